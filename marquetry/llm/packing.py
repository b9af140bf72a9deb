"""Items packed into containers of fixed capacity: first fit, then swap-based local search."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise

#: Items that are packed together, about.
BLOCK = 20_000
#: Container kinds at most; they are a literal of the plan.
KINDS = 1_000


def pack(items: DataFrame, capacities: DataFrame, key: str, size: str, block: int = BLOCK, search: bool = True) -> DataFrame:
    """(container_kind, container_id, ``key``, part, first_token, tokens): every item in exactly one container of each kind.

    ``capacities(container_kind, capacity)``. Only an item larger than a capacity is split: into parts as large as the container, which fill one
    each, and a rest that is packed like other items. Items of size zero are packed, repeated rows are items of their own; null keys are left out,
    null sizes count as zero. Capacities below one and null ones are left out. Empty tables give nothing.

    Items are hashed into blocks, so that no task holds more than a block of one kind, and packed within them: a block leaves few containers
    underfull beside its hundreds. Without ``search`` the first fit stays as it is. ``capacities`` becomes a literal; more than ``KINDS`` rows raise ValueError.
    """
    kind = items.schema[key].dataType.simpleString()
    base = items.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    base = base.withColumn("u", F.monotonically_increasing_id())
    base = materialise(base, "items")
    blocks = max(1, -(-base.count() // block))
    kinds = capacities.where(F.col("container_kind").isNotNull() & (F.col("capacity") >= 1)).select("container_kind", F.col("capacity").cast("long").alias("capacity")).distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"more than {KINDS} container kinds")
    literal = F.array(*[F.struct(F.lit(r.container_kind).alias("container_kind"), F.lit(r.capacity).cast("long").alias("capacity")) for r in kinds]) if kinds else F.lit(None).cast("array<struct<container_kind:string,capacity:bigint>>")
    each = base.select("*", F.explode(literal).alias("x")).select("k", "n", "u", "x.*")
    whole = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(0)
    each = each.withColumn("whole", whole).withColumn("rest", F.col("n") - F.col("whole") * F.col("capacity"))
    name = lambda *c: F.concat_ws("-", F.col("container_kind"), *c)
    full = each.where("whole > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    full = full.select("container_kind", name(F.lit("w"), F.col("u"), F.col("part")).alias("container_id"), F.col("k").alias(key), F.col("part").cast("int").alias("part"), (F.col("part") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"))
    rest = each.where("rest > 0 or whole = 0").withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        capacity = int(group.capacity.iloc[0])
        order = group.sort_values("u")
        sizes = order.rest.tolist()
        bins = first_fit(sizes, capacity)
        bins = improve(bins, sizes, capacity) if search else bins
        where = {i: b for b, members in enumerate(bins) for i in members}
        order = order.reset_index(drop=True)
        return pd.DataFrame({"container_kind": order.container_kind, "bin": [where[i] for i in range(len(order))], "block": order.block, "k": order.k, "part": order.whole.astype("int32"), "first_token": order.whole * capacity, "tokens": order.rest})

    packed = rest.select("container_kind", "capacity", "block", "k", "u", "whole", "rest").repartition(max(1, 2 * blocks * len(kinds)), "container_kind", "block").groupBy("container_kind", "block").applyInPandas(run, f"container_kind string, bin long, block long, k {kind}, part int, first_token long, tokens long")
    packed = packed.select("container_kind", name(F.lit("p"), F.col("block"), F.col("bin")).alias("container_id"), F.col("k").alias(key), "part", "first_token", "tokens")
    return full.unionByName(packed)


def first_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices per container; each item, in the order given, goes into the first container with room for it. A tree over the rooms finds that one."""
    leaves = 1 << max(1, len(sizes) - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins: list[list[int]] = []
    for i, n in enumerate(sizes):
        at = 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= n else 2 * at + 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(i)
        room[at] -= n
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search over the underfull containers until no exchange is left: an item moves, or is exchanged for one or two smaller ones that come back,
    wherever the sum of squared fills grows. Emptied containers are dropped.

    The emptiest container gives first, its largest item first, and the taker is the one that this leaves fullest. All that a container may give back,
    nothing, an item or two, stands in one sorted table; what changed since is passed over, and once that is a quarter the next sweep makes the table anew. The search ends
    with a sweep in which nothing changed, so no such exchange is left, or when less than one container's room is open, so that none can be emptied.
    Squared fills are whole numbers that only grow, so it does end. Of equal sizes in a container one stands for all.
    """
    bins = [list(b) for b in bins]
    fill = np.array([sum(sizes[i] for i in b) for b in bins], np.int64)
    while True:
        loose = [b for b in np.argsort(fill, kind="stable").tolist() if bins[b] and fill[b] < capacity]
        open_ = sum(capacity - int(fill[b]) for b in loose)
        if open_ < capacity:
            break
        table = _offers(bins, sizes, fill, loose, capacity)
        fresh, stale, changed = np.ones(len(bins), bool), set(), False
        for giver in loose:
            if open_ < capacity or len(loose) < 4 * len(stale):
                break
            for item in sorted(bins[giver], key=lambda i: -sizes[i]):
                if (taken := _taker(table, sizes[item], giver, fill, fresh)) is None:
                    continue
                taker, back = taken
                back = _members(bins[taker], sizes, back)
                bins[giver].remove(item)
                bins[taker] = [i for i in bins[taker] if i not in back] + [item]
                bins[giver] += back
                moved = sizes[item] - sum(sizes[i] for i in back)
                fill[giver] -= moved
                fill[taker] += moved
                fresh[giver] = fresh[taker] = False
                stale |= {giver, taker}
                changed = True
            if not bins[giver]:
                open_ -= capacity
        if not changed:
            break
    return [b for b in bins if b]


def _members(members: list[int], sizes: list[int], wanted: tuple[int, ...]) -> list[int]:
    found: list[int] = []
    for m in wanted:
        found.append(next(i for i in members if sizes[i] == m and i not in found))
    return found


def _offers(bins: list[list[int]], sizes: list[int], fill: np.ndarray, loose: list[int], capacity: int) -> tuple[np.ndarray, ...]:
    """(reach, returned, bin, size one, size two), by reach: a container that gives back ``returned`` can take up to ``reach``, its room and that; sizes are -1 where nothing is given."""
    counts = [len(bins[b]) for b in loose]
    at = np.repeat(np.array(loose), counts)
    size = np.array([sizes[i] for b in loose for i in bins[b]], np.int64)
    order = np.lexsort((size, at))
    at, size = at[order], size[order]
    first = np.r_[True, (at[1:] != at[:-1]) | (size[1:] != size[:-1])]
    twice = np.flatnonzero(np.diff(np.r_[np.flatnonzero(first), len(at)]) > 1)
    at, size = at[first], size[first]
    # each size with every larger one of its container
    partners = np.searchsorted(at, at, side="right") - np.arange(len(at)) - 1
    low = np.repeat(np.arange(len(at)), partners)
    high = low + 1 + np.arange(len(low)) - np.repeat(np.cumsum(partners) - partners, partners)
    bin_ = np.r_[loose, at, at[low], at[twice]]
    one = np.r_[np.full(len(loose), -1), size, size[low], size[twice]]
    two = np.r_[np.full(len(loose) + len(at), -1), size[high], size[twice]]
    returned = np.maximum(one, 0) + np.maximum(two, 0)
    reach = capacity - fill[bin_] + returned
    order = np.lexsort((bin_, returned, reach))
    return reach[order], returned[order], bin_[order], one[order], two[order]


def _taker(table: tuple[np.ndarray, ...], n: int, giver: int, fill: np.ndarray, fresh: np.ndarray) -> tuple[int, tuple[int, ...]] | None:
    """The container that takes an item of size ``n`` and is left with the least room, and the sizes it gives back; null if no exchange lets the squared fills grow."""
    reach, returned, bin_, one, two = table
    at, step = int(reach.searchsorted(n)), 16
    filled = int(fill[giver])
    while at < len(reach):
        part = slice(at, at + step)
        b, back = bin_[part], returned[part]
        good = fresh[b] & (b != giver) & (back < n) & (fill[b] - back > filled - n)
        first = int(good.argmax())
        if good[first]:
            k = at + first
            return int(bin_[k]), tuple(int(m) for m in (one[k], two[k]) if m >= 0)
        at, step = at + step, step * 4
    return None
