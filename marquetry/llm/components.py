"""Pairwise matches consolidated into groups: connected components on a two-dimensional grid of blocks."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.lineage import discard, materialise

#: Distinct edges aimed at per grid cell.
CELL_EDGES = 250_000


def components(edges: DataFrame, a: str, b: str, cell_edges: int = CELL_EDGES, max_rounds: int = 60) -> DataFrame:
    """(group_id, record_id) for each record that an edge links to another one; the group is the smallest record id in it.

    Null ends, self links and repeats are no links; an empty table gives no rows.

    Vertices are hashed into blocks, an edge belongs to the cell of its two blocks, so the links of a hot record spread over a
    row and a column of cells. Each cell runs a union-find of its own and gives every vertex its local representative. A vertex meets the
    representatives of its row and column, links them to the smallest, and is itself linked to what each of them moved to. Those links are the next round's edges; it is over when no vertex has two representatives.
    Links to a representative that stays need no exchange, so the members of a large finished group are not joined
    again; where a large one moves, the adaptive skew join splits it. Rounds are cut by written tables, of which the last round's are kept.
    """
    links = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    state = materialise(links.distinct(), "links")
    for _ in range(max_rounds):
        blocks = max(2, math.ceil(math.sqrt(2 * state.count() / cell_edges)))
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))  # noqa: E731, B023
        cells = state.select("u", "v", F.least(block("u"), block("v")).alias("row"), F.greatest(block("u"), block("v")).alias("col"))
        local = cells.groupBy("row", "col").applyInArrow(_local_union_find, "v string, rep string")
        met = materialise(local, "met")
        known = materialise(met.groupBy("v").agg(F.min("rep").alias("low"), F.max("rep").alias("high")), "reps")
        if known.where("low < high").isEmpty():
            discard(state, met)
            return known.select(F.col("low").alias("group_id"), F.col("v").alias("record_id"))
        moved = known.where("low < v").select(F.col("v").alias("rep"), F.col("low").alias("to"))
        followed = met.join(moved, "rep", "left").select(F.coalesce("to", "rep").alias("u"), "v")
        torn = known.where("low < high").select("v", F.col("low").alias("u"))
        hooked = met.join(torn, "v").select("u", F.col("rep").alias("v"))
        before, state = state, materialise(followed.unionByName(hooked).where(F.col("u") != F.col("v")).distinct(), "links")
        discard(before, met, known)
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _local_union_find(cell: pa.Table) -> pa.Table:
    """Every vertex of one cell with the smallest vertex that the cell links it to."""
    u, v = cell.column("u").combine_chunks(), cell.column("v").combine_chunks()
    n = len(u)
    both = pa.concat_arrays([u, v]).dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[both.indices.to_numpy()]
    rep = smallest_linked(codes[:n], codes[n:], len(names))
    by_rank = names.take(pa.array(order))
    return pa.table({"v": by_rank, "rep": by_rank.take(pa.array(rep))})


def smallest_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of the component of each of ``n`` vertices: hooking to smaller roots, then halving the paths."""
    parent = np.arange(n)
    while len(u):
        ru, rv = parent[u], parent[v]
        differ = ru != rv
        u, v, ru, rv = u[differ], v[differ], ru[differ], rv[differ]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent
