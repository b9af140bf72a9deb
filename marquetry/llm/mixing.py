"""Sources mixed to target weights: entropy balancing by distributed Newton steps, then rounding into copies."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise

#: Documents of one size that are numbered together, about.
STRATUM = 50_000
#: A source whose targets would allow less than this share of all tokens does not hold the mix down; it is repeated to its cap and falls short.
LEAST_REACH = 0.1


def reachable_total(have: dict[str, float], targets: dict[str, tuple[float, int]], least_reach: float = LEAST_REACH) -> float:
    """The largest total at which every source reaches its target within its repeats, but for sources that would allow less than ``least_reach`` of what there is."""
    reach = [have.get(s, 0) * cap / share for s, (share, cap) in targets.items() if share > 0]
    enough = [r for r in reach if r >= least_reach * sum(have.values()) and r > 0]
    return min(enough) if enough else max(reach, default=0.0)


def mix(documents: DataFrame, targets: DataFrame, key: str, total: float | None = None, tolerance: float = 1e-6, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(copies, report). ``documents(key, source, tokens)``, ``targets(source, target_share, max_repeats)``.

    ``copies(key, source, tokens, copies)`` has every document taken at least once. ``report(source, target_share, max_repeats, documents,
    available_tokens, wanted_tokens, mixed_tokens, actual_share, tilt)`` has a row per target, also of those without documents.

    Rates are exp(tilt * tokens / mean), capped at the source's repeats: among all rates with the wanted tokens those nearest, in entropy, to taking each
    document once. The tilts solve the convex dual; each Newton step is one aggregation over the histogram of sizes per source, guarded by
    bisection. A target beyond the repeats gets the cap. Documents without source, target or tokens are left out; repeated
    rows are documents of their own; of repeated targets the larger stands. ``targets`` is collected and broadcast: it has a row per source of a mix.

    Rates are rounded in tokens: from the largest size to the smallest, the documents of one size get the whole number of copies that is nearest to their
    rates and what the larger ones left over or owe, so a source misses its tokens by about half of its smallest document. That runs over the histogram,
    which has a row per distinct size of a source. Within a size the copies are spread evenly by whole-number arithmetic over strata of documents, so
    a size of any number of documents is spread in parallel; no document exceeds its source's repeats.
    """
    spark = documents.sparkSession
    want = {r.source: (float(r.target_share), int(r.max_repeats)) for r in targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0) & (F.col("max_repeats") >= 1)).groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).orderBy("source").collect()}
    usable = documents.where((F.col("tokens") > 0) & F.col("source").isin(*want)).select(F.col(key).alias("k"), "source", F.col("tokens").cast("long").alias("tokens")).withColumn("u", F.monotonically_increasing_id())
    usable = materialise(usable, "mix-documents")
    sizes = materialise(usable.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    have = {r.source: (r.d, float(r.t)) for r in sizes.groupBy("source").agg(F.sum("n").alias("d"), F.sum(F.col("n") * F.col("tokens")).alias("t")).collect()}
    goal = total if total is not None else reachable_total({s: t for s, (_, t) in have.items()}, want)
    aims = {s: min(share * goal, have[s][1] * cap) for s, (share, cap) in want.items() if s in have}
    mean = {s: t / d for s, (d, t) in have.items()}
    low, high, tilt = dict.fromkeys(aims, -1e3), dict.fromkeys(aims, 1e3), dict.fromkeys(aims, 0.0)
    done = {s for s in aims if aims[s] >= have[s][1] * want[s][1] * (1 - 1e-12)}
    for s in done:
        tilt[s] = 1e3

    def literal(values: dict[str, float]):
        return F.try_element_at(F.create_map(*[x for s in sorted(values) for x in (F.lit(s), F.lit(float(values[s])))]), F.col("source"))

    def rate(tilts: dict[str, float]):
        caps = literal({s: want[s][1] for s in aims})
        return F.least(caps, F.exp(F.least(literal(tilts) * F.col("tokens") / literal(mean), F.lit(50.0))))

    for _ in range(rounds):
        open_ = sorted(set(aims) - done)
        if not open_:
            break
        r = rate(tilt)
        steps = sizes.where(F.col("source").isin(*open_)).groupBy("source").agg(
            F.sum(F.col("n") * F.col("tokens") * r).alias("g"),
            F.sum(F.when(r < literal({s: want[s][1] for s in aims}), F.col("n") * F.col("tokens") * F.col("tokens") * r / literal(mean)).otherwise(0.0)).alias("h"),
        )
        for row in steps.collect():
            s = row.source
            gap = row.g - aims[s]
            if abs(gap) <= tolerance * max(1.0, aims[s]):
                done.add(s)
                continue
            (high if gap > 0 else low)[s] = tilt[s]
            step = tilt[s] - gap / row.h if row.h else math.inf
            tilt[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
    if not aims:
        taken = spark.createDataFrame([], f"`{key}` {documents.schema[key].dataType.simpleString()}, source string, tokens long, copies int")
    else:
        # whole copies per source and size, then spread over the documents of that size
        whole = materialise(sizes.withColumn("rate", rate(tilt)).withColumn("cap", literal({s: want[s][1] for s in aims}).cast("long")).withColumn("aim", literal(aims)).groupBy("source").applyInPandas(_whole_copies, "source string, tokens long, n long, total long"), "mix-totals")
        per = F.ceil(F.col("n") / STRATUM)
        placed = usable.join(whole, ["source", "tokens"]).withColumn("stratum", F.pmod(F.xxhash64("k", "u"), per))
        counts = placed.groupBy("source", "tokens", "stratum").agg(F.count(F.lit(1)).alias("c"))
        starts = counts.select("source", "tokens", "stratum", (F.sum("c").over(Window.partitionBy("source", "tokens").orderBy("stratum")) - F.col("c")).alias("start"))
        inside = Window.partitionBy("source", "tokens", "stratum").orderBy("k", "u")
        place = placed.join(starts, ["source", "tokens", "stratum"]).withColumn("i", F.col("start") + F.row_number().over(inside))
        upto = lambda i: F.expr(f"(CAST({i} AS DECIMAL(19, 0)) * CAST(total % n AS DECIMAL(19, 0))) div n")
        copies = F.floor(F.col("total") / F.col("n")) + upto("i") - upto("i - 1")
        taken = materialise(place.select(F.col("k").alias(key), "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0"), "mix-copies")
    got = {r.source: float(r.t) for r in taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).collect()}
    whole = sum(got.values())
    report = [(s, share, cap, have.get(s, (0, 0))[0], int(have.get(s, (0, 0))[1]), float(share * goal), int(got.get(s, 0)), got.get(s, 0) / whole if whole else 0.0, tilt.get(s, 0.0) if abs(tilt.get(s, 0.0)) < 1e3 else None) for s, (share, cap) in want.items()]
    schema = "source string, target_share double, max_repeats int, documents long, available_tokens long, wanted_tokens double, mixed_tokens long, actual_share double, tilt double"
    return taken, spark.createDataFrame(report, schema)


def _whole_copies(cells: pd.DataFrame) -> pd.DataFrame:
    """(source, tokens, n, total): whole copies for each size of one source, the largest size first, so that the tokens add up to the aim."""
    cells = cells.sort_values("tokens", ascending=False)
    left, expected, totals = float(cells.aim.iloc[0]), float((cells.n * cells.tokens * cells.rate).sum()), []
    for size, n, rate, cap in zip(cells.tokens, cells.n, cells.rate, cells.cap):
        expected -= n * size * rate  # what the smaller sizes are to bring
        total = min(max(round((left - expected) / size), 0), n * cap)
        left -= total * size
        totals.append(total)
    return cells[["source", "tokens", "n"]].assign(total=totals)
