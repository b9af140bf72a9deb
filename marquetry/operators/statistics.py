"""Robust curve fitting, change detection, source terms and reproducible samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.functions.numeric import expected_tags, huber
from marquetry.functions.text import hash_bucket
from marquetry.operators.lineage import materialise


def source_multipliers(df: DataFrame, source: str, actual: Column, predicted: Column, shrink: int = 5) -> DataFrame:
    """(source, n, multiplier): actual over predicted, shrunk toward one by ``shrink`` rows; one where nothing is predicted."""
    g = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.sum(actual).alias("a"), F.sum(predicted).alias("p"))
    ratio = F.when(F.col("p") > 0, F.col("a") / F.col("p")).otherwise(1.0)
    return g.select(source, "n", (1 + F.col("n") / (F.col("n") + shrink) * (ratio - 1)).alias("multiplier"))


#: Bounds of the curve's cap and saturation, and the points of the first grid and the finer ones along each.
CAPS, SATURATIONS, POINTS, FINER = (0.5, 15.0), (10.0, 3000.0), 60, 40


def spaced(low: float, high: float, n: int, geometric: bool = False) -> list[float]:
    return [low * (high / low) ** (i / (n - 1)) if geometric else low + (high - low) * i / (n - 1) for i in range(n)]


def curve_fit(df: DataFrame, chars: str, tags: str, spans: tuple[float, ...] = (0.5, 0.1, 0.02)) -> tuple[float, float, float] | None:
    """(cap, saturation, loss) with the least Huber loss: a grid of caps, linear, by saturations, geometric, then finer grids around the best; the first of
    equals, cap before saturation, and a finer one only if it is better. Null without rows. Rows with a null, or without a length, are left out.

    Rows are reduced to their distinct (chars, tags) with counts once; each grid is a literal that they are exploded by, and one row comes back.
    """
    h = materialise(df.where(F.col(tags).isNotNull() & (F.col(chars) > 0)).groupBy(F.col(chars).alias("chars"), F.col(tags).alias("tags")).agg(F.count(F.lit(1)).alias("n")), "curve-rows")
    best = None
    grids: list = [(spaced(*CAPS, POINTS), spaced(*SATURATIONS, POINTS, True)), *spans]
    for grid in grids:
        if isinstance(grid, float):
            cap, saturation, _ = best
            grid = (spaced(max(CAPS[0], cap - grid * 4), min(CAPS[1], cap + grid * 4), FINER), spaced(max(SATURATIONS[0], saturation * (1 - grid)), min(SATURATIONS[1], saturation * (1 + grid)), FINER))
        found = grid_fit(h, "chars", "tags", *grid, weight="n").first()
        if found is None:
            return None
        if best is None or found.loss < best[2]:
            best = (found.cap, found.saturation, found.loss)
    return best


def grid_fit(df: DataFrame, chars: str, tags: str, caps: list[float], saturations: list[float], weight: str | None = None) -> DataFrame:
    """(cap, saturation, loss) of the grid point with the least Huber loss, to six digits; the first of equals.

    Rows are reduced to their distinct (chars, tags) with counts before they meet the grid, which is a literal: the join is a local explode.
    """
    h = df.where(F.col(chars).isNotNull() & F.col(tags).isNotNull()).groupBy(chars, tags).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    grid = F.explode(F.array(*[F.lit(x) for x in caps]))
    each = h.withColumn("cap", grid).withColumn("saturation", F.explode(F.array(*[F.lit(x) for x in saturations])))
    loss = F.sum(F.col("n") * huber(F.col(tags) - expected_tags(F.col(chars), F.col("cap"), F.col("saturation"))))
    return each.groupBy("cap", "saturation").agg(F.round(loss, 6).alias("loss")).orderBy("loss", "cap", "saturation").limit(1)


#: Rows of one part that are summed up in one task.
CHUNK = 100_000


def cusum(df: DataFrame, part: str, order: list[str], value: str, baseline: int = 30, slack: float = 0.5, alarm: float = 5.0, remaining: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(part, alarm_at, direction): the position of the first alarm of a two-sided cumulative sum after ``baseline`` rows, if ``remaining`` rows or more are left from it on.

    The recursion max(0, s + x) equals S_i - min(0, min S_j) of running sums. Rows are numbered over the whole table and cut into chunks of a part; sums and least
    sums run within a chunk, on what the chunks before it carry over, so a part of any size is watched in parallel. Parts whose baseline is short or does not vary are
    left out, and an alarm with too few rows left ends the watch of its part.
    """
    from marquetry.operators.ranking import number_rows

    rows = number_rows(df.where(F.col(part).isNotNull()).select(part, *order, F.col(value).alias("v")), F.col(part).asc(), *[F.col(c).asc() for c in order], name="__row")
    first = rows.groupBy(part).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__size"))
    n = rows.join(first, part).withColumn("i", F.col("__row") - F.col("__first") + 1).select(part, "i", "v", "__size")
    base = n.where(F.col("i") <= baseline).groupBy(part).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count(F.lit(1)).alias("n"))
    z = n.where(F.col("i") > baseline).join(base.where((F.col("sd") > 0) & (F.col("n") >= baseline)), part).withColumn("z", (F.col("v") - F.col("mean")) / F.col("sd")).withColumn("chunk", F.floor(F.col("i") / chunk))
    inside = Window.partitionBy(part, "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    s = z.withColumn("up", F.sum(F.col("z") - slack).over(inside)).withColumn("down", F.sum(F.col("z") + slack).over(inside))
    s = materialise(s.withColumn("least", F.min("up").over(inside)).withColumn("most", F.max("down").over(inside)).select(part, "i", "chunk", "up", "down", "least", "most", "__size"), "running-sums")
    # what each chunk starts from: sums and extremes of those before it, a row per chunk
    ends = s.groupBy(part, "chunk").agg(F.max_by("up", "i").alias("u"), F.max_by("down", "i").alias("d"), F.min("up").alias("lu"), F.max("down").alias("md"))
    before = Window.partitionBy(part).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("u0", F.coalesce(F.sum("u").over(before), F.lit(0.0))).withColumn("d0", F.coalesce(F.sum("d").over(before), F.lit(0.0)))
    ends = ends.withColumn("l0", F.min(F.col("u0") + F.col("lu")).over(before)).withColumn("m0", F.max(F.col("d0") + F.col("md")).over(before))
    s = s.join(ends.select(part, "chunk", "u0", "d0", "l0", "m0"), [part, "chunk"])
    high = F.col("u0") + F.col("up") - F.least(F.lit(0.0), F.col("l0"), F.col("u0") + F.col("least"))
    low = F.col("d0") + F.col("down") - F.greatest(F.lit(0.0), F.col("m0"), F.col("d0") + F.col("most"))
    hit = s.withColumns({"high": high, "low": low}).where((F.col("high") > alarm) | (F.col("low") < -alarm))
    found = hit.groupBy(part).agg(F.min("i").cast("int").alias("alarm_at"), F.min_by(F.when(F.col("high") > alarm, "up").otherwise("down"), "i").alias("direction"), F.max("__size").alias("__size"))
    return found.where(F.col("__size") - F.col("alarm_at") + 1 >= remaining).drop("__size")


def strata(score: Column, verdict: Column, floor: float = 0.70) -> Column:
    return F.when(verdict == "merged", "merged").when(score >= floor, "near_miss").otherwise("sampled")


def latch(churn: DataFrame, part: str, least_rate: float = 0.5, least_evidence: int = 20, least_runs: int = 2) -> DataFrame:
    """(part, evidence, runs, armed): runs whose churn rate reaches ``least_rate`` add their churned rows; enough of both arms the latch."""
    good = churn.where((F.col("seen") > 0) & (F.col("churned") / F.col("seen") >= least_rate))
    g = good.groupBy(part).agg(F.sum("churned").alias("evidence"), F.count(F.lit(1)).alias("runs"))
    return g.withColumn("armed", (F.col("evidence") >= least_evidence) & (F.col("runs") >= least_runs))


def refit_gate(df: DataFrame, key: str, chars: str, tags: str, candidate: tuple[float, float], incumbent: tuple[float, float], folds: int = 5) -> DataFrame:
    """(candidate_loss, incumbent_loss, accepted): mean Huber losses on the fold of hash zero, which the fit does not see; the candidate must be strictly better."""
    held = df.where((hash_bucket(F.col(key), folds) == 0) & F.col(chars).isNotNull() & F.col(tags).isNotNull())
    loss = lambda p: F.avg(huber(F.col(tags) - expected_tags(F.col(chars), F.lit(float(p[0])), F.lit(float(p[1])))))
    g = held.agg(loss(candidate).alias("candidate_loss"), loss(incumbent).alias("incumbent_loss"))
    return g.withColumn("accepted", F.coalesce(F.col("candidate_loss") < F.col("incumbent_loss"), F.lit(False)))


def drop_before(df: DataFrame, changes: DataFrame, part: str, order: list[str], at: str) -> DataFrame:
    """The rows of each part from the position ``at`` of its change on; parts without a change stay whole."""
    from marquetry.operators.ranking import number_rows

    n = number_rows(df, F.col(part).asc(), *[F.col(c).asc() for c in order], name="__row")
    first = n.groupBy(F.col(part).alias("__part")).agg(F.min("__row").alias("__first"))
    n = n.join(first, F.col(part).eqNullSafe(F.col("__part"))).join(changes.select(F.col(part).alias("__changed"), F.col(at).alias("__at")), F.col(part) == F.col("__changed"), "left")
    return n.where(F.col("__at").isNull() | (F.col("__row") - F.col("__first") + 1 >= F.col("__at"))).drop("__row", "__first", "__part", "__at", "__changed")
