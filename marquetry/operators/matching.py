"""Guarded pair joins, clusters and merges of records, and reconciliation with stored ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marquetry.functions.numeric import cosine
from marquetry.functions.text import canonical_title, canonical_venue
from marquetry.operators.lineage import discard, materialise


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / (lengths), from the longest common subsequence; 1 for two empty texts."""
    if not a and not b:
        return 1.0
    if a == b:
        return 1.0
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | 1 << i
    free = (1 << len(a)) - 1
    state = free
    for ch in b:  # bit-parallel: zeros of the state mark the subsequence
        match = state & positions.get(ch, 0)
        state = (state + match) | (state - match)
    common = (~state & free).bit_count()
    return 2.0 * common / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Indel ratio of the texts with their words sorted; null where either is null."""
    return pd.Series([None if x is None or y is None else indel_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def length_bound(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths alone allow a ratio of ``least``; keeps hopeless pairs from the Python worker."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


#: Records of one venue and bucket that meet in one task.
MEETING = 2_000


def guarded_pairs(events: DataFrame, key: str, title: str, venue: str, start: str, hours: int = 2, meeting: int = MEETING) -> DataFrame:
    """(a, b, title_a, title_b): pairs with the same venue and starts at most ``hours`` apart; exact copies are collapsed first.

    Both venues or both starts may be null, which matches; one null doesn't. Copies with equal canonical title, venue and start
    are represented by the smallest key and come out as (representative, copy) with equal titles. Starts are bucketed, and a row meets its own bucket and the
    next, so the join is on venue and bucket; one with more than ``meeting`` rows is joined in blocks. A venue's copies meet no one but their representative.
    """
    rows = events.select(F.col(key).alias("id"), canonical_title(F.col(title)).alias("t"), canonical_venue(F.col(venue)).alias("v"), F.col(start).cast("timestamp").cast("long").alias("s")).distinct()
    rows = materialise(rows, "guarded")
    same = rows.groupBy("t", "v", "s").agg(F.min("id").alias("rep"))
    copies = rows.alias("x").join(same.alias("y"), F.col("x.t").eqNullSafe(F.col("y.t")) & F.col("x.v").eqNullSafe(F.col("y.v")) & F.col("x.s").eqNullSafe(F.col("y.s")))
    copies = copies.where("x.id <> y.rep").select(F.col("y.rep").alias("a"), F.col("x.id").alias("b"), F.col("x.t").alias("title_a"), F.col("x.t").alias("title_b"))
    width = hours * 3600
    g, k = F.xxhash64(F.coalesce("v", F.lit("\0"))), F.coalesce(F.floor(F.col("s") / width), F.lit(-1 << 40))
    reps = same.select(F.col("rep").alias("id"), "t", "v", "s", g.alias("g"), k.alias("k"))
    # a crowded venue and bucket, such as that of rows without either, is joined in blocks: every two blocks meet in a task of their own
    crowd = reps.groupBy("g", "k").agg(F.ceil(F.count(F.lit(1)) / meeting).cast("int").alias("blocks"))
    placed = reps.join(crowd, ["g", "k"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    after = crowd.select("g", (F.col("k") - 1).alias("k"), F.col("blocks").alias("next"))
    left = placed.join(after, ["g", "k"], "left")
    own = left.select("*", F.lit(0).alias("step"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    across = left.where("next IS NOT NULL").select("*", F.lit(1).alias("step"), F.explode(F.sequence(F.lit(0), F.col("next") - 1)).alias("j"))
    asks = own.unionByName(across).select("id", "t", "v", "s", "g", (F.col("k") + F.col("step")).alias("k"), "step", "i", "j")
    before = crowd.select("g", (F.col("k") + 1).alias("k"), F.col("blocks").alias("last"))
    right = placed.join(before, ["g", "k"], "left").withColumn("j", F.col("i")).drop("i")
    answers = right.select("*", F.lit(0).alias("step"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).unionByName(right.where("last IS NOT NULL").select("*", F.lit(1).alias("step"), F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("i")))
    met = asks.alias("x").join(answers.alias("y"), ["g", "k", "step", "i", "j"])
    near = (F.col("x.s").isNull() & F.col("y.s").isNull()) | (F.abs(F.col("x.s") - F.col("y.s")) <= width)
    once = F.when(F.col("step") == 0, F.col("x.id") < F.col("y.id")).otherwise(F.col("x.id") != F.col("y.id")) & F.col("x.v").eqNullSafe(F.col("y.v"))
    met = met.where(once & near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), F.when(F.col("x.id") < F.col("y.id"), F.col("x.t")).otherwise(F.col("y.t")).alias("title_a"), F.when(F.col("x.id") < F.col("y.id"), F.col("y.t")).otherwise(F.col("x.t")).alias("title_b"))
    return met.distinct().unionByName(copies)


def fuzzy_pairs(pairs: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, score, verdict) of guarded pairs; both titles null score one, one null is incomparable and left out."""
    both = F.col("title_a").isNull() & F.col("title_b").isNull()
    one = F.col("title_a").isNull() != F.col("title_b").isNull()
    score = F.when(both | F.col("title_a").eqNullSafe(F.col("title_b")), 1.0).otherwise(token_sort_ratio("title_a", "title_b"))
    scored = pairs.where(~one).withColumn("score", score)
    return scored.select("a", "b", "score", F.when(F.col("score") >= least, "merged").otherwise("distinct").alias("verdict"))


def clusters(edges: DataFrame, a: str, b: str, max_rounds: int = 40) -> DataFrame:
    """(id, cluster): connected components by alternating stars; the cluster is its smallest id. A round is two aggregations, cut by written tables."""
    state = materialise(edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "stars")
    before = _sum_of(state)
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").distinct()
        large = materialise(large, "stars")
        small_low = large.groupBy("v").agg(F.min("u").alias("m"))
        hooked = large.join(small_low, "v").select(F.col("m").alias("u"), F.explode(F.array("v", "u")).alias("v")).where(F.col("u") != F.col("v")).distinct()
        new = materialise(hooked, "stars")
        if (now := _sum_of(new)) == before:
            return new.select(F.col("v").alias("id"), F.col("u").alias("cluster")).unionByName(new.select(F.col("u").alias("id"), F.col("u").alias("cluster")).distinct())
        discard(state, large)
        state, before = new, now
    raise RuntimeError("no fixed point")


def _sum_of(pairs: DataFrame) -> tuple:
    """The number of pairs and two sums of hashes of them; equal sets of pairs have equal ones."""
    hashes = [F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)")) for seed in (1, 2)]
    return tuple(pairs.agg(F.count(F.lit(1)), *hashes).first())


def merge_clusters(rows: DataFrame, members: DataFrame, key: str, fields: list[str], created: str) -> DataFrame:
    """One row per cluster: the member with the fewest nulls (ties: earliest, then smaller key) wins, and each of its nulls is
    filled from the next best. ``min_by`` with a filter does it in one aggregation, so no cluster is gathered."""
    nulls = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0))
    joined = rows.join(members.select(F.col("id").alias("__id"), "cluster"), F.col(key) == F.col("__id")).withColumn("__order", F.struct(nulls.alias("n"), F.col(created), F.col(key)))
    best = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("__order"))).alias(f) for f in fields]
    return joined.groupBy("cluster").agg(F.min_by(key, "__order").alias("winner"), F.count(F.lit(1)).alias("members"), *best)


def reconcile(fresh: DataFrame, stored: DataFrame, key: str, shared: str, depth: Column, created: str) -> DataFrame:
    """(fresh_key, stored_key, place): the stored rows that share a candidate with a fresh one; the deepest wins, then the earliest, then the smaller key. Place 1 is the winner, the others are stale."""
    f = fresh.select(F.col(key).alias("fresh_key"), F.explode(F.array_distinct(shared)).alias("c"))
    s = stored.select(F.col(key).alias("stored_key"), F.col(created).alias("created"), depth.alias("depth"), F.explode(F.array_distinct(shared)).alias("c"))
    met = f.join(s, "c").where(F.col("fresh_key") != F.col("stored_key")).groupBy("fresh_key", "stored_key").agg(F.min("created").alias("created"), F.max("depth").alias("depth"))
    order = Window.partitionBy("fresh_key").orderBy(F.desc("depth"), "created", "stored_key")
    return met.withColumn("place", F.row_number().over(order)).select("fresh_key", "stored_key", "place")


def cluster_supersession(members: DataFrame, winners: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, superseded_by, similarity) of the losers; the similarity is that of the pair with the winner, null if they never met."""
    losers = members.join(winners.select("cluster", "winner"), "cluster").where(F.col("id") != F.col("winner"))
    scored = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("similarity"))
    at = (F.least("id", "winner") == F.col("a")) & (F.greatest("id", "winner") == F.col("b"))
    return losers.join(scored, at, "left").select("id", F.col("winner").alias("superseded_by"), "similarity")


def semantic_pairs(pairs: DataFrame, vectors: DataFrame, key: str, vector: str, least: float = 0.92) -> DataFrame:
    """(a, b, score, verdict) of guarded pairs by the cosine of their vectors; a missing vector is incomparable and leaves the pair out."""
    v = vectors.select(F.col(key).alias("__k"), F.col(vector).alias("__v")).dropDuplicates(["__k"])
    left = pairs.select("a", "b").join(v, F.col("a") == F.col("__k")).select("a", "b", F.col("__v").alias("__va"))
    both = left.join(v, F.col("b") == F.col("__k")).withColumn("score", cosine(F.col("__va"), F.col("__v")))
    return both.select("a", "b", "score", F.when(F.col("score") >= least, "merged").otherwise("distinct").alias("verdict"))
