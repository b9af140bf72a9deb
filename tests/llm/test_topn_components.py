"""Top N per group and connected components against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from marquetry.llm.components import components, smallest_linked
from marquetry.llm.topn import top_n

DAY = [dt.date(2025, 6, 1), dt.date(2025, 6, 2)]


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if None in (g, i, s) or math.isnan(s):
            continue
        best[g, i] = max(best.get((g, i), -math.inf), s)
    out = set()
    for g in {k[0] for k in best}:
        out |= {(g, i) for (i, s) in sorted(((i, s) for (h, i), s in best.items() if h == g), key=lambda x: (-x[1], x[0]))[:n]}
    return out


def test_top_n_with_ties_repeats_and_several_scores_per_item(spark):
    random.seed(1)
    rows = [(random.choice(DAY), f"e{random.randrange(30):02d}", random.choice([0.1, 0.5, 0.5, 0.9, float("nan"), None])) for _ in range(400)]
    rows += rows[:50] + [(None, "x", 0.5), (DAY[0], None, 0.9)] + [(DAY[1], "hot", k / 100) for k in range(60, 100)]
    df = spark.createDataFrame(rows, "g date, i string, s double").withColumn("rank", F.lit("clash")).withColumn("score", F.lit(0))
    for n in (1, 3, 10, 100):
        got = top_n(df, "g", "i", F.col("s"), n)
        assert {(r.g, r.i) for r in got.collect()} == brute_top(rows, n)
    assert top_n(df, "g", "i", F.col("s"), 0).count() == 0


def test_top_n_of_an_empty_table(spark):
    df = spark.createDataFrame([], "g date, i string, s double")
    assert top_n(df, "g", "i", F.col("s"), 5).count() == 0


def test_top_n_prunes_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("i"), F.rand(1).alias("s"))
    from pyspark.sql import Window

    plan = df.withColumn("r", F.dense_rank().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))).where("r <= 3")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def brute_components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {(find(x), x) for x in parent}


def test_components_match_union_find(spark):
    random.seed(2)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(120)]
    star = [("hub", f"s{i:04d}") for i in range(400)]
    noise = [(f"n{random.randrange(200)}", f"n{random.randrange(200)}") for _ in range(150)]
    pairs = chain + star + noise + [(b, a) for a, b in noise] + [("self", "self"), (None, "x"), ("y", None)]
    random.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("v", F.lit(1)).withColumn("rep", F.lit("clash"))
    got = {(r.group_id, r.record_id) for r in components(df, "a", "b", cell_edges=60).collect()}
    assert got == brute_components(pairs)


def test_components_of_no_links(spark):
    assert components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0
    assert components(spark.createDataFrame([("a", "a"), (None, "b")], "a string, b string"), "a", "b").count() == 0


def test_smallest_linked_is_the_smallest():
    import numpy as np

    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    got = smallest_linked(u, v, 300)
    want = {int(x): int(r) for r, x in brute_components([(int(a), int(b)) for a, b in zip(u, v)])}
    assert all(got[x] == want.get(x, x) for x in range(300))
