"""Scores, weather, stages and numbering against brute force and stated boundaries."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marquetry.functions import numeric as N
from marquetry.functions import text as T
from marquetry.operators import matching, ranking, scoring, stages, statistics

GENERAL = scoring.Scoring(midpoint=0.5, temperature=0.1)


def test_contributions_and_scores(spark):
    unit = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [0.6, 0.8], 4: [0.0, 0.0], 5: [-1.0, 0.0]}
    vectors = spark.createDataFrame([(k, v) for k, v in unit.items()] + [(9, None)], "vid long, v array<double>")
    items = spark.createDataFrame([("a", 0, "music", 1.0, 1), ("a", 1, "music", 0.5, 2), ("a", None, "music", 1.0, 3), ("b", 0, "general", 1.0, 3), ("c", 0, "general", 1.0, 4), ("d", 0, "general", 1.0, 8), ("e", 0, "music", 1.0, 5)], "id string, position int, scope string, weight double, vid long")
    likes = [(10, [1.0, 0.0], "like", "general"), (11, [2.0, 0.0], "like", "general"), (12, [0.0, 3.0], "like", "music")]
    dislikes = [(20, [0.0, 1.0], "dislike", "general"), (21, None, "dislike", "general")]
    prefs = lambda rows: spark.createDataFrame(rows, "pid long, p array<double>, side string, domain string")
    got = {(r.id, r.position): (r.factor, r.pid, round(r.contribution, 9) if r.contribution is not None else None) for r in scoring.contributions(items, vectors, prefs(likes + dislikes), ["music"], GENERAL).collect()}
    g = lambda s: 1 / (1 + math.exp(-(s - 0.5) / 0.1))
    assert got == {
        ("a", 0): ("like", 10, round(g(1), 9)),  # the first of two equal ones
        ("a", 1): ("dislike", 20, round(-0.5 * g(1), 9)),  # a tie goes to the dislike
        ("a", None): ("dislike", 20, round(-0.8 * g(0.8), 9)),  # the like of the scope is only as similar
        ("b", 0): ("dislike", 20, round(-0.8 * g(0.8), 9)),
        ("c", 0): ("dislike", 20, round(-0.0, 9)),  # a zero vector is similar to nothing
        ("e", 0): ("dislike", 20, -0.0),
    }
    scores = {r.id: r for r in scoring.similarity_scores(scoring.contributions(items, vectors, prefs(likes + dislikes), ["music"], GENERAL), GENERAL).collect()}
    assert scores["a"].tag_score == pytest.approx(g(1) - 0.5 * g(1)) and scores["a"].base_score == pytest.approx(0.5 * g(1) - 0.3 * 0.8 * g(0.8))
    assert scores["b"].match == "no" and scores["c"].match == "maybe" and "d" not in scores
    only = scoring.contributions(items, vectors, prefs(likes), ["music"], GENERAL)
    assert {(r.id, r.position): r.factor for r in only.collect()}[("e", 0)] is None  # no dislike, and the like is not above zero
    assert scoring.contributions(items, vectors, prefs([]), ["music"], GENERAL).count() == 0
    assert scoring.contributions(items.where("false"), vectors, prefs(likes), ["music"], GENERAL).count() == 0
    for block in (1, 2):
        assert {tuple(r) for r in scoring.nearest(vectors, prefs(likes).drop("domain"), block).collect()} == {tuple(r) for r in scoring.nearest(vectors, prefs(likes).drop("domain")).collect()}


def test_similar_pairs_against_brute_force(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(6)]) for i in range(60)] + [(60, None), (61, [0.0] * 6), (None, [1.0] * 6)]
    v = spark.createDataFrame(rows, "vid long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    want = {(a, b) for a, x in rows[:60:5] for b, y in rows[:60] if a != b and cos(x, y) >= 0.4}
    for block in (4, 100):
        got = {(r.qid, r.vid) for r in scoring.similar_pairs(v, v.where("vid % 5 = 0").selectExpr("vid AS qid", "v AS q"), 0.4, block).collect()}
        assert got == want


def test_comfort_of_several_curves(spark):
    c = {"warm": N.Comfort((10, 20), (0, 30), (-10, 40), 2.0), "dew": N.Comfort((5, 10), (0, 15), (-5, 20), 1.0), "humid": N.Comfort((40, 60), (20, 80), (0, 100), 1.0, fallback_for="dew"), "rain": N.Comfort((0, 1), (0, 2), (0, 3), supersedes=("rain",))}
    rows = [(15.0, 7.0, 0.0, None, "clear"), (15.0, None, 0.0, None, "clear"), (15.0, 7.0, None, 2.5, "rain"), (15.0, 7.0, None, None, "rain"), (15.0, 7.0, None, None, "storm"), (None, None, None, None, "storm"), (None, None, None, 0.5, None), (35.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "warm double, dew double, humid double, rain double, sky string")
    got = [r[0] for r in df.select(N.comfort({k: (F.col(k), v) for k, v in c.items()}, F.col("sky"), {"rain": -0.6, "storm": -1.0, "clear": 0.0})).collect()]
    assert got == [1.0, pytest.approx((2 - 1) / 3), -0.5, -0.6, -1.0, None, 0.0, -0.5]
    add = df.select(N.weather_adjustment(F.lit(-0.4), F.lit("outdoor")), N.weather_adjustment(F.lit(0.4), F.lit("outdoor")), N.weather_adjustment(F.lit(0.4), F.lit("indoor")), N.weather_adjustment(F.lit(None).cast("double"), F.lit("outdoor")), N.wmo_condition(F.lit(95)), N.wmo_condition(F.lit(7))).first()
    assert list(add) == [pytest.approx(-0.1), pytest.approx(0.06), 0.0, 0.0, "thunderstorm", "overcast"]
    hours = F.array(*[F.struct(F.lit(h).alias("hour"), F.lit(h * 1.5).alias("t")) for h in (19, 20)])
    at = spark.range(1).select(N.sample_hour(hours, F.lit(dt.datetime(2025, 1, 1, 19, 30)), F.lit(True))["t"], N.sample_hour(hours, F.lit(dt.datetime(2025, 1, 1, 19)), F.lit(False))["t"], N.sample_hour(hours, F.lit(dt.datetime(2025, 1, 1, 3)), F.lit(True))["t"]).first()
    assert list(at) == [28.5, 30.0, None]


def test_ranks_of_a_crowd_of_equal_scores(spark):
    rows = [("g", 0.5, f"k{i:05}") for i in range(3000)] + [("h", float(i), f"k{i}") for i in range(50)] + [(None, 1.0, "n"), ("g", None, "x"), ("g", float("nan"), "y")]
    random.Random(1).shuffle(rows)
    got = {(r.g, r.i): r["rank"] for r in ranking.rank_all(spark.createDataFrame(rows, "g string, s double, i string"), "g", "s", "i").collect()}
    assert got == {("g", f"k{i:05}"): i + 1 for i in range(3000)} | {("h", f"k{i}"): 50 - i for i in range(50)} | {(None, "n"): 1}
    assert ranking.rank_all(spark.createDataFrame([], "g string, s double, i string"), "g", "s", "i").count() == 0


@pytest.mark.parametrize("chunk", [7, 100_000])
def test_cusum_by_chunks_against_the_recursion(spark, chunk):
    random.seed(4)
    series = {p: [random.gauss(0, 1) + (shift if i >= at else 0) for i in range(n)] for p, n, at, shift in (("up", 200, 120, 3), ("down", 200, 90, -2), ("flat", 100, 100, 0), ("late", 60, 55, 9), ("short", 20, 0, 0))}
    series["still"] = [1.0] * 80
    want = {}
    for p, xs in series.items():
        base = xs[:30]
        mean = sum(base) / len(base)
        sd = math.sqrt(sum((x - mean) ** 2 for x in base) / len(base))
        high = low = 0.0
        for i, x in enumerate(xs) if len(xs) >= 30 and sd > 1e-12 else ():
            if i < 30:
                continue
            high, low = max(0.0, high + (x - mean) / sd - 0.5), min(0.0, low + (x - mean) / sd + 0.5)
            if max(high, -low) > 5:
                if len(xs) - i >= 10:
                    want[p] = (i + 1, "up" if high > 5 else "down")
                break
    rows = [(p, i, x) for p, xs in series.items() for i, x in enumerate(xs)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "p string, t int, x double")
    found = statistics.cusum(df, "p", ["t"], "x", chunk=chunk)
    assert {r.p: (r.alarm_at, r.direction) for r in found.collect()} == want and "late" not in want
    left = statistics.drop_before(df, found, "p", ["t"], "alarm_at").groupBy("p").count().collect()
    assert {r.p: r["count"] for r in left} == {p: len(xs) - (want[p][0] - 1 if p in want else 0) for p, xs in series.items()}


def test_curve_fit_finds_the_curve(spark):
    rows = [(c, 4.2 * (1 - math.exp(-c / 150)) + ((c * 7) % 5 - 2) * 0.01) for c in range(5, 900, 7)] + [(None, 1.0), (0, 3.0), (50, None)]
    cap, saturation, _ = statistics.curve_fit(spark.createDataFrame(rows, "chars int, tags double"), "chars", "tags")
    assert abs(cap - 4.2) < 0.05 and abs(saturation - 150) < 5
    assert statistics.curve_fit(spark.createDataFrame([], "chars int, tags double"), "chars", "tags") is None


def test_stages(spark):
    df = spark.sql("SELECT * FROM VALUES ('Show', 'Mill', '', 'Text', 'music'), (NULL, NULL, NULL, NULL, NULL), ('', '', 'Town', '', '') AS t(a, b, c, d, e)")
    assert [r[0] for r in df.select(stages.extraction_text(*[F.col(x) for x in "abcde"])).collect()] == ["Show\nVenue: Mill\nText\nEvent category: music", "", "Venue: Town"]
    calls = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "t string")
    assert sorted((r.t or "", r.n) for r in stages.per_distinct(calls, "t", lambda xs: [len(xs) * 0 + len(x) for x in xs], "n int").collect()) == [("", None), ("a", 1), ("a", 1), ("b", 1)]
    now, done = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "z")], "k int, c string"), spark.createDataFrame([(1, "x"), (2, None), (3, "n")], "k int, c string")
    assert {r.k for r in stages.changed(now, done, "k", "c").collect()} == {3, 4}
    tags = spark.sql("""SELECT parse_json('["a b", {"tag": " jazz ", "weight": 0.4}, {"text": "folk", "weight": 7}, "", {"weight": 1}]') AS v""").select(stages.tags_of(F.col("v"))).first()[0]
    assert [(t.text, t.weight) for t in tags] == [("a b", 1.0), ("jazz", 0.4), ("folk", 1.0)]
    one = spark.range(1).select(stages.with_fallback(F.array().cast("array<struct<text:string,weight:double>>"), F.lit("film")), stages.with_fallback(F.array(F.struct(F.lit("x").alias("text"), F.lit(0.5).alias("weight"))), F.lit("film")), stages.setting_of(F.lit(" Outdoor ")), stages.setting_of(F.lit("moon"))).first()
    assert (one[0][0].text, one[1][0].text, one[2], one[3]) == ("film", "x", "outdoor", "unknown")
    rows, stored = spark.createDataFrame([(1, "h", None), (2, "h", [9.0]), (3, "q", None)], "k int, c string, v array<double>"), spark.createDataFrame([("h", [1.0], 1), ("h", [2.0], 2), ("q", None, 3)], "c string, v array<double>, at int")
    assert {r.k: r.v for r in stages.carried(rows, stored, "c", "v", "at").collect()} == {1: [2.0], 2: [9.0], 3: None}
    lines, cache = spark.createDataFrame([("f", "h1", "new"), ("f", "h2", "x")], "file string, hash string, domain string"), spark.createDataFrame([("f", "h1", "old", 7), ("f", "h9", "old", 8)], "file string, hash string, domain string, vec int")
    kept, new, gone = stages.renewed(cache, lines, ["file", "hash"])
    assert [(r.hash, r.domain, r.vec) for r in kept.collect()] == [("h1", "new", 7)] and [r.hash for r in new.collect()] == ["h2"] and [r.hash for r in gone.collect()] == ["h9"]
    assert stages.revision(lines, "file", "hash").first() == stages.revision(lines.orderBy(F.desc("hash")), "file", "hash").first() != stages.revision(lines.limit(1), "file", "hash").first()


def test_small_texts(spark):
    df = spark.createDataFrame([("café ✨ night​",), ("\U0001f37a",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.embedding_text(F.col("t"))).collect()] == ["café night", "beer mug", None, ""]
    got = spark.createDataFrame([(b"\x89PNG\r\n\x1a\n",), (b"RIFF1234WEBPVP8",), (b"RIFF1234WAVE",), (b"GIF89a",), (b"",)], "b binary").select(T.image_type(F.col("b"))).collect()
    assert [r[0] for r in got] == ["image/png", "image/webp", "image/jpeg", "image/gif", "image/jpeg"]
    assert [r[0] for r in spark.sql("SELECT explode(array(0L, 59L, 60L, 3599L, 3600L, 7505L)) AS s").select(T.duration(F.col("s"))).collect()] == ["0s", "59s", "1m", "59m", "1h00m", "2h05m"]


def test_clusters_reach_their_fixed_point(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x")]
    got = {r.id: r.cluster for r in matching.clusters(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {f"c{i:03}": "c000" for i in range(41)} | {f"s{i}": "hub" for i in range(50)} | {"hub": "hub"}
