"""Core operators against brute force and stated boundaries."""

import datetime as dt
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marquetry.functions import numeric as N
from marquetry.functions import text as T
from marquetry.functions import timing as M
from marquetry.operators import matching, ranking, statistics, writes
from marquetry.operators.references import failed_references
from marquetry.operators.timestamps import abbreviation_offsets, estimate_zones, normalise_fields, sequences, shared_starts, to_instants, usual_spans, zone_histories
from marquetry.plans import catalogue

UTC = dt.timezone.utc


def us(*a):
    return int(dt.datetime(*a, tzinfo=UTC).timestamp() * 1_000_000)


CASES = [
    ("2025-06-01T12:00:00Z", "America/New_York", "mdy", us(2025, 6, 1, 12)),
    ("2025-06-01t12:00:00z", "America/New_York", "mdy", us(2025, 6, 1, 12)),
    (" 2025-06-01 12:00\t", "America/New_York", "mdy", us(2025, 6, 1, 16)),
    ("2025-06-01", "Europe/London", "dmy", us(2025, 5, 31, 23)),
    ("20250601", "Asia/Kolkata", "dmy", us(2025, 5, 31, 18, 30)),
    ("2025-03-09 02:30", "America/New_York", "mdy", us(2025, 3, 9, 7, 30)),
    ("2025-11-02 01:30", "America/New_York", "mdy", us(2025, 11, 2, 5, 30)),
    ("11/2/2025 1:30 a.m. EST", "America/New_York", "mdy", us(2025, 11, 2, 6, 30)),
    ("3/4/25 9 PM", "Europe/London", "dmy", us(2025, 4, 3, 20)),
    ("3/4/25 9 PM", "America/Phoenix", "mdy", us(2025, 3, 5, 4)),
    ("12:00 AM", "UTC", "mdy", None),
    ("4.9.2025 12:15 a.m.", "Europe/London", "dmy", us(2025, 9, 3, 23, 15)),
    ("Tue, 08 Apr 2025 17:32:58 -0500", "UTC", "mdy", us(2025, 4, 8, 22, 32, 58)),
    ("Sunday, June 22, 2025 @ 3:30 PM", "America/New_York", "mdy", us(2025, 6, 22, 19, 30)),
    ("TZID=America/Chicago:20250901T203623", "UTC", "mdy", us(2025, 9, 2, 1, 36, 23)),
    ("2025-06-05T20:00-04:00[America/New_York]", "UTC", "mdy", us(2025, 6, 6)),
    ("2025-06-08T17:07:07.6785499-05:00", "UTC", "mdy", us(2025, 6, 8, 22, 7, 7) + 678_549),
    ("1748393100", "UTC", "mdy", 1_748_393_100_000_000),
    ("1755585868103", "UTC", "mdy", 1_755_585_868_103_000),
    ("1741633200000001", "UTC", "mdy", 1_741_633_200_000_001),
    ("2025-02-30T19:00:00Z", "UTC", "mdy", None),
    ("2025-06-01T25:00:00Z", "UTC", "mdy", None),
    ("13/13/2025", "UTC", "mdy", None),
    ("5/6/2025 7:00 PM XYZ", "America/New_York", "mdy", None),
    ("TBA", "UTC", "mdy", None),
    ("", "UTC", "mdy", None),
    (None, "UTC", "mdy", None),
    ("x" * 50_000, "UTC", "mdy", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, v string, z string, o string").withColumn("named", F.lit("clash"))
    got = {r.i: r.utc_us for r in to_instants(df, "v", "o", "z").collect()}
    assert {CASES[i][0][:60] if CASES[i][0] else None: got[i] for i in got if got[i] != CASES[i][3]} == {}


def test_fields_of_sources_with_and_without_a_declared_zone(spark):
    day = dt.datetime(2025, 6, 1, 18)
    rows = [("a", "known", "2025-06-01 10:00", "2025-06-01 10:00", day), ("b", "silent", "2025-06-01 12:59", "2025-06-01 12:59", day), ("c", None, "2025-06-01 12:00", None, day)]
    df = spark.createDataFrame(rows, "id string, source string, start_time string, raw_published_at string, discovered_at timestamp")
    zones = spark.createDataFrame([("known", "Europe/London", "dmy"), ("other", "America/Chicago", "mdy"), ("third", "America/New_York", None)], "source string, tz_name string, date_order string")
    got = {(r.id, r.field_name): r.utc_us for r in normalise_fields(df, "id", ["start_time"], zones).collect()}
    assert got == {("a", "start_time"): us(2025, 6, 1, 9), ("b", "start_time"): us(2025, 6, 1, 17, 59), ("c", "start_time"): us(2025, 6, 1, 12)}


def test_zone_estimate_takes_the_history_without_violations(spark):
    rows = [("s", dt.datetime(2025, m, 3, 12), us(2025, m, 3, 16 if 3 < m < 11 else 17, 5)) for m in (1, 2, 5, 7, 12)]
    df = spark.createDataFrame(rows, "source string, local timestamp, seen long")
    r = estimate_zones(df, "source", "local", "seen", ["America/Chicago", "America/New_York", "Europe/London", "America/Phoenix"]).collect()[0]
    assert (r.zone, r.violations, r.readings) == ("America/New_York", 0, 5)
    assert ("America/New_York", "EDT", -240) in abbreviation_offsets(["America/New_York", "No/Where"])


def test_references_against_brute_force(spark):
    random.seed(1)
    at = lambda: dt.datetime(2025, random.randrange(1, 13), random.randrange(1, 28))
    refs = [("t", random.choice("fg"), random.choice(["x", "y"]), random.choice([None, "", *(f"k{i}" for i in range(60))]), random.choice([None, at(), at()])) for _ in range(500)]
    refs += [("t", "f", "x", "hot", at()) for _ in range(300)] + [("t", "f", None, "k1", at())]
    parents = [(random.choice(["x", "y"]), f"k{i}", at()) for i in range(0, 60, 2) for _ in range(2)] + [("x", "always", None)]
    purged = [(random.choice(["x", "y"]), f"k{i}") for i in range(0, 60, 3)] + [(None, "k1"), ("x", None)]
    R = spark.createDataFrame(refs, "ref_table string, ref_field string, kind string, key string, at timestamp")
    P = spark.createDataFrame(parents, "kind string, key string, since timestamp")
    D = spark.createDataFrame(purged, "kind string, key string")
    since = {}
    for k, v, t in parents:
        t = t or dt.datetime.min
        since[k, v] = min(since.get((k, v), t), t)
    want = set()
    for t, f, k, v, when in refs:
        if k is None or v is None or when is None:
            continue
        if (k, v) in since:
            if since[k, v] > when:
                want.add((t, f, v, when.strftime("%Y-%m"), "late"))
        else:
            want.add((t, f, v, when.strftime("%Y-%m"), "deleted" if (k, v) in purged else "missing"))
    assert {tuple(r) for r in failed_references(R, P, D).collect()} == want
    assert failed_references(R.where("false"), P, D).count() == 0
    assert {r.reason for r in failed_references(R, P.where("false"), D.where("false")).collect()} == {"missing"}


def test_nights_and_windows(spark):
    df = spark.sql("SELECT timestamp'2025-06-16 03:59:59' a, timestamp'2025-06-16 04:00:00' b, timestamp'2025-06-15 23:00:00' s, CAST(NULL AS TIMESTAMP) e")
    night = F.lit("2025-06-15").cast("date")
    r = df.select(M.night_of(F.col("a")).alias("a"), M.night_of(F.col("b")).alias("b"), M.overlaps_night(F.col("s"), F.col("e"), night).alias("in"), M.overlaps_night(F.col("b"), F.col("e"), night).alias("out"), M.overlaps_night(F.lit("2025-06-01").cast("timestamp"), F.lit("2025-06-15 04:00:00").cast("timestamp"), night).alias("edge"), M.in_ingest_window(F.col("e"), F.col("e"), F.col("s"), F.col("b")).alias("none")).collect()[0]
    assert (str(r.a), str(r.b), r["in"], r.out, r.edge, r.none) == ("2025-06-15", "2025-06-16", True, False, True, True)
    assert M.clock_window("09:00-17:30") == (540, 1050)
    for bad in ("17:00-09:00", "9", "10:00-10:00"):
        with pytest.raises(ValueError):
            M.clock_window(bad)
    a, b = M.window_of("sunset_minus_30m to sunset_plus_2h", {"sunset": F.col("s")})
    assert [str(x) for x in df.select(a, b).collect()[0]] == ["2025-06-15 22:30:00", "2025-06-16 01:00:00"]
    with pytest.raises(ValueError):
        M.window_of("after sunset_plus_30min", {"sunset": F.col("s")})


def test_numbers(spark):
    df = spark.createDataFrame([(None,), (0.0,), (10.0,), (8.0,), (5.0,), (0.0,), (-9.0,), (60.0,), (100.0,), (500.0,)], "v double")
    got = [r[0] for r in df.select(N.Comfort((10, 40), (5, 60), (0, 100)).value(F.col("v"))).collect()]
    assert got == [None, -1.0, 1.0, pytest.approx(0.6), 0.0, -1.0, -1.0, 0.0, -1.0, -1.0]
    one = spark.range(1).select(N.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), N.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("z"), N.toward(F.lit(-0.5), F.lit(1.5)).alias("t"), N.gate(F.lit(0.5), 0.5, 0.0).alias("g"), N.expected_tags(F.lit(10), F.lit(4.0), F.lit(0.0)).alias("e"), N.confidence(F.lit(9), F.lit(3.0)).alias("s")).collect()[0]
    assert one.c == pytest.approx(0.5**0.5) and (one.z, one.g, one.e, one.s) == (0.0, 1.0, 4.0, 1.0) and one.t == pytest.approx(-1 / 3)


def test_texts(spark):
    df = spark.createDataFrame([("a <a href='http://x'>b</a><br>c &amp; d", "w/o Foo & w/Bar", "The  Old Mill", "*** CANCELED *** x"), (None, None, None, None)], "h string, t string, v string, c string")
    r = df.select(T.html_to_text(F.col("h")), T.canonical_title(F.col("t")), T.canonical_venue(F.col("v")), T.looks_cancelled(F.col("c")), T.swap_article(F.lit("Mill, The")), T.title_case(F.lit("o'brien's 3rd")), T.derived_id(F.lit("k"), F.lit(None), F.lit(" "))).collect()
    assert tuple(r[0]) == ("a b (http://x)\nc & d", "without foo and with bar", "old mill", True, "The Mill", "O'Brien'S 3Rd", None)
    assert tuple(r[1])[:4] == (None, None, None, None)


def test_ranks_equal_the_sorted_order(spark):
    random.seed(2)
    rows = [(random.choice("ab"), f"i{k:03d}", random.choice([None, float("nan"), -0.5, 0.25, random.random()])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, i string, s double")
    got = {(r.g, r.i): r["rank"] for r in ranking.rank_all(df, "g", "s", "i").collect()}
    for g in "ab":
        order = sorted((i for h, i, s in rows if h == g and s is not None and s == s), key=lambda i: (-next(s for h, j, s in rows if j == i), i))
        assert [got[g, i] for i in order] == list(range(1, len(order) + 1))


def test_writes(spark):
    old = spark.createDataFrame([("a", 1, 1, "x"), ("b", 5, 5, None)], "id string, first int, last int, v string")
    new = spark.createDataFrame([("a", 3, 9, "y"), ("c", 7, 7, "z"), ("b", 2, 4, "late")], "id string, first int, last int, v string")
    assert sorted(tuple(r) for r in writes.upsert(old, new, "id", "last", ["first"]).select("id", "first", "last", "v").collect()) == [("a", 1, 9, "y"), ("b", 2, 5, None), ("c", 7, 7, "z")]
    assert sorted(r.id for r in writes.append_new(old, new, ["id"], F.col("first")).collect()) == ["a", "b", "c"]
    assert writes.replace_partitions(old, new.where("false"), "id").count() == 2
    assert writes.schema_difference(old, new.drop("v").withColumn("w", F.lit(1))) == [("v", "missing"), ("w", "extra")]
    pairs = spark.createDataFrame([("b", "a", "hb", "ha")], "a string, b string, x string, y string")
    assert tuple(writes.canonical_pairs(pairs, "a", "b", [("x", "y")]).collect()[0]) == ("a", "b", "ha", "hb")


def lcs_ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return 1.0 if not a and not b else 2 * row[-1] / (len(a) + len(b))


def test_indel_ratio_against_dynamic_programming():
    random.seed(3)
    for _ in range(300):
        a, b = ("".join(random.choice("abc ") for _ in range(random.randrange(0, 90))) for _ in range(2))
        assert matching.indel_ratio(a, b) == pytest.approx(lcs_ratio(a, b))


def test_guarded_pairs_clusters_and_merges(spark):
    t = dt.datetime(2025, 6, 1, 20)
    rows = [("a", "Jazz Night", "The Hall", t, None, t), ("b", "jazz night", "Hall", t, "s", t), ("c", "Jazz Nights", "hall", t + dt.timedelta(hours=2), "long", t - dt.timedelta(days=1)), ("d", "Jazz Night", "Barn", t, None, t), ("e", "Jazz Night", "Hall", t + dt.timedelta(hours=5), None, t), ("f", None, None, None, None, t), ("g", None, None, None, None, t), ("h", "Jazz Night", None, t, None, t)]
    df = spark.createDataFrame(rows, "id string, title string, venue string, start timestamp, summary string, created timestamp")
    scored = matching.fuzzy_pairs(matching.guarded_pairs(df, "id", "title", "venue", "start"))
    assert {(r.a, r.b) for r in scored.where("verdict = 'merged'").collect()} == {("a", "b"), ("a", "c"), ("f", "g")}
    members = matching.clusters(scored.where("verdict = 'merged'"), "a", "b")
    assert {(r.cluster, r.id) for r in members.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("f", "f"), ("f", "g")}
    merged = {r.cluster: r for r in matching.merge_clusters(df, members, "id", ["title", "venue", "summary"], "created").collect()}
    assert (merged["a"].winner, merged["a"].summary, merged["a"].members) == ("c", "long", 3)
    assert {(r.id, r.superseded_by) for r in matching.cluster_supersession(members, spark.createDataFrame([("a", "c"), ("f", "f")], "cluster string, winner string"), scored).collect()} == {("a", "c"), ("b", "c"), ("g", "f")}


def test_cusum_equals_the_recursion(spark):
    random.seed(4)
    rows = [(p, i, random.gauss(0, 1) + (2.0 if p == "step" and i > 60 else 0)) for p in ("step", "flat") for i in range(1, 121)] + [("same", i, 1.0) for i in range(1, 60)]
    got = {r.p: (r.alarm_at, r.direction) for r in statistics.cusum(spark.createDataFrame(rows, "p string, i int, v double"), "p", ["i"], "v").collect()}
    for p in ("step", "flat"):
        v = [x for q, _, x in rows if q == p]
        m = sum(v[:30]) / 30
        sd = (sum((x - m) ** 2 for x in v[:30]) / 30) ** 0.5
        hi = lo = 0.0
        want = None
        for i, x in enumerate(v[30:], 31):
            hi, lo = max(0, hi + (x - m) / sd - 0.5), min(0, lo + (x - m) / sd + 0.5)
            if hi > 5 or lo < -5:
                want = (i, "up" if hi > 5 else "down")
                break
        assert got.get(p) == want
    assert "same" not in got


def test_nothing_outside_names_the_llm_subpackage_but_the_entry():
    root = Path(__file__).resolve().parent.parent
    for path in (root / "marquetry").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"marquetry\.llm|from marquetry import llm", path.read_text()), path


def test_best_preference_meets_every_preference(spark):
    rng = np.random.default_rng(5)
    v = [[float(x) for x in r] for r in rng.normal(size=(400, 6))]
    v[3] = [0.0] * 6
    v[100] = [2 * x for x in v[50]]
    rows = [(i, x, i // 50 + i % 7) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    want = {}
    for i in range(400):
        for j in range(0, 400, 50):
            key, new = (i, rows[j][2] % 2), (round(float(x[i] @ x[j]), 9), -j)
            want[key] = max(want.get(key, (-2, 0)), new)
    prefs = df.where("vec_id % 50 = 0").selectExpr("vec_id AS pid", "embedding AS p", "label AS l")
    for block in (3, 100):
        got = {(r.vec_id, r.side): (r.c, r.pid) for r in catalogue.best_of_all(df, prefs, block).collect()}
        assert {k: p for k, (_, p) in got.items()} == {k: -n for k, (_, n) in want.items()}
        assert all(abs(got[k][0] - c) < 1e-8 for k, (c, _) in want.items())


def test_zones_withheld(spark):
    """Zones are found from spans and from what other feeds state; where the readings do not tell there is none."""
    from zoneinfo import ZoneInfo

    rng = random.Random(7)
    feeds = {"n": "America/New_York", "l": "Europe/London", "k": "Asia/Kolkata", "p": "America/Phoenix"}
    rows = []
    for f, zone in feeds.items():
        for i in range(60):
            at = dt.datetime(2025, 1 + i % 12, 1 + rng.randrange(27), 12 + rng.randrange(8), rng.choice([0, 30]), tzinfo=ZoneInfo(zone))
            end = at + dt.timedelta(minutes=rng.choice([60, 90, 120, 120, 180]))
            wall = lambda t: t.strftime("%Y-%m-%d %H:%M")
            sure = lambda t: t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            rows += [(f, wall(at), [wall, sure][i % 2](end), f"Show {f}{i}", "Mill"), ("other", sure(at), sure(end), f"show {f}{i} ", "MILL")]
    rows += [("thin", "2025-05-01 20:00", "2025-05-01T23:00:00Z", None, None), ("none", None, None, "x", "y")]
    df = spark.createDataFrame(rows, "source string, start_time string, end_time string, title string, venue string")
    zones = spark.createDataFrame([(f, None, "mdy") for f in (*feeds, "other", "thin", "none")], "source string, tz_name string, date_order string")
    histories = zone_histories(2025, 2025)
    usual = usual_spans(sequences(df, zones, ["UTC"], alike=True))
    assert set(usual) == {60, 90, 120, 180} and abs(sum(usual.values()) - 1) < 1e-9
    readings = sequences(df, zones, ["UTC"]).withColumn("same", F.lit(False)).unionByName(shared_starts(df, zones, "title", "venue"))
    got = {r.source: (r.zone, r.alike) for r in estimate_zones(readings, "source", "local", "other_us", list(histories), "after", usual, None, "same").collect()}
    for f, zone in feeds.items():
        assert next(first for first, names in histories.items() if zone in names) in got[f][1]
    assert got["thin"][0] is None and "none" not in got


def test_crowded_guards(spark):
    """Rows without venue or start, and those of one busy venue, meet in blocks; the pairs are those of brute force."""
    rng = random.Random(3)
    t0 = dt.datetime(2025, 6, 1)
    rows = [(f"i{k:03}", f"t{k % 17}", None, None) for k in range(40)] + [(f"j{k:03}", f"t{k % 11}", "Mill", t0 + dt.timedelta(minutes=30 * rng.randrange(40))) for k in range(60)] + [(f"k{k}", "t", "Mill", None) for k in range(3)]
    df = spark.createDataFrame(rows, "id string, title string, venue string, start timestamp")
    first: dict = {}
    for i, t, v, s in sorted(rows):
        first.setdefault((t, v, s), i)
    reps = [r for r in rows if first[r[1:]] == r[0]]
    near = lambda a, b: a[2] == b[2] and ((a[3] is None and b[3] is None) or (a[3] is not None and b[3] is not None and abs((a[3] - b[3]).total_seconds()) <= 7200))
    want = {(a[0], b[0]) for a in reps for b in reps if a[0] < b[0] and near(a, b)} | {(first[r[1:]], r[0]) for r in rows if first[r[1:]] != r[0]}
    for meeting in (5, 2_000):
        got = [(r.a, r.b) for r in matching.guarded_pairs(df, "id", "title", "venue", "start", meeting=meeting).collect()]
        assert len(got) == len(set(got)) and set(got) == want
