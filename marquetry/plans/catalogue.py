"""Queries of the reference's operators over whole test tables, each with its SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.functions import numeric as N
from marquetry.functions import text as T
from marquetry.functions import timing as M
from marquetry.operators import matching, ranking, scoring, statistics, writes
from marquetry.operators.lineage import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r6(c):
    """Six digits as most engines round a double: scaled, then to the nearest whole number, halves away from zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * 1e6) / 1e6


# ranking and scoring

_FINAL = """SELECT run_date, event_id, max(CASE WHEN s >= 0 THEN s * m ELSE s / m END) AS final_score FROM (
    SELECT run_date, event_id, base_score * coalesce(CASE WHEN isnan(tag_confidence) THEN NULL ELSE tag_confidence END, 1.0) AS s,
        CASE match_kind WHEN 'like' THEN 1.5 WHEN 'dislike' THEN 0.5 ELSE 1.0 END AS m
    FROM event_scores WHERE base_score IS NOT NULL AND NOT isnan(base_score)) GROUP BY 1, 2"""


def final_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "event_scores").where(F.col("base_score").isNotNull() & ~F.isnan("base_score"))
    sure = F.coalesce(F.when(~F.isnan("tag_confidence"), F.col("tag_confidence")), F.lit(1.0))
    times = F.when(F.col("match_kind") == "like", 1.5).when(F.col("match_kind") == "dislike", 0.5).otherwise(1.0)
    return rows.groupBy("run_date", "event_id").agg(F.max(N.toward(F.col("base_score") * sure, times)).alias("final_score"))


@query(f"SELECT run_date, event_id, round(final_score, 6) AS final_score, CAST(row_number() OVER (PARTITION BY run_date ORDER BY final_score DESC, event_id) AS INTEGER) AS rank FROM ({_FINAL})")
def rank_final_score(spark, folder):
    """Final score by confidence and match, ranked 1..n within each run."""
    ranked = ranking.rank_all(final_scores(spark, folder), "run_date", "final_score", "event_id")
    return ranked.select("run_date", "event_id", r6("final_score").alias("final_score"), "rank")


@query("""WITH p AS (SELECT c_mktsegment, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS c
    FROM orders JOIN customer ON o_custkey = c_custkey) SELECT c_mktsegment, o_orderkey, o_totalprice, CAST(n AS INTEGER) AS position, greatest(c - 10, 0) AS hidden FROM p WHERE n <= 10""")
def topk_with_hidden_count(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderkey", "o_totalprice")
    return ranking.top_with_hidden(rows, ["c_mktsegment"], 10, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("""SELECT l_orderkey, l_linenumber, round(c, 6) AS contribution, CAST(n AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(c) DESC, l_linenumber, l_partkey, l_suppkey) AS n
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (l_discount - 0.05) AS c FROM lineitem)) WHERE n <= 2""")
def top_reasons(spark, folder):
    """The two contributions of each order that weigh most, either way."""
    rows = table(spark, folder, "lineitem").withColumn("c", F.col("l_extendedprice") * (F.col("l_discount") - 0.05))
    top = ranking.top_per(rows, ["l_orderkey"], 2, F.desc(F.abs("c")), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"))
    return top.select("l_orderkey", "l_linenumber", r6("c").alias("contribution"), "position")


@query(f"""WITH s AS ({_FINAL}), last AS (SELECT max(run_date) AS d FROM event_scores), e AS (SELECT DISTINCT event_id, title FROM stored_events WHERE superseded_by IS NULL)
    SELECT CAST(row_number() OVER (ORDER BY final_score DESC, s.event_id) AS INTEGER) AS rank, s.event_id, title, round(final_score, 6) AS final_score FROM s JOIN last ON run_date = d JOIN e ON s.event_id = e.event_id""")
def ranked_view_join(spark, folder):
    """Live events of the latest run with their scores, ranked."""
    live = table(spark, folder, "stored_events").where("superseded_by IS NULL").select("event_id", "title").distinct()
    scores = ranking.latest(final_scores(spark, folder), "run_date").join(live, "event_id")
    return ranking.rank_all(scores, "run_date", "final_score", "event_id").select("rank", "event_id", "title", r6("final_score").alias("final_score"))


# nights and windows

@query("SELECT CAST(ts - INTERVAL 4 HOUR AS DATE) AS night, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def night_of_bucket(spark, folder):
    return table(spark, folder, "events").groupBy(M.night_of(F.col("ts").cast("timestamp")).alias("night"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


NIGHT = "2025-06-15"


@query(f"""SELECT DISTINCT event_id, title, start_time, end_time FROM stored_events WHERE start_time < TIMESTAMP '{NIGHT} 04:00:00' + INTERVAL 1 DAY AND coalesce(end_time, start_time) >= TIMESTAMP '{NIGHT} 04:00:00'""")
def night_overlap(spark, folder):
    rows = table(spark, folder, "stored_events").select("event_id", "title", "start_time", "end_time")
    return rows.where(M.overlaps_night(F.col("start_time").cast("timestamp"), F.col("end_time").cast("timestamp"), F.lit(NIGHT).cast("date"))).distinct()


@query(f"""WITH n AS (SELECT CAST(d AS DATE) AS night FROM generate_series(TIMESTAMP '{NIGHT}', TIMESTAMP '{NIGHT}' + INTERVAL 6 DAY, INTERVAL 1 DAY) t(d)), e AS (SELECT DISTINCT event_id, start_time, end_time FROM stored_events)
    SELECT night, event_id FROM n JOIN e ON start_time < night + INTERVAL 28 HOUR AND coalesce(end_time, start_time) >= night + INTERVAL 4 HOUR""")
def multi_night_expand(spark, folder):
    """Each event with every one of seven nights it overlaps: its nights are generated, so no range join is needed."""
    first = F.lit(NIGHT).cast("date")
    e = table(spark, folder, "stored_events").select("event_id", F.col("start_time").cast("timestamp").alias("s"), F.coalesce("end_time", "start_time").cast("timestamp").alias("e")).where("s IS NOT NULL").distinct()
    low, high = F.greatest(M.night_of(F.col("s")), first), F.least(F.greatest(M.night_of(F.col("e")), M.night_of(F.col("s"))), F.date_add(first, 6))
    out = e.withColumn("lo", low).withColumn("hi", high).where("lo <= hi").select("event_id", "s", "e", F.explode(F.sequence("lo", "hi")).alias("night"))
    return out.where(M.overlaps_night(F.col("s"), F.col("e"), F.col("night"))).select("night", "event_id").distinct()


@query(f"""WITH e AS (SELECT DISTINCT event_id, start_time AS s, end_time AS e, TIMESTAMP '{NIGHT} 19:00:00' AS a, TIMESTAMP '{NIGHT} 22:00:00' AS b FROM stored_events WHERE start_time IS NOT NULL)
    SELECT event_id FROM e WHERE CASE WHEN e IS NULL THEN s BETWEEN a AND b
    WHEN epoch(e) - epoch(s) > 86400 THEN (s - date_trunc('day', s)) = (e - date_trunc('day', e)) OR (date_trunc('day', a) + (s - date_trunc('day', s)) <= b AND date_trunc('day', a) + (e - date_trunc('day', e)) > a)
    ELSE s <= b AND e > a END""")
def time_of_day_overlap(spark, folder):
    e = table(spark, folder, "stored_events").select("event_id", F.col("start_time").cast("timestamp").alias("s"), F.col("end_time").cast("timestamp").alias("e")).where("s IS NOT NULL").distinct()
    return e.where(M.overlaps_clock(F.col("s"), F.col("e"), F.lit(f"{NIGHT} 19:00:00").cast("timestamp"), F.lit(f"{NIGHT} 22:00:00").cast("timestamp"))).select("event_id")


@query(f"""SELECT CAST(start_time - INTERVAL 4 HOUR AS DATE) AS night, count(DISTINCT event_id) AS events FROM stored_events WHERE superseded_by IS NULL AND CAST(start_time AS DATE) BETWEEN DATE '{NIGHT}' + 1 AND DATE '{NIGHT}' + 14 GROUP BY 1""")
def upcoming_nights(spark, folder):
    e = table(spark, folder, "stored_events").where("superseded_by IS NULL")
    day = F.to_date("start_time")
    first = F.lit(NIGHT).cast("date")
    return e.where(day.between(F.date_add(first, 1), F.date_add(first, 14))).groupBy(M.night_of(F.col("start_time").cast("timestamp")).alias("night")).agg(F.count_distinct("event_id").alias("events"))


@query(f"""SELECT event_id, CASE WHEN NOT (start_time IS NULL OR (coalesce(end_time, start_time) >= TIMESTAMP '{NIGHT}' AND start_time < TIMESTAMP '{NIGHT}' + INTERVAL 45 DAY)) THEN 'window'
    WHEN NOT (coalesce(start_time > TIMESTAMP '{NIGHT}', false) OR updated_at IS NULL OR updated_at >= TIMESTAMP '{NIGHT}' - INTERVAL 30 DAY) THEN 'lookback' WHEN title IS NULL AND summary IS NULL AND start_time IS NULL THEN 'malformed' ELSE 'accepted' END AS verdict
    FROM (SELECT DISTINCT event_id, title, summary, start_time, end_time, updated_at FROM stored_events)""")
def filter_with_verdict(spark, folder):
    """Every event with the first rule that rejects it."""
    e = table(spark, folder, "stored_events").select("event_id", "title", "summary", *[F.col(c).cast("timestamp").alias(c) for c in ("start_time", "end_time", "updated_at")]).distinct()
    now = F.lit(NIGHT).cast("timestamp")
    days = lambda n: F.make_dt_interval(days=F.lit(n))
    verdict = F.when(~M.in_ingest_window(F.col("start_time"), F.col("end_time"), now, now + days(45)), "window").when(~M.passes_lookback(F.col("start_time"), F.col("updated_at"), now, now - days(30)), "lookback").when(F.coalesce("title", "summary", F.col("start_time").cast("string")).isNull(), "malformed").otherwise("accepted")
    return e.select("event_id", verdict.alias("verdict"))


@query(f"""SELECT DISTINCT event_id, start_time FROM stored_events WHERE superseded_by IS NULL AND CASE WHEN start_time IS NULL THEN created_at >= TIMESTAMP '{NIGHT}' - INTERVAL 14 DAY ELSE start_time >= TIMESTAMP '{NIGHT}' AND CAST(start_time AS DATE) <= DATE '{NIGHT}' + 10 END""")
def scope_filter(spark, folder):
    e = table(spark, folder, "stored_events").where("superseded_by IS NULL")
    return e.where(F.expr(f"CASE WHEN start_time IS NULL THEN created_at >= TIMESTAMP_NTZ '{NIGHT}' - INTERVAL 14 DAY ELSE start_time >= TIMESTAMP_NTZ '{NIGHT}' AND to_date(start_time) <= date_add(DATE '{NIGHT}', 10) END")).select("event_id", "start_time").distinct()


@query(f"""SELECT DISTINCT event_id, start_time, created_at FROM stored_events WHERE start_time >= TIMESTAMP '{NIGHT}' OR (start_time IS NULL AND updated_at >= TIMESTAMP '{NIGHT}' - INTERVAL 60 DAY)""")
def candidate_window(spark, folder):
    """Records that start from a time on, and those without a start that were seen lately."""
    e = table(spark, folder, "stored_events").select("event_id", "start_time", "created_at", "updated_at")
    return e.where(f"start_time >= TIMESTAMP_NTZ '{NIGHT}' OR (start_time IS NULL AND updated_at >= TIMESTAMP_NTZ '{NIGHT}' - INTERVAL 60 DAY)").select("event_id", "start_time", "created_at").distinct()


_COS = "(sin(radians(-0.833)) - sin(radians(latitude)) * sin(radians(-23.44 * cos(radians(360.0 / 365.0 * (dayofyear(CAST(discovered_at AS DATE)) + 10)))))) / (cos(radians(latitude)) * cos(radians(-23.44 * cos(radians(360.0 / 365.0 * (dayofyear(CAST(discovered_at AS DATE)) + 10))))))"


@query(f"SELECT DISTINCT id, round(degrees(acos({_COS})) * 4, 4) AS sunset_minutes FROM venues WHERE latitude IS NOT NULL AND abs({_COS}) <= 1 AND extract(hour FROM discovered_at) * 60 + extract(minute FROM discovered_at) > 720 + degrees(acos({_COS})) * 4")
def after_sunset(spark, folder):
    """Venues discovered after sunset at their latitude, by the sun's time."""
    v = table(spark, folder, "venues").where("latitude IS NOT NULL").withColumn("m", M.sunset_minutes(F.to_date("discovered_at"), F.col("latitude")))
    return v.where(F.col("m").isNotNull() & (F.hour("discovered_at") * 60 + F.minute("discovered_at") > 720 + F.col("m"))).select("id", F.round("m", 4).alias("sunset_minutes")).distinct()


# text

_SQUEEZE = "trim(regexp_replace({}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


@query("SELECT DISTINCT title, " + _SQUEEZE.format("regexp_replace(regexp_replace(regexp_replace(lower(title), '\\bw/o\\b', 'without', 'g'), '\\bw/', 'with ', 'g'), '&', ' and ', 'g')") + " AS title_key FROM event_candidates WHERE title IS NOT NULL")
def canonical_title(spark, folder):
    c = table(spark, folder, "event_candidates").where("title IS NOT NULL").select("title").distinct()
    return c.select("title", T.canonical_title(F.col("title")).alias("title_key"))


@query("SELECT DISTINCT venue, regexp_replace(lower(" + _SQUEEZE.format("venue") + "), '^(the|a|an) ', '') AS venue_key FROM event_candidates WHERE venue IS NOT NULL")
def canonical_venue(spark, folder):
    c = table(spark, folder, "event_candidates").where("venue IS NOT NULL").select("venue").distinct()
    return c.select("venue", T.canonical_venue(F.col("venue")).alias("venue_key"))


@query("SELECT doc_id, " + _SQUEEZE.format("nfc_normalize(text)") + " AS clean FROM documents WHERE text IS NOT NULL")
def normalize_text(spark, folder):
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.normalize_text(F.col("text")).alias("clean"))


@query("SELECT doc_id, sha256(text) AS fingerprint, CASE WHEN trim(coalesce(source, '')) <> '' OR trim(coalesce(venue, '')) <> '' THEN coalesce(doc_kind, '') || ':' || substr(sha256(coalesce(source, '') || '|' || coalesce(venue, '')), 1, 16) END AS content_id FROM documents")
def content_fingerprint(spark, folder):
    return table(spark, folder, "documents").select("doc_id", T.fingerprint(F.col("text")).alias("fingerprint"), T.derived_id(F.coalesce("doc_kind", F.lit("")), F.col("source"), F.col("venue")).alias("content_id"))


@query("SELECT DISTINCT event_id, substr(sha1(event_id), 1, 7) AS handle FROM stored_events")
def short_handle(spark, folder):
    return table(spark, folder, "stored_events").select("event_id").distinct().select("event_id", T.short_handle(F.col("event_id")).alias("handle"))


@query("SELECT handle, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources FROM (SELECT doc_id, source, lower(unnest(regexp_extract_all(text, '@[A-Za-z0-9_.]+'))) AS handle FROM documents) GROUP BY 1")
def handle_mentions(spark, folder):
    d = table(spark, folder, "documents").where(F.col("text").contains("@")).select("doc_id", "source", F.explode(T.handles_in(F.col("text"))).alias("handle"))
    return d.groupBy("handle").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))


@query("SELECT mention, count(DISTINCT id) AS entities, min(depth) AS depth FROM (SELECT id, depth, unnest(string_split(mention_sources, ',')) AS mention FROM candidate_entities WHERE mention_sources IS NOT NULL) GROUP BY 1")
def entity_mentions(spark, folder):
    e = table(spark, folder, "candidate_entities").where("mention_sources IS NOT NULL").select("id", "depth", F.explode(F.split("mention_sources", ",")).alias("mention"))
    return e.groupBy("mention").agg(F.count_distinct("id").alias("entities"), F.min("depth").alias("depth"))


@query("SELECT id, text AS tag, least(greatest(coalesce(weight, 1.0), 0.0), 1.0) AS weight, CAST(pos AS INTEGER) AS position FROM (SELECT id, unnest(tags).text AS text, unnest(tags).weight AS weight, generate_subscripts(tags, 1) - 1 AS pos FROM (SELECT DISTINCT id, tags FROM event_candidates)) WHERE trim(coalesce(text, '')) <> ''")
def tag_rows(spark, folder):
    """The tags of each listing in order, weights clamped, blank ones dropped."""
    c = table(spark, folder, "event_candidates").select("id", "tags").distinct()
    t = c.select("id", F.posexplode("tags").alias("position", "t"))
    return t.where(F.trim(F.coalesce("t.text", F.lit(""))) != "").select("id", F.col("t.text").alias("tag"), T.clamp_weight(F.col("t.weight")).alias("weight"), "position")


# writes

@query("""SELECT id, max_by(source, last_seen_at) AS source, min(discovered_at) AS discovered_at, max(last_seen_at) AS last_seen_at FROM event_candidates GROUP BY 1""")
def candidate_upsert(spark, folder):
    """Two fetches merged by id: the latest row stands, first seen is kept."""
    c = table(spark, folder, "event_candidates").select("id", "source", "discovered_at", "last_seen_at")
    cut = F.lit(NIGHT).cast("timestamp_ntz")
    return writes.upsert(c.where(F.col("last_seen_at") < cut), c.where(F.col("last_seen_at") >= cut), "id", "last_seen_at", ["discovered_at"])


_VERSION = "SELECT id, sha256(concat_ws('|', coalesce(title, ''), coalesce(venue, ''), coalesce(start_time, ''))) AS content_hash, last_seen_at FROM event_candidates"


@query(f"SELECT id, content_hash, min(last_seen_at) AS observed_at FROM ({_VERSION}) GROUP BY 1, 2")
def version_append(spark, folder):
    """Versions by id and content; the first observation of each stays."""
    content = T.fingerprint(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("title", "venue", "start_time")]))
    c = table(spark, folder, "event_candidates").select("id", content.alias("content_hash"), F.col("last_seen_at").alias("observed_at"))
    cut = F.lit(NIGHT).cast("timestamp_ntz")
    keys = ["id", "content_hash"]
    old = ranking.first_per(c.where(F.col("observed_at") < cut), keys, F.col("observed_at"))
    return writes.append_new(old, c.where(F.col("observed_at") >= cut), keys, F.col("observed_at"))


@query("""WITH e AS (SELECT event_id, CAST(ts AS DATE) AS run_date, value FROM events), m AS (SELECT max(run_date) AS d FROM e)
    SELECT event_id, run_date, value FROM e, m WHERE run_date < d - 4 UNION ALL SELECT event_id, run_date, value * 2 FROM e, m WHERE run_date >= d - 4""")
def partition_replace(spark, folder):
    """The last five days are recomputed and replace their partitions."""
    e = table(spark, folder, "events").select("event_id", F.to_date("ts").alias("run_date"), "value")
    last = e.agg(F.max("run_date").alias("d"))
    new = e.join(F.broadcast(last), F.col("run_date") >= F.date_sub("d", 4)).select("event_id", "run_date", (F.col("value") * 2).alias("value"))
    return writes.replace_partitions(e, new, "run_date")


@query("""SELECT pass_name, record_a, record_b, max(updated_at) AS updated_at, max(struct_pack(u := updated_at, v := verdict, s := score)).v AS verdict FROM (SELECT pass_name, least(record_a, record_b) AS record_a, greatest(record_a, record_b) AS record_b, verdict, score, updated_at FROM dedup_decisions) GROUP BY 1, 2, 3""")
def decision_upsert(spark, folder):
    """Decisions by pass and unordered pair; the latest stands."""
    d = writes.canonical_pairs(table(spark, folder, "dedup_decisions"), "record_a", "record_b", [("content_hash_a", "content_hash_b")])
    return d.groupBy("pass_name", "record_a", "record_b").agg(F.max("updated_at").alias("updated_at"), F.max(F.struct("updated_at", "verdict", "score"))["verdict"].alias("verdict"))


_IDENTITY = "sha256(concat_ws('|', coalesce(source, ''), coalesce(lower(title), ''), coalesce(lower(venue), ''), coalesce(start_time, '')))"


@query(f"SELECT substr({_IDENTITY}, 1, 16) AS new_id, max(struct_pack(l := last_seen_at, i := id)).i AS keeper, min(discovered_at) AS discovered_at, max(last_seen_at) AS last_seen_at, count(DISTINCT id) AS collapsed FROM event_candidates WHERE title IS NOT NULL OR start_time IS NOT NULL GROUP BY 1")
def rekey_collapse(spark, folder):
    """Listings re-keyed by content: who is kept, and what it inherits."""
    new = F.substring(T.fingerprint(F.concat_ws("|", F.coalesce("source", F.lit("")), *[F.coalesce(F.lower(c), F.lit("")) for c in ("title", "venue")], F.coalesce("start_time", F.lit("")))), 1, 16)
    c = table(spark, folder, "event_candidates").where("title IS NOT NULL OR start_time IS NOT NULL")
    return writes.collapse_keys(c, "id", new, "discovered_at", "last_seen_at")


# references, sets and tallies

@query("SELECT DISTINCT o.event_id, o.source FROM extraction_observations o WHERE o.event_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM stored_events e WHERE e.event_id = o.event_id)")
def orphan_check(spark, folder):
    """Observations of events that are not there."""
    o = table(spark, folder, "extraction_observations").select("event_id", "source").where("event_id IS NOT NULL").distinct()
    return o.join(table(spark, folder, "stored_events").select("event_id").distinct(), "event_id", "left_anti").select("event_id", "source")


@query("SELECT s.source, count(DISTINCT c.id) AS fetched, count(DISTINCT CASE WHEN c.title IS NOT NULL AND c.start_time IS NOT NULL THEN c.id END) AS accepted FROM source_zones s LEFT JOIN event_candidates c ON s.source = c.source GROUP BY 1")
def source_tallies(spark, folder):
    """Fetched and accepted listings of every source, those without any included."""
    c = table(spark, folder, "event_candidates").groupBy("source", "id").agg(F.max((F.col("title").isNotNull() & F.col("start_time").isNotNull()).cast("int")).alias("ok"))
    g = c.groupBy("source").agg(F.count(F.lit(1)).alias("fetched"), F.sum("ok").alias("accepted"))
    return table(spark, folder, "source_zones").select("source").join(g, "source", "left").na.fill(0)


@query("SELECT c AS candidate_id, count(DISTINCT event_id) AS events FROM (SELECT event_id, unnest(source_event_candidates) AS c FROM stored_events) GROUP BY 1 HAVING count(DISTINCT event_id) > 1")
def shared_candidates(spark, folder):
    e = table(spark, folder, "stored_events").select("event_id", F.explode("source_event_candidates").alias("candidate_id")).distinct()
    return e.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("events")).where("events > 1")


@query("SELECT source, count(*) AS seen, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS churned, round(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM (SELECT source, lower(title) AS t, venue, start_time, count(DISTINCT id) AS n FROM event_candidates WHERE title IS NOT NULL OR start_time IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1")
def churn_by_source(spark, folder):
    """Per source, contents seen and contents that came under more than one id."""
    c = table(spark, folder, "event_candidates").where("title IS NOT NULL OR start_time IS NOT NULL").groupBy("source", F.lower("title").alias("t"), "venue", "start_time").agg(F.count_distinct("id").alias("n"))
    g = c.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.sum((F.col("n") > 1).cast("bigint")).alias("churned"))
    return g.select("source", "seen", "churned", r6(F.col("churned") / F.col("seen")).alias("rate"))


@query("""WITH r AS (SELECT source, date_trunc('month', observed_at) AS run, count(*) AS seen, sum(CASE WHEN degradation IS NOT NULL OR backfilled THEN 1 ELSE 0 END) AS churned FROM extraction_observations WHERE source IS NOT NULL GROUP BY 1, 2)
    SELECT source, sum(churned) AS evidence, count(*) AS runs, sum(churned) >= 8 AND count(*) >= 2 AS armed FROM r WHERE churned / seen >= 0.05 GROUP BY 1""")
def latch(spark, folder):
    o = table(spark, folder, "extraction_observations").where("source IS NOT NULL").groupBy("source", F.date_trunc("month", "observed_at").alias("run"))
    runs = o.agg(F.count(F.lit(1)).alias("seen"), F.sum((F.col("degradation").isNotNull() | F.coalesce("backfilled", F.lit(False))).cast("bigint")).alias("churned"))
    return statistics.latch(runs, "source", least_rate=0.05, least_evidence=8)


_FRESH = f"created_at >= TIMESTAMP '{NIGHT}'"


@query("""WITH e AS (SELECT event_id, summary, created_at, superseded_by, unnest(source_event_candidates) AS c FROM stored_events), m AS (SELECT f.event_id AS fresh_key, s.event_id AS stored_key, max(CAST(s.summary IS NOT NULL AS INTEGER)) AS d, min(s.created_at) AS t
    FROM e f JOIN e s ON f.c = s.c AND f.event_id <> s.event_id AND s.superseded_by IS NULL GROUP BY 1, 2)
    SELECT fresh_key, stored_key, CAST(row_number() OVER (PARTITION BY fresh_key ORDER BY d DESC, t, stored_key) AS INTEGER) AS place FROM m""")
def reconcile(spark, folder):
    """Every event with the other live ones that share a candidate: the winner, and those it replaces."""
    e = table(spark, folder, "stored_events")
    return matching.reconcile(e, e.where("superseded_by IS NULL"), "event_id", "source_event_candidates", F.col("summary").isNotNull().cast("int"), "created_at")


@query(f"""WITH e AS (SELECT DISTINCT event_id, created_at, superseded_by, unnest(source_event_candidates) AS c FROM stored_events), f AS (SELECT c FROM e WHERE {_FRESH})
    SELECT DISTINCT event_id FROM stored_events WHERE NOT ({_FRESH}) AND superseded_by IS NULL AND start_time >= TIMESTAMP '{NIGHT}' AND event_id NOT IN (SELECT event_id FROM e WHERE c IN (SELECT c FROM f))""")
def carry_forward(spark, folder):
    """Stored events in scope that no fresh event claims."""
    e = table(spark, folder, "stored_events")
    cut = F.lit(NIGHT).cast("timestamp_ntz")
    fresh = e.where(F.col("created_at") >= cut).select(F.explode("source_event_candidates").alias("c")).distinct()
    links = e.select("event_id", F.explode("source_event_candidates").alias("c"))
    claimed = links.join(fresh, "c", "left_semi").select("event_id").distinct()
    old = e.where((F.col("created_at") < cut) & F.col("superseded_by").isNull() & (F.col("start_time") >= cut)).select("event_id").distinct()
    return old.join(claimed, "event_id", "left_anti")


@query(f"SELECT id, min(source) AS source FROM event_candidates WHERE discovered_at < TIMESTAMP '{NIGHT}' GROUP BY 1 UNION ALL SELECT id, min(source) FROM event_candidates WHERE NOT discovered_at < TIMESTAMP '{NIGHT}' GROUP BY 1")
def candidate_merge(spark, folder):
    """Loaded and fetched listings merged by id; a loaded one stands."""
    cut = F.lit(NIGHT).cast("timestamp_ntz")
    c = table(spark, folder, "event_candidates")
    part = lambda x: x.groupBy("id").agg(F.min("source").alias("source"))
    return writes.merge_missing(part(c.where(F.col("discovered_at") < cut)), part(c.where(~(F.col("discovered_at") < cut))), "id")


@query("SELECT id, name FROM (SELECT DISTINCT id, name FROM venues WHERE name IS NOT NULL) v WHERE lower(name) NOT IN (SELECT lower(c_name) FROM customer UNION SELECT lower(name) FROM venues WHERE category = 'cafe' AND name IS NOT NULL)")
def blocklist_anti(spark, folder):
    """Venues whose name no entry of a blocklist has."""
    v = table(spark, folder, "venues").where("name IS NOT NULL")
    block = table(spark, folder, "customer").select(F.lower("c_name").alias("k")).unionByName(v.where("category = 'cafe'").select(F.lower("name").alias("k"))).distinct()
    return v.select("id", "name", F.lower("name").alias("k")).distinct().join(block, "k", "left_anti").select("id", "name")


@query("""SELECT DISTINCT id, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round(2 * 3958.8 * asin(sqrt(least(pow(sin(radians(42.2 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(42.2)) * pow(sin(radians(-71.3 - longitude) / 2), 2), 1.0))), 4) END AS miles FROM venues
    WHERE latitude IS NULL OR longitude IS NULL OR 2 * 3958.8 * asin(sqrt(least(pow(sin(radians(42.2 - latitude) / 2), 2) + cos(radians(latitude)) * cos(radians(42.2)) * pow(sin(radians(-71.3 - longitude) / 2), 2), 1.0))) <= 15""")
def haversine_radius(spark, folder):
    """Venues within 15 miles; those without coordinates stay."""
    miles = N.haversine_miles(F.col("latitude"), F.col("longitude"), F.lit(42.2), F.lit(-71.3))
    return table(spark, folder, "venues").where(miles.isNull() | (miles <= 15)).select("id", F.round(miles, 4).alias("miles")).distinct()


@query("""WITH one AS (SELECT tz_name, min(source) AS only_source FROM source_zones GROUP BY 1 HAVING count(DISTINCT source) = 1)
    SELECT s.source, s.tz_name, o.only_source FROM source_zones s LEFT JOIN one o ON s.tz_name = o.tz_name""")
def site_unambiguous(spark, folder):
    """Each feed with the only feed of its zone, null where the zone has several."""
    z = table(spark, folder, "source_zones").select("source", "tz_name")
    one = z.groupBy("tz_name").agg(F.min("source").alias("only_source"), F.count_distinct("source").alias("n")).where("n = 1").drop("n")
    return z.join(one, "tz_name", "left").select("source", "tz_name", "only_source")


@query("""WITH seeds AS (SELECT handle FROM candidate_entities WHERE depth = 0 UNION SELECT lower(unnest(regexp_extract_all(text, '@[A-Za-z0-9_.]+'))) FROM documents)
    SELECT DISTINCT e.id, e.handle FROM candidate_entities e WHERE e.mention_count >= 3 AND EXISTS (SELECT 1 FROM seeds s WHERE list_contains(string_split(e.mention_sources, ','), s.handle))""")
def promotion_evidence(spark, folder):
    """Entities with three mentions and one by a seed: a handle of depth zero or one that a document names."""
    e = table(spark, folder, "candidate_entities")
    named = table(spark, folder, "documents").where(F.col("text").contains("@")).select(F.explode(T.handles_in(F.col("text"))).alias("m"))
    seeds = e.where("depth = 0").select(F.col("handle").alias("m")).unionByName(named).distinct()
    rows = e.where("mention_count >= 3").select("id", "handle", F.explode(F.split("mention_sources", ",")).alias("m"))
    return rows.join(seeds, "m", "left_semi").select("id", "handle").distinct()


# vectors

_PREFS = "SELECT vec_id AS pid, embedding AS p, label % 2 AS side FROM embeddings WHERE vec_id % 50 = 0"


def _dots(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"""WITH s AS (SELECT vec_id, pid, side, {_dots('embedding', 'p')} / (sqrt({_dots('embedding', 'embedding')}) * sqrt({_dots('p', 'p')})) AS c FROM embeddings, ({_PREFS}))
    SELECT vec_id, side, round(max(c), 6) AS best, max(struct_pack(c := round(c, 9), n := -pid)).n * -1 AS pid FROM s GROUP BY 1, 2""")
def best_preference(spark, folder):
    """For each vector the most similar preference, per side, where every vector whose id is divisible by 50 is one; ties go to the first."""
    return _best(spark, folder).select("vec_id", "side", r6("c").alias("best"), "pid")


def _best(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return best_of_all(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("p"), F.col("label").alias("l")))


def best_of_all(vectors: DataFrame, preferences: DataFrame, block: int = scoring.PREFERENCE_BLOCK) -> DataFrame:
    """(vec_id, side, c, pid): ``scoring.nearest`` of ``preferences(pid, p, l)`` for each row of ``vectors(vec_id, embedding)``; the side is the parity of ``l``."""
    found = scoring.nearest(vectors.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), preferences.select("pid", "p", F.pmod("l", F.lit(2)).alias("side")), block)
    return found.select(F.col("vid").alias("vec_id"), F.col("side").cast("int").alias("side"), "c", "pid")


@query(f"""WITH s AS (SELECT vec_id, label, side, max({_dots('embedding', 'p')} / (sqrt({_dots('embedding', 'embedding')}) * sqrt({_dots('p', 'p')}))) AS c FROM embeddings, ({_PREFS}) GROUP BY 1, 2, 3),
    b AS (SELECT vec_id, label, max(CASE WHEN side = 0 THEN c END) AS l, max(CASE WHEN side = 1 THEN c END) AS d FROM s GROUP BY 1, 2),
    k AS (SELECT label, CASE WHEN l > coalesce(d, -1) THEN l / (1 + exp(-(l - 0.5) / 0.1)) ELSE -d / (1 + exp(-(d - 0.5) / 0.1)) END AS x FROM b)
    SELECT label, round(coalesce(avg(CASE WHEN x > 0 THEN x END), 0) - coalesce(avg(CASE WHEN x < 0 THEN -x END), 0), 6) AS balanced, round(avg(x), 6) AS mean, count(*) AS n FROM k GROUP BY 1""")
def similarity_score(spark, folder):
    """Gated contributions of the better side, balanced over the vectors of each label."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    best = _best(spark, folder).groupBy("vec_id").agg(F.max(F.when(F.col("side") == 0, F.col("c"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("c"))).alias("d"))
    x = F.when(F.col("l") > F.coalesce("d", F.lit(-1.0)), F.col("l") * N.gate(F.col("l"), 0.5, 0.1)).otherwise(-F.col("d") * N.gate(F.col("d"), 0.5, 0.1))
    k = best.join(labels, "vec_id").select("label", x.alias("x"))
    up, down = F.coalesce(F.avg(F.when(F.col("x") > 0, F.col("x"))), F.lit(0.0)), F.coalesce(F.avg(F.when(F.col("x") < 0, -F.col("x"))), F.lit(0.0))
    return k.groupBy("label").agg(r6(up - down).alias("balanced"), r6(F.avg("x")).alias("mean"), F.count(F.lit(1)).alias("n"))


_BUCKET = "CAST('0x' || substr(sha256({0}), 1, 16) AS UBIGINT) % (SELECT count(*) FROM embeddings)"


def bucket_of(c, spark, folder):
    """The entry of a text in the dictionary of vectors: a hash of it by the dictionary's size."""
    return T.hash_bucket(c, table(spark, folder, "embeddings").count()).cast("bigint")


@query(f"""SELECT t.id, t.tag, t.weight, v.vec_id, v.label FROM (SELECT DISTINCT id, unnest(tags).text AS tag, unnest(tags).weight AS weight FROM event_candidates) t LEFT JOIN (SELECT vec_id, label FROM embeddings WHERE label <> 9) v ON v.vec_id = {_BUCKET.format('t.tag')}""")
def tag_vector_left_join(spark, folder):
    """Tags with their entry of the dictionary of vectors, null where it has none."""
    t = table(spark, folder, "event_candidates").select("id", F.explode("tags").alias("t")).select("id", F.col("t.text").alias("tag"), F.col("t.weight").alias("weight")).distinct()
    v = table(spark, folder, "embeddings").where("label <> 9").select("vec_id", "label")
    return t.join(v, bucket_of(F.col("tag"), spark, folder) == F.col("vec_id"), "left").select("id", "tag", "weight", "vec_id", "label")


# pair matching

_EVENTS = "SELECT DISTINCT event_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '\\bw/o\\b', 'without', 'g'), '\\bw/', 'with ', 'g'), '&', ' and ', 'g'), '[\\s\\x{00A0}]+', ' ', 'g')) AS t, regexp_replace(lower(trim(regexp_replace(venue, '[\\s\\x{00A0}]+', ' ', 'g'))), '^(the|a|an) ', '') AS v, start_time AS s FROM stored_events"


def _fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return matching.fuzzy_pairs(matching.guarded_pairs(table(spark, folder, "stored_events"), "event_id", "title", "venue", "start_time"))


@query()
def fuzzy_dedup_pairs(spark, folder):
    """Scored pairs of stored events at one venue within two hours."""
    return _fuzzy(spark, folder).select("a", "b", r6("score").alias("score"), "verdict")


@query(f"WITH e AS ({_EVENTS}) SELECT t AS title_key, v AS venue_key, s AS start_time, min(id) AS event_id, count(*) AS copies FROM e WHERE t IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def exact_dedup_groups(spark, folder):
    """Stored events that agree in canonical title, venue and start."""
    e = table(spark, folder, "stored_events").select("event_id", T.canonical_title(F.col("title")).alias("title_key"), T.canonical_venue(F.col("venue")).alias("venue_key"), "start_time").distinct().where("title_key IS NOT NULL")
    return e.groupBy("title_key", "venue_key", "start_time").agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


@query()
def fuzzy_clusters(spark, folder):
    """Clusters of merged pairs, each record with its class."""
    return matching.clusters(_fuzzy(spark, folder).where("verdict = 'merged'"), "a", "b")


@query()
def cluster_merge(spark, folder):
    """One record per cluster, nulls filled from the next best."""
    members = fuzzy_clusters(spark, folder)
    rows = ranking.first_per(table(spark, folder, "stored_events"), ["event_id"], F.desc("updated_at"), F.col("title"))
    return matching.merge_clusters(rows, members, "event_id", ["title", "venue", "location", "end_time", "summary", "venue_id"], "created_at")


@query()
def supersession(spark, folder):
    """Losers of each cluster with the winner and their pair's similarity."""
    pairs = materialise(_fuzzy(spark, folder).where("verdict = 'merged'"), "fuzzy")
    members = materialise(matching.clusters(pairs, "a", "b"), "clusters")
    rows = ranking.first_per(table(spark, folder, "stored_events"), ["event_id"], F.desc("updated_at"), F.col("title"))
    winners = matching.merge_clusters(rows, members, "event_id", ["title", "venue", "location", "end_time", "summary", "venue_id"], "created_at")
    return matching.cluster_supersession(members, winners, pairs)


@query("""WITH d AS (SELECT DISTINCT pass_name, record_a, record_b, score, verdict, CASE WHEN verdict = 'merged' THEN 'merged' WHEN score >= 0.7 THEN 'near_miss' ELSE 'sampled' END AS kind FROM dedup_decisions)
    SELECT pass_name, record_a, record_b, kind, CASE WHEN kind = 'sampled' THEN 10 ELSE 1 END AS denominator FROM d WHERE kind <> 'sampled' OR CAST('0x' || substr(sha256(pass_name || '|' || record_a || '|' || record_b), 1, 16) AS UBIGINT) % 10 = 0""")
def decision_sample(spark, folder):
    """Merged and near pairs whole, a reproducible tenth of the rest, with the rate on the row."""
    d = table(spark, folder, "dedup_decisions").select("pass_name", "record_a", "record_b", "score", "verdict").distinct().withColumn("kind", statistics.strata(F.col("score"), F.col("verdict")))
    keep = (F.col("kind") != "sampled") | (T.hash_bucket(F.concat_ws("|", "pass_name", "record_a", "record_b"), 10) == 0)
    return d.where(keep).select("pass_name", "record_a", "record_b", "kind", F.when(F.col("kind") == "sampled", 10).otherwise(1).alias("denominator"))


# statistics

_OBS = "SELECT DISTINCT event_id, observed_at, chars, tags, source FROM extraction_observations WHERE chars IS NOT NULL AND tags IS NOT NULL"


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "extraction_observations").where("chars IS NOT NULL AND tags IS NOT NULL").select("event_id", "observed_at", "chars", "tags", "source").distinct()


@query(f"SELECT event_id, observed_at, source, round(least(1.0, tags / (3.8 * (1 - exp(-chars / 127.0)))), 6) AS confidence FROM ({_OBS}) WHERE chars > 0")
def tag_confidence(spark, folder):
    o = observations(spark, folder).where("chars > 0")
    return o.select("event_id", "observed_at", "source", r6(N.confidence(F.col("tags"), N.expected_tags(F.col("chars"), F.lit(3.8), F.lit(127.0)))).alias("confidence"))


@query(f"SELECT source, n, round(1 + n / (n + 5) * (CASE WHEN p > 0 THEN a / p ELSE 1.0 END - 1), 6) AS multiplier FROM (SELECT source, count(*) AS n, sum(tags) AS a, sum(3.8 * (1 - exp(-chars / 127.0))) AS p FROM ({_OBS}) GROUP BY 1)")
def source_multipliers(spark, folder):
    m = statistics.source_multipliers(observations(spark, folder), "source", F.col("tags"), N.expected_tags(F.col("chars"), F.lit(3.8), F.lit(127.0)))
    return m.select("source", "n", r6("multiplier").alias("multiplier"))


@query(f"""SELECT CAST(CAST('0x' || substr(sha256(event_id), 1, 16) AS UBIGINT) % 5 AS INTEGER) AS fold, count(*) AS n, round(avg(CASE WHEN abs(r) <= 1.5 THEN 0.5 * r * r ELSE 1.5 * (abs(r) - 0.75) END), 6) AS loss FROM (SELECT event_id, tags - 3.8 * (1 - exp(-chars / 127.0)) AS r FROM ({_OBS})) GROUP BY 1""")
def hash_folds(spark, folder):
    """Huber loss of the curve per fold; folds are a hash of the event."""
    r = F.col("tags") - N.expected_tags(F.col("chars"), F.lit(3.8), F.lit(127.0))
    return observations(spark, folder).groupBy(T.hash_bucket(F.col("event_id"), 5).alias("fold")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(N.huber(r))).alias("loss"))


def _grid_sql() -> str:
    """The four grids of ``statistics.curve_fit``, one after the other."""
    loss = "SELECT cap, saturation, round(sum(n * CASE WHEN abs(r) <= 1.5 THEN 0.5 * r * r ELSE 1.5 * (abs(r) - 0.75) END), 6) AS loss FROM (SELECT n, cap, saturation, tags - cap * (1 - exp(-chars / saturation)) AS r FROM h, {grid}) GROUP BY 1, 2"
    best = "b{k} AS (SELECT cap, saturation, loss FROM ({found}) ORDER BY loss, old, cap, saturation LIMIT 1)"
    parts = [f"h AS (SELECT chars, tags, count(*) AS n FROM ({_OBS}) WHERE chars > 0 GROUP BY 1, 2)", "g0 AS (SELECT 0.5 + 14.5 * i / 59 AS cap, 10.0 * pow(300.0, j / 59) AS saturation FROM range(60) a(i), range(60) b(j))"]
    parts.append(best.format(k=0, found=f"SELECT *, 0 AS old FROM ({loss.format(grid='g0')})"))
    for k, span in enumerate((0.5, 0.1, 0.02), 1):
        low, high = f"greatest(0.5, cap - {span * 4})", f"least(15.0, cap + {span * 4})"
        thin, wide = f"greatest(10.0, saturation * (1 - {span}))", f"least(3000.0, saturation * (1 + {span}))"
        parts.append(f"g{k} AS (SELECT {low} + ({high} - {low}) * i / 39 AS cap, {thin} + ({wide} - {thin}) * j / 39 AS saturation FROM b{k - 1}, range(40) a(i), range(40) b(j))")
        parts.append(best.format(k=k, found=f"SELECT *, 0 AS old FROM ({loss.format(grid=f'g{k}')}) UNION ALL SELECT *, -1 FROM b{k - 1}"))
    return "WITH " + ", ".join(parts) + " SELECT round(cap, 3) AS cap, round(saturation, 1) AS saturation, round(loss, 4) AS loss FROM b3"


@query(_grid_sql())
def curve_grid_fit(spark, folder):
    """The curve that fits tags to length best: a grid of 60 by 60, then three finer ones around the best."""
    cap, saturation, loss = statistics.curve_fit(observations(spark, folder), "chars", "tags") or (None, None, None)
    one = spark.range(1).select(F.lit(cap).cast("double").alias("c"), F.lit(saturation).cast("double").alias("s"), F.lit(loss).cast("double").alias("l"))
    return one.select((F.round(F.col("c") * 1000) / 1000).alias("cap"), (F.round(F.col("s") * 10) / 10).alias("saturation"), (F.round(F.col("l") * 1e4) / 1e4).alias("loss"))


@query("""WITH n AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM n WHERE i <= 30 GROUP BY 1 HAVING count(*) >= 30 AND stddev_pop(value) > 0),
    s AS (SELECT event_type, i, sum((value - m) / sd - 0.5) OVER w AS u, sum((value - m) / sd + 0.5) OVER w AS d FROM n JOIN b USING (event_type) WHERE i > 30 WINDOW w AS (PARTITION BY event_type ORDER BY i)),
    h AS (SELECT event_type, i, u - least(0, min(u) OVER w) AS hi, d - greatest(0, max(d) OVER w) AS lo FROM s WINDOW w AS (PARTITION BY event_type ORDER BY i)), k AS (SELECT event_type, count(*) AS rows_there FROM events GROUP BY 1)
    SELECT event_type, CAST(min(i) AS INTEGER) AS alarm_at, CASE WHEN min_by(hi, i) > 5 THEN 'up' ELSE 'down' END AS direction FROM h JOIN k USING (event_type) WHERE hi > 5 OR lo < -5 GROUP BY 1 HAVING max(rows_there) - min(i) + 1 >= 10""")
def cusum_change(spark, folder):
    return statistics.cusum(table(spark, folder, "events"), "event_type", ["ts", "event_id"], "value")


@query("""WITH o AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'signup' THEN event_id END AS h FROM events)
    SELECT event_id, user_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM o""")
def carry_forward_heading(spark, folder):
    """Each row with the last heading above it."""
    e = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return ranking.carry_forward(e, "user_id", "o", F.when(F.col("event_type") == "signup", F.col("event_id")), "heading").select("event_id", "user_id", "heading")


@query("""SELECT event_id, user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS rolled FROM (SELECT *, CASE WHEN value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS f FROM events)""")
def year_rollover(spark, folder):
    e = table(spark, folder, "events").withColumn("o", F.struct("ts", "event_id"))
    return ranking.rollovers(e, "user_id", "o", "value", "rolled").select("event_id", "user_id", "rolled")


@query("SELECT user_id, event_type, min_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_wins_dedupe(spark, folder):
    return ranking.first_per(table(spark, folder, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


_CLIMB = """CASE WHEN value BETWEEN 10 AND 40 THEN 1.0 WHEN value < 10 THEN (CASE WHEN 10 - value <= 5 THEN 1 - (10 - value) / 5 WHEN 10 - value <= 10 THEN -(10 - value - 5) / 5 ELSE -1.0 END)
    ELSE (CASE WHEN value - 40 <= 20 THEN 1 - (value - 40) / 20 WHEN value - 40 <= 60 THEN -(value - 40 - 20) / 40 ELSE -1.0 END) END"""


@query(f"SELECT event_id, round({_CLIMB}, 6) AS comfort FROM events WHERE value IS NOT NULL")
def comfort_curve(spark, folder):
    """An asymmetric trapezoid over readings."""
    curve = N.Comfort((10, 40), (5, 60), (0, 100))
    return table(spark, folder, "events").where("value IS NOT NULL").select("event_id", r6(curve.value(F.col("value"))).alias("comfort"))


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS hour, round(avg(value), 6) AS reading FROM events GROUP BY 1, 2)
    SELECT o_orderkey, h.reading FROM (SELECT o_orderkey, DATE '2024-01-01' + CAST(o_orderkey % 30 AS INTEGER) AS day, CAST(o_orderkey % 24 AS INTEGER) AS hour FROM orders) o LEFT JOIN h USING (day, hour)""")
def weather_join(spark, folder):
    """Hourly readings joined by day and hour; rows without a reading stay."""
    h = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(r6(F.avg("value")).alias("reading"))
    o = table(spark, folder, "orders").select("o_orderkey", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 30).cast("int")).alias("day"), (F.col("o_orderkey") % 24).cast("int").alias("hour"))
    return o.join(h, ["day", "hour"], "left").select("o_orderkey", "reading")


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS t FROM events GROUP BY 1), r(name, low, high, s, e) AS (VALUES ('walk', 10, 40, 18, 20), ('swim', 25, 100, 12, 15))
    SELECT 'synthetic:' || name || ':' || strftime(day, '%Y-%m-%d') AS event_id, CAST(day AS TIMESTAMP) + s * INTERVAL 1 HOUR AS start_time, CAST(day AS TIMESTAMP) + e * INTERVAL 1 HOUR AS end_time FROM d, r WHERE t BETWEEN low AND high""")
def synthetic_rules(spark, folder):
    """Activities that rules derive from each day's readings; the rules are a literal."""
    d = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("t"))
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("low"), F.lit(b).alias("high"), F.lit(s).alias("s"), F.lit(e).alias("e")) for n, a, b, s, e in (("walk", 10, 40, 18, 20), ("swim", 25, 100, 12, 15))]))
    x = d.withColumn("r", rules).where(F.col("t").between(F.col("r.low"), F.col("r.high")))
    at = lambda c: F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col(c))
    return x.select(F.concat_ws(":", F.lit("synthetic"), "r.name", F.col("day").cast("string")).alias("event_id"), at("r.s").alias("start_time"), at("r.e").alias("end_time"))


@query("SELECT event_id, count(*) AS versions, max(updated_at) AS updated_at, date_diff('millisecond', min(created_at), max(updated_at)) AS duration_ms FROM stored_events GROUP BY 1")
def run_duration(spark, folder):
    e = table(spark, folder, "stored_events").groupBy("event_id").agg(F.count(F.lit(1)).alias("versions"), F.max("updated_at").alias("updated_at"), F.min("created_at").alias("c"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return e.select("event_id", "versions", "updated_at", (ms("updated_at") - ms("c")).alias("duration_ms"))


@query("SELECT DISTINCT event_id, run_date, base_score FROM event_scores WHERE run_date = (SELECT max(run_date) FROM event_scores) AND base_score IS NOT NULL AND NOT isnan(base_score)")
def latest_run(spark, folder):
    s = ranking.latest(table(spark, folder, "event_scores").select("event_id", "run_date", "base_score"), "run_date")
    return s.where(F.col("base_score").isNotNull() & ~F.isnan("base_score")).distinct()


@query("SELECT source, n, round(sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING), 0) <= 50000 AS within_budget FROM (SELECT source, count(*) AS n FROM event_candidates GROUP BY 1)")
def budget_cut(spark, folder):
    """Work in order until a budget is spent; the window runs over the sums of the sources."""
    g = table(spark, folder, "event_candidates").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), "source").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("source", "n", (F.sum("n").over(w) <= 50_000).alias("within_budget"))


@query(f"""WITH h AS (SELECT chars, tags FROM ({_OBS}) WHERE CAST('0x' || substr(sha256(event_id), 1, 16) AS UBIGINT) % 5 = 0), r AS (SELECT abs(tags - 4.5 * (1 - exp(-chars / 140.0))) AS a, abs(tags - 3.8 * (1 - exp(-chars / 127.0))) AS b FROM h),
    l AS (SELECT avg(CASE WHEN a <= 1.5 THEN 0.5 * a * a ELSE 1.5 * (a - 0.75) END) AS c, avg(CASE WHEN b <= 1.5 THEN 0.5 * b * b ELSE 1.5 * (b - 0.75) END) AS i FROM r) SELECT round(c, 6) AS candidate_loss, round(i, 6) AS incumbent_loss, c < i AS accepted FROM l""")
def refit_gate(spark, folder):
    """Whether another curve beats the present one on the held-out fold."""
    g = statistics.refit_gate(observations(spark, folder), "event_id", "chars", "tags", (4.5, 140.0), (3.8, 127.0))
    return g.select(r6("candidate_loss").alias("candidate_loss"), r6("incumbent_loss").alias("incumbent_loss"), "accepted")


@query("""WITH n AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    b AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS sd FROM n WHERE i <= 30 GROUP BY 1 HAVING count(*) >= 30 AND stddev_pop(value) > 0),
    s AS (SELECT event_type, i, sum((value - m) / sd - 0.5) OVER w AS u, sum((value - m) / sd + 0.5) OVER w AS d FROM n JOIN b USING (event_type) WHERE i > 30 WINDOW w AS (PARTITION BY event_type ORDER BY i)),
    h AS (SELECT event_type, i, u - least(0, min(u) OVER w) AS hi, d - greatest(0, max(d) OVER w) AS lo FROM s WINDOW w AS (PARTITION BY event_type ORDER BY i)), k AS (SELECT event_type, count(*) AS rows_there FROM events GROUP BY 1), c AS (SELECT event_type, min(i) AS a FROM h JOIN k USING (event_type) WHERE hi > 5 OR lo < -5 GROUP BY 1 HAVING max(rows_there) - min(i) + 1 >= 10)
    SELECT n.event_type, n.event_id FROM n LEFT JOIN c ON n.event_type = c.event_type WHERE a IS NULL OR i >= a""")
def drop_pre_change(spark, folder):
    """The readings of each type since its last change."""
    e = table(spark, folder, "events")
    changes = statistics.cusum(e, "event_type", ["ts", "event_id"], "value")
    return statistics.drop_before(e, changes, "event_type", ["ts", "event_id"], "alarm_at").select("event_type", "event_id")


@query()
def semantic_dedup_pairs(spark, folder):
    """Guarded pairs of stored events by the cosine of their titles' letter counts, a stand-in for summary vectors."""
    e = table(spark, folder, "stored_events").where("title IS NOT NULL")
    letters = F.array(*[F.length(F.regexp_replace(F.lower("title"), f"[^{c}]", "")).cast("double") for c in "abcdefghijklmnopqrstuvwxyz"])
    vectors = e.select("event_id", letters.alias("v"))
    pairs = matching.guarded_pairs(table(spark, folder, "stored_events"), "event_id", "title", "venue", "start_time")
    return matching.semantic_pairs(pairs, vectors, "event_id", "v").select("a", "b", r6("score").alias("score"), "verdict")


@query("SELECT o.event_id, o.observed_at FROM (SELECT DISTINCT event_id, observed_at FROM extraction_observations) o WHERE EXISTS (SELECT 1 FROM stored_events e WHERE e.event_id = o.event_id AND e.superseded_by IS NULL)")
def live_observations(spark, folder):
    """Observations of live events: a semi-join."""
    o = table(spark, folder, "extraction_observations").select("event_id", "observed_at").distinct()
    return o.join(table(spark, folder, "stored_events").where("superseded_by IS NULL").select("event_id").distinct(), "event_id", "left_semi")


@query("SELECT source, degradation, count(*) AS n, count(DISTINCT event_id) AS events, sum(CASE WHEN backfilled THEN 1 ELSE 0 END) AS backfilled FROM extraction_observations GROUP BY 1, 2")
def run_summary(spark, folder):
    o = table(spark, folder, "extraction_observations")
    return o.groupBy("source", "degradation").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"), F.sum(F.when(F.col("backfilled"), 1).otherwise(0)).alias("backfilled"))


@query("WITH c AS (SELECT model, prompt_version, count(*) AS n, min(observed_at) AS first_seen FROM extraction_observations WHERE model IS NOT NULL AND prompt_version IS NOT NULL GROUP BY 1, 2) SELECT model, prompt_version, n FROM c ORDER BY n DESC, first_seen, model, prompt_version LIMIT 1")
def modal_regime(spark, folder):
    """The most frequent model and prompt; ties go to the one seen first."""
    c = table(spark, folder, "extraction_observations").where("model IS NOT NULL AND prompt_version IS NOT NULL").groupBy("model", "prompt_version").agg(F.count(F.lit(1)).alias("n"), F.min("observed_at").alias("t"))
    return c.orderBy(F.desc("n"), "t", "model", "prompt_version").limit(1).select("model", "prompt_version", "n")
