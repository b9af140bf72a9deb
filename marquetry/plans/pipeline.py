"""Queries of the scoring chain, the stages and the views, each with its SQL: similarity, weather, final scores, orders, inputs and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquetry.functions import numeric as N
from marquetry.functions import text as T
from marquetry.functions import timing as M
from marquetry.operators import matching, ranking, scoring, stages, writes
from marquetry.operators.lineage import materialise
from marquetry.plans.catalogue import _BUCKET, NIGHT, _dots, bucket_of, query, r6, table

# similarity

CONFIG = scoring.Scoring(midpoint=0.2, temperature=0.05, summary_weight=0.3, yes_from=0.05, no_margin=0.15)
#: The domain of each type of source; any other is general.
DOMAINS = {"cinema": "screen", "calendar": "music"}

_ITEMS = f"""ev AS (SELECT id, CASE min(source_type) WHEN 'cinema' THEN 'screen' WHEN 'calendar' THEN 'music' ELSE 'general' END AS scope, min(summary) AS summary FROM event_candidates GROUP BY 1),
    tg AS (SELECT id, text, max(least(greatest(coalesce(weight, 1.0), 0.0), 1.0)) AS weight FROM (SELECT id, unnest(tags).text AS text, unnest(tags).weight AS weight FROM event_candidates) WHERE trim(coalesce(text, '')) <> '' GROUP BY 1, 2),
    it AS (SELECT tg.id, CAST(row_number() OVER (PARTITION BY tg.id ORDER BY text) - 1 AS INTEGER) AS position, scope, weight, text AS tag, {_BUCKET.format('text')} AS vid FROM tg JOIN ev USING (id)
        UNION ALL SELECT id, NULL, scope, 1.0, NULL, {_BUCKET.format('summary')} FROM ev WHERE summary IS NOT NULL)"""
_CONTRIBUTIONS = f"""WITH {_ITEMS},
    prefs AS (SELECT vec_id AS pid, embedding AS p, CASE label % 2 WHEN 0 THEN 'like' ELSE 'dislike' END AS side, CASE WHEN label < 6 THEN 'general' WHEN label < 8 THEN 'music' ELSE 'screen' END AS domain FROM embeddings WHERE vec_id % 50 = 0),
    v AS (SELECT DISTINCT vid, scope FROM it),
    s AS (SELECT v.vid, v.scope, side, pid, {_dots('e.embedding', 'p')} / (sqrt({_dots('e.embedding', 'e.embedding')}) * sqrt({_dots('p', 'p')})) AS c FROM v JOIN embeddings e ON e.vec_id = v.vid AND e.label <> 9 JOIN prefs ON domain IN ('general', v.scope)),
    b AS (SELECT vid, scope, max(CASE side WHEN 'like' THEN c END) AS l, max(CASE side WHEN 'dislike' THEN c END) AS d, -max(CASE side WHEN 'like' THEN struct_pack(c := round(c, 9), n := -pid) END).n AS lp, -max(CASE side WHEN 'dislike' THEN struct_pack(c := round(c, 9), n := -pid) END).n AS dp FROM s GROUP BY 1, 2),
    c AS (SELECT id, position, tag, l, d, CASE WHEN l > coalesce(d, 0.0) THEN 'like' WHEN d IS NOT NULL THEN 'dislike' END AS factor, CASE WHEN l > coalesce(d, 0.0) THEN lp WHEN d IS NOT NULL THEN dp END AS pid, CASE WHEN l > coalesce(d, 0.0) THEN l WHEN d IS NOT NULL THEN d END AS sim, weight FROM it JOIN b USING (vid, scope)),
    k AS (SELECT *, CASE factor WHEN 'like' THEN 1 WHEN 'dislike' THEN -1 END * sim / (1 + exp(-(sim - 0.2) / 0.05)) * weight AS x FROM c)"""


def contributed(spark: SparkSession, folder: str) -> DataFrame:
    """The contributions of the distinct tags of each listing, in the order of their texts, and of its summary."""
    c = table(spark, folder, "event_candidates").select("id", "source_type", "tags", "summary")
    domain = F.lit("general")
    for kind, name in DOMAINS.items():
        domain = F.when(F.min("source_type") == kind, name).otherwise(domain)
    ev = c.groupBy("id").agg(domain.alias("scope"), F.min("summary").alias("summary"))
    tg = c.select("id", F.explode("tags").alias("t")).where(F.trim(F.coalesce("t.text", F.lit(""))) != "").groupBy("id", F.col("t.text").alias("tag")).agg(F.max(T.clamp_weight(F.col("t.weight"))).alias("weight"))
    tg = tg.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("tag")) - 1).join(ev.select("id", "scope"), "id")
    items = tg.select("id", "position", "scope", "weight", "tag").unionByName(ev.where("summary IS NOT NULL").select("id", F.lit(None).cast("int").alias("position"), "scope", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("tag"), "summary"), allowMissingColumns=True)
    items = materialise(items.withColumn("vid", bucket_of(F.coalesce("tag", "summary"), spark, folder)).drop("summary"), "scored-items")
    e = table(spark, folder, "embeddings")
    named = F.when(F.col("label") < 6, "general").when(F.col("label") < 8, "music").otherwise("screen")
    prefs = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("pid"), F.col("embedding").alias("p"), F.when(F.col("label") % 2 == 0, "like").otherwise("dislike").alias("side"), named.alias("domain"))
    return scoring.contributions(items, e.where("label <> 9").select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), prefs, [*DOMAINS.values()], CONFIG)


_TAGS = "coalesce(avg(CASE WHEN position IS NOT NULL AND x > 0 THEN x END), 0) - coalesce(avg(CASE WHEN position IS NOT NULL AND x < 0 THEN -x END), 0)"


@query(f"""{_CONTRIBUTIONS}, g AS (SELECT id, {_TAGS} AS t, coalesce(max(CASE WHEN position IS NULL THEN x END), 0) AS y, greatest(max(l), 0) AS bl, greatest(max(d), 0) AS bd FROM k GROUP BY 1)
    SELECT id, round(t, 6) AS tag_score, round(y, 6) AS summary_score, round(t + 0.3 * y, 6) AS base_score, CASE WHEN coalesce(bd, 0) - coalesce(bl, 0) >= 0.15 THEN 'no' WHEN t + 0.3 * y >= 0.05 THEN 'yes' ELSE 'maybe' END AS match FROM g""")
def event_similarity(spark, folder):
    """Tag score, summary score, base score and label of each listing with a known vector."""
    s = scoring.similarity_scores(contributed(spark, folder), CONFIG)
    return s.select("id", *[r6(c).alias(c) for c in ("tag_score", "summary_score", "base_score")], "match")


@query(f"""{_CONTRIBUTIONS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY position NULLS LAST) AS INTEGER) AS place, factor, pid, tag, round(sim, 6) AS similarity, round(x, 6) AS contribution FROM k WHERE x IS NOT NULL""")
def reasons_list(spark, folder):
    """The reasons of each listing in order, its tags first and then its summary, each with the preference that it met."""
    c = contributed(spark, folder).where("contribution IS NOT NULL")
    listed = c.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("position", F.lit(1 << 30)).alias("position"), "factor", "pid", "tag", "similarity", "contribution"))).alias("reasons"))
    each = listed.select("id", F.posexplode("reasons").alias("i", "r"))
    return each.select("id", (F.col("i") + 1).alias("place"), "r.factor", "r.pid", "r.tag", r6(F.col("r.similarity")).alias("similarity"), r6(F.col("r.contribution")).alias("contribution"))


@query(f"""{_CONTRIBUTIONS} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY round(abs(x), 9) DESC, position NULLS LAST) AS INTEGER) AS place, factor, pid, tag, round(x, 6) AS contribution FROM k WHERE x IS NOT NULL""")
def explain_order(spark, folder):
    """The same reasons by the weight of their contributions, either way; equal ones stay in order."""
    c = contributed(spark, folder).where("contribution IS NOT NULL").withColumn("__w", F.round(F.round(F.abs("contribution") * 1e9) / 1e9, 9))
    placed = c.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("__w"), F.col("position").asc_nulls_last())))
    return placed.select("id", "place", "factor", "pid", "tag", r6("contribution").alias("contribution"))


@query(f"""WITH {_ITEMS} SELECT tag, min(vid) AS vid, count(*) AS uses FROM it WHERE tag IS NOT NULL GROUP BY 1""")
def tag_dictionary(spark, folder):
    """The distinct tags with their entry of the dictionary: what a stage has to embed, once each."""
    t = table(spark, folder, "event_candidates").select("id", F.explode("tags").alias("t")).where(F.trim(F.coalesce("t.text", F.lit(""))) != "").select("id", F.col("t.text").alias("tag")).distinct()
    return t.groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).select("tag", bucket_of(F.col("tag"), spark, folder).alias("vid"), "uses")


# weather

_HOURS = """h AS (SELECT CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS hour, avg(CASE event_type WHEN 'view' THEN value END) AS temperature, avg(CASE event_type WHEN 'click' THEN value END) AS dew_point, avg(CASE event_type WHEN 'signup' THEN value END) AS humidity, avg(CASE event_type WHEN 'error' THEN value END) AS rain,
    CAST(sum(CASE event_type WHEN 'purchase' THEN value END) AS INTEGER) % 100 AS code FROM events GROUP BY 1, 2)"""
CURVES = {"temperature": N.Comfort((45, 55), (35, 65), (25, 85), 2.0), "dew_point": N.Comfort((40, 60), (30, 70), (20, 90), 1.0), "humidity": N.Comfort((40, 60), (30, 70), (20, 90), 1.0, fallback_for="dew_point"), "rain": N.Comfort((0, 40), (0, 60), (0, 90), 1.0, supersedes=("rain",))}
PENALTIES = {"rain": -0.6, "thunderstorm": -1.0, "snow": -0.4, "clear": 0.0}


def _curve_sql(c: str, k: N.Comfort) -> str:
    def side(d: str, i: float, z: float, f: float) -> str:
        a, b = abs(z - i), abs(f - z)
        if not a and not b:
            return "1.0"
        near = f"WHEN {d} <= {a} THEN 1 - ({d}) / {a}.0 " if a else ""
        far = f"WHEN {d} <= {a + b} THEN -({d} - {a}) / {b}.0 " if b else ""
        return f"CASE WHEN {d} <= 0 THEN 1.0 {near}{far}ELSE -1.0 END"

    low, high = side(f"({k.ideal[0]} - {c})", k.ideal[0], k.zero[0], k.floor[0]), side(f"({c} - {k.ideal[1]})", k.ideal[1], k.zero[1], k.floor[1])
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} < {k.ideal[0]} THEN {low} WHEN {c} > {k.ideal[1]} THEN {high} ELSE 1.0 END"


_WMO_SQL = "CASE " + " ".join(f"WHEN code IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in N.WMO.items()) + " ELSE 'overcast' END"
_COMFORT = f"""{_HOURS}, w AS (SELECT day, hour, {_WMO_SQL} AS condition, {_curve_sql('temperature', CURVES['temperature'])} AS t, {_curve_sql('dew_point', CURVES['dew_point'])} AS dw, CASE WHEN dew_point IS NULL THEN {_curve_sql('humidity', CURVES['humidity'])} END AS hu, {_curve_sql('rain', CURVES['rain'])} AS ra FROM h),
    m AS (SELECT *, (coalesce(2.0 * t, 0) + coalesce(dw, 0) + coalesce(hu, 0)) AS total, (CASE WHEN t IS NULL THEN 0 ELSE 2.0 END + CASE WHEN dw IS NULL THEN 0 ELSE 1 END + CASE WHEN hu IS NULL THEN 0 ELSE 1 END) AS weight FROM w),
    cf AS (SELECT day, hour, condition, CASE WHEN coalesce(t, dw, hu, ra) IS NULL THEN NULL ELSE least(CASE WHEN weight > 0 THEN total / weight ELSE 0 END, coalesce(ra, 9), CASE WHEN condition = 'rain' AND ra IS NULL THEN -0.6 WHEN condition = 'thunderstorm' THEN -1.0 WHEN condition = 'snow' THEN -0.4 ELSE 9 END) END AS comfort FROM m)"""


def hourly_comfort(spark: SparkSession, folder: str) -> DataFrame:
    """(day, hour, condition, comfort) of hourly readings, which the events of each type stand for."""
    e = table(spark, folder, "events")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    h = e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(mean("view").alias("temperature"), mean("click").alias("dew_point"), mean("signup").alias("humidity"), mean("error").alias("rain"), F.rint(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")))).cast("int").alias("code"))
    h = h.withColumn("condition", N.wmo_condition(F.col("code") % 100))
    return h.select("day", "hour", "condition", N.comfort({k: (F.col(k), c) for k, c in CURVES.items()}, F.col("condition"), PENALTIES).alias("comfort"))


@query(f"WITH {_COMFORT} SELECT day, hour, condition, round(comfort, 6) AS comfort FROM cf")
def weather_comfort(spark, folder):
    """The comfort of each hour: fallback and superseding curves, and conditions that cap."""
    return hourly_comfort(spark, folder).select("day", "hour", "condition", r6("comfort").alias("comfort"))


_EVENT = "SELECT event_id, min(setting) AS setting, min(timing) AS timing, min(start_time) AS start_time, min(title) AS title FROM stored_events WHERE superseded_by IS NULL GROUP BY 1"
_ADJUSTED = f"""{_COMFORT}, e AS ({_EVENT}), j AS (SELECT e.*, comfort FROM e LEFT JOIN cf ON hour = CASE WHEN timing = 'exact' THEN extract(hour FROM start_time) ELSE 20 END AND day = DATE '2024-01-01' + CAST(date_diff('day', DATE '2024-01-01', CAST(start_time AS DATE)) % 30 AS INTEGER)),
    a AS (SELECT event_id, setting, start_time, title, CASE WHEN setting = 'outdoor' THEN coalesce(comfort * CASE WHEN comfort >= 0 THEN 0.15 ELSE 0.25 END, 0.0) ELSE 0.0 END AS adjustment FROM j)"""


def adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, setting, start_time, title, adjustment): live events with the weather of their hour, or of 20:00 where no time is stated."""
    e = table(spark, folder, "stored_events").where("superseded_by IS NULL").groupBy("event_id").agg(*[F.min(c).alias(c) for c in ("setting", "timing", "start_time", "title")])
    days = hourly_comfort(spark, folder).groupBy("day").agg(F.collect_list(F.struct("hour", "comfort")).alias("hours"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.datediff("start_time", F.lit("2024-01-01")) % 30).cast("int"))
    j = e.withColumn("day", day).join(days, "day", "left").withColumn("reading", N.sample_hour(F.col("hours"), F.col("start_time"), F.col("timing") == "exact"))
    return j.select("event_id", "setting", "start_time", "title", N.weather_adjustment(F.col("reading.comfort"), F.col("setting")).alias("adjustment"))


@query(f"WITH {_ADJUSTED} SELECT event_id, setting, round(adjustment, 6) AS adjustment FROM a")
def weather_adjustment(spark, folder):
    """What the weather adds to each live event; nothing indoors and where it is unknown."""
    return adjusted(spark, folder).select("event_id", "setting", r6("adjustment").alias("adjustment"))


_RUN = f"""{_ADJUSTED}, s AS (SELECT event_id, max(base_score * coalesce(CASE WHEN isnan(tag_confidence) THEN NULL ELSE tag_confidence END, 1.0) ) AS s0, max(CASE match_kind WHEN 'like' THEN 1.5 WHEN 'dislike' THEN 0.5 ELSE 1.0 END) AS m FROM event_scores WHERE run_date = (SELECT max(run_date) FROM event_scores) AND base_score IS NOT NULL AND NOT isnan(base_score) GROUP BY 1),
    f AS (SELECT s.event_id, a.start_time, a.title, CASE WHEN s0 >= 0 THEN s0 * m ELSE s0 / m END + a.adjustment AS final_score FROM s JOIN a ON s.event_id = a.event_id)"""


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """(event_id, start_time, title, final_score) of the latest run's live events, the weather included."""
    s = ranking.latest(table(spark, folder, "event_scores"), "run_date").where(F.col("base_score").isNotNull() & ~F.isnan("base_score"))
    sure = F.coalesce(F.when(~F.isnan("tag_confidence"), F.col("tag_confidence")), F.lit(1.0))
    times = F.when(F.col("match_kind") == "like", 1.5).when(F.col("match_kind") == "dislike", 0.5).otherwise(1.0)
    s = s.groupBy("event_id").agg(F.max(F.col("base_score") * sure).alias("s"), F.max(times).alias("m"))
    return s.join(adjusted(spark, folder), "event_id").select("event_id", "start_time", "title", (N.toward(F.col("s"), F.col("m")) + F.col("adjustment")).alias("final_score"))


@query(f"""WITH {_RUN}, new AS (SELECT (SELECT max(run_date) FROM event_scores) AS run_date, event_id, round(final_score, 6) AS score, CAST(row_number() OVER (ORDER BY round(final_score, 6) DESC, event_id) AS INTEGER) AS rank FROM f)
    SELECT run_date, event_id, score, rank FROM new UNION ALL SELECT run_date, event_id, max(round(base_score, 6)), NULL FROM event_scores WHERE run_date < (SELECT max(run_date) FROM event_scores) AND base_score IS NOT NULL AND NOT isnan(base_score) GROUP BY 1, 2""")
def finish_run(spark, folder):
    """The latest run scored and ranked anew; it replaces its partition, the others stay."""
    scores = table(spark, folder, "event_scores")
    old = scores.where(F.col("base_score").isNotNull() & ~F.isnan("base_score")).groupBy("run_date", "event_id").agg(F.max(r6("base_score")).alias("score")).withColumn("rank", F.lit(None).cast("int"))
    last = scores.agg(F.max("run_date").alias("run_date"))
    new = finished(spark, folder).select("event_id", r6("final_score").alias("score")).crossJoin(F.broadcast(last))  # one row
    return writes.replace_partitions(old, ranking.rank_all(new, "run_date", "score", "event_id").select("run_date", "event_id", "score", "rank"), "run_date").select("run_date", "event_id", "score", "rank")


# views


@query(f"""WITH {_RUN}, r AS (SELECT event_id, start_time, round(final_score, 6) AS score FROM f WHERE start_time IS NOT NULL)
    SELECT CAST(start_time - INTERVAL 4 HOUR AS DATE) AS night, event_id, CAST(row_number() OVER (PARTITION BY CAST(start_time - INTERVAL 4 HOUR AS DATE) ORDER BY score DESC, event_id) AS INTEGER) AS number FROM r""")
def section_renumber(spark, folder):
    """The dated events of the latest run, numbered by score within each night."""
    f = finished(spark, folder).where("start_time IS NOT NULL").select(M.night_of(F.col("start_time").cast("timestamp")).alias("night"), "event_id", r6("final_score").alias("score"))
    return ranking.rank_all(f, "night", "score", "event_id").select("night", "event_id", F.col("rank").alias("number"))


@query("""SELECT event_id, CAST(row_number() OVER (ORDER BY start_time NULLS LAST, title NULLS LAST, event_id) AS BIGINT) AS number FROM (SELECT event_id, min(start_time) AS start_time, min(title) AS title FROM stored_events GROUP BY 1)""")
def raw_order(spark, folder):
    """All events by start, those without one last by title, numbered over the whole table."""
    e = table(spark, folder, "stored_events").groupBy("event_id").agg(F.min("start_time").alias("start_time"), F.min("title").alias("title"))
    return ranking.number_rows(e, F.col("start_time").asc_nulls_last(), F.col("title").asc_nulls_last(), F.col("event_id").asc(), name="number").select("event_id", "number")


@query("""WITH m AS (SELECT DISTINCT event_id, title FROM stored_events WHERE contains(lower(title), 'night')), o AS (SELECT *, row_number() OVER (ORDER BY title, event_id) AS n, count(*) OVER () AS c FROM m)
    SELECT event_id, title, CAST(n AS INTEGER) AS position, greatest(c - 10, 0) AS hidden FROM o WHERE n <= 10""")
def selector_match(spark, folder):
    """The first ten events whose title holds a word, and how many more there are."""
    m = table(spark, folder, "stored_events").select("event_id", "title").distinct().where(M.selected(F.col("event_id"), F.col("title"), "night"))
    return ranking.top_with_hidden(m.withColumn("g", F.lit(1)), ["g"], 10, F.col("title"), F.col("event_id")).select("event_id", "title", "position", "hidden")


@query("SELECT DISTINCT event_id, substr(sha1(event_id), 1, 7) AS handle FROM stored_events WHERE starts_with(substr(sha1(event_id), 1, 7), 'a1')")
def handle_match(spark, folder):
    """The events whose handle begins as a selector says."""
    e = table(spark, folder, "stored_events").select("event_id", "title").distinct()
    return e.where(M.selected(F.col("event_id"), F.col("title"), "#A1")).select("event_id", T.short_handle(F.col("event_id")).alias("handle")).distinct()


@query(f"SELECT CASE WHEN start_time IS NULL THEN 'undated' WHEN CAST(start_time AS DATE) = DATE '{NIGHT}' THEN 'on_date' ELSE 'dated' END AS kind, count(DISTINCT event_id) AS events FROM stored_events GROUP BY 1")
def dated_kinds(spark, folder):
    """Events on a date, dated otherwise, and undated."""
    e = table(spark, folder, "stored_events")
    kind = F.when(F.col("start_time").isNull(), "undated").when(F.to_date("start_time") == F.lit(NIGHT).cast("date"), "on_date").otherwise("dated")
    return e.groupBy(kind.alias("kind")).agg(F.count_distinct("event_id").alias("events"))


@query("SELECT run_date, event_id, base_score, CAST(n AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY run_date DESC, base_score DESC) AS n FROM (SELECT DISTINCT event_id, run_date, base_score FROM event_scores WHERE base_score IS NOT NULL AND NOT isnan(base_score))) WHERE n <= 3")
def score_history(spark, folder):
    """The three newest scores of each event, the newest first."""
    s = table(spark, folder, "event_scores").where(F.col("base_score").isNotNull() & ~F.isnan("base_score")).select("event_id", "run_date", "base_score").distinct()
    return ranking.top_per(s, ["event_id"], 3, F.desc("run_date"), F.desc("base_score")).select("run_date", "event_id", "base_score", "position")


# stages

_PLACE = "concat_ws(', ', nullif(venue, ''), nullif(location, ''))"
_INPUT = f"concat_ws(chr(10), nullif(title, ''), CASE WHEN {_PLACE} <> '' THEN 'Venue: ' || {_PLACE} END, nullif(description, ''), CASE WHEN source_type <> '' THEN 'Event category: ' || source_type END)"


@query(f"SELECT DISTINCT id, sha256({_INPUT}) AS input_hash, CAST(length({_INPUT}) AS INTEGER) AS chars FROM event_candidates")
def extraction_input(spark, folder):
    """The text a model would read of each listing, as its hash and length: the facts on labelled lines, blank ones left out."""
    c = table(spark, folder, "event_candidates")
    text = stages.extraction_text(*[F.col(x) for x in ("title", "venue", "location", "description", "source_type")])
    return c.select("id", T.fingerprint(text).alias("input_hash"), F.length(text).alias("chars")).distinct()


@query(f"""WITH i AS (SELECT id, max(struct_pack(l := last_seen_at, h := sha256({_INPUT}))).h AS h, min(discovered_at) AS d FROM event_candidates GROUP BY 1), done AS (SELECT id, max(struct_pack(l := last_seen_at, h := sha256({_INPUT}))).h AS h FROM event_candidates WHERE last_seen_at < TIMESTAMP '{NIGHT}' GROUP BY 1)
    SELECT i.id FROM i LEFT JOIN done USING (id) WHERE i.h IS DISTINCT FROM done.h""")
def extraction_queue(spark, folder):
    """Listings whose input has changed since a date, or is new."""
    c = table(spark, folder, "event_candidates").withColumn("h", T.fingerprint(stages.extraction_text(*[F.col(x) for x in ("title", "venue", "location", "description", "source_type")])))
    latest = lambda d: d.groupBy("id").agg(F.max(F.struct("last_seen_at", "h"))["h"].alias("h"))
    return stages.changed(latest(c), latest(c.where(F.col("last_seen_at") < F.lit(NIGHT).cast("timestamp_ntz"))), "id", "h").select("id")


@query("""SELECT DISTINCT id, tag FROM (SELECT id, title, venue, location, trim(unnest(tags).text) AS tag FROM event_candidates) WHERE tag <> '' AND lower(tag) NOT IN ('genre', 'music genre', 'musical genre', 'artist', 'event', 'performance type')
    AND lower(tag) IS DISTINCT FROM lower(trim(title)) AND lower(tag) IS DISTINCT FROM lower(trim(venue)) AND lower(tag) IS DISTINCT FROM lower(trim(location))""")
def tag_hygiene(spark, folder):
    """Tags that say something: no placeholders, and none that only repeat the title or the place."""
    c = table(spark, folder, "event_candidates").select("id", "title", "venue", "location", F.explode("tags").alias("t"))
    kept = c.withColumn("tag", F.trim("t.text")).where(stages.says_something(F.col("tag"), [F.col("title"), F.col("venue"), F.col("location")]))
    return kept.select("id", "tag").distinct()


@query("SELECT id, source_type AS tag FROM event_candidates GROUP BY 1, 2 HAVING max(len(tags)) = 0 OR max(len(tags)) IS NULL")
def category_fallback(spark, folder):
    """Listings without any tag get their category as one."""
    c = table(spark, folder, "event_candidates").groupBy("id", "source_type").agg(F.max(F.size("tags")).alias("n"))
    return c.where("n <= 0 OR n IS NULL").select("id", F.col("source_type").alias("tag"))


@query("""SELECT DISTINCT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' ELSE (s // 3600) || 'h' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || 'm' END AS age FROM (SELECT event_id, CAST(greatest(date_diff('second', created_at, updated_at), 0) AS BIGINT) AS s FROM stored_events) WHERE s IS NOT NULL""")
def duration_text(spark, folder):
    """The span between creation and update as people read it."""
    e = table(spark, folder, "stored_events")
    s = F.unix_seconds(F.col("updated_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp"))
    return e.select("event_id", T.duration(F.greatest(s, F.lit(0))).alias("age")).where("age IS NOT NULL").distinct()


@query("SELECT id, length(text) AS size, uses FROM (SELECT text, count(DISTINCT id) AS uses, min(id) AS id FROM (SELECT id, unnest(tags).text AS text FROM event_candidates) WHERE text IS NOT NULL GROUP BY 1)")
def embedding_stage(spark, folder):
    """A stage that is given each distinct text once and whose results are joined back; here a stand-in for a model that gives a text's length."""
    t = table(spark, folder, "event_candidates").select("id", F.explode("tags").alias("t")).select("id", F.col("t.text").alias("text")).where("text IS NOT NULL").distinct()
    done = stages.per_distinct(t, "text", lambda texts: [len(x) for x in texts], "size long")
    return done.groupBy("text").agg(F.min("id").alias("id"), F.max("size").alias("size"), F.count(F.lit(1)).alias("uses")).select("id", "size", "uses")


# keyed tables


@query("SELECT handle, count(*) AS n, min(depth) AS depth FROM (SELECT DISTINCT id, depth, handle, mention FROM (SELECT id, depth, handle, unnest(string_split(mention_sources, ',')) AS mention FROM candidate_entities)) GROUP BY 1")
def mention_upsert(spark, folder):
    """Entities with the number of distinct sources that mention them and the depth at which they were first met."""
    e = table(spark, folder, "candidate_entities").select("handle", "id", "depth", F.explode(F.split("mention_sources", ",")).alias("mention")).distinct()
    return e.groupBy("handle").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"))


@query("""WITH o AS (SELECT source, CAST(observed_at AS DATE) AS day, max(struct_pack(t := observed_at, c := chars, e := event_id)) AS x FROM extraction_observations WHERE source IS NOT NULL GROUP BY 1, 2), n AS (SELECT max(observed_at) AS t FROM extraction_observations)
    SELECT source, day, x.t AS stamped, x.t >= n.t - INTERVAL 30 DAY AS fresh FROM o, n""")
def day_cache(spark, folder):
    """The latest row per source and day, and whether it is fresh."""
    o = table(spark, folder, "extraction_observations").where("source IS NOT NULL").groupBy("source", F.to_date("observed_at").alias("day")).agg(F.max("observed_at").alias("stamped"))
    n = table(spark, folder, "extraction_observations").agg(F.max("observed_at").alias("t"))
    return o.crossJoin(F.broadcast(n)).select("source", "day", "stamped", (F.col("stamped") >= F.col("t") - F.make_dt_interval(days=F.lit(30))).alias("fresh"))  # one row


@query(f"""WITH l AS (SELECT event_id, max(struct_pack(u := updated_at, t := title, s := summary)) AS x, count(*) AS versions FROM stored_events GROUP BY 1) SELECT event_id, x.t AS title, versions FROM l""")
def event_save(spark, folder):
    """Saving by id: the latest version stands."""
    e = table(spark, folder, "stored_events").groupBy("event_id").agg(F.max(F.struct("updated_at", "title", "summary")).alias("x"), F.count(F.lit(1)).alias("versions"))
    return e.select("event_id", "x.title", "versions")


@query(f"""WITH a AS (SELECT id, unnest(tags).text AS t FROM event_candidates WHERE last_seen_at < TIMESTAMP '{NIGHT}'), b AS (SELECT id, unnest(tags).text AS t FROM event_candidates WHERE last_seen_at >= TIMESTAMP '{NIGHT}'), i AS (SELECT DISTINCT id FROM event_candidates)
    SELECT DISTINCT 'gone' AS change, t AS tag FROM a WHERE t NOT IN (SELECT t FROM b WHERE t IS NOT NULL) UNION ALL SELECT DISTINCT 'new', t FROM b WHERE t NOT IN (SELECT t FROM a WHERE t IS NOT NULL) UNION ALL SELECT 'both', t FROM (SELECT t FROM a INTERSECT SELECT t FROM b) WHERE t IS NOT NULL""")
def tag_difference(spark, folder):
    """The tags of two periods: those gone, those new, those in both."""
    t = table(spark, folder, "event_candidates").select(F.explode("tags").alias("t"), (F.col("last_seen_at") >= F.lit(NIGHT).cast("timestamp_ntz")).alias("late")).select(F.col("t.text").alias("tag"), "late").where("tag IS NOT NULL")
    g = t.groupBy("tag").agg(F.max(F.when(F.col("late"), 1).otherwise(0)).alias("b"), F.max(F.when(~F.col("late"), 1).otherwise(0)).alias("a")).where("a + b > 0")
    return g.select(F.when((F.col("a") == 1) & (F.col("b") == 1), "both").when(F.col("b") == 1, "new").otherwise("gone").alias("change"), "tag")


# pairs


@query("""WITH RECURSIVE links AS (SELECT record_a AS u, record_b AS v FROM dedup_decisions WHERE verdict = 'merged' AND record_kind = 'event' AND record_a <> record_b UNION SELECT record_b, record_a FROM dedup_decisions WHERE verdict = 'merged' AND record_kind = 'event' AND record_a <> record_b),
    reach(r, m) AS (SELECT u, u FROM links UNION SELECT l.v, reach.m FROM reach JOIN links l ON l.u = reach.r WHERE reach.m < l.v) SELECT r AS id, min(m) AS cluster FROM reach GROUP BY 1""")
def decision_clusters(spark, folder):
    """The clusters of the events that decisions merged."""
    return matching.clusters(_merged(spark, folder), "record_a", "record_b")


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dedup_decisions").where("verdict = 'merged' AND record_kind = 'event' AND record_a IS NOT NULL AND record_b IS NOT NULL").select("record_a", "record_b")


_FIELDS = ("title", "venue", "location", "end_time", "summary", "venue_id")
_ORDERED = f"struct_pack(n := {' + '.join(f'CAST({f} IS NULL AS INTEGER)' for f in _FIELDS)}, c := created_at, e := event_id)"


@query(f"""WITH RECURSIVE links AS (SELECT record_a AS u, record_b AS v FROM dedup_decisions WHERE verdict = 'merged' AND record_kind = 'event' AND record_a <> record_b UNION SELECT record_b, record_a FROM dedup_decisions WHERE verdict = 'merged' AND record_kind = 'event' AND record_a <> record_b),
    reach(r, m) AS (SELECT u, u FROM links UNION SELECT l.v, reach.m FROM reach JOIN links l ON l.u = reach.r WHERE reach.m < l.v), k AS (SELECT r AS id, min(m) AS cluster FROM reach GROUP BY 1),
    e AS (SELECT event_id, {', '.join(f'min({f}) AS {f}' for f in _FIELDS)}, min(created_at) AS created_at FROM stored_events GROUP BY 1), o AS (SELECT *, {_ORDERED} AS o FROM e JOIN k ON e.event_id = k.id)
    SELECT cluster, arg_min(event_id, o) AS winner, count(*) AS members, {', '.join(f'arg_min({f}, o) FILTER ({f} IS NOT NULL) AS {f}' for f in _FIELDS)} FROM o GROUP BY 1""")
def decision_merge(spark, folder):
    """One record per cluster of decisions that has events: the completest wins, its gaps are filled from the next best."""
    rows = table(spark, folder, "stored_events").groupBy("event_id").agg(*[F.min(f).alias(f) for f in _FIELDS], F.min("created_at").alias("created_at"))
    return matching.merge_clusters(rows, decision_clusters(spark, folder), "event_id", list(_FIELDS), "created_at")


@query(f"""WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, vec_id, {_dots('embedding', 'q')} / (sqrt({_dots('embedding', 'embedding')}) * sqrt({_dots('q', 'q')})) AS c FROM embeddings, q WHERE vec_id <> qid) SELECT qid, vec_id, round(c, 6) AS cosine FROM s WHERE c >= 0.2""")
def cosine_pairs(spark, folder):
    """Each vector whose id is divisible by 50 with all others that are similar."""
    e = table(spark, folder, "embeddings")
    p = scoring.similar_pairs(e.select(F.col("vec_id").alias("vid"), F.col("embedding").alias("v")), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q")), 0.2)
    return p.select("qid", F.col("vid").alias("vec_id"), r6("c").alias("cosine"))


@query(f"""WITH d AS (SELECT DISTINCT record_a AS a, record_b AS b FROM dedup_decisions WHERE record_kind = 'event' AND record_a < record_b), v AS (SELECT a, b, x.embedding AS p, y.embedding AS q FROM d JOIN embeddings x ON x.vec_id = {_BUCKET.format('a')} AND x.label <> 9 JOIN embeddings y ON y.vec_id = {_BUCKET.format('b')} AND y.label <> 9),
    s AS (SELECT a, b, {_dots('p', 'q')} / (sqrt({_dots('p', 'p')}) * sqrt({_dots('q', 'q')})) AS c FROM v) SELECT a, b, round(c, 6) AS score, CASE WHEN c >= 0.1 THEN 'merged' ELSE 'distinct' END AS verdict FROM s""")
def semantic_verdicts(spark, folder):
    """The pairs that decisions name, judged by the cosine of their vectors; a record without a vector is incomparable."""
    d = table(spark, folder, "dedup_decisions").where("record_kind = 'event' AND record_a < record_b").select(F.col("record_a").alias("a"), F.col("record_b").alias("b")).distinct()
    ids = d.select(F.explode(F.array("a", "b")).alias("k")).distinct().withColumn("vec_id", bucket_of(F.col("k"), spark, folder))
    vectors = ids.join(table(spark, folder, "embeddings").where("label <> 9").select("vec_id", "embedding"), "vec_id")
    return matching.semantic_pairs(d, vectors, "k", "embedding", least=0.1).select("a", "b", r6("score").alias("score"), "verdict")
