"""Queries of the general data-quality problems: timestamps (p2) and references (p3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.operators.references import failed_references
from marquetry.operators.timestamps import CANONICAL, estimate_zones, normalise_fields, sequences, shared_starts, usual_spans, zone_histories

TIME_FIELDS = ["start_time", "end_time", "raw_published_at"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each readable time that is not yet in canonical form, as microseconds in UTC."""
    rows = table(spark, folder, "event_candidates").select("id", "source", "discovered_at", *TIME_FIELDS)
    read = normalise_fields(rows, "id", TIME_FIELDS, table(spark, folder, "source_zones"))
    new = read.where(F.col("utc_us").isNotNull() & ~F.col("text").rlike(CANONICAL))
    return new.select(F.col("id").alias("candidate_id"), "field_name", "utc_us").distinct()


def p2_zone_estimates(spark: SparkSession, folder: str) -> DataFrame:
    """The zone estimated for each source from its listings' starts and ends and from what other feeds state, beside the declared one.

    Candidates are all offset histories of the zone database in the years of the readings; where several read all of a source's readings alike, one that some feed
    declares gives the name. ``agrees`` says whether the declared zone is among those; it is null where the readings do not tell.
    """
    zones = table(spark, folder, "source_zones").select("source", "tz_name", "date_order")
    rows = table(spark, folder, "event_candidates").select("source", "start_time", "end_time", "discovered_at", "title", "venue")
    years = rows.agg(F.min(F.year("discovered_at")).alias("a"), F.max(F.year("discovered_at")).alias("b")).first()
    histories = zone_histories(years.a or 2025, (years.b or 2025) + 1)
    named = {n: first for first, names in histories.items() for n in names}
    declared = sorted(r.tz_name for r in zones.select("tz_name").distinct().collect() if r.tz_name in named)
    usual = usual_spans(sequences(rows, zones, ["UTC"], alike=True))
    readings = sequences(rows, zones, ["UTC"]).withColumn("same", F.lit(False)).unionByName(shared_starts(rows, zones, "title", "venue"))
    found = estimate_zones(readings, "source", "local", "other_us", list(histories), "after", usual or {0: 1.0}, [named[d] for d in declared], "same")
    history = F.try_element_at(F.create_map(*[F.lit(x) for pair in named.items() for x in pair]), F.col("declared_zone"))
    out = zones.select("source", F.col("tz_name").alias("declared_zone")).join(found, "source", "left").withColumn("agrees", F.array_contains("alike", history))
    names = F.create_map(*[F.lit(x) for d in declared for x in (named[d], d)]) if declared else F.create_map().cast("map<string,string>")
    return out.select("source", "declared_zone", F.when(F.col("agrees"), F.col("declared_zone")).otherwise(F.coalesce(F.try_element_at(names, F.col("zone")), F.col("zone"))).alias("estimated_zone"), "agrees", "violations", "readings")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each reference of decisions, observations and promoted entities that fails in a month, with the reason."""
    decisions = table(spark, folder, "dedup_decisions")
    refs = None
    for field in ("record_a", "record_b"):
        part = decisions.where(F.col("record_kind").isin("candidate", "event")).select(F.lit("dedup_decisions").alias("ref_table"), F.lit(field).alias("ref_field"), F.col("record_kind").alias("kind"), F.col(field).alias("key"), F.col("updated_at").alias("at"))
        refs = part if refs is None else refs.unionByName(part)
    for name, field, kind, at in (("extraction_observations", "event_id", "event", "observed_at"), ("candidate_entities", "promoted_venue_id", "venue", "updated_at")):
        refs = refs.unionByName(table(spark, folder, name).select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(kind).alias("kind"), F.col(field).alias("key"), F.col(at).alias("at")))
    parents = None
    for name, field, kind, at in (("event_candidates", "id", "candidate", "discovered_at"), ("stored_events", "event_id", "event", "created_at"), ("venues", "id", "venue", "discovered_at")):
        part = table(spark, folder, name).select(F.lit(kind).alias("kind"), F.col(field).alias("key"), F.col(at).alias("since"))
        parents = part if parents is None else parents.unionByName(part)
    purged = table(spark, folder, "purged_records").select(F.col("record_kind").alias("kind"), F.col("record_id").alias("key"))
    return failed_references(refs, parents, purged)


QUERIES = {"p2_found": p2_found, "p2_zone_estimates": p2_zone_estimates, "p3_found": p3_found}

_TARGETS = "SELECT 'candidate' AS kind, id AS k, min(discovered_at) AS since FROM event_candidates GROUP BY 2 UNION ALL SELECT 'event', event_id, min(created_at) FROM stored_events GROUP BY 2 UNION ALL SELECT 'venue', id, min(discovered_at) FROM venues GROUP BY 2"

ORACLES = {
    "p3_found": f"""
        WITH refs AS (
            SELECT 'dedup_decisions' AS ref_table, 'record_a' AS ref_field, record_kind AS kind, record_a AS k, updated_at AS at FROM dedup_decisions
            UNION ALL SELECT 'dedup_decisions', 'record_b', record_kind, record_b, updated_at FROM dedup_decisions
            UNION ALL SELECT 'extraction_observations', 'event_id', 'event', event_id, observed_at FROM extraction_observations
            UNION ALL SELECT 'candidate_entities', 'promoted_venue_id', 'venue', promoted_venue_id, updated_at FROM candidate_entities),
        targets AS ({_TARGETS}),
        gone AS (SELECT DISTINCT record_kind AS kind, record_id AS k FROM purged_records)
        SELECT DISTINCT r.ref_table, r.ref_field, r.k AS ref_value, strftime(r.at, '%Y-%m') AS ref_month,
            CASE WHEN t.k IS NOT NULL THEN 'late' WHEN g.k IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
        FROM refs r LEFT JOIN targets t ON r.kind = t.kind AND r.k = t.k LEFT JOIN gone g ON r.kind = g.kind AND r.k = g.k
        WHERE r.k IS NOT NULL AND r.at IS NOT NULL AND (t.k IS NULL OR t.since > r.at)""",
}
