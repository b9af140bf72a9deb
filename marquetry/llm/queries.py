"""Queries of the training-data operators, each over its whole tables, with SQL where that can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquetry.llm.addresses import locations, same_addresses
from marquetry.llm.components import components
from marquetry.llm.incremental import ListingIndex, first_listings
from marquetry.llm.mixing import mix
from marquetry.llm.mojibake import find_garbled
from marquetry.llm.packing import pack
from marquetry.llm.tokens import count_tokens
from marquetry.llm.topn import top_n
from marquetry.operators.lineage import materialise
from marquetry.operators.timestamps import normalise_fields


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best events of each run."""
    best = top_n(table(spark, folder, "event_scores"), "run_date", "event_id", F.col("base_score"), 10)
    return best.select(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "event_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of venue records at one location."""
    pairs = same_addresses(table(spark, folder, "venues"), "id", "address", ["name", "canonical_name"])
    return pairs.select(F.col("a").alias("venue_a"), F.col("b").alias("venue_b"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Each venue record with the smallest id of its location and the number of records there."""
    placed = materialise(locations(table(spark, folder, "venues"), "id", "address", ["name", "canonical_name"]), "locations")
    classes = placed.groupBy("location").agg(F.min("key").alias("class_id"), F.count_distinct("key").alias("records"))
    return placed.join(classes, "location").select(F.col("key").alias("venue_id"), "class_id", "records").distinct()


def listings_with_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, title, venue, town, start_us, at): the listings of which title, venue and start can be read."""
    rows = table(spark, folder, "event_candidates").select("id", "source", "title", "venue", "location", "start_time", "discovered_at")
    rows = rows.where(F.col("title").isNotNull() & F.col("venue").isNotNull() & F.col("start_time").isNotNull())
    starts = normalise_fields(rows.withColumn("row", F.struct("id", "title", "venue", "location", "discovered_at")), "row", ["start_time"], table(spark, folder, "source_zones"), seen="discovered_at")
    return starts.where(F.col("utc_us").isNotNull()).select("row.id", "row.title", "row.venue", F.col("row.location").alias("town"), F.col("utc_us").alias("start_us"), F.col("row.discovered_at").cast("timestamp").alias("at"))


#: The newest days of discovery, which p5_found adds to the index as a batch of their own.
NEWEST_DAYS = 30


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each later listing of a happening with the listing accepted first: an index of the history, then the newest batch against it."""
    newest = table(spark, folder, "event_candidates").agg(F.date_format(F.max("discovered_at") - F.make_dt_interval(days=F.lit(NEWEST_DAYS)), "yyyy-MM-dd")).first()[0]
    pairs = first_listings(materialise(listings_with_starts(spark, folder), "starts"), [newest] if newest else None)
    return pairs.select(F.least("later", "first").alias("candidate_a"), F.greatest("later", "first").alias("candidate_b"))


def p5_recall(spark: SparkSession, folder: str) -> DataFrame:
    """What the graph walks find of what an exhaustive search finds, per shard of an index of all listings; every 50th vector asks."""
    index = ListingIndex(spark)
    index.add(listings_with_starts(spark, folder))
    found = index.recall().agg(F.count(F.lit(1)).alias("shards"), F.max("vectors").alias("largest"), F.sum("asked").alias("asked"), F.sum("similar").alias("similar"), F.sum("found").alias("found"))
    return found.select("*", (F.col("found") / F.col("similar")).alias("recall"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each linked record with the smallest record id of its group."""
    return components(table(spark, folder, "dedup_decisions").where(F.col("verdict") == "merged"), "record_a", "record_b")


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in a container of each kind; only documents larger than the container are split."""
    return pack(*_sized(spark, folder), "doc_id", "tokens")


def _sized(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = count_tokens(table(spark, folder, "documents"), "doc_id", "text")
    return sizes, table(spark, folder, "container_sizes").select("container_kind", F.col("capacity_tokens").alias("capacity"))


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of each kind after the first fit and after the search, tokens and fill, beside the fewest containers possible."""
    sizes, kinds = _sized(spark, folder)
    sizes = materialise(sizes, "sizes")
    before = pack(sizes, kinds, "doc_id", "tokens", search=False).groupBy("container_kind").agg(F.count_distinct("container_id").alias("first_fit"))
    used = pack(sizes, kinds, "doc_id", "tokens").groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("tokens").alias("tokens"))
    fill = F.col("tokens") / (F.col("containers") * F.col("capacity"))
    return used.join(before, "container_kind").join(kinds, "container_kind").select("container_kind", "first_fit", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("fewest"), fill.alias("fill"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the mix with their numbers of copies."""
    return _mixed(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mix."""
    return _mixed(spark, folder)[1]


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    documents = table(spark, folder, "documents").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # a row per source of the mix
    return mix(count_tokens(documents, "doc_id", "text", ["source"]), targets, "doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold garbled text."""
    return find_garbled(table(spark, folder, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold garbled text, with the text restored as far as it can be."""
    return find_garbled(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_recall": p5_recall, "p6_found": p6_found, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_restored": p9_restored}

ORACLES = {
    "p1_found": """
        WITH best AS (SELECT run_date, event_id, max(base_score) AS s FROM event_scores WHERE base_score IS NOT NULL AND NOT isnan(base_score) GROUP BY 1, 2)
        SELECT strftime(run_date, '%Y-%m-%d') AS run_date, event_id FROM best QUALIFY row_number() OVER (PARTITION BY run_date ORDER BY s DESC, event_id) <= 10""",
    "p6_found": """
        WITH RECURSIVE links AS (
            SELECT record_a AS u, record_b AS v FROM dedup_decisions WHERE verdict = 'merged' AND record_a <> record_b
            UNION SELECT record_b, record_a FROM dedup_decisions WHERE verdict = 'merged' AND record_a <> record_b),
        reach(r, m) AS (SELECT u, u FROM links UNION SELECT l.v, reach.m FROM reach JOIN links l ON l.u = reach.r WHERE reach.m < l.v)
        SELECT r AS record_id, min(m) AS group_id FROM reach GROUP BY 1""",
}
