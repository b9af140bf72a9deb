"""Stages around models: their inputs, queues and results. A model is any function over batches of texts; it is called once for each distinct text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tags that name the idea of a tag.
PLACEHOLDERS = ("genre", "music genre", "musical genre", "artist", "event", "performance type")


def extraction_text(title: Column, venue: Column, location: Column, description: Column, category: Column) -> Column:
    """What a model reads of a record: title, place, description and category, each on a line of its own with a label where it needs one; blank facts are left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    place = F.nullif(F.concat_ws(", ", some(venue), some(location)), F.lit(""))
    return F.concat_ws("\n", some(title), F.concat(F.lit("Venue: "), place), some(description), F.concat(F.lit("Event category: "), some(category)))


def embedding_hash(tags: Column, summary: Column) -> Column:
    """The hash of what vectors are made from: the tags' texts and the summary, a line each."""
    return F.sha2(F.concat_ws("\n", F.transform(tags, lambda t: t["text"]), F.coalesce(summary, F.lit(""))), 256)


def changed(now: DataFrame, done: DataFrame, key: str, content: str) -> DataFrame:
    """The rows of ``now`` whose key is new or whose content differs from what was ``done``; a null content is one too."""
    before = done.select(F.col(key).alias("__k"), F.col(content).alias("__c"), F.lit(True).alias("__done"))
    return now.join(before, F.col(key) == F.col("__k"), "left").where(F.col("__done").isNull() | ~F.col(content).eqNullSafe(F.col("__c"))).drop("__k", "__c", "__done")


def in_turn(queue: DataFrame, start: str, key: str) -> DataFrame:
    """The soonest first, those without a start last."""
    return queue.orderBy(F.col(start).asc_nulls_last(), F.col(key))


def says_something(tag: Column, stated: list[Column]) -> Column:
    """Whether a tag is neither blank, a placeholder, nor just what the input states: its title, its place or a part of that."""
    low = F.lower(tag)
    good = (tag != "") & ~low.isin(*PLACEHOLDERS)
    for c in stated:
        good = good & ~low.eqNullSafe(F.lower(F.trim(c)))
    return good


def setting_of(raw: Column) -> Column:
    """Indoor or outdoor as stated; anything else is unknown."""
    low = F.lower(F.trim(raw))
    return F.when(low.isin("indoor", "outdoor"), low).otherwise("unknown")


def tags_of(reply: Column) -> Column:
    """Tags of a reply, a variant: texts, or objects with ``tag`` or ``text`` and a weight; blank ones are dropped, a missing weight is one."""
    each = reply.cast("array<variant>")
    text = lambda v: F.coalesce(F.try_variant_get(v, "$.tag", "string"), F.try_variant_get(v, "$.text", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    weight = lambda v: F.least(F.greatest(F.coalesce(F.try_variant_get(v, "$.weight", "double"), F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    found = F.transform(each, lambda v: F.struct(F.trim(F.regexp_replace(text(v), r"[\s\x{00A0}]+", " ")).alias("text"), weight(v).alias("weight")))
    return F.filter(found, lambda t: t["text"] != "")


def with_fallback(tags: Column, category: Column) -> Column:
    """The category as the only tag where there is none."""
    fallback = F.when(F.nullif(category, F.lit("")).isNotNull(), F.array(F.struct(category.alias("text"), F.lit(1.0).alias("weight"))))
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, tags).otherwise(F.coalesce(fallback, tags))


def per_distinct(rows: DataFrame, text: str, model: Callable[[list[str]], list], result: str) -> DataFrame:
    """``rows`` with the column ``result`` (a name and a type) that ``model`` gives for each text; it sees every distinct text once, in batches. A null text is not asked about and has a null result."""
    name, kind = result.split(" ", 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"__text": b["__text"], name: model(b["__text"].tolist())})

    asked = rows.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    return rows.join(asked.mapInPandas(run, f"__text string, {name} {kind}"), F.col(text) == F.col("__text"), "left").drop("__text")


def carried(rows: DataFrame, stored: DataFrame, content: str, vector: str, stamp: str) -> DataFrame:
    """``rows`` without a vector take that of the stored row with the same content hash, of several the last; what has one keeps it."""
    last = stored.where(F.col(vector).isNotNull()).groupBy(F.col(content).alias("__c")).agg(F.max_by(vector, stamp).alias("__v"))
    return rows.join(last, F.col(content) == F.col("__c"), "left").withColumn(vector, F.coalesce(F.col(vector), F.col("__v"))).drop("__c", "__v")


def renewed(cache: DataFrame, lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, new, gone): the cached rows whose line is still there with its present columns, the lines to be embedded, and the cached rows to be pruned."""
    return lines.join(cache.select(*keys, *[c for c in cache.columns if c not in lines.columns]), keys), lines.join(cache.select(*keys), keys, "left_anti"), cache.join(lines.select(*keys), keys, "left_anti")


def revision(lines: DataFrame, *columns: str) -> DataFrame:
    """(content_hash): one hash for a whole set of lines, whatever their order: the hash of their hashes, which add up as whole numbers in 16 parts."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 4 * i, 4), 16, 10).cast("bigint")).alias(f"p{i}") for i in range(16)]
    return lines.agg(*parts).select(F.sha2(F.concat_ws("|", *[F.col(f"p{i}").cast("string") for i in range(16)]), 256).alias("content_hash"))
