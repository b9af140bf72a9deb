"""References to records that are missing, were deleted, or arrived later than the row that names them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise

#: Keys per range: the positions of one 4 KB bitmap of Spark's bitmap functions.
RANGE = 32_768
#: Keys aimed at per range, so that hashing leaves room.
AIM = 16_384


def failed_references(refs: DataFrame, parents: DataFrame, purged: DataFrame) -> DataFrame:
    """Every reference that fails in a month, with the reason.

    ``refs(ref_table, ref_field, kind, key, at)``, ``parents(kind, key, since)``, ``purged(kind, key)``. Result
    (ref_table, ref_field, ref_value, ref_month, reason): ``late`` if a parent exists whose ``since`` lies after the earliest reference of
    that month, ``deleted`` if there is none but ``purged`` has the key, else ``missing``. Null keys, null kinds and
    references without a time are no references; a parent without ``since`` was always there; of repeated parents the earliest counts.
    An empty string is an ordinary key. Empty tables give what follows from them: no parents, every reference fails.

    Keys are encoded as integers: a hash puts each into a range, its rank there is its bit. The rank is a function of the set of keys, so
    a recomputed task finds the same codes. For each range and period there is one bitmap of references and one of
    the parents there before the period; reference AND-NOT parent leaves the bits to decode, and only those are looked at by row.
    The one shuffle of the input is by range, after repeated references were reduced to one per key and month,
    so a hot key is one row per month and field; the coded rows are written once, and decoding looks only at those whose bit is open. No task holds more than a range.
    """
    month = F.date_format("at", "yyyy-MM")
    r = refs.where(F.col("key").isNotNull() & F.col("kind").isNotNull() & F.col("at").isNotNull())
    r = r.groupBy("ref_table", "ref_field", "kind", "key", month.alias("month")).agg(F.min("at").alias("at"))
    r = r.select("kind", "key", "ref_table", "ref_field", "month", "at", F.lit("r").alias("role"))
    none = F.lit(None).cast("string")
    # a parent is sure for a month if it was there before the month began; one that always was, from the first month on
    p = parents.where(F.col("key").isNotNull() & F.col("kind").isNotNull()).groupBy("kind", "key").agg(F.min(F.coalesce("since", F.lit("0001-01-01").cast("timestamp"))).alias("at"))
    p = p.select("kind", "key", none.alias("ref_table"), none.alias("ref_field"), F.date_format("at", "yyyy-MM").alias("month"), "at", F.lit("p").alias("role"))
    d = purged.where(F.col("key").isNotNull() & F.col("kind").isNotNull()).select("kind", "key").distinct()
    d = d.select("kind", "key", none.alias("ref_table"), none.alias("ref_field"), none.alias("month"), F.lit(None).cast("timestamp").alias("at"), F.lit("d").alias("role"))

    about = refs.select(F.approx_count_distinct("key")).first()[0] + parents.select(F.approx_count_distinct("key")).first()[0]
    ranges = max(1, -(-int(about * 1.1) // AIM))
    from pyspark.sql import Window

    rows = r.unionByName(p).unionByName(d).withColumn("range", F.pmod(F.xxhash64("kind", "key"), F.lit(ranges)).cast("int"))
    # more ranges than shuffle partitions or fewer: the exchange is by range either way
    code = F.dense_rank().over(Window.partitionBy("range").orderBy("kind", "key")) - 1
    coded = rows.withColumn("code", code).withColumn("part", F.floor(F.col("code") / RANGE).cast("int")).withColumn("bit", (F.col("code") % RANGE).cast("bigint"))
    coded = materialise(coded.drop("kind", "code"), "coded-references")  # read twice: for the bitmaps, and to decode what they leave

    maps = coded.where(F.col("role") != "d").groupBy("range", "part", "role", "ref_table", "ref_field", "month").agg(F.bitmap_construct_agg("bit").alias("bits"))
    left = maps.groupBy("range", "part").applyInPandas(_and_not, "range int, part int, ref_table string, ref_field string, month string, bit bigint")
    opened = left.groupBy("range", "part", "bit").agg(F.collect_list(F.struct("ref_table", "ref_field", "month")).alias("open"))
    facts = coded.join(opened, ["range", "part", "bit"]).groupBy("range", "part", "bit").agg(
        F.first("open").alias("open"),
        F.first("key", ignorenulls=True).alias("key"),
        F.min(F.when(F.col("role") == "p", F.col("at"))).alias("since"),
        F.max((F.col("role") == "d").cast("int")).alias("purged"),
        F.collect_list(F.when(F.col("role") == "r", F.struct("ref_table", "ref_field", "month", "at"))).alias("refs"),
    )
    joined = facts.select("key", "since", "purged", "open", F.explode("refs").alias("x"))
    failed = joined.where(F.array_contains("open", F.struct("x.ref_table", "x.ref_field", "x.month"))).where(F.col("since").isNull() | (F.col("since") > F.col("x.at")))
    reason = F.when(F.col("since").isNotNull(), "late").when(F.col("purged") == 1, "deleted").otherwise("missing")
    return failed.select(F.col("x.ref_table").alias("ref_table"), F.col("x.ref_field").alias("ref_field"), F.col("key").alias("ref_value"), F.col("x.month").alias("ref_month"), reason.alias("reason")).distinct()


def _and_not(maps: pd.DataFrame) -> pd.DataFrame:
    """References AND NOT the parents of earlier periods, decoded; one range, so a few bitmaps of 4 KB per field and month."""
    import numpy as np

    parents = maps[maps.role == "p"].sort_values("month")
    found = []
    for (table, field, month), group in maps[maps.role == "r"].groupby(["ref_table", "ref_field", "month"]):
        bits = np.frombuffer(group.bits.iloc[0], "u1")
        sure = np.zeros_like(bits)
        for other in parents.bits[parents.month < month]:
            sure = sure | np.frombuffer(other, "u1")
        open_bits = np.flatnonzero(np.unpackbits(bits & ~sure, bitorder="little"))
        if len(open_bits):
            found.append(pd.DataFrame({"range": maps.range.iloc[0], "part": maps.part.iloc[0], "ref_table": table, "ref_field": field, "month": month, "bit": open_bits}))
    kinds = {"range": "int32", "part": "int32", "ref_table": object, "ref_field": object, "month": object, "bit": "int64"}
    return pd.concat(found)[list(kinds)].astype(kinds) if found else pd.DataFrame({c: pd.Series(dtype=k) for c, k in kinds.items()})
