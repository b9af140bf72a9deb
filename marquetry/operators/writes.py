"""Write semantics of keyed tables, as the table that results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.operators.ranking import first_per


def upsert(old: DataFrame, new: DataFrame, key: str, stamp: str, keep_first: list[str], *tie: Column) -> DataFrame:
    """The latest row per key, with the smallest value ever seen of the ``keep_first`` columns; one aggregation, no join."""
    rows = old.unionByName(new, allowMissingColumns=True)
    others = [c for c in rows.columns if c != key]
    last = F.max_by(F.struct(*others), F.struct(F.col(stamp), *tie)).alias("__last")
    seen = rows.groupBy(key).agg(last, *[F.min(c).alias(f"__first_{c}") for c in keep_first])
    return seen.select(key, *[(F.col(f"__first_{c}") if c in keep_first else F.col(f"__last.{c}")).alias(c) for c in others])


def append_new(old: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """``old`` and the rows of ``new`` whose key is not in it; of new rows with one key the first in the order counts."""
    return old.unionByName(first_per(new, keys, *order).join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_partitions(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """The rows of ``new`` replace those of the partitions it has; an empty one replaces nothing."""
    return old.join(F.broadcast(new.select(part).distinct()), part, "left_anti").unionByName(new)  # a row per partition


def write_partitions(new: DataFrame, path: str, part: str) -> None:
    """The same on a stored table: only the partitions that occur are overwritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def merge_missing(loaded: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """Full outer merge by key in which the loaded row stands as a whole."""
    return loaded.unionByName(fetched.join(loaded.select(key), key, "left_anti"), allowMissingColumns=True)


def canonical_pairs(df: DataFrame, a: str, b: str, swapped: list[tuple[str, str]]) -> DataFrame:
    """Each pair in one order, the columns that belong to its ends swapped along."""
    turn = F.col(a) > F.col(b)
    out = {a: F.least(a, b), b: F.greatest(a, b)}
    for x, y in swapped:
        out |= {x: F.when(turn, F.col(y)).otherwise(F.col(x)), y: F.when(turn, F.col(x)).otherwise(F.col(y))}
    return df.withColumns(out)


def collapse_keys(rows: DataFrame, old: str, new: Column, first: str, last: str) -> DataFrame:
    """Rows under a new key: the keeper has the latest ``last``, then the larger old key; the earliest ``first`` stays."""
    keyed = rows.withColumn("new_id", new)
    g = keyed.groupBy("new_id").agg(F.max_by(old, F.struct(last, old)).alias("keeper"), F.min(first).alias(first), F.max(last).alias(last), F.count_distinct(old).alias("collapsed"))
    return g


def schema_difference(left: DataFrame, right: DataFrame) -> list[tuple[str, str]]:
    """(column, missing | extra | changed | misordered) of ``right`` against ``left``."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    out = [(c, "missing") for c in a if c not in b] + [(c, "extra") for c in b if c not in a] + [(c, "changed") for c in a if c in b and a[c] != b[c]]
    common = [c for c in left.columns if c in b]
    return out + [(c, "misordered") for c, d in zip(common, [c for c in right.columns if c in a]) if c != d]
