"""Cutting lineage through the shared folder, so that a lost executor costs one re-read and not a recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marquetry.session import shared_folder


def materialise(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and return the written table.

    A written table is preferred to ``checkpoint()``, which computes its input twice. Empty input keeps its schema.
    What only leads to other written tables is deleted by ``discard``; the rest stays with the session's folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marquetry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing reads any more."""
    for t in tables:
        delete_folder(t.sparkSession, t._written_to)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whichever that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
