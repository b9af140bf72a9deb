"""Ranks, latest rows and best matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquetry.operators.lineage import materialise


def number_rows(df: DataFrame, *order: Column, name: str = "row") -> DataFrame:
    """The rows, written once, with ``name``: 1..n in the given order over the whole table; the order must be a total one for the numbers to be settled.

    Range partitions by a sample's quantiles, each sorted by itself, and the counts of those before: no task holds more than its range, and equal first
    columns are split by the later ones. The counts are a row per partition.
    """
    slices = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    written = materialise(slices.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = written.groupBy(part.alias("__part")).agg((F.max(place) + 1).alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    return written.withColumn("__part", part).join(before, "__part").withColumn(name, F.col("__before") + place + 1).drop("__part", "__before", "__id")


def rank_all(df: DataFrame, group: str, score: str, tiebreak: str) -> DataFrame:
    """Add ``rank``, 1..n within ``group`` by score descending, then ``tiebreak``; rows with a null or NaN score are left out, a null group is one.

    All rows are numbered by group, score and tiebreak, and a row's rank is its number less that of its group's first: a group of any size, or any number of equal
    scores, is ranked in parallel.
    """
    good = df.where(F.col(score).isNotNull() & ~F.isnan(score))
    numbered = number_rows(good, F.col(group).asc(), F.desc(score), F.col(tiebreak).asc(), name="__row")
    first = numbered.groupBy(group).agg(F.min("__row").alias("__first"))
    first = first.select(F.col(group).alias("__group"), "__first")
    return numbered.join(first, F.col(group).eqNullSafe(F.col("__group"))).withColumn("rank", (F.col("__row") - F.col("__first") + 1).cast("int")).drop("__row", "__first", "__group")


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, by a group limit that prunes before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key, numbered by ``position``."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("position") <= n)


def top_with_hidden(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """As ``top_per``, with the number of rows that are not shown. The count is an aggregate of its own, so no group is gathered."""
    hidden = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("hidden"))
    return top_per(df, keys, n, *order).join(hidden, keys)


def latest(df: DataFrame, by: str) -> DataFrame:
    """The rows with the largest value of ``by``."""
    top = df.agg(F.max(by).alias("__top"))
    return df.join(F.broadcast(top), F.col(by) == F.col("__top")).drop("__top")  # one row


def carry_forward(df: DataFrame, part: str, order: str, heading: Column, name: str) -> DataFrame:
    """Add ``name``: the last non-null heading up to each row of its part."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def rollovers(df: DataFrame, part: str, order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: how often ``value`` fell below its predecessor so far, as a page's dates do at the turn of a year."""
    w = Window.partitionBy(part).orderBy(order)
    fell = F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0)
    return df.withColumn("__fell", fell).withColumn(name, F.sum("__fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__fell")


def nearest_year(day_month: Column, month: Column, weekday: Column, today: Column, past_days: int = 30) -> Column:
    """The date with this day, month and weekday (0 is Monday) in the year nearest to today that isn't over ``past_days`` past."""
    options = F.array(*[F.try_to_date(F.concat_ws("-", F.year(today) + k, F.lpad(month.cast("string"), 2, "0"), F.lpad(day_month.cast("string"), 2, "0"))) for k in (0, 1, -1)])
    fits = F.filter(options, lambda d: d.isNotNull() & (F.weekday(d) == weekday) & (F.datediff(today, d) <= past_days))
    return F.array_min(F.transform(fits, lambda d: F.struct(F.abs(F.datediff(d, today)).alias("gap"), d.alias("day"))))["day"]
