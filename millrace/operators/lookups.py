"""Joins that are more than an equality: as-of, intervals, k-th occurrence, path suffixes, checked pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.ranking import carried, grouped_rank


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left plus the ``value`` of the last right row of the same ``by`` at or before ``at``; null without one.

    No range join: both sides are stacked, and the last non-null value is carried on over range partitions, so a key may
    hold any share of the rows. Of right rows at one instant the greatest value counts; null values are not carried.
    """
    whole = left.select(F.struct("*").alias("_left")).schema["_left"].dataType
    steps = right.groupBy(by, at).agg(F.max(value).alias("_value")).select(by, at, F.lit(0).alias("_side"), "_value", F.lit(None).cast(whole).alias("_left"))
    asked = left.select(by, at, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct("*").alias("_left"))
    found = carried(steps.unionByName(asked), [by], [at, "_side"], "_value", "_found", previous=False)
    return found.where("_left is not null").select("_left.*", F.col("_found").alias(value))


def in_interval(points: DataFrame, point: str, intervals: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """points joined to the intervals that hold them, ends included, by equality on buckets of ``width``.

    Every interval is listed under each bucket it touches, so choose the width near the intervals' length. Numbers only.
    """
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    spread = intervals.where(F.col(low) <= F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    joined = points.withColumn("_bucket", bucket(F.col(point))).join(spread, "_bucket")
    return joined.where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop("_bucket")


def exactly_one(joined: DataFrame, key: str) -> DataFrame:
    """joined, or an error at run time if a key stands there more than once."""
    n = F.count("*").over(Window.partitionBy(key))
    checked = joined.withColumn("_n", n)
    return checked.withColumn("_ok", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("not exactly one interval")).cast("boolean"))).where("_ok").drop("_n", "_ok")


def kth_occurrence(left: DataFrame, right: DataFrame, key: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """The first left row of a key with the first right row, the second with the second, and so on. A key may hold any share
    of the rows: occurrences are numbered over range partitions, and (key, occurrence) is unique."""
    a = grouped_rank(left, key, left_order, rank="_k")
    b = grouped_rank(right, key, right_order, rank="_k")
    return a.join(b, [*key, "_k"]).drop("_k")


def suffixes(path: Column) -> Column:
    """The path and every tail of it that starts after a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def resolve_suffix(requests: DataFrame, files: DataFrame, by: str, wanted: str, path: str) -> DataFrame:
    """requests joined to the files of the same ``by`` whose path is ``wanted`` or ends with a slash and it."""
    listed = files.withColumn("_suffix", F.explode(suffixes(F.col(path)))).withColumnRenamed(by, "_by")
    return requests.join(listed, (F.col(by) == F.col("_by")) & (F.col(wanted) == F.col("_suffix"))).drop("_by", "_suffix")
