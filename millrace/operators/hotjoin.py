"""Left join on a skewed key: keys too frequent for one task go through a broadcast whose size is bounded by proof."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least one row in HOT: so at most HOT keys can be hot, however large the table is.
HOT = 1000


def hot_left_join(rows: DataFrame, keyed: DataFrame, key: str, row_id: str, weight: str, total: int) -> DataFrame:
    """``rows`` left-joined to ``keyed`` (one row per key) on ``key``, which may be null or hold any share of the rows.

    ``weight`` is the column of ``keyed`` with the number of rows of its key, ``total`` their sum. Hot keys (at most
    ``HOT`` of them) are joined by broadcast; the rest by shuffle, where rows of hot and null keys are spread by
    ``row_id`` instead of meeting in one task. Null keys match nothing.
    """
    columns = [c for c in keyed.columns if c not in (key, weight)]
    hot = keyed.where(F.col(weight) * HOT >= F.lit(total)).select(F.col(key).alias("_hot"), F.struct(*columns).alias("_h"))
    cold = keyed.where(F.col(weight) * HOT < F.lit(total)).select(F.concat(F.lit("k"), F.col(key).cast("string")).alias("_cold"), F.struct(*columns).alias("_c"))
    first = rows.join(F.broadcast(hot), rows[key] == F.col("_hot"), "left")
    spread = F.concat(F.lit("r"), F.col(row_id).cast("string"))
    first = first.withColumn("_cold_key", F.when(F.col("_hot").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string"))).otherwise(spread))
    joined = first.join(cold, F.col("_cold_key") == F.col("_cold"), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c) for c in columns])
