"""Row numbers, running sums and quantiles over whole tables or groups of any size, without pulling one into one task.

A window holds a whole group in one task, and one without groups the whole table. Here rows are range-partitioned by group
and order, so that a group may lie in many partitions; every partition numbers its rows in one pass, and what the group of
its first row had before comes from the ends of the partitions: one small row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import cut


def _changes(columns: list[pa.Array], n: int, last: list | None) -> np.ndarray:
    """Whether each of n rows has another key than the row before it; ``last`` is the key before the first row. Without
    one the first row begins nothing yet."""
    changed = np.zeros(n, dtype=bool)
    for column, before in zip(columns, last if last is not None else [None] * len(columns)):
        here, there = column.slice(1), column.slice(0, n - 1)
        same = pc.if_else(pc.or_(pc.is_null(here), pc.is_null(there)), pc.and_(pc.is_null(here), pc.is_null(there)), pc.fill_null(pc.equal(here, there), False))
        changed[1:] |= ~same.to_numpy(zero_copy_only=False).astype(bool)
        changed[0] |= last is not None and column[0].as_py() != before
    return changed


def grouped_rank(frame: DataFrame, by: list[str], order: list[str], rank: str = "rank", weight: str | None = None, running: str = "running", parts: int | None = None) -> DataFrame:
    """frame plus ``rank``, 1-based inside its group in the order of ``order``, and with ``weight`` the running sum up to the row.

    ``order`` must be total for a unique result; equal rows get consecutive ranks. Nulls come first and are a group of
    their own; a null weight counts as 0. ``by`` may be empty. The numbered partitions are cut in the checkpoint folder,
    since their bounds must not be drawn anew when the offsets are added. Column names starting with ``_r_`` are taken.
    """
    spark = frame.sparkSession
    if weight:
        frame = frame.withColumn("_r_w", F.coalesce(F.col(weight), F.lit(0)))
        kind = frame.schema["_r_w"].dataType
        frame = frame.withColumn("_r_w", F.col("_r_w").cast("double" if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)) else "long"))
    else:
        frame = frame.withColumn("_r_w", F.lit(0).cast("long"))
    keys = [*by, *order]
    ranged = frame.repartitionByRange(parts, *keys) if parts else frame.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn("_r_part", F.spark_partition_id())
    names = ranged.columns
    at = [names.index(c) for c in by]
    number = "double" if isinstance(frame.schema["_r_w"].dataType, T.DoubleType) else "long"
    schema = T.StructType([*ranged.schema.fields, T.StructField("_r_row", T.LongType()), T.StructField("_r_n", T.LongType()), T.StructField("_r_sum", T.DoubleType() if number == "double" else T.LongType()), T.StructField("_r_first", T.BooleanType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, total, first, row = None, 0, 0, True, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes([batch.column(i) for i in at], n, last)
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, place, -1))
            weights = batch.column(names.index("_r_w")).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(weights)])
            within = np.where(begin >= 0, place - begin + 1, place + 1 + count)
            run = np.where(begin >= 0, sums[1:] - sums[np.maximum(begin, 0)], sums[1:] + total)
            leading = first & (begin < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row + place, pa.int64()), pa.array(within, pa.int64()), pa.array(run, pa.float64() if number == "double" else pa.int64()), pa.array(leading, pa.bool_())], [f.name for f in schema.fields])
            last, count, total, first, row = [batch.column(i)[n - 1].as_py() for i in at], int(within[-1]), run[-1], bool(leading[-1]), row + n

    done = cut(ranged.mapInArrow(numbered, schema))
    ends = F.struct("_r_n", "_r_sum", "_r_first", *[F.col(c).alias(f"k{i}") for i, c in enumerate(by)])
    heads = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(by)], F.lit(0).alias("k"))
    # one row a partition
    rows = sorted(done.groupBy("_r_part").agg(F.max_by(ends, "_r_row").alias("end"), F.min_by(heads, "_r_row").alias("head")).collect(), key=lambda r: r["_r_part"])
    carried, key, n, total = [], None, 0, 0
    for r in rows:
        head, tail = [r.head[f"k{i}"] for i in range(len(by))], [r.end[f"k{i}"] for i in range(len(by))]
        if key != head:
            n = total = 0
        carried.append((r["_r_part"], n, total))
        alone = r.end["_r_first"]
        n, total, key = (n if alone else 0) + r.end["_r_n"], (total if alone else 0) + r.end["_r_sum"], tail
    offsets = spark.createDataFrame(carried, f"_r_part int, _r_before long, _r_total {number}")
    out = done.join(F.broadcast(offsets), "_r_part").withColumn(rank, F.col("_r_n") + F.when(F.col("_r_first"), F.col("_r_before")).otherwise(0))
    if weight:
        out = out.withColumn(running, F.col("_r_sum") + F.when(F.col("_r_first"), F.col("_r_total")).otherwise(0))
    return out.drop("_r_part", "_r_before", "_r_total", "_r_row", "_r_n", "_r_sum", "_r_first", "_r_w")


def carried(frame: DataFrame, by: list[str], order: list[str], value: str, name: str, previous: bool = True, parts: int | None = None) -> DataFrame:
    """frame plus ``name``: the ``value`` of the row before in the group's order, or, with ``previous`` false, the last value
    up to the row that is not null; null where there is none.

    Like ``grouped_rank``: a group may lie in many partitions. What a partition cannot know, because its first group began
    before it, comes from the ends of the partitions before. Column names starting with ``_r_`` are taken.
    """
    spark, keys = frame.sparkSession, [*by, *order]
    ranged = frame.withColumn("_r_v", F.col(value))
    ranged = ranged.repartitionByRange(parts, *keys) if parts else ranged.repartitionByRange(*keys)
    ranged = ranged.sortWithinPartitions(*keys).withColumn("_r_part", F.spark_partition_id())
    names, kind = ranged.columns, ranged.schema["_r_v"].dataType
    at, values = [names.index(c) for c in by], names.index("_r_v")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_r_row", T.LongType()), T.StructField("_r_out", kind), T.StructField("_r_open", T.BooleanType()), T.StructField("_r_end", kind), T.StructField("_r_end_open", T.BooleanType())])

    def pass_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, unknown, row = None, None, True, 0  # the key before, what it passes on, whether that is not known here
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new, place, column = _changes([batch.column(i) for i in at], n, last), np.arange(n), batch.column(values)
            begin = np.maximum.accumulate(np.where(new, place, -1))
            source = place if previous else np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), place, -1))
            ends = np.where(source >= np.maximum(begin, 0), source, np.where(begin >= 0, -2, -1))  # -1: from before, -2: nothing
            got = np.concatenate([[-1], ends[:-1]]) if previous else ends
            got = np.where(previous & new, -2, got)
            pool = pa.concat_arrays([pa.array([held], column.type), column])
            out = pool.take(pa.array(np.where(got == -2, 0, got + 1), mask=got == -2))
            end = pool.take(pa.array(np.where(ends == -2, 0, ends + 1), mask=ends == -2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(row + place, pa.int64()), out, pa.array((got == -1) & unknown), end, pa.array((ends == -1) & unknown)], [f.name for f in schema.fields])
            unknown = bool(unknown and ends[-1] == -1)
            last, held, row = [batch.column(i)[n - 1].as_py() for i in at], end[n - 1].as_py(), row + n

    done = cut(ranged.mapInArrow(pass_on, schema))
    key = [F.col(c).alias(f"k{i}") for i, c in enumerate(by)]
    # one row a partition
    rows = sorted(done.groupBy("_r_part").agg(F.max_by(F.struct(*key, "_r_end", "_r_end_open"), "_r_row").alias("end"), F.min_by(F.struct(*key, F.lit(0).alias("k")), "_r_row").alias("head")).collect(), key=lambda r: r["_r_part"])
    found, before, now = [], None, None
    for r in rows:
        if before != [r.head[f"k{i}"] for i in range(len(by))]:
            now = None
        found.append((r["_r_part"], now))
        now = now if r.end["_r_end_open"] else r.end["_r_end"]
        before = [r.end[f"k{i}"] for i in range(len(by))]
    table = spark.createDataFrame(found, T.StructType([T.StructField("_r_part", T.IntegerType()), T.StructField("_r_in", kind)]))
    out = done.join(F.broadcast(table), "_r_part").withColumn(name, F.when(F.col("_r_open"), F.col("_r_in")).otherwise(F.col("_r_out")))
    return out.drop("_r_part", "_r_v", "_r_row", "_r_out", "_r_open", "_r_end", "_r_end_open", "_r_in")


def global_rank(frame: DataFrame, order: list[str], parts: int | None = None, rank: str = "rank", weight: str | None = None, running: str = "running") -> DataFrame:
    """``grouped_rank`` over the whole table."""
    return grouped_rank(frame, [], order, rank, weight, running, parts)


def ntile_of(rank: Column, total: Column, tiles: int) -> Column:
    """The 0-based tile of a 1-based rank: the first ``total % tiles`` tiles hold one row more."""
    size, extra = F.floor(total / tiles), total % tiles
    long = (size + 1) * extra
    return F.when(rank <= long, F.floor((rank - 1) / (size + 1))).otherwise(extra + F.floor((rank - 1 - long) / F.greatest(size, F.lit(1)))).cast("long")


def quantiles(frame: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(*by, each name of ``shares``): exact quantiles of the non-null values of each group, linear between neighbours.

    No group's values meet in one buffer: values are ranked, and of each group the at most two rows a quantile lies between
    are picked. Groups without values are left out.
    """
    known = frame.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_q_v"))
    keys = by or ["_q_all"]
    known = known if by else known.withColumn("_q_all", F.lit(0))
    ranked = grouped_rank(known, keys, ["_q_v"], rank="_q_k")
    sizes = ranked.groupBy(*keys).agg(F.max("_q_k").alias("_q_n"))
    at = {name: 1 + (F.col("_q_n") - 1) * F.lit(float(share)) for name, share in shares.items()}
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a), F.ceil(a)) for a in at.values()])))
    places = sizes.select(*[F.col(k).alias(f"_q_{i}") for i, k in enumerate(keys)], "_q_n", F.explode(wanted).alias("_q_at"))
    matching = (F.col("_q_k") == F.col("_q_at"))
    for i, k in enumerate(keys):
        matching = matching & F.col(k).eqNullSafe(F.col(f"_q_{i}"))
    # (group, rank) is nearly unique, so the join has no hot key
    picked = ranked.join(places, matching).groupBy(*keys).agg(F.first("_q_n").alias("_q_n"), F.map_from_entries(F.collect_set(F.struct("_q_at", "_q_v"))).alias("_q_m"))
    low, high = lambda a: F.element_at("_q_m", F.floor(a)), lambda a: F.element_at("_q_m", F.ceil(a))
    return picked.select(*by, *[(low(a) + (high(a) - low(a)) * (a - F.floor(a))).alias(name) for name, a in at.items()])
