"""Deterministic samples, quotas and permutations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.hashing import draw
from millrace.operators.ranking import global_rank, grouped_rank


def systematic(frame: DataFrame, order: list[str], fraction: float) -> DataFrame:
    """Row i (0-based in the global order) iff floor((i + 1) f) > floor(i f)."""
    i = F.col("rank") - 1
    return global_rank(frame, order).where(F.floor((i + 1) * F.lit(fraction)) > F.floor(i * F.lit(fraction))).drop("rank")


def choose(frame: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, by seeded hash order: a top-n, merged from each partition's own."""
    return frame.orderBy(draw(F.col(ident), seed), ident).limit(n)


def quotas(sizes: DataFrame, stratum: str, size: str, total: int) -> DataFrame:
    """(stratum, quota): shares of ``total`` in proportion to size, by largest remainder; equal remainders go by stratum.

    The strata are few: the windows run over them alone.
    """
    everything = Window.partitionBy(F.lit(1))
    exact = F.lit(total) * F.col(size) / F.sum(size).over(everything)
    base = sizes.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    rest = base.withColumn("_left", F.lit(total) - F.sum("_floor").over(everything)).withColumn("_n", F.row_number().over(everything.orderBy(F.round(F.col("_exact") - F.col("_floor"), 9).desc(), stratum)))
    return rest.select(stratum, (F.col("_floor") + F.when(F.col("_n") <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def stratified(frame: DataFrame, stratum: str, ident: str, total: int, seed: int) -> DataFrame:
    """``total`` rows with largest-remainder quotas by stratum, drawn in hash order; a stratum may hold any share of the rows."""
    quota = quotas(frame.groupBy(stratum).agg(F.count("*").alias("n")), stratum, "n", total).withColumnRenamed(stratum, "_stratum")
    ranked = grouped_rank(frame.withColumn("_draw", draw(F.col(ident), seed)), [stratum], ["_draw", ident], rank="_k")
    chosen = ranked.where(F.col("_k") <= total)  # no quota is larger
    return chosen.join(quota, F.col(stratum).eqNullSafe(F.col("_stratum"))).where(F.col("_k") <= F.col("quota")).drop("_k", "_draw", "quota", "_stratum")


def permutations(frame: DataFrame, ident: str, epochs: int, seed: int) -> DataFrame:
    """Every row once an epoch, in an order drawn anew: (epoch, position, ident), positions counted inside the epoch."""
    many = frame.select(ident).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    keyed = many.withColumn("_key", F.sha1(F.concat_ws(":", (F.col("epoch") + seed).cast("string"), F.col(ident).cast("string"))))
    return grouped_rank(keyed, ["epoch"], ["_key", ident]).select("epoch", (F.col("rank") - 1).alias("position"), ident)


def prefix_need(frame: DataFrame, by: list[str], order: list[str], size: str, need: float) -> DataFrame:
    """The rows of each group, in ``order``, up to the one with which their sizes reach ``need``."""
    ranked = grouped_rank(frame, by, order, weight=size, rank="_k", running="_sum")
    return ranked.where(F.col("_sum") - F.coalesce(F.col(size), F.lit(0)) < F.lit(need)).drop("_k", "_sum")


def dealt_longest_first(frame: DataFrame, ident: str, size: str, slots: int) -> DataFrame:
    """frame plus (``turn``, ``slot``): rows by size, the longest first, dealt to the slots there and back, so that no slot
    ends late. Null sizes come last."""
    ranked = global_rank(frame.withColumn("_down", -F.coalesce(F.col(size), F.lit(-1))), ["_down", ident], rank="_k")
    turn, place = F.floor((F.col("_k") - 1) / slots), (F.col("_k") - 1) % slots
    return ranked.withColumns({"turn": turn, "slot": F.when(turn % 2 == 0, place).otherwise(slots - 1 - place)}).drop("_k", "_down")


def nearest_distinct(frame: DataFrame, ident: str, value: str, targets: list[float]) -> list[tuple[float, object]]:
    """(target, ident): for each target in turn the row nearest to it of those not chosen yet, the least ident of equals.

    As many rows as there are targets can be taken before, so the driver looks at that many of the nearest to each.
    """
    chosen: list[tuple[float, object]] = []
    for target in targets:
        off = F.abs(F.col(value) - F.lit(float(target)))
        near = frame.where(F.col(value).isNotNull()).orderBy(off, ident).select(ident).limit(len(targets)).collect()
        free = [r[0] for r in near if r[0] not in {i for _, i in chosen}]
        if free:
            chosen.append((float(target), free[0]))
    return chosen


GOLDEN = 0.6180339887498949


def weyl_choice(index: Column, bounds: list[float], scale: float = 1.0) -> Column:
    """The interval, by its number, that the point frac((index + 1) GOLDEN) times ``scale`` falls into; a bound belongs to the
    next one."""
    point = ((index + 1) * F.lit(GOLDEN) - F.floor((index + 1) * F.lit(GOLDEN))) * F.lit(scale)
    return sum((F.when(F.lit(b) <= point, 1).otherwise(0) for b in bounds), F.lit(0))
