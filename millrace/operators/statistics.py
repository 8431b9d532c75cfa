"""Evaluation statistics: pooled and stratified ratios, clustered errors, paired tests, pass rates, quantiles."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.operators.hotjoin import hot_left_join
from millrace.operators.ranking import global_rank
from millrace.session import cut

Z = NormalDist().inv_cdf(0.975)


def pooled_ratio(top: Column, bottom: Column) -> Column:
    """Sum over sum; null for a zero or empty bottom."""
    return F.sum(top) / F.nullif(F.sum(bottom), F.lit(0.0))


def stratified_ratio(rows: DataFrame, stratum: str, top: str, bottom: str, weights: DataFrame, weight: str) -> DataFrame:
    """One row: the weighted mean of the strata's row means of ``top`` over that of ``bottom``."""
    means = rows.groupBy(stratum).agg((F.sum(top) / F.count("*")).alias("_t"), (F.sum(bottom) / F.count("*")).alias("_b"))
    joined = means.join(F.broadcast(weights.select(stratum, weight)), stratum)
    return joined.agg((F.sum(F.col(weight) * F.col("_t")) / F.nullif(F.sum(F.col(weight) * F.col("_b")), F.lit(0.0))).alias("ratio"))


def clustered_ratio(rows: DataFrame, by: list[str], cluster: str, top: str, bottom: str) -> DataFrame:
    """By group: ratio, and its standard error by the delta method over cluster sums of the residuals.

    The groups' ratios are joined back by broadcast only as adaptive execution finds them small; a group of one
    cluster has no error (null).
    """
    ratio = rows.groupBy(*by).agg(F.sum(top).alias("_t"), F.sum(bottom).alias("_b")).withColumn("ratio", F.col("_t") / F.nullif(F.col("_b"), F.lit(0.0)))
    sums = rows.groupBy(*by, cluster).agg(F.sum(top).alias("_ct"), F.sum(bottom).alias("_cb"))
    residual = sums.join(ratio, by).withColumn("_r", F.col("_ct") - F.col("ratio") * F.col("_cb"))
    spread = residual.groupBy(*by).agg(F.first("ratio").alias("ratio"), F.first("_b").alias("_b"), F.count("*").alias("clusters"), F.var_samp("_r").alias("_v"))
    return spread.select(*by, "ratio", "clusters", (F.sqrt(F.col("clusters") * F.col("_v")) / F.col("_b")).alias("se"))


def mean_with_error(rows: DataFrame, by: list[str], value: str, cluster: str | None = None) -> DataFrame:
    """By group: n, mean, standard error (of cluster sums of residuals if clustered) and 95 % normal bounds."""
    if cluster is None:
        base = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))
    else:
        keys, by = by, by or ["_all"]
        rows = rows if keys else rows.withColumn("_all", F.lit(0))
        parts = rows.groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_k"))
        means = parts.groupBy(*by).agg((F.sum("_s") / F.sum("_k")).alias("mean"), F.sum("_k").alias("n"))
        joined = parts.join(means, by)
        base = joined.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), (F.sqrt(F.sum(F.pow(F.col("_s") - F.col("_k") * F.col("mean"), 2))) / F.first("n")).alias("se")).drop("_all")
    return base.withColumns({"low": F.col("mean") - Z * F.col("se"), "high": F.col("mean") + Z * F.col("se")})


def wilson(passed: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % Wilson interval of passed out of n."""
    p = passed / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return middle - half, middle + half


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """The unbiased chance that one of k samples passes, of n with c passing; 1 if fewer than k fail."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * (n - c - i) / (n - i))
    return F.when(n - c < k, F.lit(1.0)).otherwise(1 - miss)


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r; null if a side does not vary."""
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def average_ranks(rows: DataFrame, value: str, name: str, row_id: str) -> DataFrame:
    """rows plus ``name``: the 1-based rank of ``value``, ties sharing the mean of theirs; null for a null value.

    Distinct values are counted and ranked, and their ranks joined back; a value may hold any share of the rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    ranked = global_rank(counts, [value], weight="_n", rank="_k", running="_upto")
    keyed = ranked.select(value, "_n", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name))
    return hot_left_join(rows, keyed, value, row_id, "_n", rows.count())


def spearman(rows: DataFrame, a: str, b: str, row_id: str) -> DataFrame:
    """One row: rho, the correlation of average ranks over rows with both values; null if a side does not vary."""
    known = cut(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(row_id, a, b))
    ranked = average_ranks(average_ranks(known, a, "_a", row_id), b, "_b", row_id)
    return ranked.agg(correlation(F.col("_a"), F.col("_b")).alias("rho"))


def holm(p: str, by: list[str]) -> Column:
    """Step-down adjusted p-values within ``by``; over all rows (of a report) without."""
    by = by or [F.lit(1)]
    order = Window.partitionBy(*by).orderBy(p)
    m = F.count(p).over(Window.partitionBy(*by))
    return F.least(F.lit(1.0), F.max((m - F.row_number().over(order) + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(a: pd.Series, b: pd.Series) -> pd.Series:
    """Two-sided exact binomial p of the discordant counts; 1 without any. Terms are summed as logarithms of binomials."""
    def one(x: int, y: int) -> float:
        n, low = x + y, min(x, y)
        i = np.arange(1, low + 1, dtype=float)
        terms = np.concatenate([[0.0], np.cumsum(np.log(n + 1 - i) - np.log(i))]) - n * math.log(2)
        top = terms.max()
        return min(1.0, 2 * math.exp(top) * float(np.exp(terms - top).sum())) if n else 1.0
    return pd.Series([one(int(x), int(y)) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """The chance of a standard normal at least as far from 0 as z; null stays null."""
    return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)), na_action="ignore")


#: What a difference must be, in standard errors, to be found with 80 % power at 5 %.
DETECTABLE = Z + NormalDist().inv_cdf(0.8)


def compare(samples: DataFrame, by: list[str], problem: str, side: str, passed: str, cluster: str | None = None) -> DataFrame:
    """Paired comparison of two sides, ``a`` and ``b``, over identical problems, a row for each value of ``by``:

    n, the sides' mean pass rates (samples of a problem averaged first), diff = b - a with its standard error (clustered
    if asked) and 95 % interval, the correlation of the rates (null if one is constant), the test and its p (exact
    McNemar if every problem has one sample on both sides, else the normal test), p adjusted over all rows, and the
    difference that would be detected. A problem that a side lacks is an error at run time.
    """
    is_a, is_b = F.col(side) == "a", F.col(side) == "b"
    value = F.col(passed).cast("double")
    per = samples.groupBy(*by, problem, *([cluster] if cluster else [])).agg(F.avg(F.when(is_a, value)).alias("_a"), F.avg(F.when(is_b, value)).alias("_b"), F.greatest(F.count_if(is_a), F.count_if(is_b)).alias("_k"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    per = per.withColumn("_d", F.when(both, F.col("_b") - F.col("_a")).otherwise(F.raise_error(F.lit("a problem on one side only")).cast("double")))
    error = mean_with_error(per, by, "_d", cluster)
    sides = per.groupBy(*by).agg(F.avg("_a").alias("a"), F.avg("_b").alias("b"), correlation(F.col("_a"), F.col("_b")).alias("corr"), F.max("_k").alias("_most"), F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).alias("_only_a"), F.count_if((F.col("_b") == 1) & (F.col("_a") == 0)).alias("_only_b"))
    joined = error.join(sides, by)
    exact = F.col("_most") == 1
    z = F.col("mean") / F.nullif(F.col("se"), F.lit(0.0))
    normal = F.coalesce(normal_two_sided(z), F.when(F.col("mean") == 0, 1.0).otherwise(0.0))
    tested = joined.withColumns({"test": F.when(exact, "mcnemar").otherwise("normal"), "p": F.when(exact, mcnemar_exact("_only_a", "_only_b")).otherwise(normal)})
    return tested.select(*by, "n", "a", "b", F.col("mean").alias("diff"), "se", "low", "high", "corr", "test", "p", holm("p", []).alias("p_holm"), (F.lit(DETECTABLE) * F.col("se")).alias("mde"))


def parabola(x: Column, y: Column) -> dict[str, Column]:
    """Sums of the normal equations of a least-squares parabola."""
    return {"n": F.count(x)} | {f"x{k}": F.sum(F.pow(x, k)) for k in range(1, 5)} | {f"y{k}": F.sum(y * F.pow(x, k)) for k in range(0, 3)}


def parabola_coefficients(frame: DataFrame) -> DataFrame:
    """frame (of ``parabola`` sums) plus a, b, c of a x^2 + b x + c, and the vertex; null for a singular system."""
    n, x1, x2, x3, x4, y0, y1, y2 = (F.col(k) for k in ("n", "x1", "x2", "x3", "x4", "y0", "y1", "y2"))
    det = n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2)
    c = y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)
    b = n * (y1 * x4 - y2 * x3) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)
    a = n * (x2 * y2 - x3 * y1) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)
    safe = F.nullif(det, F.lit(0.0))
    return frame.withColumns({"a": a / safe, "b": b / safe, "c": c / safe}).withColumn("vertex", -F.col("b") / F.nullif(2 * F.col("a"), F.lit(0.0)))
