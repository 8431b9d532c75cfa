"""Exact search over vectors: blocks of queries against blocks of rows, the best of each pair of blocks, then of all."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block: bounds what a task holds at once.
BLOCK = 2048


def _blocks(rows: DataFrame, ident: str, vector: str, side: str) -> DataFrame:
    parts = max(1, -(-rows.count() // BLOCK))
    block = F.pmod(F.xxhash64(ident), F.lit(parts))
    return rows.groupBy(block.alias("_b")).agg(F.collect_list(F.struct(F.col(ident).alias("i"), F.col(vector).alias("v"))).alias(side)).select(F.col(f"{side}.i").alias(f"{side}_i"), F.col(f"{side}.v").alias(f"{side}_v"))


def nearest(rows: DataFrame, wanted: Column, ident: str, vector: str, k: int) -> DataFrame:
    """(query, ident, score): for each row that is ``wanted`` the ``k`` rows of highest inner product, rounded to four
    places, equal ones by ``ident``. Null vectors are left out; no query gives an empty result."""
    known = rows.where(F.col(vector).isNotNull()).select(ident, vector)

    def best(batches):
        for batch in batches:
            for qi, qv, ri, rv in zip(batch["q_i"], batch["q_v"], batch["r_i"], batch["r_v"]):
                score = np.stack(qv).astype(float) @ np.stack(rv).astype(float).T
                # what rounding can still lift into the best k lies within one step of the k-th
                low = np.partition(score, -k, axis=1)[:, -k] - 1e-4 if score.shape[1] > k else np.full(len(score), -np.inf)
                a, b = np.nonzero(score >= low[:, None])
                yield pd.DataFrame({"query": np.asarray(qi)[a], ident: np.asarray(ri)[b], "score": score[a, b]})

    kind = rows.schema[ident].dataType.simpleString()
    pairs = _blocks(known.where(wanted), ident, vector, "q").crossJoin(_blocks(known, ident, vector, "r"))
    found = pairs.repartition(rows.sparkSession.sparkContext.defaultParallelism).mapInPandas(best, f"query {kind}, {ident} {kind}, score double").withColumn("score", F.round("score", 4))
    order = Window.partitionBy("query").orderBy(F.desc("score"), ident)
    return found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k).drop("_k")
