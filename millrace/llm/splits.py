"""Splits that keep related records together: components first, then a component swap search for the shares.

Groups are the connected components of repositories under their links, or the records of one problem. Whole components
are placed: a hashed start in the target shares, then annealing by moves and swaps of components that lowers the
deviation of sizes and of label counts from the targets. Components holding at least one record in a thousand (at most
a thousand of them) are searched together and brought to the target shares among themselves; all others in hashed
blocks, in parallel, each against its own part of what the heavy ones left of the targets over all records. Every block
runs several chains and keeps the best state any of them met.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import repository_key
from millrace.operators.components import connected_components
from millrace.operators.hotjoin import HOT, hot_left_join
from millrace.session import cut

#: More distinct labels than this are no categories.
LABELS = 256
BLOCK = 2000


def anneal(keys: list[str], sizes: np.ndarray, labels: np.ndarray, names: list[str], wanted: np.ndarray, chains: int = 3, steps: int = 8, seed: int = 17) -> tuple[list[int], float]:
    """Place components (``sizes``, ``labels`` counts by row) into splits whose wanted record counts are ``wanted``.

    Returns the best placement met and its cost: the squared deviations of split sizes from ``wanted``, plus those of
    each label's counts from the split's share of the label, as fractions of all records.
    """
    n, m = len(keys), len(names)
    total = float(max(1, sizes.sum()))
    share = np.maximum(wanted, 0) / max(1e-9, np.maximum(wanted, 0).sum())
    bounds = np.cumsum(share)
    used = [j for j in range(labels.shape[1]) if labels[:, j].any()]
    weights = [[(0, float(sizes[i]))] + [(1 + t, float(labels[i, j])) for t, j in enumerate(used) if labels[i, j]] for i in range(n)]
    goal = [[float(wanted[k])] + [float(share[k] * labels[:, j].sum()) for j in used] for k in range(m)]
    best: tuple[list[int], float] = ([0] * n, math.inf)
    for chain in range(chains):
        rng = np.random.default_rng([seed, chain, n])
        draws = [(zlib.crc32(f"{seed}:{chain}:{k}".encode()) + 0.5) / 2**32 for k in keys]
        state = [min(m - 1, int(np.searchsorted(bounds, d, side="right"))) for d in draws]
        off = [[-g for g in row] for row in goal]
        for i, k in enumerate(state):
            for d, w in weights[i]:
                off[k][d] += w
        cost = sum(x * x for row in off for x in row)
        least, since = cost, []  # the best cost so far, and the moves since
        count = steps * n if m > 1 and n else 0
        picks, others = rng.integers(0, max(1, n), (2, max(1, count)))
        coins, accept, targets = rng.random(count), rng.random(count), rng.integers(0, max(1, m), max(1, count))
        heat = cost / max(1, n) if n else 0.0
        for t in range(count):
            i, j = int(picks[t]), int(others[t])
            a = state[i]
            if coins[t] < 0.5:
                b, second = int(targets[t]), ()
            else:
                b, second = state[j], weights[j]
            if a == b:
                continue
            delta, va, vb = 0.0, off[a], off[b]
            change: dict[int, float] = {}
            for d, w in weights[i]:
                change[d] = w
            for d, w in second:
                change[d] = change.get(d, 0.0) - w
            for d, w in change.items():
                delta += 2 * w * (vb[d] - va[d]) + 2 * w * w
            if delta <= 0 or (heat > 0 and accept[t] < math.exp(-delta / heat)):
                for d, w in change.items():
                    va[d] -= w
                    vb[d] += w
                since.append((i, a))
                state[i] = b
                if second:
                    since.append((j, b))
                    state[j] = a
                cost += delta
                if cost < least - 1e-9:
                    least, since = cost, []
            heat *= 1 - 6.0 / count
        for i, a in reversed(since):  # back to the best state met
            state[i] = a
        if least < best[1]:
            best = (state, least)
    return best[0], best[1] / total**2


def records_of(repository_files: DataFrame, code_functions: DataFrame, raw_traces: DataFrame) -> DataFrame:
    """(record_table, record_id, row_key, key, recorded, label) of all records; a null repository or problem gives a null key."""
    def part(frame: DataFrame, name: str, ident: str, key) -> DataFrame:
        return frame.select(F.lit(name).alias("record_table"), F.col(ident).alias("record_id"), key.alias("key"), F.col("split_name").alias("recorded"), F.col("lang").alias("label"))

    repo = F.concat(F.lit("r:"), repository_key(F.col("repo_name")))
    parts = part(repository_files, "repository_files", "file_id", repo).unionByName(part(code_functions, "code_functions", "function_id", repo)).unionByName(part(raw_traces, "raw_traces", "trace_id", F.concat(F.lit("p:"), F.col("problem_id"))))
    return parts.withColumn("row_key", F.concat_ws("/", "record_table", "record_id"))


def labels_of(records: DataFrame) -> list[str]:
    """The distinct labels, a small set of categories; more than LABELS raise."""
    found = sorted(r.label for r in records.select("label").where("label is not null").distinct().limit(LABELS + 1).collect())
    if len(found) > LABELS:
        raise ValueError(f"more than {LABELS} distinct labels")
    return found


def component_table(records: DataFrame, links: DataFrame, labels: list[str]) -> DataFrame:
    """One row per key: component, its number of records, the least and greatest recorded split, and the count of each label
    (columns l0, l1, ... in the order of ``labels``)."""
    named = links.select(F.concat(F.lit("r:"), repository_key(F.col("from_repo"))).alias("u"), F.concat(F.lit("r:"), repository_key(F.col("to_repo"))).alias("v"))
    joined = connected_components(named)
    keys = records.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("recorded").alias("low"), F.max("recorded").alias("high"), *[F.count_if(F.col("label") == v).alias(f"l{i}") for i, v in enumerate(labels)])
    return keys.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))


def assign_splits(records: DataFrame, links: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """records plus (component, split, mixed): whole components in the target shares.

    ``mixed`` tells whether the recorded, non-null splits of the record's component differ. A record without a key is
    a component of its own: its split is drawn by hash in the target shares, and it is never mixed. Labels are a small
    set of categories (more than LABELS raise); null labels count for no label, null recorded splits for no difference. Targets that do not sum to one are scaled; a null or
    negative share counts as zero; without any positive target, every split is null. Other columns are dropped.
    """
    rows = sorted((r.split_name, max(0.0, r.target_share or 0.0)) for r in targets.where("split_name is not null").select("split_name", "target_share").collect())
    rows = [(k, s / sum(x for _, x in rows)) for k, s in rows if sum(x for _, x in rows) > 0]
    names, shares = [k for k, _ in rows], np.array([s for _, s in rows])
    labels = labels_of(records)
    columns = [f"l{i}" for i in range(len(labels))]
    keys = cut(component_table(records, links, labels))
    sums = [F.sum(c).alias(c) for c in ["n", *columns]]
    components = cut(keys.groupBy("component").agg(*sums, (F.min("low") < F.max("high")).alias("mixed")).withColumn("mixed", F.coalesce("mixed", F.lit(False))))
    size = components.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k")).first()
    spark = records.sparkSession
    # at most HOT components hold one record in HOT: the only ones that come to the driver
    heavy = components.where(F.col("n") * HOT >= F.lit(size.n)).select("component", "n", *columns).orderBy("component").toPandas()
    wanted = shares * float(size.n)
    chosen: list[int] = []
    if len(heavy) and names:
        counts = heavy[columns].to_numpy(dtype=float)
        chosen, _ = anneal(list(heavy["component"]), heavy["n"].to_numpy(dtype=float), counts, names, shares * float(heavy["n"].sum()), chains=8, steps=200, seed=seed)
    placed = np.zeros(len(names))
    for k, n in zip(chosen, heavy["n"]):
        placed[k] += n
    left = np.maximum(wanted - placed, 0) if len(names) else np.zeros(0)
    left = left / left.sum() if len(names) and left.sum() > 0 else shares
    table = spark.createDataFrame([(c, names[k]) for c, k in zip(heavy["component"], chosen)], "component string, split string")
    light_rows = components.where(F.col("n") * HOT < F.lit(size.n)).withColumn("block", F.pmod(F.xxhash64("component"), F.lit(max(1, math.ceil(size.k / BLOCK)))))

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("component")
        if not names:
            return pd.DataFrame({"component": frame["component"], "split": None})
        sizes = frame["n"].to_numpy(dtype=float)
        state, _ = anneal(list(frame["component"]), sizes, frame[columns].to_numpy(dtype=float), names, left * sizes.sum(), seed=seed)
        return pd.DataFrame({"component": frame["component"], "split": [names[k] for k in state]})

    light_table = light_rows.select("component", "n", "block", *columns).groupBy("block").applyInPandas(search, "component string, split string")
    chosen_splits = light_table.unionByName(table)
    keyed = keys.select("key", "n", "component").join(components.select("component", "mixed").join(chosen_splits, "component", "left"), "component", "left").select("key", F.col("n").alias("weight"), "component", "split", "mixed")
    draw = F.pmod(F.xxhash64("row_key", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    lone = F.lit(None).cast("string")
    for name, bound in reversed(list(zip(names, np.cumsum(shares)))):
        lone = F.when(draw < float(bound), F.lit(name)).otherwise(lone if name != names[-1] else F.lit(name))
    result = hot_left_join(records, keyed, "key", "row_key", "weight", int(size.n))
    return result.select("record_table", "record_id", "recorded", "label", F.coalesce("component", F.concat(F.lit("x:"), "row_key")).alias("component"), F.when(F.col("key").isNull(), lone).otherwise(F.col("split")).alias("split"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
