"""Mixtures of sources with target shares: temperature weights, and their realisation as budgeted block permutations.

Inside a group the weight of a source is its token share to a power between 0 (even) and 1 (in proportion). The
exponent is found by bisection: the least one whose weights ask no source for more readings than allowed, or, if a
target entropy is given, the one that meets it under the same limit. A source's budget becomes whole readings and one
part of a reading: every reading permutes hashed blocks of documents, and the part takes blocks while they fit, then, in
their order, documents of the next blocks that fit into what is left. What the sources of a group still lack together is
filled up from what they passed over: by documents that fit, then by one more if that brings the group nearer to its
budget.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut


def weights(tokens: list[float], exponent: float) -> list[float]:
    top = max(tokens, default=0.0)
    raw = [(t / top) ** exponent if t > 0 else 0.0 for t in tokens]
    return [w / sum(raw) for w in raw] if sum(raw) > 0 else [0.0 for _ in tokens]


def entropy(shares: list[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def temper(tokens: list[float], budget: float, repeats: float, target: float | None = None, rounds: int = 60) -> tuple[float, list[float]]:
    """(exponent, tokens to draw of each source) for a group; sources without tokens draw none.

    If even proportional weights ask for more than ``repeats`` readings, every source is read ``repeats`` times and the
    group stays short of its budget.
    """
    if budget <= 0 or sum(tokens) <= 0:
        return 1.0, [0.0 for _ in tokens]
    if sum(tokens) * repeats <= budget:
        return 1.0, [t * repeats for t in tokens]

    def fits(exponent: float) -> bool:
        return all(w * budget <= t * repeats * (1 + 1e-12) for w, t in zip(weights(tokens, exponent), tokens))

    def flat_enough(exponent: float) -> bool:
        return target is None or entropy(weights(tokens, exponent)) <= target

    low, high = 0.0, 1.0
    if fits(0.0) and flat_enough(0.0):
        high = 0.0
    else:
        for _ in range(rounds):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) and flat_enough(middle) else (middle, high)
    return high, [w * budget for w in weights(tokens, high)]


@dataclass(frozen=True)
class Draw:
    stage: str
    group_name: str
    source: str
    share_kind: str
    target: float
    exponent: float
    tokens: int
    budget: int
    repeats: int


def plan(groups: list[dict], tokens: dict[str, int], reached: dict[str, int] | None = None, target_entropy: float | None = None) -> list[Draw]:
    """The budget of each source of each stage: of the ``fixed`` and ``supply`` groups, or, once ``reached`` tells what
    these really gave to each stage, of the ``rest`` groups, which share what the stage lacks, nothing below 0."""
    draws: list[Draw] = []
    rests = Counter(g["stage"] for g in groups if g["share_kind"] == "rest")
    for g in sorted(groups, key=lambda g: (g["stage"], g["group_name"])):
        if (g["share_kind"] == "rest") != (reached is not None):
            continue
        total = float(g["stage_tokens"] or 0)
        sources = sorted(set(g["sources"] or []))
        have = [float(tokens.get(s, 0)) for s in sources]
        repeats = int(g["max_repeats"] if g["max_repeats"] is not None else 1)
        if g["share_kind"] == "supply":
            exponent, drawn, goal, repeats = 1.0, list(have), sum(have), max(1, repeats)
        else:
            goal = (g["share"] or 0.0) * total if reached is None else max(0.0, total - reached.get(g["stage"], 0)) / rests[g["stage"]]
            exponent, drawn = temper(have, goal, repeats, target_entropy)
        draws += [Draw(g["stage"], g["group_name"], s, g["share_kind"], goal / total if total else 0.0, exponent, int(h), int(round(d)), repeats) for s, h, d in zip(sources, have, drawn)]
    return draws


DRAWS = "stage string, group_name string, source string, share_kind string, target double, exponent double, have long, budget long, repeats int"


GROUP = ["stage", "group_name"]
DRAW = [*GROUP, "source"]
ROW = [*DRAW, "epoch", "block", "sort_key", "doc_id", "tokens"]
ROWS = "stage string, group_name string, source string, epoch long, block long, sort_key long, doc_id long, tokens long"


def greedy(tokens: list[int], free: list[bool], room: int) -> int:
    """Take what is free and fits into what is ``room`` yet, in order; the room left. Taken entries are no longer free."""
    for i, n in enumerate(tokens):
        if free[i] and n <= room:
            free[i], room = False, room - n
    return room


def settled(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents taken of a group's candidates, and what the group lacks in the end: each source fills its own ``room``, the
    group what is left of all, and one last document is taken if it is nearer to the budget than none."""
    frame = frame.sort_values(["block", "sort_key", "source", "doc_id", "tokens"], kind="stable").reset_index(drop=True)
    free, lacking = [True] * len(frame), int(frame["lacking"].iloc[0])
    for _, own in frame.groupby("source", sort=True):
        held, room = [True] * len(own), int(own["room"].iloc[0])
        lacking -= room - greedy(own["tokens"].tolist(), held, room)
        for i, still in zip(own.index, held):
            free[i] = still
    tokens = frame["tokens"].tolist()
    lacking = greedy(tokens, free, lacking)
    off, last = min(((abs(n - lacking), i) for i, n in enumerate(tokens) if free[i]), default=(lacking, -1))
    if off < lacking:
        free[last], lacking = False, lacking - tokens[last]
    return frame[ROW].assign(taken=[not f for f in free], lacking=lacking)


SETTLED = f"{ROWS}, taken boolean, lacking long"


def _before(sums: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum("total").over(order), F.lit(0)))


def _told(values: dict[tuple, int], by: list[str]) -> Column:
    """The number of a row's ``by`` values, null where there is none: as many entries as the configuration has draws."""
    found = F.lit(None).cast("long")
    for key, n in sorted(values.items()):
        found = F.when(reduce(and_, (F.col(c) == v for c, v in zip(by, key))), F.lit(n).cast("long")).otherwise(found)
    return found


def realise(counted: DataFrame, draws: list[Draw], documents: dict[str, int], seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows, tokens by stage) of the draws; ``documents`` has the number of documents of each source.

    A source of n documents is cut into about sqrt(n) blocks of about sqrt(n) documents: neither the running sum over the
    blocks of a reading nor the blocks that are taken in part grow as the source does. The driver gets one row a draw.
    """
    spark = counted.sparkSession
    table = spark.createDataFrame([(d.stage, d.group_name, d.source, d.budget // d.tokens, d.budget % d.tokens, max(1, math.isqrt(documents.get(d.source, 1)))) for d in draws if d.tokens and d.budget], "stage string, group_name string, source string, whole long, part long, blocks long")

    def permuted(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("stage", "epoch", "doc_id", F.lit(seed)), F.col("blocks")))
        return rows.withColumn("block", F.pmod(F.xxhash64("stage", "source", "epoch", "block", F.lit(seed + 1)), F.lit(2**40))).withColumn("sort_key", F.xxhash64("stage", "epoch", "doc_id", F.lit(seed + 2)))

    joined = counted.join(F.broadcast(table), "source")  # the plan: as many rows as the configuration names
    whole = permuted(joined.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("whole")))))
    part = permuted(joined.where("part > 0").withColumn("epoch", F.col("whole") + 1))
    sums = _before(part.groupBy(*DRAW, "block").agg(F.sum("tokens").alias("total"), F.first("part").alias("part")), DRAW)
    found = sums.where("before + total > part").groupBy(*DRAW).agg(F.min(F.struct("block", (F.col("part") - F.col("before")).alias("room"))).alias("b")).collect()
    border, room = ({tuple(r)[:3]: r.b[k] for r in found} for k in ("block", "room"))
    lacking = {(d.stage, d.group_name): 0 for d in draws}
    for (stage, group, _), n in room.items():
        lacking[stage, group] += n
    bounded = part.withColumn("border", _told(border, DRAW))
    # candidates: from the block at the border on, up to the one with which the documents that fit into what the whole group
    # lacks are twice enough for it
    spare = bounded.where("block >= border").select(*ROW, _told(room, DRAW).alias("room"), _told(lacking, GROUP).alias("lacking"))
    fits = _before(spare.where("tokens <= lacking").groupBy(*DRAW, "block").agg(F.sum("tokens").alias("total"), F.first("lacking").alias("lacking")), DRAW)
    upto = dict(border) | {tuple(r)[:3]: r.upto for r in fits.where("before < 2 * lacking").groupBy(*DRAW).agg(F.max("block").alias("upto")).collect()}
    chosen = cut(spare.where((F.col("tokens") < 2 * F.col("lacking")) & (F.col("block") <= _told(upto, DRAW))).groupBy(*GROUP).applyInPandas(settled, SETTLED))
    rows = whole.select(ROW).unionByName(bounded.where("block < border").select(ROW)).unionByName(chosen.where("taken").select(ROW))
    lacking |= {(r.stage, r.group_name): r.lacking for r in chosen.groupBy(*GROUP).agg(F.first("lacking").alias("lacking")).collect()}
    reached: dict[str, int] = {}
    for d in draws:
        reached[d.stage] = reached.get(d.stage, 0) + (d.budget if d.tokens else 0)
    for (stage, _), n in lacking.items():
        reached[stage] -= n
    return rows, reached


def mixture(counted: DataFrame, groups: DataFrame, target_entropy: float | None = None, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(rows, draws): rows (stage, group_name, source, epoch, block, sort_key, doc_id, tokens) in the order of
    (epoch, block, sort_key); draws, the plan by stage and source.

    counted has doc_id, source, tokens. Documents without tokens, and those of sources no group names, are never drawn.
    A source without documents draws nothing; a group no source of which has documents reaches nothing. ``rest`` groups
    are planned from what the others have really reached.
    """
    spark = counted.sparkSession
    counted = cut(counted.select(F.col("doc_id").cast("long"), "source", F.col("tokens").cast("long")).where("tokens > 0 and source is not null"))
    names = groups.select(F.explode("sources").alias("source")).distinct()
    # one row per source that a group names: the mixture's own configuration bounds it
    sizes = counted.join(names, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()
    tokens, documents = {r.source: r.tokens for r in sizes}, {r.source: r.n for r in sizes}
    stated = [r.asDict() for r in groups.collect()]
    draws = plan(stated, tokens, None, target_entropy)
    rows, reached = realise(counted, draws, documents, seed)
    rest = plan(stated, tokens, reached, target_entropy)
    rows = rows.unionByName(realise(counted, rest, documents, seed)[0])
    table = spark.createDataFrame([(d.stage, d.group_name, d.source, d.share_kind, d.target, d.exponent, d.tokens, d.budget, d.repeats) for d in draws + rest], DRAWS)
    return rows, table


def report(rows: DataFrame, draws: DataFrame, groups: DataFrame) -> DataFrame:
    """For each stage, group and source: tokens reached, its share of stage_tokens beside the group's target, readings."""
    got = rows.groupBy("stage", "group_name", "source").agg(F.sum("tokens").alias("reached_tokens"), F.max("epoch").alias("readings"))
    stages = groups.groupBy("stage").agg(F.max("stage_tokens").alias("stage_tokens"))
    joined = draws.join(got, ["stage", "group_name", "source"], "left").join(stages, "stage", "left").na.fill(0, ["reached_tokens", "readings"])
    group = Window.partitionBy("stage", "group_name")
    return joined.select("stage", "group_name", "share_kind", "source", "have", "budget", "repeats", "reached_tokens", "readings", F.round("exponent", 6).alias("exponent"), F.round(F.col("reached_tokens") / F.col("stage_tokens"), 6).alias("source_share"), F.round(F.sum("reached_tokens").over(group) / F.col("stage_tokens"), 6).alias("group_share"), F.round("target", 6).alias("target_share"))
