"""Token counts under a byte-level vocabulary, by iterated merges over the distinct pieces of the texts.

The split pattern runs in the JVM; each Arrow batch of piece arrays is dictionary-encoded, so only distinct pieces not
yet met by the worker are merged. Those are held as one symbol array: every round joins adjacent pairs with the merge
ranks, takes the lowest rank of each piece, applies it, and leaves out finished pieces, until none can be merged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import topic_key
from millrace.operators.sequences import PATTERN as SPLIT_PATTERN
from millrace.session import spread

#: Java's classes are ASCII unless asked otherwise.
JVM_PATTERN = "(?U)" + SPLIT_PATTERN
NONE = np.iinfo(np.int64).max
#: Entries a worker remembers before it starts anew; a larger memo only saves work.
MEMO = 1_000_000


class Merger:
    """Byte-pair merges of many pieces at once. ``vocabulary`` maps token bytes to ranks and holds every single byte."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        missing = [b for b in range(256) if bytes([b]) not in vocabulary]
        if missing:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.base = np.array([vocabulary[bytes([b])] for b in range(256)], dtype=np.int64)
        self.width = max(vocabulary.values()) + 1
        pairs: dict[int, int] = {}
        early: set[int] = set()  # tokens of which a neighbour can make a token of lower rank
        for token, rank in vocabulary.items():
            for cut in range(1, len(token)):
                x, y = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
                if x is not None and y is not None:
                    pairs[x * self.width + y] = rank
                    early.update(s for s in (x, y) if s > rank)
        order = np.array(sorted(pairs), dtype=np.int64)
        self.keys = np.append(order, NONE)
        self.ranks = np.append(np.array([pairs[k] for k in order.tolist()], dtype=np.int64), NONE)
        self.single = np.zeros(self.width, dtype=bool)
        self.single[list(early)] = True
        self.memo: dict[str, int] = {}

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ranks of all pieces in a row, number of tokens of each piece)."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        done_ids, done_owner = [], []
        whole = [self.vocabulary.get(p) for p in pieces]
        at = [i for i, w in enumerate(whole) if w is not None]
        done_ids.append(np.array([whole[i] for i in at], dtype=np.int64))
        done_owner.append(np.array(at, dtype=np.int64))
        rest = [i for i, w in enumerate(whole) if w is None and pieces[i]]
        ids = self.base[np.frombuffer(b"".join(pieces[i] for i in rest), dtype=np.uint8)]
        owner = np.repeat(np.array(rest, dtype=np.int64), [len(pieces[i]) for i in rest])
        while ids.size:
            joined = owner[:-1] == owner[1:]
            keys = np.where(joined, ids[:-1] * self.width + ids[1:], -1)
            where = np.searchsorted(self.keys, keys)
            rank = np.append(np.where(self.keys[where] == keys, self.ranks[where], NONE), NONE)
            starts = np.flatnonzero(np.append(True, ~joined))
            lengths = np.diff(np.append(starts, ids.size))
            least = np.minimum.reduceat(rank, starts)
            active = least < NONE
            if not active.all():
                stay = np.repeat(active, lengths)
                done_ids.append(ids[~stay])
                done_owner.append(owner[~stay])
                ids, owner, rank = ids[stay], owner[stay], rank[stay]
                lengths, least = lengths[active], least[active]
                if not ids.size:
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            # of overlapping equal pairs every second is taken, from the left
            fresh = np.append(True, np.diff(at) > 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(at.size), 0))
            at = at[(np.arange(at.size) - run) % 2 == 0]
            merged = rank[at]
            if self.single[merged].any():  # here the next pair may rank lower, so one at a time
                first = np.append(True, owner[at][1:] != owner[at][:-1])
                keep = first | ~self.single[merged]
                at, merged = at[keep], merged[keep]
            ids[at] = merged
            gone = np.ones(ids.size, dtype=bool)
            gone[at + 1] = False
            ids, owner = ids[gone], owner[gone]
        ids, owner = np.concatenate([*done_ids, ids]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        np.add.at(counts, owner, 1)
        return ids[order], counts

    def counts(self, pieces: list[str]) -> np.ndarray:
        """Token counts of distinct pieces, remembered between batches."""
        new = [p for p in pieces if p not in self.memo]
        if new:
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = pieces
            self.memo.update(zip(new, self.merge([p.encode() for p in new])[1].tolist()))
        return np.fromiter(map(self.memo.__getitem__, pieces), dtype=np.int64, count=len(pieces))


_MERGERS: dict[int, Merger] = {}


def vocabulary_of(rows: DataFrame) -> dict[bytes, int]:
    """The vocabulary of (token_rank, token_b64) rows; it is a fixed table of at most a million tokens. Rows with nulls
    are left out; of repeated bytes the lowest rank counts."""
    found = rows.select("token_rank", "token_b64").where("token_rank is not null and token_b64 is not null").limit(1_000_001).collect()
    if len(found) > 1_000_000:
        raise ValueError("a vocabulary of more than a million tokens")
    result: dict[bytes, int] = {}
    for row in sorted(found, key=lambda r: -r.token_rank):
        result[base64.b64decode(row.token_b64)] = row.token_rank
    return result


def merger_of(vocabulary: dict[bytes, int], key: int) -> Merger:
    """The worker's own merger for this vocabulary; it lives as long as the worker."""
    if key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[key] = Merger(vocabulary)
    return _MERGERS[key]


def token_counts(documents: DataFrame, vocabulary: dict[bytes, int], keep: Iterable[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns of documents and ``tokens`` BIGINT, the tokens of the whole text as ordinary text.

    A null text gives null tokens, an empty one 0. Repeated documents stay repeated. Columns may have any name but
    ``tokens`` and ``_pieces``; those not kept are not read.
    """
    keep = list(keep)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    key = hash(frozenset(vocabulary.items()))
    source = spread(documents.select(*keep, text)).select(*keep, F.regexp_extract_all(F.col(text), F.lit(JVM_PATTERN), F.lit(0)).alias("_pieces"))
    schema = T.StructType([*documents.select(*keep).schema.fields, T.StructField("tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = merger_of(shared.value, key)
        for batch in batches:
            pieces = batch.column(len(keep))
            flat = pieces.flatten().dictionary_encode()
            each = merger.counts(flat.dictionary.to_pylist()) if len(flat) else np.zeros(0, dtype=np.int64)
            running = np.concatenate([[0], np.cumsum(each[flat.indices.to_numpy()])]) if len(flat) else np.zeros(1, dtype=np.int64)
            missing = pieces.is_null().to_numpy(zero_copy_only=False)
            lengths = pieces.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(lengths)
            tokens = pa.array(running[ends] - running[ends - lengths], pa.int64(), mask=missing)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], tokens], [*keep, "tokens"])

    return source.mapInArrow(count, schema)


def totals(counted: DataFrame) -> DataFrame:
    """documents and tokens by source, lang and topic (spelling aside; null stays a value of its own)."""
    by = counted.withColumn("topic", topic_key(F.col("topic")))
    return by.groupBy("source", "lang", "topic").agg(F.count("*").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def against_stages(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """For each stage and source: its documents and tokens, and what part of the stage's tokens one reading gives.

    Every (stage, group, source) of ``groups`` gets a row, those without documents with 0. A null stage total gives a
    null part.
    """
    have = counted.groupBy("source").agg(F.count("*").alias("documents"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    want = groups.select("stage", "group_name", "stage_tokens", F.explode("sources").alias("source"))
    joined = want.join(have, "source", "left").na.fill(0, ["documents", "tokens"])
    return joined.select("stage", "group_name", "source", "documents", "tokens", "stage_tokens", F.round(F.col("tokens") / F.expr("nullif(stage_tokens, 0)"), 9).alias("part"))
