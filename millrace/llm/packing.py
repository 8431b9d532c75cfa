"""Rows of a fixed token length, filled by swap-based local search.

Documents meet in hashed blocks of about ``ROWS`` rows. Inside a block they are placed twice, first fit in hash order and
best fit by size; from either start the search lets rows give their documents to rows at least as full, the emptiest
first: by moves, one-for-one, two-for-one and one-for-two exchanges, over all documents of both rows. Every step raises
the sum of squared fills, so it ends; a row that empties is dropped. When no row can give anything, the better of the
two results is kept, so there are never more rows than best fit alone makes. Only a text longer than a row is cut: into
whole rows and one rest, which is placed like any document.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

ROWS = 400
ITEMS = 20_000


class Bins:
    """Items of given sizes in rows of one capacity."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.bin = np.full(len(sizes), -1, dtype=np.int64)
        self.gap = np.zeros(0, dtype=np.int64)

    def first_fit(self) -> None:
        """In the order given, the first row that has room."""
        gaps = np.full(max(1, len(self.sizes)), self.capacity, dtype=np.int64)
        used = low = 0
        for item, size in enumerate(self.sizes.tolist()):
            open_ = gaps[low:used]
            fits = int(np.argmax(open_ >= size)) if used > low else 0
            if used > low and open_[fits] >= size:
                at = low + fits
            else:
                at, used = used, used + 1
            gaps[at] -= size
            self.bin[item] = at
            while low < used and gaps[low] == 0:
                low += 1
        self.gap = gaps[:used].copy()

    def best_fit(self) -> None:
        """Large items first, each into the row it fills best."""
        gaps: list[tuple[int, int]] = []  # of the rows with room, ascending
        used = 0
        for item in np.argsort(-self.sizes, kind="stable").tolist():
            size = int(self.sizes[item])
            at = bisect.bisect_left(gaps, (size, -1))
            if at == len(gaps):
                gap, row, used = self.capacity, used, used + 1
            else:
                gap, row = gaps.pop(at)
            self.bin[item] = row
            if gap > size:
                bisect.insort(gaps, (gap - size, row))
        self.gap = np.zeros(used, dtype=np.int64)
        for gap, row in gaps:
            self.gap[row] = gap

    def put(self, to: int, *items: int) -> None:
        for item in items:
            self.gap[self.bin[item]] += self.sizes[item]
            self.gap[to] -= self.sizes[item]
            self.bin[item] = to

    def give(self, donor: int) -> bool:
        """One step that moves tokens from the donor to a row at least as full; False if there is none."""
        mine = np.flatnonzero(self.bin == donor)
        # of equal sizes one stands for all; a pair may need two of them
        own, first, count = np.unique(-self.sizes[mine], return_index=True, return_counts=True)
        own, mine, second = -own, mine[first], self._second(mine, count)
        room = np.where(self.gap <= self.gap[donor], self.gap, 0)
        room[donor] = 0
        moved = np.flatnonzero(own <= room.max(initial=0))
        if moved.size:  # the largest that fits anywhere, into the tightest row that takes it
            at = moved[0]
            self.put(int(np.argmin(np.where(room >= own[at], room, self.capacity + 1))), int(mine[at]))
            return True
        others = np.flatnonzero(room[self.bin] > 0)
        if not others.size:
            return False
        size, space = self.sizes[others], room[self.bin[others]]
        order = np.argsort(size + space, kind="stable")
        reach = (size + space)[order]
        # from each place on, the least size whose row can take up to reach in its stead
        least = np.minimum.accumulate(size[order][::-1])[::-1]
        one, two = np.triu_indices(len(own))
        paired = (one != two) | (second[one] >= 0)
        one, two = one[paired], two[paired]
        for sums, given in ((own, [(int(m),) for m in mine]), (own[one] + own[two], None)):
            at = np.searchsorted(reach, sums)
            gain = np.where(at < len(least), sums - least[np.minimum(at, len(least) - 1)], 0)
            best = int(np.argmax(gain)) if gain.size else 0
            if gain.size and gain[best] > 0:
                back = int(others[order[at[best] + int(np.argmin(size[order[at[best] :]]))]])
                a, b = (best, best) if given else (int(one[best]), int(two[best]))
                items = given[best] if given else (int(mine[a]), int(mine[b] if a != b else second[a]))
                to = int(self.bin[back])
                self.put(donor, back)
                self.put(to, *items)
                return True
        return self._one_for_two(donor, own, mine, others, size, space)

    def _second(self, mine: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Another item of each distinct size, largest first; -1 without one."""
        ordered = mine[np.argsort(-self.sizes[mine], kind="stable")]
        begin = np.cumsum(count) - count
        return np.where(count > 1, ordered[np.minimum(begin + 1, len(ordered) - 1)], -1)

    def _one_for_two(self, donor: int, own: np.ndarray, mine: np.ndarray, others: np.ndarray, size: np.ndarray, space: np.ndarray) -> bool:
        """A donor's item against two of one row: for each item of a row the least partner with which both are enough."""
        order = np.lexsort((size, self.bin[others]))
        others, size, space = others[order], size[order], space[order]
        row, place = self.bin[others], np.arange(len(others))
        keys = row * (self.capacity + 1) + size
        for item, given in zip(own.tolist(), mine.tolist()):
            partner = np.searchsorted(keys, row * (self.capacity + 1) + np.maximum(item - space - size, 0))
            partner = np.where(partner == place, partner + 1, partner)
            inside = np.minimum(partner, len(keys) - 1)
            pair = size + size[inside]
            fits = (partner < len(keys)) & (row[inside] == row) & (pair < item) & (pair + space >= item)
            if fits.any():
                best = int(np.argmax(np.where(fits, item - pair, 0)))
                to = int(row[best])
                self.put(donor, int(others[best]), int(others[inside[best]]))
                self.put(to, given)
                return True
        return False

    def search(self) -> None:
        """Until no row can give anything, or as few rows are left as the tokens need."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        left, moved = len(self.gap), True
        while moved and left > max(1, least):
            moved = False
            for donor in np.argsort(-self.gap, kind="stable").tolist():
                if self.gap[donor] in (0, self.capacity):
                    continue
                while self.gap[donor] < self.capacity and self.give(donor):
                    moved = True
                if self.gap[donor] == self.capacity:
                    left -= 1
                    if left <= max(1, least):
                        break
        keep = np.flatnonzero(self.gap < self.capacity)
        place = np.full(len(self.gap), -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        self.bin, self.gap = place[self.bin], self.gap[keep]


def pack_block(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(row of each item, number of rows) for sizes between 1 and capacity."""
    best = None
    for start in (Bins.first_fit, Bins.best_fit):
        bins = Bins(sizes, capacity)
        start(bins)
        bins.search()
        if best is None or len(bins.gap) < len(best.gap):
            best = bins
        if len(best.gap) <= -(-int(sizes.sum()) // capacity):
            break  # as few rows as the tokens need
    return best.bin, len(best.gap)


SCHEMA = "seq_len int, block long, row long, doc_id long, pieces int, piece int, start long, length int"


def pack(counted: DataFrame, lengths: list[int], seed: int = 11) -> DataFrame:
    """Placements (seq_len, block, row, doc_id, pieces, piece, start, length) of (doc_id, tokens) for each row length.

    Tokens [start, start + length) of a document stand in row (seq_len, block, row). ``pieces`` is 1 unless the
    document is longer than a row. Null or zero tokens take no room and get no placement. Repeated doc_ids are placed
    as often as they come; other columns are dropped; an empty table gives no rows.
    """
    counted = cut(counted.select(F.col("doc_id").cast("long"), F.col("tokens").cast("long")).where("tokens > 0"))
    size = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("n")).first()
    wide = None
    for length in sorted({int(n) for n in lengths if n and n > 0}):
        blocks = max(1, -(-size.tokens // (length * ROWS)), -(-size.n // ITEMS))
        one = counted.withColumn("seq_len", F.lit(length)).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(blocks)))
        wide = one if wide is None else wide.unionByName(one)
    if wide is None:
        wide = counted.limit(0).withColumn("seq_len", F.lit(1)).withColumn("block", F.lit(0).cast("long"))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        length, block = int(frame["seq_len"].iloc[0]), int(frame["block"].iloc[0])
        frame = frame.sort_values(["doc_id", "tokens"], kind="stable")
        docs, tokens = frame["doc_id"].to_numpy(), frame["tokens"].to_numpy()
        mixed = np.argsort((docs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(1), kind="stable")
        docs, tokens = docs[mixed], tokens[mixed]
        whole, rest = tokens // length, tokens % length
        pieces = whole + (rest > 0)
        last = np.flatnonzero(rest > 0)
        rows, count = pack_block(rest[last], length) if len(last) else (np.zeros(0, np.int64), 0)
        owner = np.repeat(np.arange(len(docs)), whole)
        order = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        part = np.concatenate([owner, last])
        piece = np.concatenate([order, whole[last]])
        return pd.DataFrame({"seq_len": length, "block": block, "row": np.concatenate([count + np.arange(len(owner)), rows]), "doc_id": docs[part], "pieces": pieces[part].astype(np.int32), "piece": piece.astype(np.int32), "start": piece * length, "length": np.concatenate([np.full(len(owner), length), rest[last]]).astype(np.int32)})

    return wide.groupBy("seq_len", "block").applyInPandas(place, SCHEMA)


def fill(placed: DataFrame) -> DataFrame:
    """For each row length: rows, tokens, the share of the room that is filled, documents cut and full rows."""
    rows = placed.groupBy("seq_len", "block", "row").agg(F.sum("length").alias("used"), F.sum(F.when((F.col("pieces") > 1) & (F.col("piece") == 0), 1).otherwise(0)).alias("cut"))
    return rows.groupBy("seq_len").agg(F.count("*").alias("rows"), F.sum("used").alias("tokens"), F.round(F.sum("used") / (F.count("*") * F.col("seq_len")), 6).alias("filled"), F.sum("cut").alias("documents_cut"), F.count_if(F.col("used") == F.col("seq_len")).alias("full_rows"))
