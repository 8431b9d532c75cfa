"""Token sequences: encoding, pieces, repetition, cycles, packing and row assembly."""

from __future__ import annotations

import ast
import base64
import bisect
import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed value: the split pattern that goes with the vocabulary's file format.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++|\s*[\r\n]|\s+(?!\S)|\s+"""
TOKENS = T.ArrayType(T.IntegerType())


def piece_counts(frame: DataFrame, text: str, source: str) -> DataFrame:
    """(piece, source, n) of every piece of the split pattern, which together are the text; null texts have none."""
    cut_ = F.regexp_extract_all(text, F.lit("(?U)" + PATTERN), F.lit(0))
    return frame.where(F.col(text).isNotNull()).select(F.col(source).alias("source"), F.explode(cut_).alias("piece")).groupBy("piece", "source").agg(F.count("*").alias("n"))


def pair_scores(counts: DataFrame) -> DataFrame:
    """(a, b, f, r, score) of every pair of neighbouring bytes in the pieces: how often, in how many sources, f ln r."""
    code = F.hex(F.encode("piece", "UTF-8"))
    at = F.sequence(F.lit(1), F.length(code) - 3, F.lit(2))
    pairs = counts.where(F.octet_length("piece") > 1).select("source", "n", F.explode(F.transform(at, lambda i: F.substr(code, i, F.lit(4)))).alias("pair"))
    per = pairs.groupBy("pair", "source").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("f"), F.count_distinct("source").alias("r"))
    byte = lambda at: F.conv(F.substr("pair", F.lit(at), F.lit(2)), 16, 10).cast("int")
    return per.select(byte(1).alias("a"), byte(3).alias("b"), "f", "r", F.round(F.col("f") * F.log("r"), 6).alias("score"))

_ENCODINGS: dict = {}


def _encoding(ranks: dict[bytes, int], pattern: str):
    import tiktoken

    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if key not in _ENCODINGS:
        _ENCODINGS[key] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[key]


def vocabulary(rows: DataFrame) -> dict[bytes, int]:
    """token bytes to rank; a tokenizer is a fixed table."""
    return {base64.b64decode(r.token_b64): r.token_rank for r in rows.select("token_rank", "token_b64").collect()}


def encoder(spark, ranks: dict[bytes, int], pattern: str = PATTERN) -> Callable[[Column], Column]:
    """text -> ARRAY<INT>, special strings as ordinary text; null stays null."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf(TOKENS)
    def encode(texts: pd.Series) -> pd.Series:
        coder = _encoding(shared.value, pattern)
        return texts.map(coder.encode_ordinary, na_action="ignore")

    return encode


# ---- pieces

def python_statements(text: str) -> list[int]:
    """Character positions of the lines on which a top-level statement starts; every line start if the text does not parse."""
    lines = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return lines
    return sorted({lines[min(min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1, len(lines) - 1)] for n in tree.body})


_CPP = re.compile(r"//[^\n]*|/\*.*?\*/|R\"([^()\\\s]{0,16})\(.*?\)\1\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#(?:\\\n|[^\n])*|[{}();]", re.S | re.M)


def cpp_statements(text: str) -> list[int]:
    """Character positions of the lines that follow a statement ending outside all brackets: after a semicolon or a closing
    brace at level 0, or after a directive. Comments and literals hold no brackets."""
    depth, starts = 0, {0}
    for token in _CPP.finditer(text):
        found = token.group(0)
        if found in ("{", "("):
            depth += 1
        elif found in ("}", ")"):
            depth = max(0, depth - 1)
        if depth == 0 and (found in (";", "}") or found.lstrip(" \t").startswith("#")):
            end = text.find("\n", token.end())
            if end >= 0 and not text[token.end() : end].strip():
                starts.add(end + 1)
    return sorted(starts)


STATEMENTS = {"Python": python_statements, "C++": cpp_statements}


def cut_pieces(starts: np.ndarray | list[int], text: str, window: int, language: str | None) -> list[tuple[int, int]]:
    """Token ranges of at most ``window`` tokens whose ends fall on the last statement start in reach (of a language whose
    statements are known), else on the last line end, else on the last character start. ``starts`` are the characters that
    begin before each token, and the text's length last."""
    starts = np.asarray(starts, dtype=np.int64)
    n = len(starts) - 1
    if n <= window:
        return [(0, n)] if n else []
    whole = np.diff(starts, prepend=-1) > 0  # a character begins with the token before
    lines = np.zeros(len(text) + 1, dtype=bool)
    lines[1:] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10
    statements = np.zeros(len(text) + 1, dtype=bool)
    statements[np.minimum(STATEMENTS[language](text), len(text)) if language in STATEMENTS else []] = True
    # for each place and kind of end the last one up to it
    ends = [np.maximum.accumulate(np.where(kind & whole, np.arange(n + 1), 0)) for kind in (statements[starts], lines[starts], whole)]
    pieces, at = [], 0
    while n - at > window:
        end = next((int(e[at + window]) for e in ends if e[at + window] > at), at + window)
        pieces.append((at, end))
        at = end
    return [*pieces, (at, n)]


def piece_cutter(spark, ranks: dict[bytes, int], window: int) -> Callable[[Column, Column], Column]:
    """(text, lang) -> ARRAY<STRUCT<start, end, text>> of token ranges and what they hold."""
    shared = spark.sparkContext.broadcast(ranks)

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
    def cut(texts: pd.Series, langs: pd.Series) -> pd.Series:
        coder = _encoding(shared.value, PATTERN)
        # how many characters begin in each token
        begun = np.zeros(max(shared.value.values(), default=0) + 1, dtype=np.int64)
        for token, rank in shared.value.items():
            begun[rank] = sum((b & 0xC0) != 0x80 for b in token)

        def one(text, lang):
            if text is None:
                return []
            ids = coder.encode_ordinary(text)
            if len(ids) <= window:
                return [(0, len(ids), text)] if ids else []
            starts = np.concatenate([[0], np.cumsum(begun[ids])])
            return [(a, b, text[starts[a] : starts[b]]) for a, b in cut_pieces(starts, text, window, lang)]

        return pd.Series([[dict(zip(("start", "end", "text"), piece)) for piece in one(t, g)] for t, g in zip(texts, langs)])

    return cut


# ---- infilling

def node_spans(text: str) -> list[tuple[int, int]]:
    """Character ranges of the statements and expressions of a Python text, in order; none if it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, MemoryError, RecursionError):
        return []
    lines = text.split("\n")
    begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])])

    def at(line: int, column: int) -> int:  # columns of the tree are bytes
        held = lines[line - 1] if line <= len(lines) else ""
        return int(begin[line - 1]) + (column if held.isascii() else len(held.encode()[:column].decode(errors="ignore")))

    return sorted({(at(n.lineno, n.col_offset), at(n.end_lineno, n.end_col_offset)) for n in ast.walk(tree) if isinstance(n, (ast.stmt, ast.expr))})


def infill(text: str, key: str, language: str | None = None, rate: float = 0.5) -> tuple[str, str] | None:
    """(mode, example) of a text whose middle is moved to the end; null if not drawn. The middle is one node of the syntax
    tree, by even chance and where there is a tree, else a span between line starts. All draws depend on the key alone."""
    digest = hashlib.sha256(key.encode()).digest()
    draw = [int.from_bytes(digest[i : i + 4], "big") / 2**32 for i in range(0, 20, 4)]
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n" and i + 1 < len(text)]
    if draw[0] >= rate or len(starts) < 2:
        return None
    nodes = node_spans(text) if language == "Python" and draw[4] < 0.5 else []
    if nodes:
        a, b = nodes[int(draw[1] * len(nodes))]
    else:
        a, b = sorted((starts[int(draw[1] * len(starts))], [*starts[1:], len(text)][int(draw[2] * len(starts))]))
    if a == b:
        return None
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draw[3] < 0.5:
        return "psm", f"<PRE>{prefix}<SUF>{suffix}<MID>{middle}"
    return "spm", f"<PRE><SUF>{suffix}<MID>{prefix}{middle}"


@F.pandas_udf(T.StructType([T.StructField("mode", T.StringType()), T.StructField("example", T.StringType())]))
def infilled(texts: pd.Series, keys: pd.Series, langs: pd.Series) -> pd.DataFrame:
    rows = [infill(t, k, g) if t is not None else None for t, k, g in zip(texts, keys, langs)]
    return pd.DataFrame([r or (None, None) for r in rows], columns=["mode", "example"])


# ---- packing

def best_fit(sizes: list[int], capacity: int, closed: list[bool] | None = None) -> list[int]:
    """Row of each item by best-fit decreasing: equal sizes in order, of equally good rows the one last put into.

    A ``closed`` item must be followed by one more slot unless an open item stands in its row: a row of closed items
    alone keeps a slot free, which an open item may take. Without ``closed`` all items are open. Sizes that fit no row
    raise.
    """
    rows, used, puts = [0] * len(sizes), 0, 0
    waiting: tuple[list, list] = ([], [])  # (room, -put, row): rows of closed items alone, net of their slot; all others
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, slot = sizes[i], int(closed is None or not closed[i])
        if size > capacity - 1 + slot:
            raise ValueError("an item is longer than a row")
        offers = []
        for kind, need in ((0, size - slot), (1, size)):
            at = bisect.bisect_left(waiting[kind], (need, -puts - 1, 0))
            if at < len(waiting[kind]):
                offers.append((waiting[kind][at][0] + (slot if kind == 0 else 0), kind, at))
        if offers:
            free, kind, at = min(offers)
            row = waiting[kind].pop(at)[2]
        else:
            free, kind, row, used = capacity - 1 + slot, 0, used, used + 1
        rows[i], puts = row, puts + 1
        if free > size:
            bisect.insort(waiting[max(kind, slot)], (free - size, -puts, row))
    return rows


def first_fit(sizes: list[int], capacity: int, most: int) -> list[int]:
    """Row of each item by first-fit decreasing with at most ``most`` items a row; equal sizes in order. Sizes beyond the
    capacity raise. The first row with room is found by descending a tree of the most room below each node."""
    rows, leaves = [0] * len(sizes), 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    count = [0] * leaves
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        if sizes[i] > capacity:
            raise ValueError("an item is longer than a row")
        at = 1
        while at < leaves:
            at = 2 * at if room[2 * at] >= sizes[i] else 2 * at + 1
        row = rows[i] = at - leaves
        count[row] += 1
        room[at] = room[at] - sizes[i] if count[row] < most else -1
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return rows


#: Items of a shard that are packed together, about: the shards follow the number of items, so tasks stay equal.
SHARD_ITEMS = 50_000


def shard_of(items: int, *ident: str) -> Column:
    """The shard of an item, of as many shards as ``items`` items need."""
    return F.pmod(F.xxhash64(*ident), F.lit(max(1, -(-items // SHARD_ITEMS))))


def pack_shards(pieces: DataFrame, shard: str, ident: list[str], size: str, capacity: int, most: int | None = None, closed: str | None = None) -> DataFrame:
    """(shard, *ident, size[, closed], row) by best fit, or first fit if ``most`` items may share a row. Every shard is packed
    alone, equal sizes in the order of ``ident``."""
    keep = [shard, *ident, size, *([closed] if closed else [])]
    schema = T.StructType([*pieces.select(*keep).schema.fields, T.StructField("row", T.LongType())])

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([*ident, size], kind="stable")
        sizes = frame[size].tolist()
        rows = first_fit(sizes, capacity, most) if most is not None else best_fit(sizes, capacity, frame[closed].tolist() if closed else None)
        return frame.assign(row=rows)[[*keep, "row"]]

    return pieces.select(*keep).groupBy(shard).applyInPandas(place, schema)


def spans_in_rows(packed: DataFrame, ident: str = "doc_id", size: str = "size") -> DataFrame:
    """(shard, row, ident, start, stop) of the items of ``pack_shards``, a slot for the start mark before each; an item in
    more than one piece is an error at run time."""
    pieces = packed.groupBy(ident).agg(F.count("*").alias("_n"))
    before = F.sum(size).over(Window.partitionBy("shard", "row").orderBy(ident).rowsBetween(Window.unboundedPreceding, 0))
    checked = packed.withColumn("stop", before).join(pieces, ident).withColumn("_one", F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("an item in more than one piece")).cast("boolean")))
    return checked.where("_one").select("shard", "row", ident, (F.col("stop") - F.col(size) + 1).alias("start"), "stop")


# ---- repetition

def end_matches(tokens: np.ndarray, most: int) -> np.ndarray:
    """For each distance up to ``most`` (and below the length): how many tokens at the end equal those that distance earlier.

    One pass over the reversed sequence: inside the stretch that some earlier distance is known to match, lengths repeat.
    """
    back = tokens[::-1].tolist()
    n = len(back)
    found = np.zeros(min(most, max(0, n - 1)) + 1, dtype=np.int64)
    left = right = 0
    for p in range(1, len(found)):
        length = min(right - p, int(found[p - left])) if p < right else 0
        while p + length < n and back[length] == back[p + length]:
            length += 1
        if p + length > right:
            left, right = p, p + length
        found[p] = length
    return found


#: A response is in a cycle if its last CYCLE_TAIL tokens equal those up to MOST_PERIOD before; it repeats
#: itself if of its last REPEAT_TAIL tokens the share LOOP stands in runs of REPEAT_WINDOW that recur there, asked every
#: CHECK tokens.
CYCLE_TAIL, MOST_PERIOD, REPEAT_TAIL, REPEAT_WINDOW, LOOP, CHECK = 1024, 2048, 4096, 32, 0.99, 2048


def find_cycle(tokens: list, tail: int = CYCLE_TAIL, most: int = MOST_PERIOD) -> tuple[int | None, int | None]:
    """(period, onset): the least period at which the last ``tail`` tokens all equal those one period before, and the first
    place from which every token equals the one a period later; nulls if there is none."""
    matches = end_matches(np.asarray(tokens), most)
    periods = np.flatnonzero(matches >= max(1, tail))
    if not len(periods):
        return None, None
    period = int(periods[0])
    return period, len(tokens) - period - int(matches[period])


@F.pandas_udf(T.StructType([T.StructField("period", T.IntegerType()), T.StructField("onset", T.IntegerType())]))
def cycle(ids: pd.Series, tail: pd.Series, most: pd.Series) -> pd.DataFrame:
    """``find_cycle`` of each sequence; nulls for a null one."""
    out = [find_cycle(list(tokens), int(window), int(limit)) if tokens is not None else (None, None) for tokens, window, limit in zip(ids, tail, most)]
    return pd.DataFrame(out, columns=["period", "onset"]).astype("Int32")


def recurring(tokens: np.ndarray, window: int) -> np.ndarray:
    """Which tokens stand inside a run of ``window`` tokens that occurs more than once."""
    n = len(tokens)
    if n < window:
        return np.zeros(n, dtype=bool)
    runs = np.lib.stride_tricks.sliding_window_view(tokens, window)
    _, kind, count = np.unique(runs, axis=0, return_inverse=True, return_counts=True)
    begin = np.flatnonzero(count[kind.ravel()] > 1)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + window, -1)
    return np.cumsum(edges[:n]) > 0


def repeats_itself(tokens: list, tail: int = REPEAT_TAIL, window: int = REPEAT_WINDOW, share: float = LOOP, check: int = CHECK) -> bool:
    """Whether the repetition rule, asked at every multiple of ``check`` tokens from ``tail`` on, stops the sequence here."""
    n = len(tokens)
    return n >= tail and n % check == 0 and bool(recurring(np.asarray(tokens)[-tail:], window).mean() >= share)


@F.pandas_udf(T.BooleanType())
def repetition_stop(ids: pd.Series, tail: pd.Series, window: pd.Series, check: pd.Series) -> pd.Series:
    return pd.Series([repeats_itself(list(t), int(a), int(w), LOOP, int(c)) if t is not None else None for t, a, w, c in zip(ids, tail, window, check)], dtype="object")


#: The repetition penalty's parameters, and the longest match it measures.
MULTIPLIER, BASE, ALLOWED, MOST_MATCH = 0.8, 1.75, 2, 64


def repetition_penalties(tokens: list[int], breakers: set[int], allowed: int = ALLOWED) -> dict[int, tuple[int, float]]:
    """Token to (match length, penalty): each token that followed an earlier copy of the sequence's end, at least
    ``allowed`` tokens long. A breaker ends every match and is never penalised; of several copies the longest counts."""
    x = np.asarray(tokens, dtype=np.int64)
    if len(x) < 2:
        return {}
    stops = np.flatnonzero(np.isin(x, list(breakers)))
    reach = min(MOST_MATCH, len(x) - 1 - int(stops[-1]) if len(stops) else MOST_MATCH)
    lengths = np.minimum(end_matches(x, len(x))[1:], reach)  # by distance 1, 2, ...
    after = x[::-1][: len(lengths)]  # the token behind the copy at that distance
    best: dict[int, int] = {}
    for at in np.flatnonzero((lengths >= max(1, allowed)) & ~np.isin(after, list(breakers))).tolist():
        best[int(after[at])] = max(best.get(int(after[at]), 0), int(lengths[at]))
    return {v: (n, MULTIPLIER * BASE ** (n - allowed)) for v, n in best.items()}


_PENALTY = T.ArrayType(T.StructType([T.StructField("token", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("penalty", T.DoubleType())]))


def penalised(breakers: list[int]) -> Callable[[Column], Column]:
    """ids -> the penalties of the tokens that may come next, ascending by token; null stays null."""
    marks = set(breakers)

    @F.pandas_udf(_PENALTY)
    def penalties(ids: pd.Series) -> pd.Series:
        return ids.map(lambda t: [{"token": v, "length": n, "penalty": p} for v, (n, p) in sorted(repetition_penalties(list(t), marks).items())], na_action="ignore")

    return penalties


def repeated_coverage(frame: DataFrame, words: Column, n: int, out: str = "covered") -> DataFrame:
    """frame plus the share of positions inside an n-gram that occurs twice or more; rows with shorter (or null)
    sequences are left out."""
    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))

    def covered(h) -> float:
        h = np.asarray(h)
        _, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        at = np.flatnonzero(counts[where] > 1)
        mark = np.zeros(len(h) + n, dtype=np.int64)
        np.add.at(mark, at, 1)
        np.add.at(mark, at + n, -1)
        return float((np.cumsum(mark)[: len(h) + n - 1] > 0).mean())

    def measure(batches):
        for frame_ in batches:
            yield frame_.assign(**{out: [covered(h) for h in frame_["_hashes"]]}).drop(columns="_hashes")

    hashed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, grams(w))), 1)
    schema = T.StructType([*frame.schema.fields, T.StructField(out, T.DoubleType())])
    return frame.withColumn("_hashes", hashed).where("_hashes is not null").mapInPandas(measure, schema)


def bisect_most(low: int, high: int, fits: Callable[[int], bool]) -> int:
    """The largest size up to ``high`` found feasible by bisection from ``low``, which must fit; exact if feasibility is
    monotone."""
    if not fits(low):
        raise ValueError("the least size does not fit")
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if fits(middle) else (low, middle - 1)
    return low
