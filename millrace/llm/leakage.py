"""Benchmark passages inside a corpus, found with one Aho-Corasick automaton over normalised items.

Texts are compared as streams of letters and digits alone, so line breaks, hyphenation, comment marks, quotes, markup
and letter case do not matter; offsets are mapped back to the original text. The automaton holds every run of
``SEED`` consecutive words of every item that is the item's own. Hits of one item that follow each other in both texts
are chained over short gaps, where words were changed; a chain of enough item words is a passage.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import spread


#: Words in a pattern; a passage needs WORDS of its item's words in order, of which at least DENSE stand unchanged;
#: GAP is the longest run of changed words inside a passage, LONG the length of a changed word.
SEED, WORDS, DENSE, GAP, LONG = 3, 11, 0.6, 4, 14
#: A pattern in this many items, or in this share of its benchmark's items, is a standing instruction, not an item's own.
SHARED, SHARED_PART = 3, 0.02

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10}\d?);")
_MARKUP = re.compile(r"</?[A-Za-z][A-Za-z0-9]{0,9}(?:\s[^<>]{0,300})?/?>|\\[nrt](?![a-z_])|\\u[0-9a-fA-F]{4}")
_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")
_LOWER = bytes(range(256)).lower()
_DROP = bytes(b for b in range(256) if not (b < 128 and chr(b).isalnum()))


def _blank(match: re.Match) -> str:
    """What replaces markup: blanks, except letters that an entity or escape stands for; the length never changes."""
    found = match.group(0)
    kept = html.unescape(found) if found[0] == "&" else ""
    kept = kept if len(kept) == 1 and kept.isalnum() else ""
    return kept + " " * (len(found) - len(kept))


def cleaned(text: str) -> str:
    """Markup blanked out, letter for letter: offsets stay those of the text."""
    if "&" in text:
        text = _ENTITY.sub(_blank, text)
    if "<" in text or "\\" in text:
        text = _MARKUP.sub(_blank, text)
    return text


def stream(text: str) -> str:
    """The letters and digits of a text in compatible form and lower case."""
    text = cleaned(text)
    if text.isascii():
        return text.encode().translate(_LOWER, _DROP).decode()
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def offsets(text: str) -> list[int]:
    """For each position of ``stream(text)``, the position in the text it comes from, and the text's length."""
    places: list[int] = []
    for at, char in enumerate(cleaned(text)):
        places += [at] * (len(_OTHER.sub("", unicodedata.normalize("NFKC", char).casefold())))
    return [*places, len(text)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", cleaned(text)).casefold())


class Items:
    """The automaton of a fixed benchmark: patterns to (item, word position), and each item's word offsets."""

    def __init__(self, rows: list[tuple[int, str | None, str]]):
        texts = [(item, name, words_of(text)) for item, name, text in rows if text]
        inside: Counter = Counter()
        per: Counter = Counter()
        for _, name, words in texts:
            per[name] += 1
            inside.update({(name, *words[p : p + SEED]) for p in range(len(words) - SEED + 1)})
        everywhere: Counter = Counter()
        for (_, *seed), n in inside.items():
            everywhere[tuple(seed)] += n
        self.starts: dict[int, list[int]] = {}
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, name, words in texts:
            starts = [0]
            for w in words:
                starts.append(starts[-1] + len(w))
            self.starts[item] = starts
            for p in range(len(words) - SEED + 1):
                seed = tuple(words[p : p + SEED])
                if everywhere[seed] >= SHARED and inside[(name, *seed)] >= SHARED_PART * per[name]:
                    continue
                places["".join(seed)].append((item, p))
        self.automaton = ahocorasick.Automaton()
        for pattern, at in places.items():
            self.automaton.add_word(pattern, (len(pattern), at))
        if len(places):
            self.automaton.make_automaton()
        self.empty = not places

    def passages(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, item words matched, item words spanned, start, end) of the longest passage of each item; start and end
        are positions in ``stream(text)``."""
        if self.empty:
            return []
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for end, (length, at) in self.automaton.iter(stream(text)):
            start = end + 1 - length
            for item, p in at:
                hits[item].append((start, p, end + 1))
        found = []
        for item, own in hits.items():
            best = chain(own, self.starts[item])
            if best and best[1] >= WORDS and best[0] >= DENSE * best[1]:
                found.append((item, *best))
        return found


def chain(hits: list[tuple[int, int, int]], starts: list[int]) -> tuple[int, int, int, int] | None:
    """(words matched, words spanned, start, end) of the best chain of (stream start, word position, stream end) hits.

    Hits on one diagonal are a run. A run may follow another if it skips at most GAP words of the item and the stream
    between them has room for about as many words: each skipped word may have become one of up to LONG characters, or
    one such word have been put in. More than one skipped word need longer runs on both sides, and a chain with such a
    gap WORDS - 1 words in all. So what a chain holds stands in the text as it stands in the item, changed words
    aside; words that only occur near each other do not chain.
    """
    runs: list[list[int]] = []  # word from, word to, start, end
    open_: dict[int, list[int]] = {}
    for start, p, end in sorted(hits):
        diagonal = start - starts[p]
        run = open_.get(diagonal)
        if run and p <= run[1]:
            run[1], run[3] = max(run[1], p + SEED), max(run[3], end)
        else:
            open_[diagonal] = run = [p, p + SEED, start, end]
            runs.append(run)
    runs.sort(key=lambda r: (r[2], r[0]))
    states: list[tuple[int, int, int, bool]] = []  # matched, first word, start, wide gap
    best = None
    low = 0
    longest = max((e - s for _, _, s, e in runs), default=0) + LONG * (GAP + 1)
    for k, (a, b, s, e) in enumerate(runs):
        state = (b - a, a, s, False)
        while low < k and runs[low][2] < s - longest:
            low += 1
        for j in range(low, k):
            pa_, pb, ps, pe = runs[j]
            gap = a - pb
            if pa_ >= a or pb >= b or gap > GAP or gap > 1 and min(b - a, pb - pa_) < gap + 2:
                continue
            if gap < 0:  # both runs hold the same words of the item: they must be the same in the text, a word put in aside
                fits = gap >= 1 - SEED and starts[pb] - starts[a] >= pe - s >= starts[pb] - starts[a] - LONG
            else:
                fits = 0 <= s - pe <= max(starts[a] - starts[pb], LONG)
            if fits:
                grown = states[j][0] + b - max(a, pb)
                if grown > state[0]:
                    state = (grown, states[j][1], states[j][2], states[j][3] or gap > 1)
        states.append(state)
        if (best is None or state[0] > best[0]) and not (state[3] and state[0] < WORDS - 1):
            best = (state[0], b - state[1], state[2], e)
    return best


_ITEMS: dict[int, Items] = {}


def items_of(rows: list, key: int) -> Items:
    if key not in _ITEMS:
        _ITEMS.clear()
        _ITEMS[key] = Items(rows)
    return _ITEMS[key]


SCHEMA = "item_id long, doc_id long, words int, span int, start long, end long, passage string"


def leaks(documents: DataFrame, benchmark: DataFrame, most_items: int = 100_000) -> DataFrame:
    """(item_id, doc_id, words, span, start, end, passage): each item and document with a passage of the item, once.

    The longest passage is reported, with its place in the original text. The benchmark is a fixed table, sent to every
    worker; more than ``most_items`` rows raise. Null and empty texts on either side match nothing, as do items of
    fewer than twelve words. Repeated documents are reported each; items repeated under one id count as one text list.
    """
    rows = benchmark.select("item_id", "benchmark_name", "text").where("item_id is not null and text is not null").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError("the benchmark is too large for one automaton")
    plain = sorted((r.item_id, r.benchmark_name or "", r.text) for r in rows)
    shared = documents.sparkSession.sparkContext.broadcast(plain)
    key = hash(tuple(plain))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(shared.value, key)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                passages = items.passages(text)
                if passages:
                    places = offsets(text)
                    for item, matched, span, start, end in sorted(passages):
                        # where characters combine, the stream may be shorter than its parts: stay inside the text
                        a = places[min(start, len(places) - 1)]
                        b = min(len(text), places[min(end, len(places)) - 1] + 1)
                        out.append((item, doc, matched, span, a, b, text[a:b]))
            columns = list(zip(*out)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "doc_id", "words", "span", "start", "end", "passage"])

    return spread(documents.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")).mapInArrow(scan, SCHEMA)


def leaked_items(found: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per benchmark item: the number of documents that hold a passage of it, and the longest one's words (0 if none)."""
    per = found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest"))
    return benchmark.select("item_id", "benchmark_name", "task").join(per, "item_id", "left").na.fill(0, ["documents", "longest"])
