"""Text statistics per document, as mergeable partial counts, and a verdict whether a text is running prose.

A huge text is split into chunks that are counted in parallel. What a chunk cannot know, whether a word, a sentence end or
a line goes on across its ends, is carried as a boundary state of bounded size; neighbours are merged, FAN at a time, in
a tree until one state is left. Texts of one chunk take the same counts in one pass. Ratios and rules are Spark
expressions over the counts; no rule depends on the words of a language.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, spread

CHUNK, FAN = 65_536, 16

#: Frequent function words of some European languages. They make the reported share of common words; the
#: verdict does not use it.
COMMON = frozenset("""
the a an and or of to in is was it that for on with as at by this be are were had has have not but from they we you he she his her their
our its which who what when if so than then there would could can will may must only one all some each every no do does did been into them
der die das und ist ein eine einen einem einer dem den des nicht mit von zu auf für im am er sie es man aber wie wenn dann als auch nach bei
aus wird hat war sich ich wir ihr daß dass oder um durch über
le la les un une et est de des du dans en il elle on que qui ne pas avec sur pour mais quand au aux ce sa son sans par nous vous cette se plus
el los las y es del una por con para su al lo como más pero sus o si sin sobre no
di che il lo gli per con non si della dei nel alla sono è anche
e do da os as em um uma não na no dos das ao
het een van dat zijn op te voor niet met aan er ook maar
""".split())

def _mark_ranges() -> str:
    """The combining marks of Unicode's basic plane as ranges of a character class: they belong to the letter before them."""
    marks = [c for c in range(0x300, 0xFFFF) if unicodedata.category(chr(c))[0] == "M"]
    first = [c for c, before in zip(marks, [-1, *marks]) if c != before + 1]
    last = [c for c, after in zip(marks, [*marks[1:], -1]) if c + 1 != after]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


_LETTER, _MARKS = r"[^\W\d_]", _mark_ranges()
_CLOSE = r"[\"'”’»«)\]*_]{0,8}"
_LETTERS = re.compile(f"{_LETTER}+")
_WORD = re.compile(f"(?<!{_LETTER})(?<![{_MARKS}]){_LETTER}+(?:[{_MARKS}]+{_LETTER}*)*")
#: Sentence ends: marks before white space, closing quotes between them aside, or marks of scripts that set no space. An
#: ellipsis ends no sentence. Every pattern is bounded, so what starts in one place is settled REACH characters later.
_TERM = re.compile(rf"(?<![.!?…])[.!?]{{1,8}}{_CLOSE}(?=\s|\Z)|[。！？।॥؟۔።։။។]")
_DOTS = re.compile(rf"(?<![.!?…])\.{{2,8}}{_CLOSE}(?=\s|\Z)")
_CAPITALS = re.compile(rf"(?<!{_LETTER})[A-Z]{{2,24}}(?!{_LETTER})")
REACH = 48
#: Quotation marks belong to dialogue and are no symbols.
_SYMBOL = re.compile(rf"[^\w\s\"'“”‘’„‚«»‹›「」『』{_MARKS}]|_")
_DIGIT = re.compile(r"\d")
#: Letters of scripts that write words without spaces: two of them stand for a word. Thai and Lao mark no sentence ends.
_DENSE = re.compile(r"[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
_UNMARKED = re.compile(r"[\u0e00-\u0eff]")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_BULLET = re.compile(r"(?:[-*•·+–—‣◦▪●○]|\(?\d{1,4}[.)]|\(?[A-Za-z][.)])(?:\s|\Z)")
#: A line of dialogue may begin with a long dash; it ends a sentence.
_SPEECH = re.compile(r"[–—―]")
_ENDED = re.compile(r"(?<![.…])[.!?:;。！？।॥؟۔።։။។][\"'”’»«)\]*_]*\Z")
_SPOKEN = re.compile(r"[.!?…。！？][\"'”’»«)\]*_]*\Z")
_CLIPPED = re.compile(r"(?:\.\.\.|…|\[…\]|\[\.\.\.\]|»|\|)\Z")

#: Counts over characters, over places where something starts, and over lines.
CHAR = ["chars", "letters", "symbols", "digits", "dense", "unmarked"]
START = ["words", "common", "sentences", "capitals"]
LINE = ["lines", "ended_lines", "clipped_lines", "listed_chars", "tabled_chars", "line_chars", "short_lines"]
COUNTS = CHAR + START + LINE


def tidy(text: str) -> str:
    """Leading marks dropped and line ends as LF."""
    text = text.lstrip("﻿")
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def added(*counts: list[int]) -> list[int]:
    return [sum(x) for x in zip(*counts)]


def char_counts(text: str, runs: list[str] | None = None) -> list[int]:
    runs = _LETTERS.findall(text) if runs is None else runs
    dense = unmarked = 0
    if not text.isascii():
        dense, unmarked = len(_DENSE.findall(text)), len(_UNMARKED.findall(text))
    return [len(text), sum(map(len, runs)), len(_SYMBOL.findall(text)), len(_DIGIT.findall(text)), dense, unmarked]


def start_counts(text: str, runs: list[str] | None = None) -> list[int]:
    """Counts of what starts anywhere in a complete text; in plain ASCII the words are the runs of letters."""
    words = runs if runs is not None and text.isascii() else _WORD.findall(text)
    return [len(words), sum(map(COMMON.__contains__, map(str.lower, words))), len(_TERM.findall(text)) - len(_DOTS.findall(text)), len(_CAPITALS.findall(text))]


def starts_between(text: str, low: int, high: int) -> list[int]:
    """Counts of what starts in text[low:high]; the rest of text is its surroundings."""
    at = [[m for m in pattern.finditer(text) if low <= m.start() < high] for pattern in (_WORD, _TERM, _DOTS, _CAPITALS)]
    return [len(at[0]), sum(m.group(0).lower() in COMMON for m in at[0]), len(at[1]) - len(at[2]), len(at[3])]


def line_counts(start: str, end: str, length: int, pipes: int, tabs: int, gaps: int) -> list[int]:
    """Counts of one closed line, from its first and last visible characters and its totals."""
    if not start:
        return [0] * len(LINE)
    listed = bool(_BULLET.match(start)) and not (_SPEECH.match(start) and _SPOKEN.search(end))
    tabled = not listed and (pipes >= 2 or tabs >= 1 or gaps >= 2 or (pipes == 1 and length < 80))
    return [1, int(bool(_ENDED.search(end))), int(bool(_CLIPPED.search(end))), length if listed else 0, length if tabled else 0, length, int(length < 40)]


EDGE = 12


def lines_of(text: str) -> list[int]:
    total = [0] * len(LINE)
    for line in text.split("\n"):
        body = line.strip()
        if body:
            total = added(total, line_counts(body[:EDGE], body[-EDGE:], len(body), body.count("|"), body.count("\t"), len(_GAP.findall(body)) if "  " in body else 0))
    return total


def whole(text: str) -> list[int]:
    """All counts of a complete text, in the order of COUNTS."""
    runs = _LETTERS.findall(text)
    return char_counts(text, runs) + start_counts(text, runs) + lines_of(text)


# ---- boundary state: what starts near the ends of a piece of text

def _run(text: str) -> dict:
    """A short piece is kept as it stands; of a longer one, what starts at its first place or within REACH of its end is
    not settled, and both ends are kept."""
    if len(text) <= 2 * REACH + 2:
        return {"raw": text}
    return {"counts": starts_between(text, 1, len(text) - REACH), "left": text[:REACH], "right": text[-REACH - 1 :]}


def _run_join(a: dict, b: dict) -> dict:
    if "raw" in a and "raw" in b:
        return _run(a["raw"] + b["raw"])
    if "raw" in a:
        seam = a["raw"] + b["left"]
        return b | {"counts": added(b["counts"], starts_between(seam, 1, len(a["raw"]) + 1)) if a["raw"] else b["counts"], "left": seam[:REACH]}
    if "raw" in b:
        seam = a["right"] + b["raw"]
        return a | {"counts": added(a["counts"], starts_between(seam, 1, len(seam) - REACH)), "right": seam[-REACH - 1 :]}
    return {"counts": added(a["counts"], b["counts"], starts_between(a["right"] + b["left"], 1, REACH + 2)), "left": a["left"], "right": b["right"]}


def _run_close(run: dict) -> list[int]:
    if "raw" in run:
        return start_counts(run["raw"])
    return added(run["counts"], starts_between(run["left"], 0, 1), starts_between(run["right"], 1, REACH + 1))


# ---- boundary state: a piece of one line

def _blank(text: str) -> dict:
    """White space: its length, tabs, whether it is blanks alone, and its first and last EDGE characters."""
    return {"n": len(text), "tabs": text.count("\t"), "plain": not text.strip(" "), "text": text if len(text) <= 2 * EDGE else text[:EDGE] + text[-EDGE:]}


def _blank_join(a: dict, b: dict) -> dict:
    text = a["text"] + b["text"]
    return {"n": a["n"] + b["n"], "tabs": a["tabs"] + b["tabs"], "plain": a["plain"] and b["plain"], "text": text if len(text) <= 2 * EDGE else text[:EDGE] + text[-EDGE:]}


def _piece(text: str) -> dict:
    """A piece of a line: the ends and totals of what is visible, and the white space around it."""
    body = text.strip()
    lead = len(text) - len(text.lstrip()) if body else len(text)
    return {"start": body[:EDGE], "end": body[-EDGE:], "length": len(body), "pipes": body.count("|"), "tabs": body.count("\t"), "gaps": len(_GAP.findall(body)), "lead": _blank(text[:lead]), "trail": _blank(text[lead + len(body) :])}


def _piece_join(a: dict, b: dict) -> dict:
    """Two neighbouring pieces of one line as one."""
    if not a["length"]:
        return b | {"lead": _blank_join(a["lead"], b["lead"])}
    if not b["length"]:
        return a | {"trail": _blank_join(a["trail"], b["lead"])}
    between = _blank_join(a["trail"], b["lead"])
    start = (a["start"] + between["text"] + b["start"])[:EDGE] if a["length"] < EDGE else a["start"]
    end = (a["end"] + between["text"] + b["end"])[-EDGE:] if b["length"] < EDGE else b["end"]
    gap = int(between["n"] >= 2 and between["plain"])
    return {"start": start, "end": end, "length": a["length"] + between["n"] + b["length"], "pipes": a["pipes"] + b["pipes"], "tabs": a["tabs"] + b["tabs"] + between["tabs"], "gaps": a["gaps"] + b["gaps"] + gap, "lead": a["lead"], "trail": b["trail"]}


def _piece_close(piece: dict) -> list[int]:
    return line_counts(*(piece[k] for k in ("start", "end", "length", "pipes", "tabs", "gaps")))


# ---- the state of a chunk

def partial(text: str) -> dict:
    """The state of a chunk: counts of its characters and complete lines, and what its ends leave open."""
    state = {"chars": char_counts(text), "run": _run(text)}
    head, newline, rest = text.partition("\n")
    if not newline:
        return state | {"open": _piece(text)}
    body, _, tail = rest.rpartition("\n")
    return state | {"head": _piece(head), "lines": lines_of(body), "tail": _piece(tail)}


def merge(a: dict, b: dict) -> dict:
    """The state of two neighbouring chunks."""
    state = {"chars": added(a["chars"], b["chars"]), "run": _run_join(a["run"], b["run"])}
    if "open" in a and "open" in b:
        return state | {"open": _piece_join(a["open"], b["open"])}
    if "open" in a:
        return state | {"head": _piece_join(a["open"], b["head"]), "lines": b["lines"], "tail": b["tail"]}
    if "open" in b:
        return state | {"head": a["head"], "lines": a["lines"], "tail": _piece_join(a["tail"], b["open"])}
    return state | {"head": a["head"], "lines": added(a["lines"], b["lines"], _piece_close(_piece_join(a["tail"], b["head"]))), "tail": b["tail"]}


def finish(state: dict) -> list[int]:
    lines = _piece_close(state["open"]) if "open" in state else added(state["lines"], _piece_close(state["head"]), _piece_close(state["tail"]))
    return state["chars"] + _run_close(state["run"]) + lines


def merged(states: list[dict]) -> dict:
    while len(states) > 1:
        states = [merge(*states[i : i + 2]) if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return states[0]


# ---- operator

_FIELDS = ", ".join(f"{c} long" for c in COUNTS)


def text_counts(documents: DataFrame, ident: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, counts...) of each document with a non-null text; an empty text counts 0 everywhere.

    One scan counts short texts and cuts long ones into chunks; what it gives, counts and chunks of long texts alone, is
    written to the checkpoint folder. Repeated ids and repeated rows are counted each. A null id stays null. Columns but
    the two named are not read.
    """
    rows = documents.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null")
    names = ["doc_id", "row", "part", "text", *COUNTS]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, counts = [], []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                body = tidy(raw)
                if len(body) <= chunk:
                    docs.append(doc)
                    counts.append(whole(body))
                    continue
                key = int.from_bytes(hashlib.blake2b(f"{doc}\n{body}".encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)
                cuts = range(0, len(body), chunk)
                n = len(cuts)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([body[i : i + chunk] for i in cuts], pa.string()), *[pa.nulls(n, pa.int64()) for _ in COUNTS]], names)
            n = len(docs)
            columns = list(zip(*counts)) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = [json.dumps(partial(t)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(states, pa.string())], ["doc_id", "row", "part", "state"])

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        # equal rows (one id, one text) meet here: each part comes once a copy, and so does the result
        copies = int((frame["part"] == frame["part"].iloc[0]).sum())
        frame = frame.drop_duplicates("part").sort_values("part")
        state = json.dumps(merged([json.loads(s) for s in frame["state"]]))
        return pd.DataFrame({"doc_id": [frame["doc_id"].iloc[0]] * copies, "row": frame["row"].iloc[0], "part": frame["part"].iloc[0] // FAN, "state": state})

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*[finish(json.loads(s)) for s in batch.column(3).to_pylist()])) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", *COUNTS])

    scanned = cut(spread(rows).mapInArrow(scan, f"doc_id long, row long, part long, text string, {_FIELDS}"))
    schema = "doc_id long, row long, part long, state string"
    parts = scanned.where("part is not null").select("doc_id", "row", "part", "text")
    states = parts.repartition("doc_id", "row", "part").mapInArrow(count, schema)
    # three levels join up to FAN ** 3 chunks (268 million characters), the last one whatever is left: states are small
    for level in range(3):
        key = F.floor(F.col("part") / FAN).alias("group") if level < 2 else F.lit(0).alias("group")
        states = states.groupBy("doc_id", "row", key).applyInPandas(lambda frame: join(frame), schema)
    return scanned.where("part is null").select("doc_id", *COUNTS).unionByName(states.mapInArrow(close, f"doc_id long, {_FIELDS}"))


def _share(part: str, of: str) -> Column:
    return F.coalesce(F.col(part) / F.expr(f"nullif({of}, 0)"), F.lit(0.0))


#: The rules' bounds. Running text ends a sentence every few to a few dozen words; one sentence more than counted is
#: granted, so that a single long one is no case. Letters standing alone (MOST words of them) are no words.
FEWEST_ENDS, MOST_ENDS, MOST_LISTED, MOST_TABLED, MOST_CLIPPED, MOST_SYMBOLS, MOST_DIGITS = 0.025, 1.0, 0.5, 0.5, 0.7, 0.2, 0.25
LEAST_LENGTH, MOST = 1.5, 10


def statistics(counts: DataFrame) -> DataFrame:
    """Ratios beside the counts, one boolean per rule, and ``prose``: whether no rule speaks against running prose.

    The rules count marks, lines and characters and know no language: words of scripts without spaces are counted as two
    letters each, and a script that marks no sentence ends is not asked for any. A text without any visible character
    has prose null: it is no case.
    """
    ratios = counts.withColumns({
        "mean_word_length": _share("letters", "words"),
        "common_share": _share("common", "words"),
        "symbol_ratio": _share("symbols", "chars"),
        "digit_ratio": _share("digits", "chars"),
        "running_words": F.col("words") + F.col("dense") / 2,
        "ended_share": _share("ended_lines", "lines"),
        "clipped_share": _share("clipped_lines", "lines"),
        "listed_share": _share("listed_chars", "line_chars"),
        "tabled_share": _share("tabled_chars", "line_chars"),
    }).withColumn("sentence_rate", _share("sentences", "running_words"))
    marked = F.col("unmarked") * 2 <= F.col("letters")
    rules = {
        "no_sentences": marked & ((F.col("sentences") <= 0) | (F.col("sentences") + 1 < F.col("running_words") * FEWEST_ENDS)),
        "broken_sentences": F.col("sentence_rate") > MOST_ENDS,
        "spaced_letters": (F.col("words") > MOST) & (F.col("mean_word_length") < LEAST_LENGTH),
        "is_list": F.col("listed_share") > MOST_LISTED,
        "is_table": F.col("tabled_share") > MOST_TABLED,
        "is_clipped": F.col("clipped_share") > MOST_CLIPPED,
        "is_symbols": F.col("symbol_ratio") > MOST_SYMBOLS,
        "is_numbers": F.col("digit_ratio") > MOST_DIGITS,
    }
    against = F.lit(False)
    for rule in rules:
        against = against | F.col(rule)
    return ratios.withColumns(rules).withColumn("prose", F.when(F.col("lines") > 0, ~against))
