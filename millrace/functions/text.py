"""Text expressions of the corpus: line ends, identities, rendering, reasoning and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK, END_THINK = "<think>", "</think>"


def normalize_lines(text: Column) -> Column:
    """Leading U+FEFF marks dropped; CR LF and CR as LF. Null stays null."""
    bare = F.regexp_replace(text, "^﻿+", "")
    return F.replace(F.replace(bare, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def content_id(text: Column) -> Column:
    """SHA-1 hex of the UTF-8 bytes."""
    return F.sha1(text)


def path_comment(path: Column, body: Column, language: Column) -> Column:
    """The body under a comment line that names its path; CR and LF in the path are spelled out, one final LF of the
    body is dropped, and a C++ path ending in a backslash gets a line of its own so that it continues nothing."""
    safe = F.replace(F.replace(path, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    text = F.regexp_replace(body, r"\n\z", "")
    extra = F.when(F.endswith(safe, F.lit("\\")), F.lit("\n")).otherwise(F.lit(""))
    return F.when(language == "C++", F.concat(F.lit("// "), safe, extra, F.lit("\n"), text, F.lit("\n"))).otherwise(F.concat(F.lit("# "), safe, F.lit("\n"), text, F.lit("\n")))


def file_text(path: Column, body: Column, language: Column) -> Column:
    """A file as a part of a document: under its path comment, a C++ text ending in a backslash with one line end more, so
    that it does not continue on the next file."""
    extra = F.when((language == "C++") & F.endswith(F.regexp_replace(body, r"\n\z", ""), F.lit("\\")), F.lit("\n")).otherwise(F.lit(""))
    return F.concat(path_comment(path, body, language), extra)


def strip(text: Column) -> Column:
    """White space of any kind dropped at both ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def reasoning(reply: Column) -> Column:
    """Text between a leading <think> and the first </think>; null if either is missing."""
    return F.when(F.regexp_like(reply, F.lit(r"(?s)\A\s*<think>.*</think>")), F.regexp_extract(reply, r"(?s)\A\s*<think>(.*?)</think>", 1))


def answer(reply: Column) -> Column:
    """Text after the first </think> of a reply that starts with <think>; null otherwise."""
    return F.when(F.regexp_like(reply, F.lit(r"(?s)\A\s*<think>.*</think>")), F.regexp_extract(reply, r"(?s)\A\s*<think>.*?</think>(.*)\z", 1))


def last_answer(reply: Column) -> Column:
    """Text after the last </think>, empty without one."""
    return F.when(F.contains(reply, F.lit(END_THINK)), F.substring_index(reply, END_THINK, -1)).otherwise(F.when(reply.isNotNull(), F.lit("")))


def words(text: Column) -> Column:
    """Runs without white space, in order; empty for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def problem_key(prompt: Column) -> Column:
    """Lower-case letters and digits, words joined by one blank."""
    return F.array_join(F.regexp_extract_all(F.lower(prompt), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def fenced_code(reply: Column) -> Column:
    """The last fenced block marked python, else the last one without a mark; null without either."""
    marked = F.regexp_extract_all(reply, F.lit(r"(?s)```(?:python|py)[ \t]*\n(.*?)```"), F.lit(1))
    plain = F.regexp_extract_all(reply, F.lit(r"(?s)```[ \t]*\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(marked, F.lit(-1)), F.try_element_at(plain, F.lit(-1)))


def stop_at(text: Column, stops: list[str]) -> tuple[Column, Column]:
    """(text before the earliest stop word, whether there was one)."""
    places = F.filter(F.array(*[F.instr(text, s) for s in stops]), lambda p: p > 0)
    first = F.array_min(places)
    return F.when(first.isNotNull(), F.substr(text, F.lit(1), first - 1)).otherwise(text), F.coalesce(first.isNotNull(), F.lit(False))


def overlong_penalty(length: Column, limit: float, cushion: float) -> Column:
    """0 up to ``limit - cushion``, then falling to -1 at ``limit``."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(0.0), (F.lit(limit) - F.lit(cushion) - length) / F.lit(cushion)))
