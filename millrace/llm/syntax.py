"""Programs that are not valid in their language, by parsing with derivatives, and their rates by repository.

Every text is cut into token kinds and read by the memoised derivative parser of its language. An empty derivative marks
the failing token; a language that does not end with the text marks truncation. No other parser has a say in the verdict.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.names import repository_key
from millrace.llm import lexers
from millrace.session import spread


def verdict(text: str, language: str) -> tuple[str, int | None, str | None]:
    """(``valid``, ``error`` or ``truncated``; line and spelling of the failing token of an error)."""
    text = lexers.normalized(text)
    parser = lexers.parser(language)
    if language == "Python":
        at, accepted = parser.read(lexers.python_stretches(text))
        if accepted:
            return "valid", None, None
        return ("truncated", None, None) if at < 0 else ("error", *lexers.python_place(text, at))
    at, accepted = parser.read(lexers.cpp_stretches(text))
    if accepted or "#" in text and parser.read(lexers.cpp_stretches(text, last_branch=True))[1]:
        return "valid", None, None
    return ("truncated", None, None) if at < 0 else ("error", *lexers.cpp_place(text, at))


LANGUAGES = ("Python", "C++")


def programs(repository_files: DataFrame, code_functions: DataFrame, completions: DataFrame) -> DataFrame:
    """(record_table, record_id, repository, lang, text) of all programs; completions have no repository."""
    def part(frame: DataFrame, name: str, ident: str, text: str, repo) -> DataFrame:
        return frame.select(F.lit(name).alias("record_table"), F.col(ident).cast("long").alias("record_id"), repo.alias("repository"), "lang", F.col(text).alias("text"))

    key = repository_key(F.col("repo_name"))
    files = spread(part(repository_files, "repository_files", "file_id", "content", key))
    return files.unionByName(part(code_functions, "code_functions", "function_id", "content", key)).unionByName(part(completions, "completions", "completion_id", "text", F.lit(None).cast("string")))


SCHEMA = "record_table string, record_id long, repository string, lang string, verdict string, line int, token string"


def parse(rows: DataFrame) -> DataFrame:
    """Each program of ``programs`` with its verdict and, for an error, the line and spelling of the failing token.

    A null text, and a language other than Python and C++ (null included), has a null verdict: no case. An empty text
    is valid. Repeated rows are judged each.
    """
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = [verdict(text, lang) if text is not None and lang in LANGUAGES else (None, None, None) for lang, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            verdicts, lines, tokens = zip(*results) if results else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(lines, pa.int32()), pa.array(tokens, pa.string())], ["record_table", "record_id", "repository", "lang", "verdict", "line", "token"])

    return rows.mapInArrow(judge, SCHEMA)


def rates(judged: DataFrame) -> DataFrame:
    """By repository and lang: programs, how many fail at a token or are cut short, and their rate."""
    cases = judged.where("verdict is not null").groupBy("repository", "lang").agg(F.count("*").alias("programs"), F.count_if(F.col("verdict") == "error").alias("errors"), F.count_if(F.col("verdict") == "truncated").alias("truncated"))
    return cases.withColumn("rate", F.round((F.col("errors") + F.col("truncated")) / F.col("programs"), 6))
