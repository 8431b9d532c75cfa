"""Chat traces as training rows: formats, parts, drop reasons and the ordered chain that decides what is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators.curation import cap_equals, keep_first, overlaps
from millrace.session import cut

#: A chat row: its format, and its messages with role, content and, in one format, the reasoning apart.
MESSAGES = "array<struct<role: string, content: string, reasoning_content: string>>"

#: A file listing (its name on a line, then a fenced block), the request that follows a problem in the
#: editing format, and a heading that ends a text.
LISTING = r"(?sm)^(\S+\.\w+)\n```[^\n]*\n(.*?)\n```"
EDIT_REQUEST = "\n####\n\nUse the above instructions to modify the supplied files:"
LAST_HEADING = r"\n#{1,6} [^\n]*\s*\z"

#: Stock instructions around a problem, which do not belong to it.
WRAPPERS = [
    r"You are a helpful and harmless assistant\. You should think step-by-step before responding to the instruction below\.",
    r"Please use \S+ programming language only\.",
    r"You must use ```\w+ for just the final solution code block with the following format:\s*```\w+\s*\S+ Your code here\s*```",
    r"Write (?:Python|C\+\+) code to solve the problem\.",
    r"Solve the problem starting with the provided function header\.\s*Function header:\s*```[\s\S]*?```",
    r"Please place the solution code in the following format:\s*```\w+\s*# Your solution code here\s*```",
]

#: The reasons for which a row is dropped, in the order in which they are asked.
REASONS = ["no_reasoning", "no_answer", "short_reasoning", "over_length", "contaminated", "duplicate", "capped"]


def problem_key(prompt: Column) -> Column:
    """A prompt's problem, the unit of the split: without wrappers, in lower case, its letters and digits as words joined by
    one blank."""
    return X.problem_key(F.regexp_replace(prompt, "|".join(WRAPPERS), " "))


def _wants(rows: Column, roles: list[str], what: str, then: Column) -> Column:
    """``then`` if the messages have these roles, else an error at run time."""
    fits = F.transform(rows, lambda m: m["role"]) == F.array(*map(F.lit, roles))
    return F.when(F.coalesce(fits, F.lit(False)), then).otherwise(F.raise_error(F.concat(F.lit(f"{what}: no row of "), F.lit(", ".join(roles)))).cast("struct<prompt: string, reasoning: string, answer: string>"))


def _parts(prompt: Column, reasoning: Column, answer: Column) -> Column:
    return F.struct(prompt.alias("prompt"), reasoning.alias("reasoning"), answer.alias("answer"))


def _content(rows: Column, at: int) -> Column:
    return F.get(rows, F.lit(at))["content"]


def _thinking(prompt: Column, reply: Column) -> Column:
    """Reasoning between a leading mark and the first closing one; without both there is none."""
    return _parts(prompt, X.reasoning(reply), X.answer(reply))


def parts_of(kind: Column, messages: Column) -> Column:
    """(prompt, reasoning, answer) of a chat row by its format; a part that the row lacks is null. A row outside its format's
    structure is an error at run time, an unknown format gives null."""
    pair = ["user", "assistant"]
    tagged = _wants(messages, pair, "tagged", _thinking(_content(messages, 0), _content(messages, 1)))
    apart = _wants(messages, pair, "apart", _parts(_content(messages, 0), F.get(messages, F.lit(1))["reasoning_content"], _content(messages, 1)))
    turns = _wants(messages, ["human", "gpt"], "turns", _thinking(_content(messages, 0), _content(messages, 1)))
    stub, request, reply = (_content(messages, k) for k in (5, 7, 8))
    listed, shown = F.regexp_instr(stub, F.lit(LISTING)), F.regexp_instr(reply, F.lit(LISTING))
    statement = F.substring_index(request, EDIT_REQUEST, 1)
    prompt = F.concat(X.strip(F.substr(stub, listed)), F.lit("\n\n"), X.strip(statement))
    prose = F.regexp_replace(F.regexp_replace(F.substr(reply, F.lit(1), shown - 1), r"(?U)\s+\z", ""), LAST_HEADING, "")
    code = F.concat(F.lit("```python\n"), F.regexp_extract(reply, LISTING, 2), F.lit("\n```"))
    none = F.lit(None).cast("string")
    edits = F.when((F.size(messages) == 9) & (listed > 0), F.when(shown > 0, _parts(prompt, prose, code)).otherwise(_parts(prompt, F.lit("none"), none))).otherwise(F.raise_error(F.lit("edits: no nine messages with a listing")).cast("struct<prompt: string, reasoning: string, answer: string>"))
    return F.when(kind == "tagged", tagged).when(kind == "apart", apart).when(kind == "edits", edits).when(kind == "turns", turns)


def parsed(rows: DataFrame, kind: str = "kind", messages: str = "messages") -> DataFrame:
    """rows plus (prompt, reasoning, answer, carriage, reason): parts with LF line ends and nothing around them, whether any held
    a CR, and the first reason of structure: ``no_reasoning`` or ``no_answer``, else null.

    Null messages are no row of any format: an error. A part that is empty after all is as good as absent.
    """
    found = rows.withColumn("_p", parts_of(F.col(kind), F.col(messages)))
    raw = [F.col(f"_p.{n}") for n in ("prompt", "reasoning", "answer")]
    clean = [X.strip(F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))) for c in raw]
    whole = raw[1].isNotNull() & raw[2].isNotNull()
    carriage = whole & F.exists(F.array(*raw), lambda c: F.coalesce(F.contains(c, F.lit("\r")), F.lit(False)))
    reason = F.when(F.coalesce(clean[1], F.lit("")) == "", "no_reasoning").when(F.coalesce(clean[2], F.lit("")) == "", "no_answer")
    parts = {n: F.when(reason.isNull(), c) for n, c in zip(("prompt", "reasoning", "answer"), clean)}
    return found.withColumns(parts | {"reason": reason, "carriage": F.coalesce(carriage & reason.isNull(), F.lit(False))}).drop("_p")


def measured(rows: DataFrame, size, ident: str, tests: DataFrame, least: int, most: int) -> DataFrame:
    """(ident, group, prompt_key, problem, text_key, reason, context, length) of ``parsed`` rows: sizes by ``size``, each part alone, and
    the first of all reasons that concern a row by itself. Digests stand for texts from here on."""
    context, thought, rest = (size(c) for c in (F.concat("prompt", F.lit(X.THINK)), F.col("reasoning"), F.concat(F.lit(X.END_THINK), F.col("answer"))))
    sized = rows.withColumns({"context": context, "thought": thought}).withColumn("length", F.col("context") + F.col("thought") + rest)
    text = F.concat_ws("\n", "prompt", "reasoning", "answer")
    key = F.concat("prompt", F.lit(X.THINK), "reasoning", F.lit(X.END_THINK), "answer")
    narrow = cut(sized.select(ident, "group", "carriage", F.sha1("prompt").alias("prompt_key"), F.sha1(problem_key(F.col("prompt"))).alias("problem"), F.sha1(key).alias("text_key"), "context", "length", F.coalesce("reason", F.when(F.col("thought") < least, "short_reasoning").when(F.col("length") + 2 > most, "over_length")).alias("reason"), F.when(F.col("reason").isNull(), text).alias("_text")))
    hit = overlaps(narrow.where("reason is null"), tests, ident, "_text").select(ident, F.lit(True).alias("_hit"))
    return narrow.drop("_text").join(hit, ident, "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_hit"), "contaminated"))).drop("_hit")


def decided(rows: DataFrame, ident: str, caps: dict[str, int | None], seed: int) -> DataFrame:
    """``measured`` rows with their final ``reason`` (null for those kept): repeats of an earlier text, then all but a group's
    cap of the rows of one prompt, in seeded order. Neither a text nor a prompt meets in one task."""
    rows = cut(rows)
    alive = rows.where("reason is null").select(ident, "group", "prompt_key", "text_key")
    first = keep_first(alive, ["text_key"], [ident])
    capped = F.coalesce(F.col("group").isin([g for g, n in caps.items() if n is not None]), F.lit(False))  # a null group is not
    kept = first.where(~capped).select(ident)
    for cap in sorted({n for n in caps.values() if n is not None}):
        mine = first.where(F.col("group").isin([g for g, n in caps.items() if n == cap]))
        kept = kept.unionByName(cap_equals(mine, ["group", "prompt_key"], ident, cap, seed).select(ident))
    fate = first.select(ident, F.lit(True).alias("_first")).join(kept.withColumn("_kept", F.lit(True)), ident, "left")
    joined = rows.join(fate, ident, "left")
    return joined.withColumn("reason", F.coalesce("reason", F.when(F.col("_first").isNull(), "duplicate").when(F.col("_kept").isNull(), "capped"))).drop("_first", "_kept")
