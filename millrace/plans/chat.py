"""Queries of chat traces, programs and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import programs as G
from millrace.functions import text as X
from millrace.functions.hashing import blake64
from millrace.operators import sequences as Q
from millrace.operators import traces as E
from millrace.operators.ranking import global_rank
from millrace.plans.curate import LF, SPACE, grams_sql, words_sql
from millrace.plans.registry import query
from millrace.session import spread

_STARTS = "regexp_matches(generation, '(?s)^\\s*<think>.*</think>')"
_REASON = f"case when {_STARTS} then regexp_extract(generation, '(?s)^\\s*<think>(.*?)</think>', 1) end"
_ANSWER = f"case when {_STARTS} then regexp_extract(generation, '(?s)^\\s*<think>.*?</think>(.*)$', 1) end"


@query("p07_parse_predicate")
def _(t):
    parsed = t("completions").where("lang = 'Python' and text is not null").select("completion_id", G.parse_outcome("text").alias("p"))
    return parsed.select("completion_id", "p.outcome", "p.line", "p.message")


def python_files(t):
    return spread(t("repository_files").where("lang = 'Python' and content is not null").select("file_id", X.normalize_lines(F.col("content")).alias("content")))


@query("p08_minimal_repair")
def _(t):
    """Whether each Python file parses as it is or after the fewest repairs, and whether it was changed."""
    rows = python_files(t).withColumn("fixed", G.repaired(F.col("content")))
    return rows.select("file_id", F.col("fixed").isNotNull().alias("parses"), (F.col("fixed") != F.col("content")).alias("changed"))


@query("p09_checked_files")
def _(t):
    rows = python_files(t).select("file_id", G.repaired(F.col("content")).alias("content"))
    return rows.where("content is not null").select("file_id", X.content_id(F.col("content")).alias("id"))


_LITERAL_REPAIRS = ["x = 1\n", "<NAME> = 1\n", "if x:\n\ty = 1\n        z = 2\n", "if <NAME>:\n\ty = 1\n        z = 2\n", "print 'x'\n", "  \tx = (\n"]


@query("p08_literal_repairs", "select * from (values (1, 'x = 1' || chr(10)), (2, 'NAME = 1' || chr(10)), (3, 'if x:' || chr(10) || '        y = 1' || chr(10) || '        z = 2' || chr(10)), (4, 'if NAME:' || chr(10) || '        y = 1' || chr(10) || '        z = 2' || chr(10)), (5, null), (6, null)) v(k, fixed)")
def _(t):
    """Files that need no repair, one, the other, both, and two that none helps."""
    rows = t.spark.createDataFrame([(k, x) for k, x in enumerate(_LITERAL_REPAIRS, 1)], "k int, content string")
    return rows.select("k", G.repaired(F.col("content")).alias("fixed"))


@query("p12_reasoning_split", f"select trace_id, sha1({_REASON}) as reasoning, sha1({_ANSWER}) as answer from raw_traces where generation is not null")
def _(t):
    g = F.col("generation")
    return t("raw_traces").where("generation is not null").select("trace_id", F.sha1(X.reasoning(g)).alias("reasoning"), F.sha1(X.answer(g)).alias("answer"))


def chat_rows(t):
    """Traces as chat rows of the four formats, by trace_id: tagged, apart, edits and turns."""
    kinds = F.array(*map(F.lit, ("tagged", "apart", "edits", "turns")))
    reply = F.coalesce("generation", F.lit(""))
    thought, answer = F.coalesce(X.reasoning(F.col("generation")), F.lit("")), F.coalesce(X.answer(F.col("generation")), F.lit(""))

    def message(role, content, reasoning=None):
        return F.struct(F.lit(role).alias("role"), content.alias("content"), (F.lit(None).cast("string") if reasoning is None else reasoning).alias("reasoning_content"))

    stub = F.lit("These are the files.\n\nmain.py\n```\npass\n```\n")
    listing = F.concat(thought, F.lit("\n\n### Solution Code\n\nmain.py\n```\n"), F.replace(answer, F.lit("`"), F.lit("")), F.lit("\n```\n"))
    request = F.concat("prompt", F.lit(E.EDIT_REQUEST + " main.py"))
    edits = F.array(*[message(*m) for m in (("system", F.lit("s")), ("user", F.lit("u")), ("assistant", F.lit("a")), ("user", F.lit("u")), ("assistant", F.lit("a")), ("user", stub), ("assistant", F.lit("Ok.")), ("user", request), ("assistant", listing))])
    rows = t("raw_traces").where("prompt is not null").withColumn("kind", F.get(kinds, (F.col("trace_id") % 4).cast("int")))
    pair = F.array(message("user", F.col("prompt")), message("assistant", reply))
    apart = F.array(message("user", F.col("prompt")), message("assistant", answer, thought))
    turns = F.array(message("human", F.col("prompt")), message("gpt", reply))
    return rows.select("trace_id", F.col("source").alias("group"), "kind", F.when(F.col("kind") == "tagged", pair).when(F.col("kind") == "apart", apart).when(F.col("kind") == "edits", edits).otherwise(turns).alias("messages"))


def _lf(text):
    return f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def _strip(text):
    return f"regexp_replace(regexp_replace({text}, '^{SPACE}+', ''), '{SPACE}+$', '')"


_PROSE = f"regexp_replace(coalesce({_REASON}, ''), '{SPACE}+$', '')"
_PARSED = f"""(select trace_id, kind, {_strip(_lf("case when kind = 2 then 'main.py' || chr(10) || '```' || chr(10) || 'pass' || chr(10) || '```' || chr(10) || chr(10) || " + _strip("prompt") + " else prompt end"))} as prompt,
{_strip(_lf(f"case when kind = 2 then {_PROSE} else coalesce({_REASON}, '') end"))} as reasoning,
{_strip(_lf(f"case when kind = 2 then '```python' || chr(10) || replace(coalesce({_ANSWER}, ''), '`', '') || chr(10) || '```' else coalesce({_ANSWER}, '') end"))} as answer,
contains(case when kind = 2 then prompt || {_PROSE} || coalesce({_ANSWER}, '') else prompt || coalesce({_REASON}, '') || coalesce({_ANSWER}, '') end, chr(13)) as carriage
from (select *, trace_id % 4 as kind from raw_traces where prompt is not null))"""
_WHY = "case when reasoning = '' then 'no_reasoning' when answer = '' then 'no_answer' end"


@query("p13_format_parser", f"select trace_id, {_WHY} as reason, carriage and {_WHY} is null as carriage, case when {_WHY} is null then sha1(prompt) end as prompt, case when {_WHY} is null then sha1(reasoning) end as reasoning, case when {_WHY} is null then sha1(answer) end as answer from {_PARSED}")
def _(t):
    """Chat rows of four formats as prompt, reasoning and answer, or the reason why not."""
    return E.parsed(chat_rows(t)).select("trace_id", "reason", "carriage", *[F.sha1(c).alias(c) for c in ("prompt", "reasoning", "answer")])


_MEASURED = f"""(select trace_id, p.grp, sha1(prompt) as prompt_key, sha1(prompt || '<think>' || reasoning || '</think>' || answer) as text_key,
case when {_WHY} is not null then {_WHY} when len({words_sql('reasoning')}) < 20 then 'short_reasoning' when len({words_sql("prompt || '<think>'")}) + len({words_sql('reasoning')}) + len({words_sql("'</think>' || answer")}) + 2 > 600 then 'over_length' when h.trace_id is not null then 'contaminated' end as reason
from (select x.*, r.source as grp from {_PARSED} x join raw_traces r using (trace_id)) p left join (select distinct trace_id from ({grams_sql(f"(select trace_id, prompt || chr(10) || reasoning || chr(10) || answer as text from {_PARSED})", 'trace_id', 'text', 10)}) d join ({grams_sql('benchmark', 'item_id', 'text', 10)}) b using (gram)) h using (trace_id))"""


def measured(t, size, least, most):
    return E.measured(spread(E.parsed(chat_rows(t))), size, "trace_id", t("benchmark"), least, most)


def by_words(text):
    return F.size(X.words(text)).cast("long")


@query("p14_drop_reason", f"select trace_id, reason from {_MEASURED}")
def _(t):
    """The first reason that concerns a row by itself, sizes in words, benchmark overlap included."""
    return measured(t, by_words, 20, 600).select("trace_id", "reason")


_DECIDED = f"(select *, case when reason is null and copy > 1 then 'duplicate' else reason end as why from (select *, case when reason is null then row_number() over (partition by reason, text_key order by trace_id) end as copy from {_MEASURED}))"


@query("p15_ordered_drop_chain", f"select grp as \"group\", coalesce(case when why is null and k > 2 then 'capped' else why end, 'kept') as reason, count(*) as n from (select *, case when why is null then row_number() over (partition by grp, prompt_key, why order by sha1('9:' || trace_id), trace_id) end as k from {_DECIDED}) group by 1, 2")
def _(t):
    """The whole chain in words: reasons of a row, repeats, then two a prompt in each group."""
    rows = measured(t, by_words, 20, 600)
    groups = [r["group"] for r in rows.select("group").distinct().collect()]  # sources: a configuration's few names
    done = E.decided(rows, "trace_id", {g: 2 for g in groups}, 9)
    return done.groupBy("group", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p15_token_drop_chain")
def _(t):
    """The same in tokens of the vocabulary, for rows of 32,768; every second group is not capped."""
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    rows = measured(t, lambda text: F.size(encode(text)).cast("long"), 20, 32768)
    groups = sorted(r["group"] for r in rows.select("group").where("group is not null").distinct().collect())
    done = E.decided(rows, "trace_id", {g: 2 if i % 2 == 0 else None for i, g in enumerate(groups)}, 9)
    return done.select("trace_id", "group", "reason", "context", "length")


_STOCK = "|".join(E.WRAPPERS).replace("'", "''")
_KEY = f"array_to_string(regexp_extract_all(lower(regexp_replace(prompt, '{_STOCK}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+'), ' ')"


@query("p16_problem_key", f"select trace_id, sha1({_KEY}) as key from (select trace_id, case trace_id % 4 when 0 then 'Please use python programming language only. ' || prompt when 1 then 'Write C++ code to solve the problem.' || chr(10) || prompt else prompt end as prompt from raw_traces where prompt is not null)")
def _(t):
    """The problem behind prompts, some of them with a wrapper around it."""
    k = F.col("trace_id") % 4
    wrapped = F.when(k == 0, F.concat(F.lit("Please use python programming language only. "), "prompt")).when(k == 1, F.concat(F.lit("Write C++ code to solve the problem.\n"), "prompt")).otherwise(F.col("prompt"))
    return t("raw_traces").where("prompt is not null").select("trace_id", F.sha1(E.problem_key(wrapped)).alias("key"))


@query("p17_digests", "select source, count(distinct sha1(text)) as texts from documents where text is not null group by 1")
def _(t):
    """64-bit digests decide equality; sources of a few million texts have no collision to expect."""
    return t("documents").where("text is not null").select("source", F.xxhash64("text").alias("digest")).groupBy("source").agg(F.count_distinct("digest").alias("texts"))


@query("p17_stored_digests")
def _(t):
    """The 64-bit digests as they are stored elsewhere: BLAKE2b of 8 bytes, little end first."""
    return spread(t("documents").where("text is not null").select("doc_id", "text")).select("doc_id", blake64("text").alias("digest"))


@query("p18_usable_rows", "select trace_id, regexp_replace(problem_id, '/[A-F]$', '') as question from raw_traces where finish_reason = 'stop' and generation is not null and length(prompt) > 100")
def _(t):
    return t("raw_traces").where("finish_reason = 'stop' and generation is not null and length(prompt) > 100").select("trace_id", F.regexp_replace("problem_id", "/[A-F]$", "").alias("question"))


@query("p19_imported_names")
def _(t):
    """Names that Python files import from one module, and all modules they import."""
    rows = python_files(t).withColumn("found", G.imports("content"))
    return rows.select("file_id", F.array_distinct(F.transform("found", lambda x: x["module"])).alias("modules"), G.names_from(F.col("found"), "math").alias("names")).where("size(modules) > 0")


@query("p19_literal_names", "select * from (values (1, 'a,c'), (2, ''), (3, ''), (4, 'b')) v(k, names)")
def _(t):
    texts = ["from solution import c, a\nfrom solution import a as z\nimport os\n", "import solution\nfrom .solution import x\n", "from solution import *\n", "def f(:\n  pass\nfrom solution import (b)\n"]
    rows = t.spark.createDataFrame(list(enumerate(texts, 1)), "k int, content string")
    return rows.select("k", F.array_join(G.names_from(G.imports("content"), "solution"), ",").alias("names"))


@query("p20_fenced_code", "select trace_id, sha1(coalesce(regexp_extract_all(generation, '(?s)```(?:python|py)[ \\t]*\\n(.*?)```', 1)[-1], regexp_extract_all(generation, '(?s)```[ \\t]*\\n(.*?)```', 1)[-1])) as code from raw_traces where generation is not null")
def _(t):
    return t("raw_traces").where("generation is not null").select("trace_id", F.sha1(X.fenced_code(F.col("generation"))).alias("code"))


@query("p21_ending", "select trace_id, case when generation is null then 'none' when not contains(generation, '</think>') then 'open' when contains(split_part(generation, '</think>', -1), '```') then 'code' when trim(split_part(generation, '</think>', -1), chr(10) || ' ') = '' then 'empty' else 'text' end as ending from raw_traces")
def _(t):
    after = F.substring_index("generation", "</think>", -1)
    ending = F.when(F.col("generation").isNull(), "none").when(~F.contains("generation", F.lit("</think>")), "open").when(F.contains(after, F.lit("```")), "code").when(F.trim(after, F.lit("\n ")) == "", "empty").otherwise("text")
    return t("raw_traces").select("trace_id", ending.alias("ending"))


@query("p22_stop_words", "select completion_id, coalesce(p > 0, false) as cut, length(case when p > 0 then text[:p - 1] else text end) as n from (select *, list_min(list_filter([strpos(text, 'def '), strpos(text, 'class '), strpos(text, 'print(')], lambda x: x > 0)) as p from completions where text is not null)")
def _(t):
    text, cut = X.stop_at(F.col("text"), ["def ", "class ", "print("])
    return t("completions").where("text is not null").select("completion_id", cut.alias("cut"), F.length(text).cast("long").alias("n"))


@query("p23_solution_diagnostics")
def _(t):
    """What is certainly wrong with Python completions: of the function their item's text defines, else of their last one."""
    entry = F.regexp_extract("text", r"(?m)^def (\w+)\(", 1)
    named = t("benchmark").where("lang = 'Python' and text is not null").select("item_id", F.when(entry != "", entry).alias("entry"))
    rows = t("completions").where("lang = 'Python' and text is not null").select("completion_id", "item_id", "text").join(F.broadcast(named), "item_id", "left")
    found = spread(rows).withColumn("found", G.functions("text"))
    return found.select("completion_id", G.diagnosis(F.col("text"), F.col("found"), F.col("entry")).alias("diagnosis"))


_LITERAL_SOLUTIONS = [("def f(x):\n    return x\n", "f"), ("def f(x):\n    return\n", "f"), ("def f(x):\n    def g():\n        return 1\n", "f"), ("def f(x):\n    yield x\n", "f"), ("def g(x):\n    return x\n", "f"), ("def f(x:\n", "f"), ("def f():\n    return 1\ndef f():\n    pass\n", "f"), (None, "f")]


@query("p23_literal_solutions", "select * from (values (1, 'ok'), (2, 'returns_nothing'), (3, 'returns_nothing'), (4, 'returns_nothing'), (5, 'missing'), (6, 'unparsed'), (7, 'returns_nothing'), (8, null)) v(k, diagnosis)")
def _(t):
    rows = t.spark.createDataFrame([(k, *x) for k, x in enumerate(_LITERAL_SOLUTIONS, 1)], "k int, content string, entry string")
    found = rows.withColumn("found", G.functions("content"))
    return found.select("k", G.diagnosis(F.col("content"), F.col("found"), F.col("entry")).alias("diagnosis"))


@query("p24_prompt_examples")
def _(t):
    """Interactive examples and assertions in the string literals of Python files."""
    rows = python_files(t).select("file_id", F.explode(G.examples("content")).alias("e"))
    return rows.select("file_id", "e.source", "e.want")


@query("p25_storable", "select completion_id, finish_reason is not null and finish_reason <> 'length' and text is not null as storable from completions")
def _(t):
    return t("completions").select("completion_id", (F.col("finish_reason").isNotNull() & F.coalesce(F.col("finish_reason") != "length", F.lit(False)) & F.col("text").isNotNull()).alias("storable"))


_WORDS = words_sql("text")
_SPLIT = f"(select completion_id, w, (len(w) * 2) // 5 as a, (len(w) * 3) // 5 as b, completion_id % 2 as mode from (select completion_id, {_WORDS} as w from completions where text is not null))"


@query("p26_infilling_prompt", f"select completion_id, sha1(array_to_string(case when mode = 0 then ['<PRE>'] || w[:a] || ['<SUF>'] || w[b + 1:] || ['<MID>'] else ['<PRE>', '<SUF>'] || w[b + 1:] || ['<MID>'] || w[:a] end, ' ')) as prompt, len(w) - (b - a) + 3 as n from {_SPLIT}")
def _(t):
    """Prompts for the middle of a text, in words: prefix, suffix and the mark of the middle, in either order."""
    w = F.col("w")
    rows = t("completions").where("text is not null").select("completion_id", X.words(F.col("text")).alias("w")).withColumns({"a": F.floor(F.size(w) * 2 / 5).cast("int"), "b": F.floor(F.size(w) * 3 / 5).cast("int")})
    pre, suf, mid = (F.array(F.lit(m)) for m in ("<PRE>", "<SUF>", "<MID>"))
    prefix, suffix = F.slice(w, 1, F.col("a")), F.slice(w, F.col("b") + 1, F.size(w))
    prompt = F.when(F.col("completion_id") % 2 == 0, F.concat(pre, prefix, suf, suffix, mid)).otherwise(F.concat(pre, suf, suffix, mid, prefix))
    return rows.select("completion_id", F.sha1(F.array_join(prompt, " ")).alias("prompt"), F.size(prompt).cast("long").alias("n"))


@query("p27_overlong_penalty", "select doc_id, round(greatest(-1.0, least(0.0, (4000.0 - 1000.0 - n_chars) / 1000.0)), 6)::double as penalty from documents")
def _(t):
    return t("documents").select("doc_id", F.round(X.overlong_penalty(F.col("n_chars"), 4000.0, 1000.0), 6).alias("penalty"))


@query("p28_run_name", "select source, array_to_string(list_sort(list_filter(['lang=' || lang, 'code=' || is_code::varchar, case when keep_order <> 0 then 'order=' || keep_order end], lambda x: x is not null)), ',') as name from source_catalog")
def _(t):
    parts = F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("code="), F.col("is_code").cast("string")), F.when(F.col("keep_order") != 0, F.concat(F.lit("order="), F.col("keep_order").cast("string"))))
    return t("source_catalog").select("source", F.array_join(F.array_sort(F.filter(parts, lambda x: x.isNotNull())), ",").alias("name"))


@query("p29_numeric_suffix", "select distinct hub_file, regexp_extract(hub_file, '(\\d+)\\.parquet$', 1)::int as part from repository_files where hub_file is not null")
def _(t):
    return t("repository_files").where("hub_file is not null").select("hub_file", F.regexp_extract("hub_file", r"(\d+)\.parquet$", 1).cast("int").alias("part")).distinct()


@query("p30_prompt_equality", "select doc_id, text = replace(text, chr(13), '') as clean from documents where text is not null")
def _(t):
    chars = F.array("text")
    return t("documents").where("text is not null").select("doc_id", (~F.exists(chars, lambda x: F.contains(x, F.lit("\r")))).alias("clean"))


@query("p31_chat_template", f"select trace_id, sha1(regexp_replace(regexp_replace(prompt || chr(10) || chr(10) || coalesce(generation, ''), '^{SPACE}+', ''), '{SPACE}+$', '') || '<think>') as rendered from raw_traces where prompt is not null")
def _(t):
    """The messages of a row joined by an empty line, nothing around them, and the mark that opens the answer."""
    messages = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in (("user", F.col("prompt")), ("assistant", F.coalesce("generation", F.lit(""))))])
    joined = F.array_join(F.transform(messages, lambda m: m["content"]), "\n\n")
    return t("raw_traces").where("prompt is not null").select("trace_id", F.sha1(F.concat(X.strip(joined), F.lit(X.THINK))).alias("rendered"))


@query("p32_three_parts", f"select trace_id, sha1(prompt || '<think>') as context, sha1({_REASON}) as reasoning, sha1('</think>' || ({_ANSWER})) as answer from raw_traces where generation is not null and prompt is not null")
def _(t):
    g = F.col("generation")
    return t("raw_traces").where("generation is not null and prompt is not null").select("trace_id", F.sha1(F.concat("prompt", F.lit("<think>"))).alias("context"), F.sha1(X.reasoning(g)).alias("reasoning"), F.sha1(F.concat(F.lit("</think>"), X.answer(g))).alias("answer"))


@query("p33_last_close", "select trace_id, length(case when contains(generation, '</think>') then split_part(generation, '</think>', -1) else '' end) as n from raw_traces where generation is not null")
def _(t):
    return t("raw_traces").where("generation is not null").select("trace_id", F.length(X.last_answer(F.col("generation"))).cast("long").alias("n"))


@query("p34_step_sets", "select source, array_to_string(list_sort(list_distinct(list_transform(range(1, 5), lambda k: round_even(n * k / 4.0, 0)::bigint) || list_filter([1, 2, 4, 8, 16, 32, 64, 128, 256, 512], lambda p: p <= n))), ',') as steps from (select source, count(*) as n from documents group by 1)")
def _(t):
    n = F.col("n")
    even = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.bround(n * k / 4.0, 0).cast("long"))
    powers = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.shiftleft(F.lit(1).cast("long"), k) if isinstance(k, int) else F.pow(F.lit(2), k).cast("long")), lambda p: p <= n)
    return t("documents").groupBy("source").agg(F.count("*").alias("n")).select("source", F.array_join(F.array_sort(F.array_union(even, powers)).cast("array<string>"), ",").alias("steps"))


@query("p35_vocabulary_mask", "select token_rank from tokenizer_vocab where length(token_b64) > 0 and regexp_matches(from_base64(token_b64)::varchar, '[.,;(){}]')")
def _(t):
    return t("tokenizer_vocab").where(F.regexp_like(F.decode(F.unbase64("token_b64"), "ISO-8859-1"), F.lit("[.,;(){}]"))).select("token_rank")


@query("p36_message_lines", "select trace_id, sha1(replace(replace(prompt, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || '|' || replace(replace(coalesce(generation, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) as digest from raw_traces where prompt is not null")
def _(t):
    messages = F.transform(F.array("prompt", F.coalesce("generation", F.lit(""))), lambda m: F.replace(F.replace(m, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")))
    return t("raw_traces").where("prompt is not null").select("trace_id", F.sha1(F.array_join(messages, "|")).alias("digest"))


@query("p37_program_assembly", "select completion_id, sha1(replace(b.text || chr(10) || c.text, chr(9), '    ') || case when c.lang = 'C++' then chr(10) || '}' else '' end) as program from completions c join benchmark b using (item_id) where c.text is not null")
def _(t):
    rows = t("completions").where("text is not null").select("completion_id", "item_id", "lang", F.col("text").alias("body")).join(F.broadcast(t("benchmark").select("item_id", F.col("text").alias("prompt"))), "item_id")
    closed = F.when(F.col("lang") == "C++", F.lit("\n}")).otherwise(F.lit(""))
    return rows.select("completion_id", F.sha1(F.concat(F.replace(F.concat("prompt", F.lit("\n"), "body"), F.lit("\t"), F.lit("    ")), closed)).alias("program"))


_SPEC = "(select i - 1 as k, split_part(s, ':', 1)::double as temperature, split_part(s, ':', 2)::int as samples, coalesce(sum(split_part(s, ':', 2)::int) over (order by i rows between unbounded preceding and 1 preceding), 0) as before from (select unnest(string_split('0.6:4,1.0:8,0.2:1', ',')) as s, unnest(range(1, 4)) as i))"


@query("p38_sample_spec", f"select item_id, temperature, sample, 1000 + row_number() over (order by item_id, k, sample) - 1 as seed from benchmark, (select k, temperature, unnest(range(0, samples)) as sample from {_SPEC})")
def _(t):
    """The requests that a sampling rule asks for: for every item the samples of each temperature, with seeds that follow
    the request's number."""
    pairs = F.transform(F.split(F.lit("0.6:4,1.0:8,0.2:1"), ","), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(1)).cast("double").alias("temperature"), F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("samples")))
    rules = t("benchmark").select("item_id", F.posexplode(pairs).alias("k", "p"))
    asked = rules.select("item_id", "k", "p.temperature", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p.samples").cast("long") - 1)).alias("sample"))
    return global_rank(asked, ["item_id", "k", "sample"]).select("item_id", "temperature", "sample", (F.lit(999) + F.col("rank")).alias("seed"))


@query("p38_context_ids")
def _(t):
    """What a prompt is to a model: the start mark (-1) and the tokens of the prompt with the mark that opens reasoning."""
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    ids = F.concat(F.array(F.lit(-1)), encode(F.concat("text", F.lit(X.THINK))))
    return spread(t("benchmark").where("text is not null").select("item_id", "text")).select("item_id", F.size(ids).alias("n"), F.sha1(F.array_join(ids.cast("array<string>"), ",")).alias("digest"))


_PLAN = "(select stage, floor(stage_tokens / (seq_len * 4.0))::bigint as steps, floor(stage_tokens / (seq_len * 4.0) * 0.1)::bigint as warm, floor(stage_tokens / (seq_len * 4.0) * 0.4)::bigint as down from (select stage, max(stage_tokens) as stage_tokens, max(seq_len) as seq_len from mixture_groups group by 1))"


@query("p39_plan_laws", f"select stage, step, round(least(case when warm > 0 then (step + 1) / warm::double else 1.0 end, 1.0, case when down > 0 then (steps - step) / down::double else 1.0 end), 6)::double as multiplier from (select *, unnest(range(0, steps)) as step from {_PLAN})")
def _(t):
    """The steps of each stage's run from its tokens, and each step's rate: rising over the first tenth, level, falling over
    the last four."""
    batch = F.max("stage_tokens") / (F.max("seq_len") * 4.0)
    plan = t("mixture_groups").groupBy("stage").agg(F.floor(batch).alias("steps"), F.floor(batch * 0.1).alias("warm"), F.floor(batch * 0.4).alias("down"))
    steps = plan.where("steps > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps") - 1)).alias("step"))
    rate = F.least(F.when(F.col("warm") > 0, (F.col("step") + 1) / F.col("warm")).otherwise(1.0), F.lit(1.0), F.when(F.col("down") > 0, (F.col("steps") - F.col("step")) / F.col("down")).otherwise(1.0))
    return steps.select("stage", "step", F.round(rate, 6).alias("multiplier"))
