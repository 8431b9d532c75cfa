"""Queries of the curation path: standardize, identify, deduplicate, split, shard, decontaminate."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions.hashing import residue
from millrace.functions.names import repository_key
from millrace.operators import curation as C
from millrace.operators import graphs
from millrace.operators import sampling as S
from millrace.operators.ranking import carried, global_rank, grouped_rank
from millrace.plans.registry import query
from millrace.session import cut

LF = "replace(replace(regexp_replace({0}, '^\\x{{FEFF}}+', ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
SPACE = "[\\t\\n\\v\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
NORM = LF.format("text")


def words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{SPACE}+'), lambda w: w <> '')"


def grams_sql(source: str, ident: str, text: str, n: int) -> str:
    rest = "".join(f" || ' ' || lead(word, {k}) over w" for k in range(1, n))
    split = f"select {ident}, unnest(w) as word, generate_subscripts(w, 1) as pos from (select {ident}, {words_sql(text)} as w from {source} where {text} is not null)"
    return f"select distinct {ident}, gram from (select {ident}, word{rest} as gram from ({split}) window w as (partition by {ident} order by pos)) where gram is not null"


def standardized(t):
    return t("documents").withColumn("content", X.normalize_lines(F.col("text"))).withColumn("id", X.content_id(F.col("content")))


STANDARD = f"(select *, {NORM} as content, sha1({NORM}) as id from documents)"


@query("p01_line_normalization", f"select doc_id, sha1({NORM}) as digest, length({NORM}) as n from documents")
def _(t):
    c = X.normalize_lines(F.col("text"))
    return t("documents").select("doc_id", F.sha1(c).alias("digest"), F.length(c).cast("long").alias("n"))


@query("p02_standardize", f"select id, source, coalesce(lang, 'none') as language, length(content) as n from {STANDARD} where text is not null")
def _(t):
    return standardized(t).where("text is not null").select("id", "source", F.coalesce("lang", F.lit("none")).alias("language"), F.length("content").cast("long").alias("n"))


_TRACE = LF.format("prompt || generation")


@query("p03_standardizers", f"""
select 'repository file' as category, file_id as record, sha1({LF.format('content')}) as id, ltrim(relative_path, '/') as path from repository_files where content is not null
union all select 'function', function_id, sha1({LF.format('content')}), null from code_functions where content is not null
union all select 'conversation', trace_id, sha1({_TRACE}), null from raw_traces where finish_reason = 'stop' and prompt is not null and generation is not null
union all select 'text', doc_id, sha1({NORM}), null from documents where category = 'text' and text is not null""")
def _(t):
    def make(frame, category, record, text, path=None):
        return frame.select(F.lit(category).alias("category"), F.col(record).alias("record"), X.content_id(X.normalize_lines(text)).alias("id"), (path if path is not None else F.lit(None).cast("string")).alias("path")).where("id is not null")

    files = make(t("repository_files"), "repository file", "file_id", F.col("content"), F.ltrim(F.col("relative_path"), F.lit("/")))
    functions = make(t("code_functions"), "function", "function_id", F.col("content"))
    traces = make(t("raw_traces").where("finish_reason = 'stop'"), "conversation", "trace_id", F.concat("prompt", "generation"))
    texts = make(t("documents").where("category = 'text'"), "text", "doc_id", F.col("text"))
    return files.unionByName(functions).unionByName(traces).unionByName(texts)


@query("p04_null_text_filter", "select doc_id, source from documents where text is not null")
def _(t):
    return t("documents").where("text is not null").select("doc_id", "source")


@query("p05_sha1_id", "select file_id, sha1(content) = id as same from repository_files where content is not null")
def _(t):
    return t("repository_files").where("content is not null").select("file_id", (X.content_id(F.col("content")) == F.col("id")).alias("same"))


@query("p06_group_residue", "select group_key, (md5_number(group_key) % 100)::bigint as residue, count(*) as n from documents where group_key is not null group by 1, 2")
def _(t):
    return t("documents").where("group_key is not null").groupBy("group_key").agg(F.count("*").alias("n")).withColumn("residue", residue(F.col("group_key")))


_PATH = "replace(replace(relative_path, chr(13), '\\r'), chr(10), '\\n')"
_BODY = "regexp_replace(content, '\\n$', '')"


@query("p10_path_comment", f"""select file_id, sha1(case when lang = 'C++' then '// ' || {_PATH} || case when {_PATH} like '%\\' then chr(10) else '' end || chr(10) || body || chr(10)
else '# ' || {_PATH} || chr(10) || body || chr(10) end) as digest from (select *, case when content like '%' || chr(10) then content[:-2] else content end as body from repository_files) where content is not null""")
def _(t):
    return t("repository_files").where("content is not null").select("file_id", F.sha1(X.path_comment(F.col("relative_path"), F.col("content"), F.col("lang"))).alias("digest"))


def number_of(text):
    """52 bits of a digest as a number: sums of them are digests of sets."""
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(13)), 16, 10).cast("decimal(38,0)")


@query("p11_documents_from_samples", "select lower(repo_name) as repo, lang, count(*) as files, sum(('0x' || md5(coalesce(relative_path, '') || chr(1) || sha1(content) || chr(1) || file_id)[:13])::hugeint)::varchar as digest from repository_files where repo_name is not null and content is not null group by 1, 2")
def _(t):
    """One document a repository and language, as its number of files and a digest of their places and contents: sums of
    the files' digests, so that no task holds a repository. The documents themselves are p11_sample_documents."""
    files = t("repository_files").where("repo_name is not null and content is not null")
    place = F.concat(F.coalesce("relative_path", F.lit("")), F.lit("\x01"), F.sha1("content"), F.lit("\x01"), F.col("file_id").cast("string"))
    return files.groupBy(F.lower("repo_name").alias("repo"), "lang").agg(F.count("*").alias("files"), F.sum(number_of(place)).cast("string").alias("digest"))


@query("p11_sample_documents")
def _(t):
    """One document a sample of a source's repository, whatever its folders, as its files' texts in dependency order."""
    files = t("repository_files").withColumn("repo", repository_key(F.col("repo_name"))).where("repo is not null and source is not null")
    whole = files.select(F.concat("source", F.lit("\n"), "repo").alias("repo"), "lang", "file_id", "relative_path", "content")
    texts = files.select("file_id", X.file_text(F.col("relative_path"), F.col("content"), F.col("lang")).alias("text"))
    parts = graphs.document_parts(graphs.samples(whole, one_per_path=False), texts, ["repo", "lang", "sample"])
    place = F.split("repo", "\n", 2)
    return parts.withColumns({"source": place[0], "repo": place[1]}).select("source", "repo", "lang", "sample", "part", "file_id", "start", "text")


@query("w01_keep_first", f"select doc_id, id from (select doc_id, id, row_number() over (partition by id order by keep_order, doc_id) as n from {STANDARD} join source_catalog using (source) where text is not null) where n = 1 and id <> sha1('')")
def _(t):
    rows = standardized(t).where("text is not null").select("doc_id", "id", "source").join(F.broadcast(t("source_catalog").select("source", "keep_order")), "source")
    return C.keep_first(rows, ["id"], ["keep_order", "doc_id"]).where(F.col("id") != F.sha1(F.lit(""))).select("doc_id", "id")


def dropped(t):
    rows = standardized(t).where("text is not null").select("doc_id", "id", "source").join(F.broadcast(t("source_catalog").select("source", "keep_order")), "source")
    return rows, C.duplicate_addresses(rows, "id", ["keep_order", "doc_id"])


@query("j01_drop_by_address", f"select doc_id, source from (select doc_id, id, source, row_number() over (partition by id order by keep_order, doc_id) as n from {STANDARD} join source_catalog using (source) where text is not null) where n = 1 and id <> sha1('')")
def _(t):
    rows, bad = dropped(t)
    return C.drop_addresses(rows, bad, ["keep_order", "doc_id"]).select("doc_id", "source")


@query("a01_rows_duplicates", f"select source, count(*) as row_count, count(*) filter (n > 1 or id = sha1('')) as duplicates from (select source, id, row_number() over (partition by id order by keep_order, doc_id) as n from {STANDARD} join source_catalog using (source) where text is not null) group by 1")
def _(t):
    rows, bad = dropped(t)
    marked = rows.join(bad.withColumn("bad", F.lit(True)), ["keep_order", "doc_id"], "left")
    return marked.groupBy("source").agg(F.count("*").alias("row_count"), F.count_if("bad").alias("duplicates"))


_OVERLAP = f"select doc_id, list_sort(list(distinct item_id)) as items from ({grams_sql('documents', 'doc_id', 'text', 10)}) d join ({grams_sql('benchmark', 'item_id', 'text', 10)}) b using (gram) group by 1"


def overlapping(t):
    return C.overlaps(t("documents"), t("benchmark"), "doc_id", "text")


@query("j02_ngram_overlap", f"select doc_id, array_to_string(items, ',') as items, len(items) as n from ({_OVERLAP})")
def _(t):
    return overlapping(t).select("doc_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("j03_without_overlap", f"select doc_id, source from documents where doc_id not in (select doc_id from ({_OVERLAP}))")
def _(t):
    return t("documents").join(overlapping(t), "doc_id", "left_anti").select("doc_id", "source")


@query("s19_drop_records", f"select source, count(*) as dropped, count(distinct item) as items from (select doc_id, unnest(items) as item from ({_OVERLAP})) join documents using (doc_id) group by 1")
def _(t):
    hit = overlapping(t).join(t("documents").select("doc_id", "source"), "doc_id").select("source", F.explode("items").alias("item"))
    return hit.groupBy("source").agg(F.count("*").alias("dropped"), F.count_distinct("item").alias("items"))


_CURATED = f"""(select lang, case when n > 1 or id = sha1('') then 'duplicate' when residue = 0 then 'val' when o.doc_id is not null then 'contaminated' else 'kept' end as fate
from (select doc_id, lang, id, (md5_number(id) % 100)::bigint as residue, row_number() over (partition by id order by keep_order, doc_id) as n from {STANDARD} join (select source, keep_order from source_catalog) using (source) where text is not null) d left join ({_OVERLAP}) o using (doc_id))"""


@query("flagship_curate", f"select coalesce(lang, 'none') as lang, count(*) filter (fate = 'kept') as kept, count(*) filter (fate = 'duplicate') as duplicate, count(*) filter (fate = 'contaminated') as contaminated, count(*) filter (fate = 'val') as val from {_CURATED} group by 1")
def flagship(t):
    """Standardize, drop repeats in source priority, split by hash, and drop benchmark overlap outside validation."""
    return curated(t, residue(F.col("id")) == 0)


@query("flagship_curate_groups")
def _(t):
    """The same with the split by the hash of the group, so that a group is on one side; null groups are in training."""
    return curated(t, C.hash_split(F.col("group_key")) == "val")


def curated(t, val):
    """The narrow rows are made once; the first of each text is a minimum that is combined before the shuffle, what it leaves
    are the duplicates, and only firsts meet the overlaps."""
    text = X.normalize_lines(F.col("text"))
    order = F.broadcast(t("source_catalog").select("source", "keep_order"))
    rows = cut(t("documents").where("text is not null").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), "source", "group_key", X.content_id(text).alias("id")).join(order, "source").drop("source"))
    first = C.keep_first(rows, ["id"], ["keep_order", "doc_id"]).where(F.col("id") != F.sha1(F.lit("")))
    fate = F.when(val, "val").when(F.col("items").isNotNull(), "contaminated").otherwise("kept")
    fates = first.join(overlapping(t), "doc_id", "left").groupBy("lang", fate.alias("fate")).agg(F.count("*").alias("n"))
    # of each language: all rows less the firsts are the duplicates
    every = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.lit("duplicate").alias("fate"), "n").unionByName(fates.select("lang", F.lit("duplicate").alias("fate"), (-F.col("n")).alias("n")))
    return fates.unionByName(every).groupBy("lang").agg(*[F.coalesce(F.sum(F.when(F.col("fate") == f, F.col("n"))), F.lit(0)).alias(f) for f in ("kept", "duplicate", "contaminated", "val")])


@query("w02_ntile_shards", "select doc_id, ntile(100) over (order by doc_id) - 1 as shard from documents")
def _(t):
    return C.shards(t("documents").select("doc_id"), ["doc_id"], 100)


@query("w03_rank_cap", "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang, topic order by sha1('7:' || doc_id), doc_id) as k from documents where lang is not null and topic is not null) where k <= 3")
def _(t):
    return C.cap_equals(t("documents").where("lang is not null and topic is not null").select("doc_id", "lang", "topic"), ["lang", "topic"], "doc_id", 3, 7).select("doc_id", "lang")


@query("w04_running_offsets", "select doc_id, (sum(n_chars) over (order by doc_id) - n_chars)::bigint as offset_start, sum(n_chars) over (order by doc_id)::bigint as offset_end from documents")
def _(t):
    ranked = global_rank(t("documents").select("doc_id", "n_chars"), ["doc_id"], weight="n_chars")
    return ranked.select("doc_id", (F.col("running") - F.col("n_chars")).alias("offset_start"), F.col("running").alias("offset_end"))


@query("w05_run_boundaries", "select user_id, event_id, sum(flag) over (partition by user_id order by ts, event_id)::bigint as run from (select *, case when event_type is distinct from lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as flag from events)")
def _(t):
    before = carried(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", "before")
    flagged = before.withColumn("flag", F.when(~F.col("event_type").eqNullSafe(F.col("before")), 1).otherwise(0))
    return grouped_rank(flagged, ["user_id"], ["ts", "event_id"], weight="flag", running="run").select("user_id", "event_id", "run")


@query("w06_systematic_sampling", "select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders) where floor((i + 1) * 0.37::double) > floor(i * 0.37::double)")
def _(t):
    return S.systematic(t("orders").select("o_orderkey"), ["o_orderkey"], 0.37)


@query("w07_epoch_permutations", "select epoch, row_number() over (partition by epoch order by sha1((epoch + 3)::varchar || ':' || doc_id::varchar), doc_id) - 1 as position, doc_id from documents, (select unnest([0, 1]) as epoch)")
def _(t):
    return S.permutations(t("documents"), "doc_id", 2, 3)


@query("w12_position_in_segment", "select repo_name, file_id, row_number() over w as position, coalesce(sum(length(content)) over (partition by repo_name order by relative_path, file_id rows between unbounded preceding and 1 preceding), 0)::bigint as before_chars from repository_files where repo_name is not null and content is not null window w as (partition by repo_name order by relative_path, file_id)")
def _(t):
    rows = t("repository_files").where("repo_name is not null and content is not null").select("repo_name", "file_id", "relative_path", F.length("content").cast("long").alias("n"))
    ranked = grouped_rank(rows, ["repo_name"], ["relative_path", "file_id"], weight="n", rank="position")
    return ranked.select("repo_name", "file_id", "position", (F.col("running") - F.col("n")).alias("before_chars"))


@query("w13_request_seeds", "select trace_id, 100 + row_number() over (partition by problem_id order by trace_id) - 1 as seed from raw_traces")
def _(t):
    ranked = grouped_rank(t("raw_traces").select("trace_id", "problem_id"), ["problem_id"], ["trace_id"])
    return ranked.select("trace_id", (F.lit(99) + F.col("rank")).alias("seed"))


@query("k01_order_in_shard", "select shard, doc_id, row_number() over (partition by shard order by id, doc_id) as position from (select doc_id, sha1(text) as id, (md5_number(doc_id::varchar) % 8)::bigint as shard from documents where text is not null)")
def _(t):
    rows = t("documents").where("text is not null").select("doc_id", F.sha1("text").alias("id"), residue(F.col("doc_id").cast("string"), 8).alias("shard"))
    return grouped_rank(rows, ["shard"], ["id", "doc_id"], rank="position").select("shard", "doc_id", "position")


@query("k02_multi_key_sort", "select file_id, row_number() over (order by lower(repo_name) nulls first, relative_path nulls first, id nulls first, file_id) as rank from repository_files")
def _(t):
    rows = t("repository_files").select("file_id", F.lower("repo_name").alias("repo"), "relative_path", "id")
    return global_rank(rows, ["repo", "relative_path", "id", "file_id"]).select("file_id", "rank")


@query("k05_largest_remainder", "with s as (select c_mktsegment as stratum, count(*) as n from customer group by 1), e as (select *, 97 * n / sum(n) over () as exact, floor(97 * n / sum(n) over ()) as low from s), r as (select *, 97 - sum(low) over () as left_, row_number() over (order by round(exact - low, 9) desc, stratum) as k from e) select stratum, (low + case when k <= left_ then 1 else 0 end)::bigint as quota from r")
def _(t):
    return S.quotas(t("customer").groupBy(F.col("c_mktsegment").alias("stratum")).agg(F.count("*").alias("n")), "stratum", "n", 97)


@query("k05_stratified_sample", "with s as (select c_mktsegment as stratum, count(*) as n from customer group by 1), e as (select *, 97 * n / sum(n) over () as exact, floor(97 * n / sum(n) over ()) as low from s), r as (select *, 97 - sum(low) over () as left_, row_number() over (order by round(exact - low, 9) desc, stratum) as k from e), q as (select stratum, low + case when k <= left_ then 1 else 0 end as quota from r) select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by sha1('5:' || c_custkey), c_custkey) as k from customer) join q on stratum = c_mktsegment where k <= quota")
def _(t):
    return S.stratified(t("customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 97, 5)


@query("k06_choice", "select doc_id from documents order by sha1('13:' || doc_id), doc_id limit 50")
def _(t):
    return S.choose(t("documents").select("doc_id"), "doc_id", 50, 13)


@query("k08_first_and_max", "select user_id, first(event_type order by ts, event_id) as first_type, arg_max(event_type, (ts, event_id)) as last_type from events group by 1")
def _(t):
    at = F.struct("ts", "event_id")
    return t("events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max_by("event_type", at).alias("last_type"))


@query("k09_prefix_need", "select source, doc_id from (select source, doc_id, coalesce(sum(n_chars) over (partition by source order by doc_id desc rows between unbounded preceding and 1 preceding), 0) as before from documents) where before < 20000")
def _(t):
    rows = t("documents").select("source", "doc_id", "n_chars", (-F.col("doc_id")).alias("down"))
    return S.prefix_need(rows, ["source"], ["down"], "n_chars", 20000).select("source", "doc_id")


@query("k03_longest_first", "select hub_file, (k // 6)::bigint as turn, (case when (k // 6) % 2 = 0 then k % 6 else 5 - k % 6 end)::bigint as slot from (select hub_file, row_number() over (order by bytes desc, hub_file) - 1 as k from (select hub_file, sum(length(content)) as bytes from repository_files where hub_file is not null and content is not null group by 1))")
def _(t):
    """Files dealt to six slots, the longest first; what they give does not depend on it."""
    files = t("repository_files").where("hub_file is not null and content is not null").groupBy("hub_file").agg(F.sum(F.length("content")).alias("bytes"))
    return S.dealt_longest_first(files, "hub_file", "bytes", 6).select("hub_file", "turn", "slot")


_NEAR = "select doc_id from documents where doc_id not in (select doc_id from ({0})) order by abs(n_chars - {1}), doc_id limit 1"
_FIRST = "select 500.0::double as target, doc_id from (select doc_id from documents order by abs(n_chars - 500), doc_id limit 1)"
_SECOND = f"{_FIRST} union all select 501.0::double, doc_id from ({_NEAR.format(_FIRST, 501)})"
_THIRD = f"{_SECOND} union all select 4000.0::double, doc_id from ({_NEAR.format(_SECOND, 4000)})"


@query("k07_nearest_distinct", _THIRD)
def _(t):
    """For each length asked for, the document nearest to it that is not chosen yet."""
    chosen = S.nearest_distinct(t("documents").select("doc_id", "n_chars"), "doc_id", "n_chars", [500, 501, 4000])
    return t.spark.createDataFrame(chosen, "target double, doc_id long")


@query("s03_extent", "select source, hub_file, bytes from (select *, coalesce(sum(bytes) over (partition by source order by sha1(hub_file), hub_file rows between unbounded preceding and 1 preceding), 0) as before, sum(bytes) over (partition by source) as total from (select source, hub_file, sum(length(content))::bigint as bytes from repository_files where hub_file is not null and content is not null group by 1, 2)) where before < total / 2")
def _(t):
    files = t("repository_files").where("hub_file is not null and content is not null").groupBy("source", "hub_file").agg(F.sum(F.length("content")).alias("bytes"))
    sized = files.withColumn("total", F.sum("bytes").over(Window.partitionBy("source")))
    return C.extent(sized, ["source"], "hub_file", "bytes", F.col("total") / 2).drop("total")


@query("s01_glob_listing", "select distinct c.source, f.hub_file from repository_files f join source_catalog c on f.source = c.source and f.hub_file glob c.files_glob")
def _(t):
    pattern = F.concat(F.lit("^"), F.replace(F.replace(F.col("files_glob"), F.lit("."), F.lit("\\.")), F.lit("*"), F.lit(".*")), F.lit("$"))
    globs = t("source_catalog").select("source", pattern.alias("pattern"))
    listed = t("repository_files").where("hub_file is not null").select("source", "hub_file").distinct()
    return listed.join(F.broadcast(globs), "source").where(F.regexp_like("hub_file", F.col("pattern"))).select("source", "hub_file")


@query("s04_pruned_copy", "select file_id, repo_name, relative_path from repository_files")
def _(t):
    return t("repository_files").select("file_id", "repo_name", "relative_path")


@query("s06_scan_by_source", "select source, count(*) as n, count(text) as texts from documents group by 1")
def _(t):
    return t("documents").groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("texts"))


@query("s11_projected_scan", "select trace_id, problem_id, finish_reason from raw_traces where finish_reason is not null")
def _(t):
    return t("raw_traces").select("trace_id", "problem_id", "finish_reason").where("finish_reason is not null")


@query("s18_batches_by_bytes", "select hub_file, (coalesce(sum(bytes) over (order by hub_file rows between unbounded preceding and 1 preceding), 0) // 100000)::bigint as batch from (select hub_file, sum(length(content))::bigint as bytes from repository_files where hub_file is not null and content is not null group by 1)")
def _(t):
    files = t("repository_files").where("hub_file is not null and content is not null").groupBy("hub_file").agg(F.sum(F.length("content")).alias("bytes"))
    ranked = global_rank(files, ["hub_file"], weight="bytes")
    return ranked.select("hub_file", F.floor((F.col("running") - F.col("bytes")) / 100000).alias("batch"))


@query("s25_benchmark_texts", "select benchmark_name || '/' || split_part(task, '/', 2) as key, sha1(text) as digest from benchmark")
def _(t):
    return t("benchmark").select(F.concat_ws("/", "benchmark_name", F.split_part("task", F.lit("/"), F.lit(2))).alias("key"), F.sha1("text").alias("digest"))


@query("s27_dataset_card", f"select source, count(*) filter (s = 'train') as train, count(*) filter (s = 'val') as val from (select source, case when (md5_number(group_key) % 100)::bigint = 0 then 'val' else 'train' end as s from documents) group by 1")
def _(t):
    rows = t("documents").select("source", C.hash_split(F.col("group_key")).alias("split"))
    return rows.groupBy("source").pivot("split", ["train", "val"]).count().na.fill(0)


@query("s29_source_digest", "select repo_name, sum(('0x' || md5(coalesce(relative_path, '') || chr(1) || sha256(coalesce(content, '')) || chr(1) || file_id)[:13])::hugeint)::varchar as digest from repository_files where repo_name is not null group by 1")
def _(t):
    """A digest of each repository's tree that is added up from its files, whatever its size; in path order it is
    s29_tree_digest."""
    place = F.concat(F.coalesce("relative_path", F.lit("")), F.lit("\x01"), F.sha2(F.coalesce("content", F.lit("")), 256), F.lit("\x01"), F.col("file_id").cast("string"))
    return t("repository_files").where("repo_name is not null").groupBy("repo_name").agg(F.sum(number_of(place)).cast("string").alias("digest"))


@query("s29_tree_digest")
def _(t):
    """SHA-256 of each repository's whole tree: path, NUL, content, NUL in path order. Parts are hashed as they come by,
    sorted on disk, so a tree of any size is read by one task but held by none."""
    def digest(batches):
        name, state = None, None
        for batch in batches:
            done = []
            for repo, path, content in zip(batch["repo_name"], batch["path"], batch["content"]):
                if repo != name:
                    if state is not None:
                        done.append((name, state.hexdigest()))
                    name, state = repo, hashlib.sha256()
                state.update(path.encode() + b"\0" + content.encode() + b"\0")
            yield pd.DataFrame(done, columns=["repo_name", "digest"])
        if state is not None:
            yield pd.DataFrame([(name, state.hexdigest())], columns=["repo_name", "digest"])

    parts = t("repository_files").where("repo_name is not null").select("repo_name", F.coalesce("relative_path", F.lit("")).alias("path"), "file_id", F.coalesce("content", F.lit("")).alias("content"))
    return parts.repartition("repo_name").sortWithinPartitions("repo_name", "path", "file_id").mapInPandas(digest, "repo_name string, digest string")


@query("s30_layout", "select distinct source || '/' || case when (md5_number(group_key) % 100)::bigint = 0 then 'val' else 'train' end || '/' || (md5_number(group_key) % 10)::bigint || '.parquet' as path from documents where group_key is not null")
def _(t):
    g = F.col("group_key")
    return t("documents").where("group_key is not null").select(F.concat("source", F.lit("/"), C.hash_split(g), F.lit("/"), residue(g, 10).cast("string"), F.lit(".parquet")).alias("path")).distinct()


@query("a38_shard_totals", "select shard, sum(n_chars)::bigint as total from (select n_chars, ntile(16) over (order by doc_id) - 1 as shard from documents) group by 1")
def _(t):
    return C.shards(t("documents").select("doc_id", "n_chars"), ["doc_id"], 16).groupBy("shard").agg(F.sum("n_chars").alias("total"))


@query("a40_dense_ids", "select distinct source, dense_rank() over (order by source) - 1 as unit from documents")
def _(t):
    return t("documents").select("source").distinct().select("source", (F.dense_rank().over(Window.orderBy("source")) - 1).alias("unit"))


@query("u01_union_all", "select 0 as ordinal, file_id as record, source from repository_files union all select 1, function_id, source from code_functions")
def _(t):
    a = t("repository_files").select(F.lit(0).alias("ordinal"), F.col("file_id").alias("record"), "source")
    return a.unionByName(t("code_functions").select(F.lit(1).alias("ordinal"), F.col("function_id").alias("record"), "source"))


@query("u02_ranked_concat", "select keep_order, source, count(*) as n from (select source from repository_files union all select source from code_functions union all select source from raw_traces) join source_catalog using (source) group by 1, 2")
def _(t):
    parts = [t(n).select("source") for n in ("repository_files", "code_functions", "raw_traces")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(t("source_catalog").select("source", "keep_order")), "source").select("keep_order", "source", "n")


@query("u03_right_wins_union", "select key, arg_max(v, side) as v from (select 'n' || n_nationkey as key, 0 as side, n_name as v from nation union all select 'n' || s_nationkey, 1, min(s_name) from supplier group by s_nationkey) group by 1")
def _(t):
    left = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("key"), F.lit(0).alias("side"), F.col("n_name").alias("v"))
    right = t("supplier").groupBy(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("key")).agg(F.lit(1).alias("side"), F.min("s_name").alias("v")).select("key", "side", "v")
    return left.unionByName(right).groupBy("key").agg(F.max_by("v", "side").alias("v"))


@query("u04_first_occurrence", "select topic, doc_id from (select topic, doc_id, row_number() over (partition by topic order by doc_id) as n from documents where topic is not null) where n = 1")
def _(t):
    return t("documents").where("topic is not null").groupBy("topic").agg(F.min("doc_id").alias("doc_id"))


@query("u05_set_difference", "select c_nationkey as nation from customer except select s_nationkey from supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).subtract(t("supplier").select("s_nationkey"))


@query("u06_set_intersection", "select c_nationkey as nation from customer intersect select s_nationkey from supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).intersect(t("supplier").select("s_nationkey"))


@query("j06_split_membership", "select k, doc_id, split from (select group_key as k, doc_id, case when (md5_number(group_key) % 100)::bigint < 3 then 'val' when (md5_number(group_key) % 100)::bigint < 6 then 'test' else 'train' end as split, row_number() over (partition by group_key order by doc_id) as n from documents where group_key is not null) where n = 1")
def _(t):
    rows = t("documents").where("group_key is not null").groupBy(F.col("group_key").alias("k")).agg(F.min("doc_id").alias("doc_id"))
    part = residue(F.col("k"))
    return rows.select("k", "doc_id", F.when(part < 3, "val").when(part < 6, "test").otherwise("train").alias("split"))


@query("j07_val_membership", "select trace_id, problem_id from raw_traces where problem_id in (select problem_id from (select distinct problem_id from raw_traces) order by sha1('3:' || problem_id), problem_id limit 10)")
def _(t):
    chosen = S.choose(t("raw_traces").select("problem_id").distinct(), "problem_id", 10, 3)
    return t("raw_traces").join(F.broadcast(chosen), "problem_id", "left_semi").select("trace_id", "problem_id")
