"""Queries of token sequences, packing, repetition and import graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import text as X
from millrace.functions.hashing import residue
from millrace.functions.names import repository_key
from millrace.operators import curation as C
from millrace.operators import graphs, sequences as Q
from millrace.operators.components import connected_components
from millrace.operators.ranking import global_rank, grouped_rank
from millrace.plans.curate import words_sql
from millrace.plans.registry import query
from millrace.session import cut, spread


def encoded(t):
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    return spread(t("documents").where("text is not null").select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", encode("text").alias("tokens"))


@query("q01_encode")
def _(t):
    return encoded(t).select("doc_id", F.size("tokens").alias("n"), F.sha1(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query("q02_pair_scores", "select a, b, f, r, round(f * ln(r), 6) as score from (select a, b, sum(n)::bigint as f, count(distinct source) as r from (select source, word[i] as a, word[i + 1] as b, count(*) as n from (select source, word, unnest(range(1, length(word))) as i from (select source, unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents where text is not null)) group by 1, 2, 3) group by 1, 2) where r > 1 order by score desc, f desc, a, b limit 100")
def _(t):
    """The merge order of source-attributed pairs: frequency times log of the number of sources, then frequency, then the
    smaller pair. Vocabularies are given, so the merges themselves are not repeated here."""
    words = t("documents").where("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    counted = words.groupBy("source", "word").agg(F.count("*").alias("n"))
    pairs = counted.where(F.length("word") > 1).select("source", "n", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("i")).select("source", "n", F.substr("word", F.col("i"), F.lit(1)).alias("a"), F.substr("word", F.col("i") + 1, F.lit(1)).alias("b"))
    per = pairs.groupBy("a", "b", "source").agg(F.sum("n").alias("n")).groupBy("a", "b").agg(F.sum("n").alias("f"), F.count("*").alias("r")).where("r > 1")
    return per.withColumn("score", F.round(F.col("f") * F.log("r"), 6)).orderBy(F.desc("score"), F.desc("f"), "a", "b").limit(100)


@query("q02_piece_pair_scores")
def _(t):
    """Scores of all byte pairs over all pieces of the split pattern, pairs of one source (score 0) among them. No
    statement: RE2 has neither the pattern's lookahead nor its possessive repeats."""
    return Q.pair_scores(Q.piece_counts(spread(t("documents").select("source", "text")), "text", "source"))


@query("q18_pair_order")
def _(t):
    """All pairs in the order in which they would be merged: score, then frequency, then the smaller pair."""
    scored = Q.pair_scores(Q.piece_counts(spread(t("documents").select("source", "text")), "text", "source")).where("r > 1")
    down = scored.select("a", "b", "f", "r", "score", (-F.col("score")).alias("_s"), (-F.col("f")).alias("_f"))
    return global_rank(down, ["_s", "_f", "a", "b"]).drop("_s", "_f")


_TOP = "select a, b, f, r, round(f * ln(r), 6) as score from (select a, b, sum(n)::bigint as f, count(distinct source) as r from (select source, word[i] as a, word[i + 1] as b, count(*) as n from (select source, word, unnest(range(1, length(word))) as i from (select source, unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents where text is not null)) group by 1, 2, 3) group by 1, 2)"


@query("k04_best_pair", f"{_TOP} order by score desc, f desc, a, b limit 1")
def _(t):
    """The one pair that would be merged first: a maximum over structs, combined before the shuffle. Merges are not carried
    out, as vocabularies are given."""
    words = t("documents").where("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).groupBy("source", "word").agg(F.count("*").alias("n"))
    pairs = words.where(F.length("word") > 1).select("source", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    per = pairs.groupBy("pair", "source").agg(F.sum("n").alias("n")).groupBy("pair").agg(F.sum("n").alias("f"), F.count("*").alias("r"))
    score = F.round(F.col("f") * F.log("r"), 6)
    first = per.agg(F.min_by(F.struct("pair", "f", "r", score.alias("score")), F.struct(-score, -F.col("f"), "pair")).alias("p"))
    return first.select(F.substr("p.pair", F.lit(1), F.lit(1)).alias("a"), F.substr("p.pair", F.lit(2), F.lit(1)).alias("b"), "p.f", "p.r", "p.score")


def pieces(t, window=512):
    """Pieces of all documents with their text, numbered in their document; ``last`` marks a document's end."""
    cut_ = Q.piece_cutter(t.spark, Q.vocabulary(t("tokenizer_vocab")), window)
    texts = spread(t("documents").where("text is not null").select("doc_id", "source", "lang", "text"))
    rows = texts.withColumn("p", cut_("text", "lang")).select("doc_id", "source", "lang", F.size("p").alias("n"), F.posexplode("p").alias("piece", "p"))
    return rows.select("doc_id", "source", "lang", "piece", "p.start", "p.end", (F.col("piece") + 1 == F.col("n")).alias("last"), "p.text")


@query("q03_pieces")
def _(t):
    return pieces(t).select("doc_id", "source", "piece", "start", "end")


@query("q04_statement_cuts")
def _(t):
    """Pieces of Python and C++ documents: their ends follow top-level statements."""
    cut_ = Q.piece_cutter(t.spark, Q.vocabulary(t("tokenizer_vocab")), 256)
    return spread(t("documents").where("lang in ('Python', 'C++') and text is not null").select("doc_id", "lang", "text")).select("doc_id", "lang", F.size(cut_("text", "lang")).alias("pieces"))


def examples(t):
    """Pieces with the infilling example drawn for some of them."""
    key = F.concat_ws(":", F.lit("infill"), F.col("doc_id").cast("string"), F.col("piece").cast("string"))
    return pieces(t).withColumn("x", Q.infilled("text", key, "lang"))


@query("q05_infilling")
def _(t):
    return examples(t).where("x.mode is not null").select("doc_id", "piece", "x.mode", F.length("x.example").alias("n"))


#: An example's marks are three tokens more than its piece.
MARKS = 3


def packed_pieces(t, capacity=2048):
    """(shard, doc_id, piece, size, closed, row): a piece takes a slot for its start and what is read of it; a document's
    last piece and an example are whole and need their end in the row, other pieces go on elsewhere."""
    drawn = F.col("x.mode").isNotNull()
    rows = cut(examples(t).select("doc_id", "piece", (1 + F.col("end") - F.col("start") + F.when(drawn, MARKS).otherwise(0)).alias("size"), (F.col("last") | drawn).alias("closed")))
    return Q.pack_shards(rows.withColumn("shard", Q.shard_of(rows.count(), "doc_id")), "shard", ["doc_id", "piece"], "size", capacity, closed="closed")


@query("q06_best_fit")
def _(t):
    """Rows of pieces; in a row the whole pieces come first (``place``), then those that go on elsewhere."""
    place = F.row_number().over(Window.partitionBy("shard", "row").orderBy(F.desc("closed"), "doc_id", "piece"))
    return packed_pieces(t).withColumn("place", place)


@query("a39_fill_rate")
def _(t):
    packed = packed_pieces(t).groupBy("shard").agg(F.sum("size").alias("tokens"), F.count_distinct("row").alias("rows"))
    return packed.select("shard", "rows", F.round(F.col("tokens") / (F.col("rows") * 2048), 6).alias("filled"))


def packed_completions(t, capacity=4096):
    """(shard, completion_id, piece, size, row) in tokens: a text longer than a row is whole rows and a rest, its pieces in
    order; a piece may not be told from another of its size before it is packed."""
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    sized = spread(t("completions").where("text is not null").select("completion_id", "text")).select("completion_id", F.size(encode("text")).alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(capacity))
    parts = cut(sized.select("completion_id", F.posexplode(starts).alias("piece", "start"), "n").select("completion_id", "piece", F.least(F.col("n") - F.col("start"), F.lit(capacity)).alias("size")))
    return Q.pack_shards(parts.withColumn("shard", Q.shard_of(parts.count(), "completion_id")), "shard", ["completion_id", "piece"], "size", capacity, most=255)


@query("q07_first_fit")
def _(t):
    return packed_completions(t).select("shard", "completion_id", "piece", "size", "row")


@query("q20_packed_rollouts")
def _(t):
    """Rows of prompt and completion: bounds, the positions that are trained on (those that predict the completion), and a
    position's weight, the sample's advantage in its prompt over the tokens of the batch. Sequences longer than a row
    are in none (null)."""
    capacity = 4096
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    prompts = spread(t("benchmark").where("text is not null").select("item_id", "text")).select("item_id", F.size(encode("text")).alias("context"))
    sized = spread(t("completions").where("text is not null and item_id is not null").select("completion_id", "item_id", "finish_reason", "text")).select("completion_id", "item_id", F.when(F.col("finish_reason") == "stop", 1.0).otherwise(0.0).alias("reward"), F.size(encode("text")).alias("n"))
    rows = cut(sized.join(F.broadcast(prompts), "item_id").withColumn("size", F.col("context") + F.col("n")))
    means = rows.groupBy("item_id").agg(F.avg("reward").alias("mean"))
    whole = rows.agg(F.stddev_pop("reward").alias("spread"), F.sum("n").alias("tokens"))  # one row
    weighed = rows.join(means, "item_id").crossJoin(F.broadcast(whole))
    weight = F.coalesce((F.col("reward") - F.col("mean")) / F.nullif(F.col("spread"), F.lit(0.0)) / F.nullif(F.col("tokens"), F.lit(0)), F.lit(0.0))
    fits = rows.where(F.col("size") <= capacity)
    packed = Q.pack_shards(fits.withColumn("shard", Q.shard_of(rows.count(), "completion_id")), "shard", ["completion_id"], "size", capacity, most=255).drop("size")
    stop = F.sum("size").over(Window.partitionBy("shard", "row").orderBy("completion_id").rowsBetween(Window.unboundedPreceding, 0))
    placed = packed.join(rows.select("completion_id", "size", "context", "n"), "completion_id").withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
    spans = placed.select("completion_id", "shard", "row", "start", "stop", (F.col("start") + F.col("context") - 1).alias("first_loss"), (F.col("stop") - 2).alias("last_loss"))
    return weighed.select("completion_id", F.round(weight, 12).alias("weight")).join(spans, "completion_id", "left")


@query("q08_row_assembly")
def _(t):
    """What a row reads: before each piece its start mark (-1), then its tokens; a position is trained on (mask 1) but for
    the start mark of a piece that follows one going on elsewhere, as nothing ended there."""
    encode = Q.encoder(t.spark, Q.vocabulary(t("tokenizer_vocab")))
    ids = cut(pieces(t).select("doc_id", "piece", "last", encode("text").alias("ids")).withColumn("size", 1 + F.size("ids")))
    packed = Q.pack_shards(ids.drop("ids").withColumn("shard", Q.shard_of(ids.count(), "doc_id")), "shard", ["doc_id", "piece"], "size", 2048, closed="last").drop("size", "last")
    order = F.struct(~F.col("last"), "doc_id", "piece", "last", "ids")
    rows = packed.join(ids, ["doc_id", "piece"]).groupBy("shard", "row").agg(F.array_sort(F.collect_list(order)).alias("pieces"))
    bos = F.array(F.lit(-1))
    read = F.flatten(F.transform("pieces", lambda p: F.concat(bos, p["ids"])))
    ended = F.transform("pieces", lambda p, i: F.when(i == 0, F.lit(1)).otherwise(F.element_at("pieces", F.greatest(i, F.lit(1)))["last"].cast("int")))
    mask = F.flatten(F.zip_with("pieces", ended, lambda p, e: F.concat(F.array(e), F.array_repeat(F.lit(1), F.size(p["ids"])))))
    return rows.select("shard", "row", F.size(read).alias("n"), F.sha1(F.array_join(read.cast("array<string>"), ",")).alias("ids"), F.sha1(F.array_join(mask.cast("array<string>"), ",")).alias("mask"))


_KEPT = "(select doc_id, n_chars + 1 as size from documents where (md5_number(group_key) % 100)::bigint = 0 and n_chars between 1 and 30000)"


@query("q12_spans_in_rows", f"select doc_id, size - 1 as length, true as inside from {_KEPT}")
def _(t):
    """Where each held-out document stands in the packed rows: one piece a document, else an error; documents longer than
    a row are left out before, as they are in training. The statement checks lengths and that rows hold their spans."""
    kept = cut(t("documents").where((C.hash_split(F.col("group_key")) == "val") & F.col("n_chars").between(1, 30000)).select("doc_id", (F.col("n_chars") + 1).cast("int").alias("size")))
    packed = Q.pack_shards(kept.withColumn("shard", Q.shard_of(kept.count(), "doc_id")), "shard", ["doc_id"], "size", 32768)
    return Q.spans_in_rows(packed).select("doc_id", (F.col("stop") - F.col("start")).cast("long").alias("length"), ((F.col("start") >= 1) & (F.col("stop") <= 32768)).alias("inside"))


@query("q09_stage_shares", "with n as (select source, sum(n_chars) as n from documents group by 1), g as (select stage, group_name, share_kind, share, stage_tokens, sum(coalesce(n.n, 0))::double as have from (select *, unnest(sources) as source from mixture_groups) left join n using (source) group by all), f as (select *, case when share_kind = 'fixed' then share when share_kind = 'supply' then have / (stage_tokens * 4) end as s from g) select stage, group_name, round(coalesce(s, 1 - sum(s) over (partition by stage)), 6) as share from f")
def _(t):
    have = t("documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    groups = t("mixture_groups").select("stage", "group_name", "share_kind", "share", "stage_tokens", F.explode("sources").alias("source")).join(have, "source", "left").groupBy("stage", "group_name", "share_kind", "share", "stage_tokens").agg(F.sum(F.coalesce("n", F.lit(0))).cast("double").alias("have"))
    s = F.when(F.col("share_kind") == "fixed", F.col("share")).when(F.col("share_kind") == "supply", F.col("have") / (F.col("stage_tokens") * 4))
    return groups.withColumn("s", s).select("stage", "group_name", F.round(F.coalesce("s", 1 - F.sum("s").over(Window.partitionBy("stage"))), 6).alias("share"))


_REPO = "nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\\s/]+|[\\s/]+$', '', 'g'), '\\.git[\\s/]*$', ''), '\\s*/[\\s/]*', '/', 'g')), '')"


@query("q10_components", f"with recursive e as (select {_REPO.format('from_repo')} as a, {_REPO.format('to_repo')} as b from repo_links), s as (select a, b from e where a is not null and b is not null union select b, a from e where a is not null and b is not null), n as (select distinct x as node from (select a as x from e union all select b from e) where x is not null), r as (select node, node as seen from n union select r.node, s.b from r join s on r.seen = s.a) select node, min(seen) as component from r group by 1")
def _(t):
    links = t("repo_links").select(repository_key(F.col("from_repo")).alias("u"), repository_key(F.col("to_repo")).alias("v"))
    return connected_components(links)


def repository_files(t):
    """Files under their repository's one spelling."""
    return t("repository_files").withColumn("repo", repository_key(F.col("repo_name"))).where("repo is not null").select("repo", "source", "lang", "file_id", "relative_path", "content")


@query("q11_dependency_order")
def _(t):
    return graphs.samples(repository_files(t))


@query("j12_import_edges")
def _(t):
    return graphs.samples(repository_files(t)).where("imports > 0").select("repo", "lang", "file_id", "imports")


#: A small repository in each language: absolute, relative and unparsable imports, a cycle, includes beside, above and by
#: their ends, and files that nothing joins.
LITERAL_FILES = [
    (1, "a/b", "Python", "main.py", "import pkg.core\nfrom pkg import loop_a\n"),
    (2, "a/b", "Python", "pkg/__init__.py", ""),
    (3, "a/b", "Python", "pkg/core.py", "from .util import helper\nimport os\n"),
    (4, "a/b", "Python", "pkg/util.py", "x = 1\n"),
    (5, "a/b", "Python", "pkg/loop_a.py", "from . import loop_b\n"),
    (6, "a/b", "Python", "pkg/loop_b.py", "from pkg.loop_a import z\n"),
    (7, "a/b", "Python", "lone.py", "import lone\nfrom ... import up\n"),
    (8, "a/b", "Python", "old/broken.py", "import old.tool\nprint 'x'\n"),
    (9, "a/b", "Python", "old/tool.py", ""),
    (10, "a/b", "C++", "src/main.cpp", '#include "util.h"\n#include <deep/x.h>\n#include <vector>\n'),
    (11, "a/b", "C++", "src/util.h", '#include "../include/vec.h"\n'),
    (12, "a/b", "C++", "include/vec.h", '#include "../../out.h"\n'),
    (13, "a/b", "C++", "lib/deep/x.h", ""),
    (14, "a/b", "C++", "lib/util.h", ""),
    (15, "c/d", "Python", "main.py", "import pkg.core\n"),
]


def literal_files(t):
    return t.spark.createDataFrame([(*row[:4], row[4], "s") for row in LITERAL_FILES], "file_id long, repo string, lang string, relative_path string, content string, source string")


@query("j12_literal_edges", "select * from (values (1, 3), (3, 1), (5, 2), (6, 1), (8, 1), (10, 2), (11, 1)) v(file_id, imports)")
def _(t):
    """Imports of a repository that holds every kind of them."""
    return graphs.samples(literal_files(t)).where("imports > 0").select("file_id", F.col("imports").cast("long").alias("imports"))


_LINKS = "(values (1, 3), (1, 2), (1, 5), (3, 4), (5, 6), (5, 2), (6, 5), (8, 9), (10, 11), (10, 13), (11, 12)) l(a, b)"


@query("q11_literal_order", f"with recursive l as (select * from {_LINKS}), both_ as (select a, b from l union select b, a from l), f as (select unnest(range(1, 16)) as id), r as (select id, id as seen from f union select r.id, both_.b from r join both_ on r.seen = both_.a), d as (select a, b from l union select d.a, l.b from d join l on d.b = l.a) select f.id as file_id, (select count(*) from r where r.id = f.id) as size, true as after_imports, coalesce((select count(*) from d x join d y on x.a = y.b and x.b = y.a where x.a = f.id and x.b <> f.id), 0) as in_cycle from f")
def _(t):
    """Of each file: how many its sample has, whether it comes after all it imports (its own cycle aside), and how many files
    are in its cycle besides it. The statement follows the links by recursion."""
    placed = cut(graphs.samples(literal_files(t)).select("repo", "lang", "sample", "file_id", "position"))
    links = t.spark.createDataFrame([(1, 3), (1, 2), (1, 5), (3, 4), (5, 6), (5, 2), (6, 5), (8, 9), (10, 11), (10, 13), (11, 12)], "file_id long, b long")
    cycle = t.spark.createDataFrame([(5, 1), (6, 1)], "file_id long, in_cycle long")
    other = placed.select(F.col("file_id").alias("b"), F.col("position").alias("at"), F.col("sample").alias("there"), F.col("repo").alias("_repo"), F.col("lang").alias("_lang"))
    kept = links.join(placed, "file_id").join(other, "b").where("not (file_id in (5, 6) and b in (5, 6))").groupBy("file_id").agg(F.bool_and((F.col("at") < F.col("position")) & (F.col("there") == F.col("sample")) & (F.col("lang") == F.col("_lang"))).alias("kept"))
    size = F.count("*").over(Window.partitionBy("repo", "lang", "sample"))
    return placed.withColumn("size", size).join(kept, "file_id", "left").join(cycle, "file_id", "left").select("file_id", "size", F.coalesce("kept", F.lit(True)).alias("after_imports"), F.coalesce("in_cycle", F.lit(0)).cast("long").alias("in_cycle"))


@query("q15_repository_documents", f"select repo, count(*) as files, sum(length(content))::bigint as chars from (select *, row_number() over (partition by repo, relative_path order by keep_order, file_id) as n from (select f.*, {_REPO.format('repo_name')} as repo from repository_files f) join (select source, keep_order from source_catalog) using (source) where repo is not null and relative_path is not null and content is not null) where n = 1 group by 1")
def _(t):
    """Of a path delivered by several sources the first source's file; sums stand for the joined texts (see p11)."""
    rows = t("repository_files").withColumn("repo", repository_key(F.col("repo_name"))).where("repo is not null and relative_path is not null and content is not null").join(F.broadcast(t("source_catalog").select("source", "keep_order")), "source")
    first = rows.groupBy("repo", "relative_path").agg(F.min_by(F.length("content"), F.struct("keep_order", "file_id")).alias("chars"))
    return first.groupBy("repo").agg(F.count("*").alias("files"), F.sum("chars").alias("chars"))


@query("q15_document_parts")
def _(t):
    """The document of each repository and language over all its sources: of a path the first source's file, files in the
    order of the samples, as parts with offsets."""
    order = F.broadcast(t("source_catalog").select("source", "keep_order"))
    files = repository_files(t).join(order, "source")
    texts = files.select("file_id", X.file_text(F.col("relative_path"), F.col("content"), F.col("lang")).alias("text"))
    return graphs.document_parts(graphs.samples(files, ("keep_order", "file_id")), texts, ["repo", "lang"])


@query("q16_trailing_parts", "select lang, part, n from (select *, coalesce(sum(n) over (partition by lang order by part desc rows between unbounded preceding and 1 preceding), 0) as after_ from (select lang, (md5_number(file_id::varchar) % 20)::bigint as part, sum(length(content))::bigint as n from repository_files where content is not null group by 1, 2)) where after_ < 200000")
def _(t):
    parts = t("repository_files").where("content is not null").groupBy("lang", residue(F.col("file_id").cast("string"), 20).alias("part")).agg(F.sum(F.length("content")).alias("n"))
    after = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.withColumn("after_", after).where("after_ < 200000").select("lang", "part", "n")


_SHARDS = "(select *, sum(n) over (partition by source order by shard) - n as before from (select source, (md5_number(doc_id::varchar) % 10)::bigint as shard, sum(n_chars)::bigint as n from documents group by 1, 2))"
_NEEDS = "(select stage, source, max(case share_kind when 'supply' then 1e18 else share * stage_tokens * 4 / len(sources) end) as need from (select *, unnest(sources) as source from mixture_groups) where share_kind <> 'rest' group by 1, 2)"
_DRAWN = f"(select source, shard, n, before from {_SHARDS} join {_NEEDS} using (source) where stage = 'file_level' and before < need)"


@query("q17_shards_for_draw", f"select source, shard, n, 'file_level' as stage from {_DRAWN} union all select s.source, s.shard, s.n, 'repo_level' from {_SHARDS} s join {_NEEDS} d on s.source = d.source and d.stage = 'repo_level' left join (select source, max(before + n) as upto from {_DRAWN} group by 1) u on s.source = u.source where s.before >= coalesce(upto, 0) and s.before - coalesce(upto, 0) < need")
def _(t):
    """Which shards each stage packs: whole corpora whole, others until the stage's draw is covered; the second stage goes on
    behind the first, so no document is packed twice. Ten shards a source: the windows run over shards."""
    shards = t("documents").groupBy("source", residue(F.col("doc_id").cast("string"), 10).alias("shard")).agg(F.sum("n_chars").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("shard")) - F.col("n")
    shards = shards.withColumn("before", before)
    need = F.when(F.col("share_kind") == "supply", F.lit(1e18)).otherwise(F.col("share") * F.col("stage_tokens") * 4 / F.size("sources"))
    needs = t("mixture_groups").where("share_kind <> 'rest'").select("stage", need.alias("need"), F.explode("sources").alias("source")).groupBy("stage", "source").agg(F.max("need").alias("need"))
    first = shards.join(needs.where("stage = 'file_level'"), "source").where("before < need")
    upto = first.groupBy("source").agg(F.max(F.col("before") + F.col("n")).alias("upto"))
    behind = F.col("before") - F.coalesce("upto", F.lit(0))
    second = shards.join(needs.where("stage = 'repo_level'"), "source").join(upto, "source", "left").where((behind >= 0) & (behind < F.col("need")))
    return first.select("source", "shard", "n", "stage").unionByName(second.select("source", "shard", "n", "stage"))


@query("q19_row_draw", "with r as (select source, doc_id, row_number() over (partition by source order by doc_id) - 1 as slot from documents), n as (select source, count(*) as n from documents group by 1) select source, slot, doc_id as row_ from r union all select source, unnest(range(n, (n + 31) // 32 * 32)), -1 from n")
def _(t):
    """Rows of each source in order, filled up with -1 to whole batches of 32."""
    ranked = grouped_rank(t("documents").select("source", "doc_id"), ["source"], ["doc_id"])
    sizes = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    filled = sizes.withColumn("upto", F.ceil(F.col("n") / 32) * 32).where("upto > n")
    pad = filled.select("source", F.explode(F.sequence(F.col("n"), F.col("upto") - 1)).alias("slot"), F.lit(-1).cast("long").alias("row_"))
    return ranked.select("source", (F.col("rank") - 1).alias("slot"), F.col("doc_id").alias("row_")).unionByName(pad)


_N = 6
_COVER = f"with w as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from (select doc_id, {words_sql('text')} as w from documents where text is not null)), g as (select doc_id, pos, n, word{''.join(f' || chr(32) || lead(word, {k}) over d' for k in range(1, _N))} as gram from w window d as (partition by doc_id order by pos)), r as (select doc_id, pos, n, count(*) over (partition by doc_id, gram) > 1 as twice from g where gram is not null), c as (select doc_id, any_value(n) as n, list(distinct p) as ps from (select doc_id, n, unnest(range(pos, pos + {_N})) as p from r where twice) group by 1) select r.doc_id, round(coalesce(len(any_value(ps)), 0) / any_value(r.n), 6) as covered from r left join c using (doc_id) group by 1"


@query("w08_repetition_coverage", _COVER)
def _(t):
    rows = Q.repeated_coverage(spread(t("documents").where("text is not null").select("doc_id", "text")), X.words(F.col("text")), _N)
    return rows.select("doc_id", F.round("covered", 6).alias("covered"))


@query("a45_repetition_before_answer")
def _(t):
    return Q.repeated_coverage(t("raw_traces").where("generation is not null").select("trace_id", "generation"), X.words(X.reasoning(F.col("generation"))), 4).select("trace_id", "covered")


def sequences(t):
    """Event kinds by user in time as tokens; every third user's ends in a loop of three, every fifth's in one of forty."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.ascii("event_type").alias("k")))), lambda s: s["k"])
    kinds = t("events").groupBy("user_id").agg(ordered.alias("ids"))
    again = lambda part, n: F.flatten(F.array_repeat(part, n))
    short, long = again(F.array(*map(F.lit, (7, 8, 9))), 40), again(F.sequence(F.lit(1), F.lit(40)), 3)
    return kinds.select("user_id", F.when(F.col("user_id") % 3 == 0, F.concat("ids", short)).when(F.col("user_id") % 5 == 0, F.concat("ids", long)).otherwise(F.col("ids")).alias("ids"))


_IDS = "select user_id, case when user_id % 3 = 0 then ids || flatten(list_transform(range(0, 40), lambda i: [7, 8, 9])) when user_id % 5 = 0 then ids || flatten(list_transform(range(0, 3), lambda i: range(1, 41)::int[])) else ids end as ids from (select user_id, list(ascii(event_type) order by ts, event_id) as ids from events group by 1)"
_CYCLE = f"(select user_id, ids, period, case when period is not null then coalesce(list_max(list_filter(range(1, len(ids) - period + 1), lambda i: ids[i] <> ids[i + period])), 0) end as onset from (select *, list_filter(range(1, 65), lambda p: len(ids) >= 48 + p and ids[len(ids) - 47:] = ids[len(ids) - 47 - p:len(ids) - p])[1] as period from ({_IDS})))"


def cycles(t):
    return sequences(t).select("user_id", "ids", Q.cycle("ids", F.lit(48), F.lit(64)).alias("c"))


@query("w09_exact_cycle", f"select user_id, period::int as period, onset::int as onset from {_CYCLE}")
def _(t):
    return cycles(t).select("user_id", "c.period", "c.onset")


@query("a22_loop_onsets", f"select count(*) as loops, median(onset) as middle from {_CYCLE} where onset is not null")
def _(t):
    return cycles(t).where("c.onset is not null").agg(F.count("*").alias("loops"), F.median("c.onset").alias("middle"))


@query("p40_stop_predicates", f"select user_id, period is not null and not list_contains(ids, 112) as stop from {_CYCLE}")
def _(t):
    """A cycle and no closing token (here a purchase)."""
    return cycles(t).select("user_id", (F.col("c.period").isNotNull() & ~F.array_contains("ids", 112)).alias("stop"))


@query("p40_served_stop")
def _(t):
    """The rule of a served response: it ends with the mark forced at a check that the repetition rule stops."""
    marked = sequences(t).withColumn("ids", F.concat("ids", F.array(F.lit(-1))))
    before = F.slice("ids", 1, F.size("ids") - 1)
    return marked.select("user_id", ((F.element_at("ids", -1) == -1) & Q.repetition_stop(before, F.lit(60), F.lit(6), F.lit(1))).alias("stop"))


_PEN = f"""with s as ({_IDS}), u as (select user_id, ids, len(ids) as n, coalesce(list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = 112)), 0) as mark from s),
m as (select user_id, ids[i + 1] as token, list_max(list_filter(range(1, least(64, n - mark, i) + 1), lambda k: ids[i - k + 1:i] = ids[n - k + 1:n])) as length from (select *, unnest(range(1, n)) as i from u))
select user_id, token, max(length)::int as length, round(0.8 * 1.75 ** (max(length) - 2), 6) as penalty from m where length >= 2 and token <> 112 group by 1, 2"""


@query("q14_repetition_penalty", _PEN)
def _(t):
    """Tokens that would repeat an earlier stretch, with the length they would repeat; a purchase breaks matches."""
    rows = sequences(t).select("user_id", F.explode(Q.penalised([112])("ids")).alias("p"))
    return rows.select("user_id", "p.token", "p.length", F.round("p.penalty", 6).alias("penalty"))


_ROUNDS = f"""with s as ({_IDS}), r as (select user_id, k, ids[:least(k * 32, len(ids), 160)] as part, len(ids) as n from s, (select unnest(range(1, 6)) as k)),
e as (select user_id, k, part, case when list_contains(part, 115) then 'stop' when len(part) >= 160 then 'length' when len(list_filter(range(1, 65), lambda p: len(part) >= 48 + p and part[len(part) - 47:] = part[len(part) - 47 - p:len(part) - p])) > 0 then 'loop' when k * 32 >= n then 'stop' end as finish from r)
select user_id, min(k) as rounds, arg_min(finish, k) as finish, arg_min(len(part), k) as tokens from e where finish is not null group by 1"""


@query("t08_active_rounds", _ROUNDS)
def _(t):
    """Sequences given out in rounds of 32 tokens: after a round one leaves the active set if it holds its stop token or
    has ended, at the limit, or in a loop; the others go on."""
    active, done = cut(sequences(t)), []
    for k in range(1, 6):
        part = F.slice("ids", 1, F.least(F.lit(k * 32), F.size("ids"), F.lit(160)))
        seen = active.withColumn("part", part).withColumn("loop", Q.cycle("part", F.lit(48), F.lit(64))["period"])
        finish = F.when(F.array_contains("part", 115), "stop").when(F.size("part") >= 160, "length").when(F.col("loop").isNotNull(), "loop").when(F.size("ids") <= k * 32, "stop")
        judged = cut(seen.withColumn("finish", finish))
        done.append(judged.where("finish is not null").select("user_id", F.lit(k).cast("long").alias("rounds"), "finish", F.size("part").cast("long").alias("tokens")))
        active = judged.where("finish is null").select("user_id", "ids")
    result = done[0]
    for frame in done[1:]:
        result = result.unionByName(frame)
    return result


_SUPPLY = "(select stage, group_name, share, max_repeats, sum(coalesce(n, 0)) as have from (select *, unnest(sources) as source from mixture_groups where share_kind = 'fixed') left join (select source, sum(n_chars) as n from documents group by 1) using (source) group by all)"


@query("q13_largest_plan", f"select stage, floor(min(have * max_repeats / share) / 8192)::bigint as batches from {_SUPPLY} group by 1")
def _(t):
    """The most batches of 8,192 each stage can train without reading a fixed group beyond its repeats, by bisection."""
    have = t("documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    groups = t("mixture_groups").where("share_kind = 'fixed'").select("stage", "group_name", "share", "max_repeats", F.explode("sources").alias("source")).join(have, "source", "left")
    # the configuration's groups: a few rows
    rows = groups.groupBy("stage", "group_name", "share", "max_repeats").agg(F.sum(F.coalesce("n", F.lit(0))).alias("have")).collect()
    found = []
    for stage in sorted({r.stage for r in rows}):
        mine = [r for r in rows if r.stage == stage]
        most = max(int(r.have) * r.max_repeats for r in mine) * 1000
        found.append((stage, Q.bisect_most(0, most, lambda n: all(n * 8192 * r.share <= r.have * r.max_repeats for r in mine))))
    return t.spark.createDataFrame(found, "stage string, batches long")


@query("s14_token_stream")
def _(t):
    """Offsets of every document in one stream of tokens, in doc_id order."""
    sized = encoded(t).select("doc_id", F.size("tokens").cast("long").alias("n"))
    return global_rank(sized, ["doc_id"], weight="n").select("doc_id", (F.col("running") - F.col("n")).alias("start"), F.col("running").alias("stop"))
