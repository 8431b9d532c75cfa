"""Queries of sources, sinks and streams: each writes under the shared checkpoint folder and reads back."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.hashing import residue
from millrace.operators import sequences as Q
from millrace.operators.curation import shards
from millrace.operators.ranking import global_rank
from millrace.plans.curate import words_sql
from millrace.plans.registry import query
from millrace.session import cut, spread
from millrace.sources import files as S
from millrace.streaming import streams


@query("s02_footer_rows", "select count(*) as n from documents")
def _(t):
    return S.footers(t.spark, f"{t.folder}/documents.parquet", "text").agg(F.sum("rows").alias("n"))


@query("s05_blob_texts", "select doc_id, case doc_id % 5 when 3 then null when 4 then null else sha1(case when doc_id % 5 = 1 then regexp_replace(text, '[^\\x{00}-\\x{FF}]', '?', 'g') else text end) end as digest from documents where text is not null")
def _(t):
    """Blobs in several charsets as texts; of a broken blob and of an unknown charset there is none."""
    k = F.col("doc_id") % 5
    charset = F.when(k == 1, "latin-1").when(k == 2, "utf-16").when(k == 4, "no-such-charset")
    rows = spread(t("documents").where("text is not null").select("doc_id", "text")).withColumn("charset", charset)
    blobs = rows.select("doc_id", "charset", S.text_blob("text", F.when(k != 4, F.col("charset"))).alias("blob"))
    broken = blobs.withColumn("blob", F.when(k == 3, F.substr("blob", F.lit(1), F.lit(9))).otherwise(F.col("blob")))
    return broken.select("doc_id", F.sha1(S.blob_text("blob", "charset")).alias("digest"))


@query("s07_zstd_sink", "select source, count(*) as n from documents group by 1")
def _(t):
    path = S.write_columns(t("documents").select("doc_id", "source"), S.scratch(t.spark, "s07"))
    return t.spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


@query("s08_partitioned_sink", "select (md5_number(group_key) % 10)::bigint as part, count(*) as n from documents where group_key is not null group by 1")
def _(t):
    rows = t("documents").where("group_key is not null").select("doc_id", residue(F.col("group_key"), 10).alias("part"))
    path = S.write_columns(rows, S.scratch(t.spark, "s08"), by=["part"], order=["doc_id"])
    return t.spark.read.schema("doc_id long, part long").parquet(path).groupBy("part").agg(F.count("*").alias("n"))


@query("s09_sharded_sink", "select shard, min(doc_id) as low, max(doc_id) as high, count(*) as n from (select doc_id, ntile(10) over (order by doc_id) - 1 as shard from documents) group by 1")
def _(t):
    path = S.write_columns(shards(t("documents").select("doc_id"), ["doc_id"], 10), S.scratch(t.spark, "s09"), by=["shard"], order=["doc_id"])
    return t.spark.read.schema("doc_id long, shard long").parquet(path).groupBy("shard").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))


@query("s10_json_lines", "select trace_id, sha1(prompt) as digest from raw_traces")
def _(t):
    path = S.scratch(t.spark, "s10")
    S.append_records(t("raw_traces").select("trace_id", "prompt"), path)
    return S.read_records(t.spark, path, "trace_id long, prompt string").select("trace_id", F.sha1("prompt").alias("digest"))


_LOG = "(select user_id as run, event_id as step, case event_type when 'error' then 'failure' when 'signup' then 'run' when 'purchase' then 'val' else 'train' end as kind, (event_id % 3) as attempt, value from events)"


def run_records(t):
    """Events as records of run logs: their kind, step and attempt; only some kinds have a value."""
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "run").when(F.col("event_type") == "purchase", "val").otherwise("train")
    rows = t("events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), kind.alias("kind"), (F.col("event_id") % 3).alias("attempt"), "value")
    return rows.withColumn("value", F.when(F.col("kind").isin("train", "val"), F.col("value")))


@query("s12_run_log", f"select run, kind, max(attempt) as attempts, count(*) as n, round(sum(case when kind in ('train', 'val') then value end), 4) as total from {_LOG} group by 1, 2")
def _(t):
    path = S.scratch(t.spark, "s12")
    S.append_records(run_records(t), path)
    log = S.read_records(t.spark, path, "run long, step long, kind string, attempt long, value double")
    return log.groupBy("run", "kind").agg(F.max("attempt").alias("attempts"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s13_append_sink", "select count(*) * 2 as n from events")
def _(t):
    path = S.scratch(t.spark, "s13")
    for _ in range(2):
        S.append_records(t("events").select("event_id", "value"), path)
    return S.read_records(t.spark, path, "event_id long, value double").agg(F.count("*").alias("n"))


@query("s14_token_files", f"select row_number() over (order by doc_id) - 1 as document, len(w) as n, sha1(array_to_string(list_transform(w, lambda x: length(x)), ',')) as digest from (select doc_id, coalesce({words_sql('text')}, []) as w from documents)")
def _(t):
    """Token arrays (here the lengths of words) written as flat files with their places, and read back."""
    path = S.scratch(t.spark, "s14")
    S.write_token_files(t("documents").select("doc_id", F.transform(X.words(F.col("text")), lambda w: F.length(w)).alias("ids")), path, ["doc_id"], "ids")
    return S.read_token_files(t.spark, path).select("document", F.size("tokens").cast("long").alias("n"), F.sha1(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


def _packed(t):
    """Documents cut at 2,048 characters and packed into rows by best fit."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(2048).cast("long"))
    cuts = t("documents").where("n_chars > 0").select("doc_id", F.posexplode(starts).alias("piece", "start"), "n_chars")
    pieces = cut(cuts.select("doc_id", "piece", "start", (F.least(F.col("start") + 2048, F.col("n_chars")) - F.col("start")).cast("int").alias("size")))
    packed = Q.pack_shards(pieces.withColumn("shard", Q.shard_of(pieces.count(), "doc_id")), "shard", ["doc_id", "piece"], "size", 2048)
    return packed.join(pieces.select("doc_id", "piece", "start"), ["doc_id", "piece"])


@query("s15_packed_sink", "select doc_id, ((n_chars + 2047) // 2048)::bigint as pieces, n_chars as used, true as fits from documents where n_chars > 0")
def _(t):
    """Packed rows as they are stored: a row a group of pieces, in the order in which they are read."""
    order = F.array_sort(F.collect_list(F.struct("doc_id", "piece", "start", "size")))
    path = S.write_columns(_packed(t).groupBy("shard", "row").agg(order.alias("pieces")), S.scratch(t.spark, "s15"), order=["shard", "row"])
    rows = t.spark.read.parquet(path).withColumn("used", F.aggregate("pieces", F.lit(0), lambda a, p: a + p["size"]))
    return rows.select(F.explode("pieces").alias("p"), (F.col("used") <= 2048).alias("fits")).groupBy("p.doc_id").agg(F.count("*").alias("pieces"), F.sum("p.size").alias("used"), F.bool_and("fits").alias("fits"))


@query("s16_packed_source", "select doc_id, sha1(text) as digest from documents where n_chars > 0 and text is not null")
def _(t):
    """Documents put together again from the stored rows: the pieces' places lead back to the text."""
    path = S.write_columns(_packed(t), S.scratch(t.spark, "s16"), order=["shard", "row", "doc_id", "piece"])
    texts = t("documents").where("text is not null").select("doc_id", "text")
    parts = t.spark.read.parquet(path).join(texts, "doc_id").select("doc_id", "piece", F.substr("text", (F.col("start") + 1).cast("int"), F.col("size")).alias("part"))
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    return joined.select("doc_id", F.sha1(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("digest"))


@query("s17_key_value_store", "select user_id::varchar as key, arg_max(event_type, (ts, event_id)) as value from events group by 1")
def _(t):
    store = S.KeyValue(S.scratch(t.spark, "s17"))
    at = F.struct("ts", "event_id")
    keyed = t("events").groupBy(F.col("user_id").cast("string").alias("key"))
    store.put(keyed.agg(F.min_by("event_type", at).alias("value")), 0)
    store.put(keyed.agg(F.max_by("event_type", at).alias("value")), 1)
    return store.get(t("events").select(F.col("user_id").cast("string").alias("key")).distinct())


@query("s20_numbered_json", "select number, row_number() over (order by number) as place, count(*) as n from (select (md5_number(event_id::varchar) % 12)::bigint as number from events) group by 1")
def _(t):
    """Compressed files of records read in the order of the numbers in their names, not of the names."""
    path = S.scratch(t.spark, "s20")
    rows = t("events").select("event_id", residue(F.col("event_id").cast("string"), 12).alias("number"))
    rows.repartition("number").write.partitionBy("number").option("compression", "gzip").json(path)
    read = t.spark.read.schema("event_id long").option("recursiveFileLookup", "true").json(path).withColumn("file", F.col("_metadata.file_path"))
    files = read.groupBy("file").agg(F.count("*").alias("n")).withColumn("number", F.regexp_extract("file", r"number=(\d+)/[^/]*$", 1).cast("long"))
    return global_rank(files.groupBy("number").agg(F.sum("n").alias("n")), ["number"], rank="place").select("number", "place", "n")


_CELLS = "(select event_id // 200 as step, event_type, event_id % 2 as attempt, max(value) as value from events group by 1, 2, 3)"


@query("s21_matrix_sidecar", f"select step, " + ", ".join(f"round(coalesce(max(value) filter (event_type = '{c}' and attempt = 1), max(value) filter (event_type = '{c}' and attempt = 0)), 6) as {c}" for c in ("click", "error", "purchase", "signup", "view")) + f" from {_CELLS} group by 1")
def _(t):
    """A matrix of steps and catalogued columns beside a log: written by attempts as fixed-width rows with NaN for what is
    missing, read with the latest attempt's values over the earlier ones and null for NaN."""
    columns = ["click", "error", "purchase", "signup", "view"]  # the catalogue
    cells = t("events").groupBy(F.floor(F.col("event_id") / 200).alias("step"), (F.col("event_id") % 2).alias("attempt"), "event_type").agg(F.max("value").alias("value"))
    wide = cells.groupBy("step", "attempt").pivot("event_type", columns).agg(F.first("value"))
    path = S.scratch(t.spark, "s21")
    for attempt in (0, 1):  # a resumed run writes its steps again
        row = F.array(*[F.coalesce(c, F.lit(float("nan"))) for c in columns])
        wide.where(F.col("attempt") == attempt).select("step", "attempt", row.alias("row")).write.mode("append").parquet(path)
    read = t.spark.read.parquet(path).select("step", "attempt", *[F.nanvl(F.get("row", F.lit(i)), F.lit(None).cast("double")).alias(c) for i, c in enumerate(columns)])
    latest = [F.round(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("attempt"))), 6).alias(c) for c in columns]
    return read.groupBy("step").agg(*latest)


@query("s22_atomic_replace", "select 'before' as seen, count(*) as n from region union all select 'by the old reader', count(*) from region union all select 'after', count(*) from nation")
def _(t):
    """A table is replaced while a reader holds the version before: both see whole tables."""
    stored = S.Replaced(t.spark, S.scratch(t.spark, "s22"))
    stored.replace(t("region"))
    old = stored.read()
    before = old.agg(F.count("*").alias("n")).select(F.lit("before").alias("seen"), "n")
    stored.replace(t("nation"))
    late = old.agg(F.count("*").alias("n")).select(F.lit("by the old reader").alias("seen"), "n")
    return before.unionByName(late).unionByName(stored.read().agg(F.count("*").alias("n")).select(F.lit("after").alias("seen"), "n"))


@query("s24_report_sink", "select source, count(*) as n from documents group by 1")
def _(t):
    path = S.scratch(t.spark, "s24")
    report = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    report.select(F.to_json(F.struct("source", F.struct("n").alias("counts"))).alias("value")).write.text(path)
    return t.spark.read.text(path).select(F.from_json("value", "source string, counts struct<n: long>").alias("r")).select("r.source", "r.counts.n")


@query("s26_tokenizer_file", "select token_rank, token_b64 from tokenizer_vocab")
def _(t):
    path = S.scratch(t.spark, "s26")
    S.tokenizer_lines(t("tokenizer_vocab")).write.text(path)
    return S.read_tokenizer(t.spark.read.text(path))


@query("s28_session_settings")
def _(t):
    """A session made for large inputs: its settings bound what a task holds, so that operators spill and batches stay small.
    They are set on a session of their own, and an aggregation runs under them."""
    settings = {"spark.sql.files.maxPartitionBytes": "64m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1000", "spark.sql.windowExec.buffer.spill.threshold": "100000"}
    session = t.spark.newSession()
    for name, value in settings.items():
        session.conf.set(name, value)
    groups = session.read.parquet(f"{t.folder}/documents.parquet").groupBy("source").count().count()
    return t.spark.createDataFrame([(n, session.conf.get(n), groups) for n in settings], "name string, value string, groups long")


@query("s31_prepare", "select source, lang, count(*) as n from repository_files where content is not null group by 1, 2")
def _(t):
    from millrace.functions.text import content_id, normalize_lines

    text = normalize_lines(F.col("content"))
    rows = t("repository_files").where("content is not null").select("source", "lang", content_id(text).alias("id"), text.alias("content"))
    path = S.write_columns(rows, S.scratch(t.spark, "s31"))
    return t.spark.read.parquet(path).groupBy("source", "lang").agg(F.count("*").alias("n"))


# ---- streams, run to the end of what is there

def _event_files(t, name):
    path = S.scratch(t.spark, name)
    t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props").repartition(3).write.parquet(path)
    return path


@query("t01_run_log_stream", "select kind, count(*) as n, true as ended from (select case when event_id % 4 = 0 then 'val' else 'train' end as kind from events union all select 'end') group by 1")
def _(t):
    """A watcher reads an append-only log as it grows, until the record that ends it."""
    path, sink, state = S.scratch(t.spark, "t01"), S.scratch(t.spark, "t01-sink"), S.scratch(t.spark, "t01-state")
    records = t("events").select("event_id", F.when(F.col("event_id") % 4 == 0, "val").otherwise("train").alias("kind"))
    end = t.spark.createDataFrame([(-1, "end")], "event_id long, kind string")
    half = F.col("event_id") % 2 == 0
    ended = []
    for part in (records.where(half), records.where(~half), end):  # the log between three looks at it
        part.write.mode("append").json(path)
        log = streams.run_log(t.spark, path, "event_id long, kind string", files=100)
        ended.append(streams.until_end(log, state, lambda rows, k: rows.withColumn("batch", F.lit(k)).write.mode("append").parquet(sink)))
    return t.spark.read.parquet(sink).groupBy("kind").agg(F.count("*").alias("n")).withColumn("ended", F.lit(ended == [False, False, True]))


@query("t02_exchange", "select event_id % 4 as k, (event_id % 4)::bigint as place, count(*) as n, true as finished from events group by 1, 2")
def _(t):
    """Batches left out of order are taken in the order of k, each once over two readers, up to the last one."""
    folder, state, sink = (S.scratch(t.spark, n) for n in ("t02", "t02-state", "t02-sink"))
    rows, order = t("events").select("event_id", (F.col("event_id") % 4).alias("k")), []
    left = streams.Exchange(t.spark, folder, state)

    def take(batch, k):
        batch.withColumn("place", F.lit(len(order)).cast("long")).write.mode("append").parquet(sink)
        order.append(k)

    finished = []
    for ks in ((1, 0), (3, 2)):
        for k in ks:
            left.put(rows.where(F.col("k") == k), k)
        if 3 in ks:
            left.close(3)
        finished.append(streams.Exchange(t.spark, folder, state).take(take))
    done = finished == [False, True] and streams.Exchange(t.spark, folder, state).take(take) and order == [0, 1, 2, 3]
    return t.spark.read.parquet(sink).groupBy("k", "place").agg(F.count("*").alias("n")).withColumn("finished", F.lit(done))


@query("s23_file_exchange", "select user_id, count(*) as n from events group by 1")
def _(t):
    """The same files as a stream: one file at a time, each once by the checkpoint; read ones are moved away."""
    path, sink, state, done = _event_files(t, "s23"), S.scratch(t.spark, "s23-sink"), S.scratch(t.spark, "s23-state"), S.scratch(t.spark, "s23-done")
    for _ in range(2):  # a second run finds nothing new
        streams.run_to_end(streams.exchange(t.spark, path, streams.EVENTS, done).select("user_id", "event_id"), state, sink=sink)
    return t.spark.read.parquet(sink).groupBy("user_id").agg(F.count("*").alias("n"))


@query("t07_bounded_batches", "select event_id % 6 as k, count(*) as n, true as ordered from events group by 1")
def _(t):
    """At most two files are in work at a time, in the order in which they came."""
    path, sink = S.scratch(t.spark, "t07"), S.scratch(t.spark, "t07-sink")
    for k in range(6):
        t("events").where(F.col("event_id") % 6 == k).select("event_id", (F.col("event_id") % 6).alias("k")).coalesce(1).write.mode("append").parquet(path)
    stream = t.spark.readStream.schema("event_id long, k long").option("maxFilesPerTrigger", 2).parquet(path)
    streams.run_to_end(stream, S.scratch(t.spark, "t07-state"), each=lambda rows, number: rows.withColumn("batch", F.lit(number)).write.mode("append").parquet(sink))
    return t.spark.read.parquet(sink).groupBy("k").agg(F.count("*").alias("n"), (F.max("batch") == F.min("batch")).alias("one"), F.min("batch").alias("batch")).select("k", "n", (F.col("one") & (F.col("batch") == F.floor(F.col("k") / 2))).alias("ordered"))


@query("t03_resume", "select event_id, 1 as times from events")
def _(t):
    """A consumer that was stopped half way goes on with what its sink does not hold yet; nothing is done twice."""
    sink = S.scratch(t.spark, "t03-sink")
    rows = t("events").select("event_id")
    rows.where("event_id % 3 = 0").write.parquet(sink)  # what was done before it stopped
    for _ in range(2):  # resumed twice: the second time finds nothing
        rest = cut(streams.unseen(rows, t.spark.read.parquet(sink), ["event_id"]))
        rest.write.mode("append").parquet(sink)
    return t.spark.read.parquet(sink).groupBy("event_id").agg(F.count("*").cast("int").alias("times"))


_WATCHED = "(select request, list(token order by position) as ids from (select user_id as request, row_number() over (partition by user_id order by event_id) - 1 as position, ascii(event_type) as token from events union all select user_id, 1000 + i, 7 + i % 3 from (select distinct user_id from events where user_id % 4 = 0), (select unnest(range(0, 60)) as i)) group by 1)"


@query("t04_loop_watch", f"select request, min(n) as seen from (select request, n, ids[:n] as part from {_WATCHED}, (select unnest(range(8, 400, 8)) as n) where n <= len(ids)) where len(list_filter(range(1, 9), lambda p: n >= 24 + p and part[n - 23:] = part[n - 23 - p:n - p])) > 0 group by 1")
def _(t):
    """Requests whose tokens arrive in three parts are watched, a check every 8 tokens; every fourth one ends in a loop."""
    ordered = F.array_sort(F.collect_list(F.struct("event_id", F.ascii("event_type").alias("token"))))
    kinds = t("events").groupBy(F.col("user_id").alias("request")).agg(F.transform(ordered, lambda s: s["token"]).alias("ids"))
    loop = F.flatten(F.array_repeat(F.array(*map(F.lit, (7, 8, 9))), 20))
    tokens = kinds.withColumn("ids", F.when(F.col("request") % 4 == 0, F.concat("ids", loop)).otherwise(F.col("ids"))).select("request", F.posexplode("ids").alias("position", "token"))
    path, sink, state = S.scratch(t.spark, "t04"), S.scratch(t.spark, "t04-sink"), S.scratch(t.spark, "t04-state")
    for low, high in ((0, 30), (30, 70), (70, 10_000)):
        tokens.where((F.col("position") >= low) & (F.col("position") < high)).select("request", F.col("position").cast("long").alias("position"), "token").write.mode("append").parquet(path)
        stream = t.spark.readStream.schema("request long, position long, token int").parquet(path)
        streams.run_to_end(streams.stateful(stream, "request", streams.loop_watch(24, 8, 8)), state, sink=sink)
    return t.spark.read.schema("request long, at long, period int").parquet(sink).select("request", (F.col("at") + 1).alias("seen"))


def _parts(t, name):
    """Texts in two parts; all files are one batch, so that a text's parts meet in order."""
    path = S.scratch(t.spark, name)
    halves = F.array(F.struct(F.lit(0).alias("position"), F.substr("text", F.lit(1), F.lit(100)).alias("part")), F.struct(F.lit(1).alias("position"), F.substr("text", F.lit(101), F.length("text")).alias("part")))
    t("completions").where("text is not null").select(F.col("completion_id").alias("request"), F.explode(halves).alias("p")).select("request", "p.position", "p.part").write.parquet(path)
    return t.spark.readStream.schema("request long, position int, part string").parquet(path)


@query("t05_stop_search", "select completion_id as request, least(case when strpos(text, 'return') > 0 then strpos(text, 'return') else 1000000000 end, case when strpos(text, 'class ') > 0 then strpos(text, 'class ') else 1000000000 end) - 1 as at from completions where strpos(text, 'return') > 0 or strpos(text, 'class ') > 0")
def _(t):
    sink = S.scratch(t.spark, "t05-sink")
    streams.run_to_end(streams.stateful(_parts(t, "t05"), "request", streams.stop_search(["return", "class "])), S.scratch(t.spark, "t05-state"), sink=sink)
    return t.spark.read.schema("request long, at long").parquet(sink)


@query("t06_closed_flag", "select completion_id as request, contains(text, 'return') as closed from completions where text is not null")
def _(t):
    sink = S.scratch(t.spark, "t06-sink")
    flagged = streams.stateful(_parts(t, "t06"), "request", streams.closed_flag("return"), mode="append")
    streams.run_to_end(flagged, S.scratch(t.spark, "t06-state"), sink=sink)
    return t.spark.read.schema("request long, closed boolean").parquet(sink).groupBy("request").agg(F.bool_or("closed").alias("closed"))


@query("t_hourly_windows", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(t):
    """Event-time windows under a watermark wide enough to keep every row, as a batch over the same files gives them."""
    path = _event_files(t, "hourly")
    sink = S.scratch(t.spark, "hourly-sink")
    stream = t.spark.readStream.schema(streams.EVENTS).parquet(path)
    streams.run_to_end(streams.hourly(stream, "60 days"), S.scratch(t.spark, "hourly-state"), mode="update", each=lambda frame, k: frame.withColumn("batch", F.lit(k)).write.mode("append").parquet(sink))
    latest = t.spark.read.parquet(sink).groupBy("start", "event_type").agg(F.max_by("n", "batch").alias("n"))
    return latest.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
