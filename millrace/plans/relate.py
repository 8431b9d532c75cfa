"""Queries of joins and lookups, and of the engine's relational surface beyond the corpus (``ext_``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import lookups as L
from millrace.operators import vectors as V
from millrace.operators.ranking import carried
from millrace.operators.sampling import GOLDEN, weyl_choice
from millrace.plans.registry import query


def r6(c):
    return F.round(c, 6)


_VERDICTS = "(select item_id, sample_no, case when count(*) filter (finish_reason = 'stop') > 0 then 'pass' else 'fail' end as verdict from completions where text is not null and sample_no % 2 = 0 group by 1, 2)"


@query("j04_verdict_lookup", f"select c.completion_id, v.verdict, v.verdict = 'pass' as success from completions c left join {_VERDICTS} v using (item_id, sample_no)")
def _(t):
    """Each sample with its verdict by (item, sample): those not judged have neither verdict nor success."""
    judged = t("completions").where("text is not null and sample_no % 2 = 0")
    verdicts = judged.groupBy("item_id", "sample_no").agg(F.when(F.count_if(F.col("finish_reason") == "stop") > 0, "pass").otherwise("fail").alias("verdict"))
    return t("completions").select("completion_id", "item_id", "sample_no").join(verdicts, ["item_id", "sample_no"], "left").select("completion_id", "verdict", (F.col("verdict") == "pass").alias("success"))


@query("j05_held_out", "select c_custkey from customer where c_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000) and c_name not in (select replace(s_name, 'Supplier', 'Customer') from supplier)")
def _(t):
    rich = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct()
    named = t("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("c_name")).distinct()
    return t("customer").join(rich, "c_nationkey", "left_anti").join(named, "c_name", "left_anti").select("c_custkey")


@query("j05_held_out_causes", "select count(*) filter (c_nationkey in (select s_nationkey from supplier where s_acctbal > 5000)) as by_nation, count(*) filter (c_name in (select replace(s_name, 'Supplier', 'Customer') from supplier)) as by_name, count(*) as n from customer")
def _(t):
    rich = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("rich", F.lit(True))
    named = t("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("c_name")).distinct().withColumn("named", F.lit(True))
    return t("customer").join(rich, "c_nationkey", "left").join(named, "c_name", "left").agg(F.count_if("rich").alias("by_nation"), F.count_if("named").alias("by_name"), F.count("*").alias("n"))


@query("j08_as_of", "select e.event_id, r.value as purchase from events e asof left join (select user_id, ts, max(value) as value from events where event_type = 'purchase' group by 1, 2) r on e.user_id = r.user_id and e.ts >= r.ts where e.event_type = 'error'")
def _(t):
    left = t("events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = t("events").where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("purchase"))
    return L.as_of(left, right, "user_id", "ts", "purchase").select("event_id", "purchase")


@query("j09_mixture_choice", f"with g as (select group_name, share, sum(share) over (order by group_name rows unbounded preceding) as upto, row_number() over (order by group_name) - 1 as k from mixture_groups where stage = 'file_level' and share_kind = 'fixed'), p as (select doc_id, ((doc_id + 1) * {GOLDEN}::double - floor((doc_id + 1) * {GOLDEN}::double)) * (select sum(share) from g) as spot from documents) select doc_id, (select count(*) from g where upto <= spot)::int as choice from p")
def _(t):
    """The group of the mixture that each row of training is drawn from: an even sequence of points against the running
    shares of the groups."""
    groups = t("mixture_groups").where("stage = 'file_level' and share_kind = 'fixed'").select("group_name", "share").orderBy("group_name").collect()  # a configuration's few rows
    bounds, total = [], 0.0
    for g in groups:
        total += g.share
        bounds.append(total)
    return t("documents").select("doc_id", weyl_choice(F.col("doc_id"), bounds, total).alias("choice"))


_KTH = "select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as k from lineitem where l_returnflag = "


@query("j10_kth_occurrence", f"select a.l_partkey, a.l_orderkey as a_order, b.l_orderkey as b_order from ({_KTH}'A') a join ({_KTH}'R') b on a.l_partkey = b.l_partkey and a.k = b.k")
def _(t):
    side = lambda flag, name: t("lineitem").where(F.col("l_returnflag") == flag).select("l_partkey", F.col("l_orderkey").alias(name), F.col("l_linenumber").alias(f"{name}_line"))
    return L.kth_occurrence(side("A", "a_order"), side("R", "b_order"), ["l_partkey"], ["a_order", "a_order_line"], ["b_order", "b_order_line"]).select("l_partkey", "a_order", "b_order")


@query("j11_path_suffix", "select r.file_id as request, f.file_id as target from (select file_id, repo_name, array_to_string(string_split(relative_path, '/')[-2:], '/') as wanted from repository_files where repo_name is not null and relative_path is not null) r join repository_files f on r.repo_name = f.repo_name and (f.relative_path = r.wanted or suffix(f.relative_path, '/' || r.wanted))")
def _(t):
    files = t("repository_files").where("repo_name is not null and relative_path is not null").select("file_id", "repo_name", "relative_path")
    wanted = F.substring_index("relative_path", "/", -2)
    requests = files.select(F.col("file_id").alias("request"), "repo_name", wanted.alias("wanted"))
    return L.resolve_suffix(requests, files, "repo_name", "wanted", "relative_path").select("request", F.col("file_id").alias("target")).distinct()


@query("j13_one_interval", "select o_orderkey, year(o_orderdate) as period from orders")
def _(t):
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    years = t("orders").select(F.year("o_orderdate").alias("period")).distinct().select(F.col("period").cast("long").alias("period"), F.unix_date(F.make_date("period", F.lit(1), F.lit(1))).alias("low"), F.unix_date(F.make_date("period", F.lit(12), F.lit(31))).alias("high"))
    return L.exactly_one(L.in_interval(t("orders").select("o_orderkey", day.alias("day")), "day", years, "low", "high", 366.0), "o_orderkey").select("o_orderkey", "period")


@query("j14_label_spans", "select d.doc_id, l.quality, substr(d.text, 11, 30) as span from documents d join labels l using (doc_id) where d.text is not null")
def _(t):
    return t("documents").where("text is not null").select("doc_id", F.substr("text", F.lit(11), F.lit(30)).alias("span")).join(t("labels").select("doc_id", "quality"), "doc_id").select("doc_id", "quality", "span")


_CACHED = "(select doc_id, min(quality) as quality from labels group by 1)"


@query("j15_cached_verdicts", f"select d.doc_id, coalesce(l.quality, case when d.n_chars > 1000 then 'long' else 'short' end) as verdict, l.quality is not null as cached from documents d left join {_CACHED} l using (doc_id) where d.category = 'text'")
def _(t):
    cache = t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = t("documents").where("category = 'text'").select("doc_id", "n_chars").join(cache, "doc_id", "left")
    hit = rows.where("quality is not null").select("doc_id", F.col("quality").alias("verdict"), F.lit(True).alias("cached"))
    miss = rows.where("quality is null").select("doc_id", F.when(F.col("n_chars") > 1000, "long").otherwise("short").alias("verdict"), F.lit(False).alias("cached"))
    return hit.unionByName(miss)


@query("j16_paired_steps", "select user_id, event_id, round(value - first_value(value) over w, 6) as from_first, round(value - lag(value) over w, 6) as from_last from events window w as (partition by user_id order by ts, event_id)")
def _(t):
    rows = t("events").select("user_id", "ts", "event_id", "value")
    first = rows.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"))
    before = carried(rows, ["user_id"], ["ts", "event_id"], "value", "before")
    return before.join(first, "user_id").select("user_id", "event_id", r6(F.col("value") - F.col("first")).alias("from_first"), r6(F.col("value") - F.col("before")).alias("from_last"))


@query("w10_consecutive_change", "select user_id, event_id, round(value - lag(value) over w, 6) as change, round(sum(value) over (partition by user_id order by ts, event_id rows between 3 preceding and current row), 6) as recent from events window w as (partition by user_id order by ts, event_id)")
def _(t):
    rows = t("events").select("user_id", "ts", "event_id", "value")
    ahead = rows.withColumn("last", F.col("value"))
    for k in range(1, 4):  # the three rows before, each from the one before it
        ahead = carried(ahead, ["user_id"], ["ts", "event_id"], "value" if k == 1 else f"v{k - 1}", f"v{k}")
    recent = sum((F.coalesce(f"v{k}", F.lit(0.0)) for k in range(1, 4)), F.col("value"))
    return ahead.select("user_id", "event_id", r6(F.col("value") - F.col("v1")).alias("change"), r6(recent).alias("recent"))


@query("j17_common_benchmarks", "select b.item_id, count(*) as samples from benchmark b join completions c using (item_id) group by 1 having count(distinct c.lang) = 1")
def _(t):
    return t("benchmark").select("item_id").join(t("completions").select("item_id", "lang"), "item_id").groupBy("item_id").agg(F.count("*").alias("samples"), F.count_distinct("lang").alias("langs")).where("langs = 1").drop("langs")


@query("j18_groups_weights", "select stage, group_name, s.source, s.bytes_per_token from (select stage, group_name, unnest(sources) as source from mixture_groups) g join source_catalog s using (source)")
def _(t):
    return t("mixture_groups").select("stage", "group_name", F.explode("sources").alias("source")).join(F.broadcast(t("source_catalog").select("source", "bytes_per_token")), "source").select("stage", "group_name", "source", "bytes_per_token")


@query("j19_first_accepted", "select item_id, coalesce(min(sample_no) filter (finish_reason = 'stop'), min(sample_no)) as chosen, count(*) as attempts from completions group by 1")
def _(t):
    return t("completions").groupBy("item_id").agg(F.coalesce(F.min(F.when(F.col("finish_reason") == "stop", F.col("sample_no"))), F.min("sample_no")).alias("chosen"), F.count("*").alias("attempts"))


@query("j20_verdict_chain", "select completion_id, case when text is null then 'missing' when length(text) < 300 then 'short' when finish_reason = 'length' then 'cut' when finish_reason is null then 'unknown' else 'checked' end as verdict from completions")
def _(t):
    verdict = F.when(F.col("text").isNull(), "missing").when(F.length("text") < 300, "short").when(F.col("finish_reason") == "length", "cut").when(F.col("finish_reason").isNull(), "unknown").otherwise("checked")
    return t("completions").select("completion_id", verdict.alias("verdict"))


_STUBS = "(select distinct item_id from completions where sample_no = 0 and finish_reason = 'stop' and length(text) < 600)"


@query("j21_trivial_prompts", f"select completion_id, case when finish_reason = 'length' or finish_reason is null then 'not_closed' when text is null then 'no_code' when v.verdict = 'pass' and item_id in {_STUBS} then 'pass_trivial' else coalesce(v.verdict, 'no_verdict') end as verdict from completions left join {_VERDICTS} v using (item_id, sample_no)")
def _(t):
    """One row a response: unclosed ones first, then those without code; a pass on an item that a stub (here a short first
    sample) passes too is trivial; else the verdict found for (item, sample)."""
    judged = t("completions").where("text is not null and sample_no % 2 = 0")
    verdicts = judged.groupBy("item_id", "sample_no").agg(F.when(F.count_if(F.col("finish_reason") == "stop") > 0, "pass").otherwise("fail").alias("found"))
    stubs = t("completions").where("sample_no = 0 and finish_reason = 'stop' and length(text) < 600").select("item_id").distinct().withColumn("trivial", F.lit(True))
    rows = t("completions").select("completion_id", "item_id", "sample_no", "finish_reason", F.col("text").isNull().alias("empty")).join(verdicts, ["item_id", "sample_no"], "left").join(stubs, "item_id", "left")
    open_ = F.col("finish_reason").isNull() | (F.col("finish_reason") == "length")
    return rows.select("completion_id", F.when(open_, "not_closed").when(F.col("empty"), "no_code").when((F.col("found") == "pass") & F.col("trivial"), "pass_trivial").otherwise(F.coalesce("found", F.lit("no_verdict"))).alias("verdict"))


@query("j22_context_keys", "select trace_id, sha256(array_to_string(list_filter(regexp_split_to_array(prompt, '[\\t\\n\\v\\f\\r ]+'), lambda w: w <> '')[1:16], ',')) as key from raw_traces where prompt is not null")
def _(t):
    words = F.filter(F.split("prompt", r"[\t\n\x0B\f\r ]+"), lambda w: w != "")
    return t("raw_traces").where("prompt is not null").select("trace_id", F.sha2(F.array_join(F.slice(words, 1, 16), ","), 256).alias("key"))


@query("j23_first_record", f"select d.doc_id, coalesce(l.quality, b.kind) as found from documents d left join {_CACHED} l using (doc_id) left join (select distinct item_id + 1000000 as doc_id, 'item' as kind from benchmark) b using (doc_id)")
def _(t):
    cache = t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    items = t("benchmark").select((F.col("item_id") + 1000000).alias("doc_id")).distinct().withColumn("kind", F.lit("item"))
    return t("documents").select("doc_id").join(cache, "doc_id", "left").join(items, "doc_id", "left").select("doc_id", F.coalesce("quality", "kind").alias("found"))


@query("j24_prompts_with_labels", "select doc_id, source || coalesce('/' || lang, '') as label, n_chars from documents where n_chars > 10 order by sha1('21:' || doc_id), doc_id limit 40")
def _(t):
    from millrace.operators.sampling import choose

    return choose(t("documents").where("n_chars > 10"), "doc_id", 40, 21).select("doc_id", F.concat("source", F.coalesce(F.concat(F.lit("/"), "lang"), F.lit(""))).alias("label"), "n_chars")


# ---- engine surface

@query("ext_joins", "select r_name, count(*) as customers, count(distinct o_orderkey) as orders_ from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by 1")
def _(t):
    rows = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.groupBy("r_name").agg(F.count("*").alias("customers"), F.count_distinct("o_orderkey").alias("orders_"))


@query("ext_full_outer", "select coalesce(c_nationkey, s_nationkey) as nation, c, s from (select c_nationkey, count(*) as c from customer group by 1) full join (select s_nationkey, count(*) as s from supplier group by 1) on c_nationkey = s_nationkey")
def _(t):
    a = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    return a.join(t("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s")), "nation", "full")


@query("ext_rollup", "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("ext_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("ext_ranking", "select o_orderkey, rank() over w as r, dense_rank() over w as d, round(percent_rank() over w, 6) as p, round(cume_dist() over w, 6) as c, nth_value(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second from orders window w as (partition by o_custkey order by o_orderdate)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate")
    every = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t("orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), r6(F.percent_rank().over(w)).alias("p"), r6(F.cume_dist().over(w)).alias("c"), F.nth_value("o_orderkey", 2).over(every).alias("second"))


@query("ext_range_frame", "select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3600 preceding and current row) as hour_count from events")
def _(t):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return t("events").withColumn("at", at).select("event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)).alias("hour_count"))


@query("ext_except_all", "select c_nationkey as nation from customer except all select s_nationkey from supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).exceptAll(t("supplier").select("s_nationkey"))


@query("ext_intersect_all", "select c_nationkey as nation from customer intersect all select s_nationkey from supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("nation")).intersectAll(t("supplier").select("s_nationkey"))


@query("ext_approximate")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("middle"))


@query("ext_json_path", "select event_type, sum((props->>'$.k')::bigint)::bigint as total from events group by 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


@query("ext_decimal_dates", "select date_trunc('month', o_orderdate)::date as month, sum(o_totalprice::decimal(12,2))::double as total, count(*) as n from orders group by 1")
def _(t):
    return t("orders").groupBy(F.trunc("o_orderdate", "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total"), F.count("*").alias("n"))


@query("ext_maps", "select user_id, array_to_string(list(event_type || '=' || n order by event_type), ',') as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1")
def _(t):
    per = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return per.select("user_id", F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("ext_tumbling_window", "select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def _(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


@query("ext_session_window", "select user_id, session, count(*) as n from (select user_id, sum(flag) over (partition by user_id order by ts, event_id) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as flag from events)) group by 1, 2")
def _(t):
    s = t("events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("w.start")).cast("decimal(38,0)").cast("long").alias("session"), "n")


@query("ext_vector_similarity", "select vec_id, round(list_inner_product(embedding, (select embedding from embeddings where vec_id = 0)), 4) as score from embeddings order by 2 desc, 1 limit 10")
def _(t):
    probe = t("embeddings").where("vec_id = 0").first().embedding  # one vector
    score = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, probe)), lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return t("embeddings").select("vec_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "vec_id").limit(10)


@query("ext_vector_neighbours")
def _(t):
    """The ten best rows for every row whose vec_id is divisible by 20, over all rows (itself among them)."""
    return V.nearest(t("embeddings"), F.col("vec_id") % 20 == 0, "vec_id", "embedding", 10)


@query("ext_q1", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice), 2) as base, round(sum(l_extendedprice * (1 - l_discount)), 2) as discounted, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as charge, round(avg(l_discount), 6) as discount, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2")
def _(t):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    r2 = lambda c: F.round(F.sum(c), 2)
    return t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(r2("l_quantity").alias("quantity"), r2("l_extendedprice").alias("base"), r2(net).alias("discounted"), r2(net * (1 + F.col("l_tax"))).alias("charge"), r6(F.avg("l_discount")).alias("discount"), F.count("*").alias("n"))
