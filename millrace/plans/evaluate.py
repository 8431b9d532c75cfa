"""Queries of evaluation statistics, on the driver's tables in place of run records."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import sequences as Q
from millrace.operators import statistics as S
from millrace.operators.ranking import carried, grouped_rank, quantiles
from millrace.plans.registry import query
from millrace.session import cut, spread

Z = repr(S.Z)


def r6(c):
    return F.round(c, 6)


@query("a04_pooled_ratio", "select l_returnflag, round(sum(l_extendedprice) / sum(l_quantity), 6) as ratio from lineitem group by 1")
def _(t):
    return t("lineitem").groupBy("l_returnflag").agg(r6(S.pooled_ratio(F.col("l_extendedprice"), F.col("l_quantity"))).alias("ratio"))


@query("a05_stratified_ratio", "select round(sum(w * t) / sum(w * b), 6) as ratio from (select l_returnflag, sum(l_extendedprice) / count(*) as t, sum(l_quantity) / count(*) as b, case l_returnflag when 'A' then 0.5 when 'N' then 0.3 else 0.2 end as w from lineitem group by 1)")
def _(t):
    weights = t.spark.createDataFrame([("A", 0.5), ("N", 0.3), ("R", 0.2)], "l_returnflag string, w double")
    return S.stratified_ratio(t("lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", weights, "w").select(r6("ratio").alias("ratio"))


@query("a06_clustered_ratio_error", "with r as (select l_returnflag, sum(l_extendedprice) / sum(l_quantity) as ratio, sum(l_quantity) as q from lineitem group by 1), c as (select l_returnflag, l_orderkey, sum(l_extendedprice) as t, sum(l_quantity) as b from lineitem group by 1, 2) select l_returnflag, round(any_value(ratio), 5) as ratio, count(*) as clusters, round(sqrt(count(*) * var_samp(t - ratio * b)) / any_value(q), 5) as se from c join r using (l_returnflag) group by 1")
def _(t):
    return S.clustered_ratio(t("lineitem"), ["l_returnflag"], "l_orderkey", "l_extendedprice", "l_quantity").select("l_returnflag", F.round("ratio", 5).alias("ratio"), "clusters", F.round("se", 5).alias("se"))


@query("a07_paired_rows", "select a.event_id, round(b.value - a.value, 6) as diff from events a join events b on a.event_id + 1 = b.event_id and a.user_id = b.user_id")
def _(t):
    a = t("events").select("event_id", "user_id", "value")
    b = t("events").select((F.col("event_id") - 1).alias("event_id"), "user_id", F.col("value").alias("next"))
    return a.join(b, ["event_id", "user_id"]).select("event_id", r6(F.col("next") - F.col("value")).alias("diff"))


@query("a08_mean_error_clustered", f"with c as (select o_orderstatus, o_custkey, sum(o_totalprice) as s, count(*) as k from orders group by 1, 2), m as (select o_orderstatus, sum(s) / sum(k) as mean, sum(k) as n from c group by 1) select o_orderstatus, any_value(n)::bigint as n, round(any_value(mean), 4) as mean, round(sqrt(sum((s - k * mean) ** 2)) / any_value(n), 4) as se from c join m using (o_orderstatus) group by 1")
def _(t):
    return S.mean_with_error(t("orders"), ["o_orderstatus"], "o_totalprice", "o_custkey").select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


@query("a08_mean_error", "select o_orderstatus, count(*) as n, round(avg(o_totalprice), 4) as mean, round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) as se from orders group by 1")
def _(t):
    return S.mean_with_error(t("orders"), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", "n", F.round("mean", 4).alias("mean"), F.round("se", 4).alias("se"))


@query("a09_wilson", f"select event_type, passed, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) as high from (select event_type, count(*) filter (value > 20) as passed, count(*) as n, count(*) filter (value > 20) / count(*) as p, {Z}::double as z from events group by 1)")
def _(t):
    cell = t("events").groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("passed"), F.count("*").alias("n"))
    low, high = S.wilson(F.col("passed"), F.col("n"))
    return cell.select("event_type", "passed", "n", r6(low).alias("low"), r6(high).alias("high"))


@query("a10_combined_average", "select round((a.mean + b.mean) / 2, 6) as mean, round(sqrt(a.se ** 2 + b.se ** 2) / 2, 6) as se from (select avg(value) as mean, stddev_samp(value) / sqrt(count(*)) as se from events where event_type = 'click') a, (select avg(value) as mean, stddev_samp(value) / sqrt(count(*)) as se from events where event_type = 'view') b")
def _(t):
    each = S.mean_with_error(t("events").where("event_type in ('click', 'view')"), ["event_type"], "value")
    return each.agg(r6(F.avg("mean")).alias("mean"), r6(F.sqrt(F.sum(F.pow("se", 2))) / 2).alias("se"))


@query("a11_pass_columns", "select item_id, split_part(benchmark_name || '/' || item_id, '/', 1) as cluster, bool_or(finish_reason = 'stop') as any_stop, bool_and(finish_reason = 'stop') as all_stop from completions join (select item_id, benchmark_name from benchmark) using (item_id) where finish_reason is not null group by item_id, benchmark_name")
def _(t):
    rows = t("completions").where("finish_reason is not null").join(t("benchmark").select("item_id", "benchmark_name"), "item_id")
    key = F.concat_ws("/", "benchmark_name", F.col("item_id").cast("string"))
    stop = F.col("finish_reason") == "stop"
    return rows.withColumn("cluster", F.split_part(key, F.lit("/"), F.lit(1))).groupBy("item_id", "cluster").agg(F.bool_or(stop).alias("any_stop"), F.bool_and(stop).alias("all_stop"))


_PAIR = "select user_id, max(value) filter (event_type = 'click') > 60 as a, max(value) filter (event_type = 'view') > 60 as b from events where event_type in ('click', 'view') group by 1 having count(distinct event_type) = 2"


def paired(t):
    rows = t("events").where("event_type in ('click', 'view')").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return rows.where("a is not null and b is not null").select("user_id", (F.col("a") > 60).alias("a"), (F.col("b") > 60).alias("b"))


@query("a12_paired_comparison", f"select count(*) as n, round(avg(b::int - a::int), 6) as diff, round(stddev_samp(b::int - a::int) / sqrt(count(*)), 6) as se, round(covar_samp(b::int, a::int) / nullif(stddev_samp(a::int) * stddev_samp(b::int), 0), 6) as corr, count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from ({_PAIR})")
def _(t):
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    return paired(t).agg(F.count("*").alias("n"), r6(F.avg(b - a)).alias("diff"), r6(F.stddev_samp(b - a) / F.sqrt(F.count("*"))).alias("se"), r6(S.correlation(a.cast("double"), b.cast("double"))).alias("corr"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))


_BINOMIAL = "least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2)))))"


@query("a12_mcnemar_exact", f"select only_a, only_b, round({_BINOMIAL}, 6) as p from (select count(*) filter (a and not b) as only_a, count(*) filter (b and not a) as only_b from ({_PAIR}))")
def _(t):
    counts = paired(t).agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"))
    return counts.withColumn("p", r6(S.mcnemar_exact("only_a", "only_b")))


_SAMPLES = "(select 'slot ' || (hour(ts) % 3) as cell, user_id, event_type, (value > 60)::int as passed from events where event_type in ('click', 'view') union all select 'best', user_id, event_type, max(value) > 60 from events where event_type in ('click', 'view') group by 2, 3)"
_RATES = f"(select *, b - a as d from (select cell, user_id, avg(passed) filter (event_type = 'click') as a, avg(passed) filter (event_type = 'view') as b, greatest(count(*) filter (event_type = 'click'), count(*) filter (event_type = 'view')) as k from {_SAMPLES} group by 1, 2) where a is not null and b is not null)"
_ERF = "2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda i: (case when i % 2 = 0 then 1 else -1 end) * exp((2 * i + 1) * ln(x) - lgamma(i + 1)) / (2 * i + 1)))"
_TESTED = f"(select *, case when most = 1 then {_BINOMIAL} when se > 0 and x > 4 then 0 when se > 0 and x > 0 then 1 - ({_ERF}) else 1 end as p from (select *, abs(diff / se) / sqrt(2) as x from (select cell, count(*) as n, avg(a) as a, avg(b) as b, avg(d) as diff, stddev_samp(d) / sqrt(count(*)) as se, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) as corr, max(k) as most, count(*) filter (a = 1 and b = 0) as only_a, count(*) filter (a = 0 and b = 1) as only_b from {_RATES} group by 1)))"


@query("a12_compare", f"select cell, n, round(a, 6) as a, round(b, 6) as b, round(diff, 6) as diff, round(se, 6) as se, round(diff - {Z}::double * se, 6) as low, round(diff + {Z}::double * se, 6) as high, round(corr, 6) as corr, case when most = 1 then 'mcnemar' else 'normal' end as test, round(p, 5) as p, round(least(1, max((m - i + 1) * p) over (order by p, cell rows unbounded preceding)), 5) as p_holm, round({S.DETECTABLE!r}::double * se, 6) as mde from (select *, row_number() over (order by p, cell) as i, count(*) over () as m from {_TESTED})")
def _(t):
    """Clicks against views by user: a row for each slot of hours, with several samples, and one of a single sample."""
    rows = t("events").where("event_type in ('click', 'view')").select(F.concat(F.lit("slot "), (F.hour("ts") % 3).cast("string")).alias("cell"), "user_id", "event_type", (F.col("value") > 60).cast("int").alias("passed"), "value")
    best = rows.groupBy("user_id", "event_type").agg((F.max("value") > 60).cast("int").alias("passed")).select(F.lit("best").alias("cell"), "user_id", "event_type", "passed")
    samples = rows.drop("value").unionByName(best).withColumn("side", F.when(F.col("event_type") == "click", "a").otherwise("b"))
    both = samples.groupBy("cell", "user_id").agg(F.count_distinct("side").alias("sides")).where("sides = 2").drop("sides")
    done = S.compare(samples.join(both, ["cell", "user_id"]), ["cell"], "user_id", "side", "passed")
    return done.select("cell", "n", *[r6(c).alias(c) for c in ("a", "b", "diff", "se", "low", "high", "corr")], "test", F.round("p", 5).alias("p"), F.round("p_holm", 5).alias("p_holm"), r6("mde").alias("mde"))


_P = "(select event_type, hour(ts) as h, round(1 / (1 + abs(avg(value) - 50)), 9) as p from events group by 1, 2)"


@query("w14_holm", f"select event_type, h, round(least(1, max((m - n + 1) * p) over (partition by event_type order by p, h rows unbounded preceding)), 6) as adjusted from (select *, row_number() over (partition by event_type order by p, h) as n, count(*) over (partition by event_type) as m from {_P})")
def _(t):
    rows = t("events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.round(1 / (1 + F.abs(F.avg("value") - 50)), 9).alias("p"))
    return rows.select("event_type", "h", r6(S.holm("p", ["event_type"])).alias("adjusted"))


@query("a13_parse_shares", "select user_id, count(*) filter (event_type = 'click') / count(*) as click, count(*) filter (event_type = 'view') / count(*) as view, count(*) filter (event_type = 'other') / count(*) as other from events group by 1")
def _(t):
    share = lambda kind: (F.count_if(F.col("event_type") == kind) / F.count("*")).alias(kind)
    return t("events").groupBy("user_id").agg(share("click"), share("view"), share("other"))


@query("a14_medians", "select event_type, round(median(value), 6) as middle, round(avg((value > 40)::int), 6) as share from events where value > 5 group by 1")
def _(t):
    rows = t("events").where("value > 5").select("event_type", "value")
    share = rows.groupBy("event_type").agg(r6(F.avg((F.col("value") > 40).cast("int"))).alias("share"))
    return quantiles(rows, ["event_type"], "value", {"middle": 0.5}).join(share, "event_type").select("event_type", r6("middle").alias("middle"), "share")


@query("a15_rollout_summary", "select event_type, sum(n)::bigint as responses, count(*) as prompts, round(avg(hit::int), 6) as rate_per_prompt, round(sum(k) / sum(n), 6) as rate_per_response, count(*) filter (full_) as solved, count(*) filter (hit and not full_) as mixed from (select event_type, user_id, count(*) as n, count(*) filter (value > 30) as k, bool_or(value > 30) as hit, bool_and(value > 30) as full_ from events group by 1, 2) group by 1")
def _(t):
    per = t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 30).alias("k"), F.bool_or(F.col("value") > 30).alias("hit"), F.bool_and(F.col("value") > 30).alias("full"))
    return per.groupBy("event_type").agg(F.sum("n").alias("responses"), F.count("*").alias("prompts"), r6(F.avg(F.col("hit").cast("int"))).alias("rate_per_prompt"), r6(F.sum("k") / F.sum("n")).alias("rate_per_response"), F.count_if("full").alias("solved"), F.count_if(F.col("hit") & ~F.col("full")).alias("mixed"))


@query("a16_pass_at_k", "select user_id, round(case when n - c < 3 then 1.0 else 1 - (n - c) / n::double * (n - c - 1) / (n - 1) * (n - c - 2) / (n - 2) end, 6) as pass3 from (select user_id, count(*) as n, count(*) filter (value > 40) as c from events group by 1 having count(*) >= 3)")
def _(t):
    per = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 40).alias("c")).where("n >= 3")
    return per.select("user_id", r6(S.pass_at_k(F.col("n"), F.col("c"), 3)).alias("pass3"))


@query("a17_quantile_block", "select o_orderpriority, count(*) as n, round(quantile_cont(o_totalprice, 0.1), 4) as p10, round(quantile_cont(o_totalprice, 0.5), 4) as p50, round(quantile_cont(o_totalprice, 0.9), 4) as p90, max(o_totalprice) as most from orders group by 1")
def _(t):
    rows = t("orders").select("o_orderpriority", "o_totalprice")
    block = rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"))
    q = quantiles(rows, ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return block.join(q, "o_orderpriority").select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("p10", "p50", "p90")], "most")


@query("a18_grouping_shape", "select event_type, hour(ts) % 4 as slot, grouping(event_type) * 2 + grouping(hour(ts) % 4) as gid, count(*) as n, round(avg(value), 6) as mean from events group by grouping sets ((), (event_type), (hour(ts) % 4))")
def _(t):
    rows = t("events").select("event_type", (F.hour("ts") % 4).cast("long").alias("slot"), "value")
    return rows.groupingSets([[], ["event_type"], ["slot"]], "event_type", "slot").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), r6(F.avg("value")).alias("mean"))


@query("a19_termination", "select source, count(*) as n, count(*) filter (n_chars = 0) as empty, count(*) filter (n_chars between 1 and 1000) as short, count(*) filter (n_chars > 1000) as long, round(quantile_cont(n_chars, 0.5), 3) as middle from documents group by 1")
def _(t):
    n = F.col("n_chars")
    rows = t("documents").select("source", "n_chars")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(n == 0).alias("empty"), F.count_if(n.between(1, 1000)).alias("short"), F.count_if(n > 1000).alias("long"))
    return counts.join(quantiles(rows, ["source"], "n_chars", {"middle": 0.5}), "source", "left").withColumn("middle", F.round("middle", 3))


@query("a19_closing_curve", "select budget, source, count(*) filter (n_chars <= budget) / count(*) as closed from documents, (select unnest([500, 1000, 2000, 4000, 8000]) as budget) group by 1, 2")
def _(t):
    rows = t("documents").select("source", "n_chars", F.explode(F.array(*map(F.lit, (500, 1000, 2000, 4000, 8000)))).alias("budget"))
    return rows.groupBy("budget", "source").agg((F.count_if(F.col("n_chars") <= F.col("budget")) / F.count("*")).alias("closed"))


@query("a20_spearman", "select round(corr(a, b), 6) as spearman from (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2 as a, rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2 as b from orders)")
def _(t):
    return S.spearman(t("orders"), "o_totalprice", "o_custkey", "o_orderkey").select(r6("rho").alias("spearman"))


@query("a21_threshold_histogram", "select bucket, threshold, count(*) filter (n_chars >= threshold) as n from (select n_chars, case when n_chars < 500 then 0 when n_chars < 2000 then 1 else 2 end as bucket from documents), (select unnest([100, 1000, 10000]) as threshold) group by 1, 2")
def _(t):
    bucket = F.when(F.col("n_chars") < 500, 0).when(F.col("n_chars") < 2000, 1).otherwise(2)
    rows = t("documents").select("n_chars", bucket.alias("bucket"), F.explode(F.array(*map(F.lit, (100, 1000, 10000)))).alias("threshold"))
    return rows.groupBy("bucket", "threshold").agg(F.count_if(F.col("n_chars") >= F.col("threshold")).alias("n"))


def last_before(t, n):
    """The last n events of each user before a moment."""
    rows = t("events").where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).select("user_id", "event_id", "value", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("back"), (-F.col("event_id")).alias("down"))
    return grouped_rank(rows, ["user_id"], ["back", "down"]).where(F.col("rank") <= n)


@query("a23_job_cost", "select user_id, round(median(value), 6) as before from (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where ts < timestamp '2024-01-20') where k <= 50 group by 1")
def _(t):
    return quantiles(last_before(t, 50), ["user_id"], "value", {"before": 0.5}).select("user_id", r6("before").alias("before"))


@query("w11_last_before", "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events where ts < timestamp '2024-01-20') where k <= 5")
def _(t):
    return last_before(t, 5).select("user_id", "event_id")


@query("a24_budget_summary", "select lang, count(*) filter (finish_reason = 'stop') as natural_, count(*) filter (finish_reason = 'length') as forced, count(*) filter (finish_reason is null) as unknown from completions group by 1")
def _(t):
    f = F.col("finish_reason")
    return t("completions").groupBy("lang").agg(F.count_if(f == "stop").alias("natural_"), F.count_if(f == "length").alias("forced"), F.count_if(f.isNull()).alias("unknown"))


@query("a25_latency", "select user_id, count(*) as n, round(avg(gap), 4) as mean, round(median(gap), 4) as middle, round(quantile_cont(gap, 0.99), 4) as p99, round(count(*) / sum(gap), 6) as throughput from (select user_id, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) where gap is not null group by 1")
def _(t):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    before = carried(t("events").select("user_id", "ts", "event_id", at.alias("at")), ["user_id"], ["ts", "event_id"], "at", "before")
    gaps = cut(before.select("user_id", (F.col("at") - F.col("before")).alias("gap")).where("gap is not null"))
    sums = gaps.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("mean"), r6(F.count("*") / F.sum("gap")).alias("throughput"))
    q = quantiles(gaps, ["user_id"], "gap", {"middle": 0.5, "p99": 0.99})
    return sums.join(q, "user_id").select("user_id", "n", "mean", F.round("middle", 4).alias("middle"), F.round("p99", 4).alias("p99"), "throughput")


@query("a26_parabola", "with s as (select count(*)::double n, sum(x) x1, sum(x**2) x2, sum(x**3) x3, sum(x**4) x4, sum(y) y0, sum(y*x) y1, sum(y*x*x) y2 from (select p_size / 50 as x, p_retailprice / 1000 as y from part)), d as (select *, n*(x2*x4-x3*x3) - x1*(x1*x4-x3*x2) + x2*(x1*x3-x2*x2) as det from s) select round((n*(x2*y2-x3*y1) - x1*(x1*y2-y1*x2) + y0*(x1*x3-x2*x2)) / det, 5) as a, round((n*(y1*x4-y2*x3) - y0*(x1*x4-x3*x2) + x2*(x1*y2-y1*x2)) / det, 5) as b, round((y0*(x2*x4-x3*x3) - x1*(y1*x4-x3*y2) + x2*(y1*x3-x2*y2)) / det, 5) as c from d")
def _(t):
    sums = t("part").agg(*[c.alias(k) for k, c in S.parabola(F.col("p_size") / 50, F.col("p_retailprice") / 1000).items()])
    return S.parabola_coefficients(sums).select(F.round("a", 5).alias("a"), F.round("b", 5).alias("b"), F.round("c", 5).alias("c"))


@query("a27_bucket_sums", "select least((n_chars + 999) // 1000, 5) as bucket_right, least(n_chars // 1000, 5) as bucket_left, sum(n_chars)::bigint as chars, count(*) as n from documents group by 1, 2")
def _(t):
    n = F.col("n_chars")
    return t("documents").groupBy(F.least(F.floor((n + 999) / 1000), F.lit(5).cast("long")).alias("bucket_right"), F.least(F.floor(n / 1000), F.lit(5).cast("long")).alias("bucket_left")).agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))


@query("a28_loss_by_corpus", "select event_type, event_id // 100 as step, round(sum(value) / count(*), 6) as loss from events group by 1, 2")
def _(t):
    return t("events").groupBy("event_type", F.floor(F.col("event_id") / 100).alias("step")).agg(r6(F.sum("value") / F.count("*")).alias("loss"))


@query("a29_multi_membership", "select label, count(*) as n, round(avg(n_chars), 4) as mean from (select unnest(['all', source, source || '/' || lang]) as label, n_chars from documents where lang is not null) group by 1")
def _(t):
    rows = t("documents").where("lang is not null").select(F.explode(F.array(F.lit("all"), "source", F.concat_ws("/", "source", "lang"))).alias("label"), "n_chars")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("a30_reasoning_cell", "select count(*) filter (finish_reason = 'stop') as stop, count(*) filter (finish_reason = 'length') as length, round(avg((generation like '%</think>%')::int), 6) as closed, round(avg(case when finish_reason = 'stop' then (generation like '%</think>%')::int end), 6) as closed_if_stop from raw_traces")
def _(t):
    closed = F.contains("generation", F.lit("</think>")).cast("int")
    f = F.col("finish_reason")
    return t("raw_traces").agg(F.count_if(f == "stop").alias("stop"), F.count_if(f == "length").alias("length"), r6(F.avg(closed)).alias("closed"), r6(F.avg(F.when(f == "stop", closed))).alias("closed_if_stop"))


@query("a31_verdict_counters", "select lang, count(*) filter (finish_reason = 'stop') as stop, count(*) filter (finish_reason = 'length') as length from completions group by 1")
def _(t):
    return t("completions").groupBy("lang").pivot("finish_reason", ["stop", "length"]).count().na.fill(0)


@query("a32_batch_advantage", "select l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) over (partition by l_orderkey)) / s, 6) as advantage from lineitem join (select l_orderkey from lineitem group by 1 having min(l_quantity) < max(l_quantity)) using (l_orderkey), (select stddev_pop(l_quantity) as s from lineitem)")
def _(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    spread = rows.agg(F.stddev_pop("l_quantity").alias("s")).first().s  # one number
    w = Window.partitionBy("l_orderkey")
    mixed = rows.withColumns({"low": F.min("l_quantity").over(w), "high": F.max("l_quantity").over(w), "mean": F.avg("l_quantity").over(w)}).where("low < high")
    return mixed.select("l_orderkey", "l_linenumber", r6((F.col("l_quantity") - F.col("mean")) / F.lit(spread)).alias("advantage"))


@query("a33_bucket_differences", "select l_linenumber as bucket, round(avg(abs(l_discount - l_tax)), 6) as mean_diff, round(max(abs(l_discount - l_tax)), 6) as max_diff, round(avg((l_discount = l_tax)::int), 6) as agreement from lineitem group by 1")
def _(t):
    d = F.abs(F.col("l_discount") - F.col("l_tax"))
    return t("lineitem").groupBy(F.col("l_linenumber").alias("bucket")).agg(r6(F.avg(d)).alias("mean_diff"), r6(F.max(d)).alias("max_diff"), r6(F.avg((F.col("l_discount") == F.col("l_tax")).cast("int"))).alias("agreement"))


@query("a34_curves", "select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as place, case when event_type = 'error' then null else event_id % 97 end as value from events")
def _(t):
    """Records as curves: each run's values in the order of its steps, null where a record lacks one. A curve is its places and
    values, so a run of any length is no list in one task."""
    rows = t("events").select("user_id", "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_id") % 97).alias("value"))
    return grouped_rank(rows, ["user_id"], ["ts", "event_id"]).select("user_id", (F.col("rank") - 1).alias("place"), "value")


@query("a35_latest_attempt", "select user_id, event_type, arg_max(value, (ts, event_id)) as value, min(ts) filter (value > 90) as first_failure from events group by 1, 2")
def _(t):
    return t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min(F.when(F.col("value") > 90, F.col("ts"))).alias("first_failure"))


@query("a36_word_counts", "select word, count(*) as n, count(distinct source) as sources from (select source, unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents where text is not null) group by 1 having count(*) >= 50")
def _(t):
    words = t("documents").where("text is not null").select("source", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    # counted by source first: a frequent word's rows are combined before they meet
    per = words.groupBy("word", "source").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("sources")).where("n >= 50")


@query("a36_piece_counts")
def _(t):
    """Every piece of the split pattern with its count and sources, rare ones too. No statement, as in q02."""
    per = Q.piece_counts(spread(t("documents").select("source", "text")), "text", "source")
    return per.groupBy("piece").agg(F.sum("n").alias("n"), F.count_distinct("source").alias("sources"))


@query("a37_attended_keys", "select source, sum(case when n_chars <= 512 then n_chars * (n_chars + 1) // 2 else 512 * 513 // 2 + (n_chars - 512) * 513 end)::bigint as keys from documents group by 1")
def _(t):
    keys = F.expr("least(n_chars, 512L) * (least(n_chars, 512L) + 1) div 2 + (n_chars - least(n_chars, 512L)) * 513")
    return t("documents").groupBy("source").agg(F.sum(keys).alias("keys"))


@query("a41_byte_shares", "select source, round(t * b / sum(t * b) over (), 9) as share from (select source, n / sum(n) over () as t, b from (select source, sum(n_chars) as n from documents group by 1) join (select source, bytes_per_token as b from source_catalog where bytes_per_token is not null) using (source))")
def _(t):
    sizes = t("documents").groupBy("source").agg(F.sum("n_chars").alias("n")).join(F.broadcast(t("source_catalog").where("bytes_per_token is not null").select("source", "bytes_per_token")), "source")
    every = Window.partitionBy(F.lit(1))
    weighed = sizes.withColumn("w", F.col("n") / F.sum("n").over(every) * F.col("bytes_per_token"))
    return weighed.select("source", F.round(F.col("w") / F.sum("w").over(every), 9).alias("share"))


@query("a42_validation_sample", "select source, (ceil(least(n, 1000) / 32.0) * 32)::bigint as rows_ from (select source, count(*) as n from documents group by 1)")
def _(t):
    return t("documents").groupBy("source").agg((F.ceil(F.least(F.count("*"), F.lit(1000)) / 32) * 32).cast("long").alias("rows_"))


@query("a43_grouped_ratio_error", "with r as (select l_returnflag, l_linestatus, sum(l_extendedprice) / sum(l_quantity) as ratio, sum(l_quantity) as q from lineitem group by 1, 2), c as (select l_returnflag, l_linestatus, l_orderkey, sum(l_extendedprice) as t, sum(l_quantity) as b from lineitem group by 1, 2, 3) select l_returnflag, l_linestatus, round(any_value(ratio), 5) as ratio, round(sqrt(count(*) * var_samp(t - ratio * b)) / any_value(q), 5) as se from c join r using (l_returnflag, l_linestatus) group by 1, 2")
def _(t):
    return S.clustered_ratio(t("lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey", "l_extendedprice", "l_quantity").select("l_returnflag", "l_linestatus", F.round("ratio", 5).alias("ratio"), F.round("se", 5).alias("se"))


@query("a44_run_record", "select user_id, arg_min(event_type, (ts, event_id)) as first_kind, max(value) filter (event_type in ('purchase', 'error')) as peak, count(*) filter (event_type <> 'view') as others from events group by 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_kind"), F.max(F.when(F.col("event_type").isin("purchase", "error"), F.col("value"))).alias("peak"), F.count_if(F.col("event_type") != "view").alias("others"))


@query("a02_drop_histogram", "select source, count(*) filter (reason = 'null') as null_, count(*) filter (reason = 'empty') as empty, count(*) filter (reason = 'short') as short, count(*) filter (reason = 'kept') as kept from (select source, case when text is null then 'null' when text = '' then 'empty' when length(text) < 200 then 'short' else 'kept' end as reason from documents) group by 1")
def _(t):
    reason = F.when(F.col("text").isNull(), "null_").when(F.col("text") == "", "empty").when(F.length("text") < 200, "short").otherwise("kept")
    return t("documents").withColumn("reason", reason).groupBy("source").pivot("reason", ["null_", "empty", "short", "kept"]).count().na.fill(0)


@query("a03_split_stats", "select source, count(*) as rows_, count(distinct group_key) as groups_, sum(n_chars + 2)::bigint as total, round_even(quantile_cont(n_chars, 0.1), 0)::bigint as q1, round_even(quantile_cont(n_chars, 0.5), 0)::bigint as q5, round_even(quantile_cont(n_chars, 0.9), 0)::bigint as q9, max(n_chars) as most from documents group by 1")
def _(t):
    rows = t("documents").select("source", "group_key", "n_chars")
    counts = rows.groupBy("source").agg(F.count("*").alias("rows_"), F.count_distinct("group_key").alias("groups_"), F.sum(F.col("n_chars") + 2).alias("total"), F.max("n_chars").alias("most"))
    q = quantiles(rows, ["source"], "n_chars", {"q1": 0.1, "q5": 0.5, "q9": 0.9})
    return counts.join(q, "source", "left").select("source", "rows_", "groups_", "total", *[F.bround(c, 0).cast("long").alias(c) for c in ("q1", "q5", "q9")], "most")


@query("t10_late_values", "select user_id, event_id, lag(value) over (partition by user_id order by ts, event_id) as logged from events")
def _(t):
    """What a log holds that writes each step's value with the next step."""
    return carried(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value", "logged").select("user_id", "event_id", "logged")


@query("a42_solution_bits", "select user_id, round(sum(value) filter (k > user_id % 7), 4) as bits, count(*) filter (k > user_id % 7) as scored from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) group by 1")
def _(t):
    """The bits of each solution: those of its tokens behind the prompt's end."""
    ranked = grouped_rank(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"])
    behind = F.col("rank") > F.col("user_id") % 7
    return ranked.groupBy("user_id").agg(F.round(F.sum(F.when(behind, F.col("value"))), 4).alias("bits"), F.count_if(behind).alias("scored"))


_PASSED = "(select b.benchmark_name as benchmark, c.lang as mode, c.item_id as problem, c.sample_no as sample, bool_or(c.finish_reason = 'stop') as base, bool_or(c.finish_reason = 'stop' and length(c.text) > 400) as plus from completions c join benchmark b using (item_id) where c.finish_reason is not null and c.text is not null group by 1, 2, 3, 4)"


@query("e12_long_records", f"select benchmark, mode, 'base' as column_, problem, sample, base as passed from {_PASSED} union all select benchmark, mode, 'plus', problem, sample, plus from {_PASSED}")
def _(t):
    """Evaluation outputs as other tools leave them, a JSON record a benchmark and mode with arrays by problem, as one long
    table: a row a column, problem and sample."""
    stop = F.col("finish_reason") == "stop"
    joined = t("completions").where("finish_reason is not null and text is not null").join(F.broadcast(t("benchmark").select("item_id", "benchmark_name")), "item_id")
    samples = joined.groupBy(F.col("benchmark_name").alias("benchmark"), F.col("lang").alias("mode"), "item_id", "sample_no").agg(F.bool_or(stop).alias("base"), F.bool_or(stop & (F.length("text") > 400)).alias("plus"))
    problems = samples.groupBy("benchmark", "mode", "item_id").agg(F.array_sort(F.collect_list(F.struct("sample_no", "base", "plus"))).alias("s"))
    columns = F.struct(F.transform("s", lambda x: x["sample_no"]).alias("samples"), F.transform("s", lambda x: x["base"]).alias("base"), F.transform("s", lambda x: x["plus"]).alias("plus"))
    records = problems.select("benchmark", "mode", F.to_json(F.struct(F.col("item_id").alias("id"), columns.alias("result"))).alias("record"))
    read = records.select("benchmark", "mode", F.from_json("record", "id long, result struct<samples: array<int>, base: array<boolean>, plus: array<boolean>>").alias("r"))
    long = read.select("benchmark", "mode", F.col("r.id").alias("problem"), F.explode(F.arrays_zip("r.result.samples", "r.result.base", "r.result.plus")).alias("x"))
    return long.select("benchmark", "mode", "problem", F.col("x.samples").alias("sample"), F.explode(F.create_map(F.lit("base"), F.col("x.base"), F.lit("plus"), F.col("x.plus"))).alias("column_", "passed"))


@query("e12_month_shards", "select date_trunc('month', o_orderdate)::date as first_day, (date_trunc('month', o_orderdate) + interval 1 month - interval 1 day)::date as last_day, count(*) as n from orders group by 1, 2 union all select m::date, (m + interval 1 month - interval 1 day)::date, 0 from (select unnest(generate_series(date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)), interval 1 month)) as m from orders) where m not in (select date_trunc('month', o_orderdate) from orders)")
def _(t):
    """Whole months from the first to the last date, each with what falls into it, ends included; empty months too."""
    ends = t("orders").agg(F.trunc(F.min("o_orderdate"), "month").alias("low"), F.trunc(F.max("o_orderdate"), "month").alias("high"))
    months = ends.select(F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("first_day"))
    found = t("orders").groupBy(F.trunc("o_orderdate", "month").alias("first_day")).agg(F.count("*").alias("n"))
    return months.join(found, "first_day", "left").select("first_day", F.date_sub(F.add_months("first_day", 1), 1).alias("last_day"), F.coalesce("n", F.lit(0)).alias("n"))
