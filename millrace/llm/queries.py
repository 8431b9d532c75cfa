"""The pN_ queries over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.catalog import table
from millrace.llm import leakage, mixing, packing, quality, splits, syntax, tokens
from millrace.llm.sql import ORACLES
from millrace.session import cut

QUERIES: dict = {}
__all__ = ["ORACLES", "QUERIES"]


def query(name: str):
    def add(build):
        QUERIES[name] = build
        return build
    return add


def _assigned(spark: SparkSession, folder: str) -> DataFrame:
    records = splits.records_of(*(table(spark, folder, n) for n in ("repository_files", "code_functions", "raw_traces")))
    return splits.assign_splits(records, table(spark, folder, "repo_links"), table(spark, folder, "split_targets"))


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of groups whose recorded splits differ."""
    return _assigned(spark, folder).where("mixed").select("record_table", "record_id")


@query("p3_splits")
def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every record."""
    return _assigned(spark, folder).select("record_table", "record_id", "component", "split")


@query("p3_shares")
def p3_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Records, share and target share of each split."""
    done = _assigned(spark, folder).groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("component").alias("components"))
    targets = table(spark, folder, "split_targets").select(F.col("split_name").alias("split"), "target_share")
    return done.join(targets, "split", "full").select("split", "records", "components", F.round(F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(1))), 6).alias("share"), "target_share")


@query("p3_bounds")
def p3_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each split's share is within 0.002 of its target, and whether no component stands in two splits."""
    done = cut(_assigned(spark, folder).select("component", "split"))
    apart = done.groupBy("component").agg((F.min("split") == F.max("split")).alias("one")).agg(F.bool_and("one").alias("together"))
    shares = done.groupBy("split").agg(F.count("*").alias("n"))
    total = done.count()
    rows = table(spark, folder, "split_targets").join(shares, F.col("split_name") == F.col("split"), "left").crossJoin(F.broadcast(apart))  # one row
    return rows.select(F.col("split_name").alias("split"), (F.abs(F.coalesce("n", F.lit(0)) / max(1, total) - F.col("target_share")) < 0.002).alias("within"), "together")


def _counted(spark: SparkSession, folder: str, *keep: str) -> DataFrame:
    return tokens.token_counts(table(spark, folder, "documents"), tokens.vocabulary_of(table(spark, folder, "tokenizer_vocab")), ["doc_id", *keep])


@query("p2_totals")
def p2_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and tokens by source, lang and topic."""
    return tokens.totals(_counted(spark, folder, "source", "lang", "topic"))


@query("p2_documents")
def p2_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The token count of every document."""
    return _counted(spark, folder)


@query("p2_stages")
def p2_stages(spark: SparkSession, folder: str) -> DataFrame:
    """Each stage's sources with their tokens, against the stage's total."""
    return tokens.against_stages(_counted(spark, folder, "source"), table(spark, folder, "mixture_groups"))


def _mixture(spark: SparkSession, folder: str, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups = table(spark, folder, "mixture_groups")
    return *mixing.mixture(_counted(spark, folder, "source"), groups, target_entropy), groups


@query("p4_mixture")
def p4_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of each stage, as often as they are read, with their place in the permutation."""
    return _mixture(spark, folder)[0]


@query("p4_shares")
def p4_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares reached by group and source beside the targets."""
    return mixing.report(*_mixture(spark, folder))


@query("p4_entropy_shares")
def p4_entropy_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The same where a group's sources are to be as uneven as an entropy of one nat tells, as far as repeats allow."""
    return mixing.report(*_mixture(spark, folder, 1.0))


@query("p4_bounds")
def p4_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each group reaches its target, or all its repeats allow, to within one document (the mean of its longest
    source's), and whether no source is read more often than it may be."""
    groups = table(spark, folder, "mixture_groups")
    counted = cut(_counted(spark, folder, "source").where("tokens > 0"))
    rows, draws = mixing.mixture(counted, groups)
    reached = cut(mixing.report(rows, draws, groups)).join(counted.groupBy("source").agg(F.avg("tokens").alias("mean")), "source", "left")
    per = reached.groupBy("stage", "group_name").agg(F.sum("reached_tokens").alias("reached"), F.sum(F.col("have") * F.col("repeats")).alias("most"), F.max(F.coalesce("mean", F.lit(0.0))).alias("document"), F.bool_and(F.col("readings") <= F.col("repeats")).alias("readings_kept"))
    stages = per.groupBy("stage").agg(F.sum("reached").alias("all"))
    joined = groups.join(per, ["stage", "group_name"]).join(stages, "stage")
    goal = F.when(F.col("share_kind") == "fixed", F.col("share") * F.col("stage_tokens")).when(F.col("share_kind") == "supply", F.col("most")).otherwise(F.greatest(F.lit(0), F.col("stage_tokens") - (F.col("all") - F.col("reached"))))
    return joined.select("stage", "group_name", (F.abs(F.col("reached") - F.least(goal, F.col("most"))) <= F.col("document")).alias("within"), "readings_kept")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    # distinct row lengths of the stages: a configuration table
    lengths = [r.seq_len for r in table(spark, folder, "mixture_groups").select("seq_len").distinct().collect()]
    return packing.pack(_counted(spark, folder), lengths)


@query("p5_found")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that had to be cut, by row length."""
    return _packed(spark, folder).where("pieces > 1 and piece = 0").select("doc_id", "seq_len")


@query("p5_rows")
def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Where every piece of every document stands."""
    return _packed(spark, folder)


@query("p5_fill")
def p5_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the rows are."""
    return packing.fill(_packed(spark, folder))


@query("p5_bounds")
def p5_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Whether no row holds more than it can, the rows are at most 2 % (and two) more than the tokens need, and every document
    stands in them whole."""
    placed = cut(_packed(spark, folder))
    rows = placed.groupBy("seq_len", "block", "row").agg(F.sum("length").alias("used")).groupBy("seq_len").agg(F.count("*").alias("rows"), F.sum("used").alias("tokens"), F.max("used").alias("most"))
    whole = placed.groupBy("seq_len", "doc_id").agg((F.max(F.col("start") + F.col("length")) == F.sum("length")).alias("whole")).groupBy("seq_len").agg(F.bool_and("whole").alias("whole"))
    tight = F.col("rows") <= F.ceil(F.col("tokens") / F.col("seq_len")) * 1.02 + 2
    return rows.join(whole, "seq_len").select("seq_len", (F.col("most") <= F.col("seq_len")).alias("fits"), tight.alias("tight"), "whole")


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("p6_found")
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and the documents that hold a passage of theirs."""
    return _leaks(spark, folder).select("item_id", "doc_id")


@query("p6_passages")
def p6_passages(spark: SparkSession, folder: str) -> DataFrame:
    """The longest passage of each item and document, with its place in the original text."""
    return _leaks(spark, folder)


@query("p6_items")
def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents leak each item."""
    return leakage.leaked_items(_leaks(spark, folder), table(spark, folder, "benchmark"))


def _statistics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.statistics(quality.text_counts(table(spark, folder, "documents").where("category = 'text'")))


@query("p7_found")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of category text that are no running prose."""
    return _statistics(spark, folder).where("not prose").select("doc_id")


@query("p7_statistics")
def p7_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, ratios, rule outcomes and verdict of every document of category text."""
    return _statistics(spark, folder)


@query("p7_counts")
def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Those counts that a statement can make too."""
    return _statistics(spark, folder).select("doc_id", "chars", "lines", "short_lines", "line_chars")


@query("p7_verdicts")
def p7_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The verdicts against the hand labels."""
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    return _statistics(spark, folder).join(labels, "doc_id").groupBy("quality", "prose").agg(F.count("*").alias("documents"))


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    return syntax.parse(syntax.programs(*(table(spark, folder, n) for n in ("repository_files", "code_functions", "completions"))))


@query("p1_found")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Programs that are not valid in their language."""
    return _judged(spark, folder).where("verdict <> 'valid'").select("record_table", "record_id")


@query("p1_verdicts")
def p1_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every program, and where an error stands."""
    return _judged(spark, folder)


@query("p1_rates")
def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of invalid programs by repository and language."""
    return syntax.rates(_judged(spark, folder))
