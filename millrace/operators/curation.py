"""Exact deduplication, hash splits, sharding and benchmark overlap of a document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.hashing import draw, residue
from millrace.functions.text import words
from millrace.operators.ranking import global_rank, grouped_rank, ntile_of
from millrace.session import spread


def keep_first(frame: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, found by a minimum that is combined before the shuffle, so a key may hold
    any share of the rows. Null keys are a key of their own; ``order`` should be total."""
    rest = [c for c in frame.columns if c not in key]
    first = frame.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return first.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in frame.columns])


def duplicate_addresses(frame: DataFrame, ident: str, address: list[str]) -> DataFrame:
    """Addresses of the rows that repeat an earlier row's ident, or whose text is empty: narrow, without the text.

    The least address of each ident is found with a partially aggregated min, so an ident held by a third of all rows
    does not meet in one task; the join back is an equi join on the ident that adaptive execution may split.
    """
    narrow = frame.select(ident, F.struct(*address).alias("at"))
    first = narrow.groupBy(ident).agg(F.min("at").alias("first"))
    joined = narrow.join(first, ident).where((F.col("at") != F.col("first")) | (F.col(ident) == F.sha1(F.lit(""))))
    return joined.select([F.col(f"at.{a}").alias(a) for a in address])


def drop_addresses(frame: DataFrame, dropped: DataFrame, address: list[str]) -> DataFrame:
    return frame.join(dropped, address, "left_anti")


def hash_split(group: Column, parts: int = 100) -> Column:
    """val for residue 0 of the group's hash, else train; a null group is train."""
    return F.when(residue(group, parts) == 0, F.lit("val")).otherwise(F.lit("train"))


def shards(frame: DataFrame, order: list[str], tiles: int) -> DataFrame:
    """frame plus ``shard``: equal runs of rows in the global order."""
    total = frame.count()
    return global_rank(frame, order).withColumn("shard", ntile_of(F.col("rank"), F.lit(total), tiles)).drop("rank")


def ngram_keys(text: Column, n: int) -> Column:
    """All n-word runs as pairs of 64-bit hashes: equal pairs stand for equal runs (128 bits decide).

    Repeats stay: making struct arrays distinct compares all pairs.
    """
    # the words are bound to a lambda's variable: inlined, they would be split anew for every run
    def keys(w: Column) -> Column:
        def key(i: Column) -> Column:
            run = F.slice(w, i, n)
            return F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(n), run).alias("b"))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), key)).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))

    return F.element_at(F.transform(F.array(words(text)), keys), 1)


#: A benchmark's n-grams up to this many go to every executor; more are joined by shuffle.
BROADCAST_GRAMS = 500_000


def overlaps(documents: DataFrame, tests: DataFrame, ident: str, text: str, test_ident: str = "item_id", test_text: str = "text", n: int = 10) -> DataFrame:
    """(ident, items): documents sharing an n-word run with tests, and the ids of those tests, ascending.

    Runs meet the tests' by broadcast, before any shuffle, so only hits are grouped. Null texts match nothing.
    """
    grams = tests.select(F.explode(ngram_keys(F.col(test_text), n)).alias("gram"), F.col(test_ident).alias("item")).select("gram.a", "gram.b", "item").distinct()
    many = grams.limit(BROADCAST_GRAMS + 1).count() > BROADCAST_GRAMS
    mine = spread(documents.select(ident, text)).select(F.col(ident), F.explode(ngram_keys(F.col(text), n)).alias("gram")).select(ident, "gram.a", "gram.b")
    hits = mine.join(grams if many else F.broadcast(grams), ["a", "b"])
    return hits.groupBy(ident).agg(F.array_sort(F.collect_set("item")).alias("items"))


def cap_equals(frame: DataFrame, group: list[str], ident: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group, in a seeded order that depends on the ident alone."""
    ranked = grouped_rank(frame.withColumn("_draw", draw(F.col(ident), seed)), group, ["_draw", ident], rank="_k")
    return ranked.where(F.col("_k") <= cap).drop("_k", "_draw")


def extent(files: DataFrame, by: list[str], name: str, size: str, need: Column) -> DataFrame:
    """The smallest run of files, in the order of their names' SHA-1, whose sizes reach ``need``."""
    order = Window.partitionBy(*by).orderBy(F.sha1(name), name)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("_before", before).where(F.col("_before") < need).drop("_before")
