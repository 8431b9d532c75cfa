"""Connected components of an undirected link table, as alternating star contractions.

Each round contracts every neighbourhood onto its least member: first the larger neighbours (large star), then the
smaller ones (small star). The number of rounds grows with the logarithm of the graph, whatever its diameter, every
aggregation is a min (so a hub is combined before the shuffle), and each round is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
    return moved.select("e.u", "e.v").where("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame, left: str = "u", right: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links``; component is the least node name reachable.

    Rows with a null end name no pair: the other end stays a node of its own. A self link makes its node a component
    of one. Repeated and reversed links change nothing; an empty table gives an empty result. Other columns of
    ``links`` are ignored. Raises if ``max_rounds`` (far beyond the logarithm of any table) do not suffice.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v"))
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).where("node is not null").distinct()
    edges = cut(pairs.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _signature(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges)))
        after = _signature(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
