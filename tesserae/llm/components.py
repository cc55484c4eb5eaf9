"""Connected components by alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond").

Edges only are moved, each round is checkpointed, and the driver sees two numbers a round. The joins are written so that run-time
skew handling can split a hub's rows: they meet on a hash of the node, by which neither side is dealt out already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import ensure_checkpoint_dir


def _least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.groupBy(node).agg(F.min(other).alias("_m")).select(F.col(node).alias("_node"), F.least(node, "_m").alias("_m"), F.xxhash64(F.lit(3), node).alias("_h"))


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    return edges.withColumn("_h", F.xxhash64(F.lit(3), node)).join(_least(edges, node, other), "_h").where(F.col(node) == F.col("_node"))


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges: a, b (long). Gives node, root: the smallest node that is reachable, for every node of an edge."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        small = _with_least(large, "a", "b").select(F.explode(F.array(F.struct("a", F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("x")).select("x.*")
        e = small.where("a <> b").distinct().checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("x")).select("x.*")
    return pairs.groupBy("node").agg(F.min("root").alias("root"))
