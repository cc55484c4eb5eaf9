"""The stored n-gram index: posting lists by bucket, block and gram; lookups read the buckets of their grams alone.

Ids are cut into blocks of BLOCK, and a list holds the places in its block, in order, so a gram that all cards hold is many rows and never one.
The writer packs the places as differences (Parquet's delta encoding). Lists of a term's grams meet block by block, the rarest gram first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import grams
from tesserae.operators import governance, graph, search
from tesserae.sources import store

BUCKETS = 64
BLOCK = 1 << 16
#: Cards of so many ids lie in one task, where their postings become short lists; only these are dealt out.
SHORT = 1 << 10


def bucket(gram: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def lists(cards: DataFrame, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """bucket, gram, block, n, places. Postings become short lists where the cards lie, so what is shuffled are cards and lists."""
    at = F.pmod("id", F.lit(block))
    named = cards.select(F.floor(F.col("id") / block).alias("block"), F.floor(at / SHORT).cast("int").alias("_short"), at.cast("int").alias("at"), search.indexed(cards).alias("_text"))
    one = search.dealt(named, "block", "_short").select("block", "_short", "at", F.explode(grams(F.col("_text"), 2, 3)).alias("gram"))
    short = one.groupBy("block", "_short", "gram").agg(F.collect_list("at").alias("_at"))
    rows = short.groupBy("gram", "block").agg(F.sum(F.size("_at")).alias("n"), F.array_sort(F.flatten(F.collect_list("_at"))).alias("places"))
    return rows.select(bucket(F.col("gram"), buckets).alias("bucket"), "gram", "block", "n", "places")


def save(cards: DataFrame, folder: str, buckets: int = BUCKETS, block: int = BLOCK) -> int:
    """A new version of the index; its number."""
    order = ["bucket", "gram", "block"]
    rows = lists(cards, buckets, block)
    parts = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    delta = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
    return store.commit(dealt, folder, by=("bucket",), **delta)


def postings(index: DataFrame, wanted: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The lists of these grams; the condition on buckets is constant and prunes folders."""
    return index.where(F.col("bucket").isin([bucket(F.lit(g), buckets) for g in wanted]) & F.col("gram").isin(wanted))


def holding(index: DataFrame, term: str, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """id of the cards whose text holds all grams of the term: candidates, to be verified. Terms of one character have no grams."""
    need = search.wanted([term])[term]
    if not need:
        raise ValueError("a term of one character isn't in the index")
    found = postings(index, need, buckets)
    sizes = {r["gram"]: r["n"] for r in found.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the term
    first, *others = sorted(need, key=lambda g: (sizes.get(g, 0), g))
    rows = found.where(F.col("gram") == first).select("block", "places")
    if len(sizes) < len(need):
        rows = rows.where("false")
    for gram in others:
        more = found.where(F.col("gram") == gram).select("block", F.col("places").alias("_more"))
        rows = rows.join(more, "block").select("block", F.array_intersect("places", "_more").alias("places")).where(F.size("places") > 0)
    return rows.select("block", F.explode("places").alias("at")).select((F.col("block") * block + F.col("at")).alias("id"))


def lookup(cards: DataFrame, index: DataFrame, term: str, buckets: int = BUCKETS, block: int = BLOCK) -> DataFrame:
    """The cards whose indexed text holds the term: candidates from the index, then verified."""
    kept = cards.join(holding(index, term.lower(), buckets, block), "id", "left_semi")
    return kept.where(F.contains(F.lower(search.indexed(kept)), F.lit(term.lower())))


def build(cards: DataFrame, edges: DataFrame, folder: str, by: list[str]) -> dict[str, int]:
    """All relations of an index, each as a new version: nodes, edges, tags (tag, id), search, and meta, which is written last."""
    out = {
        "nodes": store.commit(cards, f"{folder}/nodes"),
        "edges": store.commit(edges.select("src", "dst").distinct(), f"{folder}/edges"),
        "tags": store.commit(governance.long_inventory(cards, "tags", "id"), f"{folder}/tags"),
        "search": save(cards, f"{folder}/search"),
    }
    told_apart = store.read(cards.sparkSession, f"{folder}/edges", out["edges"])
    return out | {"meta": store.commit(graph.status_counts(cards, told_apart, by), f"{folder}/meta")}


def relations(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: store.read(spark, f"{folder}/{name}") for name in ("nodes", "edges", "tags", "search", "meta")}
