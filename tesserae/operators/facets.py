"""Facet counts that ignore their own facet, the residual category, and short lists that keep what is chosen."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.plans.spec import QuerySpec

FACETS = ("topic", "klass", "category", "tag")


def counts(cards: DataFrame, spec: QuerySpec, facet: str, concrete: list[str], residual: str, values: list[str] | None = None) -> DataFrame:
    """value, n under all predicates but the facet's own; the value null holds the total. Unknown values count in the total only."""
    rows = replace(spec, **{facet: None}).apply(cards, concrete, residual)
    if facet == "category":
        found = F.filter(F.array_distinct("tags"), lambda t: t.isin(concrete))
        rows = rows.select(F.explode(F.concat(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(residual))), F.array(F.lit(None).cast("string")))).alias("value"))
        return rows.groupBy("value").agg(F.count("*").alias("n"))
    out = rows.groupBy(F.col(facet).alias("value")).agg(F.count("*").alias("n"))
    total = out.agg(F.lit(None).cast("string").alias("value"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    kept = out.where(F.col("value").isin(values)) if values else out.where("value IS NOT NULL")
    return kept.unionByName(total)


def every(cards: DataFrame, spec: QuerySpec, concrete: list[str], residual: str, known: dict[str, list[str]] | None = None) -> DataFrame:
    """facet, value, n of topic, klass, category and tag at once, each under all predicates but its own; the value null holds a facet's total.

    One scan and one shuffle: a card's failed predicates are bits of a mask, and it counts for a facet if no other bit than the facet's is
    set. known: values of a facet that are listed; others count in its total only. Tags that are categories aren't listed, and tags are
    counted under all predicates, as the tag list is one of the result.
    """
    known = known or {}
    shown = spec.predicates_by_facet(concrete, residual)
    failed = sum((F.when(p, 0).otherwise(1 << i) for i, p in enumerate(shown[f] for f in FACETS if f in shown)), F.lit(0))
    bit = {f: 1 << i for i, f in enumerate(f for f in FACETS if f in shown)}
    rows = cards.where(shown["status"]) if "status" in shown else cards
    rows = rows.withColumn("_failed", failed).where(F.col("_failed").isin(0, *bit.values()))  # a card with two failed predicates counts nowhere
    found = F.filter(F.array_distinct("tags"), lambda t: t.isin(concrete))
    values = {
        "topic": F.array("topic"),
        "klass": F.array("klass"),
        "category": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(residual))),
        "tag": F.filter(F.array_distinct("tags"), lambda t: ~t.isin(concrete)),
    }
    listed = [_counted(facet, of, known.get(facet), (F.col("_failed") == 0) if facet == "tag" else F.col("_failed").isin(0, bit.get(facet, 0))) for facet, of in values.items()]
    return rows.select(F.explode(F.concat(*listed)).alias("_")).groupBy("_.facet", "_.value").agg(F.count("*").alias("n"))


def _counted(facet: str, values: Column, known: list[str] | None, counts: Column) -> Column:
    """(facet, value) for each listed value, and one for the total; none if the card doesn't count."""
    kept = F.filter(values, lambda x: x.isNotNull() & x.isin(known)) if known else F.array_compact(values)
    pairs = F.transform(F.concat(kept, F.array(F.lit(None).cast("string"))), lambda x: F.struct(F.lit(facet).alias("facet"), x.alias("value")))
    return F.when(counts, pairs).otherwise(F.slice(pairs, 1, 0))


def tags(cards: DataFrame, categories: list[str], limit: int = 8) -> DataFrame:
    """The most frequent tags that are no categories."""
    n = cards.select(F.explode(F.array_distinct("tags")).alias("value")).where(~F.col("value").isin(categories)).groupBy("value").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), "value").limit(limit)


def shortened(n: DataFrame, limit: int, selected: str | None) -> DataFrame:
    """The first values by count, the selected one always among them, and how many are hidden. n: a row a value of one facet."""
    top = F.row_number().over(Window.partitionBy("_all").orderBy(F.col("n").desc(), "value"))
    rows = n.withColumn("_all", F.lit(1)).withColumn("place", top).withColumn("_shown", (F.col("place") <= limit) | (F.col("value") == selected if selected else F.lit(False)))
    rows = rows.withColumn("hidden", F.count_if(~F.col("_shown")).over(Window.partitionBy("_all")))
    return rows.where("_shown").drop("_all", "_shown")
