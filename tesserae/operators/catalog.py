"""Cards: load view, orders, headers, pages, neighbours, comparison."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.ranking import beside


def visible(cards: DataFrame, hidden_topics: list[str], show_obsolete: bool = False) -> DataFrame:
    """Without hidden topics, and without obsolete cards that have no effective period; an empty period is none."""
    out = cards.where(~F.coalesce(F.col("topic").isin(hidden_topics), F.lit(False))) if hidden_topics else cards
    if show_obsolete:
        return out
    return out.where(~F.coalesce(F.col("obsolete"), F.lit(False)) | (F.coalesce(F.col("effective"), F.lit("")) != ""))


def position(c: Column, order: list[str], unknown: int) -> Column:
    """Place in a configured order, from 0."""
    at = F.array_position(F.array(*map(F.lit, order)), c) - 1
    return F.when(F.coalesce(at, F.lit(-1)) >= 0, at).otherwise(F.lit(unknown)).cast("int")


def load_order(topics: list[str]) -> list[Column]:
    """Unknown topics first, then class, cards with an ordinal first, number."""
    return [position(F.col("topic"), topics, -1), F.col("klass"), (F.col("ord") <= 0), F.col("ord"), F.col("id")]


def browse_order(topics: list[str], classes: list[str], first: str) -> list[Column]:
    """Unknown topics and classes last; ordinals first in one class; then number, then load order."""
    return [position(F.col("topic"), topics, 99), position(F.col("klass"), classes, 99), F.when(F.col("klass") == first, F.col("ord")).asc_nulls_last(), F.col("ord").asc_nulls_last(), F.col("load_ord")]


def grouped_order(topics: list[str], classes: list[str], first: str, category: Column) -> list[Column]:
    """Topic; cards of the first class by number; all others by category, class, number."""
    is_first = F.coalesce(F.col("klass") == first, F.lit(False))
    zero = F.lit(0)
    return [position(F.col("topic"), topics, 99), F.when(is_first, 0).otherwise(1), F.when(is_first, zero).otherwise(category), F.when(is_first, zero).otherwise(position(F.col("klass"), classes, 99)), F.col("ord").asc_nulls_last(), F.col("load_ord")]


def first_category(order: list[str]) -> Column:
    """The first category in the configured order that the card carries, as a place; the residual comes last."""
    out = F.lit(len(order))
    for i, c in reversed(list(enumerate(order))):
        out = F.when(F.coalesce(F.array_contains("tags", c), F.lit(False)), i).otherwise(out)
    return out


def numbered(rows: DataFrame, order: list[Column], within: list[str], out: str = "pos") -> DataFrame:
    """Places from 1 in each partition."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*within).orderBy(*order)))


def headers(rows: DataFrame, key: str, order: list[Column], within: list[str]) -> DataFrame:
    """A header where the key differs from the row before; it shows the key's whole count, and a key can have several headers."""
    met = beside(rows, within, order, [key], "_place")
    counted = _with_count(met, [*within, key], "of_key")
    header = (F.col("_place") == 1) | ~F.col(f"before_{key}").eqNullSafe(F.col(key))
    return counted.withColumn("header", header).select(*rows.columns, "header", "of_key")


def _with_count(rows: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Rows with the number of rows of their key: counts are added up before they are dealt out, and met by key."""
    n = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias(out))
    return rows.join(n, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])).drop(*[f"_{k}" for k in keys])


def page(rows: DataFrame, pos: str, number: int, size: int) -> DataFrame:
    """Rows of a page from 0."""
    return rows.where(F.col(pos).between(number * size + 1, (number + 1) * size))


def neighbours(rows: DataFrame, order: list[Column], within: list[str]) -> DataFrame:
    """The card before and after, the place and how many there are; no wrapping around."""
    met = beside(rows, within, order, ["id"]).withColumnsRenamed({"before_id": "before", "after_id": "after"})
    return _with_count(met, within, "of")


def compared(cards: DataFrame, ids: list[int], least: int = 2, most: int = 3) -> DataFrame:
    """The chosen cards in the order of choice; unknown ids drop out."""
    if not least <= len(ids) <= most:
        raise ValueError(f"choose {least} to {most} cards")
    return cards.where(F.col("id").isin(ids)).withColumn("place", F.array_position(F.array(*map(F.lit, ids)), F.col("id")).cast("int"))


def differs(cards: DataFrame, fields: list[str]) -> DataFrame:
    """A row: does the field differ between the cards? A null is a value of its own."""
    return cards.agg(*[(F.countDistinct(F.struct(f)) > 1).alias(f) for f in fields])
