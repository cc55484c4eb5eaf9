"""What a user asks for: immutable, compiled to predicates on a catalogue of cards."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From the widest to the narrowest; going up to one clears all that follow it.
LEVELS = ("topic", "klass", "category", "tag", "query", "scenario")


@dataclass(frozen=True)
class QuerySpec:
    topic: str | None = None
    klass: str | None = None
    category: str | None = None
    tag: str | None = None
    query: str | None = None
    scenario: str | None = None
    show_obsolete: bool = False

    def drill_up(self, level: str) -> QuerySpec:
        """Keep this level and those above it."""
        return replace(self, **dict.fromkeys(LEVELS[LEVELS.index(level) + 1 :]))

    def focus(self, topic: str) -> QuerySpec:
        """Everything but the topic is cleared."""
        return QuerySpec(topic=topic)

    def without(self, *facets: str) -> QuerySpec:
        return replace(self, **dict.fromkeys(facets))

    def predicates_by_facet(self, concrete: list[str], residual: str) -> dict[str, Column]:
        """Cheap ones first; null means no restriction. Text and scenario are joins and not among them."""
        out = {}
        if not self.show_obsolete:
            out["status"] = ~F.coalesce(F.col("obsolete"), F.lit(False))
        if self.topic is not None:
            out["topic"] = F.col("topic") == self.topic
        if self.klass is not None:
            out["klass"] = F.col("klass") == self.klass
        if self.category is not None:
            out["category"] = in_category(self.category, concrete, residual)
        if self.tag is not None:
            out["tag"] = F.array_contains("tags", self.tag)
        return out

    def predicates(self, concrete: list[str], residual: str) -> list[Column]:
        return list(self.predicates_by_facet(concrete, residual).values())

    def apply(self, cards: DataFrame, concrete: list[str], residual: str) -> DataFrame:
        for p in self.predicates(concrete, residual):
            cards = cards.where(p)
        return cards


def in_category(category: str, concrete: list[str], residual: str) -> Column:
    """The residual category holds the rows that carry none of the concrete ones."""
    if category == residual:
        return ~F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, concrete))), F.lit(False))
    return F.coalesce(F.array_contains("tags", category), F.lit(False))
