"""Weighted text search with synonyms, the n-gram index, and relevance order."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import grams, has, norm
from tesserae.operators.ranking import containing

#: What a synonym's match is worth. A double: as a decimal, 90, 170 and 180 would round otherwise.
SYNONYM_SHARE = 0.7


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """queries: query. Gives query, term, ord in the order of first sight; ord 0 is the query itself.

    After the query come the words of the group that holds it exactly (the last such group), then those of each group with a word
    that contains it or lies in it. Substrings are proposed by a run of letters and then verified, so both sides may grow.
    """
    q = queries.select("query", norm(F.col("query")).alias("_q")).distinct()
    s = synonyms.select("grp", "ord", F.lower("word").alias("word"))
    winner = s.groupBy("word").agg(F.max("grp").alias("_exact"))
    own = q.where("_q <> ''")
    other = s.select(F.col("grp").alias("_g"), F.col("word").alias("_w"))
    near = containing(other, "_w", own, "_q").unionByName(containing(own, "_q", other, "_w")).select("query", "_q", "_g", "_w").distinct()
    groups = near.join(winner.withColumnRenamed("word", "_x"), F.col("_q") == F.col("_x"), "left")
    groups = groups.groupBy("query", "_q", "_g").agg(F.min(F.when(F.col("_g") == F.col("_exact"), 0).otherwise(1)).alias("_rank"))
    terms = groups.join(s, F.col("_g") == F.col("grp")).select("query", F.col("word").alias("term"), F.struct("_rank", "_g", F.col("ord").alias("_o")).alias("_at"))
    own = own.select("query", F.col("_q").alias("term"), F.struct(F.lit(-1).alias("_rank"), F.lit(-1).alias("_g"), F.lit(-1).alias("_o")).alias("_at"))
    seen = own.union(terms).groupBy("query", "term").agg(F.min("_at").alias("_at"))
    return seen.select("query", "term", (F.row_number().over(Window.partitionBy("query").orderBy("_at")) - 1).alias("ord"))


def term_score(term: Column | str, original: bool, weights: dict[str, int], share: float = SYNONYM_SHARE) -> Column:
    """What one term is worth on a card, by the fields that hold it."""
    worth = lambda w: F.lit(float(w) if original else float(int(w * share)))
    fields = {"title": F.col("title"), "id": F.col("id").cast("string"), "tags": F.array_join("tags", " "), "summary": F.col("summary")}
    return sum((F.when(has(fields[k], term), worth(w)).otherwise(F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))


def search(cards: DataFrame, terms: list[str], weights: dict[str, int]) -> DataFrame:
    """Cards that any term matches, with score and the first synonym that matched. The first term is the original.

    Terms are literals of one query, so scoring is one pass over the cards without a join or a shuffle.
    """
    scores = [term_score(t, i == 0, weights) for i, t in enumerate(terms)]
    first = F.coalesce(*[F.when(s > 0, F.lit(t)) for t, s in zip(terms[1:], scores[1:], strict=True)], F.lit(None).cast("string"))
    return cards.withColumns({"score": sum(scores[1:], scores[0]).cast("long"), "via": first}).where("score > 0")


def ranked(found: DataFrame, limit: int | None = None, relevant: DataFrame | None = None) -> DataFrame:
    """Best first: by the scenario's score if one is chosen (relevant: id, relevance), then the query's; ties in load order."""
    order = [F.col("score").desc(), F.col("load_ord")]
    if relevant is not None:
        found, order = found.join(relevant, "id"), [F.col("relevance").desc(), *order]
    out = found.orderBy(*order)
    return out.limit(limit) if limit else out


def indexed(cards: DataFrame) -> Column:
    """What the index holds of a card."""
    return F.concat_ws("\n", "title", F.col("id").cast("string"), F.array_join("tags", " "), "summary")


def dealt(cards: DataFrame, *by: str) -> DataFrame:
    """The cards over all partitions: a catalogue of few bytes is read by few tasks, and each card becomes some sixty rows."""
    return cards.repartition(int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def postings(cards: DataFrame, only: list[str] | None = None) -> DataFrame:
    """gram, id: the inverted index in long form; only: the grams that are wanted, which are looked for in the text without cutting it up."""
    if only is not None:
        known = sorted({g for g in only if len(g) in (2, 3) and " " not in (g[0], g[-1])})
        text = F.lower(indexed(cards))
        found = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.contains(text, F.lit(g)), g) for g in known]))
        return cards.select("id", F.explode(found).alias("gram"))
    rows = dealt(cards.select("id", indexed(cards).alias("_text")), "id")
    return rows.select("id", F.explode(grams(F.col("_text"), 2, 3)).alias("gram"))


def gram_stats(cards: DataFrame) -> DataFrame:
    """docs (with any gram), bigrams, trigrams: how many different ones. Grams are told apart in each task before they are dealt out."""
    rows = dealt(cards.select("id", indexed(cards).alias("_text")), "id")
    one = rows.select(F.explode(grams(F.col("_text"), 2, 3)).alias("gram")).distinct()
    n = one.agg(F.count_if(F.length("gram") == 2).alias("bigrams"), F.count_if(F.length("gram") == 3).alias("trigrams"))
    # a text has a gram of two or three characters if two that aren't blank are next to each other, or have one between them
    docs = cards.where(F.rlike(F.lower(indexed(cards)), F.lit("(?s)[^ ].?[^ ]"))).agg(F.countDistinct("id").alias("docs"))
    return docs.crossJoin(F.broadcast(n))


def wanted(terms: list[str]) -> dict[str, list[str]]:
    """By term its grams: of three letters if it has any, else of two. A term of one character has none, as the index is a prefilter of
    longer queries."""
    cut = lambda t, n: sorted({t.lower()[i : i + n] for i in range(len(t) - n + 1) if t[i] != " " and t[i + n - 1] != " "})
    return {t: cut(t, 3) or cut(t, 2) for t in terms}


def candidates(index: DataFrame, terms: list[str]) -> DataFrame:
    """Ids whose postings hold all grams of some term. Only the wanted grams' postings are read from the index, and dealt out once."""
    need = {t: g for t, g in wanted(terms).items() if g}
    hits = index.where(F.col("gram").isin(sorted({x for g in need.values() for x in g})))
    n = hits.groupBy("id").agg(*[F.count_if(F.col("gram").isin(g)).alias(f"_{i}") for i, g in enumerate(need.values())] or [F.lit(0).alias("_0")])
    full = [F.col(f"_{i}") == len(g) for i, g in enumerate(need.values())]
    return n.where(reduce(or_, full, F.lit(False))).select("id")


def prefiltered(cards: DataFrame, terms: list[str], least: int = 2) -> DataFrame:
    """The cards that hold all grams of some term, in one pass without an index; the filter acts only if a term has `least` characters."""
    need = [g for t, g in wanted(terms).items() if len(t) >= least and g]
    if not need:
        return cards
    text = F.lower(indexed(cards))
    return cards.where(reduce(or_, [reduce(and_, [F.contains(text, F.lit(x)) for x in g]) for g in need]))


def palette(items: DataFrame, terms: list[str], kinds: dict[str, int], limit: int = 60, scenarios: int = 12) -> DataFrame:
    """items: kind, label, haystack, ord. Kind's worth, and 50 if the label holds the query itself; ranked by kind and order after that.

    Without a query: all views, then the first scenarios (kind rule), each worth its kind.
    """
    worth = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("kind")), F.lit(0))
    if not terms:
        first = items.where("kind = 'rule'").orderBy("ord").limit(scenarios)
        return items.where("kind = 'view'").unionByName(first).withColumn("score", worth).orderBy(F.col("score").desc(), "kind", "ord").limit(limit)
    any_ = F.lit(False)
    for t in terms:
        any_ = any_ | has(F.col("haystack"), t)
    score = worth + F.when(has(F.col("label"), terms[0]), 50).otherwise(0)
    return items.where(any_).withColumn("score", score).orderBy(F.col("score").desc(), "kind", "ord").limit(limit)
