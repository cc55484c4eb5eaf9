"""Audit of sources: how far the terms of each source of a language lie from those of every other one, and which terms stand out.

The steps:

1. terms are counted by (language, source, term) in blocks of text, before anything is dealt out; then one shuffle by (language, term) adds
   them up, drops terms of fewer than MIN_DOCS documents and lists each term's counts by source: its sparse vector;
2. terms of one language with equal vectors are one row with their number: the deduplicated columns. All sums over terms run over these;
3. shares of a group depend on the count alone, so every pair of sources is evaluated once a distinct vector and multiplied by its
   number of terms. Only sources that a vector names are met with each other; what a pair gives where one of the two, or both, have
   count 0 is taken from the counts of each source and from the number of terms, and what the first way gave for named pairs beside
   it is subtracted. So the sums are those over all kept terms, exactly, without a row a term and pair;
4. single terms are ranked as they are, within their group, the best ones kept before rows are dealt out.

Counts are multiplied as decimals of 38 digits, shares are below 2**31, and a pair's sums stay below 2**63 with up to 1e9 kept terms in a language.

Defined results: null text, lang and source are empty strings; rows with equal ids, or equal in all, count once each; very long texts are
counted whole; groups without terms have a row for each other source of their language; a language with no kept term gives 0 for each pair; ties
fall to the lower item in UTF-8 order; an empty table gives an empty table; no column but the three is read, so names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import buffers, filled, row_blocks
from tesserae.session import ensure_checkpoint_dir, ship

MIN_DOCS = 3
TERM_RANKS = 200
SCALE = 1_000_000_000
#: Bytes of text whose terms are counted together.
COUNT_BYTES = 16 << 20
#: Pairs of entries evaluated at once in a task.
PAIRS_AT_ONCE = 1 << 20
#: A table of so many (language, source) groups at most is sent to every task, about 100 bytes each; beyond, it is joined by a shuffle.
GROUPS_SENT = 100_000

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def block_counts(lang: pa.Array, source: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """lang, source, term, n (occurrences), docs of a block of documents."""
    offsets, data = buffers(filled(text))
    inside = _TERM[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a document's first byte begins a term of its own
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    kept = data[inside] | (_UPPER[data[inside]].astype(np.uint8) << 5)
    at = np.cumsum(inside)[starts] - 1 if len(starts) else np.zeros(0, np.int64)
    ends = np.append(at, len(kept)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(kept)).dictionary_encode()
    n_words = max(1, len(words.dictionary))
    langs, sources = filled(lang).dictionary_encode(), filled(source).dictionary_encode()
    n_sources = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * n_sources + sources.indices.to_numpy()
    by_doc, times = np.unique(doc * n_words + words.indices.to_numpy(), return_counts=True)
    key = group[by_doc // n_words] * n_words + by_doc % n_words
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    key, n, docs = key[begin], np.add.reduceat(times, begin) if len(begin) else times, np.diff(np.append(begin, len(key)))
    columns = [langs.dictionary.take(pa.array(key // n_words // n_sources)), sources.dictionary.take(pa.array(key // n_words % n_sources)), words.dictionary.take(pa.array(key % n_words))]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns] + [pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def term_vectors(docs: DataFrame, text: str, lang: str, source: str, min_docs: int) -> DataFrame:
    """lang, term, vector: the kept terms with (source, n) for each source that has them, by source."""
    ship(docs.sparkSession)
    texts = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}")
    rows = docs.select(*map(texts, (lang, source, text)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_blocks(batch, batch.schema.names[2], COUNT_BYTES) if batch.num_rows else ():
                yield block_counts(*part.columns)

    counts = rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return by_term.where(F.col("docs") >= min_docs).select("lang", "term", "vector")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly; 1 where total is 0."""
    return F.expr("1L + CASE WHEN {t} = 0 THEN 0L ELSE ({s} * CAST({n} + 1 AS DECIMAL(28, 0))) div {t} END".format(t=f"CAST({total} AS DECIMAL(38, 0))", s=SCALE, n=n))


def gap(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def groups_of(docs: DataFrame, vectors: DataFrame, lang: str, source: str) -> DataFrame:
    """A row a (lang, source) of the documents: s (its number in the language), big_n (occurrences of kept terms), k (kept terms that it has),
    v (kept terms of the language), lang_n, p0 (the share of a term that it hasn't)."""
    empty = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    groups = docs.select(empty(lang, "lang"), empty(source, "source")).distinct()
    sizes = vectors.select("lang", "m", F.inline("vector")).groupBy("lang", "source").agg(F.sum(F.col("m").cast("decimal(18,0)") * F.col("n")).cast("decimal(27,0)").alias("big_n"), F.sum("m").alias("k"))
    kept = vectors.groupBy("lang").agg(F.sum("m").alias("v"))
    g = groups.join(sizes, ["lang", "source"], "left").join(kept, "lang", "left").fillna(0, ["k", "v"]).withColumn("big_n", F.coalesce("big_n", F.lit(0).cast("decimal(27,0)")))
    by_lang = Window.partitionBy("lang")  # a row a source
    g = g.withColumns({"s": F.row_number().over(by_lang.orderBy("source")), "lang_n": F.sum("big_n").over(by_lang).cast("decimal(27,0)")})
    return g.withColumn("p0", share("0", "big_n + v"))


def named_pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, x, y, value: over the vectors that name both sources, what the pair gives, less what it would give with one count 0, plus with both."""
    numbered = vectors.withColumn("id", F.monotonically_increasing_id()).select("id", "lang", "m", F.inline("vector"))
    shares = numbered.join(groups, ["lang", "source"]).select("id", "lang", "m", "s", share("n", "big_n + v").alias("p"), "p0")
    rows = shares.groupBy("id", "lang", "m").agg(F.collect_list("s").alias("s"), F.collect_list("p").alias("p"), F.collect_list("p0").alias("p0")).where(F.size("s") > 1)

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from pair_sums(batch.column(1), batch.column(2).to_numpy(), *batch.columns[3:])

    return rows.mapInArrow(evaluate, "lang string, x int, y int, value long")


def pair_sums(lang: pa.Array, m: np.ndarray, s: pa.ListArray, p: pa.ListArray, p0: pa.ListArray) -> Iterator[pa.RecordBatch]:
    langs = lang.dictionary_encode()
    size = s.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    begin = (np.cumsum(size) - size)[row]
    partners = size[row]
    code = langs.indices.to_numpy().astype(np.int64)[row]
    s, p, p0 = (x.flatten().to_numpy().astype(np.int64) for x in (s, p, p0))
    many = int(s.max()) + 1
    weight = m.astype(np.int64)[row]
    upto = np.cumsum(partners)
    at = 0
    while at < len(row):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        left = np.repeat(np.arange(at, end), partners[at:end])
        right = begin[left] + np.arange(len(left)) - (upto - partners)[left] + (upto[at - 1] if at else 0)
        left, right = left[left != right], right[left != right]
        f = lambda a, b: (a - b) * (a - b) // b
        value = weight[left] * (f(p[left], p[right]) - f(p[left], p0[right]) - f(p0[left], p[right]) + f(p0[left], p0[right]))
        key = (code[left] * many + s[left]) * many + s[right]
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        if len(first):
            k = key[first]
            ints = [pa.array((x).astype(np.int32)) for x in (k // many % many, k % many)]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(k // many // many)).cast(pa.string()), *ints, pa.array(np.add.reduceat(value, first))], names=["lang", "x", "y", "value"])
        at = end


def pairs(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every two sources of a language."""
    few = F.broadcast if groups.count() <= GROUPS_SENT else (lambda x: x)
    one = vectors.select("lang", "m", F.inline("vector")).groupBy("lang", "source", "n").agg(F.sum("m").alias("m")).join(few(groups), ["lang", "source"])
    one = one.groupBy("lang", F.col("s").alias("a"), share("n", "big_n + v").alias("p")).agg(F.sum("m").cast("decimal(18,0)").alias("m"))
    met = one.join(few(groups.select("lang", F.col("s").alias("b"), "p0")), "lang").where("a <> b")
    there = F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.expr(f"m * {gap('p', 'p0')}").alias("value"))
    back = F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.expr(f"m * {gap('p0', 'p')}").alias("value"))
    one_sided = met.select("lang", F.explode(F.array(there, back)).alias("_")).select("lang", "_.*")
    both = named_pairs(vectors, few(groups)).withColumn("value", F.col("value").cast("decimal(38,0)"))
    found = one_sided.withColumn("value", F.col("value").cast("decimal(38,0)")).union(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("found"))
    x = groups.select("lang", F.col("s").alias("x"), "source", F.col("k").alias("kx"), F.col("p0").alias("px"), "v")
    y = groups.select("lang", F.col("s").alias("y"), F.col("source").alias("item"), F.col("k").alias("ky"), F.col("p0").alias("py"))
    every = x.join(y, "lang").where("x <> y")  # the rows of the result
    neither = F.expr(f"CAST(v - kx - ky AS DECIMAL(18, 0)) * {gap('px', 'py')}")
    return every.join(found, ["lang", "x", "y"], "left").select("lang", "source", "item", (neither + F.coalesce("found", F.lit(0).cast("decimal(38,0)"))).cast("long").alias("value"))


def standing_out(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value of the terms whose share in a group is above that in its language."""
    few = F.broadcast if groups.count() <= GROUPS_SENT else (lambda x: x)
    counts = terms.select("lang", "term", F.aggregate("vector", F.lit(0).cast("decimal(27,0)"), lambda a, e: (a + e["n"]).cast("decimal(27,0)")).alias("all_n"), F.inline("vector"))
    shares = counts.join(few(groups.select("lang", "source", "big_n", "v", "lang_n")), ["lang", "source"])
    shares = shares.select("lang", "source", F.col("term").alias("item"), share("n", "big_n + v").alias("p"), share("all_n", "lang_n + v").alias("q"))
    return shares.where("p > q").select("lang", "source", "item", F.expr(gap("p", "q")).alias("value"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank. term_ranks is the report's length; pairs are all ranked."""
    ensure_checkpoint_dir(docs.sparkSession)
    terms = term_vectors(docs.select(text, lang, source), text, lang, source, min_docs).checkpoint()
    vectors = terms.groupBy("lang", "vector").agg(F.count("*").alias("m")).checkpoint()
    groups = groups_of(docs, vectors, lang, source).checkpoint()
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))).alias("rank")
    out = lambda part, df: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", best)
    return out("pair", pairs(vectors, groups)).union(out("term", standing_out(terms, groups)).where(F.col("rank") <= term_ranks))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
a AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
b AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY lang, term),
p AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM a),
q AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM b),
x AS (SELECT g.lang, g.source, h.source AS item FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source),
y AS (SELECT s.lang, s.source, t.source AS item, sum((s.p - t.p) * (s.p - t.p) // t.p) AS value FROM p s JOIN p t ON s.lang = t.lang AND s.term = t.term AND s.source <> t.source GROUP BY ALL),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM x LEFT JOIN y USING (lang, source, item)
      UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
