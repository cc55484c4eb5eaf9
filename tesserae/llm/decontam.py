"""Benchmark decontamination: an FM-index for each shard of documents, searched backwards for all benchmark windows at once.

A shard is a block of whole documents in a task. Its words become numbers of the benchmark's vocabulary; a word outside it cannot be in
an occurrence, so it separates runs, and runs shorter than the shortest window are left out. Windows found are located by sampled
positions, and their spans are merged.

The benchmark goes to the tasks as one vocabulary and its windows, in panels of at most PANEL_WORDS words. A shard is split into words and
indexed once, however many panels search it. Each worker holds the whole benchmark, whose rows pass through the driver: it is the small side.

Defined results: very long texts are blocks of their own, read whole; extra columns are kept, and one named like a result is replaced; items
are in the order of their ids as text; a null text has no words, no hits and is not contaminated; a null or wordless item has no window; windows of an item with
a null id hit words but name no item; rows of equal item ids are one item; repeated documents each get their own result; an empty table
of documents gives an empty table, an empty benchmark no hits.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import append, aside
from tesserae.llm.fmindex import FMIndex

WINDOW = 13
PANEL_WORDS = 1_000_000
#: n_hit * this many >= n_words: contaminated.
ONE_IN = 20

#: Bytes of words, A-Z lower-cased; all others become spaces.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = regex.compile(r"[0-9A-Za-z\u0080-\U0010FFFF]+")

HIT = T.StructType([T.StructField(k, T.IntegerType()) for k in ("first_word", "end_word", "start", "end")])


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Panel:
    """Windows of some items, as rows of numbers; `number` is the vocabulary of all panels, and grows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], number: dict[bytes, int]):
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, found in items:
            ids = [number.setdefault(w, len(number) + 1) for w in found]
            for i in range(max(1, len(ids) - WINDOW + 1)):
                owners.setdefault(tuple(ids[i : i + WINDOW]), set()).update([] if item is None else [item])
        self.length = np.array([len(w) for w in owners], np.int64)
        self.patterns = np.zeros((len(owners), WINDOW), np.int64)
        for k, w in enumerate(owners):
            self.patterns[k, WINDOW - len(w) :] = w
        self.names = sorted(set().union(*owners.values()))
        place = {x: i for i, x in enumerate(self.names)}
        self.owners = np.array([place[x] for s in owners.values() for x in s], np.int64)
        self.owner_ends = np.cumsum([len(s) for s in owners.values()])

    def items(self, text: np.ndarray, window: np.ndarray, out: list[list[str]]) -> None:
        """Adds to out, by text, the items whose windows occur in it."""
        # a window that occurs many times in a text is one pair before its owners are looked up
        pairs = np.unique(text * len(self.length) + window)
        at, w = pairs // len(self.length), pairs % len(self.length)
        size = self.owner_ends[w] - np.where(w > 0, self.owner_ends[w - 1], 0)
        owner = self.owners[np.repeat(self.owner_ends[w] - np.cumsum(size), size) + np.arange(size.sum())]
        each = np.unique(np.repeat(at, size) * max(1, len(self.names)) + owner)
        for t, x in zip((each // max(1, len(self.names))).tolist(), (each % max(1, len(self.names))).tolist(), strict=True):
            out[t].append(self.names[x])


class Shard:
    """The index of a shard's runs of known words. ids: numbers of its words, 0 for others; text: whose word it is."""

    def __init__(self, ids: np.ndarray, text: np.ndarray, least: int):
        self.index = None
        if not len(ids):
            return
        known = ids > 0
        begins = known.copy()
        begins[1:] &= ~known[:-1] | (text[1:] != text[:-1])
        starts = np.flatnonzero(begins)
        ends = known.copy()
        ends[:-1] &= ~known[1:] | (text[1:] != text[:-1])
        size = np.flatnonzero(ends) + 1 - starts
        starts, size = starts[size >= least], size[size >= least]
        if not len(starts):
            return
        # the runs, with a 0 after each, and where each place of them is in the shard
        into = np.cumsum(size + 1) - size - 1
        self.place = np.repeat(starts - into, size + 1) + np.arange(size.sum() + len(size))
        runs = ids[np.minimum(self.place, len(ids) - 1)]
        runs[into + size] = 0
        self.index = FMIndex(runs)

    def occurrences(self, panel: Panel) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur, and their first words."""
        if self.index is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, high = self.index.search(panel.patterns, panel.length)
        found = np.flatnonzero(low < high)
        many = high[found] - low[found]
        rows = np.repeat(low[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return np.repeat(found, many), self.place[self.index.locate(rows)]


def search(texts: pa.Array, number: dict[bytes, int], panels: list[Panel]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """By text: number of words, merged spans, items with a window that occurs."""
    raw = texts.cast(pa.large_binary()).to_pylist()
    ids: list[int] = []
    sizes = []
    for t in raw:
        found = words(t)
        sizes.append(len(found))
        ids.extend(map(number.get, found, repeat(0)))
    text = np.repeat(np.arange(len(raw)), sizes)
    spans: list[list[dict]] = [[] for _ in raw]
    items: list[list[str]] = [[] for _ in raw]
    if not panels:
        return sizes, spans, items
    shard = Shard(np.array(ids, np.int64), text, min(int(p.length.min()) for p in panels))
    cover = np.zeros(len(ids) + 1, np.int64)
    for panel in panels:
        window, first = shard.occurrences(panel)
        if len(window):
            np.add.at(cover, first, 1)
            np.add.at(cover, first + panel.length[window], -1)
            panel.items(text[first], window, items)
    hit = np.cumsum(cover[:-1]) > 0
    edge = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (text[1:] == text[:-1])])) if len(hit) else np.zeros(0, np.int64)
    stop = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (text[1:] == text[:-1]), [False]])) + 1 if len(hit) else edge
    base = np.cumsum(sizes) - sizes
    for t in np.unique(text[edge]).tolist():
        places = [m.span() for m in WORD.finditer(raw[t].decode())]
        mine = text[edge] == t
        for a, b in zip((edge[mine] - base[t]).tolist(), (stop[mine] - base[t]).tolist(), strict=True):
            spans[t].append({"first_word": a, "end_word": b, "start": places[a][0], "end": places[b - 1][1]})
    return sizes, spans, [sorted(set(found)) for found in items]


def read(benchmark: DataFrame, id_col: str, text: str, panel_words: int) -> tuple[dict[bytes, int], list[Panel]]:
    """The vocabulary of all items, and their windows in panels."""
    number: dict[bytes, int] = {}
    panels, part, size = [], [], 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        if found := words(row.t.encode()):
            part.append((row.i, found))
            size += len(found)
        if size >= panel_words:
            panels.append(Panel(part, number))
            part, size = [], 0
    return number, panels + ([Panel(part, number)] if part else [])


def detect(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_col: str = "item_id", item_text: str = "text", panel_words: int = PANEL_WORDS) -> DataFrame:
    """docs with n_words, hits (merged spans, in words and in code points), items, n_hit, contaminated."""
    context = docs.sparkSession.sparkContext
    number, panels = read(benchmark, item_col, item_text, panel_words)
    sent = context.broadcast(number), [context.broadcast(p) for p in panels]  # the benchmark is taken to be the small side
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(HIT)), T.StructField("items", T.ArrayType(T.StringType()))]

    def make():
        """One pass over the texts for all panels."""
        known, parts = sent[0].value, [p.value for p in sent[1]]
        return lambda texts: list(search(texts, known, parts))

    out = append(docs, text, fields, make)
    hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end_word"] - h["first_word"])
    out = out.withColumn("n_hit", hit.cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = detect(docs.select(id_col, text), benchmark, text).drop(text)
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def without(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs that are not contaminated, as they are."""
    named, back = aside(docs, text)
    return detect(named, benchmark, text).where(~F.col("contaminated")).select(*back)


#: The report in DuckDB's SQL, for tables whose ids are unique: every window of every document meets the items' windows.
ORACLE_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, low),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), a, b), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
j AS (SELECT item_id, w, least(len(w), 13) AS n FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win FROM j),
o AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS win, unnest(range(1, len(w) - n + 2)) AS k
      FROM d, (SELECT DISTINCT n FROM j) WHERE len(w) >= n),
h AS (SELECT doc_id, item_id, n, k FROM o JOIN p USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
