"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over all words, found in a block-max inverted index.

1. Terms are all words of the examples; each word's weight is (1 + log count) * idf * (1 + TELLING * its information on the label). The
   last factor is smooth and holds for every word: no word is chosen or left out. Without it (TELLING = 0) the cosine is plain TF-IDF,
   which finds far fewer toxic rows; README has both figures. Words that no example holds can't add to a cosine; in the text's length,
   each has the idf of a word of one document.
2. Document frequencies come from all documents.
3. Examples are at most TRAIN_ROWS labelled rows, those of the smallest seeded hash, never held-out ones. Examples of equal words and
   counts are one row of the index with two counts.
4. Each term has a list of rows; rows are laid out in groups of alike ones, and each group's longest lists as its columns, with their largest
   weight in every block. The short lists are added up first; of the columns, only the groups that these bounds allow to reach the k-th best
   cosine. So the nearest rows are exact.
5. The nearest examples vote by their distance; votes become probabilities by a monotone fit on leave-one-out votes. The score's evidence
   is the nearest examples' ids.

Labels, language, source and id are no features. Every whole text is scored. Words are known by their 64-bit hashes.

Defined results: a null or empty text gets the score of a text without words; a very long text is one row of counts; cosines count in
millionths, and equal ones go to
the example of the smaller seeded hash; repeated rows get equal scores; an empty table gives an empty table; extra columns are kept, and
one named like a result is replaced; without labels of both classes every score is the smoothed share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import append, buffers, filled, held_out, row_blocks
from tesserae.llm.quality import sample
from tesserae.session import ship

TRAIN_ROWS = 20_000
THRESHOLD = 0.3
NEAREST = 15
#: Picked by leave-one-out votes of the labelled rows that may be learnt from.
TELLING = 300.0
#: Equal examples weigh together as their number to this power, however many they are.
COPIES = 0.5
#: Rows a block and a group of the index; terms whose lists are laid out as columns of a group.
BLOCK_ROWS = 32
GROUP_ROWS = 1 << 10
COLUMNS = 256
#: The longest lists, by which rows are laid out so that those of a block are alike.
AXES = 64
#: Rows whose words are worked on at once while the index is built; vectors that are looked up at once.
PART = 1_000
BATCH = 128
#: Words of lists that are counted or sorted at once.
SORTED = 1 << 19
#: A row's place in the layout and its weight.
ENTRY = np.dtype([("at", np.int32), ("weight", np.float32)])
#: Sums of 32 bits are right to less than this; smaller cosines than LEAST are none.
SLACK = 2e-5
LEAST = 1e-6
#: Scores of texts that a worker remembers.
SCORES = 20_000

LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode().translate(LETTERS).split()


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: where each one's words end (from 0), the hashes of its distinct words, and how often it holds each."""
    found = [Counter(words(t)) for t in texts]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in found])]).astype(np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(found)), np.uint64, ends[-1])
    return ends, hashes, np.fromiter(chain.from_iterable(c.values() for c in found), np.int32, ends[-1])


def numbers(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places among the sorted known hashes, -1 for others."""
    if not len(known):
        return np.full(len(hashes), -1)
    order = np.argsort(hashes)  # so that the search runs through the known ones once
    at = np.empty(len(hashes), np.int64)
    at[order] = np.minimum(np.searchsorted(known, hashes[order]), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def packed(texts: list[str]) -> list[list[bytes]]:
    """By text, the sorted hashes of its distinct words (uint64) and their counts (int32)."""
    ends, hashes, times = bags(texts)
    order = [a + np.argsort(hashes[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return [[hashes[o].tobytes() for o in order], [times[o].tobytes() for o in order]]


def layout(rows: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows in which those of a block are alike: halves along the axis of most spread, down to blocks."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        part = todo.pop()
        if len(part) <= size or not rows.shape[1]:
            out.append(part)
            continue
        x = rows[part].astype(float)
        x -= x.mean(axis=0)
        along = x @ np.linalg.eigh(x.T @ x)[1][:, -1]
        ranked = part[np.argsort(np.round(along, 6), kind="stable")]
        half = size * max(1, len(ranked) // size // 2)
        todo += [ranked[half:], ranked[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """Unit vectors by term. Rows are known by their position in what is given.

    Every term has a list of its rows and weights. Rows are laid out in blocks of alike rows, and some blocks are a group. What the `columns`
    longest lists of a group hold there is laid out as columns of the group instead, with their largest weight in every block; a group's columns
    are added only for the vectors with which one of its blocks could reach the k-th best cosine.
    """

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, size: int = BLOCK_ROWS, columns: int = COLUMNS, group: int = GROUP_ROWS):
        """Row i has terms[ends[i]:ends[i + 1]] with these weights, of any length; weights are changed."""
        n = self.n = len(ends) - 1
        self.blocks, self.size, self.group = -(-n // size), size, max(1, group // size)
        rows = lambda a, b: np.repeat(np.arange(a, b), np.diff(ends[a : b + 1]))  # noqa: E731  of the words of rows a to b - 1
        weights = weights.astype(np.float32, copy=False)
        for a in range(0, n, PART):  # rows at a time, so that no array of double numbers is as long as all words
            at, row = slice(ends[a], ends[min(n, a + PART)]), rows(a, min(n, a + PART)) - a
            norm = np.sqrt(np.bincount(row, weights[at].astype(float) ** 2, min(n, a + PART) - a))
            weights[at] /= np.where(norm > 0, norm, 1.0).astype(np.float32)[row]
        columns = min(columns, n_terms)
        every = np.zeros(n_terms, np.int64)
        for a in range(0, len(terms), SORTED):
            every += np.bincount(terms[a : a + SORTED], minlength=n_terms)
        axis = np.full(n_terms, -1, np.int32)
        longest = np.argsort(-every, kind="stable")[: min(AXES, columns)]
        axis[longest] = np.arange(len(longest))
        axes = np.zeros((n, len(longest)), np.float32)
        for a in range(0, n, PART):
            at = slice(ends[a], ends[min(n, a + PART)])
            held = np.flatnonzero(axis[terms[at]] >= 0)
            axes[rows(a, min(n, a + PART))[held], axis[terms[at][held]]] = weights[at][held]
        self.order = layout(axes, size).astype(np.int32)
        self.place = np.argsort(self.order).astype(np.int32)
        del axes, axis
        each = self.group * size
        chosen = np.zeros((-(-n // each), columns), np.int64)  # by group, the terms that are columns
        for g in range(len(chosen)):
            mine = [terms[ends[r] : ends[r + 1]] for r in self.order[g * each : (g + 1) * each].tolist()]
            chosen[g] = np.argsort(-np.bincount(np.concatenate(mine), minlength=n_terms), kind="stable")[:columns]
        self.long = np.unique(chosen)  # the terms that are columns of any group
        self.column = np.full(n_terms, -1, np.int32)
        self.column[self.long] = np.arange(len(self.long))
        self.columns = self.column[chosen]
        where = np.full((len(chosen), len(self.long)), -1, np.int32)
        where[np.arange(len(chosen))[:, None], self.columns] = np.arange(columns)
        self.dense = np.zeros((self.blocks * size, columns), np.float32)
        short = np.ones(len(terms), bool)
        for a in range(0, n, PART):
            at = slice(ends[a], ends[min(n, a + PART)])
            place, column = self.place[rows(a, min(n, a + PART))], self.column[terms[at]]
            held = np.flatnonzero(column >= 0)
            to = where[place[held] // each, column[held]]
            held, to = held[to >= 0], to[to >= 0]
            self.dense[place[held], to] = weights[at][held]
            short[at][held] = False
            every -= np.bincount(terms[at][held], minlength=n_terms)
        self.most = self.dense.reshape(self.blocks, size, columns).max(axis=1)
        self.start = np.concatenate([[0], np.cumsum(every)]).astype(np.int64)
        self.entries = np.empty(self.start[-1], ENTRY)
        cuts = np.unique(np.searchsorted(self.start, np.arange(0, self.start[-1] + SORTED, SORTED)).clip(0, n_terms))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # some terms at a time, so that no key is held for all words
            mine = np.flatnonzero((terms >= a) & (terms < b) & short)
            place = self.place[np.searchsorted(ends, mine, side="right") - 1]
            order = np.argsort(terms[mine].astype(np.int64) * n + place)
            here = slice(self.start[a], self.start[b])
            self.entries["at"][here], self.entries["weight"][here] = place[order], weights[mine[order]]

    def __setstate__(self, state: dict) -> None:
        """Tasks use the arrays as they are sent."""
        self.__dict__ = dict(state)

    def vectors(self, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Rows first to last - 1: their terms, weights and length, 1."""
        out = []
        rows = self.order[self.entries["at"]]
        mine = np.flatnonzero((rows >= first) & (rows < last))
        rows, weights = rows[mine], self.entries["weight"][mine]
        terms = np.searchsorted(self.start, mine, side="right") - 1
        by = np.argsort(rows, kind="stable")
        ends = np.searchsorted(rows[by], np.arange(first, last + 1))
        for r in range(first, last):
            at = by[ends[r - first] : ends[r - first + 1]]
            dense, group = self.dense[self.place[r]], self.place[r] // (self.group * self.size)
            held = np.flatnonzero(dense)
            found = np.concatenate([terms[at], self.long[self.columns[group, held]]])
            order = np.argsort(found)
            out.append((found[order], np.concatenate([weights[at], dense[held]])[order], 1.0))
        return out

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray, float]], k: int = NEAREST, without: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For vectors (terms in order, weights, length): the rows with the largest cosines, and these; ties to the earlier row.

        without: for each vector, a row that is left out, or None.
        """
        out = []
        for s in range(0, len(queries), BATCH):
            out += self._nearest(queries[s : s + BATCH], k, (without or [None] * len(queries))[s : s + BATCH])
        return out

    def _nearest(self, queries: list, k: int, without: list) -> list[tuple[np.ndarray, np.ndarray]]:
        if not self.n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        q = np.zeros((len(queries), len(self.long)))
        short = np.zeros((len(queries), self.blocks * self.size))  # what the short lists add up to
        for i, (terms, weights, length) in enumerate(queries):
            weights = weights / (length or 1.0)
            column = self.column[terms]
            q[i, column[column >= 0]] = weights[column >= 0]
            starts, many = self.start[terms], self.start[terms + 1] - self.start[terms]
            ends = np.cumsum(many)
            if len(ends) and ends[-1]:
                at = np.repeat(starts - ends + many, many)  # the places of all entries of all lists, each taken as one number
                at += np.arange(len(at))
                entries = self.entries.view(np.int64).take(at, mode="clip").view(ENTRY)
                share = np.repeat(weights, many)
                share *= entries["weight"]
                short[i] = np.bincount(entries["at"], share, self.blocks * self.size)
            if without[i] is not None:
                short[i, self.place[without[i]]] = -2.0
        q32, full = q.astype(np.float32), short.astype(np.float32)
        best = lambda: np.maximum.reduceat(full, np.arange(0, full.shape[1], self.size), axis=1)  # noqa: E731  of each block
        groups = [(slice(b, b + self.group), slice(b * self.size, (b + self.group) * self.size)) for b in range(0, self.blocks, self.group)]
        bound = best()
        least = self.kth(bound, k)
        for columns, (blocks, _) in zip(self.columns, groups, strict=True):
            bound[:, blocks] += q32[:, columns] @ self.most[blocks].T
        bound = np.maximum.reduceat(bound, [blocks.start for blocks, _ in groups], axis=1)
        # the k-th best is no less than that of the likeliest group
        likely = bound.argmax(axis=1)

        def add(g: int, mine: np.ndarray) -> None:
            rows = groups[g][1]
            full[mine, rows] += q32[mine[:, None], self.columns[g]] @ self.dense[rows].T

        for g in np.unique(likely).tolist():
            mine = np.flatnonzero(likely == g)
            add(g, mine)
            least[mine] = np.maximum(least[mine], self.kth(full[mine, groups[g][1]], k))
        open_ = bound >= np.maximum(least - SLACK, LEAST / 2)[:, None]
        open_[np.arange(len(queries)), likely] = False
        for g in np.flatnonzero(open_.any(axis=0)).tolist():
            add(g, np.flatnonzero(open_[:, g]))
        most = best()
        return [self.best(short[i], full[i], most[i], q[i], k) for i in range(len(queries))]

    @staticmethod
    def kth(x: np.ndarray, k: int) -> np.ndarray:
        return np.partition(x, -k, axis=1)[:, -k] if x.shape[1] >= k else np.full(len(x), -1.0, x.dtype)

    def best(self, short: np.ndarray, full: np.ndarray, most: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k rows; sums of 32 bits propose them, each one's cosine is added up anew in 64."""
        blocks = np.flatnonzero(most >= LEAST / 2)
        if len(blocks) > k:
            blocks = np.flatnonzero(most >= max(LEAST / 2, np.partition(most, -k)[-k] - SLACK))
        got = full.reshape(self.blocks, self.size)[blocks].ravel()
        least = max(LEAST / 2, np.partition(got, -k)[-k] - SLACK if len(got) > k else 0.0)
        at = np.flatnonzero(got >= least)
        at = blocks[at // self.size] * self.size + at % self.size
        cosine = np.round(short[at] + (self.dense[at] * q[self.columns[at // (self.group * self.size)]]).sum(axis=1), 6)
        rows = self.order[at]
        order = np.lexsort((rows, -cosine))
        order = order[cosine[order] >= LEAST][:k]
        return rows[order].astype(np.int64), cosine[order]


class Model:
    """The examples' index, what a term weighs, and, once `calibrate` has run, probabilities of votes. All tasks use one broadcast of it."""

    sent: Broadcast

    def __init__(self, hashes: np.ndarray, scale: np.ndarray, unknown: float, index: Index, votes: np.ndarray, ids: list):
        self.hashes, self.scale, self.unknown, self.index, self.votes, self.ids = hashes, scale, unknown, index, votes, ids
        total = votes.sum(axis=0)
        self.share = float((total[1] + 1) / (total.sum() + 2))

    def nearest(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        ends, hashes, times = bags(texts)
        terms, tf = numbers(self.hashes, hashes), 1 + np.log(times)
        weights = tf * np.where(terms >= 0, self.scale[terms], self.unknown)
        queries = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            order = a + np.lexsort((weights[a:b], terms[a:b]))
            length = math.sqrt((weights[order] ** 2).sum())
            order = order[np.searchsorted(terms[order], 0) :]
            queries.append((terms[order], weights[order], length))
        return self.index.nearest(queries)

    def vote(self, rows: np.ndarray, cosine: np.ndarray, votes: np.ndarray) -> float:
        """Share of label 1 among rows with these votes, near ones counting more."""
        total = votes.sum(axis=1)
        weight = np.maximum(total, 1) ** (COPIES - 1) / (0.05 + 1 - cosine)
        return float((0.5 * self.share + (weight * votes[:, 1]).sum()) / (0.5 + (weight * total).sum()))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "sent"}

    def left_out(self, first: int, last: int) -> Iterator[tuple[int, int, int, float]]:
        """Rows of the index: row, label, examples of that label, and the vote on one of them when it isn't asked."""
        alone = self.votes.sum(axis=1) == 1
        queries = self.index.vectors(first, last)
        without = [r if alone[r] else None for r in range(first, last)]
        for row, (rows, cosine) in zip(range(first, last), self.index.nearest(queries, without=without), strict=True):
            for label in (0, 1):
                if self.votes[row, label]:
                    votes = self.votes[rows].copy()
                    if not alone[row]:
                        votes[rows == row, label] -= 1
                    yield row, label, int(self.votes[row, label]), self.vote(rows, cosine, votes)

    def calibrate(self, raw: np.ndarray, y: np.ndarray, times: np.ndarray) -> None:
        self.x, self.p = monotone(np.repeat(raw, times), np.repeat(y, times))


def monotone(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities that rise with raw (pool adjacent violators), smoothed, as points of a broken line that still rises with raw."""
    order = np.lexsort((y, raw))
    pools: list[list[float]] = []
    for x, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        pools.append([x, 1.0, v])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            x1, n1, s1 = pools.pop()
            x0, n0, s0 = pools.pop()
            pools.append([(x0 * n0 + x1 * n1) / (n0 + n1), n0 + n1, s0 + s1])
    xs = np.array([0.0, *(p[0] for p in pools), 1.0])
    share = [(p[2] + 0.2 * p[0]) / (p[1] + 0.2) for p in pools]
    ps = np.maximum.accumulate(np.array([0.0, *share, 1.0]))
    ps[0] = min(ps[0], ps[1])
    keep = np.concatenate([[True], np.diff(xs) > 1e-12])
    return xs[keep], ps[keep]


def document_counts(docs: DataFrame, text: str, hashes: Broadcast) -> DataFrame:
    """term, n: documents that hold it, for the terms whose hashes are sent. Each task holds one number a term."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes.value
        n = np.zeros(len(known) + 1, np.int64)  # the last one: words that no example holds
        for batch in batches:
            for part in row_blocks(batch, text):
                found = Counter()  # the block's words, each hashed once
                for whole in filled(part.column(0)).to_pylist():
                    found.update(set(words(whole)))
                at = numbers(known, np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))) % len(n)
                np.add.at(n, at, np.fromiter(found.values(), np.int64, len(found)))
        seen = np.flatnonzero(n[:-1])
        for s in range(0, len(seen), 1 << 16):
            part = seen[s : s + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(n[part])], names=["term", "n"])

    return docs.select(text).mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))


def information(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Mutual information in nats of a label and a word: a of n1 examples of label 1 hold it, b of n0 others."""
    n = n1 + n0
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    seen, unseen = (a + b) / n, 1 - (a + b) / n
    return np.maximum(0.0, part(a, n1 * seen) + part(b, n0 * seen) + part(n1 - a, n1 * unseen) + part(n0 - b, n0 * unseen)) / n


def examples(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text: str, rows: int) -> pa.Table:
    """_id, _y, and the packed words of `rows` labelled documents at most, in seeded order."""
    chosen = sample(labels, target, rows, id_col).withColumnRenamed(id_col, "_id")
    known = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # `rows` ids at most
    known = known.select("_id", "_y", "_text", F.xxhash64("_id", "_text").alias("_order"))
    fields = [T.StructField("_h", T.BinaryType()), T.StructField("_c", T.BinaryType())]
    found = append(known, "_text", fields, lambda: lambda a: packed(a.to_pylist()))
    return found.select("_id", "_y", "_h", "_c", "_order").orderBy("_order", "_y").limit(rows).toArrow()


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, telling: float = TELLING) -> Model | float:
    spark = docs.sparkSession
    got = examples(docs, labels, target, id_col, text, rows)
    y = got["_y"].to_numpy().astype(float)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if min(n0, n1) < 3:
        return (n1 + 1) / (n0 + n1 + 2)
    packs = [c.cast(pa.large_binary()) for c in (got["_h"].combine_chunks(), got["_c"].combine_chunks())]
    row, ids, votes, same = {}, [], [], []
    for k, (i, label) in enumerate(zip(got["_id"].to_pylist(), y.tolist(), strict=True)):
        at = row.setdefault(hashlib.blake2b(packs[0][k].as_buffer().to_pybytes() + packs[1][k].as_buffer().to_pybytes(), digest_size=16).digest(), len(ids))
        if at == len(ids):
            ids.append(i)
            votes.append([0, 0])
            same.append(k)
        votes[at][int(label)] += 1
    packs = [p.take(pa.array(same)) for p in packs]
    del got, row
    pa.default_memory_pool().release_unused()
    votes = np.array(votes, float)
    ends, every = buffers(packs[0])
    ends, every = ends // 8, every.view(np.uint64)
    hashes = np.unique(every)
    terms = np.empty(len(every), np.int32)
    tf = np.empty(len(every), np.float32)
    times = buffers(packs[1])[1].view(np.int32)
    for a in range(0, len(every), 1 << 18):
        terms[a : a + (1 << 18)] = np.searchsorted(hashes, every[a : a + (1 << 18)])
        tf[a : a + (1 << 18)] = 1 + np.log(times[a : a + (1 << 18)])
    del packs, every, times
    pa.default_memory_pool().release_unused()
    total = docs.count()
    known = spark.sparkContext.broadcast(hashes)
    counted = document_counts(docs, text, known).toArrow()  # a row a word of the examples
    known.destroy()
    n = np.zeros(len(hashes))
    n[counted["term"].to_numpy()] = counted["n"].to_numpy()
    del counted
    held = np.zeros((2, len(hashes)))
    for r in range(0, len(ids), PART):
        at = slice(ends[r], ends[min(len(ids), r + PART)])
        sizes = np.diff(ends[r : r + PART + 1])
        for k in (0, 1):
            held[k] += np.bincount(terms[at], np.repeat(votes[r : r + PART, k], sizes), len(hashes))
    scale = (np.log((1 + total) / (1 + n)) + 1) * (1 + telling * information(held[1], held[0], n1, n0))
    tf *= scale.astype(np.float32)[terms]
    model = Model(hashes, scale, math.log((1 + total) / 2) + 1, Index(ends, terms, tf, len(hashes)), votes, ids)
    del terms, tf
    model.sent = spark.sparkContext.broadcast(model)  # TRAIN_ROWS examples and their words
    model.calibrate(*leave_one_out(spark, model))
    model.index = None  # the tasks have it
    return model


def leave_one_out(spark, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes, labels and numbers of equal examples, computed by a few tasks."""
    ship(spark)
    sent = model.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids = batch.column(0).to_numpy()  # a range
            out = m.left_out(int(ids[0]), int(ids[-1]) + 1) if len(ids) else []
            yield pa.RecordBatch.from_pylist([dict(zip(("r", "y", "n", "vote"), x, strict=True)) for x in out], pa.schema([("r", pa.int64()), ("y", pa.int64()), ("n", pa.int64()), ("vote", pa.float64())]))

    found = spark.range(0, model.index.n, 1, max(1, min(24, model.index.n // 100))).mapInArrow(run, "r long, y long, n long, vote double").toArrow()
    order = np.lexsort((found["y"].to_numpy(), found["r"].to_numpy()))
    return tuple(found[k].to_numpy()[order] for k in ("vote", "y", "n"))


def score(df: DataFrame, model: Model | float, text: str = "text", out: str = "score", evidence: str = "evidence", id_type: T.DataType | None = None) -> DataFrame:
    """df with each whole text's score and the ids (of type id_type) of the labelled examples that are nearest."""
    id_type = id_type or T.LongType()
    if isinstance(model, float):
        return df.withColumns({out: F.lit(round(model, 9)), evidence: F.array().cast(T.ArrayType(id_type))})
    sent, curve = model.sent, (model.x, model.p)
    fields = [T.StructField(out, T.DoubleType()), T.StructField(evidence, T.ArrayType(id_type))]

    def make():
        m = sent.value
        seen: dict[bytes, tuple] = {}

        def work(a: pa.Array) -> list:
            if len(seen) > SCORES:
                seen.clear()
            texts = a.to_pylist()
            keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            new = {k: t for k, t in zip(keys, texts, strict=True) if k not in seen}
            for k, (rows, cosine) in zip(new, m.nearest(list(new.values())), strict=True):
                seen[k] = (round(float(np.interp(m.vote(rows, cosine, m.votes[rows]), *curve)), 9), [m.ids[i] for i in rows[:3].tolist()])
            return [[seen[k][0] for k in keys], [seen[k][1] for k in keys]]

        return work

    return append(df, text, fields, make)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence."""
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    scored = score(kept, fit(docs, labels, "toxic", id_col, text), "_text", id_type=docs.schema[id_col].dataType)
    return scored.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
