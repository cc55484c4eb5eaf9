"""Fingerprints, links and components against plain code."""

import random
import re

import numpy as np
import pytest
import xxhash

from tesserae.llm import simhash
from tesserae.llm.components import components


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: a value a node; smallest node reachable over 2 bits or fewer."""
    x = np.array(fps, np.uint64)
    parent = list(range(len(x)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2) + i + 1:
            p, q = root(i), root(int(j))
            parent[max(p, q)] = min(p, q)
    return [root(i) for i in range(len(x))]


def test_fingerprints():
    rng = random.Random(3)
    texts = ["", " \n", "One", "One two", "A b C", "a\x1cb É\tx\x0by z", "ab " * 40_000] + [" ".join(rng.choice("ab cd é F gh IJ k".split()) for _ in range(rng.randrange(1, 700))) for _ in range(40)]
    hashes = [simhash.shingle_hashes(t.encode()) for t in texts]
    got = simhash.majority(np.array(sum(hashes, []), np.uint64), np.array(list(map(len, hashes))))
    assert got.tolist() == [plain_fingerprint(t) for t in texts]


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    fields = lambda v: np.array([[(int(x) >> i) & 3 for i in range(0, 64, 2)] for x in simhash.packed(v)])
    assert (simhash.manhattan(simhash.packed(a), simhash.packed(b)) == np.abs(fields(a) - fields(b)).sum(axis=1)).all()
    assert (np.abs(fields(a) - fields(b)).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("pairwise", [3_000, 70])
def test_links(spark, pairwise, monkeypatch):
    rng = random.Random(8)
    values = {rng.getrandbits(64) for _ in range(300)}
    for v in list(values)[:60]:
        for _ in range(10):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                v ^= 1 << b
            values.add(v)
    centre = rng.getrandbits(64)
    values |= {centre ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)} | {centre, 0, 3, 1 << 63}
    values = sorted(values)
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.cell_links(fps).collect()
    assert len(edges) <= 4 * len(values)
    assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2 for r in edges)
    at = {v: i for i, v in enumerate(values)}
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in edges:
        p, q = (root(at[x & ((1 << 64) - 1)]) for x in (r.a, r.b))
        parent[max(p, q)] = min(p, q)
    assert [root(i) for i in range(len(values))] == plain_components(values)


def test_large_cell():
    """Every pair of a cell, whichever way it is searched."""
    rng = np.random.default_rng(2)
    fp = np.unique(rng.integers(0, 1 << 10, 700).astype(np.uint64))
    choice, ends = np.zeros(len(fp), np.int64), np.array([len(fp)])
    pairs = []
    for most in (10_000, 10):
        simhash.PAIRWISE, before = most, simhash.PAIRWISE
        i, j = simhash.links(fp, choice, ends)
        simhash.PAIRWISE = before
        pairs.append({frozenset((int(fp[a]), int(fp[b]))) for a, b in zip(i, j, strict=True)})
    whole = {frozenset((int(a), int(b))) for a in fp for b in fp if a < b and int(a ^ b).bit_count() <= 2 and simhash.linked(np.array([a]), np.array([b]), np.array([0]))[0]}
    assert pairs[0] == pairs[1] == whole


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 400)] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(5, 5), (-9, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = spark.createDataFrame([(5000, None), (5001, ""), (4999, " \t"), (None, "x"), (None, "x"), (7, docs.where("doc_id = 3").first().text)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    want = rows.collect()
    fps = [plain_fingerprint(r.text) for r in want]
    roots = plain_components(fps)
    low = {}
    for r, c in zip(want, roots, strict=True):
        if r.doc_id is not None:
            low[c] = min(low.get(c, r.doc_id), r.doc_id)
    expected = sorted(((r.doc_id, f"{f:016x}", low.get(c)) for r, f, c in zip(want, fps, roots, strict=True)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(rows).collect()), key=str) == expected
    assert simhash.near_duplicates(rows.where("false")).count() == 0
