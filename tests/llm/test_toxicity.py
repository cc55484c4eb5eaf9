"""The index against all cosines, held-out accuracy, and odd rows."""

import math
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import toxicity

VECTORS = st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 9), max_size=6), min_size=1, max_size=300)


@settings(max_examples=150, deadline=None)
@given(VECTORS, st.dictionaries(st.integers(0, 11), st.integers(1, 9), max_size=6), st.integers(1, 20), st.sampled_from([1, 4, 32]), st.sampled_from([0, 3, 20]), st.booleans())
def test_nearest_is_exact(vectors, query, k, size, columns, left):
    dense = np.zeros((len(vectors), 12))
    for i, v in enumerate(vectors):
        for t, c in v.items():
            dense[i, t] = c * (t + 1)
    ends = np.cumsum([0, *map(len, vectors)])
    terms = np.array([t for v in vectors for t in v], np.int64)
    index = toxicity.Index(ends, terms, dense[np.repeat(np.arange(len(vectors)), np.diff(ends)), terms], 12, size, columns)
    index.__setstate__(index.__dict__)
    unit = lambda m: m / np.maximum(1e-300, np.linalg.norm(m, axis=-1, keepdims=True))
    q = np.zeros(12)
    q[list(query)] = list(query.values())
    cosine = unit(dense) @ unit(q)
    if left:
        cosine[0] = 0
    ((rows, got),) = index.nearest([(np.array(sorted(query), np.int64), q[sorted(query)], np.linalg.norm(q))], k, [0 if left else None])
    want = np.sort(cosine[cosine > 1e-4])[::-1][:k]
    assert np.allclose(got, want, atol=3e-6) and np.allclose(cosine[rows], got, atol=3e-6)


@settings(max_examples=100, deadline=None)
@given(VECTORS, VECTORS, st.integers(1, 20), st.sampled_from([1, 4]), st.sampled_from([0, 2, 5]), st.sampled_from([4, 16]))
def test_nearest_is_exact_in_groups(vectors, queries, k, size, columns, group):
    """Many vectors at once, against groups of rows that each have columns of their own."""
    table = lambda rows: np.array([[(t + 1) * v.get(t, 0) for t in range(12)] for v in rows], float)
    dense, q = table(vectors), table(queries)
    ends = np.cumsum([0, *map(len, vectors)])
    terms = np.array([t for v in vectors for t in v], np.int64)
    index = toxicity.Index(ends, terms, dense[np.repeat(np.arange(len(vectors)), np.diff(ends)), terms], 12, size, columns, group)
    unit = lambda m: m / np.maximum(1e-300, np.linalg.norm(m, axis=-1, keepdims=True))
    cosines = unit(q) @ unit(dense).T
    asked = [(np.array(sorted(v), np.int64), row[sorted(v)], np.linalg.norm(row)) for v, row in zip(queries, q, strict=True)]
    for (rows, got), cosine in zip(index.nearest(asked, k), cosines, strict=True):
        assert np.allclose(got, np.sort(cosine[cosine > 1e-4])[::-1][:k], atol=3e-6) and np.allclose(cosine[rows], got, atol=3e-6)
    for (found, weights, _), row in zip(index.vectors(0, len(vectors)), unit(dense), strict=True):
        assert found.tolist() == np.flatnonzero(row).tolist() and np.allclose(weights, row[found], atol=1e-6)


def test_frequent_words_of_each_group_are_columns():
    """Four languages of rows: what a language's rows often hold is in no list, however many words the others have."""
    rng = np.random.default_rng(5)
    words = [np.unique(np.concatenate([16 * (i % 4) + rng.integers(0, 16, 12), [64 + i]])) for i in range(512)]
    terms, ends = np.concatenate(words), np.cumsum([0, *map(len, words)])
    index = toxicity.Index(ends, terms, np.ones(len(terms)), 64 + 512, 16, 16, 64)
    assert len(index.entries) < 0.2 * len(terms)


def test_scores_equal_plain_ones(spark):
    """Every score anew: dictionaries of words, all cosines, votes, leave-one-out votes, calibration."""
    rng = np.random.default_rng(3)
    some = [f"w{int(x)}" for x in rng.zipf(1.4, 6000) % 400]
    texts = [" ".join(some[i * 15 : i * 15 + 5 + i % 11]) + (" vile" * (i % 3) + " É! rot" if i % 5 == 0 else "") for i in range(400)]
    texts[7], texts[11], texts[12], texts[390] = texts[5], "", "...", "nothing known"
    docs = spark.createDataFrame([(f"id{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    labels = spark.createDataFrame([(f"id{i}", int(i % 5 == 0)) for i in range(300)], "doc_id string, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}

    chosen = [(r["_id"], int(r["_y"])) for r in toxicity.examples(docs, labels, "toxic", "doc_id", "text", 20_000).to_pylist()]
    split = lambda t: Counter("".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split())
    bags = {f"id{i}": split(t) for i, t in enumerate(texts)}
    df = Counter(w for b in bags.values() for w in b)
    n1 = sum(y for _, y in chosen)
    n0, known = len(chosen) - n1, Counter(w for i, _ in chosen for w in bags[i])
    bad = Counter(w for i, y in chosen if y for w in bags[i])

    def information(w):
        total = 0.0
        for y, n in ((1, n1), (0, n0)):
            inside = bad[w] if y else known[w] - bad[w]
            for x, marginal in ((inside, known[w]), (n - inside, n1 + n0 - known[w])):
                total += x * math.log(x * (n1 + n0) / (n * marginal)) if x else 0.0
        return total / (n1 + n0)

    def vector(bag):
        v = {w: (1 + math.log(c)) * (math.log(401 / (1 + df[w])) + 1) * (1 + 300 * information(w)) if w in known else (1 + math.log(c)) * (math.log(401 / 2) + 1) for w, c in bag.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    rows = {}
    for i, y in chosen:
        key = tuple(sorted(bags[i].items()))
        rows.setdefault(key, [vector(bags[i]), [0, 0], i])[1][y] += 1
    rows = list(rows.values())

    def vote(v, out=None, y=None):
        alone = out is not None and sum(rows[out][1]) == 1
        near = [(-round(sum(x * r[0].get(w, 0.0) for w, x in v.items()), 6), j) for j, r in enumerate(rows) if not (alone and j == out)]
        top, bottom, asked = 0.5 * (n1 + 1) / (n1 + n0 + 2), 0.5, []
        for c, j in sorted(x for x in near if x[0] < 0)[:15]:
            n = [rows[j][1][k] - (not alone and j == out and k == y) for k in (0, 1)]
            weight = max(1, sum(n)) ** -0.5 / (0.05 + 1 + c)
            top, bottom = top + weight * n[1], bottom + weight * sum(n)
            asked.append(rows[j][2])
        return top / bottom, asked

    raw = [(vote(r[0], j, y)[0], y) for j, r in enumerate(rows) for y in (0, 1) for _ in range(r[1][y])]
    x, p = toxicity.monotone(np.array([a for a, _ in raw]), np.array([float(b) for _, b in raw]))
    for i, bag in bags.items():
        share, asked = vote(vector(bag) if bag else {})
        assert abs(got[i].score - np.interp(share, x, p)) < 1e-5 and got[i].evidence == asked[:3], i


def test_monotone():
    rng = np.random.default_rng(0)
    raw = rng.random(4000)
    y = (rng.random(4000) < raw**2).astype(float)
    x, p = toxicity.monotone(raw, y)
    assert (np.diff(p) >= 0).all() and abs(np.interp(0.8, x, p) - 0.64) < 0.1


def test_every_copy_of_an_example_counts():
    """However many there are: each further one moves the vote, by less than the one before."""
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, None, np.array([[5.0, 5.0]]), [1])
    votes = [model.vote(np.array([0, 1]), np.array([0.9, 0.9]), np.array([[0.0, n], [4.0, 0.0]])) for n in (*range(1, 101), 10_000)]
    steps = np.diff(votes)
    assert (steps > 0).all() and (np.diff(steps[:-1]) < 0).all() and votes[-1] > 0.97


def test_words():
    assert toxicity.words("ÉA-b 3,x\n") == ["éa".encode(), b"b", b"3", b"x"]


def test_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert np.mean(caught) > 0.85 and np.mean([r.predicted for r in rows if r.toxic == 0]) < 0.02
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in rows)
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) toxic")
    again = toxicity.classify(docs, turned).where("held_out").select("doc_id", "score").collect()
    assert {r.doc_id: r.score for r in rows}.items() <= {r.doc_id: r.score for r in again}.items()


def test_odd_rows(spark):
    rows = [(i, f"plain words number {i} of text" + (" nastyword" if i % 4 == 0 else ""), "x") for i in range(200)]
    rows += [(900, None, "x"), (901, "", None), (902, "nastyword " * 30_000, "x"), (4, rows[4][1], "x"), (None, "nastyword", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 205 and by[900].score == by[901].score
    assert [by[i].predicted for i in (4, 8, 12, 902, None)] == [1] * 5 and sum(by[i].predicted for i in range(200) if i % 4) == 0
    assert toxicity.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.where("false")).collect()} == {0.5}


def test_copy_of_an_example_is_its_nearest(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).where("doc_id = 8847").first()  # held out; a copy of the labelled toxic row 8959
    assert got.evidence[0] == 8959
