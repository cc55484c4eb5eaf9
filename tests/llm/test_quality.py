"""Document statistics against plain counting, the tree code, and the two quality queries."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.llm import docstats, quality, rules, trees

TEXTS = st.lists(st.text(alphabet="ab#|\n \t\x0b\x1c é😀A1!", max_size=60), max_size=8)


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    hit = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_counts(texts):
    c = docstats.counts(pa.array(texts, pa.large_string()))
    assert list(zip(*(c[k].tolist() for k in rules.BASE), strict=True)) == [plain(x) for x in texts]
    x = docstats.features(c)
    assert x.shape == (len(texts), len(docstats.FEATURES)) and np.isfinite(x).all()


def test_long_and_sliced():
    texts = ["a b c d e " * 20_000, "x" * 200_000, "", "a b c d e f a b c d e"]
    c = docstats.counts(pa.array(["pad", *texts], pa.large_string()).slice(1))
    assert c["n_repeat_words"].tolist() == [100_000, 0, 0, 10] and c["longest"].tolist() == [1, 200_000, 0, 1]


def test_boosting_and_isolation():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = trees.boost(x[:2000], y[:2000], rounds=60)
    assert ((trees.probability(model, x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    one = trees.walk(model, x[:1])
    by_hand = 0.0
    for t in range(len(model["feature"])):
        at = 0
        while model["left"][t, at] != at:
            at = model["left"][t, at] if x[0, model["feature"][t, at]] <= model["threshold"][t, at] else model["right"][t, at]
        by_hand += model["value"][t, at]
    assert abs(one[0] - by_hand) < 1e-9
    forest = trees.isolate(np.vstack([x, x[:1] + 50]))
    assert trees.anomaly(forest, np.vstack([x, x[:1] + 50])).argmax() == 3000


def frames(spark):
    good = [(i, f"word{i} and other{i % 7} plain text follows here {i} with ten words or more every{i}", i % 5) for i in range(160)]
    bad = [(i, "### $$$ ||| && a%% b## c$$ | | | | " + f"x{i}", i % 5) for i in range(200, 300)]
    odd = [(900, None, 0), (901, "", 0), (1, good[1][1], 0), (None, "no id here", 1), (902, "x " * 30_000, 1)]
    docs = spark.createDataFrame([(i, t, "en", "score") for i, t, _ in good + bad + odd], "doc_id long, text string, lang string, score string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good] + [(i, 0, 1) for i, _, _ in bad] + [(None, 1, 0), (901, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    docs, labels = frames(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 265
    by = {r.doc_id: r for r in rows}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) or r.doc_id is None for r in rows)
    assert np.mean([by[i].predicted == 1 for i in range(160)]) > 0.97 and np.mean([by[i].predicted == 0 for i in range(200, 300)]) > 0.97
    assert by[900].score == by[901].score
    assert quality.classify(docs.where("false"), labels).count() == 0
    alone = quality.classify(docs, labels.where("false")).collect()
    assert {r.score for r in alone} == {0.5}


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = frames(spark)
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - quality, quality) quality", "toxic")
    assert sorted(quality.classify(docs, turned).collect(), key=str) == sorted(quality.classify(docs, labels).collect(), key=str)


def test_rules(spark):
    docs, labels = frames(spark)
    docs = docs.where("doc_id is null or doc_id not between 212 and 299")  # rows of one kind are anomalies while they are few
    rows = {r.doc_id: r for r in rules.verdicts(docs, labels).collect()}
    for r in docs.collect():
        n, chars, symbols, dups, repeats = plain(r.text or "")
        got = rows[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert got.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (got.base_failed and got.kept)
    assert np.mean([rows[i].kept for i in range(160)]) > 0.98 and np.mean([rows[i].kept for i in range(200, 212)]) < 0.05
    assert rules.verdicts(docs.where("false"), labels).count() == 0
    plainly = rules.verdicts(docs, labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in plainly)


def path(forest, tree, row):
    """The value of the leaf that a row ends in, step by step."""
    at = 0
    while forest["left"][tree, at] != at:
        at = forest["left"][tree, at] if row[forest["feature"][tree, at]] <= forest["threshold"][tree, at] else forest["right"][tree, at]
    return forest["value"][tree, at]


def test_scores_and_anomalies_row_by_row(spark):
    """Every row of both queries from its own statistics, tree by tree."""
    docs, labels = frames(spark)
    model, forest = quality.fit(docs, labels), rules.fit(docs, labels)
    scores = {(r.doc_id, r.score) for r in quality.classify(docs, labels).collect()}
    anomalies = {(r.doc_id, r.anomaly, r.kept) for r in rules.verdicts(docs, labels).collect()}
    for r in docs.collect():
        x = docstats.features(docstats.counts(pa.array([r.text or ""], pa.large_string())))[0]
        margin = model["start"] + sum(path(model, t, x) for t in range(len(model["feature"])))
        score = 1 / (1 + np.exp(-margin))
        assert any(i == r.doc_id and abs(s - score) < 1e-8 for i, s in scores)
        steps = [path(forest, t, x[rules.USED]) for t in range(len(forest["feature"]))]
        assert min(steps) > 0 and forest["feature"].max() > 3  # splits are on many statistics
        anomaly = 2 ** (-np.mean(steps) / forest["norm"])
        n, _, _, _, repeats = plain(r.text or "")
        kept = n >= 10 and 100 * repeats <= 20 * n and anomaly <= forest["cut"]
        assert any(i == r.doc_id and abs(a - anomaly) < 1e-8 and k == kept for i, a, k in anomalies)


def test_trees_split_where_the_gain_is_largest():
    """The first split of the first tree against all splits tried one by one."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 12, (400, 3)).astype(np.float32)
    y = ((x[:, 1] > 6) & (rng.random(400) < 0.9)).astype(float)
    model = trees.boost(x, y, rounds=1, depth=1)
    p = 1 / (1 + np.exp(-np.log((y.sum() + 1) / (400 - y.sum() + 1))))
    g, h = p - y, np.full(400, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    tried = {(j, t): gain(x[:, j] <= t) for j in range(3) for t in range(11) if 8 <= (x[:, j] <= t).sum() <= 392}
    j, t = max(tried, key=tried.get)
    assert (model["feature"][0, 0], model["threshold"][0, 0]) == (j, t)
    low = x[:, j] <= t
    assert np.isclose(path(model, 0, x[low][0]), -0.1 * g[low].sum() / (h[low].sum() + 1))


def test_leaves_hold_path_lengths():
    """Each row of the sample lies in a leaf whose value is the number of splits, and the mean path of those left with it."""
    x = np.random.default_rng(2).normal(size=(64, 4)).astype(np.float32)
    forest = trees.isolate(x, trees=5, sample=64)
    for t in range(5):
        where = {}
        for i, row in enumerate(x):
            at, steps = 0, 0
            while forest["left"][t, at] != at:
                at = forest["left"][t, at] if row[forest["feature"][t, at]] <= forest["threshold"][t, at] else forest["right"][t, at]
                steps += 1
            where.setdefault((at, steps), []).append(i)
        for (at, steps), rows in where.items():
            assert np.isclose(forest["value"][t, at], steps + trees.mean_path(len(rows)))


def test_rules_learn_from_all_labelled_rows(spark):
    """More labelled rows than a fit ever held at once: the threshold is that of all of them."""
    n = 28_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(14)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", i), F.lit(40)).cast("string"))), F.repeat(F.lit("#"), (F.pmod(F.xxhash64("doc_id"), F.lit(97)) / 8).cast("int")))
    docs = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("text", text)
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(97)) < 90).cast("int").alias("quality"))
    model = rules.fit(docs, labels)
    learnt = {r.doc_id: r.quality for r in labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").collect()}
    assert len(learnt) > quality.TRAIN_ROWS
    rows = [r for r in docs.collect() if r.doc_id in learnt]
    c = docstats.counts(pa.array([r.text for r in rows], pa.large_string()))
    score = np.round(trees.anomaly(model, docstats.features(c)[:, rules.USED]), 9)
    y = np.array([learnt[r.doc_id] for r in rows])
    used = (c["n_words"] >= 10) & (100 * c["n_repeat_words"] <= 20 * c["n_words"])
    score, y = score[used], y[used]
    good, bad = np.sort(score[y == 1]), np.sort(score[y == 0])
    cuts = np.unique(score[score >= good[int(np.ceil((1 - rules.MOST_LOST) * (len(good) - 1)))]])
    gain = (len(bad) - np.searchsorted(bad, cuts, side="right")) * len(good) - (len(good) - np.searchsorted(good, cuts, side="right")) * len(bad)
    at = int(np.argmax(gain))
    want = (cuts[at] + (cuts[at + 1] if at + 1 < len(cuts) else cuts[at] + 1e-9)) / 2
    assert abs(model["cut"] - want) < 1e-12 and 0 < at < len(cuts) - 1
