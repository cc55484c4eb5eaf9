"""The FM-index and the report against plain search."""

import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import decontam
from tesserae.llm.fmindex import FMIndex, suffix_array

RUNS = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=40), min_size=1, max_size=8)


@settings(max_examples=400, deadline=None)
@given(RUNS, st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=5), min_size=1, max_size=8))
def test_index(runs, patterns):
    text = np.array([x for r in runs for x in [*r, 0]])
    order = suffix_array(text)
    key = lambda i: [(0, i + k) if x == 0 else (1, x) for k, x in enumerate(text[i:].tolist())]
    assert order.tolist() == sorted(range(len(text)), key=key)
    index = FMIndex(text)
    rows = np.zeros((len(patterns), 5), np.int64)
    for i, p in enumerate(patterns):
        rows[i, 5 - len(p) :] = p
    low, high = index.search(rows, np.array(list(map(len, patterns))))
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, windows):
    w = plain_words(text)
    hit, items = set(), set()
    sizes = {len(k) for k in windows}
    for i in range(len(w)):
        for n in sizes:
            if (found := windows.get(tuple(w[i : i + n]))) is not None and i + n <= len(w):
                hit |= set(range(i, i + n))
                items |= found
    return (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))


def windows_of(items):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).update([] if i is None else [str(i)])
    return windows


LONG = "alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def test_report(spark):
    items = [(9, LONG), (10, "short Item"), (11, None), (12, "..."), (10, "short item again"), (None, "nameless words here"), (13, LONG + " pi")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [LONG.upper(), f"x {LONG} y", "alpha beta", None, "", "a short, ITEM! b", "short item again short item", "nameless words here", "É" + LONG, (LONG + " ") * 3, "filler " * 50_000 + LONG, LONG.replace("nu", "nix"), "short", LONG + "\x1c" + LONG, "short", "item"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, LONG, "x"), (0, LONG.upper(), "x")], "doc_id long, text string, hits string")
    want = sorted([(r.doc_id, *plain(r.text, windows_of(items))) for r in docs.collect()], key=str)
    assert sorted(map(tuple, decontam.report(docs, bench).collect()), key=str) == want
    split = decontam.detect(docs.select("doc_id", "text"), bench, panel_words=3)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r.items)) for r in split.collect()), key=str) == [x[:4] for x in want]
    assert decontam.report(docs.where("false"), bench).count() == 0
    assert {(r.n_hit, r.contaminated) for r in decontam.report(docs, bench.where("false")).collect()} == {(0, False)}
    spans = decontam.detect(docs, bench).where("doc_id = 1").first().hits
    assert [(h.first_word, h.end_word, h.start, h.end) for h in spans] == [(1, 16, 2, 2 + len(LONG))]
    assert decontam.without(docs, bench).columns == docs.columns


def test_panels_share_one_index(monkeypatch):
    """However many panels: the same words, spans and items, and each shard is indexed once."""
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(40)}"
    items = [(str(k), [word().encode() for _ in range(int(rng.integers(1, 30)))]) for k in range(60)]
    texts = pa.array([" ".join([word() for _ in range(int(rng.integers(0, 60)))] + [x.decode() for x in items[int(rng.integers(60))][1]]) for _ in range(50)], pa.large_string())
    made = []
    monkeypatch.setattr(decontam, "FMIndex", lambda runs: made.append(1) or FMIndex(runs))
    got = []
    for size in (1, 7, 60):
        number: dict = {}
        panels = [decontam.Panel(items[i : i + size], number) for i in range(0, 60, size)]
        got.append(decontam.search(texts, number, panels))
    assert got[0] == got[1] == got[2] and len(made) == 3 and any(got[0][2])


def test_tables(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    windows = windows_of([tuple(r) for r in bench.collect()])
    got = sorted(map(tuple, decontam.report(docs, bench).collect()))
    assert got == sorted((r.doc_id, *plain(r.text, windows)) for r in docs.collect())
    assert 0 < sum(r[5] for r in got) < len(got) / 4


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '/root/testdata/sf0.001/{t}.parquet'")
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert sorted(map(tuple, decontam.report(docs, bench).collect())) == sorted(con.sql(decontam.ORACLE_SQL).fetchall())
