"""Shared lines against plain counting, at every place where a run can be cut."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tesserae.llm import line_dedup

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(texts, min_docs, order=None):
    """Kept text, lines, dropped lines by row; with an order of rows, the first occurrence stays."""
    split = [(t or "").split("\n") for t in texts]
    found = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    seen, out = set(), {}
    for i in order or range(len(texts)):
        stay = []
        for x in split[i]:
            k = key(x)
            if found[k] < min_docs or (order is not None and k not in seen):
                stay.append(x)
            seen.add(k)
        out[i] = ("\n".join(stay), len(split[i]), len(split[i]) - len(stay))
    return [out[i] for i in range(len(texts))]


TEXTS = [None, "", "\n\n", "A\nb \n\ta", "a", "É\né", "\x1ca\n a\x0b", "x\r\nx\r\nb", "q\n" * 500 + "b", "b\n" * 300 + "a"]
TEXTS += [f"own {i}\nShared Line\n only {i}\nshared line \n\nb" for i in range(60)] + ["hot"] * 300 + ["one\ntwo\nhot"] * 7


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("min_docs", [1, 2, 10, 65])
def test_against_plain(spark, parts, min_docs):
    rows = [(None if i % 50 == 0 else i // 2, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = line_dedup.cleaned(df.repartition(5), min_docs=min_docs, parts=parts).collect()
    want = plain([t for _, t, _ in rows], min_docs)
    assert sorted(map(str, ((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got))) == sorted(map(str, ((i, *w) for (i, _, _), w in zip(rows, want, strict=True))))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_first_occurrence_stays(spark, parts):
    rng = random.Random(parts)
    texts = ["\n".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(6))) + f"\nown {i}" for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.cleaned(df, min_docs=2, keep_first=True, parts=parts).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, 2, list(range(len(texts))))


def test_repeated_rows_count_and_share_a_bitmap(spark):
    df = spark.createDataFrame([(1, "a\nb\na")] * 9 + [(2, "A")], "doc_id long, text string").coalesce(1)
    got = line_dedup.cleaned(df).collect()
    assert sorted((r.text, r.n_dropped) for r in got) == [("", 1)] + [("b", 2)] * 9
    assert line_dedup.keep_maps(df).count() == 2
    assert line_dedup.cleaned(df.where("doc_id = 1")).where("n_dropped > 0").count() == 0


@given(st.sets(st.integers(0, 200), min_size=1), st.integers(0, 300))
def test_bitmaps(dropped, more):
    n = max(dropped) + 1 + more
    assert set(np.flatnonzero(~line_dedup.kept(line_dedup.packed(sorted(dropped)), n))) == dropped


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string, _id int, __aside0 string, copy string")
    assert line_dedup.digests(df).count() == 0 and line_dedup.cleaned(df).columns == [*df.columns, "n_lines", "n_dropped"]
    got = line_dedup.digests(spark.createDataFrame([(None, None), (3, "")], "doc_id long, text string")).collect()
    assert {tuple(r)[1:] for r in got} == {(1, 0, hashlib.sha256(b"").hexdigest())}


def test_tables(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    assert sorted(map(tuple, line_dedup.digests(spark.read.parquet(path)).collect())) == sorted(con.sql(line_dedup.ORACLE_SQL).fetchall())
