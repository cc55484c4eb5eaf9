"""The mix against its definition: targets dealt again and again, seats dealt one by one."""

import heapq
import re
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tesserae.llm import mixing


def plain_targets(sizes):
    """sizes: by source, None last."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, open_ = sum(sizes.values()) * 1.5, {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def plain_seats(votes, seats):
    heap = [(-v, k, 0) for k, v in votes.items() if v > 0]
    heapq.heapify(heap)
    out = dict.fromkeys(votes, 0)
    for _ in range(seats if heap else 0):
        _, k, n = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-votes[k] / (2 * (n + 1) + 1), k, n + 1))
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 4000), min_size=1, max_size=30), st.integers(0, 400))
def test_apportion(spark, votes, seats):
    parties = spark.createDataFrame([(1, f"p{i:02}", v, seats) for i, v in enumerate(votes)], "g int, k string, v long, seats long")
    got = {r.k: r.quota for r in mixing.apportion(parties, "v", "seats", ["g"], ["k"], "quota").collect()}
    assert got == plain_seats({f"p{i:02}": v for i, v in enumerate(votes)}, seats)


def check(df, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = defaultdict(int)
    for _, t, s in rows:
        sums[s] += size(t)
    targets, taken = plain_targets(dict(sums)), defaultdict(int)
    assert len(df) == len(rows)
    by = {i: (s, size(t)) for i, t, s in rows}
    for r in df:
        s, n = by[r.doc_id]
        assert r.size == n and r.source_size == sums[s] and r.target == pytest.approx(targets[s]) and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(2, t / 100), s


def test_mix(spark):
    rows = [(i, "w " * (i % 37), ["big", "b", "é", None, "tiny", ""][0 if i % 3 else i % 6]) for i in range(900)]
    rows += [(2000, None, "b"), (2001, "a\x1cb c \t\x0b d", "b"), (2002, "x " * 30_000, "b"), (None, "one two", "c")]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, taken string")
    got = mixing.mix(df, shard_words=1500)
    check(got.collect(), rows)
    again = mixing.mix(df.repartition(7), shard_words=1500)
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (2, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(df.where("false")).count() == 0
    got = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got)[2] == (2, 0, 0.0, 0) and sum(r.taken for r in got) == 6
    assert [(r.target, r.taken) for r in mixing.mix(df.where("doc_id = 2")).collect()] == [(0.0, 0)]


def test_tables(spark):
    import duckdb

    path = "/root/testdata/sf0.01/documents.parquet"
    df = spark.read.parquet(path)
    got = mixing.mix(df).collect()
    check(got, [(r.doc_id, r.text, r.source) for r in df.collect()])
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS FROM '{path}'")
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(mixing.ORACLE_SQL).fetchall())


def test_many_rows_of_one_id_and_many_equal_rows(spark):
    """Against the SQL; rows of one id are dealt out to shards by their texts, equal ones are one entry of a tape."""
    import duckdb
    import pandas as pd

    rows = pd.DataFrame([(None if i % 3 else i, "w " * (i % 40), f"s{i % 2}") for i in range(4000)] + [(7, f"v{i} w", "s0") for i in range(1001)] + [(8, "a b c", "s1")] * 2500, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    df = spark.createDataFrame([(None if pd.isna(i) else int(i), t, s) for i, t, s in rows.itertuples(index=False)], "doc_id long, text string, source string")
    placed, shards = mixing.tape(df, "doc_id", "text", "source", shard_words=500)
    sizes = placed.groupBy("source_key", "shard").count().agg({"count": "max"}).first()[0]
    assert placed.where("doc_id = 8").count() == 1 and sizes < 120 and shards.agg({"shards": "sum"}).first()[0] > 100
    con = duckdb.connect()
    con.register("documents", rows)
    assert sorted(map(str, map(tuple, mixing.mix(df).collect()))) == sorted(map(str, con.sql(mixing.ORACLE_SQL).fetchall()))


def test_equal_ids_of_unequal_texts_are_told_apart(spark):
    """Also at the cuts, however the input is dealt out: the mixed corpus is the same."""
    rows = [(1, f"w{i} x y z", "a") for i in range(60)] + [(1, "e f g h", "a")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted((r.text, r.taken) for r in mixing.mixed(df.repartition(k), shard_words=37).collect()) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2]


def test_mixed_corpus_of_one_id(spark):
    """So many rows without an id that they are split, and equal ones at the cuts."""
    rows = [(None if i % 3 else i, "v w x y z " * (i % 4), f"s{i % 2}") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, plan = mixing.mixed(df, shard_words=2000).collect(), mixing.mix(df, shard_words=2000).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.taken) for r in got))) == sorted(map(str, ((r.doc_id, r.size, r.taken) for r in plan)))
    assert all(len(r.text.split()) == r.taken for r in got)


def test_mixed_corpus(spark):
    rows = [(i % 50 if i < 60 else None if i % 9 == 0 else i, f"w{i % 50} x\ty\nz " * (i % 5), [None, "a", "b"][i % 3], i) for i in range(400)]
    rows += [rows[-1]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got, plan = mixing.mixed(df, shard_words=100).collect(), mixing.mix(df, shard_words=100).collect()
    assert sorted(map(str, ((r.doc_id, r.size, r.taken) for r in got))) == sorted(map(str, ((r.doc_id, r.size, r.taken) for r in plan)))
    texts = {}
    for i, t, s, _ in rows:
        texts.setdefault((i, s), set()).add(t)
    for r in got:
        assert len(r.text.split()) == r.taken
        whole = r.taken // r.size if r.size else 0
        assert any(len(t.split()) == r.size and r.text.split() == t.split() * whole + t.split()[: r.taken - whole * r.size] for t in texts[r.doc_id, r.source])
    assert len(got) == len(rows) and mixing.mixed(df.where("false")).count() == 0
