"""The trie against one built in dictionaries."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb

from tesserae.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows, rebuild=True):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            by[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    node = {}
    for c in sorted(by):
        own = [y[3:] for y in sorted(by[c])]
        if rebuild:
            h = zlib.crc32(str(c).encode()) % 4
            own = [y[3:] for y in sorted(by.get(c - c % 20, []))][:h] + own[h:]
        for d in range(len(own) + 1):
            e = node.setdefault(tuple(own[:d]), {"conv": c, "n": 0, "ends": [], "ch": 0, "leaves": 0, "saved": 0})
            e["n"] += 1
            if d == len(own):
                e["ends"].append(c)
    for k in node:
        if k:
            node[k[:-1]]["ch"] += 1
    out = []
    for k in sorted(node, key=len, reverse=True):
        e, up = node[k], node[k[:-1]] if k else None
        e["leaves"] = e["leaves"] or 1
        e["saved"] += (e["n"] - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        if up:
            up["leaves"] += e["leaves"]
            up["saved"] += e["saved"]
        out.append((e["conv"], len(k), up["conv"] if up else None, e["n"], e["ch"], e["leaves"], e["saved"], hashlib.sha256(",".join(map(str, e["ends"])).encode()).hexdigest()))
    return sorted(map(str, out))


def check(spark, rows, rebuild=True):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)
    if rebuild:
        got = prefix_trie.nodes(df)
    else:
        turns = prefix_trie.ordered(df).withColumnRenamed("pos", "depth").checkpoint()
        got = prefix_trie.trie(turns, turns.groupBy("conv").agg({"depth": "max"}).withColumnRenamed("max(depth)", "len"))
    assert sorted(map(str, map(tuple, got.collect()))) == plain(rows, rebuild)


def test_random_trees(spark):
    rng = random.Random(3)
    rows = []
    for c in range(120):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c\td", "", None, "é"]) if t < 3 else rng.choice("xy")) for t in range(rng.randrange(1, 9))]
    check(spark, rows)


def test_deep_shared_turns_copies_and_prefixes(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "u", f"turn {t}") for c in (21, 22, 23) for t in range(12)] + [(24, t, "u", f"turn {t}") for t in range(7)]
    rows += [(c, t, "u", f"copy {t}" if t < 4 else "end") for c in range(100, 140) for t in range(5)]  # one class, and its parts
    rows += [(c, 0, "u", "alone") for c in (5, 1000)]
    check(spark, rows, rebuild=False)
    check(spark, rows)


def test_edges(spark):
    odd = [(None, 1, "u", "nobody's"), (7, None, None, None), (7, None, "", ""), (7, 2, "u", "b"), (7, 2, "u", "b"), (7, 2, "u", "a"), (-5, 0, "u", "b"), (-40, 0, "u", "c"), (20, 5, "ab", "c"), (21, 5, "a", "bc"), (3, 1, "u", "w " * 20_000)]
    check(spark, odd)
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(c, 0, "u", "x") for c in range(1, 4)])  # some without any turn left
    check(spark, [(40, t, "u", "x") for t in range(3)])


def test_tables(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{path}'")
    df = spark.read.parquet(path)
    got = sorted(map(str, map(tuple, prefix_trie.nodes(df).collect())))
    assert got == sorted(map(str, con.sql(prefix_trie.ORACLE_SQL).fetchall())) == plain([tuple(r) for r in df.collect()])
