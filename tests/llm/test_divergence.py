"""The audit against sums over all terms and pairs."""

import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tesserae.llm import divergence


def plain(rows):
    """rows: text, lang, source."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= 3]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= 3) for s in {d[1] for d in mine}}
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for s, c in counts.items():
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                best = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(best, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(t, la, s, "x") for t, la, s in rows], "text string, lang string, source string, term string").repartition(3)


def test_against_plain(spark):
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(65 + i // 26)}" for i in range(200)]
    pick = lambda: " ".join(words[min(int(x), 199)] for x in rng.exponential(25, int(rng.integers(0, 40))))
    rows = [(pick(), ["en", "de", None][i % 3], [None, "", "a", "B", "é", f"s{i % 11}"][i % 6]) for i in range(300)]
    rows += [("solo words", "xx", "one"), (None, "yy", "a"), ("", "yy", "b"), ("three times", "zz", "a"), ("three", "zz", "a"), ("three", "zz", None), ("", "zz", "c"), ("hot " * 30_000, "en", "hot"), ("a1b-c\nD_e", "en", "a")]
    rows += [rows[5]] * 4
    assert sorted(map(tuple, divergence.audit(table(spark, rows)).collect())) == plain(rows)


def test_many_terms_are_cut_by_rank_and_ties_fall_to_the_lower_item(spark):
    word = lambda i: "t" + "".join(chr(97 + i // 26**k % 26) for k in range(3))
    rows = [(" ".join(word(i) for i in range(400)), "en", "a")] * 3 + [("other", "en", "b")] * 5
    got = divergence.audit(table(spark, rows)).collect()
    assert sorted(map(tuple, got)) == plain(rows)
    assert sum(r.part == "term" and r.source == "a" for r in got) == 200


def test_empty(spark):
    assert divergence.audit(table(spark, []).where("false")).count() == 0


@pytest.mark.parametrize("texts", [["a b", "", "ba", "a"], ["é", "Éa É", "x" * 1000, "1 2"], [""], ["a", "a", "", "a"]])
def test_block_counts(texts):
    n = len(texts)
    got = divergence.block_counts(pa.array(["l"] * n), pa.array(["s", None][i % 2] for i in range(n)), pa.array(texts)).to_pylist()
    want, docs = Counter(), Counter()
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        want.update((["s", ""][i % 2], w) for w in found)
        docs.update((["s", ""][i % 2], w) for w in set(found))
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in got} == {k: (want[k], docs[k]) for k in want} and len(got) == len(want)


def test_pairs_in_small_steps(monkeypatch):
    """However few pairs are evaluated at once, the sums are those over all pairs."""
    rng = np.random.default_rng(2)
    rows = [sorted(rng.choice(9, int(rng.integers(1, 9)), replace=False).tolist()) for _ in range(40)]
    lists = lambda make: pa.array([[make() for _ in r] for r in rows], pa.list_(pa.int64()))
    p, p0 = lists(lambda: int(rng.integers(1, 10**9))), lists(lambda: int(rng.integers(1, 1000)))
    m = rng.integers(1, 5, 40)
    sums = Counter()
    for s, a, z, w in zip(rows, p.to_pylist(), p0.to_pylist(), m, strict=True):
        for i in range(len(s)):
            for j in range(len(s)):
                f = lambda x, y: (x - y) ** 2 // y
                if i != j:
                    sums[s[i], s[j]] += int(w) * (f(a[i], a[j]) - f(a[i], z[j]) - f(z[i], a[j]) + f(z[i], z[j]))
    for at_once in (1, 7, 10**6):
        monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", at_once)
        got = Counter()
        for batch in divergence.pair_sums(pa.array(["l"] * 40), m, pa.array(rows, pa.list_(pa.int32())), p, p0):
            for r in batch.to_pylist():
                got[r["x"], r["y"]] += r["value"]
        assert {k: v for k, v in got.items()} == dict(sums)


def test_tables(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{path}'")
    assert sorted(map(tuple, divergence.audit(spark.read.parquet(path)).collect())) == sorted(con.sql(divergence.ORACLE_SQL).fetchall())
