"""Each stage against plain code on a small table, and the whole."""

import re

import pytest

import corpus_pipeline as cp
from tesserae.llm import pii, quality, simhash
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_decontam import windows_of
from tests.llm.test_mixing import check as check_mix
from tests.llm.test_simhash import plain_components, plain_fingerprint

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_stages(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    scored = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    kept = cp.keep_good(spark, docs, DIR)
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, s in scored.items() if s >= 0.7} and kept.columns == docs.columns

    one = cp.keep_one(spark, kept, DIR)
    order = sorted(rows)
    groups = plain_components([plain_fingerprint(rows[i].text) for i in order])
    first = {}
    for i, g in zip(order, groups, strict=True):
        first.setdefault(g, i)
    left = {r.doc_id: r for r in one.collect()}
    assert left == {i: rows[i] for i in first.values()} and len(left) < len(rows)

    clean = cp.keep_uncontaminated(spark, one, DIR)
    windows = windows_of([tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()])
    rest = {r.doc_id: r for r in clean.collect()}
    assert rest == {i: r for i, r in left.items() if not plain_hits(r.text, windows)[4]} and len(rest) < len(left)

    hidden = cp.hide_personal_data(spark, clean, DIR)
    assert hidden.columns == docs.columns
    got = {r.doc_id: r for r in hidden.collect()}
    assert set(got) == set(rest)
    for i, r in got.items():
        assert r.text == pii.redact(rest[i].text, pii.find(rest[i].text)) and r.n_chars == len(r.text)
        assert not [x for x in pii.find(r.text) if x[4]]
    assert sum(r.text != rest[i].text for i, r in got.items()) > 0

    check_mix(cp.mix_sources(spark, hidden, DIR).collect(), [(r.doc_id, r.text, r.source) for r in got.values()])


def test_run(spark):
    assert [n for n, _ in cp.STAGES] == ["quality", "simhash", "decontamination", "pii", "mixing"]
    rows = cp.run(spark, DIR).collect()
    assert len(rows) > 400 and rows[0].asDict().keys() == {"doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert all(len(split(r.text)) == r.taken and len(r.text) == r.n_chars for r in rows) and sum(r.taken for r in rows) > sum(r.size for r in rows)


def test_one_of_each(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, "a b c", "y"), (None, "a b c", "z"), (None, "d e f g", "z"), (None, "d e f g", "z"), (3, None, "x"), (4, "", "x"), (5, "other words are here", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n string")
    got = sorted(map(tuple, simhash.deduplicated(df).collect()), key=str)
    assert got == sorted([(1, "a b c", "x"), (None, "d e f g", "z"), (3, None, "x"), (5, "other words are here", "x")], key=str)
    assert simhash.deduplicated(df.where("false")).count() == 0


def test_empty_and_odd_tables(spark, docs, tmp_path):
    spark.read.parquet(f"{DIR}/labels.parquet").where("false").write.parquet(f"{tmp_path}/labels.parquet")
    spark.read.parquet(f"{DIR}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x", None, "s", 1), (2, "w " * 40_000, "en", "s", 80_000)], docs.schema)
    for frame in (docs.where("false"), odd):
        for name, stage in cp.STAGES:
            frame = stage(spark, frame, str(tmp_path))
            assert name == "mixing" or frame.columns == docs.columns
            frame.collect()
