"""Versions, retention by folders, loosely typed JSON."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.sources import loose, sinks, store


def numbers(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def test_versions_are_pinned_and_forgotten(spark, tmp_path):
    at = str(tmp_path / "r")
    assert [store.commit(numbers(spark, n), at) for n in (3, 4, 5)] == [1, 2, 3]
    pinned = store.read(spark, at, 2)
    assert pinned.count() == 4 and store.read(spark, at).count() == 5
    assert store.forget(spark, at, 2) == [1] and store.versions(spark, at) == [2, 3] and pinned.count() == 4
    with pytest.raises(FileNotFoundError):
        store.read(spark, at, 1)
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "none"))


def test_a_job_that_dies_leaves_the_version_before(spark, tmp_path):
    at = str(tmp_path / "r")
    store.commit(numbers(spark, 3), at)
    broken = spark.range(0, 8, 1, 4).select(F.when(F.col("id") == 7, F.raise_error(F.lit("half way"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="half way"):
        store.commit(broken, at)
    assert store.versions(spark, at) == [1] and store.read(spark, at).count() == 3
    got = store.put({"a": numbers(spark, 2), "b": broken, "c": numbers(spark, 1), "d": numbers(spark, 1)}, at, {"a", "b", "c"})
    assert got["a"] == got["c"] == "ok" and got["d"] == "ignored" and got["b"].startswith("failed")


def test_two_editors(spark, tmp_path):
    at = str(tmp_path / "draft")
    assert store.autosave(numbers(spark, 1), at, 0) == 1 and store.autosave(numbers(spark, 2), at, 1) == 2
    with pytest.raises(store.Conflict):
        store.autosave(numbers(spark, 9), at, 1)
    assert store.read(spark, at).count() == 2 and len([n for n in store.names(spark, at) if n.startswith("data-")]) == 2
    for k in range(2, 9):
        store.autosave(numbers(spark, k + 1), at, k)
    assert store.versions(spark, at) == [5, 6, 7, 8, 9]


def test_pointer_of_a_version_is_made_once(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / n).write_text(n)
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store.move(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert (tmp_path / "b").read_text() == "b"


def files(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_retention_writes_the_border_day_only(spark, tmp_path):
    at = str(tmp_path / "ev")
    rows = spark.range(240).select("id", (F.lit("2024-03-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"))
    sinks.append_events(rows, at)
    before = files(at)
    got = sinks.drop_older(spark, at, datetime(2024, 3, 4, 10))
    assert got == {"gone": [f"event_date=2024-03-0{k}" for k in (1, 2, 3)], "cut": ["event_date=2024-03-04"]}
    left = spark.read.parquet(at)
    assert left.count() == 240 - 3 * 24 - 10 and left.agg(F.min("id")).first()[0] == 82
    new = {p for p, t in files(at).items() if before.get(p) != t}
    assert new and all("event_date=2024-03-04" in p for p in new)
    assert sinks.drop_older(spark, at, datetime(2024, 3, 4, 10))["gone"] == [] and spark.read.parquet(at).count() == left.count()


def test_retention_that_died_is_made_whole(spark, tmp_path):
    at = tmp_path / "ev"
    sinks.append_events(spark.sql("SELECT 1L AS id, timestamp'2024-03-04 12:00:00' AS ts"), str(at))
    (at / "event_date=2024-03-04").rename(at / "_old-event_date=2024-03-04")
    sinks.drop_older(spark, str(at), datetime(2024, 3, 1))
    assert spark.read.parquet(str(at)).count() == 1


def test_guards(spark):
    lines = [
        '{"id": "a", "title": "t", "tags": ["x", 2], "ord": 3, "obsolete": true, "effective_period": ""}',
        '{"id": "b", "tags": "x,y", "ord": "3", "title": 7, "obsolete": "yes", "parent": null}',
        '{"id": "c", "ord": 2.9, "tags": {"a": 1}, "summary": ["s"]}',
        '{"id": "", "title": "t"}', '{"title": "t"}', '{"id": 5}', "[1]", '"text"', '{"id": "d", ', "", None, "3",
    ]
    good, bad = loose.records(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string"))
    got = {r.id: tuple(r)[1:] for r in good.select(*loose.cards(F.col("v"))).collect()}
    assert got == {"a": ("t", None, ["x", "2"], 3, "", True, None), "b": ("b", None, [], 0, "", False, None), "c": ("c", None, [], 2, "", False, None)}
    assert {r.n: r.reason for r in bad.collect()} == {3: "no key", 4: "no key", 5: "no key", 6: "not an object", 7: "not an object", 8: "syntax", 9: "empty", 10: "empty", 11: "not an object"}


def test_malformed_files_have_no_rows(spark, tmp_path):
    for name, value in {"good": '[{"q": "a", "n": 1}, {"q": "b"}]', "object": '{"q": "a"}', "broken": '[{"q": "a"', "empty": ""}.items():
        (tmp_path / f"f={name}").mkdir()
        (tmp_path / f"f={name}" / "x.json").write_text(value)
    got = loose.whole(spark, str(tmp_path), "array<struct<q:string,n:int>>").collect()
    assert sorted((r.f, r.q, r.n) for r in got) == [("good", "a", 1), ("good", "b", None)]
    (tmp_path / "f=good" / "x.json").write_text('{"k": {"title": "t", "items": ["i"]}, "l": {}}')
    got = loose.whole_map(spark, str(tmp_path), "struct<title:string,items:array<string>>").where("f = 'good'").collect()
    assert sorted((r.key, r.title, r["items"]) for r in got) == [("k", "t", ["i"]), ("l", None, None)]
