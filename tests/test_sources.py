"""Readers and writers on small files."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from tesserae.sources import readers, sinks, store


def put(path, value):
    path.write_text(json.dumps(value, ensure_ascii=False) if not isinstance(value, str) else value, encoding="utf-8")
    return str(path)


def test_catalogue_and_edges(spark, tmp_path):
    nodes = put(tmp_path / "n.json", [{"id": "A-x-001", "tags": ["a"], "extra": 1}, {"id": "B-x-002", "version_history": [{"date": "2024-01-01", "change": "c"}]}])
    rows = readers.catalogue(spark, nodes).orderBy("id").collect()
    assert [r.id for r in rows] == ["A-x-001", "B-x-002"] and rows[0].tags == ["a"] and rows[1].version_history[0].change == "c"
    wrapped = put(tmp_path / "e1.json", {"edges": [{"from": "a", "to": "b", "relation": "cites", "inferred": False}]})
    bare = put(tmp_path / "e2.json", [{"from": "a", "to": "b", "relation": "cites", "inferred": True}])
    assert [tuple(r)[:4] for r in readers.edges(spark, wrapped).collect()] == [("a", "b", "cites", False)]
    assert [tuple(r)[:4] for r in readers.edges(spark, bare).collect()] == [("a", "b", "cites", True)]
    assert readers.edges(spark, str(tmp_path / "none.json")).count() == 0


def test_dictionary_keeps_order(spark, tmp_path):
    path = put(tmp_path / "d.json", {"zz": "1", "aa": "2", "mm": "3"})
    assert [tuple(r) for r in readers.dictionary(spark, path).orderBy("ord").collect()] == [(0, "zz", "1"), (1, "aa", "2"), (2, "mm", "3")]


def test_synonym_index(spark):
    groups = spark.createDataFrame([(0, "ring", ["Band", "loop"]), (1, "loop", ["coil"]), (2, "x", None)], "grp int, canonical string, aliases array<string>")
    got = {r.word: (r.grp, tuple(r.ord)) for r in readers.synonym_index(groups).collect()}
    assert got == {"ring": (0, (0, 0)), "band": (0, (0, 1)), "loop": (1, (0, 2)), "coil": (1, (1, 1)), "x": (2, (2, 0))}


def test_scenarios_documents_manifest_draft(spark, tmp_path):
    light = put(tmp_path / "s.json", [{"id": "s1", "title": "t"}, {"id": "s2", "title": "u"}])
    detail = put(tmp_path / "sd.json", [{"id": "s1", "subtitle": "more"}])
    got = {r.id: (r.title, r.subtitle) for r in readers.scenarios(spark, light, detail).collect()}
    assert got == {"s1": ("t", "more"), "s2": ("u", None)}
    (tmp_path / "docs").mkdir()
    put(tmp_path / "docs" / "a.md", "x\ny")
    assert [r.text for r in readers.documents(spark, str(tmp_path / "docs")).collect()] == ["x\ny"]
    path = put(tmp_path / "m.csv", "filename,category,parent,agency,version,notes\na.pdf,c,,g,1,\n")
    files = spark.createDataFrame([("a.pdf",), ("b.pdf",)], "filename string")
    rows = readers.described(files, readers.manifest(spark, path), {"category": F.lit("guess"), "parent": F.lit("top")}).orderBy("filename").collect()
    assert [(r.category, r.parent) for r in rows] == [("c", "top"), ("guess", "top")]
    assert readers.manifest(spark, str(tmp_path / "no.csv")).count() == 0
    drafts = put(tmp_path / "dr.json", [{"name": "n"}, {"tripReason": "x"}])
    assert [(r.name, r.exchangeRate) for r in readers.draft(spark, drafts, {"exchangeRate": "31"}).collect()] == [("n", "31")]


def test_rates_and_points(spark, tmp_path):
    tree = put(tmp_path / "t.json", [{"region": "r", "countries": [{"country": "c", "cities": [{"key": "k", "name": "n", "rate": 5, "seasonal": [{"from": "12-01", "to": "01-31", "rate": 9}]}]}]}])
    from tesserae.operators.rates import flattened

    rates, seasons = flattened(readers.rate_tree(spark, tree))
    assert [tuple(r) for r in rates.collect()] == [("r", "c", "k", "n", 5)] and [tuple(r) for r in seasons.collect()] == [("k", 0, "12-01", "01-31", 9)]
    flat = put(tmp_path / "f.json", {"entries": [{"node_id": "a", "value": "1", "is_other": True}]})
    assert [(r.node_id, r.is_other) for r in readers.flat_rates(spark, flat).collect()] == [("a", True)]
    kv = spark.createDataFrame([("k", 1)], "key string, v int")
    assert readers.point_read(None, "k") == 503 and readers.point_read(kv, "z") == 404 and readers.point_read(kv, "k").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 3, 1))], "id long, ts timestamp")
    path = str(tmp_path / "ev")
    sinks.append_events(df, path)
    sinks.append_events(df, path)
    assert spark.read.parquet(path).count() == 4
    sinks.retain(spark.read.parquet(path).drop("event_date"), str(tmp_path / "kept"), F.lit("2024-02-01").cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 2
    assert store.put({"a": df, "b": df}, str(tmp_path / "kv"), {"a"}) == {"a": "ok", "b": "ignored"}
    write = sinks.batch_writer(str(tmp_path / "st"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "st")).count() == 2
    sinks.export_json(df, str(tmp_path / "js"))
    assert spark.read.json(str(tmp_path / "js")).count() == 2
