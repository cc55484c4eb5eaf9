"""What must hold whatever the rows: facets add up, the index loses nothing, pages add up, streams equal batches."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.operators import events as ev
from tesserae.operators import facets, graph, search
from tesserae.operators.ranking import containing
from tesserae.plans import config as c
from tesserae.plans.spec import QuerySpec
from tesserae.session import ensure_checkpoint_dir
from tesserae.sources.tables import cards
from tesserae.streaming import events as streams

DIR = "/root/testdata/sf0.001"


def test_facets_add_up(spark):
    rows = cards(spark, DIR)
    for spec in (QuerySpec(), QuerySpec(klass="PROMO"), QuerySpec(category="other")):
        n = {r.value: r.n for r in facets.counts(rows, spec, "topic", c.CONCRETE, c.RESIDUAL).collect()}
        assert sum(v for k, v in n.items() if k is not None) == n[None] == spec.apply(rows, c.CONCRETE, c.RESIDUAL).count()
    n = {r.value: r.n for r in facets.counts(rows, QuerySpec(), "category", c.CONCRETE, c.RESIDUAL).collect()}
    for k in [*c.CONCRETE, c.RESIDUAL]:
        assert n.get(k, 0) == QuerySpec(category=k).apply(rows, c.CONCRETE, c.RESIDUAL).count()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=12), min_size=1, max_size=20), st.text(alphabet="abc", min_size=2, max_size=4))
def test_index_equals_scan(spark, titles, term):
    rows = spark.createDataFrame([(i, t, ["x"], "") for i, t in enumerate(titles)], "id long, title string, tags array<string>, summary string")
    found = {r.id for r in search.candidates(search.postings(rows), [term]).collect()}
    text = F.concat_ws("\n", "title", F.col("id").cast("string"), F.array_join("tags", " "), "summary")
    scan = {r.id for r in rows.where(tx.has(text, term)).collect()}
    assert scan <= found == {r.id for r in search.prefiltered(rows, [term]).collect()}
    assert {r.id for r in rows.where(F.col("id").isin(list(found)) & tx.has(text, term)).collect()} == scan if found else not scan


def test_bad_events(spark):
    rows = [("click", "t", "{}"), ("what", "t", "{}"), ("click", "t" * 101, "{}"), ("click", "t", "x" * 501), (None, None, None), ("view", None, None)]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1), *r) for i, r in enumerate(rows)], "id long, ts timestamp_ntz, type string, target string, context string")
    got = {r.id: r.x for r in df.select("id", ev.reject_reason(c.EVENT_TYPES).alias("x")).collect()}
    assert got == {0: None, 1: "type", 2: "target", 3: "context", 4: "type", 5: None}
    clean = ev.sanitised(df.where("id in (0, 5)"), "click", F.lit("agent of more than sixteen"), F.lit("2024-01-01").cast("timestamp_ntz")).orderBy("id").collect()
    assert [len(clean[0].target), clean[0].agent, clean[1].target] == [16, "agent of more th", None]


def test_batches_are_guarded(spark):
    item = "struct<id:long,type:string,target:string,context:string>"
    good, bad = (1, "click", "t", "{}"), (2, "what", "t", "{}")
    df = spark.createDataFrame([("ok", [good, bad]), ("none", []), ("many", [good] * 51), ("full", [good] * 50)], f"batch string, items array<{item}>")
    assert {r.batch: r.n for r in ev.unbatched(df, c.EVENT_TYPES).groupBy("batch").agg(F.count("*").alias("n")).collect()} == {"ok": 1, "full": 50}


def test_stream_equals_batch(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=37 * i), "u" + str(i % 3), "view") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, user string, type string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in ev.windows(df, "1 day").collect()}
    assert {tuple(r) for r in streams.run_to_end(ev.windows(read(), "1 day"), spark, "t", "complete").collect()} == batch
    late = streams.run_to_end(streams.daily(read(), "10 days"), spark, "t")
    assert {tuple(r) for r in late.collect()} <= batch
    once = streams.run_to_end(streams.once_each(read(), ["user"], "30 days").select("user"), spark, "t")
    assert sorted(r.user for r in once.collect()) == ["u0", "u1", "u2"]


def test_chains(spark):
    rows = [(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 6), (7, 4), (8, 999)] + [(i, i + 1) for i in range(1000, 1300)] + [(1300, None)]
    got = {r.id: (r.last, r.steps, r.cycle) for r in graph.chains(spark.createDataFrame(rows, "id long, next long")).collect()}
    assert [got[k] for k in (1, 2, 3, 6, 8)] == [(3, 2, False), (3, 1, False), (3, 0, False), (6, 0, False), (999, 1, False)]
    assert [got[k] for k in (4, 5, 7)] == [(None, None, True)] * 3
    assert all(got[i] == (1300, 1300 - i, False) for i in range(1000, 1301))
    assert graph.chains(spark.createDataFrame([], "id long, next long")).count() == 0


def plain_paths(edges, question, seen, path):
    for q, opt, after, conclude in edges:
        if q == question and (after is None or after not in seen):
            here = f"{path}>{opt}" + (f">{after}" if after else "")
            if conclude:
                yield here, len(seen), conclude
            if after:
                yield from plain_paths(edges, after, [*seen, after], here)


def test_flow_paths(spark):
    deep = [(f"q{i}", 1, f"q{i + 1}", None) for i in range(21)] + [("q21", 1, None, "end")]
    alike = [("q10", 1, "q1", None), ("q1", 1, None, "end"), ("q1", 2, "q10", None), ("q10", 2, None, "other")]
    loops = [(f"q{i}", o, f"q{(i * 3 + o) % 6}", None) for i in range(6) for o in (1, 2)] + [("q4", 3, None, "c"), ("q5", 3, None, "d")]
    flows = {"deep": (deep, "q0"), "alike": (alike, "q10"), "loops": (loops, "q0")}
    rows = [(f, *e) for f, (es, _) in flows.items() for e in es]
    starts = spark.createDataFrame([(f, q) for f, (_, q) in flows.items()], "flow string, question string")
    got = graph.flow_paths(starts, spark.createDataFrame(rows, "flow string, question string, opt int, next string, conclude string"))
    want = [(f, *x) for f, (es, q) in flows.items() for x in plain_paths(es, q, [q], q)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 5


def test_flow_reach_in_a_dense_flow(spark):
    """Every question leads to every other one: far too many ways to list, and few questions."""
    edges = spark.createDataFrame([("f", f"q{i}", j, f"q{j}", None) for i in range(40) for j in range(40)] + [("f", "q39", 99, None, "c")], "flow string, question string, opt int, next string, conclude string")
    got = {(r.kind, r.name): r.depth for r in graph.flow_reach(spark.createDataFrame([("f", "q0"), ("g", "q0")], "flow string, question string"), edges).collect() if r.flow == "f"}
    assert got == {("question", "q0"): 0, ("conclusion", "c"): 2} | {("question", f"q{i}"): 1 for i in range(1, 40)}
    assert graph.flow_reach(spark.createDataFrame([], "flow string, question string"), edges).count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé ", max_size=8), max_size=12), st.lists(st.text(alphabet="abé ", max_size=5), max_size=12))
def test_substring_join(spark, texts, parts):
    hay, needles = spark.createDataFrame(list(enumerate(texts)), "i int, t string"), spark.createDataFrame(list(enumerate(parts)), "j int, p string")
    got = sorted((r.i, r.j) for r in containing(hay, "t", needles, "p").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(parts) if p and p in t)


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_drill_and_focus():
    spec = QuerySpec(topic="a", klass="b", category="c", tag="d", query="e", scenario="f")
    assert spec.drill_up("klass") == QuerySpec(topic="a", klass="b") and spec.focus("z") == QuerySpec(topic="z")
