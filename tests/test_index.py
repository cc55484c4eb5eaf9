"""The stored index and facets in one scan."""

import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tesserae.operators import facets, index, search
from tesserae.plans.spec import QuerySpec
from tesserae.sources import store


def some_cards(spark, n=400):
    rng = random.Random(1)
    word = lambda: rng.choice(["red", "blue", "ring", "bolt", "Bold Ring", "é é", "x"])
    rows = [(i * 37, f"{word()} {word()}", rng.choice(["T1", "T2", "T3"]), rng.choice(["A", "B", None]), sorted({word(), word()}), word(), i % 7 == 0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, title string, topic string, klass string, tags array<string>, summary string, obsolete boolean")


def test_lookup_equals_a_scan(spark, tmp_path):
    cards = some_cards(spark)
    index.save(cards, str(tmp_path / "i"), buckets=8, block=1000)
    stored = store.read(spark, str(tmp_path / "i"))
    for term in ("ring", "Bold R", "re", "é é", "d x\n", "nothing"):
        want = {r.id for r in cards.where(F.contains(F.lower(search.indexed(cards)), F.lit(term.lower()))).collect()}
        assert {r.id for r in index.lookup(cards, stored, term, 8, 1000).collect()} == want, term


def test_only_the_buckets_of_the_grams_are_read(spark, tmp_path):
    index.save(some_cards(spark), str(tmp_path / "i"))
    stored = store.read(spark, str(tmp_path / "i"))
    grams = search.wanted(["bold"])["bold"]
    found = index.postings(stored, grams)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    wanted = {f"bucket={r[0]}" for r in spark.createDataFrame([(g,) for g in grams], "g string").select(index.bucket(F.col("g"))).collect()}
    scanned = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.rsplit("/", 2)[1] for r in scanned} <= wanted


def test_places_are_written_as_differences(spark, tmp_path):
    index.save(some_cards(spark), str(tmp_path / "i"))
    data = next(p for p in (tmp_path / "i").glob("data-*/bucket=*/*.parquet"))
    columns = pq.ParquetFile(data).metadata.row_group(0)
    encodings = {columns.column(i).path_in_schema: columns.column(i).encodings for i in range(columns.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["places.list.element"]


def test_all_facets_as_one_by_one(spark):
    cards, concrete = some_cards(spark), ["red", "blue", "ring"]
    for spec in (QuerySpec(), QuerySpec(topic="T1"), QuerySpec(topic="T1", klass="A", category="red"), QuerySpec(category="other", tag="bolt"), QuerySpec(topic="none"), QuerySpec(topic="T2", klass="B", show_obsolete=True)):
        got = facets.every(cards, spec, concrete, "other")
        assert got._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
        have = {(r.facet, r.value): r.n for r in got.collect()}
        for facet in ("topic", "klass", "category"):
            want = {r.value: r.n for r in facets.counts(cards, spec, facet, concrete, "other").collect() if r.n}
            assert {v: n for (f, v), n in have.items() if f == facet} == want, (spec, facet)
        tags = spec.apply(cards, concrete, "other").select(F.explode(F.array_distinct("tags")).alias("t")).where(~F.col("t").isin(concrete))
        assert {v: n for (f, v), n in have.items() if f == "tag" and v is not None} == {r.t: r["count"] for r in tags.groupBy("t").count().collect()}


def test_grams_are_made_in_all_partitions(spark, tmp_path):
    """A file that one task reads; blanks, line ends and characters beyond the basic plane against plain code."""
    cards = some_cards(spark).union(spark.createDataFrame([(99_999, "\U0001f600 a\U0001f600b", None, None, ["\n", " "], "  \U0001f600", False), (99_998, None, None, None, None, None, False)], some_cards(spark).schema))
    cards.coalesce(1).write.parquet(str(tmp_path / "c"))
    read = spark.read.parquet(str(tmp_path / "c"))
    texts = {r[0]: r[1].lower() for r in cards.select("id", search.indexed(cards)).collect()}
    want = {(i, t[k : k + n]) for i, t in texts.items() for n in (2, 3) for k in range(len(t) - n + 1) if t[k] != " " and t[k + n - 1] != " "}
    every = search.postings(read)
    got = [(r.id, r.gram) for r in every.collect()]
    assert set(got) == want and len(got) == len(want)
    assert every.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > read.rdd.getNumPartitions()
    lists = [(r.gram, r.block, r.n, r.places) for r in index.lists(read, block=5000).collect()]
    assert all(n == len(p) and p == sorted(p) for _, _, n, p in lists) and len({x[:2] for x in lists}) == len(lists)
    assert {(b * 5000 + at, g) for g, b, _, p in lists for at in p} == want


def test_counts_of_grams_shuffle_no_postings(spark):
    cards = some_cards(spark)
    got = search.gram_stats(cards)
    p = [(r.id, r.gram) for r in search.postings(cards).collect()]
    assert tuple(got.first()) == (len({i for i, _ in p}), len({g for _, g in p if len(g) == 2}), len({g for _, g in p if len(g) == 3}))
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
    only = search.postings(cards, ["rin", "ed", "d r", "x", "no "])
    assert sorted((r.id, r.gram) for r in only.collect()) == sorted((i, g) for i, g in p if g in {"rin", "ed", "d r"})
    assert "transform(" not in only._jdf.queryExecution().executedPlan().toString()
