"""Citations that meet on a few keys: the whole result, and no task that has all of it."""

from pyspark.sql import functions as F

from tesserae.operators import graph


def test_citations_of_one_key_are_written_by_all_tasks(spark):
    texts = spark.range(0, 60, 1, 1).selectExpr("id", "if(id % 7 = 0, null, 'law') AS topic", "'see item 3 and item 4, again item 3' AS body")
    nodes = spark.range(0, 300, 1, 1).selectExpr("id", "'law' AS topic", "'item' AS kind", "3L AS number", "0L AS sub")
    nodes = nodes.union(spark.sql("SELECT 5L, 'law', 'item', 3L, 0L UNION ALL SELECT null, 'law', 'item', 3L, 0L UNION ALL SELECT 9L, null, 'item', 4L, 0L UNION ALL SELECT 8L, 'law', null, 4L, 0L"))
    want = sorted((s, d, "item 3") for s in range(60) if s % 7 for d in (*range(300), 5) if s != d)
    for got in (
        graph.cited_forms(texts, nodes, {"item": "item ([0-9]+)"}),
        graph.cited(texts, nodes.where("kind IS NOT NULL"), "item ([0-9]+)"),
    ):
        assert sorted((r.src, r.dst, r.matched) for r in got.collect()) == want
        by_task = [r["count"] for r in got.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
        assert len(by_task) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(by_task) < 0.6 * len(want)


def test_citations_of_one_key_take_little_space(spark, tmp_path):
    texts = spark.range(0, 200, 1, 1).selectExpr("id", "'law' AS topic", "'see item 3' AS body")
    nodes = spark.range(0, 60_000, 1, 1).selectExpr("id * 7919 AS id", "'law' AS topic", "'item' AS kind", "3L AS number", "0L AS sub")
    out = tmp_path / "out"
    graph.cited_forms(texts, nodes, {"item": "item ([0-9]+)"}).write.parquet(str(out))
    rows = spark.read.parquet(str(out))
    by_src = {r.src: (r.n, r.s) for r in rows.groupBy("src").agg(F.count_distinct("dst").alias("n"), F.sum("dst").alias("s")).collect()}
    total = 7919 * sum(range(60_000))
    assert by_src == {i: (60_000, total) if i else (59_999, total) for i in range(200)}  # text 0 doesn't cite itself
    size = sum(p.stat().st_size for p in out.glob("*.parquet"))
    assert size / rows.count() < 0.45, size / rows.count()  # bytes a row
