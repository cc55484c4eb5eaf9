"""Places over ranges are those of a window, with one group of a third of all rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.operators.ranking import beside, containing, listed, lists_met, places


def test_places(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("k"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    rows = rows.withColumn("k", F.when(F.col("id") % 100 == 1, None).otherwise(F.col("k")))
    order = [F.col("v").desc(), F.col("id")]
    want = {r.id: r.pos for r in rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy(*order))).collect()}
    got = places(rows, ["k"], order, parts=16)
    # a null group is one group here as in a window
    assert {r.id: r.pos for r in got.collect()} == want and got.columns == ["id", "k", "v", "pos"]
    assert {r.id: r.pos for r in places(rows, [], order, parts=8).collect()} == {r.id: r.pos for r in rows.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))).collect()}
    assert places(rows.where("false"), ["k"], order).count() == 0


def test_beside(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 5).cast("string")).alias("k"), F.pmod(F.xxhash64("id"), F.lit(9)).alias("v"))
    order = [F.col("v"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    want = rows.select("id", F.row_number().over(w).alias("place"), F.lag("id").over(w).alias("b"), F.lead("id").over(w).alias("a"))
    got = beside(rows, ["k"], order, ["id"]).select("id", "place", F.col("before_id").alias("b"), F.col("after_id").alias("a"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_containing_within_a_key(spark):
    words = ["", "a", "ab", "abc", "xabcx", "abcd", "000", "a000", "000000", "supplier#0001", "supplier#0002", "0001"]
    hay = spark.createDataFrame([(k, w) for k in "pq" for w in words] + [("p", "only here 77")], "k string, t string")
    needles = spark.createDataFrame([(k, w) for k in "qp" for w in [*words, "77", "zzz"]], "k string, n string")
    got = sorted((r[0], r[1], r[2]) for r in containing(hay, "t", needles, "n", {"k": "k"}).select(hay["k"], "t", "n").collect())
    assert got == sorted((k, t, n) for k, t in [tuple(r) for r in hay.collect()] for n in [*words, "77", "zzz"] if n and n in t)


def test_lists_of_a_hot_key_are_short_and_lose_no_row(spark):
    left = spark.range(0, 5000, 1, 1).selectExpr("if(id % 50 = 0, 'b', 'a') AS k", "if(id = 7, null, id % 2500) AS v").union(spark.sql("SELECT CAST(null AS STRING), 1L"))
    right = spark.range(0, 300, 1, 1).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 'a', 'c')) AS k", "id AS w")
    one, other = listed(left, ["k"], ["v"], "vs", 100), listed(right, ["k"], ["w"], "ws")
    assert max(r[0] for r in one.selectExpr("size(vs)").collect()) == 100
    got = lists_met(one, other, ["k"]).select("k", F.inline("vs"), "ws").select("k", "v", F.inline("ws"))
    want = left.join(right, "k")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and want.count() == 490_000
