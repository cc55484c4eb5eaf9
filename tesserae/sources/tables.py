"""The driver's tables, and the views that bind them to the model of a document catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue cards from parts: id, title, topic, klass, tags, ord, summary, status, effective, load_ord."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("topic"),
        F.col("p_type").alias("klass"),
        F.concat(words, F.array(F.concat(F.lit("grade"), F.floor(F.col("p_size") / 10).cast("string")))).alias("tags"),
        F.col("p_size").alias("ord"),
        F.concat_ws(" ", "p_type", "p_brand").alias("summary"),
        (F.col("p_size") % 10 == 0).alias("obsolete"),
        F.when(F.col("p_size") == 50, "1999").alias("effective"),
        F.col("p_partkey").alias("load_ord"),
    )


#: The same view in DuckDB's SQL.
CARDS = """(SELECT p_partkey AS id, p_name AS title, p_brand AS topic, p_type AS klass,
  list_append(string_split(p_name, ' '), 'grade' || (p_size // 10)) AS tags, p_size AS ord, p_type || ' ' || p_brand AS summary,
  p_size % 10 = 0 AS obsolete, CASE WHEN p_size = 50 THEN '1999' END AS effective, p_partkey AS load_ord FROM part) AS cards"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: id, ts, type, target (from the context), parent, value, context, user_id."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        "ts",
        F.col("event_type").alias("type"),
        F.when(F.get_json_object("props", "$.k") != "13", F.get_json_object("props", "$.k")).alias("target"),
        F.col("props").alias("context"),
        "user_id",
        "value",
    )


EVENTS = """(SELECT event_id AS id, ts, event_type AS type,
  CASE WHEN json_extract_string(props, '$.k') <> '13' THEN json_extract_string(props, '$.k') END AS target,
  props AS context, user_id, value FROM events) AS ev"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges: a part's bucket cites parts that were ordered with it."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") % 500).alias("src"), F.col("l_partkey").alias("dst")).distinct()


CITATIONS = "(SELECT DISTINCT l_orderkey % 500 AS src, l_partkey AS dst FROM lineitem) AS edges"


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, country, city and rate."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("ord"), F.lower("s_name").alias("city"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.col("s_acctbal").alias("rate"))


RATES = """(SELECT s_suppkey AS ord, lower(s_name) AS city, n_name AS country, r_name AS region, s_acctbal AS rate
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) AS rates"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fortieth part is a scenario: rule, topic, category, primary_ids, tags, deprecated, source."""
    p = table(spark, sf_dir, "part").where("p_partkey % 40 = 3")
    words = F.split("p_name", " ")
    return p.select(
        F.col("p_partkey").cast("int").alias("rule"),
        F.col("p_brand").alias("topic"),
        F.get(words, F.lit(0)).alias("category"),
        F.array(F.col("p_partkey") + 1, F.col("p_partkey") * 7, F.lit(999_999_999).cast("long")).alias("primary_ids"),
        F.concat(words, F.array(F.concat(F.lit("grade"), F.floor(F.col("p_size") / 10).cast("string")))).alias("tags"),
        (F.col("p_size") % 7 == 0).alias("deprecated"),
        F.when(F.col("p_size") % 5 == 0, "auto").when(F.col("p_size") % 5 == 1, "hand").alias("source"),
    )


SCENARIOS = """(SELECT p_partkey::INT AS rule, p_brand AS topic, string_split(p_name, ' ')[1] AS category, [p_partkey + 1, p_partkey * 7, 999999999] AS primary_ids,
  list_append(string_split(p_name, ' '), 'grade' || (p_size // 10)) AS tags, p_size % 7 = 0 AS deprecated,
  CASE p_size % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'hand' END AS source FROM part WHERE p_partkey % 40 = 3) AS rules"""


#: Decision flows of thirteen questions each from suppliers: the next question, one further on, one back, a conclusion.
FLOWS = """(WITH s AS (SELECT s_suppkey AS k, 'f' || {div} AS flow, s_suppkey % 13 AS q FROM supplier)
  SELECT flow, 'q' || q AS question, 1 AS opt, CASE WHEN q < 12 THEN 'q' || (q + 1) END AS next, CASE WHEN q = 12 THEN 'c' || k END AS conclude FROM s
  UNION ALL SELECT flow, 'q' || q, 2, 'q' || (q + 2), NULL FROM s WHERE k % 4 = 1
  UNION ALL SELECT flow, 'q' || q, 3, 'q' || {half}, NULL FROM s WHERE k % 3 = 0
  UNION ALL SELECT flow, 'q' || q, 4, NULL, 'c' || (k % 7) FROM s WHERE k % 5 = 0) AS e"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow, question, opt, next, conclude."""
    s = table(spark, sf_dir, "supplier")
    return spark.sql("SELECT * FROM " + FLOWS.format(div="(s_suppkey DIV 13)", half="(q DIV 2)").replace("FROM supplier", "FROM {s}"), s=s)


FLOWS_SQL = FLOWS.format(div="(s_suppkey // 13)", half="(q // 2)")


def flow_conclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow, conclude, redirect: what some flows may conclude, and the flow that goes on from there."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0")
    flow = lambda k: F.concat(F.lit("f"), F.floor(k / 13).cast("string"))
    return s.select(flow(F.col("s_suppkey")).alias("flow"), F.concat(F.lit("c"), (F.col("s_suppkey") % 7).cast("string")).alias("conclude"), F.when(F.col("s_suppkey") % 4 == 0, flow(F.col("s_suppkey") + 13)).alias("redirect")).distinct()


CONCLUSIONS = """(SELECT DISTINCT 'f' || (s_suppkey // 13) AS flow, 'c' || (s_suppkey % 7) AS conclude, CASE WHEN s_suppkey % 4 = 0 THEN 'f' || ((s_suppkey + 13) // 13) END AS redirect
  FROM supplier WHERE s_suppkey % 2 = 0) AS k"""
