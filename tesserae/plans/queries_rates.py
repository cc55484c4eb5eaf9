"""Queries on rates and expense reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import values as vl
from tesserae.operators import rates as rt
from tesserae.operators import report as rp
from tesserae.plans import config as c
from tesserae.plans.registry import query, values
from tesserae.sources.tables import RATES, rates, table

#: Asked for: suppliers' names, whole, cut and odd, nations, and what none has. Aliases: places named after nations, and nations themselves.
ASK = """(SELECT s_name AS query FROM supplier WHERE s_suppkey % 37 = 3 UNION ALL SELECT right(s_name, 8) FROM supplier WHERE s_suppkey % 53 = 7 UNION ALL SELECT ' ' || upper(n_name) FROM nation
  UNION ALL SELECT 'the port of ' || n_name || ' east' FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'nowhere ' || r_name FROM region) AS v"""
ALIAS = """(SELECT n_nationkey AS ord, 'city' AS kind, 'port of ' || lower(n_name) AS key, 'NATION_' || ((n_nationkey * 7 + 1) % 25) AS nation FROM nation WHERE n_nationkey % 2 = 1
  UNION ALL SELECT 100 + n_nationkey, 'land', lower(n_name), 'NATION_' || ((n_nationkey + 3) % 25) FROM nation) AS a"""
BY_ALIAS = f"""(SELECT query, nation, kind, key FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY kind <> 'city', ord) AS rn FROM (SELECT query, lower(trim(query)) AS k FROM {ASK}) q, {ALIAS}
  WHERE key = k OR contains(key, k) OR contains(k, key)) WHERE rn = 1) AS al"""


def derived(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return spark.sql("SELECT * FROM " + re.sub(r"FROM (region|nation|supplier|part)\b", r"FROM {\1}", sql), **{t: table(spark, d, t) for t in ("region", "nation", "supplier", "part")})


@query(f"SELECT * FROM {BY_ALIAS}")
def alias_fallback(spark: SparkSession, d: str) -> DataFrame:
    return rt.by_alias(derived(spark, d, ASK), derived(spark, d, ALIAS))


@query(f"""WITH r AS (SELECT * FROM {RATES}), q AS (SELECT query, lower(trim(query)) AS k FROM {ASK}),
  f AS (SELECT query, 0 AS pri, r.* FROM q JOIN r ON lower(city) = k UNION ALL SELECT query, 1, r.* FROM q JOIN r ON contains(lower(city), k)
    UNION ALL SELECT query, 2, r.* FROM {BY_ALIAS} JOIN r ON contains(lower(country), lower(nation)) AND r.ord % 3 = 1),
  b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pri, ord) AS rn FROM f)
  SELECT q.query, CASE pri WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' WHEN 2 THEN 'alias' ELSE 'none' END AS how, city, country, rate FROM q LEFT JOIN (SELECT * FROM b WHERE rn = 1) b USING (query)""")
def rate_lookup_chain(spark: SparkSession, d: str) -> DataFrame:
    """Every third rate is marked as one of its country's other places; an alias leads to the first of these."""
    return rt.lookup(derived(spark, d, ASK), rates(spark, d), derived(spark, d, ALIAS), F.col("ord") % 3 == 1)


@query(f"SELECT ord, rate, CASE WHEN rate <= 999 AND rate >= 0 THEN '999 and below' WHEN rate BETWEEN 1000 AND 2999 THEN '1,000-2,999' WHEN rate BETWEEN 3000 AND 5999 THEN '3000 – 5999' WHEN rate BETWEEN 6000 AND 7999 THEN '6000~7999' WHEN rate >= 8000 THEN '8,000 and above' END AS tier FROM {RATES}")
def rate_tier_range(spark: SparkSession, d: str) -> DataFrame:
    return rt.in_tier(rates(spark, d), "rate", c.tiers(spark)).select("ord", "rate", "tier")


TIER_LABELS = """(SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' and below') WHEN 1 THEN concat(p_size, ',500-', p_size + 1, ',499') WHEN 2 THEN concat(p_size, ' – ', p_size * 10) WHEN 3 THEN concat(p_size, '~', p_size + 7)
  WHEN 4 THEN concat(p_size, ',000 and above') ELSE p_name END AS label FROM part) AS labels"""


@query("""SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN p_size * 1000 + 500 WHEN 4 THEN p_size * 1000 ELSE p_size END::DOUBLE AS low,
  CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN (p_size + 1) * 1000 + 499 WHEN 2 THEN p_size * 10 WHEN 3 THEN p_size + 7 END::DOUBLE AS high, p_partkey % 6 = 4 AS open FROM part WHERE p_partkey % 6 < 5""")
def tier_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tiers written in five ways, and what is none."""
    open_ = F.col("high") == float("inf")
    return rt.parsed_tiers(derived(spark, d, TIER_LABELS)).select("ord", "low", F.when(~open_, F.col("high")).alias("high"), open_.alias("open"))


SEASON = values([(i, *s) for i, s in enumerate(c.SEASONS)], "s(ord, first, last, pct)")


@query(f"""SELECT o_orderkey, coalesce(pct, 100) AS pct FROM orders LEFT JOIN (SELECT k, min_by(pct, ord) AS pct FROM (SELECT DISTINCT strftime(o_orderdate, '%m-%d') AS k FROM orders), {SEASON}
  WHERE CASE WHEN first <= last THEN k BETWEEN first AND last ELSE k >= first OR k <= last END GROUP BY k) ON k = strftime(o_orderdate, '%m-%d')""")
def rate_seasonal(spark: SparkSession, d: str) -> DataFrame:
    return rt.seasonal(table(spark, d, "orders"), "o_orderdate", c.seasons(spark)).select("o_orderkey", "pct")


PREMIUMS = [(k, n, p * n + 7) for k, p in (("basic", 11), ("wide", 23)) for n in (1, 7, 14, 30, 365)]


@query(f"""WITH a AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'basic' ELSE 'wide' END AS kind, (o_orderkey % 400)::INT AS days, count(*) AS n FROM orders GROUP BY 1, 2)
  SELECT kind, days, n, total, floor(total / days * 100 + 0.5) / 100 AS a_day FROM a LEFT JOIN {values(PREMIUMS, 'p(kind, days, total)')} USING (kind, days) WHERE days BETWEEN 1 AND 365""")
def premium_lookup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, "basic").otherwise("wide").alias("kind"), (F.col("o_orderkey") % 400).cast("int").alias("days"))
    asked_ = o.groupBy("kind", "days").agg(F.count("*").alias("n"))
    return rt.premium(asked_, spark.createDataFrame(PREMIUMS, "kind string, days int, total int"))


@query(f"""SELECT ord, region, in_section, place, greatest(0, in_section - 8) AS beyond FROM (SELECT *, count(*) OVER (PARTITION BY region) AS in_section, row_number() OVER (PARTITION BY region ORDER BY ord)::INT AS place
  FROM {RATES} WHERE contains(lower(city || country), '_1')) WHERE place <= 8""")
def rate_row_search(spark: SparkSession, d: str) -> DataFrame:
    return rt.table_rows(rates(spark, d), "region", "_1", ["city", "country"], ["ord"]).select("ord", "region", "in_section", "place", "beyond")


@query(f"WITH k AS (SELECT * FROM {RATES} WHERE contains(lower(city || country || region), 'asia')) SELECT ord, region, count(*) OVER (PARTITION BY region) AS in_region, (SELECT count(*) FROM k) = 1 AS only FROM k")
def city_options(spark: SparkSession, d: str) -> DataFrame:
    return rt.options(rates(spark, d), "Asia").select("ord", "region", "in_region", "only")


@query(f"SELECT 'section' AS source, region AS part, count(*) AS n FROM {RATES} GROUP BY region UNION ALL SELECT 'flat', c_mktsegment, count(*) FROM customer GROUP BY 2")
def rate_sources(spark: SparkSession, d: str) -> DataFrame:
    a = rates(spark, d).select(F.lit("section").alias("source"), F.col("region").alias("part"))
    b = table(spark, d, "customer").select(F.lit("flat").alias("source"), F.col("c_mktsegment").alias("part"))
    return a.unionByName(b).groupBy("source", "part").agg(F.count("*").alias("n"))


@query(f"SELECT region AS region, country, city AS key, floor(rate + 0.5)::INT AS rate, 1 AS seasons FROM {RATES}")
def rate_tree_flatten(spark: SparkSession, d: str) -> DataFrame:
    """A tree is built a country at a time and flattened again."""
    season = F.array(F.struct(F.lit("12-01").alias("from"), F.lit("01-31").alias("to"), F.lit(1).alias("rate")))
    city = F.struct(F.col("city").alias("key"), F.col("city").alias("name"), F.floor(F.col("rate") + 0.5).cast("int").alias("rate"), season.alias("seasonal"))
    tree = rates(spark, d).groupBy("region", "country").agg(F.collect_list(city).alias("cities")).select("region", F.array(F.struct("country", "cities")).alias("countries"))
    flat, seasons = rt.flattened(tree)
    return flat.join(seasons.groupBy("key").agg(F.count("*").cast("int").alias("seasons")), "key").select("region", "country", "key", "rate", "seasons")


@query("""WITH a AS (SELECT c_custkey, floor(c_acctbal * 80 / 100 * 100 + 0.5) / 100 AS daily FROM customer), b AS (SELECT *, floor(daily * 3 * 100 + 0.5) / 100 AS total FROM a)
  SELECT c_custkey, daily, total, floor(total * 31.5 + 0.5)::BIGINT AS local FROM b""")
def allowance_formula(spark: SparkSession, d: str) -> DataFrame:
    daily, total, local = rt.allowance(F.col("c_acctbal"), F.lit(3), F.lit(80), F.lit(31.5))
    return table(spark, d, "customer").select("c_custkey", daily.alias("daily"), total.alias("total"), local.cast("long").alias("local"))


TRIPS = "(SELECT o_orderkey AS trip, o_orderdate::DATE AS first, (o_orderdate + to_days((o_orderkey % 17 - 1)::INT))::DATE AS last FROM orders) AS trips"


def trips(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    first = F.to_date("o_orderdate")
    return o.select(F.col("o_orderkey").alias("trip"), first.alias("first"), F.date_add(first, (F.col("o_orderkey") % 17 - 1).cast("int")).alias("last"))


SPINE = f"(SELECT trip, (first + k::INT) AS day, (k + 1)::INT AS pos, first + k::INT = last AS return_day FROM {TRIPS}, range(16) r(k) WHERE first + k::INT <= last) AS sp"


@query(f"SELECT * FROM {SPINE}")
def trip_spine(spark: SparkSession, d: str) -> DataFrame:
    return rp.spine(trips(spark, d))


@query("""SELECT o_orderkey AS trip, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 17 END::INT AS days FROM orders""")
def trip_days(spark: SparkSession, d: str) -> DataFrame:
    return trips(spark, d).select("trip", vl.trip_days(F.col("first"), F.col("last")).cast("int").alias("days"))


@query(f"SELECT trip, day, pos, l_quantity AS quantity FROM {SPINE} LEFT JOIN (SELECT l_orderkey AS trip, l_linenumber AS pos, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) USING (trip, pos)")
def trip_carried_over(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("pos")).agg(F.max("l_quantity").alias("quantity"))
    return rp.carried_over(rp.spine(trips(spark, d)), old).select("trip", "day", "pos", "quantity")


FEE = "greatest(0.0::DOUBLE, CASE WHEN lodged THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END - CASE WHEN b THEN 0.04::DOUBLE ELSE 0 END - CASE WHEN l THEN 0.08::DOUBLE ELSE 0 END - CASE WHEN di THEN 0.08::DOUBLE ELSE 0 END)"


@query(f"""WITH x AS (SELECT trip, pos, 299.0::DOUBLE + trip % 50 AS rate, 31.5::DOUBLE AS fx, return_day OR (trip + pos) % 5 = 0 AS lodged, (trip + pos) % 2 = 0 AS b, (trip + pos) % 3 = 0 AS l, trip % 4 = 0 AS di, trip % 11 = 0 AS locked FROM {SPINE})
  SELECT trip, pos, lodged, CASE WHEN locked THEN 1234 ELSE floor(floor(rate * fx * (floor({FEE} * 10000 + 0.5) / 10000) * 10000 + 0.5) / 10000 + 0.5)::BIGINT END AS fee FROM x""")
def living_fee(spark: SparkSession, d: str) -> DataFrame:
    mod = lambda n: (F.col("trip") + F.col("pos")) % n == 0
    days = rp.spine(trips(spark, d)).withColumns({"rate": F.lit(299.0) + F.col("trip") % 50, "fx": F.lit(31.5), "special": F.lit(None).cast("string"), "lodged": mod(5), "breakfast": mod(2), "lunch": mod(3), "dinner": F.col("trip") % 4 == 0, "locked": F.col("trip") % 11 == 0, "manual": F.lit(1234).cast("long")})
    return rp.fees(rp.flags(days)).select("trip", "pos", "lodged", "fee")


LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag"
ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
PAGED = f"(SELECT *, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) - 1) // 7 + 1)::INT AS page, ceil(count(*) OVER (PARTITION BY l_orderkey) / 7)::INT AS pages FROM lineitem) AS pg"


def paged(spark: SparkSession, d: str) -> DataFrame:
    return rp.paged(table(spark, d, "lineitem"), "l_orderkey", [F.col(x) for x in ORDER.split(", ")])


@query(f"SELECT l_orderkey, page, pages, count(*) AS n, min(l_partkey) AS low FROM {PAGED} GROUP BY 1, 2, 3")
def report_pages(spark: SparkSession, d: str) -> DataFrame:
    return paged(spark, d).groupBy("l_orderkey", "page", "pages").agg(F.count("*").alias("n"), F.min("l_partkey").alias("low"))


@query(f"SELECT l_orderkey, page, sum(round(l_quantity)::BIGINT)::BIGINT AS quantity, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents, (sum(round(l_quantity)::BIGINT) + sum(round(l_extendedprice * 100)::BIGINT))::BIGINT AS together FROM {PAGED} GROUP BY GROUPING SETS ((l_orderkey, page), (l_orderkey))")
def report_rollup(spark: SparkSession, d: str) -> DataFrame:
    rows = paged(spark, d).withColumns({"quantity": F.round("l_quantity").cast("long"), "cents": F.round(F.col("l_extendedprice") * 100).cast("long")})
    return rp.totals(rows, "l_orderkey", ["quantity", "cents"])


@query("SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1")
def report_any_flag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"))


@query("""SELECT o_orderkey, (year(o_orderdate) - 1911) || '.' || strftime(o_orderdate, '%m.%d') AS roc, CASE WHEN o_orderkey % 2 = 0 THEN 'not a date' ELSE (year(o_orderdate) - 1911) || '.' || strftime(o_orderdate, '%m.%d') END AS mixed, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS dd FROM orders""")
def offset_year_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    mixed = F.when(F.col("o_orderkey") % 2 == 0, "not a date").otherwise(text)
    return o.select("o_orderkey", vl.offset_year_date(text).alias("roc"), vl.offset_year_date(mixed).alias("mixed"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd"))


@query("""SELECT c_custkey, CASE WHEN round(c_acctbal)::BIGINT = 0 THEN '' ELSE format('{:,}', round(c_acctbal)::BIGINT) END AS shown, CASE c_custkey % 3 WHEN 0 THEN 1234.5 WHEN 1 THEN 0 ELSE c_custkey END::DOUBLE AS parsed FROM customer""")
def number_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("c_custkey") % 3 == 0, " 1,234.5").when(F.col("c_custkey") % 3 == 1, "n/a").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", vl.thousands(F.round("c_acctbal").cast("long")).alias("shown"), vl.number(text).alias("parsed"))


@query("""WITH n AS (SELECT c_custkey, floor(c_acctbal * 100 * (1 + c_custkey % 3 * 1000) + 0.5)::BIGINT * CASE WHEN c_custkey % 11 = 0 THEN 100000000 ELSE 1 END AS n FROM customer), d AS (SELECT *, string_split(abs(n)::VARCHAR, '') AS ds FROM n),
  w AS (SELECT *, array_to_string(list_transform(range(1, len(ds) + 1), lambda i: translate(ds[i], '0123456789', '零壹貳參肆伍陸柒捌玖') || CASE WHEN ds[i] = '0' THEN '' ELSE ['', '拾', '佰', '仟'][(len(ds) - i) % 4 + 1] END
    || CASE WHEN (len(ds) - i) % 4 = 0 THEN ['', '萬', '億', '兆', '京'][(len(ds) - i) // 4 + 1] ELSE '' END), '') AS t FROM d)
  SELECT c_custkey, CASE WHEN n = 0 THEN '零' ELSE CASE WHEN n < 0 THEN '負' ELSE '' END || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '零+', '零', 'g'), '零([萬億兆京])', '\\1', 'g'), '([萬億兆京])[萬億兆京]+', '\\1零', 'g'), '零+', '零', 'g'), '零$', '') END AS words FROM w""")
def formal_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Amounts in words; tests/test_functions.py holds them against a plain reading too."""
    n = F.floor(F.col("c_acctbal") * 100 * (1 + F.col("c_custkey") % 3 * 1000) + 0.5) * F.when(F.col("c_custkey") % 11 == 0, 100_000_000).otherwise(1)
    return table(spark, d, "customer").select("c_custkey", vl.formal_amounts(n).alias("words"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'name' END, CASE WHEN c_custkey % 5 = 0 THEN 'order' END, CASE WHEN c_acctbal IS NULL OR NOT c_acctbal BETWEEN 20 AND 50 THEN 'rate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer""")
def report_validation(spark: SparkSession, d: str) -> DataFrame:
    key, day = F.col("c_custkey"), F.lit("2024-03-01").cast("date")
    heads = table(spark, d, "customer").select("c_custkey", F.when(key % 4 == 0, " ").otherwise(F.col("c_name")).alias("name"), day.alias("first"), F.when(key % 5 == 0, F.date_sub(day, 1)).otherwise(day).alias("last"), F.col("c_acctbal").alias("fx"))
    return rp.faults(heads).select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


ITEMS = [("ticket", None, "", "attach"), ("boarding pass", "abroad", "original", "copy"), ("receipt", None, "", "attach")]


@query("SELECT c_custkey, pos, item, flagged, CASE WHEN flagged THEN 'original' WHEN item = 'boarding pass' THEN 'copy' ELSE 'attach' END AS note FROM (SELECT c_custkey, pos, item, item = 'boarding pass' AND c_custkey % 2 = 0 AS flagged FROM customer, (VALUES (0, 'ticket'), (1, 'boarding pass'), (2, 'receipt')) i(pos, item))")
def report_checklist(spark: SparkSession, d: str) -> DataFrame:
    heads = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("abroad"))
    return rp.checklist(heads, ITEMS).select("c_custkey", "pos", "item", "flagged", "note")


@query(f"SELECT trip, count(*) AS n, (count(*) * floor(299.0::DOUBLE * 31.5 + 0.5))::BIGINT AS fees FROM {SPINE} GROUP BY trip")
def report_batch_apply(spark: SparkSession, d: str) -> DataFrame:
    """No day lodged and no meal supplied: every day's fee is the whole rate."""
    days = rp.spine(trips(spark, d)).withColumns({"rate": F.lit(299.0), "fx": F.lit(31.5), "locked": F.lit(False), "manual": F.lit(0).cast("long")})
    done = rp.applied(days, lodged=False, breakfast=False, lunch=False, dinner=False)
    return done.groupBy("trip").agg(F.count("*").alias("n"), F.sum("fee").alias("fees"))


@query("""SELECT o_orderkey AS row, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey ELSE 'home' END AS city, CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus ELSE coalesce(c_name, '') END AS place
  FROM orders LEFT JOIN customer ON c_custkey = CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END""")
def city_default(spark: SparkSession, d: str) -> DataFrame:
    """A day's city is its own, else the trip's; its place is what was entered, else the city's name."""
    o = table(spark, d, "orders")
    days = o.select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).otherwise("").alias("city"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderstatus")).otherwise("").alias("place"))
    names = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("city"), F.col("c_name").alias("name"))
    return rp.placed(days, F.lit("home"), names).select("row", "city", "place")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice = 0 OR l_quantity % 7 = 0 OR l_partkey = 0 OR l_suppkey = 0 THEN '' ELSE '$' || l_partkey || '×' || l_suppkey || '×' ||
    CASE WHEN m > 0 THEN '(' || b || '%-' || m || '%)=' || greatest(0, b - m) || '%' ELSE greatest(0, b - m) || '%' END END AS note
  FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 30 ELSE 100 END AS b, CASE WHEN l_returnflag = 'A' THEN 4 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 8 ELSE 0 END + CASE WHEN l_linenumber % 3 = 0 THEN 8 ELSE 0 END AS m FROM lineitem)""")
def fee_note(spark: SparkSession, d: str) -> DataFrame:
    """How a fee came about, as text; empty without a rate or an exchange rate."""
    rows = table(spark, d, "lineitem")
    rate = F.when((F.col("l_extendedprice") != 0) & (F.col("l_quantity") % 7 != 0), F.col("l_partkey"))
    note = rp.fee_note(rate, F.col("l_suppkey"), F.col("l_linestatus") == "O", F.col("l_returnflag") == "A", F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") % 3 == 0)
    return rows.select("l_orderkey", "l_linenumber", note.alias("note"))
