"""Rates: lookup with fallbacks, aliases, seasons, tiers, premiums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import has, norm
from tesserae.functions.values import half_up, in_season, tier_bounds
from tesserae.operators.ranking import containing


def first_of(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def by_alias(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """query, nation, kind, key: the first alias that equals, contains or lies in the query; cities before lands."""
    q = queries.select("query", norm(F.col("query")).alias("_q")).where("_q <> ''").distinct()
    k = aliases.withColumn("_k", F.lower("key"))
    met = containing(k, "_k", q, "_q").unionByName(containing(q, "_q", k, "_k").select(*k.columns, *q.columns))
    return first_of(met, "query", [F.when(F.col("kind") == "city", 0).otherwise(1), F.col("ord")]).select("query", "nation", "kind", "key")


def lookup(queries: DataFrame, rates: DataFrame, aliases: DataFrame, other: Column | None = None) -> DataFrame:
    """query, how (exact, partial, alias, none), city, country, rate: one row a query.

    Exact hits meet by equality, partial ones by substring, aliases through the rate row of the country that is marked as its other places
    (other: a condition on rates); countries meet if the row's country contains the alias's. Of several rows the first by ord counts.
    """
    q = queries.select("query", norm(F.col("query")).alias("_q")).distinct()
    cols = ["city", "country", "rate", "ord"]
    low = rates.select(*cols, F.lower("city").alias("_city"))
    exact = low.join(q, F.col("_city") == F.col("_q")).select("query", F.lit(0).alias("pri"), F.lit("exact").alias("how"), *cols)
    partial = containing(low, "_city", q, "_q").select("query", F.lit(1).alias("pri"), F.lit("partial").alias("how"), *cols)
    marked = (rates if other is None else rates.where(other)).select(*cols, F.lower("country").alias("_land"))
    marked = marked.groupBy("_land").agg(F.min_by(F.struct(*cols), "ord").alias("x")).select("x.*", "_land")
    wanted = by_alias(queries, aliases).withColumn("_nation", F.lower("nation"))
    aliased = containing(marked, "_land", wanted, "_nation").select("query", F.lit(2).alias("pri"), F.lit("alias").alias("how"), *cols)
    best = exact.unionByName(partial).unionByName(aliased).groupBy("query").agg(F.min_by(F.struct("how", *cols), F.struct("pri", "ord")).alias("x"))
    return q.select("query").join(best, "query", "left").select("query", F.coalesce("x.how", F.lit("none")).alias("how"), "x.city", "x.country", "x.rate")


def seasonal(rows: DataFrame, day: str, seasons: DataFrame) -> DataFrame:
    """rows with pct: the first season that holds the day, else 100. Ranges may go over the year's end.

    A day of the year is one of 366, so the seasons are resolved for those, and rows meet them by equality.
    """
    spark = rows.sparkSession
    days = spark.range(366).select(F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")), "MM-dd").alias("_md"))
    met = days.join(seasons, in_season(F.col("_md"), F.col("first"), F.col("last")))
    found = met.groupBy("_md").agg(F.min_by("pct", "ord").alias("pct"))
    return rows.withColumn("_md", F.date_format(day, "MM-dd")).join(F.broadcast(found), "_md", "left").withColumn("pct", F.coalesce("pct", F.lit(100))).drop("_md")


def parsed_tiers(tiers: DataFrame) -> DataFrame:
    """ord, label, low, high; labels that can't be read drop out."""
    low, high = tier_bounds(F.col("label"))
    return tiers.select("ord", "label", low.alias("low"), high.alias("high")).where("low IS NOT NULL")


def in_tier(rows: DataFrame, value: str, tiers: DataFrame) -> DataFrame:
    """rows with the first tier that holds the value, both bounds counted; null if none does. The tiers are a short configured list."""
    t = F.array_sort(F.collect_list(F.struct("ord", "label", "low", "high")))
    listed = parsed_tiers(tiers).agg(t.alias("_tiers")).scalar()  # one value, worked out once
    fits = F.filter("_tiers", lambda x: (F.col(value) >= x["low"]) & (F.col(value) <= x["high"]))
    return rows.withColumn("_tiers", listed).withColumn("tier", F.get(fits, F.lit(0))["label"]).drop("_tiers")


def allowance(rate: Column, days: Column, pct: Column, fx: Column) -> tuple[Column, Column, Column]:
    """The day's amount, the total, and the total in local money."""
    daily = half_up(rate * pct / 100, 2)
    total = half_up(daily * days, 2)
    return daily, total, half_up(total * fx)


def premium(asked: DataFrame, table: DataFrame) -> DataFrame:
    """asked: kind, days. table: kind, days, total. The total and its share a day; days outside 1 to 365 give nulls."""
    met = asked.where("days BETWEEN 1 AND 365").join(table, ["kind", "days"], "left")
    return met.withColumn("a_day", half_up(F.col("total") / F.col("days"), 2))


def table_rows(rows: DataFrame, section: str, term: str, cells: list[str], order: list[str], preview: int = 8) -> DataFrame:
    """Rows whose cells together hold the term; a section without any is hidden. Each row has its section's count, and how many lie
    beyond the preview. Only `preview` rows a section and task are dealt out, and counts."""
    kept = rows.where(has(F.concat_ws("", *[F.col(c).cast("string") for c in cells]), term.lower()))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy(section).orderBy(*order))).where(F.col("place") <= preview)
    counts = kept.groupBy(F.col(section).alias("_section")).agg(F.count("*").alias("in_section"))
    met = first.join(counts, F.col(section).eqNullSafe(F.col("_section"))).drop("_section")
    return met.withColumn("beyond", F.greatest(F.lit(0), F.col("in_section") - preview))


def options(rates: DataFrame, query: str) -> DataFrame:
    """Cities whose city, country and region hold the query, with the region's header count, and whether only one is left."""
    kept = rates.where(has(F.concat("city", "country", "region"), query.lower()))
    counts = kept.groupBy(F.col("region").alias("_region")).agg(F.count("*").alias("in_region"))
    total = counts.agg(F.sum("in_region").alias("of")).scalar()
    return kept.join(counts, F.col("region").eqNullSafe(F.col("_region"))).drop("_region").withColumn("only", total == 1)


def flattened(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rate tree (region, countries: array of country and cities) as rates and seasons."""
    country = tree.select("region", F.explode("countries").alias("c"))
    city = country.select("region", "c.country", F.explode("c.cities").alias("x"))
    rates = city.select("region", "country", "x.key", "x.name", "x.rate")
    seasons = city.select("x.key", F.posexplode("x.seasonal").alias("ord", "s")).select("key", "ord", F.col("s.from").alias("first"), F.col("s.to").alias("last"), F.col("s.rate").alias("rate"))
    return rates, seasons
