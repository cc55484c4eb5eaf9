"""Expense reports: a spine of days, fees, locks, pages, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.values import living_fee

PAGE = 7


def spine(trips: DataFrame) -> DataFrame:
    """trips: trip, first, last. A row a day, both ends counted; the last day is marked. A reversed trip has no days."""
    days = trips.where("last >= first").select("trip", "last", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    at = F.row_number().over(Window.partitionBy("trip").orderBy("day"))
    return days.select("trip", "day", at.alias("pos"), (F.col("day") == F.col("last")).alias("return_day"))


def carried_over(spine_: DataFrame, old: DataFrame) -> DataFrame:
    """A new spine meets the old rows by place, not by date. old: trip, pos and more."""
    return spine_.join(old, ["trip", "pos"], "left")


def flags(days: DataFrame) -> DataFrame:
    """days: return_day, special, lodged. A return day and a night in flight count as lodged; without lodging the special mark goes."""
    lodged = F.coalesce("lodged", F.lit(False)) | F.coalesce("return_day", F.lit(False)) | F.coalesce(F.col("special") == "flight", F.lit(False))
    return days.withColumn("lodged", lodged).withColumn("special", F.when(F.col("lodged"), F.col("special")))


def fees(days: DataFrame) -> DataFrame:
    """days: rate, fx, lodged, breakfast, lunch, dinner, locked, manual. A locked value wins over the computed one."""
    computed = living_fee(F.col("rate"), F.col("fx"), F.col("lodged"), F.col("breakfast"), F.col("lunch"), F.col("dinner"))
    return days.withColumn("fee", F.when(F.coalesce("locked", F.lit(False)), F.col("manual")).otherwise(computed))


def paged(rows: DataFrame, key: str, order: list, size: int = PAGE) -> DataFrame:
    """page from 1 and pages, each of `size` rows."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumns({"page": (F.floor(at / size) + 1).cast("int"), "pages": F.greatest(F.lit(1), F.ceil(F.count("*").over(w) / size)).cast("int")})


def totals(rows: DataFrame, key: str, money: list[str]) -> DataFrame:
    """Sub-totals a page and the grand total (page null) of a report, a column a kind of money, and all kinds together."""
    sums = rows.rollup(key, "page").agg(*[F.sum(m).alias(m) for m in money]).where(F.col(key).isNotNull())
    return sums.withColumn("together", sum((F.col(m) for m in money[1:]), F.col(money[0])))


def faults(headers: DataFrame) -> DataFrame:
    """headers: name, first, last, fx. Adds reasons: what is missing or out of range; empty if it may be submitted."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    rules = [(blank("name"), "name"), (F.col("first").isNull(), "first"), (F.col("last").isNull(), "last"), (F.coalesce(F.col("last") < F.col("first"), F.lit(False)), "order"), (~F.coalesce(F.col("fx").between(20, 50), F.lit(False)), "rate")]
    return headers.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, F.lit(n)) for bad, n in rules])))


def checklist(headers: DataFrame, items: list[tuple[str, str | None, str, str]]) -> DataFrame:
    """items: item, flag or None, note if the flag is set, note if not. A row an item a report."""
    listed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("item"), (F.col(f) if f else F.lit(False)).alias("flagged"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (n, f, a, b) in enumerate(items)])
    rows = headers.withColumn("_x", F.explode(listed))
    return rows.withColumns({"pos": F.col("_x.pos"), "item": F.col("_x.item"), "flagged": F.col("_x.flagged"), "note": F.when(F.col("_x.flagged"), F.col("_x.a")).otherwise(F.col("_x.b"))}).drop("_x")


def applied(days: DataFrame, **values: object) -> DataFrame:
    """One value for a field of all days; the fees are computed anew."""
    return fees(days.withColumns({k: F.lit(v) for k, v in values.items()}))


def placed(days: DataFrame, default: Column, names: DataFrame) -> DataFrame:
    """days: city, place. A blank city is the trip's default; a blank place is the city's name (names: city, name), if it has one."""
    own = days.withColumn("city", F.coalesce(F.nullif(F.col("city"), F.lit("")), default))
    return own.join(names, "city", "left").withColumn("place", F.coalesce(F.nullif(F.col("place"), F.lit("")), "name", F.lit(""))).drop("name")


def fee_note(rate: Column, fx: Column, lodged: Column, breakfast: Column, lunch: Column, dinner: Column) -> Column:
    """The fee's formula as text: rate, exchange rate, and the share that lodging and meals leave; empty without either rate."""
    base = F.when(F.coalesce(lodged, F.lit(False)), 30).otherwise(100)
    meals = sum((F.when(F.coalesce(m, F.lit(False)), share).otherwise(0) for m, share in ((breakfast, 4), (lunch, 8), (dinner, 8))), F.lit(0))
    text = lambda c: c.cast("string")
    left = F.concat(text(F.greatest(F.lit(0), base - meals)), F.lit("%"))
    share = F.when(meals > 0, F.concat(F.lit("("), text(base), F.lit("%-"), text(meals), F.lit("%)="), left)).otherwise(left)
    known = (F.coalesce(rate, F.lit(0)) != 0) & (F.coalesce(fx, F.lit(0)) != 0)
    return F.when(known, F.concat(F.lit("$"), text(rate), F.lit("×"), text(fx), F.lit("×"), share)).otherwise("")
