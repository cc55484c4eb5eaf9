"""Usage events: validation, pseudonyms, storing, statistics, retention. All but storing work on streams as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.text import hashed
from tesserae.functions.values import falsy_or

LONGEST_TARGET = 100
LONGEST_CONTEXT = 500
BATCH = 50


def reject_reason(types: list[str]) -> Column:
    """Why an event isn't taken; null if it is."""
    return (
        F.when(F.col("type").isNull() | ~F.col("type").isin(types), "type")
        .when(F.length("target") > LONGEST_TARGET, "target")
        .when(F.length("context") > LONGEST_CONTEXT, "context")
    )


def accepted(events: DataFrame, types: list[str]) -> DataFrame:
    return events.where(reject_reason(types).isNull())


def unbatched(batches: DataFrame, types: list[str], most: int = BATCH) -> DataFrame:
    """batches: batch, items (array of events). Batches that are empty or too long are refused whole, bad items of others are skipped."""
    sized = batches.where(F.size("items").between(1, most))
    return accepted(sized.select("batch", F.posexplode("items").alias("pos", "x")).select("batch", "pos", "x.*"), types)


def sanitised(events: DataFrame, search_type: str, agent: Column, now: Column) -> DataFrame:
    """Search targets become pseudonyms; empty values become null, a missing time now; the agent is cut to 16 characters."""
    target = F.when((F.col("type") == search_type) & (F.coalesce("target", F.lit("")) != ""), hashed(F.col("target"))).otherwise(F.nullif(F.col("target"), F.lit("")))
    return events.withColumns({"target": target, "ts": F.coalesce("ts", now), "context": falsy_or(F.col("context"), F.lit(None).cast("string")), "agent": F.substr(F.coalesce(agent, F.lit("")), F.lit(1), F.lit(16))})


def since(events: DataFrame, days: int, ref: Column | None = None) -> DataFrame:
    """Events of the last days before ref, else before the latest event: one value, worked out once, then a plain filter."""
    start = F.make_dt_interval(F.lit(days))
    if ref is None:
        ref = events.agg(F.max("ts")).scalar()
    return events.where(F.col("ts") >= ref - start)


def by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("type").agg(F.count("*").alias("n"))


def top_targets(events: DataFrame, kind: str, k: int, keep_null: bool = True) -> DataFrame:
    """The most frequent targets of one type; a null target is a group of its own or left out. Ties by target."""
    rows = events.where(F.col("type") == kind)
    n = (rows if keep_null else rows.where("target IS NOT NULL")).groupBy("target").agg(F.count("*").alias("n"))
    return n.orderBy(F.col("n").desc(), F.col("target").asc_nulls_first()).limit(k)


def bars(counts: DataFrame, least: int = 3) -> DataFrame:
    """rank, and pct: a count's share of the largest, never below `least`. counts: a short list."""
    w = Window.partitionBy("_all")
    pct = F.greatest(F.lit(least), F.floor(100 * F.col("n") / F.max("n").over(w) + 0.5)).cast("int")
    rows = counts.withColumn("_all", F.lit(1))
    return rows.withColumns({"pct": pct, "rank": F.row_number().over(w.orderBy(F.col("n").desc(), "type"))}).drop("_all")


def kept(events: DataFrame, days: int = 90) -> DataFrame:
    """What a rolling retention leaves."""
    return since(events, days)


def debounced(events: DataFrame, key: str, gap: str) -> DataFrame:
    """The last event of each burst: the next one of the key comes after the gap, or never."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    return events.withColumn("_next", F.lead("ts").over(w)).where(F.col("_next").isNull() | (F.col("_next") - F.col("ts") >= F.expr(f"interval {gap}"))).drop("_next")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """key, started, ended (of the last event), n: bursts with no pause of the gap."""
    s = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("ended"))
    return s.select(key, F.col("w.start").alias("started"), "ended", "n")


def windows(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("started"), "type", "n")


def first_over(events: DataFrame, keys: list[str], measure: str, thresholds: list[int]) -> DataFrame:
    """The first event of each key at or over each threshold, once each."""
    over = events.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col(measure) >= t)))
    return over.groupBy(*keys, "threshold").agg(F.min("ts").alias("ts"))


def reached(events: DataFrame, keys: list[str], opens: Column, measure: str, thresholds: list[int]) -> DataFrame:
    """keys, part, threshold, ts: the first event at or over each threshold since the last opening, which forgets what came before it.

    Parts are a running count of openings; what lies before the first one is part 0.
    """
    w = Window.partitionBy(*keys).orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = events.withColumn("part", F.count_if(F.coalesce(opens, F.lit(False))).over(w))
    return first_over(parts, [*keys, "part"], measure, thresholds)


def flushed(events: DataFrame, key: str, most: int, gap: str) -> DataFrame:
    """key, batch, n, first_ts, last_ts: a client's events in batches of at most `most`, cut where nothing came for the gap."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    pause = F.col("ts") - F.lag("ts").over(w) >= F.expr(f"INTERVAL {gap}")
    bursts = events.withColumn("_burst", F.count_if(F.coalesce(pause, F.lit(False))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = bursts.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(key, "_burst").orderBy("ts", "id")) - 1) / most))
    found = placed.groupBy(key, "_burst", "_chunk").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.withColumn("batch", F.row_number().over(Window.partitionBy(key).orderBy("_burst", "_chunk"))).select(key, "batch", "n", "first_ts", "last_ts")


def unanswered(asked: DataFrame, answers: DataFrame, key: str, within: str) -> DataFrame:
    """asked (key, ts, id) without an answer (key, ts) from its time on up to `within` later."""
    b = answers.select(F.col(key).alias("_key"), F.col("ts").alias("_ts"))
    return asked.join(b, F.expr(f"{key} = _key AND _ts >= ts AND _ts <= ts + INTERVAL {within}"), "left_anti")


def active_users(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.countDistinct("user_id").alias("users"))
