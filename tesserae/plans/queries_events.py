"""Queries on usage events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import hashed
from tesserae.operators import events as ev
from tesserae.plans import config as c
from tesserae.plans.registry import query
from tesserae.sources.tables import EVENTS, events, table
from tesserae.streaming import events as streams
from tesserae.streaming import keyed

TYPES = ", ".join(f"'{t}'" for t in c.EVENT_TYPES)
WEEK = f"(SELECT * FROM {EVENTS} WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events)) AS w"


@query(f"SELECT type, count(*) AS n FROM {WEEK} GROUP BY type")
def event_counts_7d(spark: SparkSession, d: str) -> DataFrame:
    return ev.by_type(ev.since(events(spark, d), 7))


@query(f"SELECT target, count(*) AS n FROM {WEEK} WHERE type = 'click' GROUP BY target ORDER BY n DESC, target NULLS FIRST LIMIT 20")
def top_targets(spark: SparkSession, d: str) -> DataFrame:
    return ev.top_targets(ev.since(events(spark, d), 7), "click", 20)


@query(f"SELECT target, count(*) AS n FROM {WEEK} WHERE type = 'view' GROUP BY target ORDER BY n DESC, target NULLS FIRST LIMIT 30")
def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return ev.top_targets(ev.since(events(spark, d), 7), "view", 30)


@query(f"SELECT substr(sha256(lower(trim(target))), 1, 16) AS target, count(*) AS n FROM {WEEK} WHERE type = 'signup' AND target IS NOT NULL GROUP BY 1 ORDER BY n DESC, target LIMIT 20")
def top_hashed(spark: SparkSession, d: str) -> DataFrame:
    rows = ev.since(events(spark, d), 7).withColumn("target", hashed(F.col("target")))
    return ev.top_targets(rows, "signup", 20, keep_null=False)


LONG = f"(SELECT id, ts, type, user_id, value, repeat(target, (id % 90)::INT) AS target, repeat(context, (id % 80)::INT) AS context FROM {EVENTS}) AS ev"


@query(f"SELECT CASE WHEN type NOT IN ({TYPES}) THEN 'type' WHEN length(target) > 100 THEN 'target' WHEN length(context) > 500 THEN 'context' END AS reason, count(*) AS n FROM {LONG} GROUP BY 1")
def event_reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Targets and contexts are repeated up to 89 and 79 times, so that every limit is met."""
    rows = events(spark, d).withColumns({"target": F.repeat("target", (F.col("id") % 90).cast("int")), "context": F.repeat("context", (F.col("id") % 80).cast("int"))})
    return rows.groupBy(ev.reject_reason(c.EVENT_TYPES).alias("reason")).agg(F.count("*").alias("n"))


BATCH = "CASE id % 4 WHEN 0 THEN 'a' || user_id WHEN 1 THEN 'b' || (user_id % 40) ELSE 'c' || user_id END"


@query(f"""WITH b AS (SELECT *, {BATCH} AS batch FROM {EVENTS}) SELECT batch, count(*) AS n, round(sum(value), 6) AS total FROM b
  WHERE batch IN (SELECT batch FROM b GROUP BY batch HAVING count(*) BETWEEN 1 AND 50) AND type IN ({TYPES}) GROUP BY batch""")
def event_batch_guard(spark: SparkSession, d: str) -> DataFrame:
    """Requests of some twenty to seventy events; the arrays exist only for those within the guard's reach, as a batch is one request."""
    rows = events(spark, d).withColumn("batch", F.expr(BATCH))
    sized = rows.groupBy("batch").agg(F.count("*").alias("_n")).where("_n <= 50")
    batches = rows.join(sized, "batch").groupBy("batch").agg(F.collect_list(F.struct("id", "type", "target", "context", "value")).alias("items"))
    return ev.unbatched(batches, c.EVENT_TYPES).groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"""SELECT id, type, CASE WHEN type = 'signup' AND target IS NOT NULL THEN substr(sha256(target), 1, 16) ELSE target END AS target, substr('user ' || user_id || ' of the table', 1, 16) AS agent, context
  FROM {EVENTS} WHERE type IN ({TYPES})""")
def event_ingest(spark: SparkSession, d: str) -> DataFrame:
    agent = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" of the table"))
    rows = ev.sanitised(ev.accepted(events(spark, d), c.EVENT_TYPES), "signup", agent, F.lit("2024-01-01").cast("timestamp_ntz"))
    return rows.select("id", "type", "target", "agent", "context")


@query("SELECT count(*) AS n, min(ts) AS first_ts FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events)")
def event_retention(spark: SparkSession, d: str) -> DataFrame:
    return ev.kept(events(spark, d), 10).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"))


@query(f"""WITH n AS (SELECT type, count(*) AS n FROM {EVENTS} GROUP BY type)
  SELECT type, n, greatest(3, floor(100 * n / (SELECT max(n) FROM n) + 0.5))::INT AS pct, row_number() OVER (ORDER BY n DESC, type)::INT AS rank FROM n""")
def event_bar_pct(spark: SparkSession, d: str) -> DataFrame:
    return ev.bars(ev.by_type(events(spark, d)))


@query("""WITH e AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS no FROM e)
  SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, no""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return ev.sessions(events(spark, d), "user_id", "6 hours")


@query("""SELECT event_id AS id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts >= INTERVAL 1 HOUR""")
def event_debounce(spark: SparkSession, d: str) -> DataFrame:
    return ev.debounced(events(spark, d), "user_id", "1 hour").select("id", "user_id", "ts")


DAILY = "SELECT date_trunc('day', ts)::TIMESTAMP AS started, event_type AS type, count(*) AS n FROM events GROUP BY 1, 2"


@query(DAILY)
def event_daily_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return ev.windows(events(spark, d), "1 day")


@query("""SELECT (date_trunc('day', ts) - to_days(k::INT))::TIMESTAMP AS started, event_type AS type, count(*) AS n FROM events, range(7) r(k) GROUP BY 1, 2""")
def event_sliding_7d(spark: SparkSession, d: str) -> DataFrame:
    return ev.windows(events(spark, d), "7 days", "1 day")


@query("SELECT user_id, threshold, min(ts) AS ts FROM events, (VALUES (25), (50), (75), (100)) t(threshold) WHERE value >= threshold GROUP BY 1, 2")
def event_once_per_threshold(spark: SparkSession, d: str) -> DataFrame:
    return ev.first_over(events(spark, d), ["user_id"], "value", [25, 50, 75, 100])


@query(f"SELECT target, count(*) AS n FROM {EVENTS} WHERE type = 'view' AND length(target) >= 2 AND NOT EXISTS (SELECT 1 FROM part WHERE p_size::VARCHAR = target) GROUP BY target")
def event_zero_result(spark: SparkSession, d: str) -> DataFrame:
    """Searches that no card answers: targets of two characters or more that are no card's ordinal."""
    known = table(spark, d, "part").select(F.col("p_size").cast("string").alias("target")).distinct()
    asked = events(spark, d).where("type = 'view' AND length(target) >= 2")
    return asked.join(known, "target", "left_anti").groupBy("target").agg(F.count("*").alias("n"))


@query("SELECT ts::DATE AS day, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def event_active_users(spark: SparkSession, d: str) -> DataFrame:
    return ev.active_users(events(spark, d))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    rows = streams.stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return rows.select(F.col("event_id").alias("id"), "ts", F.col("event_type").alias("type"), "user_id", "value", F.get_json_object("props", "$.k").alias("target"), F.col("props").alias("context"))


@query(DAILY)
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """The daily counts from a stream that runs to its end; complete output, so the last days are given out as well."""
    return streams.run_to_end(ev.windows(_stream(spark, d), "1 day"), spark, "stream-daily", "complete")


@query("SELECT event_id AS id, event_type AS type FROM events WHERE event_type IN (" + TYPES + ")")
def stream_accepted(spark: SparkSession, d: str) -> DataFrame:
    return streams.run_to_end(ev.accepted(_stream(spark, d), c.EVENT_TYPES).select("id", "type"), spark, "stream-accepted")


@query("SELECT DISTINCT user_id, event_type AS type FROM events")
def stream_once_each(spark: SparkSession, d: str) -> DataFrame:
    """One event a user and type within a watermark longer than the table."""
    return streams.run_to_end(streams.once_each(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), ["user_id", "type"], "90 days").select("user_id", "type"), spark, "stream-once")


#: What a stream has given out at its end: the watermark stands a day before the last event, in whole milliseconds.
PASSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events)"
FLUSHED = """(WITH g AS (SELECT user_id, ts, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 3 HOUR, false) AS pause FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  b AS (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g),
  k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, burst ORDER BY ts, event_id) - 1) // 10 AS chunk FROM b),
  f AS (SELECT user_id, burst, chunk, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM k GROUP BY ALL)
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY burst, chunk)::BIGINT AS batch, n, first_ts, last_ts FROM f) AS flushed"""


@query(f"SELECT * FROM {FLUSHED}")
def event_flush(spark: SparkSession, d: str) -> DataFrame:
    """Batches of at most ten events of a user, cut where nothing came for three hours."""
    rows = events(spark, d)
    return ev.flushed(rows, "user_id", 10, "3 HOURS").withColumn("batch", F.col("batch").cast("long"))


@query(f"SELECT user_id, batch, n::INT AS n, first_ts, last_ts, CASE n WHEN 10 THEN 'size' ELSE 'gap' END AS why FROM {FLUSHED} WHERE n = 10 AND last_ts <= {PASSED} OR last_ts + INTERVAL 3 HOUR <= {PASSED}")
def stream_flush(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream: what a full buffer or a timer has sent when the stream ends."""
    out = keyed.flushed(_timed(spark, d), "user_id", 10, 3 * 3600, "1 day")
    return streams.run_to_end(out, spark, "stream-flush").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


REACHED = """(SELECT user_id, part, threshold, min(ts) AS ts FROM (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM events),
  (VALUES (25), (50), (75), (100)) t(threshold) WHERE value >= threshold GROUP BY user_id, part, threshold) AS reached"""


@query(f"SELECT * FROM {REACHED}")
def event_threshold_reset(spark: SparkSession, d: str) -> DataFrame:
    """Thresholds once each, and again after the user has signed up anew."""
    return ev.reached(events(spark, d), ["user_id"], F.col("type") == "signup", "value", [25, 50, 75, 100])


@query(f"SELECT user_id, part, threshold, ts FROM {REACHED} WHERE ts <= {PASSED}")
def stream_threshold_reset(spark: SparkSession, d: str) -> DataFrame:
    out = keyed.reached(_timed(spark, d), "user_id", F.col("type") == "signup", [25, 50, 75, 100], "1 day")
    return streams.run_to_end(out, spark, "stream-thresholds").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


#: The same for two streams: the slower one counts.
BOTH_PASSED = "(SELECT date_trunc('millisecond', min(ts)) - INTERVAL 1 DAY FROM (SELECT max(ts) AS ts FROM events WHERE event_type IN ('view', 'click') GROUP BY event_type))"
UNANSWERED = "FROM events a WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'click' AND b.user_id = a.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOUR)"


@query(f"SELECT user_id, ts, event_id AS id {UNANSWERED}")
def event_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """Views that no click of the same user follows within twelve hours."""
    rows = events(spark, d)
    return ev.unanswered(rows.where("type = 'view'").select("user_id", "ts", "id"), rows.where("type = 'click'"), "user_id", "12 HOURS")


@query(f"SELECT user_id, ts, event_id AS id {UNANSWERED} AND ts + INTERVAL 12 HOUR <= {BOTH_PASSED}")
def stream_unanswered(spark: SparkSession, d: str) -> DataFrame:
    """The same by an outer join of two streams, for the views whose time is over when they end."""
    rows = _timed(spark, d)
    out = keyed.unanswered(rows.where("type = 'view'").select("user_id", "ts", "id"), rows.where("type = 'click'"), "user_id", "12 HOURS", "1 day")
    return streams.run_to_end(out, spark, "stream-unanswered").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
