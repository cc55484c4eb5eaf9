"""Writers: partitioned appends that can be repeated, retention, exports. Whole relations are replaced in versions: see store."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.store import move, names, remove


def append_events(events: DataFrame, path: str) -> None:
    """A folder a day, so that reads prune and retention drops folders."""
    events.withColumn("event_date", F.to_date("ts")).write.mode("append").partitionBy("event_date").parquet(path)


def batch_writer(path: str):
    """For foreachBatch: a batch that is written again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/micro_batch={number}")

    return write


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def retain(df: DataFrame, path: str, since) -> None:
    """Write what is not older than `since`; the reader moves to the new folder when it is whole."""
    df.where(F.col("ts") >= since).withColumn("event_date", F.to_date("ts")).write.mode("overwrite").partitionBy("event_date").parquet(path)


def drop_older(spark: SparkSession, path: str, since: datetime) -> dict[str, list[str]]:
    """Retention in place, of what append_events has written: whole days before `since` go by their folder, without being read; only the
    day that holds `since` is written anew. What is kept beyond that day is neither read nor written. The days that went, and the cut one.

    The border day is moved aside before its new folder takes its place; a run that dies between leaves it under `_old-`, and the next run
    brings it back first.
    """
    for name in names(spark, path):
        if name.startswith("_old-") and name.split("-", 1)[1] not in names(spark, path):
            move(spark, f"{path}/{name}", f"{path}/{name.split('-', 1)[1]}")
    border = f"event_date={since:%Y-%m-%d}"
    days = [n for n in names(spark, path) if n.startswith("event_date=") and n[11:12].isdigit()]
    gone = [n for n in days if n < border]
    for name in gone:
        remove(spark, f"{path}/{name}")
    cut = [n for n in days if n == border and not spark.read.parquet(f"{path}/{n}").where(F.col("ts") < F.lit(since)).isEmpty()]
    for name in cut:
        new = f"{path}/_new-{uuid.uuid4().hex}"
        spark.read.parquet(f"{path}/{name}").where(F.col("ts") >= F.lit(since)).write.parquet(new)
        move(spark, f"{path}/{name}", f"{path}/_old-{name}")
        move(spark, new, f"{path}/{name}")
        remove(spark, f"{path}/_old-{name}")
    return {"gone": gone, "cut": cut}
