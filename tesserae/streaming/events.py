"""Streams of events: the batch operators behind a watermark, a sink that can be repeated, and runs that end when all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.operators import events as ev
from tesserae.session import shared_folder
from tesserae.sources.sinks import batch_writer
from tesserae.streaming.keyed import with_state


def stream(spark: SparkSession, folder: str, glob: str, schema, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files).parquet(folder)


def daily(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts a day and type; a day is given out when the watermark has passed it."""
    return ev.windows(events.withWatermark("ts", late), "1 day")


def once_each(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    return ev.sessions(events.withWatermark("ts", late), key, gap)


def run_to_end(out: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Read all there is, write each batch once, and give back what was written. The checkpoint lies in the shared folder."""
    folder = shared_folder(spark, name)
    with with_state(spark):
        job = out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(batch_writer(f"{folder}/rows")).start()
        job.awaitTermination()
    rows = spark.read.schema(T.StructType([*out.schema.fields, T.StructField("micro_batch", T.IntegerType())])).parquet(f"{folder}/rows")
    if mode == "complete":  # each batch holds all rows so far
        rows = rows.where(F.col("micro_batch") == rows.agg(F.max("micro_batch")).first()[0])
    return rows.select(*out.columns)


def last_of_burst(events: DataFrame, key: str, gap: str, late: str = "1 day") -> DataFrame:
    """Debounce on a stream: the last event of each session."""
    s = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max_by("id", F.struct("ts", "id")).alias("id"), F.max("ts").alias("ts"))
    return s.select(key, "id", "ts")
