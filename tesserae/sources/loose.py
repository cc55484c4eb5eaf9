"""Loosely typed JSON: records are read as VARIANT, fields pass guards on what they are, and what is no record is kept aside as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBERS = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _kind(v: Column, path: str) -> Column:
    """What a field is, as the schema of its value; null if there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str, default: Column | None = None) -> Column:
    """A field that is a text, else the default."""
    return F.coalesce(F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string")), F.lit(None).cast("string") if default is None else default)


def number(v: Column, path: str, default: float = 0.0) -> Column:
    """A field that is a number; a text of digits isn't."""
    return F.coalesce(F.when(F.rlike(_kind(v, path), F.lit(NUMBERS)), F.try_variant_get(v, path, "double")), F.lit(default))


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.when(_kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def texts(v: Column, path: str) -> Column:
    """A field that is an array, its members as texts; else an empty one."""
    found = F.when(F.startswith(_kind(v, path), F.lit("ARRAY")), F.try_variant_get(v, path, "array<string>"))
    return F.coalesce(found, F.array().cast("array<string>"))


def records(lines: DataFrame, raw: str = "value", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Rows of JSON text as records (v: VARIANT, and the other columns), and those that are none, with the reason.

    A record is an object whose key is a text that isn't empty. Reasons: empty, syntax, not an object, no key.
    """
    rows = lines.withColumn("v", F.try_parse_json(raw))
    reason = (
        F.when(F.trim(F.coalesce(raw, F.lit(""))) == "", "empty")
        .when(F.col("v").isNull(), "syntax")
        .when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not an object")
        .when(F.coalesce(text(F.col("v"), f"$.{key}"), F.lit("")) == "", "no key")
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason", raw), judged.where("reason IS NOT NULL").select(*lines.columns, "reason")


def cards(v: Column) -> list[Column]:
    """A card's columns from a node, each by its guard, with defaults."""
    id_ = text(v, "$.id")
    return [
        id_.alias("id"),
        text(v, "$.title", id_).alias("title"),
        text(v, "$.parent").alias("topic"),
        texts(v, "$.tags").alias("tags"),
        number(v, "$.ord").cast("long").alias("ord"),
        text(v, "$.summary", F.lit("")).alias("summary"),
        flag(v, "$.obsolete").alias("obsolete"),
        F.nullif(text(v, "$.effective_period"), F.lit("")).alias("effective"),
    ]


def whole(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Files of one JSON value each as rows of `shape` (array<struct<...>>); a file that is malformed or of another shape has no rows.

    The columns of partition folders are kept.
    """
    files = spark.read.text(path, wholetext=True)
    value = F.try_variant_get(F.try_parse_json("value"), "$", shape)
    others = [c for c in files.columns if c != "value"]
    return files.select(*others, F.inline(F.coalesce(value, F.array().cast(shape))))


def whole_map(spark: SparkSession, path: str, of: str) -> DataFrame:
    """Files of one JSON object each as rows of key and the fields of `of` (struct<...>); anything else than an object has no rows."""
    files = spark.read.text(path, wholetext=True)
    value = F.try_variant_get(F.try_parse_json("value"), "$", f"map<string,{of}>")
    others = [c for c in files.columns if c != "value"]
    entries = files.select(*others, F.explode(F.map_entries(F.coalesce(value, F.create_map().cast(f"map<string,{of}>")))).alias("_e"))
    return entries.select(*others, "_e.key", "_e.value.*")
