"""Readers with explicit schemas. A missing file is an empty relation where the model says so; nothing infers a schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = (
    "id string, type string, parent string, title string, tags array<string>, related array<string>, source string, version string, reviewed string, "
    "status string, source_url string, effective_period string, superseded_by string, review_level string, certainty string, "
    "version_history array<struct<date:string,change:string,replaces:string>>, summary string, file_path string"
)
EDGE = "`from` string, `to` string, relation string, inferred boolean, matched string"
SCENARIO = (
    "id string, parent string, expense string, title string, subtitle string, primary_ids array<string>, tags array<string>, attachments array<string>, "
    "caveats array<string>, flow_root boolean, sub_scenarios array<string>, deprecated boolean, source string"
)
RATE = "node_id string, node_title string, table_caption string, label string, value string, unit string, row_index int, country string, is_other boolean"
TREE = "region string, countries array<struct<country:string,cities:array<struct<key:string,name:string,rate:int,seasonal:array<struct<`from`:string,`to`:string,rate:int>>>>>>"
MANIFEST = "filename string, category string, parent string, agency string, version string, notes string"
DRAFT = "name string, tripReason string, startDate string, endDate string, exchangeRate string, defaultCityKey string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that any store it reads will do."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).schema  # noqa: B018
        return True
    except AnalysisException:
        return False


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of nodes."""
    return spark.read.schema(NODE).json(path, multiLine=True)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """`{"edges": [...]}` or a bare array; a missing file has no edges."""
    if not _exists(spark, path):
        return empty(spark, EDGE)
    rows = spark.read.schema(f"edges array<struct<{EDGE.replace(' string', ':string').replace(' boolean', ':boolean')}>>, {EDGE}").json(path, multiLine=True)
    bare = F.struct(*[F.col(c) for c in ("from", "to", "relation", "inferred", "matched")])
    return rows.select(F.explode(F.coalesce("edges", F.array(bare))).alias("e")).select("e.*").where("`from` IS NOT NULL")


def scenarios(spark: SparkSession, index: str, detail: str | None = None) -> DataFrame:
    """The light index, and where given the detail over it."""
    light = spark.read.schema(SCENARIO).json(index, multiLine=True)
    if detail is None:
        return light
    return overlaid(light, spark.read.schema(SCENARIO).json(detail, multiLine=True), "id")


def overlaid(index: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Detail wins where it has a value; rows of the index stay."""
    d = detail.select(F.col(key), F.struct(*[c for c in detail.columns if c != key]).alias("_d"))
    own = [c for c in index.columns if c != key]
    return index.join(d, key, "left").select(key, *[F.coalesce(F.col(f"_d.{c}"), F.col(c)).alias(c) if c in detail.columns else F.col(c) for c in own])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object as ord, key, value; its order carries meaning and is kept."""
    raw = spark.read.text(path, wholetext=True)
    # a map keeps the text's order in from_json; the ordinal is fixed here, once
    return raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e")).select("ord", "e.key", "e.value")


def synonym_index(groups: DataFrame) -> DataFrame:
    """groups: grp, canonical, aliases. word, grp, ord: the last group of a word wins, its first place is kept."""
    words = groups.select("grp", F.posexplode(F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("p", "word"))
    return words.groupBy(F.lower("word").alias("word")).agg(F.max("grp").alias("grp"), F.min(F.struct("grp", "p")).alias("ord"))


def documents(spark: SparkSession, folder: str, suffix: str = "*.md") -> DataFrame:
    """path, text: a whole file a row."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=suffix).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def rate_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TREE).json(path, multiLine=True)


def flat_rates(spark: SparkSession, path: str) -> DataFrame:
    body = RATE.replace(" string", ":string").replace(" int", ":int").replace(" boolean", ":boolean")
    return spark.read.schema(f"entries array<struct<{body}>>").json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).csv(path, header=True, multiLine=True, escape='"') if _exists(spark, path) else empty(spark, MANIFEST)


def described(files: DataFrame, manifest_: DataFrame, inferred: dict[str, Column]) -> DataFrame:
    """files: filename. The manifest's values, else what the document's head says."""
    met = files.join(manifest_, "filename", "left")
    return met.withColumns({k: F.coalesce(F.nullif(F.trim(F.col(k)), F.lit("")), v) for k, v in inferred.items()})


def draft(spark: SparkSession, path: str, defaults: dict[str, str], lines: bool = False) -> DataFrame:
    """A saved draft over the defaults; one without both name and first day is refused. lines: a draft a line, as exports have them."""
    rows = spark.read.schema(DRAFT).json(path, multiLine=not lines)
    rows = rows.where((F.coalesce("name", F.lit("")) != "") | (F.coalesce("startDate", F.lit("")) != ""))
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def point_read(store: DataFrame | None, key: str) -> DataFrame | int:
    """The value's rows; 503 for no store, 404 for no such key."""
    if store is None:
        return 503
    found = store.where(F.col("key") == key)
    return found if found.limit(1).count() else 404


def cell_text(cell: Column) -> Column:
    """A cell that is a text or an object with `v`; line breaks become a slash."""
    value = F.when(F.startswith(F.ltrim(cell), F.lit("{")), F.get_json_object(cell, "$.v")).otherwise(cell)
    return F.regexp_replace(F.coalesce(value, F.lit("")), r"\s*\n\s*", " / ")


def caveat(c: Column, severity: str = "info") -> Column:
    """A text or an object as a struct with a severity."""
    is_object = F.startswith(F.ltrim(c), F.lit("{"))
    parsed = F.from_json(F.when(is_object, c), "text string, severity string, legal_ref string")
    return F.struct(F.when(is_object, parsed["text"]).otherwise(c).alias("text"), F.coalesce(parsed["severity"], F.lit(severity)).alias("severity"), parsed["legal_ref"].alias("legal_ref"))
