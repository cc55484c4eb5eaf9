"""Queries that store what they derive from the tables in the shared folder and read it back: index, versions, retention, loose JSON, readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import facets, index
from tesserae.plans import config as c
from tesserae.plans.registry import query
from tesserae.plans.spec import QuerySpec
from tesserae.session import shared_folder
from tesserae.sources import loose, readers, sinks, store
from tesserae.sources.tables import CARDS, CITATIONS, cards, citations, events, table

TEXT = "lower(title || chr(10) || id || chr(10) || array_to_string(tags, ' ') || chr(10) || summary)"


@query(f"SELECT 'bolt' AS term, id FROM {CARDS} WHERE contains({TEXT}, 'bolt') UNION ALL SELECT 'd ring', id FROM {CARDS} WHERE contains({TEXT}, 'd ring') UNION ALL SELECT 'promo brand#2', id FROM {CARDS} WHERE contains({TEXT}, 'promo brand#2')")
def index_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Terms against the stored index; each read takes the folders of its own grams."""
    folder, rows = shared_folder(spark, "index"), cards(spark, d)
    index.save(rows, folder)
    stored = store.read(spark, folder)
    found = [index.lookup(rows, stored, t).select(F.lit(t).alias("term"), "id") for t in ("bolt", "d ring", "Promo Brand#2")]
    return found[0].union(found[1]).union(found[2]).withColumn("term", F.lower("term"))


@query(f"""SELECT 'nodes' AS relation, count(*) AS n, sum(id)::BIGINT AS total FROM {CARDS} UNION ALL SELECT 'edges', count(*), sum(src + dst)::BIGINT FROM {CITATIONS}
  UNION ALL SELECT 'tags', count(*), sum(id)::BIGINT FROM (SELECT DISTINCT id, unnest(tags) AS tag FROM {CARDS}) UNION ALL SELECT 'meta', 4, (SELECT 2 * count(*) FROM part) + (SELECT count(*) FROM part) + (SELECT count(*) FROM {CITATIONS})
  UNION ALL SELECT 'search', count(DISTINCT gram), count(*) FROM (SELECT DISTINCT id, substr({TEXT}, i::INT, n::INT) AS gram FROM {CARDS}, range(2, 4) m(n), range(1, (SELECT max(length(p_name) + length(p_type) + length(p_brand)) * 2 + 60 FROM part)) r(i)
    WHERE i <= length({TEXT}) - n + 1 AND substr({TEXT}, i::INT, 1) <> ' ' AND substr({TEXT}, (i + n - 1)::INT, 1) <> ' ') AS g""".replace("SELECT 'meta', 4,", "SELECT 'meta', (SELECT 2 + count(DISTINCT topic) + count(DISTINCT obsolete) FROM " + CARDS + "),"))
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """All relations of an index, written and read back: rows, and a sum over each."""
    folder = shared_folder(spark, "build")
    rows = cards(spark, d)
    index.build(rows, citations(spark, d), folder, ["topic", "obsolete"])
    r = index.relations(spark, folder)
    one = lambda name, df, n, total: df.agg(F.lit(name).alias("relation"), n.alias("n"), total.cast("long").alias("total"))
    every = F.count("*")
    out = one("nodes", r["nodes"], every, F.sum("id")).union(one("edges", r["edges"], every, F.sum(F.col("src") + F.col("dst"))))
    return out.union(one("tags", r["tags"], every, F.sum("id"))).union(one("meta", r["meta"], every, F.sum("n"))).union(one("search", r["search"], F.countDistinct("gram"), F.sum("n")))


@query(f"""WITH r AS (SELECT *, topic = 'Brand#4' AS a, klass = 'PROMO' AS b, list_contains(tags, 'red') AS k FROM {CARDS} WHERE NOT obsolete),
  f AS (SELECT 'topic' AS facet, topic AS value FROM r WHERE b AND k UNION ALL SELECT 'klass', klass FROM r WHERE a AND k AND klass IN ('STANDARD', 'PROMO', 'SMALL', 'MEDIUM')
    UNION ALL SELECT 'category', unnest(CASE WHEN len(x) > 0 THEN x ELSE ['other'] END) FROM (SELECT list_distinct(list_filter(tags, lambda t: t IN ('red', 'blue', 'small', 'widget', 'bolt'))) AS x FROM r WHERE a AND b)
    UNION ALL SELECT 'tag', unnest(list_distinct(list_filter(tags, lambda t: t NOT IN ('red', 'blue', 'small', 'widget', 'bolt')))) FROM r WHERE a AND b AND k
    UNION ALL SELECT 'topic', NULL FROM r WHERE b AND k UNION ALL SELECT 'klass', NULL FROM r WHERE a AND k UNION ALL SELECT 'category', NULL FROM r WHERE a AND b UNION ALL SELECT 'tag', NULL FROM r WHERE a AND b AND k)
  SELECT facet, value, count(*) AS n FROM f GROUP BY facet, value""")
def facets_at_once(spark: SparkSession, d: str) -> DataFrame:
    """The counts of all facets for one selection, from one scan."""
    return facets.every(cards(spark, d), QuerySpec(topic="Brand#4", klass="PROMO", category="red"), c.CONCRETE, c.RESIDUAL, {"klass": c.CLASS_ORDER})


@query("""SELECT 1 AS version, count(*) AS n, sum(p_size)::BIGINT AS total FROM part UNION ALL SELECT 2, count(*), sum(p_size + 1)::BIGINT FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT 3, count(*), sum(p_size)::BIGINT FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 0, count(*), sum(p_size)::BIGINT FROM part WHERE p_partkey % 3 = 0""")
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of a relation, each read by its number, and the latest (0) without."""
    folder, p = shared_folder(spark, "versions"), table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    seen = store.autosave(p, folder, 0)
    seen = store.autosave(p.where("p_partkey % 2 = 0").withColumn("p_size", F.col("p_size") + 1), folder, seen)
    store.put({folder.rsplit("/", 1)[1]: p.where("p_partkey % 3 = 0")}, folder.rsplit("/", 1)[0], {folder.rsplit("/", 1)[1]}, keep=9)
    out = [store.read(spark, folder, v or None).agg(F.lit(v).alias("version"), F.count("*").alias("n"), F.sum("p_size").alias("total")) for v in (1, 2, 3, 0)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("SELECT ts::DATE AS day, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 10 DAY FROM events) GROUP BY 1")
def retention_folders(spark: SparkSession, d: str) -> DataFrame:
    """Events by day in the shared folder after a retention of ten days: whole folders go, the border day is cut."""
    folder, rows = shared_folder(spark, "events"), events(spark, d)
    sinks.append_events(rows, folder)
    last = rows.agg(F.max("ts") - F.make_dt_interval(F.lit(10))).first()[0]
    sinks.drop_older(spark, folder, last)
    return spark.read.schema(rows.schema.add("event_date", "date")).parquet(folder).groupBy(F.col("event_date").alias("day")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


#: What a seventh of the parts each has wrong: nothing, tags that are a text, a number in quotes, no title, cut off, no object, no id.
LOOSE = """CASE CAST(p_partkey % 7 AS INT) WHEN 4 THEN concat('{"id": "p', p_partkey, '", "title": ') WHEN 5 THEN concat('[', p_partkey, ', "', p_name, '"]')
  WHEN 6 THEN concat('{"title": "', p_name, '", "ord": ', p_size, '}')
  ELSE concat('{"id": "p', p_partkey, '", ', CASE WHEN p_partkey % 7 = 3 THEN '' ELSE concat('"title": "', p_name, '", ') END, '"parent": "', p_brand, '", "obsolete": ', p_size % 10 = 0, ', "ord": ',
    CASE WHEN p_partkey % 7 = 2 THEN concat('"', p_size, '"') ELSE concat('', p_size) END, ', "tags": ', CASE WHEN p_partkey % 7 = 1 THEN concat('"', p_name, '"') ELSE concat('["', replace(p_name, ' ', '", "'), '"]') END, '}') END"""


def loose_records(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes as lines of JSON in the shared folder, some of them broken, read back."""
    folder = shared_folder(spark, "loose")
    table(spark, d, "part").selectExpr(f"{LOOSE} AS value").write.text(folder)
    return loose.records(spark.read.text(folder))


@query("""SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 7 = 3 THEN 'p' || p_partkey ELSE p_name END AS title, p_brand AS topic, CASE WHEN p_partkey % 7 = 1 THEN '' ELSE replace(p_name, ' ', ',') END AS tags,
  CASE WHEN p_partkey % 7 = 2 THEN 0 ELSE p_size END::BIGINT AS ord, p_size % 10 = 0 AS obsolete, '' AS summary FROM part WHERE p_partkey % 7 < 4""")
def loose_cards(spark: SparkSession, d: str) -> DataFrame:
    good, _ = loose_records(spark, d)
    rows = good.select(*loose.cards(F.col("v")))
    return rows.select("id", "title", "topic", F.array_join("tags", ",").alias("tags"), "ord", "obsolete", "summary")


@query("""SELECT CASE p_partkey % 7 WHEN 4 THEN 'syntax' WHEN 5 THEN 'not an object' ELSE 'no key' END AS reason,
  CASE p_partkey % 7 WHEN 4 THEN '{"id": "p' || p_partkey || '", "title": ' WHEN 5 THEN '[' || p_partkey || ', "' || p_name || '"]' ELSE '{"title": "' || p_name || '", "ord": ' || p_size || '}' END AS value FROM part WHERE p_partkey % 7 > 3""")
def loose_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """What is no record, with the reason."""
    return loose_records(spark, d)[1].select("reason", "value")


@query("""SELECT p_brand AS topic, p_name AS q, p_size AS n FROM part WHERE split_part(p_brand, '#', 2)::INT % 4 > 1""")
def typed_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A file of questions a topic; those of some topics are cut off or hold an object, and have none."""
    folder = shared_folder(spark, "faqs")
    p = table(spark, d, "part").select(F.col("p_brand").alias("topic"), F.pmod(F.split("p_brand", "#")[1].cast("int"), F.lit(4)).alias("k"), F.to_json(F.struct(F.col("p_name").alias("q"), F.col("p_size").alias("n"))).alias("one"))
    files = p.groupBy("topic", "k").agg(F.array_join(F.collect_list("one"), ", ").alias("all"))  # a topic's file is one value, so it is made as one
    broken = F.when(F.col("k") == 0, F.concat(F.lit("["), "all")).when(F.col("k") == 1, F.concat(F.lit('{"faqs": ['), "all", F.lit("]}"))).otherwise(F.concat(F.lit("["), "all", F.lit("]")))
    files.select("topic", broken.alias("value")).write.partitionBy("topic").text(folder)
    return loose.whole(spark, folder, "array<struct<q:string,n:int>>").select("topic", "q", "n")


def arrays(df: DataFrame, folder: str, by: str, wrap: str | None = None) -> None:
    """A file of one JSON array of df's other columns for each value of `by`, in the shared folder; wrap: a field that holds the array."""
    others = F.struct(*[c for c in df.columns if c != by])
    text = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(others)), ", "), F.lit("]"))  # a file is one value, so it is made as one
    if wrap:
        text = F.when(F.pmod(F.xxhash64(by), F.lit(2)) == 0, F.concat(F.lit('{"' + wrap + '": '), text, F.lit("}"))).otherwise(text)
    df.groupBy(by).agg(text.alias("value")).write.partitionBy(by).text(folder)


@query("SELECT 'A-' || p_partkey AS id, p_name AS title, p_brand AS parent, len(string_split(p_name, ' '))::INT AS n_tags, CASE WHEN p_size % 10 = 0 THEN 'obsolete' END AS status FROM part")
def read_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Nodes as JSON arrays, a file a class, read with the model's schema; fields that aren't there are null."""
    folder, p = shared_folder(spark, "nodes"), table(spark, d, "part")
    arrays(p.select(F.concat(F.lit("A-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("parent"), F.split("p_name", " ").alias("tags"), F.when(F.col("p_size") % 10 == 0, "obsolete").alias("status"), F.lit(1).alias("unknown"), F.col("p_type").alias("k")), folder, "k")
    return readers.catalogue(spark, folder).select("id", "title", "parent", F.size("tags").alias("n_tags"), "status")


@query("SELECT DISTINCT 's' || (l_orderkey % 500) AS src, 'd' || l_partkey AS dst, l_returnflag AS relation FROM lineitem WHERE l_quantity >= 40")
def read_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges in bare arrays and in objects that hold one, and a file that isn't there, which has none."""
    folder = shared_folder(spark, "edges")
    e = table(spark, d, "lineitem").where("l_quantity >= 40").select(F.concat(F.lit("s"), (F.col("l_orderkey") % 500).cast("string")).alias("from"), F.concat(F.lit("d"), F.col("l_partkey").cast("string")).alias("to"), F.col("l_returnflag").alias("relation"), F.pmod(F.col("l_partkey"), F.lit(16)).alias("k")).distinct()
    arrays(e, folder, "k", "edges")
    return readers.edges(spark, folder).union(readers.edges(spark, f"{folder}-none")).select(F.col("from").alias("src"), F.col("to").alias("dst"), "relation")


@query("SELECT 'S' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'long ' || p_name ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS subtitle FROM part WHERE p_partkey % 40 = 3")
def read_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """A light index, and details over it where they are."""
    folder, p = shared_folder(spark, "scenarios"), table(spark, d, "part").where("p_partkey % 40 = 3")
    id_ = F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("id")
    arrays(p.select(id_, F.col("p_name").alias("title"), F.col("p_brand").alias("k")), f"{folder}/light", "k")
    arrays(p.where("p_partkey % 3 = 0").select(id_, F.concat(F.lit("long "), "p_name").alias("title"), F.col("p_type").alias("subtitle"), F.col("p_brand").alias("k")), f"{folder}/detail", "k")
    return readers.scenarios(spark, f"{folder}/light", f"{folder}/detail").select("id", "title", "subtitle")


@query("SELECT (row_number() OVER (ORDER BY n_name DESC) - 1)::INT AS ord, n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def read_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object of nations in descending order, which is kept."""
    folder = shared_folder(spark, "dictionary")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pairs = F.sort_array(F.collect_list(F.struct("n_name", "r_name")), asc=False)  # 25 nations
    text = F.array_join(F.transform(pairs, lambda x: F.concat(F.lit('"'), x["n_name"], F.lit('": "'), x["r_name"], F.lit('"'))), ", ")
    n.agg(F.concat(F.lit("{"), text, F.lit("}")).alias("value")).write.text(folder)
    return readers.dictionary(spark, folder)


@query("SELECT n_name AS name, '# ' || n_name || chr(10) || 'in region ' || n_regionkey AS text FROM nation WHERE n_nationkey % 2 = 0")
def read_markdown(spark: SparkSession, d: str) -> DataFrame:
    """A whole file a row, joined to what names it by its path."""
    folder, n = shared_folder(spark, "markdown"), table(spark, d, "nation")
    n.where("n_nationkey % 2 = 0").select("n_name", F.concat(F.lit("# "), "n_name", F.lit("\nin region "), F.col("n_regionkey").cast("string")).alias("value")).write.partitionBy("n_name").text(folder)
    found = readers.documents(spark, folder, "*.txt").withColumn("name", F.regexp_extract("path", "n_name=([^/]+)", 1))
    return n.join(found, n.n_name == found.name).select("name", F.rtrim(F.col("text"), F.lit("\n")).alias("text"))


@query("SELECT 'nation/' || n_name AS key, n_regionkey AS value, 200 AS status FROM nation WHERE n_name = 'NATION_7' UNION ALL SELECT 'nation/none', NULL, 404 UNION ALL SELECT 'nation/unbound', NULL, 503")
def read_point(spark: SparkSession, d: str) -> DataFrame:
    """One key of a stored relation, a key that isn't there, and no store."""
    folder = shared_folder(spark, "points")
    store.put({"nation": table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))}, folder, {"nation"})
    kv = store.read(spark, f"{folder}/nation")

    def row(key: str, found: DataFrame | int) -> DataFrame:
        name = F.lit(f"nation/{key}").alias("key")
        if isinstance(found, int):
            return kv.limit(0).agg(name, F.first("value").alias("value"), F.lit(found).alias("status"))
        return found.select(name, "value", F.lit(200).alias("status"))

    return row("NATION_7", readers.point_read(kv, "NATION_7")).union(row("none", readers.point_read(kv, "none"))).union(row("unbound", readers.point_read(None, "x")))


@query("""SELECT doc_id || '.pdf' AS filename, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN source ELSE lang END AS category, CASE WHEN doc_id % 3 = 0 THEN 'a "quoted", ' || lang ELSE 'from the head' END AS agency FROM documents""")
def read_manifest(spark: SparkSession, d: str) -> DataFrame:
    """A manifest in CSV beside files: its values where it has one, else what the file's head says."""
    folder, docs = shared_folder(spark, "manifest"), table(spark, d, "documents").select("doc_id", "lang", "source")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename")
    listed = docs.where("doc_id % 3 = 0").select(name, F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(" ").alias("category"), F.lit(None).cast("string").alias("parent"), F.concat(F.lit('a "quoted", '), "lang").alias("agency"), F.lit("1").alias("version"), F.lit("x\ny").alias("notes"))
    listed.write.option("header", True).option("escape", '"').csv(folder)
    files = docs.select(name, "lang")
    return readers.described(files, readers.manifest(spark, folder), {"category": F.col("lang"), "agency": F.lit("from the head")}).select("filename", "category", "agency")


@query("""SELECT CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '2024-03-01' END AS start, CASE WHEN c_custkey % 5 = 0 THEN c_custkey::VARCHAR ELSE '31.5' END AS rate, count(*) AS n
  FROM customer WHERE c_custkey % 12 <> 0 GROUP BY ALL""")
def drafts_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Drafts exported as JSON and read back over the defaults; those without both a name and a first day are refused."""
    folder, k = shared_folder(spark, "drafts"), F.col("c_custkey")
    heads = table(spark, d, "customer").select(F.when(k % 4 != 0, F.col("c_name")).alias("name"), F.when(k % 6 != 0, "2024-03-01").alias("startDate"), F.when(k % 5 == 0, k.cast("string")).alias("exchangeRate"))
    sinks.export_json(heads, folder)
    rows = readers.draft(spark, folder, {"exchangeRate": "31.5"}, lines=True)
    return rows.groupBy("name", F.col("startDate").alias("start"), F.col("exchangeRate").alias("rate")).agg(F.count("*").alias("n"))
