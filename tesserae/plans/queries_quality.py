"""Queries on data quality, tenants, and text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions import values as vl
from tesserae.operators import governance as gv
from tesserae.operators import tenancy as tn
from tesserae.plans.registry import query, values
from tesserae.sources import readers
from tesserae.sources.tables import CARDS, cards, table


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_repeated(spark: SparkSession, d: str) -> DataFrame:
    return gv.repeated(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT ref, count(*) AS n FROM (SELECT l_partkey + l_suppkey AS ref FROM lineitem) WHERE ref NOT IN (SELECT p_partkey FROM part) GROUP BY ref")
def dq_dangling(spark: SparkSession, d: str) -> DataFrame:
    refs = table(spark, d, "lineitem").select((F.col("l_partkey") + F.col("l_suppkey")).alias("ref"))
    return gv.dangling(refs, "ref", table(spark, d, "part"), "p_partkey").groupBy("ref").agg(F.count("*").alias("n"))


@query(f"""SELECT rule, severity, id::VARCHAR AS key FROM (
  SELECT id, 'ordinal' AS rule, 'warning' AS severity FROM {CARDS} WHERE ord > 45 UNION ALL SELECT id, 'topic', 'error' FROM {CARDS} WHERE NOT regexp_matches(topic, '^Brand#[0-9]$')
  UNION ALL SELECT id, 'superseded', 'error' FROM {CARDS} WHERE obsolete AND effective IS NULL UNION ALL SELECT id, 'tags', 'warning' FROM {CARDS} WHERE len(tags) > 2
  UNION ALL SELECT id, 'version', 'error' FROM {CARDS} WHERE ord % 13 = 0 OR ord % 31 = 30 UNION ALL SELECT id, 'class', 'error' FROM {CARDS} WHERE ord % 17 = 0 AND klass[1] <> 'Z'
  UNION ALL SELECT id, 'folder', 'error' FROM {CARDS} WHERE ord % 19 = 0 UNION ALL SELECT id, 'letter', 'error' FROM {CARDS} WHERE upper(title[1]) = klass[1])""")
def dq_violations(spark: SparkSession, d: str) -> DataFrame:
    """Versions aren't dates, ids have another class's letter, and files lie in another folder, each at some ordinals."""
    ord_, letter = F.col("ord"), F.substr("klass", F.lit(1), F.lit(1))
    version = F.when(ord_ % 13 == 0, "soon").otherwise(F.concat(F.lit("2024-02-"), F.when(ord_ % 31 == 30, "30").otherwise("11")))
    code = F.concat(F.when(ord_ % 17 == 0, "Z").otherwise(letter), F.lit("-"), F.col("id").cast("string"))
    file = F.concat(F.when(ord_ % 19 == 0, "misc").otherwise(F.lower("klass")), F.lit("/"), F.col("id").cast("string"), F.lit(".md"))
    rows = cards(spark, d).withColumns({"version": version, "code": code, "file": file})
    rules = [
        ("ordinal", "warning", F.col("ord") > 45),
        ("topic", "error", ~F.rlike("topic", F.lit("^Brand#[0-9]$"))),
        ("superseded", "error", F.col("obsolete") & F.col("effective").isNull()),
        ("tags", "warning", F.size("tags") > 2),
        ("version", "error", F.try_to_date("version", "yyyy-MM-dd").isNull()),
        ("class", "error", F.substring_index("code", "-", 1) != letter),
        ("folder", "error", F.substring_index("file", "/", 1) != F.lower("klass")),
        ("letter", "error", F.upper(F.substr("title", F.lit(1), F.lit(1))) == letter),
    ]
    return gv.violations(rows, "id", rules)


@query(f"SELECT 'effective' AS field, count(*) FILTER (coalesce(effective, '') = '') AS vacant, round(count(*) FILTER (coalesce(effective, '') = '') / count(*), 4) AS rate FROM {CARDS} UNION ALL SELECT 'title', count(*) FILTER (coalesce(trim(title), '') = ''), round(count(*) FILTER (coalesce(trim(title), '') = '') / count(*), 4) FROM {CARDS}")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return gv.completeness(cards(spark, d), ["effective", "title"])


@query("SELECT d.source, count(*) AS n, count(l.doc_id) AS reviewed, round(avg(length(d.text)), 6) AS mean_length FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source")
def source_summary(spark: SparkSession, d: str) -> DataFrame:
    met = table(spark, d, "documents").select("doc_id", "source", F.length("text").alias("len")).join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("seen")), "doc_id", "left")
    return met.groupBy("source").agg(F.count("*").alias("n"), F.count("seen").alias("reviewed"), F.round(F.avg("len"), 6).alias("mean_length"))


@query(f"""SELECT tag, (sum(count(*)) OVER (PARTITION BY tag))::BIGINT AS n, id // 1000 AS block, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids
  FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM {CARDS}) GROUP BY tag, id // 1000""")
def tag_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Each tag's count and ids, a row for a thousand ids."""
    return gv.inventory(cards(spark, d), "tags", "id").select("tag", "n", "block", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


TENANTS = [("t1", False, ["Brand#1", "Brand#2"], ["Brand#3"]), ("t2", True, [], []), ("t3", False, [], [])]
TOPICS = [f"Brand#{i}" for i in range(1, 21)]


def tenants(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TENANTS, "tenant_id string, visible_all boolean, visible array<string>, own array<string>")


@query(f"SELECT id, topic FROM {CARDS} WHERE topic IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#21', 'Brand#22', 'Brand#23', 'Brand#24', 'Brand#25')")
def tenant_visible(spark: SparkSession, d: str) -> DataFrame:
    return tn.visible_to(cards(spark, d), tenants(spark), TOPICS, "t1").select("id", "topic")


@query("""WITH t AS (SELECT r_name AS tenant_id, r_regionkey = 1 AS visible_all, 1 + r_regionkey AS k FROM region), b AS (SELECT DISTINCT p_brand AS topic, split_part(p_brand, '#', 2)::INT AS n FROM part)
  SELECT tenant_id, topic FROM t, b WHERE NOT visible_all AND n % 5 <> k - 1 AND NOT (n % 7 = 3)""")
def tenant_hidden(spark: SparkSession, d: str) -> DataFrame:
    """A tenant a region: each sees a fifth of the topics and owns some; one sees all."""
    topics = sorted(r[0] for r in table(spark, d, "part").select("p_brand").distinct().collect())  # the catalogue's topics, a fixed list
    number = lambda t: int(t.split("#")[1])
    r = table(spark, d, "region")
    visible = F.when(F.lit(False), F.array().cast("array<string>"))
    for k in range(5):
        visible = visible.when(F.col("r_regionkey") == k, F.array(*[F.lit(t) for t in topics if number(t) % 5 == k]).cast("array<string>"))
    own = F.array(*[F.lit(t) for t in topics if number(t) % 7 == 3]).cast("array<string>")
    return tn.hidden_topics(r.select(F.col("r_name").alias("tenant_id"), (F.col("r_regionkey") == 1).alias("visible_all"), visible.alias("visible"), own.alias("own")), topics)


LICENCES = [(0, "t1", "2030-01-01"), (1, "t2", "2001-01-01"), (2, "t3", "not a date"), (3, "t4", None)]


@query(f"SELECT c_custkey AS key, CASE WHEN l.tenant_id IS NOT NULL AND (expires_at IS NULL OR try_cast(expires_at AS TIMESTAMP) >= TIMESTAMP '2024-01-01') THEN l.tenant_id ELSE 'public' END AS tenant_id FROM customer LEFT JOIN {values(LICENCES, 'l(key, tenant_id, expires_at)')} ON l.key = c_custkey")
def licence_downgrade(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return tn.effective(keys, spark.createDataFrame(LICENCES, "key long, tenant_id string, expires_at string"), F.lit("2024-01-01").cast("timestamp"), "public")


@query("SELECT n_name AS tenant_id, n_regionkey = 0 AS visible_all FROM nation UNION ALL SELECT NULL, NULL")
def tenant_header(spark: SparkSession, d: str) -> DataFrame:
    """To a header and back; what is no header gives nulls."""
    n = table(spark, d, "nation").select(tn.to_header(F.struct(F.col("n_name").alias("tenant_id"), (F.col("n_regionkey") == 0).alias("visible_all"))).alias("h"))
    bad = spark.createDataFrame([("no header!",)], "h string")
    return n.union(bad).select(tn.from_header(F.col("h")).alias("x")).select("x.tenant_id", "x.visible_all")


@query("SELECT doc_id, CASE WHEN contains(text, '.') THEN split_part(text, '.', 1) || '.' ELSE text END || ' [auto]' AS sentence FROM documents")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.first_sentence(F.col("text"), mark=" [auto]").alias("sentence"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), f AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY 1, 2)
  SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY doc_id""")
def line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(gv.line_dedup(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT id, CASE WHEN length(title) < 8 THEN 'short' WHEN title = 'small ring' THEN 'boilerplate' WHEN length(title) > 12 THEN 'long' END AS defect FROM {CARDS}")
def title_defects(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("id", gv.title_defect(F.col("title"), 8, 12, ["Small Ring"]).alias("defect"))


@query(f"SELECT id, split_part(title, ' ', 1) AS prefix, split_part(title, ' ', 2) AS main FROM {CARDS}")
def title_split(spark: SparkSession, d: str) -> DataFrame:
    prefix, main = tx.split_title(F.col("title"), F.col("id").cast("string"), [r"[0-9]+", r"[a-z]+(?= )"])
    return cards(spark, d).select("id", prefix.alias("prefix"), main.alias("main"))


@query("SELECT p_partkey AS id, split_part(p_brand, '#', 1) AS klass, split_part(p_brand, '#', 2)::INT AS num, split_part(p_brand, '#', 2) AS law FROM part")
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = F.split("p_brand", "#")
    number = F.coalesce(F.element_at(parts, -1).try_cast("int"), F.lit(0))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.get(parts, F.lit(0)).alias("klass"), number.alias("num"), tx.after_first(F.col("p_brand"), "#").alias("law"))


@query("SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, CASE WHEN contains(url, '.html') THEN 'file' WHEN contains(url, 'utm_') THEN 'feed' ELSE 'page' END AS label FROM pages")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select("page_id", tx.url_host(F.col("url")).alias("host"), tx.first_match(F.col("url"), [(".html", "file"), ("utm_", "feed")], "page").alias("label"))


SECTION = r"SELECT conv_id, turn, trim(regexp_extract(text || chr(10) || '## End', '(?s)^(.*?)\n##\s', 1), ' ' || chr(10) || chr(9) || chr(13)) AS summary, role AS notes, true AS stripped FROM conversations"


@query(SECTION)
def section_extract(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as the body of a section between two others, below a front matter."""
    c = table(spark, d, "conversations")
    md = F.concat(F.lit("---\nid: "), F.col("conv_id").cast("string"), F.lit("\n---\n\n## Notes\n"), "role", F.lit("\n\n## Summary\n"), "text", F.lit("\n## End\nx"))
    body = tx.strip_front_matter(md)
    return c.select("conv_id", "turn", tx.section(md, "Summary").alias("summary"), tx.first_section(md, ["None", "Notes"]).alias("notes"), F.startswith(body, F.lit("## Notes")).alias("stripped"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), 'rights reserved') THEN 'contested' WHEN contains(lower(text), 'license') OR contains(lower(text), 'apache') THEN 'inferred' ELSE 'explicit' END AS certainty, doc_id % 9 = 0 AS residue FROM documents""")
def certainty_mark(spark: SparkSession, d: str) -> DataFrame:
    """Signal words by level; and lines of a table of contents, which a ninth of the texts get at their end."""
    words = {"contested": ["rights reserved"], "inferred": ["license", "apache"]}
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 9 == 0, "\nScope of all ........ 12\nend").otherwise("\nand so on ... 3 of 4"))
    return table(spark, d, "documents").select("doc_id", tx.signal(t, words, "explicit").alias("certainty"), tx.has_contents(t).alias("residue"))


@query(f"SELECT id, array_to_string(list_distinct_ordered[1:2], ',') AS tags FROM (SELECT id, CASE WHEN t[1] = t[2] THEN [t[1], t[3]] ELSE t END AS list_distinct_ordered FROM (SELECT id, list_transform(tags, lambda x: CASE x WHEN 'red' THEN 'colour' WHEN 'blue' THEN 'colour' WHEN 'bolt' THEN 'colour' ELSE x END) AS t FROM {CARDS}))")
def tag_normalise(spark: SparkSession, d: str) -> DataFrame:
    tags = gv.normal_tags(F.col("tags"), {"red": "colour", "blue": "colour", "bolt": "colour"}, 2)
    return cards(spark, d).select("id", F.array_join(tags, ",").alias("tags"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_size % 2 = 1 THEN 'fixed' ELSE p_name END AS value, CASE p_size % 3 WHEN 0 THEN 'fix' WHEN 1 THEN 'pass' END AS verdict FROM part")
def review_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("value"), (F.col("p_size") % 2 == 0).alias("reviewed"))
    verdicts = p.where("p_size % 3 < 2").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, "fix").otherwise("pass").alias("verdict"), F.lit("fixed").alias("value"))
    return gv.reviewed(rows, verdicts, "id").select("id", "value", "verdict")


@query("SELECT (('0x' || substr(md5('7:' || p_partkey), 1, 8))::BIGINT % 16)::INT AS batch, count(*) AS n FROM part GROUP BY 1")
def work_batches(spark: SparkSession, d: str) -> DataFrame:
    return gv.batches(table(spark, d, "part"), "p_partkey").groupBy("batch").agg(F.count("*").alias("n"))


@query()
def nfkc_text(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility composition; tests/test_functions.py holds it against the standard library."""
    return table(spark, d, "documents").select("doc_id", F.md5(vl.nfkc(F.col("text")).cast("binary")).alias("digest"))


#: Numbers below ten thousand in words, without zeros between.
NUMERAL = """concat(CASE WHEN {n} >= 1000 THEN concat(substr('一二三四五六七八九', CAST(floor({n} / 1000) AS INT), 1), '千') ELSE '' END, CASE WHEN {n} % 1000 >= 100 THEN concat(substr('一二三四五六七八九', CAST(floor({n} % 1000 / 100) AS INT), 1), '百') ELSE '' END,
  CASE WHEN {n} % 100 >= 20 OR {n} > 100 AND {n} % 100 >= 10 THEN substr('一二三四五六七八九', CAST(floor({n} % 100 / 10) AS INT), 1) ELSE '' END, CASE WHEN {n} % 100 >= 10 THEN '十' ELSE '' END, CASE WHEN {n} % 10 > 0 THEN substr('一二三四五六七八九', CAST({n} % 10 AS INT), 1) ELSE '' END)"""


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 1 + o_orderkey % 9999 END::INT AS n FROM orders")
def numerals(spark: SparkSession, d: str) -> DataFrame:
    """Order numbers in words and back; a fifth has a character that is no numeral."""
    word = F.expr(NUMERAL.format(n="(1 + o_orderkey % 9999)"))
    return table(spark, d, "orders").select("o_orderkey", vl.numeral(F.when(F.col("o_orderkey") % 5 == 0, F.concat(word, F.lit("甲"))).otherwise(word)).cast("int").alias("n"))


@query(f"SELECT p_partkey AS id, p_size % 4 = 0 AS marked, CASE WHEN p_size % 4 = 0 THEN translate('no. ' || chr(12032 + p_size::INT), '{vl.unified_pairs()[0]}', '{vl.unified_pairs()[1]}') ELSE 'no. ' || p_size END AS text FROM part")
def radicals(spark: SparkSession, d: str) -> DataFrame:
    """Characters that stand for radicals are found and replaced."""
    t = F.concat(F.lit("no. "), F.when(F.col("p_size") % 4 == 0, F.substr(F.lit(vl.radical_block()), F.col("p_size") + 1, F.lit(1))).otherwise(F.col("p_size").cast("string")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), vl.has_radicals(t).alias("marked"), vl.unified(t).alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[mail]', 'g'), '[+][0-9]+ [(][0-9]+[)] [0-9-]+', '[phone]', 'g') AS text FROM documents")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    mail = F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[mail]")
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(mail, "[+][0-9]+ [(][0-9]+[)] [0-9-]+", "[phone]").alias("text"))


@query("SELECT lower(regexp_replace(p_name, ' +$', '')) || '|' AS name, count(*) AS n FROM part GROUP BY 1")
def text_normalise(spark: SparkSession, d: str) -> DataFrame:
    name = tx.norm(F.concat(F.lit("　 "), F.upper("p_name"), F.lit("  \n")))
    return table(spark, d, "part").groupBy(F.concat(name, F.lit("|")).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'a / b' ELSE 'plain' END AS cell, CASE WHEN p_size % 2 = 0 THEN 'stop' ELSE 'info' END AS severity FROM part")
def union_cells(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    even = F.col("p_size") % 2 == 0
    cell = F.when(even, '{"v": "a\\nb", "multiline": true}').otherwise("plain")
    note = F.when(even, '{"text": "t", "severity": "stop"}').otherwise("t")
    return p.select(F.col("p_partkey").alias("id"), readers.cell_text(cell).alias("cell"), readers.caveat(note)["severity"].alias("severity"))


@query("SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN 'override' END, n_name, 'none') AS source FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def override_chain(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    override = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.lit("override").alias("o"))
    met = s.join(override, "s_suppkey", "left").join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
    return met.select("s_suppkey", F.coalesce("o", "n_name", F.lit("none")).alias("source"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'none' ELSE o_orderpriority END AS priority, CASE WHEN o_custkey % 7 = 0 THEN 99 ELSE o_custkey END AS cust FROM orders")
def falsy_defaults(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    text = F.when(F.col("o_custkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    num = F.when(F.col("o_custkey") % 7 == 0, 0).otherwise(F.col("o_custkey"))
    return o.select("o_orderkey", vl.falsy_or(text, F.lit("none")).alias("priority"), vl.falsy_or(num, F.lit(99), "number").alias("cust"))


@query("""SELECT o_orderkey AS id, 'legal_ref' AS rule, 'warning' AS severity FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey % 6 = 0
  UNION ALL SELECT o_orderkey, 'severity', 'error' FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 1""")
def dq_caveats(spark: SparkSession, d: str) -> DataFrame:
    """A caveat that stops or warns should name its source; its severity must be a known one."""
    level = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 4 == 1), "other").when(F.col("o_orderstatus") == "F", "stop").when(F.col("o_orderstatus") == "P", "warn").otherwise("info")
    ref = F.when(F.col("o_orderkey") % 6 == 0, "").otherwise("art. 1")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level"), ref.alias("ref"))
    found = gv.violations(rows, "id", gv.caveat_rules(F.col("level"), F.col("ref")))
    return found.select(F.col("key").cast("long").alias("id"), "rule", "severity")


@query("""SELECT 's' || s_suppkey AS key, x.rule, 'error' AS severity FROM supplier, (VALUES ('id pattern', 0), ('topic required', 1), ('kind unknown', 2), ('next or conclude', 3)) x(rule, k)
  WHERE CASE k WHEN 0 THEN s_suppkey % 10 = 3 WHEN 1 THEN s_suppkey % 7 = 2 WHEN 2 THEN s_suppkey % 5 = 4 ELSE s_suppkey % 4 IN (0, 3) END""")
def dq_scenario_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows against a schema: patterns, required fields, known values, and exactly one of two fields (here none or both at times)."""
    k = F.col("s_suppkey")
    columns = {
        "id": F.when(k % 10 == 3, "S 1").otherwise(F.lower("s_name")),
        "topic": F.when(k % 7 == 2, " ").otherwise("t"),
        "kind": F.when(k % 5 == 4, "odd").otherwise("question"),
        "next": F.when(k % 4 != 0, F.when(k % 4 != 2, "q1")),
        "conclude": F.when(k % 4 > 1, "c1"),
    }
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("key"), *[v.alias(n) for n, v in columns.items()])
    rules = gv.schema_rules(patterns={"id": "^[a-z]+#[0-9]+$"}, required=["topic"], known={"kind": ["question", "conclusion"]}, one_of=[("next", "conclude")])
    return gv.violations(rows, "key", rules).select("key", "rule", "severity")


@query("SELECT doc_id AS id, source || '/' || doc_id || '.md' AS file FROM documents WHERE doc_id % 11 = 0")
def dq_missing_files(spark: SparkSession, d: str) -> DataFrame:
    """Named source files that aren't there."""
    named = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"))
    there = named.where("id % 11 <> 0").select(F.col("file").alias("path"))
    return gv.dangling(named, "file", there, "path").select("id", "file")


@query("SELECT page_id, contains(url, 'example.org') OR contains(url, 'casino-win.example.com') AS allowed FROM pages")
def url_allowed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.in_domains(F.col("url"), ["example.org", "casino-win.example.com"]).alias("allowed"))


@query("SELECT s_suppkey AS id, trim(regexp_replace(s_name || CASE WHEN s_suppkey % 2 = 0 THEN ' (old)' ELSE '' END, '\\s*\\((old|new)\\)$', '')) AS key FROM supplier")
def key_cleanup(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.col("s_name"), F.when(F.col("s_suppkey") % 2 == 0, " (old)").otherwise(""))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), tx.without_suffix(name, r"\s*\((?:old|new)\)").alias("key"))


MD = "'## Part ' || p_partkey || chr(10) || '**' || p_name || '** is <' || p_type || '> & [' || p_brand || '](/b/' || p_size || ')' || chr(10) || chr(10) || '### End' || chr(10) || '`x' || p_size || '`'"


@query("""SELECT p_partkey AS id, '<h3>Part ' || p_partkey || '</h3>' || chr(10) || '<p><strong>' || p_name || '</strong> is &lt;' || p_type || '&gt; &amp; <a href="/b/' || p_size || '">' || p_brand || '</a></p>' || chr(10) || '<h4>End</h4>' || chr(10) || '<p><code>x' || p_size || '</code></p>' AS html FROM part""")
def markdown_html(spark: SparkSession, d: str) -> DataFrame:
    md = F.expr(MD.replace("chr(10)", "char(10)"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), tx.markdown(md).alias("html"))


@query("""WITH l AS (SELECT DISTINCT ps AS key, line FROM (SELECT p_brand AS ps, p_name AS line FROM part UNION ALL SELECT p_brand, p_name || ' ' || p_type FROM part WHERE p_size % 2 = 0))
  SELECT key, line FROM l WHERE NOT EXISTS (SELECT 1 FROM l m WHERE m.key = l.key AND m.line <> l.line AND contains(m.line, l.line))""")
def lines_contained(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a topic without those that lie within another one."""
    p = table(spark, d, "part")
    lines = p.select(F.col("p_brand").alias("key"), F.col("p_name").alias("line")).union(p.where("p_size % 2 = 0").select("p_brand", F.concat_ws(" ", "p_name", "p_type")))
    return gv.without_contained(lines, "key", "line")
