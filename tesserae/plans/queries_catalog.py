"""Queries on the catalogue: search, facets, orders, pages, scenarios, graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import text as tx
from tesserae.functions import values as values_
from tesserae.operators import catalog, facets, graph, scenario, search
from tesserae.operators.ranking import places
from tesserae.plans import config as c
from tesserae.plans.registry import query, values
from tesserae.plans.spec import QuerySpec
from tesserae.sources import readers
from tesserae.sources.readers import overlaid
from tesserae.sources.tables import CARDS, CITATIONS, CONCLUSIONS, FLOWS_SQL, SCENARIOS, cards, citations, flow_conclusions, flows, scenarios, table

TERMS = ["ring", "bolt", "gear"]
ORDERED = {k: "CASE {} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(vs)) for k, vs in (("topic", c.TOPIC_ORDER), ("klass", c.CLASS_ORDER))}


def place(k: str, unknown: int) -> str:
    return ORDERED[k].format(k) + f" ELSE {unknown} END"


def _score_sql(terms: list[str]) -> str:
    fields = {"title": "title", "id": "id::VARCHAR", "tags": "array_to_string(tags, ' ')", "summary": "summary"}
    return " + ".join(f"CASE WHEN contains(lower({e}), '{t}') THEN {c.WEIGHTS[k] if i == 0 else f'floor({c.WEIGHTS[k]} * 0.7::DOUBLE)'} ELSE 0 END" for i, t in enumerate(terms) for k, e in fields.items())


SCORED = f"(SELECT *, ({_score_sql(TERMS)})::BIGINT AS score FROM {CARDS}) AS s"


@query(f"SELECT id, title, score FROM {SCORED} WHERE score > 0 ORDER BY score DESC, load_ord LIMIT 20")
def search_weighted(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: three terms over weighted fields, the best twenty."""
    return search.ranked(search.search(cards(spark, d), TERMS, c.WEIGHTS), 20).select("id", "title", "score")


@query(f"SELECT id, score, CASE WHEN contains(lower(title || ' ' || id || ' ' || array_to_string(tags, ' ') || ' ' || summary), '{TERMS[1]}') THEN '{TERMS[1]}' WHEN contains(lower(title || ' ' || id || ' ' || array_to_string(tags, ' ') || ' ' || summary), '{TERMS[2]}') THEN '{TERMS[2]}' END AS via FROM {SCORED} WHERE score > 0")
def search_matched_term(spark: SparkSession, d: str) -> DataFrame:
    return search.search(cards(spark, d), TERMS, c.WEIGHTS).select("id", "score", "via")


#: Groups of synonyms: a region's name, then those of its nations; asked for: whole names and parts of them.
SYN = """(SELECT r_regionkey AS grp, r_regionkey * 100 AS ord, lower(r_name) AS word FROM region UNION ALL
  SELECT n_regionkey, n_regionkey * 100 + 1 + n_nationkey, lower(n_name) FROM nation UNION ALL SELECT (n_regionkey + 1) % 5, (n_regionkey + 1) % 5 * 100 + 50 + n_nationkey, lower(n_name) FROM nation WHERE n_nationkey % 6 = 0) AS syn"""
ASKED = "(SELECT ' ' || n_name AS query FROM nation UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT DISTINCT right(n_name, 2) FROM nation UNION ALL SELECT r_name || ' and more' FROM region UNION ALL SELECT DISTINCT c_mktsegment FROM customer) AS asked"


@query(f"""WITH q AS (SELECT query, lower(trim(query)) AS k FROM {ASKED}), syn AS (SELECT * FROM {SYN}),
  g AS (SELECT DISTINCT query, k, grp, CASE WHEN grp = (SELECT max(grp) FROM syn x WHERE x.word = k) THEN 0 ELSE 1 END AS r FROM q, syn WHERE contains(word, k) OR contains(k, word)),
  t AS (SELECT query, k AS term, -1 AS r, -1 AS grp, -1 AS ord FROM q UNION ALL SELECT query, word, r, g.grp, ord FROM g JOIN syn USING (grp)),
  f AS (SELECT query, term, min((r, grp, ord)) AS spot FROM t GROUP BY query, term)
  SELECT query, term, (row_number() OVER (PARTITION BY query ORDER BY spot) - 1)::INT AS ord FROM f""")
def search_synonyms(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: table(spark, d, t) for t in ("region", "nation", "customer")}
    read = lambda sql: spark.sql("SELECT * FROM " + re.sub(r"FROM (region|nation|customer)", r"FROM {\1}", sql), **tables)
    return search.expand(read(ASKED), read(SYN))


@query("""WITH w AS (SELECT r_regionkey AS grp, 0 AS p, lower(r_name) AS word FROM region UNION ALL SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT, lower(n_name) FROM nation
    UNION ALL SELECT n_regionkey, 90, 'nation' FROM nation)
  SELECT word, max(grp)::INT AS grp, min(grp * 1000 + p)::BIGINT AS spot FROM w GROUP BY word""")
def synonym_index(spark: SparkSession, d: str) -> DataFrame:
    """Words of groups inverted; one that several groups share goes to the last of them, at its first place."""
    names = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    padded = F.concat("names", F.array_repeat(F.lit(None).cast("string"), 89 - F.size("names")), F.array(F.lit("Nation")))
    groups = table(spark, d, "region").join(names, F.col("r_regionkey") == F.col("r")).select(F.col("r_regionkey").cast("int").alias("grp"), F.col("r_name").alias("canonical"), padded.alias("aliases"))
    found = readers.synonym_index(groups).where("word IS NOT NULL")
    return found.select("word", "grp", (F.col("ord.grp") * 1000 + F.col("ord.p")).cast("long").alias("spot"))


TEXT = "lower(title || chr(10) || id || chr(10) || array_to_string(tags, ' ') || chr(10) || summary)"
GRAMS = f"""(SELECT DISTINCT id, substr({TEXT}, i::INT, n::INT) AS gram FROM {CARDS}, range(2, 4) m(n), range(1, (SELECT max(length(p_name) + length(p_type) + length(p_brand)) * 2 + 60 FROM part)) r(i)
  WHERE i <= length({TEXT}) - n + 1 AND substr({TEXT}, i::INT, 1) <> ' ' AND substr({TEXT}, (i + n - 1)::INT, 1) <> ' ') AS g"""


@query(f"SELECT gram, count(*) AS n FROM {GRAMS} GROUP BY gram")
def ngram_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(cards(spark, d)).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT id) AS docs, count(DISTINCT gram) FILTER (length(gram) = 2) AS bigrams, count(DISTINCT gram) FILTER (length(gram) = 3) AS trigrams FROM {GRAMS}")
def ngram_stats(spark: SparkSession, d: str) -> DataFrame:
    return search.gram_stats(cards(spark, d))


NEED = {"widget": ["wid", "idg", "dge", "get"], "red": ["red"]}


@query(" UNION ".join(f"SELECT id FROM {GRAMS} WHERE gram IN ({', '.join(repr(x) for x in g)}) GROUP BY id HAVING count(*) = {len(g)}" for g in NEED.values()))
def ngram_candidates(spark: SparkSession, d: str) -> DataFrame:
    only = sorted({g for found in search.wanted(list(NEED)).values() for g in found})
    return search.candidates(search.postings(cards(spark, d), only), list(NEED))


@query(f"SELECT id FROM {CARDS} WHERE contains({TEXT}, 'bolt')")
def ngram_equals_contains(spark: SparkSession, d: str) -> DataFrame:
    """The prefilter's candidates, verified: the same as a plain scan, in one pass."""
    found = search.prefiltered(cards(spark, d), ["bolt"])
    return found.where(tx.has(search.indexed(found), "bolt")).select("id")


@query(f"SELECT id FROM {CARDS} WHERE contains({TEXT}, 'z') OR contains({TEXT}, 'o')")
def ngram_short_query(spark: SparkSession, d: str) -> DataFrame:
    """A query of one character passes the prefilter whole; the scan decides."""
    found = search.prefiltered(cards(spark, d), ["z", "o"])
    return found.where(tx.has(search.indexed(found), "z") | tx.has(search.indexed(found), "o")).select("id")


@query(f"""WITH items AS (SELECT 'view' AS kind, r_name AS label, lower(r_name) AS hay, r_regionkey::BIGINT AS ord FROM region
    UNION ALL SELECT 'rule', category, lower(topic || ' ' || category), rule FROM {SCENARIOS}
    UNION ALL SELECT 'card', title, lower(title || ' ' || topic), id FROM {CARDS})
  SELECT kind, label, ord, (CASE kind WHEN 'view' THEN 30 WHEN 'rule' THEN 20 ELSE 10 END + CASE WHEN contains(lower(label), 'red') THEN 50 ELSE 0 END) AS score FROM items
  WHERE contains(hay, 'red') OR contains(hay, 'crimson') OR contains(hay, 'america') ORDER BY score DESC, kind, ord LIMIT 60""")
def palette_search(spark: SparkSession, d: str) -> DataFrame:
    return search.palette(palette_items(spark, d), ["red", "crimson", "america"], KINDS).select("kind", "label", "ord", "score")


KINDS = {"view": 30, "rule": 20, "card": 10}


def palette_items(spark: SparkSession, d: str) -> DataFrame:
    views = table(spark, d, "region").select(F.lit("view").alias("kind"), F.col("r_name").alias("label"), F.lower("r_name").alias("haystack"), F.col("r_regionkey").cast("long").alias("ord"))
    rules = scenarios(spark, d).select(F.lit("rule").alias("kind"), F.col("category").alias("label"), F.concat_ws(" ", "topic", "category").alias("haystack"), F.col("rule").cast("long").alias("ord"))
    nodes = cards(spark, d).select(F.lit("card").alias("kind"), F.col("title").alias("label"), F.concat_ws(" ", "title", "topic").alias("haystack"), F.col("id").alias("ord"))
    return views.unionByName(rules).unionByName(nodes)


@query(f"""SELECT * FROM (SELECT 'view' AS kind, r_name AS label, r_regionkey::BIGINT AS ord, 30 AS score FROM region UNION ALL
  SELECT 'rule', category, rule, 20 FROM (SELECT * FROM {SCENARIOS} ORDER BY rule LIMIT 12)) ORDER BY score DESC, kind, ord LIMIT 60""")
def palette_empty(spark: SparkSession, d: str) -> DataFrame:
    """Without a query: all views and twelve scenarios."""
    return search.palette(palette_items(spark, d), [], KINDS).select("kind", "label", "ord", "score")


@query(f"SELECT id, regexp_replace(regexp_replace(title, '(widget|red)', '<mark>\\1</mark>', 'gi'), 'zz', '') AS marked FROM {CARDS}")
def search_highlight(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d).select("id", tx.highlight(F.col("title"), ["red", "widget"]).alias("marked"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM documents""")
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.escape_html(F.col("text")).cast("binary")).alias("digest"))


LIVE = f"(SELECT * FROM {CARDS} WHERE topic NOT IN ('Brand#13') AND (NOT obsolete OR coalesce(effective, '') <> '')) AS live"


@query(f"SELECT id, topic, klass FROM {LIVE}")
def load_filter(spark: SparkSession, d: str) -> DataFrame:
    return catalog.visible(cards(spark, d), c.HIDDEN_TOPICS).select("id", "topic", "klass")


@query(f"SELECT id, row_number() OVER (ORDER BY {place('topic', -1)}, klass, ord <= 0, ord, id)::INT AS pos FROM {CARDS}")
def load_order(spark: SparkSession, d: str) -> DataFrame:
    """One order over all cards, by ranges and offsets."""
    return places(cards(spark, d), [], catalog.load_order(c.TOPIC_ORDER)).select("id", "pos")


BROWSE = f"{place('topic', 99)}, {place('klass', 99)}, CASE WHEN klass = 'PROMO' THEN ord END NULLS LAST, ord NULLS LAST, load_ord"


@query(f"SELECT id, row_number() OVER (ORDER BY {BROWSE})::INT AS pos FROM {LIVE}")
def browse_order(spark: SparkSession, d: str) -> DataFrame:
    """The topic's rank leads, unknown topics come last."""
    rows = catalog.visible(cards(spark, d), c.HIDDEN_TOPICS)
    return places(rows, [], catalog.browse_order(c.TOPIC_ORDER, c.CLASS_ORDER, "PROMO")).select("id", "pos")


CAT = "CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN {i}" for i, t in enumerate(c.CONCRETE)) + f" ELSE {len(c.CONCRETE)} END"
GROUPED = f"{place('topic', 99)}, CASE WHEN klass = 'PROMO' THEN 0 ELSE 1 END, CASE WHEN klass = 'PROMO' THEN 0 ELSE {CAT} END, CASE WHEN klass = 'PROMO' THEN 0 ELSE {place('klass', 99)} END, ord NULLS LAST, load_ord"


@query(f"SELECT id, {CAT} AS category, row_number() OVER (ORDER BY {GROUPED})::INT AS pos FROM {LIVE}")
def grouped_order(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.visible(cards(spark, d), c.HIDDEN_TOPICS).withColumn("category", catalog.first_category(c.CONCRETE))
    return places(rows, [], catalog.grouped_order(c.TOPIC_ORDER, c.CLASS_ORDER, "PROMO", F.col("category"))).select("id", "category", "pos")


@query(f"""SELECT id, pos, (SELECT count(*) FROM {LIVE}) AS of, 'shown ' || least(pos, (SELECT count(*) FROM {LIVE})) || ' of ' || (SELECT count(*) FROM {LIVE}) AS shown
  FROM (SELECT id, row_number() OVER (ORDER BY {BROWSE})::INT AS pos FROM {LIVE}) WHERE pos % 30 = 0""")
def shown_of_total(spark: SparkSession, d: str) -> DataFrame:
    """After each chunk of thirty cards, how many are shown, and of how many."""
    rows = catalog.visible(cards(spark, d), c.HIDDEN_TOPICS)
    total = rows.agg(F.count("*")).scalar()
    ordered = places(rows, [], catalog.browse_order(c.TOPIC_ORDER, c.CLASS_ORDER, "PROMO")).where("pos % 30 = 0").withColumn("of", total)
    return ordered.select("id", "pos", "of", F.concat_ws(" ", F.lit("shown"), F.col("pos").cast("string"), F.lit("of"), F.col("of").cast("string")).alias("shown"))


@query(f"""WITH k AS (SELECT *, {CAT} AS category FROM {LIVE})
  SELECT id, coalesce(lag(category) OVER w <> category, true) AS header, count(*) OVER (PARTITION BY topic, category) AS of_key FROM k WINDOW w AS (PARTITION BY topic ORDER BY {GROUPED})""")
def group_headers(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.visible(cards(spark, d), c.HIDDEN_TOPICS).withColumn("category", catalog.first_category(c.CONCRETE))
    return catalog.headers(rows, "category", catalog.grouped_order(c.TOPIC_ORDER, c.CLASS_ORDER, "PROMO", F.col("category")), ["topic"]).select("id", "header", "of_key")


@query(f"SELECT id, pos FROM (SELECT id, row_number() OVER (PARTITION BY topic ORDER BY {BROWSE})::INT AS pos FROM {LIVE} WHERE topic = 'Brand#4') WHERE pos BETWEEN 4 AND 6")
def page_of_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = QuerySpec(topic="Brand#4", show_obsolete=True).apply(catalog.visible(cards(spark, d), c.HIDDEN_TOPICS), c.CONCRETE, c.RESIDUAL)
    rows = catalog.numbered(rows, catalog.browse_order(c.TOPIC_ORDER, c.CLASS_ORDER, "PROMO"), ["topic"])
    return catalog.page(rows, "pos", 1, 3).select("id", "pos")


@query(f"SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after, row_number() OVER w AS place, count(*) OVER (PARTITION BY topic) AS of FROM {LIVE} WINDOW w AS (PARTITION BY topic ORDER BY ord, id)")
def card_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = catalog.neighbours(catalog.visible(cards(spark, d), c.HIDDEN_TOPICS), [F.col("ord"), F.col("id")], ["topic"])
    return rows.select("id", "before", "after", F.col("place").cast("long").alias("place"), "of")


@query(f"SELECT count(DISTINCT topic) > 1 AS topic, count(DISTINCT klass) > 1 AS klass, count(DISTINCT ord) > 1 AS ord, count(DISTINCT coalesce(effective, '-')) > 1 AS effective FROM {CARDS} WHERE id IN (7, 3, 11)")
def compare_diff(spark: SparkSession, d: str) -> DataFrame:
    return catalog.differs(catalog.compared(cards(spark, d), [7, 3, 11]), ["topic", "klass", "ord", "effective"])


@query(f"SELECT id, title, CASE id WHEN 7 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS place FROM {CARDS} WHERE id IN (7, 3, 11)")
def compare_set(spark: SparkSession, d: str) -> DataFrame:
    return catalog.compared(cards(spark, d), [7, 3, 11]).select("id", "title", "place")


@query(f"SELECT count(*) AS n, min(id) AS first_id FROM {CARDS} WHERE NOT obsolete AND topic = 'Brand#4' AND list_contains(tags, 'red')")
def facet_equality(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(topic="Brand#4", klass="PROMO", tag="red", category="red").without("klass")
    return spec.apply(cards(spark, d), c.CONCRETE, c.RESIDUAL).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(f"SELECT count(*) AS n FROM {CARDS} WHERE NOT obsolete AND topic = 'Brand#2' AND klass = 'PROMO'")
def drill_up(spark: SparkSession, d: str) -> DataFrame:
    spec = QuerySpec(topic="Brand#2", klass="PROMO", category="bolt", tag="red", query="x").drill_up("klass")
    return spec.apply(cards(spark, d), c.CONCRETE, c.RESIDUAL).agg(F.count("*").alias("n"))


@query(f"WITH r AS (SELECT * FROM {CARDS} WHERE NOT obsolete AND klass = 'PROMO') SELECT topic AS value, count(*) AS n FROM r GROUP BY topic UNION ALL SELECT NULL, count(*) FROM r")
def facet_disjunctive(spark: SparkSession, d: str) -> DataFrame:
    return facets.counts(cards(spark, d), QuerySpec(topic="Brand#4", klass="PROMO"), "topic", c.CONCRETE, c.RESIDUAL)


@query(f"WITH r AS (SELECT * FROM {CARDS} WHERE NOT obsolete AND topic = 'Brand#4') SELECT klass AS value, count(*) AS n FROM r WHERE klass IN ('STANDARD', 'PROMO', 'SMALL', 'MEDIUM') GROUP BY klass UNION ALL SELECT NULL, count(*) FROM r")
def facet_class(spark: SparkSession, d: str) -> DataFrame:
    return facets.counts(cards(spark, d), QuerySpec(topic="Brand#4", klass="PROMO"), "klass", c.CONCRETE, c.RESIDUAL, c.CLASS_ORDER)


@query(f"""WITH r AS (SELECT * FROM {CARDS} WHERE NOT obsolete AND topic = 'Brand#4'), f AS (SELECT id, unnest(list_distinct(list_filter(tags, lambda x: x IN ('red', 'blue', 'small', 'widget', 'bolt')))) AS value FROM r)
  SELECT value, count(*) AS n FROM f GROUP BY value UNION ALL SELECT 'other', count(*) FROM r WHERE id NOT IN (SELECT id FROM f) HAVING count(*) > 0 UNION ALL SELECT NULL, count(*) FROM r""")
def facet_residual(spark: SparkSession, d: str) -> DataFrame:
    return facets.counts(cards(spark, d), QuerySpec(topic="Brand#4", category="other"), "category", c.CONCRETE, c.RESIDUAL)


@query(f"SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(tags)) AS value FROM {CARDS} WHERE NOT obsolete) WHERE value NOT IN ('red', 'blue', 'small', 'widget', 'bolt') GROUP BY value ORDER BY n DESC, value LIMIT 8")
def tag_top8(spark: SparkSession, d: str) -> DataFrame:
    return facets.tags(QuerySpec().apply(cards(spark, d), c.CONCRETE, c.RESIDUAL), c.CONCRETE)


@query(f"""WITH n AS (SELECT topic AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, topic)::INT AS place FROM {CARDS} WHERE NOT obsolete GROUP BY topic)
  SELECT value, n, place, (SELECT count(*) FROM n WHERE NOT (place <= 6 OR value = 'Brand#1')) AS hidden FROM n WHERE place <= 6 OR value = 'Brand#1'""")
def facet_topk_selected(spark: SparkSession, d: str) -> DataFrame:
    n = facets.counts(cards(spark, d), QuerySpec(), "topic", c.CONCRETE, c.RESIDUAL).where("value IS NOT NULL")
    return facets.shortened(n, 6, "Brand#1")


RULES = SCENARIOS
RELEVANT = f"""(SELECT rule, id, ctopic, rtopic, CASE WHEN p THEN 1000 + s ELSE s + sp END AS score FROM (
  SELECT rule, id, cards.topic AS ctopic, rules.topic AS rtopic, list_contains(primary_ids, id) AS p, len(list_filter(cards.tags, lambda x: list_contains(rules.tags, x))) AS s,
  len(list_filter(cards.tags, lambda x: list_contains(rules.tags, x) AND x NOT IN ('small', 'large'))) AS sp,
  category NOT IN ('red', 'blue', 'small', 'widget', 'bolt') OR list_contains(cards.tags, category) AS carried FROM {CARDS}, {RULES}) WHERE p OR (s >= 2 AND sp >= 1 AND carried)) AS rel"""


@query(f"SELECT rule, id, score FROM {RELEVANT}")
def scenario_scores(spark: SparkSession, d: str) -> DataFrame:
    return scenario.scored(cards(spark, d), scenarios(spark, d), c.GENERIC, c.CONCRETE)


@query(f"SELECT rule, (SELECT count(*) FROM {RELEVANT} WHERE rel.rule = rules.rule AND ctopic = rtopic) AS n FROM {RULES}")
def scenario_counts(spark: SparkSession, d: str) -> DataFrame:
    return scenario.match_counts(cards(spark, d), scenarios(spark, d), c.GENERIC, c.CONCRETE)


LISTED = [f"Brand#{i}" for i in range(1, 21)]


@query(f"SELECT rule FROM {RULES} WHERE NOT deprecated AND coalesce(source, '') <> 'auto' AND topic IN ({', '.join(map(repr, LISTED))}) AND contains(lower(array_to_string(tags, ' ') || ' ' || topic || ' ' || category), 'd')")
def scenario_list(spark: SparkSession, d: str) -> DataFrame:
    return scenario.listed(scenarios(spark, d), LISTED, "D").select("rule")


@query(f"""SELECT topic, category, rules, place, place = min(place) OVER (PARTITION BY topic) AS first FROM (SELECT topic, category, string_agg(rule::VARCHAR, ',' ORDER BY rule NOT IN (43, 123), rule) AS rules,
  row_number() OVER (ORDER BY {place('topic', 99)}, topic, CASE category {" ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(c.CONCRETE))} ELSE 99 END, category)::INT AS place FROM {RULES} GROUP BY topic, category)""")
def scenario_sections(spark: SparkSession, d: str) -> DataFrame:
    return scenario.sections(scenarios(spark, d), c.TOPIC_ORDER, c.CONCRETE, [43, 123])


@query(f"SELECT topic, category, count(*) AS n FROM {RULES} WHERE NOT deprecated GROUP BY topic, category")
def scenario_facets(spark: SparkSession, d: str) -> DataFrame:
    return scenarios(spark, d).where(~F.col("deprecated")).groupBy("topic", "category").agg(F.count("*").alias("n"))


@query(f"SELECT rule, CASE WHEN rule % 3 = 0 THEN 'detail ' || rule ELSE topic END AS topic, category FROM {RULES}")
def scenario_merge(spark: SparkSession, d: str) -> DataFrame:
    light = scenarios(spark, d).select("rule", "topic", "category")
    detail = scenarios(spark, d).where("rule % 3 = 0").select("rule", F.concat(F.lit("detail "), F.col("rule").cast("string")).alias("topic"))
    return overlaid(light, detail, "rule")


@query(f"SELECT rule AS id, row_number() OVER (PARTITION BY rule ORDER BY p)::INT AS place, other FROM (SELECT rule, unnest(primary_ids) AS other, generate_subscripts(primary_ids, 1) AS p FROM {RULES}) WHERE other IN (SELECT p_partkey FROM part)")
def scenario_primary(spark: SparkSession, d: str) -> DataFrame:
    lists = scenarios(spark, d).select(F.col("rule").alias("id"), F.col("primary_ids").alias("related"))
    return graph.related(lists, cards(spark, d))


@query(f"""WITH e AS (SELECT * FROM {CITATIONS} WHERE dst IN (SELECT p_partkey FROM part))
  SELECT dst, src, place, total FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY src)::INT AS place, count(*) OVER (PARTITION BY dst) AS total FROM e) WHERE place <= 6""")
def edges_incoming_top6(spark: SparkSession, d: str) -> DataFrame:
    return graph.incoming(citations(spark, d), cards(spark, d))


@query(f"SELECT id, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {CITATIONS} UNION ALL SELECT dst, 0, 1 FROM {CITATIONS}) GROUP BY id")
def edge_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(citations(spark, d))


HREFS = "(SELECT page_id AS src, unnest(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1)) AS dst FROM pages) AS h"


@query(f"SELECT src, dst, count(*) AS n FROM {HREFS} GROUP BY src, dst")
def edges_inferred(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select(F.col("page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("dst"))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH m AS (SELECT DISTINCT src, dst FROM {HREFS} WHERE length(dst) % 2 = 0) SELECT src, dst, false AS inferred FROM m UNION ALL SELECT src, dst, true FROM (SELECT DISTINCT src, dst FROM {HREFS}) h ANTI JOIN m USING (src, dst)")
def edges_dedup_anti(spark: SparkSession, d: str) -> DataFrame:
    found = edges_inferred(spark, d).select("src", "dst")
    return graph.merged(found.where("length(dst) % 2 = 0"), found)


@query(f"SELECT src, dst, s.p_brand IS DISTINCT FROM 'Brand#4' OR t.p_brand IS DISTINCT FROM 'Brand#4' AS across FROM {CITATIONS} LEFT JOIN part s ON src = s.p_partkey LEFT JOIN part t ON dst = t.p_partkey WHERE s.p_brand = 'Brand#4' OR t.p_brand = 'Brand#4'")
def topic_subgraph(spark: SparkSession, d: str) -> DataFrame:
    return graph.topic_subgraph(citations(spark, d), cards(spark, d), "Brand#4")


RELATED = "(SELECT DISTINCT l_orderkey % 500 AS src, l_partkey AS dst, CASE WHEN l_quantity >= 45 THEN 'cites' ELSE 'explains' END AS relation FROM lineitem) AS related"


@query(f"""WITH c AS (SELECT * FROM {RELATED} WHERE relation = 'cites') SELECT src, dst, s.p_brand IS DISTINCT FROM 'Brand#4' OR t.p_brand IS DISTINCT FROM 'Brand#4' AS across
  FROM c LEFT JOIN part s ON src = s.p_partkey LEFT JOIN part t ON dst = t.p_partkey WHERE s.p_brand = 'Brand#4' OR t.p_brand = 'Brand#4'
  UNION ALL SELECT p_partkey, NULL, false FROM part WHERE p_brand = 'Brand#4' AND p_partkey NOT IN (SELECT src FROM c) AND p_partkey NOT IN (SELECT dst FROM c)""")
def topic_subgraph_toggled(spark: SparkSession, d: str) -> DataFrame:
    """One relation only, and the topic's nodes that are left without an edge."""
    edges = table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_quantity") >= 45, "cites").otherwise("explains").alias("relation")).distinct()
    return graph.topic_subgraph(edges, cards(spark, d), "Brand#4", ["cites"], isolated_too=True)


@query(f"SELECT id, klass FROM {CARDS} WHERE NOT obsolete AND topic = (SELECT topic FROM {CARDS} WHERE id = 7)")
def widening_jump(spark: SparkSession, d: str) -> DataFrame:
    """A node is opened from a narrow selection: all of its topic is shown, without the other predicates."""
    rows = cards(spark, d)
    spec = QuerySpec(topic="Brand#1", klass="PROMO", tag="red", category="bolt", query="x", scenario="3")
    opened = spec.focus(rows.where("id = 7").first()["topic"])
    return opened.apply(rows, c.CONCRETE, c.RESIDUAL).select("id", "klass")


SPARSE = "(SELECT DISTINCT l_orderkey % 500 AS src, l_partkey AS dst FROM lineitem WHERE l_quantity >= 45) AS sparse"


@query(f"SELECT id FROM {CARDS} WHERE id NOT IN (SELECT src FROM {SPARSE}) AND id NOT IN (SELECT dst FROM {SPARSE})")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Cards that no citation of large orders touches."""
    few = table(spark, d, "lineitem").where("l_quantity >= 45").select((F.col("l_orderkey") % 500).alias("src"), F.col("l_partkey").alias("dst"))
    return graph.isolated(cards(spark, d), few).select("id")


@query(f"""SELECT 'nodes' AS what, NULL::VARCHAR AS value, count(*) AS n FROM {CARDS} UNION ALL SELECT 'edges', NULL, count(*) FROM {CITATIONS}
  UNION ALL SELECT 'status', CASE WHEN obsolete THEN 'obsolete' ELSE 'current' END, count(*) FROM {CARDS} GROUP BY 2 UNION ALL SELECT 'klass', klass, count(*) FROM {CARDS} GROUP BY 2""")
def index_meta(spark: SparkSession, d: str) -> DataFrame:
    """What an index says of itself: numbers of nodes and edges, and of nodes by status and class."""
    rows = cards(spark, d).withColumn("status", F.when(F.col("obsolete"), "obsolete").otherwise("current"))
    return graph.status_counts(rows, citations(spark, d), ["status", "klass"])


@query(f"""SELECT t.doc_id AS src, c.c_custkey AS dst, m.matched FROM (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all('see No. ' || (doc_id % 40) || ' and No. 7; ' || text, 'No\\. [0-9]+'))) AS matched FROM documents) m
  JOIN documents t USING (doc_id) JOIN (SELECT c_custkey, ['en', 'de', 'fr', 'es'][1 + c_custkey % 4] AS lang, c_custkey % 50 AS number FROM customer WHERE c_custkey < 400) c
  ON c.lang = t.lang AND c.number = regexp_extract(m.matched, 'No\\. ([0-9]+)', 1)::INT AND c.c_custkey <> t.doc_id""")
def edges_cited_in_topic(spark: SparkSession, d: str) -> DataFrame:
    """Citations by number, resolved among the nodes of the text's own topic (here its language)."""
    body = F.concat(F.lit("see No. "), (F.col("doc_id") % 40).cast("string"), F.lit(" and No. 7; "), F.col("text"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("topic"), body.alias("body"))
    langs = F.array(*map(F.lit, ["en", "de", "fr", "es"]))
    nodes = table(spark, d, "customer").where("c_custkey < 400").select(F.col("c_custkey").alias("id"), F.get(langs, (F.col("c_custkey") % 4).cast("int")).alias("topic"), (F.col("c_custkey") % 50).alias("number"))
    return graph.cited(texts, nodes, r"No\. ([0-9]+)")


#: Numbers below a hundred in words, for both engines: {n} is the number.
WORDED = "concat(CASE WHEN {n} >= 20 THEN substr('一二三四五六七八九', CAST(floor({n} / 10) AS INT), 1) ELSE '' END, CASE WHEN {n} >= 10 THEN '十' ELSE '' END, CASE WHEN {n} % 10 > 0 THEN substr('一二三四五六七八九', CAST({n} % 10 AS INT), 1) ELSE '' END)"
#: What a text cites, by its id: an article with or without a number below it, an item, and a question.
BODY = f"concat('see 第', {WORDED.format(n='(1 + doc_id % 40)')}, '條', CASE WHEN doc_id % 3 = 0 THEN concat('之', {WORDED.format(n='(1 + doc_id % 4)')}) ELSE '' END, ', item ', 1 + doc_id % 30, ' and Q', 1 + doc_id % 25, '; ', coalesce(text, ''))"
NODES = "(SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' ELSE 'es' END AS topic, CASE c_custkey % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'item' ELSE 'question' END AS kind, 1 + c_custkey % 50 AS number, CASE WHEN c_custkey % 6 = 0 THEN c_custkey % 5 ELSE 0 END AS sub FROM customer) AS nodes"


@query(f"""WITH t AS (SELECT doc_id AS src, lang AS topic, doc_id, {BODY} AS body FROM documents),
  m AS (SELECT src, topic, 'article' AS kind, regexp_extract(body, '第[一二三四五六七八九十]+條(之[一二三四五六七八九十]+)?', 0) AS matched, 1 + doc_id % 40 AS number, CASE WHEN doc_id % 3 = 0 THEN 1 + doc_id % 4 ELSE 0 END AS sub FROM t
    UNION ALL SELECT src, topic, 'item', 'item ' || (1 + doc_id % 30), 1 + doc_id % 30, 0 FROM t UNION ALL SELECT src, topic, 'question', 'Q' || (1 + doc_id % 25), 1 + doc_id % 25, 0 FROM t)
  SELECT src, id AS dst, m.kind, matched FROM m JOIN {NODES} USING (topic, kind, number, sub) WHERE src <> id""")
def edges_cited_forms(spark: SparkSession, d: str) -> DataFrame:
    """Articles (maybe with a number below), items and questions, each looked up in its class."""
    texts = table(spark, d, "documents").selectExpr("doc_id AS id", "lang AS topic", f"{BODY} AS body")
    nodes = spark.sql("SELECT * FROM " + NODES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer"))
    forms = {"article": "(第[一二三四五六七八九十]+條(?:之[一二三四五六七八九十]+)?)", "item": "item ([0-9]+)", "question": r"\bQ([0-9]+)"}
    return graph.cited_forms(texts, nodes, forms)


@query(f"""WITH k AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS number, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN p_partkey % 9 + 1 ELSE 0 END AS sub, CASE WHEN p_partkey % 7 = 0 THEN p_name ELSE '' END AS text FROM part)
  SELECT id, number::INT AS number, sub::INT AS sub, row_number() OVER (ORDER BY number NULLS LAST, sub, text, id)::INT AS pos FROM k""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Labels with numerals, digits, numbers below, or none of them, in the order of what they say."""
    below = f"CASE WHEN p_partkey % 3 = 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN '之' ELSE '-' END, {WORDED.format(n='(p_partkey % 9 + 1)')}) ELSE '' END"
    label = f"CASE WHEN p_partkey % 7 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN concat('第', {WORDED.format(n='p_size')}, '條', {below}) ELSE concat(p_size, {below}) END"
    rows = table(spark, d, "part").selectExpr("p_partkey AS id", f"{label} AS label").withColumn("key", values_.natural_key(F.col("label")))
    placed = places(rows, [], [*values_.natural_order("key"), F.col("id")])
    return placed.select("id", "key.number", "key.sub", "pos")


NEXT = "CASE WHEN id % 150 = 0 THEN NULL WHEN id % 450 = 100 THEN id + 5 ELSE id - 1 END"


@query(f"""WITH RECURSIVE p AS (SELECT p_partkey AS id, max(p_partkey) OVER () AS most FROM part), n AS (SELECT id, {NEXT} AS next FROM p),
  w(id, last, steps) AS (SELECT id, id, 0 FROM n UNION ALL SELECT w.id, n.next, w.steps + 1 FROM w JOIN n ON w.last = n.id WHERE n.next IS NOT NULL AND w.steps < 400),
  f AS (SELECT id, max_by(last, steps) AS last, max(steps)::BIGINT AS steps, max(steps) >= 400 AS cycle FROM w GROUP BY id)
  SELECT id, CASE WHEN NOT cycle THEN last END AS last, CASE WHEN NOT cycle THEN steps END AS steps, cycle FROM f""")
def replacement_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each part is replaced by the one before, up to 149 steps; some point onward and so make a cycle, into which others lead."""
    return graph.chains(table(spark, d, "part").select(F.col("p_partkey").alias("id")).selectExpr("id", f"{NEXT} AS next"))


@query(f"""WITH RECURSIVE walk AS (SELECT DISTINCT flow, 'q0' AS question, ['q0'] AS seen, 'q0' AS path, 0 AS depth, NULL::VARCHAR AS conclude FROM {FLOWS_SQL} UNION ALL
  SELECT w.flow, e.next, list_append(w.seen, e.next), w.path || '>' || e.opt || coalesce('>' || e.next, ''), w.depth + 1, e.conclude FROM walk w JOIN {FLOWS_SQL} ON w.flow = e.flow AND w.question = e.question WHERE e.next IS NULL OR NOT list_contains(w.seen, e.next))
  SELECT flow, path, depth, conclude FROM walk WHERE conclude IS NOT NULL""")
def flow_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = flows(spark, d)
    return graph.flow_paths(edges.select("flow", F.lit("q0").alias("question")).distinct(), edges)


@query(f"""WITH RECURSIVE walk AS (SELECT DISTINCT flow, 'q0' AS question, 0 AS depth FROM {FLOWS_SQL} UNION SELECT w.flow, e.next, w.depth + 1 FROM walk w JOIN {FLOWS_SQL} ON w.flow = e.flow AND w.question = e.question WHERE e.next IS NOT NULL AND w.depth < 30)
  SELECT flow, 'question' AS kind, question AS name, min(depth)::INT AS depth FROM walk GROUP BY ALL
  UNION ALL SELECT w.flow, 'conclusion', e.conclude, (min(w.depth) + 1)::INT FROM walk w JOIN {FLOWS_SQL} ON w.flow = e.flow AND w.question = e.question WHERE e.conclude IS NOT NULL GROUP BY ALL""")
def flow_reach(spark: SparkSession, d: str) -> DataFrame:
    """What can be reached from each flow's first question, and in how few steps."""
    edges = flows(spark, d)
    return graph.flow_reach(edges.select("flow", F.lit("q0").alias("question")).distinct(), edges)


@query(f"""WITH f AS (SELECT * FROM {FLOWS_SQL}), k AS (SELECT * FROM {CONCLUSIONS}) SELECT DISTINCT 'question' AS kind, flow, next AS name FROM f WHERE next IS NOT NULL AND (flow, next) NOT IN (SELECT (flow, question) FROM f)
  UNION ALL SELECT DISTINCT 'conclusion', flow, conclude FROM f WHERE conclude IS NOT NULL AND (flow, conclude) NOT IN (SELECT (flow, conclude) FROM k)
  UNION ALL SELECT DISTINCT 'unreached', flow, conclude FROM k WHERE (flow, conclude) NOT IN (SELECT (flow, conclude) FROM f WHERE conclude IS NOT NULL)""")
def flow_faults(spark: SparkSession, d: str) -> DataFrame:
    return graph.flow_faults(flows(spark, d), flow_conclusions(spark, d))


@query(f"SELECT k.flow, k.conclude, k.redirect, s.question AS restart FROM {CONCLUSIONS} LEFT JOIN (SELECT DISTINCT flow, 'q0' AS question FROM {FLOWS_SQL}) s ON k.redirect = s.flow")
def flow_redirects(spark: SparkSession, d: str) -> DataFrame:
    starts = flows(spark, d).select(F.col("flow").alias("redirect"), F.lit("q0").alias("restart")).distinct()
    return flow_conclusions(spark, d).join(starts, "redirect", "left").select("flow", "conclude", "redirect", "restart")


@query("SELECT p_partkey AS id, k::INT AS pos, 'v' || (p_size - k) AS version, k = 0 AS latest FROM part, range(3) r(k) WHERE k <= p_size % 3")
def version_history(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    v = F.transform(F.sequence(F.lit(0), F.col("p_size") % 3), lambda k: F.concat(F.lit("v"), (F.col("p_size") - k).cast("string")))
    return graph.history(p.select(F.col("p_partkey").alias("id"), v.alias("versions")))


@query(f"""SELECT id, coalesce(title, id::VARCHAR) AS title, topic, CASE klass WHEN 'PROMO' THEN 'Promotion' WHEN 'STANDARD' THEN 'Standard' ELSE 'Other' END AS label, array_to_string(tags[1:3], '|') AS tags3,
  CASE WHEN obsolete AND effective IS NOT NULL THEN 'limited' WHEN obsolete THEN 'obsolete' ELSE 'current' END AS badge, CASE WHEN klass = 'PROMO' THEN 'No. ' || ord || ' ' || title ELSE title END AS display FROM {CARDS}""")
def card_projection(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("klass") == "PROMO", "Promotion").when(F.col("klass") == "STANDARD", "Standard").otherwise("Other")
    badge = F.when(F.col("obsolete") & F.col("effective").isNotNull(), "limited").when(F.col("obsolete"), "obsolete").otherwise("current")
    display = F.concat_ws(" ", F.when(F.col("klass") == "PROMO", F.concat(F.lit("No. "), F.col("ord").cast("string"))), F.col("title"))
    return cards(spark, d).select("id", F.coalesce("title", F.col("id").cast("string")).alias("title"), "topic", label.alias("label"), F.array_join(F.slice("tags", 1, 3), "|").alias("tags3"), badge.alias("badge"), display.alias("display"))


@query(f"SELECT rule, title, items FROM {RULES} LEFT JOIN {values(c.BASELINES, 'b(category, title, items)')} USING (category)")
def scenario_baseline(spark: SparkSession, d: str) -> DataFrame:
    base = spark.createDataFrame(c.BASELINES, "category string, title string, items int")
    return scenarios(spark, d).join(base, "category", "left").select("rule", "title", "items")


@query(f"SELECT faq, q, rule, topic FROM {values(c.FAQS, 'f(faq, q, rule)')} JOIN {RULES} USING (rule)")
def faq_navigation(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(c.FAQS, "faq int, q string, rule int").join(scenarios(spark, d), "rule").select("faq", "q", "rule", "topic")


@query(f"SELECT flow, conclude, ref, p_name AS title FROM (SELECT flow, conclude, unnest(refs) AS ref FROM {values(c.REFERENCES, 'r(flow, conclude, refs)')}) LEFT JOIN part ON ref = p_partkey")
def conclusion_refs(spark: SparkSession, d: str) -> DataFrame:
    """References stay even if nothing answers to them."""
    refs = spark.createDataFrame(c.REFERENCES, "flow string, conclude string, refs array<long>").select("flow", "conclude", F.explode("refs").alias("ref"))
    return refs.join(cards(spark, d).select(F.col("id").alias("ref"), "title"), "ref", "left").select("flow", "conclude", "ref", "title")


@query(f"SELECT rule, CASE category WHEN 'red' THEN 'crimson list' WHEN 'bolt' THEN 'fasteners' ELSE category END AS label FROM {RULES}")
def label_rename(spark: SparkSession, d: str) -> DataFrame:
    table_ = F.create_map(*[F.lit(x) for kv in c.RENAMED.items() for x in kv])
    return scenarios(spark, d).select("rule", F.coalesce(F.element_at(table_, F.col("category")), "category").alias("label"))


@query(f"SELECT rule, rule % 2 = 1 AND len(subs) > 0 AS root, len(subs)::INT AS n_subs, s.flow IS NOT NULL AS has_flow FROM (SELECT rule, list_filter(primary_ids, lambda x: x % 40 = 3) AS subs FROM {RULES}) LEFT JOIN (SELECT DISTINCT flow FROM {FLOWS_SQL}) s ON s.flow = 'f' || (rule % 20)")
def scenario_roots(spark: SparkSession, d: str) -> DataFrame:
    roots = scenarios(spark, d).select("rule", F.filter("primary_ids", lambda x: x % 40 == 3).alias("subs"), F.concat(F.lit("f"), (F.col("rule") % 20).cast("string")).alias("flow"))
    starts = flows(spark, d).select("flow", F.lit(True).alias("has")).distinct()
    return roots.join(starts, "flow", "left").select("rule", ((F.col("rule") % 2 == 1) & (F.size("subs") > 0)).alias("root"), F.size("subs").alias("n_subs"), F.col("has").isNotNull().alias("has_flow"))


@query(f"SELECT rule, coalesce(source, '') = 'hand' OR category IN ('red', 'cold') OR topic = 'Brand#4' AND category = 'small' AS linked FROM {RULES}")
def calculator_link(spark: SparkSession, d: str) -> DataFrame:
    """A flag, a category that always does, or one that does within a topic."""
    linked = scenario.calculator_link(F.col("source") == "hand", F.col("category"), F.col("topic"), ["red", "cold"], {"Brand#4": ["small"]})
    return scenarios(spark, d).select("rule", linked.alias("linked"))


@query(f"""SELECT s.id, s.score, r.score AS relevance FROM {SCORED} JOIN {RELEVANT} ON s.id = r.id WHERE s.score > 0 AND r.rule = (SELECT min(rule) FROM {RULES}) ORDER BY r.score DESC, s.score DESC, load_ord LIMIT 30""".replace(") AS rel ON", ") AS r ON"))
def relevance_order(spark: SparkSession, d: str) -> DataFrame:
    """Search within a chosen scenario: its score comes first, then the query's, then the load order."""
    one = scenarios(spark, d).orderBy("rule").limit(1)
    relevant = scenario.scored(cards(spark, d), one, c.GENERIC, c.CONCRETE).select("id", F.col("score").alias("relevance"))
    return search.ranked(search.search(cards(spark, d), TERMS, c.WEIGHTS), 30, relevant).select("id", "score", "relevance")


@query("SELECT p_brand AS topic, p_partkey AS id FROM part WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3 OFFSET 3)")
def sections_page(spark: SparkSession, d: str) -> DataFrame:
    """The second three sections: the sections are placed, not the cards."""
    rows = cards(spark, d)
    w = Window.partitionBy("_all").orderBy("topic")
    chosen = rows.select("topic").distinct().withColumn("_all", F.lit(1)).withColumn("_place", F.row_number().over(w)).where("_place BETWEEN 4 AND 6")
    return rows.join(chosen.select("topic"), "topic", "left_semi").select("topic", "id")
