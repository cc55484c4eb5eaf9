"""Citations, inferred edges, chains of replacement, and decision flows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.values import natural_key
from tesserae.operators import ranking
from tesserae.session import ensure_checkpoint_dir


def incoming(edges: DataFrame, nodes: DataFrame, k: int = 6) -> DataFrame:
    """dst, src, place, total: the first k citing nodes of each cited one that exists; dangling edges drop out. Edges are distinct.

    Places up to k are cut off in each task before rows are dealt out, and counts are added up there, so a node that very many cite
    costs no task more than k rows a task.
    """
    live = edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    first = live.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("src"))).where(F.col("place") <= k)
    total = live.groupBy("dst").agg(F.count("*").alias("total"))
    return first.join(total, "dst").select("dst", "src", "place", "total")


def degrees(edges: DataFrame) -> DataFrame:
    """id, n_out, n_in."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    return out.join(into, "id", "full").select("id", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def related(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """lists: id, related (array). Gives id, place, other: in order, without what doesn't exist."""
    one = lists.select("id", F.posexplode("related").alias("_p", "other"))
    return one.join(nodes.select(F.col("id").alias("other")), "other").select("id", (F.col("_p") + 1).alias("place"), "other")


def merged(manual: DataFrame, inferred: DataFrame) -> DataFrame:
    """src, dst, inferred: an inferred edge is kept only where there is no manual one."""
    new = inferred.select("src", "dst").distinct().join(manual.select("src", "dst"), ["src", "dst"], "left_anti")
    return manual.select("src", "dst").distinct().withColumn("inferred", F.lit(False)).unionByName(new.withColumn("inferred", F.lit(True)))


def chains(next_of: DataFrame) -> DataFrame:
    """next_of: id, next (null: current). Gives id, last, steps, cycle.

    Pointer doubling: a round doubles the steps that each row has gone, and is checkpointed, so plans stay short; rows that ended stay out
    of the joins. While any chain is unfinished, some of its rows end in each round; when none does, the rest lead into cycles, which
    have neither a last id nor a number of steps. A next id that has no row is an end.
    """
    ensure_checkpoint_dir(next_of.sparkSession)
    ends = F.col("next").isNull() | (F.col("next") == F.col("id"))
    rows = next_of.select("id", F.coalesce("next", "id").alias("last"), F.when(ends, 0).otherwise(1).cast("long").alias("steps"), ends.alias("ended")).checkpoint()
    before = -1
    while (left := rows.where("NOT ended").count()) not in (0, before):
        before = left
        onward = rows.select(F.col("id").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("ended").alias("_ended"))
        gone = rows.where("NOT ended").join(onward, "last", "left")
        gone = gone.select("id", F.coalesce("_last", "last").alias("last"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_ended", F.lit(True)).alias("ended"))
        rows = rows.where("ended").union(gone).checkpoint()
    known = lambda c: F.when(F.col("ended"), F.col(c)).alias(c)
    return rows.select("id", known("last"), known("steps"), (~F.col("ended")).alias("cycle"))


def flow_paths(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """flow, path, depth, conclude: every way from a start to a conclusion that asks no question twice.

    A step a round, checkpointed, until no way is open; as no question is asked twice, a flow of n questions ends after n rounds.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    walk = starts.select("flow", "question", F.array("question").alias("seen"), F.col("question").alias("path"))
    found, depth = [], 0
    while not depth or not walk.isEmpty():
        depth += 1
        step = walk.join(edges, ["flow", "question"]).where(F.col("next").isNull() | ~F.array_contains("seen", F.col("next")))
        path = F.concat_ws(">", "path", F.col("opt").cast("string"), "next")
        step = step.select("flow", F.col("next").alias("question"), F.concat("seen", F.array("next")).alias("seen"), path.alias("path"), "conclude").checkpoint()
        found.append(step.where("conclude IS NOT NULL").select("flow", "path", F.lit(depth).alias("depth"), "conclude"))
        walk = step.where("question IS NOT NULL").drop("conclude")
    return reduce(DataFrame.union, found)


def flow_reach(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """flow, kind (question or conclusion), name, depth: all that can be reached, and in how few steps. Linear in the flow's options a step,
    however many ways there are.

    Each round meets only the questions that are new; it is checkpointed, and ends when none is.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    new = starts.select("flow", "question").distinct().checkpoint()
    seen, depth = new.withColumn("depth", F.lit(0)), 0
    ends = []
    while not new.isEmpty():
        depth += 1
        step = new.join(edges, ["flow", "question"]).select("flow", "next", "conclude").distinct().checkpoint()
        ends.append(step.where("conclude IS NOT NULL").select("flow", "conclude", F.lit(depth).alias("depth")).distinct())
        asked = step.where("next IS NOT NULL").select("flow", F.col("next").alias("question")).distinct()
        new = asked.join(seen.select("flow", "question"), ["flow", "question"], "left_anti").checkpoint()
        seen = seen.union(new.withColumn("depth", F.lit(depth))).checkpoint()
    questions = seen.select("flow", F.lit("question").alias("kind"), F.col("question").alias("name"), "depth")
    if not ends:
        return questions
    last = reduce(DataFrame.union, ends).groupBy("flow", "conclude").agg(F.min("depth").alias("depth"))
    return questions.union(last.select("flow", F.lit("conclusion"), "conclude", "depth"))


def flow_faults(edges: DataFrame, conclusions: DataFrame) -> DataFrame:
    """kind, flow, name: options that lead nowhere, and conclusions that nothing leads to."""
    questions = edges.select("flow", F.col("question").alias("next")).distinct()
    lost = edges.where("next IS NOT NULL").join(questions, ["flow", "next"], "left_anti").select(F.lit("question").alias("kind"), "flow", F.col("next").alias("name"))
    unknown = edges.where("conclude IS NOT NULL").join(conclusions, ["flow", "conclude"], "left_anti").select(F.lit("conclusion").alias("kind"), "flow", F.col("conclude").alias("name"))
    unreached = conclusions.join(edges, ["flow", "conclude"], "left_anti").select(F.lit("unreached").alias("kind"), "flow", F.col("conclude").alias("name"))
    return lost.union(unknown).union(unreached).distinct()


def topic_subgraph(edges: DataFrame, nodes: DataFrame, topic: str, relations: list[str] | None = None, isolated_too: bool = False) -> DataFrame:
    """src, dst, across: edges with an end in the topic. relations: those that are shown (column relation), else all; isolated_too: the topic's
    nodes without any shown edge come as rows without dst."""
    inside = nodes.where(F.col("topic") == topic).select("id")
    shown = edges if relations is None else edges.where(F.col("relation").isin(relations))
    a, b = inside.select(F.col("id").alias("src"), F.lit(True).alias("_a")), inside.select(F.col("id").alias("dst"), F.lit(True).alias("_b"))
    rows = shown.join(a, "src", "left").join(b, "dst", "left").where("_a OR _b")
    out = rows.select("src", "dst", (F.col("_a").isNull() | F.col("_b").isNull()).alias("across"))
    if not isolated_too:
        return out
    return out.union(isolated(inside, shown).select(F.col("id").alias("src"), F.lit(None).cast(out.schema["dst"].dataType).alias("dst"), F.lit(False)))


def status_counts(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """what, value, n: the numbers of nodes and edges, and of nodes by each of the columns."""
    total = lambda rows, what: rows.agg(F.lit(what).alias("what"), F.lit(None).cast("string").alias("value"), F.count("*").alias("n"))
    parts = [nodes.groupBy(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for c in by]
    return reduce(DataFrame.union, [total(nodes, "nodes"), total(edges, "edges"), *parts])


def _met(found: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """key, matched, src and each dst of the nodes of its key, but src itself. A few keys can have most rows, and the result far more rows than either side.

    So citations of one text and nodes meet as lists of ids, which are dealt out by key and slots and unpacked where they are written. All citations
    of a list are given with the same list of nodes, one after the other: written as Parquet, such runs take a fraction of a byte a row.
    """
    sources = ranking.listed(found, [*key, "matched"], ["src"], "_srcs", 64)
    rows = ranking.lists_met(sources, ranking.listed(nodes, key, ["dst"], "_dsts"), key)
    return rows.select(*key, "matched", "_dsts", F.inline("_srcs")).select(*key, "matched", "src", F.inline("_dsts")).where("src <> dst")


def cited(texts: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """texts: id, topic, body; nodes: id, topic, number. Gives src, dst, matched: citations of a number within the same topic.

    pattern's first group is the number; numbers are looked up among the nodes of the citing text's own topic, and never lead to itself.
    """
    found = texts.select(F.col("id").alias("src"), "topic", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(pattern), F.lit(0)))).alias("matched"))
    found = found.withColumn("number", F.regexp_extract("matched", pattern, 1))
    to = nodes.select(F.col("id").alias("dst"), "topic", F.col("number").cast("string").alias("number"))
    return _met(found, to, ["topic", "number"]).select("src", "dst", "matched")


def cited_forms(texts: DataFrame, nodes: DataFrame, forms: dict[str, str]) -> DataFrame:
    """texts: id, topic, body; nodes: id, topic, kind, number, sub. Gives src, dst, kind, matched: citations in any of the forms.

    forms: by kind a pattern without groups but one, the label. All are searched in one pass, the earlier form first at one place; a label is
    read as a natural key, and looked up among the nodes of its kind in the citing text's own topic, never itself.
    """
    either = "|".join(f"(?:{re.sub(r'(?<!\\)\((?!\?)', '(?:', p)})" for p in forms.values())
    found = texts.select(F.col("id").alias("src"), "topic", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(either), F.lit(0)))).alias("matched"))
    kind, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, p in reversed(forms.items()):
        whole = F.rlike("matched", F.lit(f"^(?:{p})$"))
        kind, label = F.when(whole, k).otherwise(kind), F.when(whole, F.regexp_extract("matched", f"^(?:{p})$", 1)).otherwise(label)
    found = found.withColumn("kind", kind).withColumn("_key", natural_key(label))
    found = found.select("src", "topic", "matched", "kind", F.col("_key.number").alias("number"), F.col("_key.sub").alias("sub")).where("number IS NOT NULL")
    to = nodes.select(F.col("id").alias("dst"), "topic", "kind", "number", "sub")
    return _met(found, to, ["topic", "kind", "number", "sub"]).select("src", "dst", "kind", "matched")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id")))
    return nodes.join(ends, "id", "left_anti")


def history(versions: DataFrame) -> DataFrame:
    """versions: id, versions (array, latest first). A row a version, the latest marked."""
    return versions.select("id", F.posexplode("versions").alias("pos", "version")).withColumn("latest", F.col("pos") == 0)


def ranked_within(rows: DataFrame, key: str, order: list, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
