"""Data quality: violations as rows, completeness, inventories, clean-up, review work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.ranking import containing


def violations(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """rules: name, severity, what is wrong. A row a violation, in one pass; a rule that is null isn't broken."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, bad in rules]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("x")).select("x.rule", "x.severity", "key")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def dangling(refs: DataFrame, ref: str, targets: DataFrame, target: str) -> DataFrame:
    """References to what doesn't exist."""
    return refs.join(targets.select(F.col(target).alias(ref)), ref, "left_anti")


def completeness(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """field, vacant, rate: null or blank values, in one pass."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    one = rows.agg(F.count("*").alias("_n"), *[F.count_if(blank(f)).alias(f) for f in fields])
    listed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("vacant")) for f in fields])
    return one.select("_n", F.explode(listed).alias("x")).select("x.field", "x.vacant", F.when(F.col("_n") > 0, F.round(F.col("x.vacant") / F.col("_n"), 4)).alias("rate"))


def inventory(rows: DataFrame, tags: str, key: str, block: int = 1_000) -> DataFrame:
    """tag, n, block, ids: the tag's count, and its ids in order, cut by their range into lists of `block` ids at most."""
    one = long_inventory(rows, tags, key)
    total = one.groupBy("tag").agg(F.count("*").alias("n"))
    lists = one.groupBy("tag", F.floor(F.col("id") / block).alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return lists.join(total, "tag").select("tag", "n", "block", "ids")


def long_inventory(rows: DataFrame, tags: str, key: str) -> DataFrame:
    """tag, id."""
    return rows.select(F.explode(F.array_distinct(tags)).alias("tag"), F.col(key).alias("id"))


def line_dedup(text: Column) -> Column:
    """A text without lines that repeat an earlier one; order kept."""
    return F.array_join(F.array_distinct(F.split(text, "\n")), "\n")


def title_defect(title: Column, least: int, most: int, boilerplate: Sequence[str]) -> Column:
    """The first defect, or null."""
    lower = F.lower(F.trim(title))
    return F.when(title.isNull() | (F.length(lower) < least), "short").when(lower.isin([b.lower() for b in boilerplate]), "boilerplate").when(F.length(lower) > most, "long")


def batches(rows: DataFrame, key: str, n: int = 16, salt: int = 7) -> DataFrame:
    """Work in n batches of nearly equal size by a hash that other engines have too: no order over all rows is needed."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.withColumn("batch", (number % n).cast("int"))


def reviewed(rows: DataFrame, verdicts: DataFrame, key: str, force: bool = False) -> DataFrame:
    """verdicts: key, verdict (pass, fix, flag), value. A fix replaces the value; what a person has reviewed only if forced."""
    open_ = F.lit(True) if force else ~F.coalesce(F.col("reviewed"), F.lit(False))
    met = rows.join(verdicts.select(F.col(key), F.col("verdict"), F.col("value").alias("_new")), key, "left")
    return met.withColumn("value", F.when((F.col("verdict") == "fix") & open_, F.col("_new")).otherwise(F.col("value"))).drop("_new")


def normal_tags(tags: Column, replace: dict[str, str], most: int = 4) -> Column:
    """Synonyms replaced, repeats dropped, at most `most` kept."""
    table = F.create_map(*[F.lit(x) for kv in replace.items() for x in kv])
    return F.slice(F.array_distinct(F.transform(tags, lambda t: F.coalesce(F.element_at(table, t), t))), 1, most)


def without_contained(rows: DataFrame, key: str, line: str) -> DataFrame:
    """key, line: the distinct lines of a key that do not lie whole within another line of it.

    Lines meet those that could hold them by key and their rarest run of characters, so no key's lines are gathered in one place.
    """
    lines = rows.select(key, line).distinct()
    inner = lines.select(F.col(key).alias("_key_"), F.col(line).alias("_inner"))
    inside = containing(lines, line, inner, "_inner", {key: "_key_"}).where(F.col(line) != F.col("_inner"))
    gone = inside.select(F.col("_key_").alias(key), F.col("_inner").alias(line)).distinct()
    return lines.where(F.col(line) != "").join(gone, [key, line], "left_anti").union(_lone_empty(lines, key, line))


def _lone_empty(lines: DataFrame, key: str, line: str) -> DataFrame:
    """An empty line lies within any other one; it stays where it is the only one."""
    return lines.groupBy(key).agg(F.max(line).alias(line)).where(F.col(line) == "")


def caveat_rules(level: Column, ref: Column, known: Sequence[str] = ("info", "warn", "stop")) -> list[tuple[str, str, Column]]:
    """Rules on caveats: a known severity, and a named source for those that stop or warn."""
    return [("severity", "error", ~level.isin(list(known))), ("legal_ref", "warning", level.isin("stop", "warn") & (F.trim(F.coalesce(ref, F.lit(""))) == ""))]


def schema_rules(patterns: dict[str, str], required: Sequence[str], known: dict[str, Sequence[str]], one_of: Sequence[tuple[str, str]]) -> list[tuple[str, str, Column]]:
    """Rules that a schema states, all of them errors; a null breaks a rule on required fields only."""
    out = [(f"{c} pattern", "error", ~F.rlike(F.col(c), F.lit(p))) for c, p in patterns.items()]
    out += [(f"{c} required", "error", F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "") for c in required]
    out += [(f"{c} unknown", "error", ~F.col(c).isin(list(v))) for c, v in known.items()]
    return out + [(f"{a} or {b}", "error", F.col(a).isNull() == F.col(b).isNull()) for a, b in one_of]


def checked(found: DataFrame) -> DataFrame:
    """The violations, if none of them is an error."""
    if not found.where("severity = 'error'").isEmpty():
        raise ValueError("the rows break rules of severity error")
    return found
