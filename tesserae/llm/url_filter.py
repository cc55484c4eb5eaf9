"""URL filters: rules by host and path first, then a path-template tree for the urls that no rule judges.

1. Shapes: in each segment of a path, every run of digits counts as one. Pages are counted by host and shape; all that follows, but for the
   last join, works on these counts.
2. Tree: level by level under each host, a segment that holds LITERAL_SHARE of its parent's pages (and two at least) is a branch of its
   own; all others generalise into one wildcard. So a node has at most 1 / LITERAL_SHARE + 1 branches, however many pages and ids it sees.
   DEPTH is a parameter of the operator: what lies deeper is one segment, so a path of any length costs DEPTH levels at most.
3. Merging: branches of a node are alike while the kinds of what follows them (nothing, a number, a mixed segment, a wildcard, a word) do
   not differ by a chi-square test; this asks for no label. Labels are the rules' own verdicts on the pages that they fit. Among alike
   branches, labelled ones are merged while their purities do not differ by a two-proportion test; one without labels takes the counts
   of all that are alike.
4. Purity: the share of blocked pages, a page without label counting as DOUBT of an allowed one, smoothed towards the parent's. A branch
   whose alike branches have no labels either takes its parent's share and evidence. A template is rejected if its evidence is
   LEAST_LABELLED labelled pages or more and its share reaches REJECT.

Defined results: a null url or one without `://` has an empty host and path, and no rule; equal urls get equal verdicts; repeated rows each
get their own result; very long urls and very deep paths are read whole; ties between branches go by the template's text; an empty table
gives an empty table; no column but the id and the url is read, so names of others can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import ensure_checkpoint_dir

LITERAL_SHARE = 0.02
DEPTH = 8
LEAST_LABELLED = 3
REJECT = 0.5
PRIOR = 2.0
DOUBT = 0.5
#: Of chi-square with one and with four degrees of freedom, at 5 %.
DIFFERS = 3.841
UNLIKE = 9.488
WILDCARD = "*"
KINDS = ["nothing", "number", "mixed", "wildcard", "word"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The contract's rules.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.substring_index(after_scheme(url), "?", 1), r"^[^/#]*", 0)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(after_scheme(url), "?", 1), "#", 1)
    at = F.locate("/", rest)
    return F.coalesce(F.when(at > 0, F.substr(rest, at)).otherwise(F.lit("")), F.lit(""))


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def shape_of(path: Column, depth: int) -> Column:
    """The path's parts that aren't empty, each after a /; digits are one 0, and those from depth on are one part."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    parts = F.transform(parts, lambda s: F.when(s == WILDCARD, "%2A").otherwise(F.regexp_replace(s, "[0-9]+", "0")))
    deep = F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, F.size(parts)), "%2F")))
    parts = F.when(F.size(parts) <= depth, parts).otherwise(deep)
    return F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "/"))).otherwise(F.lit(""))


def parts_of(template: Column) -> Column:
    return F.filter(F.split(template, "/"), lambda s: s != "")


def templates(counts: DataFrame, depth: int) -> DataFrame:
    """counts: host, shape, pages and more. Adds template: branches and wildcards, each with a / before it."""
    rows = counts.withColumns({"template": F.lit(""), "_segs": parts_of(F.col("shape"))}).checkpoint()
    for d in range(min(depth, rows.agg(F.max(F.size("_segs"))).first()[0] or 0)):
        rows = rows.withColumn("_seg", F.get("_segs", F.lit(d)))
        children = rows.where("_seg IS NOT NULL").groupBy("host", "template", "_seg").agg(F.sum("pages").alias("_n"))
        totals = children.groupBy("host", "template").agg(F.sum("_n").alias("_all"))
        own = children.where("_n >= 2").join(totals, ["host", "template"]).where(F.col("_n") >= LITERAL_SHARE * F.col("_all"))
        # met on a hash, by which neither side is dealt out already, so that the rows of a very large host can be split
        own = own.select(F.xxhash64("host", "template", "_seg").alias("_k"), F.col("host").alias("_host"), F.col("template").alias("_parent"), F.col("_seg").alias("_own"))
        rows = rows.withColumn("_key", F.xxhash64("host", "template", "_seg"))
        met = (F.col("_key") == F.col("_k")) & (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_parent")) & (F.col("_seg") == F.col("_own"))
        rows = rows.join(own, met, "left")
        name = F.when(F.col("_seg").isNull(), "").otherwise(F.concat(F.lit("/"), F.coalesce("_own", F.lit(WILDCARD))))
        rows = rows.withColumn("template", F.concat("template", name)).drop("_seg", "_key", "_k", "_host", "_parent", "_own").checkpoint()
    return rows.drop("_segs")


def kind_after(d: int) -> Column:
    """What follows a node of level d on the way to a template."""
    part = F.get("_parts", F.lit(d))
    word = F.when(F.contains(part, F.lit("0")), "mixed").otherwise("word")
    return F.when(part.isNull(), "nothing").when(part == "0", "number").when(part == WILDCARD, "wildcard").otherwise(word)


def purities(counts: DataFrame) -> DataFrame:
    """counts: host, template, pages, labelled, blocked. Gives host, template, evidence, share for each template's own node."""
    nodes = counts.withColumn("_parts", parts_of(F.col("template")))
    first = nodes.agg(F.sum("pages").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(F.size("_parts")).alias("d")).first()
    prior = (first.b or 0) / (first.l + DOUBT * (first.n - first.l)) if first.n else 0.0
    smoothed = lambda b, l, n, above: (b + PRIOR * above) / (l + DOUBT * (n - l) + PRIOR)  # noqa: E731, E741
    joined = lambda k: F.when(F.lit(k) > 0, F.concat(F.lit("/"), F.array_join(F.slice("_parts", 1, max(1, k)), "/"))).otherwise(F.lit(""))
    level = nodes.groupBy("host").agg(F.sum("labelled").alias("evidence"), F.sum("blocked").alias("_b"), F.sum("pages").alias("_n"))
    level = level.select("host", F.lit("").alias("template"), "evidence", smoothed(F.col("_b"), F.col("evidence"), F.col("_n"), F.lit(prior)).alias("share"))
    out = level
    for d in range(1, (first.d or 0) + 1):
        here = nodes.where(F.size("_parts") >= d).withColumns({"_parent": joined(d - 1), "_me": joined(d), "_kind": kind_after(d)})
        kinds = [F.sum(F.when(F.col("_kind") == k, F.col("pages")).otherwise(0)).alias(k) for k in KINDS]
        here = here.groupBy("host", "_parent", F.col("_me").alias("template")).agg(F.sum("pages").alias("_n"), F.sum("labelled").alias("_l"), F.sum("blocked").alias("_b"), *kinds)
        row = Window.partitionBy("host", "_parent").orderBy(*[(F.col(k) / F.col("_n")).desc() for k in KINDS], "template")
        n0, n1 = F.lag("_n").over(row), F.col("_n")
        unlike = sum((F.when(F.lag(k).over(row) + F.col(k) > 0, (F.sqrt(n1 / n0) * F.lag(k).over(row) - F.sqrt(n0 / n1) * F.col(k)) ** 2 / (F.lag(k).over(row) + F.col(k))).otherwise(0.0) for k in KINDS), F.lit(0.0))
        here = here.withColumn("_new", F.coalesce((unlike >= UNLIKE).cast("int"), F.lit(1))).withColumn("_alike", F.sum("_new").over(row))
        alike = Window.partitionBy("host", "_parent", "_alike")
        here = here.withColumns({f"_all{c}": F.sum(c).over(alike) for c in ("_l", "_b", "_n")})
        here = here.withColumn("_p", F.when(F.col("_l") > 0, F.col("_b") / F.col("_l")))
        row = alike.orderBy(F.col("_p").asc_nulls_last(), "template")
        l0, b0, l1, b1 = F.lag("_l").over(row), F.lag("_b").over(row), F.col("_l"), F.col("_b")
        both = (b0 + b1) / (l0 + l1)
        spread = both * (1 - both) * (1 / l0 + 1 / l1)
        far = F.when((l0 > 0) & (l1 > 0), F.when(spread > 0, (b0 / l0 - b1 / l1) ** 2 / spread >= DIFFERS).otherwise(b0 * l1 != b1 * l0)).otherwise(F.coalesce(l0 > 0, F.lit(True)))
        here = here.withColumn("_far", F.coalesce(far.cast("int"), F.lit(1))).withColumn("_group", F.sum("_far").over(row))
        group = Window.partitionBy("host", "_parent", "_alike", "_group")
        own = F.col("_l") > 0
        here = here.withColumns({f"_g{c}": F.when(own, F.sum(c).over(group)).otherwise(F.col(f"_all{c}")) for c in ("_l", "_b", "_n")})
        parent = level.select("host", F.col("template").alias("_parent"), F.col("share").alias("_above"), F.col("evidence").alias("_seen"))
        none = F.col("_g_l") == 0
        share = F.when(none, F.col("_above")).otherwise(smoothed(F.col("_g_b"), F.col("_g_l"), F.col("_g_n"), F.col("_above")))
        level = here.join(parent, ["host", "_parent"]).select("host", "template", F.when(none, F.col("_seen")).otherwise(F.col("_g_l")).alias("evidence"), share.alias("share"))
        out = out.union(level)
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES, depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template, evidence (labelled pages that its share is of), share (of blocked ones)."""
    ensure_checkpoint_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    text, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, "_said": said, "shape": shape_of(F.col("path"), depth)})
    said = F.col("_said")
    counts = rows.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count(said).alias("labelled"), F.count_if(said == "block").alias("blocked"))
    shapes = templates(counts, depth)
    known = purities(shapes.groupBy("host", "template").agg(*[F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]).checkpoint())
    known = shapes.select("host", "shape", "template").join(known.checkpoint(), ["host", "template"])
    known = known.select(F.xxhash64("host", "shape").alias("_k"), F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "evidence", "share")
    met = (F.xxhash64("host", "shape") == F.col("_k")) & (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape"))
    rows = rows.join(known, met, "left")
    rejected = (F.col("evidence") >= LEAST_LABELLED) & (F.col("share") >= REJECT)
    verdict = F.coalesce(said, F.when(rejected, "block").otherwise("allow"))
    return rows.select(F.col("_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "evidence", F.round("share", 9).alias("share"))
