"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks, then a seeded selection of blocks.

Only DataFrame functions. The steps:

1. every document's size in words; one narrow row (id, source, size) a document is all that later steps move;
2. targets: a share of all sizes is divided by weight, no source above CAP times its size, the excess dealt again by weight
   until none is above. The level at which that ends is found by one pass over the sources in the order in which they fill up;
3. blocks of equal tokens go to sources, and each source's blocks to its shards, to the highest quotients (Sainte-Lague). Seats
   that any divisor in reach gives are dealt at once; only the few in dispute are ranked, at most about two a party, so the
   result is that of dealing the seats one by one;
4. in each (source, shard), documents lie on a tape in seeded order. A quota of q passes over the tape r times whole and once
   up to a point in it; a document takes what of it was passed over. No document is taken more than CAP times.

The order is a hash of id and text. Rows that are equal in both are one entry of the tape with their number, so no shard grows with them.
Shards follow the input, so no task gets a whole source, however large. A rerun gives the same rows.

Defined results: a null text has size 0 and takes 0; a null source is a source of its own, the last in order; rows with equal ids
and texts lie side by side on the tape and are told apart only by that; very long texts are
counted whole; no column but id, text and source is read, so names of others can't clash; an empty table gives an empty table; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import aside
from tesserae.operators.ranking import places
from tesserae.session import ensure_checkpoint_dir

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
SEED = 20_240
#: Words that a shard holds, about.
SHARD_WORDS = 200_000
#: Copies of a row that are listed at once.
COPIES = 1_000
#: A table of so many sources at most is sent to every task; each is a few dozen bytes and a name.
SOURCES_SENT = 10_000
#: A table of so many shards at most is sent to every task, about 200 bytes each; beyond, documents are dealt out by shard.
SHARDS_SENT = 100_000
#: Words a block: a source's target is met to about half a block, so small targets get small blocks.
BLOCK_WORDS = 256
BLOCKS_AT_LEAST = 400


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, by: list[str], key: list[str], out: str) -> DataFrame:
    """Highest quotients: parties with whole-number quotas. `seats` is equal for all parties of a group `by`.

    A divisor that gives n parties all their seats lies between total / (seats + n/2) and total / (seats - n/2), as rounding moves
    a party by half a seat at most. What the first bound takes away from a party's certain seats is in dispute, about one seat a party
    and one for its share of the n/2.
    """
    # counts and sums are added up before they are dealt out; places among disputed seats come from ranges, however many parties a group has
    sums = parties.groupBy(*by).agg((F.count("*") / 2 + 1).alias("_n"), F.sum(votes).alias("_total"))
    d = parties.join(sums, by)
    ratio = F.when(F.col("_total") > 0, F.col(votes) / F.col("_total")).otherwise(0.0)
    d = d.withColumn("_low", F.greatest(F.lit(0), F.floor(ratio * (F.col(seats) - F.col("_n")) + 0.5) - 1).cast("long"))
    d = d.withColumn("_high", F.when(ratio > 0, F.ceil(ratio * (F.col(seats) + F.col("_n")) + 0.5) + 1).otherwise(0).cast("long")).checkpoint()
    open_ = d.groupBy(*by).agg((F.max(seats) - F.sum("_low")).alias("_open"))
    disputed = d.where("_high > _low").select(*by, *key, votes, F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_seat"))
    best = [(F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *[F.col(k).asc_nulls_last() for k in key], F.col("_seat").asc()]
    won = places(disputed, by, best, "_place").join(open_, by).where("_place <= _open").groupBy(*by, *key).agg(F.count("*").alias("_won"))
    joined = d.join(won, [*by, *key], "left")
    return joined.withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_n", "_total", "_low", "_high", "_won")


def targets(sources: DataFrame, share_percent: int = SHARE_PERCENT, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row a source: source_key in the order of the weights, source_size. Adds weight and target.

    Sources fill up in the order of size / weight. Those before a place are full; the rest share what is left by weight, and the first
    place at which its own source isn't above its limit ends the dealing.
    """
    order = Window.partitionBy("_all").orderBy("source_key")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long")
    s = sources.withColumn("_all", F.lit(1)).withColumn("weight", w)
    fill = Window.partitionBy("_all").orderBy(F.col("source_size") / F.col("weight"), "source_key")
    full = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("_budget", F.sum("source_size").over(Window.partitionBy("_all")) * share_percent / 100)
    left = F.col("_budget") - cap * F.coalesce(F.sum("source_size").over(full), F.lit(0))
    s = s.withColumn("_level", left / F.sum("weight").over(rest)).withColumn("_place", F.row_number().over(fill))
    s = s.withColumn("_fits", F.col("_level") * F.col("weight") <= cap * F.col("source_size"))
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_fits"), F.col("_place"))).over(Window.partitionBy("_all")))
    most = (cap * F.col("source_size")).cast("double")
    return s.withColumn("target", F.coalesce(F.least(most, F.col("_level") * F.col("weight")), most)).drop("_all", "_budget", "_place", "_fits", "_level")


def seeded(id_col: Column, text: Column, seed: int = SEED) -> Column:
    """A hexadecimal order that another engine can make too."""
    key = F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit(""))
    return F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """id, size, source_size, target, taken. how: what `tape` takes further."""
    placed, _ = tape(docs, id_col, text, source, **how)
    some = placed.withColumn("_c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    each = some.withColumn("_nth", F.explode(F.sequence(F.col("_c") * COPIES, F.least(F.col("n"), (F.col("_c") + 1) * COPIES) - 1)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_more") - F.col("_start") - F.col("_nth") * F.col("size")))
    return each.select(id_col, "size", "source_size", "target", (F.col("passes") * F.col("size") + more).cast("long").alias("taken"))


def described(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    """docs with source_key, size and _order."""
    named = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source).cast("string")))
    return docs.withColumns({"source_key": named, "size": words(F.col(text)), "_order": seeded(F.col(id_col), F.col(text), seed)})


def sharded(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their shard; sources: source_key, shards."""
    number = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long")
    few = F.broadcast if sources.count() <= SOURCES_SENT else (lambda x: x)  # beyond, a join whose hot keys are split at run time
    return rows.join(few(sources), "source_key").withColumn("shard", F.floor(number * F.col("shards") / 2**32).cast("long")).drop("shards")


def tape(docs: DataFrame, id_col: str, text: str, source: str, share_percent: int = SHARE_PERCENT, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, shard_words: int = SHARD_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Documents on the tapes of their shards, those of equal id and text in one row with their number n: where each begins (_start), how often
    its tape is passed over whole (passes) and up to where once more (_more); then the number of shards by source."""
    ensure_checkpoint_dir(docs.sparkSession)
    # the texts are read once; a lost executor rereads these rows from the shared folder
    narrow = described(docs.select(id_col, text, source), id_col, text, source, seed).groupBy(id_col, "source_key", "size", "_order").agg(F.count("*").alias("n")).checkpoint()

    sources = narrow.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_rows"))
    t = targets(sources, share_percent, weights, cap).withColumn("_all", F.lit(1)).withColumn("_votes", F.round(F.col("target") * 16).cast("long"))
    everything = Window.partitionBy("_all")
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    t = t.withColumn("block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(least / BLOCKS_AT_LEAST))), F.lit(1)).cast("long"))
    t = t.withColumn("_blocks", F.round(F.sum("_votes").over(everything) / (16 * F.col("block"))).cast("long"))
    # documents without words weigh as much as short ones here, so that no shard is large
    t = t.withColumn("shards", F.ceil(F.greatest(F.col("source_size"), 20 * F.col("_rows")) / shard_words).cast("long"))
    t = apportion(t, "_votes", "_blocks", ["_all"], ["source_key"], "source_quota")
    t = t.select("source_key", "source_size", "target", "block", "source_quota", "shards").checkpoint()

    narrow = sharded(narrow, t.select("source_key", "shards"))
    per_shard = narrow.groupBy("source_key", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_size"))
    q = apportion(per_shard.join(t, "source_key"), "shard_size", "source_quota", ["source_key"], ["shard"], "quota")
    q = q.withColumn("_words", F.least(F.col("quota") * F.col("block"), cap * F.col("shard_size")))
    q = q.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(F.col("_words") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
    q = q.select("source_key", "shard", "source_size", "target", "passes", (F.col("_words") - F.col("passes") * F.col("shard_size")).alias("_more"))

    along = Window.partitionBy("source_key", "shard").orderBy("_order", id_col).rowsBetween(Window.unboundedPreceding, -1)
    placed = narrow.withColumn("_start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(along), F.lit(0))).join(q, ["source_key", "shard"])
    return placed, t.select("source_key", "shards")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **how) -> DataFrame:
    """The mixed corpus: docs with the text that the mix takes of each, and size, source_size, target, taken.

    A text is repeated whole, a line each, as often as its taken words allow; where words are left over, the first ones follow, a space
    between them. Rows of which nothing is taken have an empty text.

    A shard's tape is cut in one place: what lies before it is taken once more, and what lies there in part. So documents meet a row a
    shard, not a row a document, and texts are dealt out only where the shards are too many to be sent to every task.
    """
    named, back = aside(docs, id_col, text, source)
    placed, shards = tape(named, id_col, text, source, seed=seed, **how)
    shard = ["source_key", "shard"]
    cut = F.min(F.when(F.col("_start") + F.col("n") * F.col("size") > F.col("_more"), F.struct("_order", F.col("_start").alias("first"), F.col("n").alias("equal"))))
    cuts = placed.groupBy(*shard, "source_size", "target", "passes", "_more").agg(cut.alias("_cut")).checkpoint()
    sent = F.broadcast if cuts.count() <= SHARDS_SENT else (lambda x: x)

    rows = sharded(described(named, id_col, text, source, seed), shards).join(sent(cuts), shard)
    tied = F.coalesce((F.col("_order") == F.col("_cut.`_order`")) & (F.col("_cut.equal") > 1), F.lit(False))
    if cuts.where("_cut.equal > 1").isEmpty():
        rows = rows.withColumn("_nth", F.lit(1))
    else:  # equal rows at a cut: any order of them gives the same rows
        rows = rows.where(~tied).withColumn("_nth", F.lit(1)).unionByName(places(rows.where(tied), shard, [F.lit(0)], "_nth"))
    at_cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_more") - F.col("_cut.first") - (F.col("_nth") - 1) * F.col("size")))
    before, at = F.col("_order") < F.col("_cut.`_order`"), F.col("_order") == F.col("_cut.`_order`")
    left = F.coalesce(F.when(before, F.col("size")).when(at, at_cut), F.lit(0)).cast("int")
    taken = (F.col("passes") * F.col("size") + left).cast("long")
    rows = rows.withColumns({"taken": taken, "_whole": F.when(F.col("size") > 0, F.floor(taken / F.col("size"))).otherwise(0).cast("int")})
    part = (F.col("taken") - F.col("_whole") * F.col("size")).cast("int")
    first = F.array_join(F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), 1, part), " ")
    out = F.concat_ws("\n", F.array_repeat(F.col(text), F.col("_whole")), F.when(part > 0, first))
    new = ["size", "source_size", "target", "taken"]
    return rows.withColumn(text, out).select(*[c for c, n in zip(back, docs.columns, strict=True) if n not in new], *new)


#: The contract's mix in DuckDB's SQL: seats are dealt by listing every quotient.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('20240:' || coalesce('=' || doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS o FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size, count(*) AS n, [3, 1, 2][1 + (row_number() OVER (ORDER BY k) - 1) % 3] AS w FROM d GROUP BY k),
f AS (SELECT *, ((SELECT sum(source_size) FROM s) * 150 / 100 - 2 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv, row_number() OVER f AS place
      FROM s WINDOW f AS (ORDER BY source_size / w, k)),
l AS (SELECT lv FROM f WHERE lv * w <= 2 * source_size ORDER BY place LIMIT 1),
t AS (SELECT s.*, least(2.0::DOUBLE * source_size, (SELECT lv FROM l) * w)::DOUBLE AS target FROM s),
b AS (SELECT greatest(1, least(256, floor(min(target) FILTER (target > 0) / 400)))::BIGINT AS block, sum(round(target * 16)::BIGINT) AS votes FROM t),
m AS (SELECT block, round(votes / (16 * block))::BIGINT AS seats FROM b),
a AS (SELECT k, count(*) AS quota FROM (SELECT k FROM t, m, range(0, seats + 1) r(i) WHERE round(target * 16) > 0
      QUALIFY row_number() OVER (ORDER BY round(target * 16)::BIGINT / (2 * i + 1) DESC, k, i) <= seats) GROUP BY k),
h AS (SELECT d.*, source_size, target, coalesce(quota, 0) AS source_quota, block,
             floor(('0x' || substr(o, 1, 8))::BIGINT * ceil(greatest(source_size, 20 * n) / 200000) / 4294967296)::BIGINT AS shard
      FROM d JOIN t USING (k) LEFT JOIN a USING (k), m),
p AS (SELECT k, shard, sum(size)::BIGINT AS shard_size, any_value(source_quota) AS seats, any_value(block) AS block FROM h GROUP BY k, shard),
c AS (SELECT k, shard, count(*) AS quota FROM (SELECT k, shard FROM p, range(0, (SELECT max(seats) + 1 FROM p)) r(i) WHERE i <= seats AND shard_size > 0
      QUALIFY row_number() OVER (PARTITION BY k ORDER BY shard_size / (2 * i + 1) DESC, shard, i) <= seats) GROUP BY k, shard),
q AS (SELECT p.*, least(coalesce(quota, 0) * block, 2 * shard_size) AS words FROM p LEFT JOIN c USING (k, shard)),
z AS (SELECT h.*, q.shard_size, q.words, coalesce(sum(size) OVER (PARTITION BY k, shard ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM h JOIN q USING (k, shard))
SELECT doc_id, size, source_size, target,
       (CASE WHEN shard_size > 0 THEN words // shard_size * size + greatest(0, least(size, words % shard_size - start)) ELSE 0 END)::BIGINT AS taken FROM z
"""
