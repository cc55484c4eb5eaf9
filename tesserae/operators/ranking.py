"""Places in a total order, joins by substring, and joins on few keys, without one task holding a whole group and without nested loops."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import ensure_checkpoint_dir

#: Slots that each side's rows of one key are dealt into, and how many values a list of a slot has at most.
SLOTS, LIST = 8, 256


def places(rows: DataFrame, within: list[str], order: list[Column], out: str = "pos", parts: int | None = None) -> DataFrame:
    """Places from 1 in each group, as row_number() gives them, for groups of any size.

    Rows are dealt out by ranges of (group, order), so a large group spreads over many tasks. A row's place is its place in its range
    and the number of its group's rows in the ranges before; only those counts, a few a range, go through a window. The dealt rows are
    checkpointed, so that both reads see the same ranges. `order` must be total, or ties fall as they lie.
    """
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("*", F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(within)], F.lit(0).alias("_")).alias("_group"))
    dealt = keyed.repartitionByRange(parts, F.col("_group"), *order).withColumn("_part", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_group", "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).select(F.col("_group").alias("_g"), F.col("_part").alias("_p"), "_before")
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part", "_group").orderBy(*order)))
    met = here.join(offsets, (F.col("_part") == F.col("_p")) & (F.col("_group") == F.col("_g")))
    return met.withColumn(out, F.col("_at") + F.col("_before")).select(*rows.columns, out)


def beside(rows: DataFrame, within: list[str], order: list[Column], columns: list[str], pos: str = "place") -> DataFrame:
    """rows with their place in the group, and the columns of the row before it (before_x) and after it (after_x); null at the ends.

    Neighbours meet by place, so a group of any size is spread over many tasks. Nulls in `within` are one group.
    """
    placed = places(rows, within, order, pos).checkpoint()
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]

    def other(name: str, step: int) -> DataFrame:
        moved = [F.col(c).alias(f"_{c}") for c in within]
        return placed.select(*moved, (F.col(pos) + step).alias(f"_{pos}"), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    out = placed
    for name, step in (("before", 1), ("after", -1)):
        met = out.join(other(name, step), reduce(and_, [*on, F.col(pos) == F.col(f"_{pos}")]), "left")
        out = met.drop(f"_{pos}", *[f"_{c}" for c in within])
    return out


def containing(hay: DataFrame, text: str, needles: DataFrame, part: str, by: dict[str, str] | None = None) -> DataFrame:
    """All pairs in which hay's text contains the needle's part, both as they are; no needle is empty.

    A needle is looked up by a run of three of its characters (or all, if it has fewer) among all runs of that length of the texts: by that of
    its runs which the fewest texts hold, so a run that all have is used only where a needle has no other. Met pairs are verified. So the
    join is one by equality, whatever the size of either side. by: columns of hay and of needles that must be equal too.
    """
    by = by or {}
    runs = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    some = F.array_distinct(F.filter(F.concat(*[runs(F.col(text), n) for n in (1, 2, 3)]), lambda g: g != ""))
    left = hay.withColumn("_run", F.explode(some))
    counts = left.groupBy(*by, "_run").agg(F.count("*").alias("_n")).withColumnsRenamed({h: f"_{n}" for h, n in by.items()})
    asked = needles.where(F.col(part) != "").select(*[F.col(n).alias(f"_{n}") for n in by.values()], F.col(part).alias("_part")).distinct()
    proposed = asked.withColumn("_run", F.explode(_distinct_runs("_part")))
    # a run that no text holds isn't met, and its needle can be in none
    known = proposed.join(counts, [*[f"_{n}" for n in by.values()], "_run"], "left")
    rarest = known.groupBy(*[f"_{n}" for n in by.values()], "_part").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_run")).alias("_best")).where("_best.n > 0")
    keys = rarest.select(*[F.col(f"_{n}") for n in by.values()], "_part", F.col("_best._run").alias("_key"))
    same = reduce(and_, [F.col(n) == F.col(f"_{n}") for n in by.values()], F.col(part) == F.col("_part"))
    right = needles.join(keys, same).drop("_part", *[f"_{n}" for n in by.values()])
    equal = reduce(and_, [left[h] == right[n] for h, n in by.items()], F.col("_run") == F.col("_key"))
    met = left.join(right, equal).where(F.contains(F.col(text), F.col(part)))
    return met.drop("_run", "_key", *[right[n] for n in by.values() if n in hay.columns])


def _distinct_runs(part: str) -> Column:
    """The runs of three characters of a text, or all of it if it has fewer."""
    c = F.col(part)
    three = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3)))
    return F.array_distinct(F.when(F.length(c) >= 3, three).otherwise(F.array(c)))


def listed(rows: DataFrame, key: list[str], values: list[str], out: str, most: int = LIST) -> DataFrame:
    """key, _slot and out: the rows of a key as lists of values (structs), none longer than `most`; repeated rows and nulls stay.

    A key's rows are dealt into SLOTS slots by a hash, and each slot is cut by running number, so a list is short however many rows a key has.
    """
    one = rows.select(*key, F.struct(*values).alias("_value"), F.pmod(F.xxhash64(*values), F.lit(SLOTS)).cast("int").alias("_slot"))
    at = F.row_number().over(Window.partitionBy(*key, "_slot").orderBy("_value"))
    cut = one.withColumn("_list", F.floor((at - 1) / most))
    return cut.groupBy(*key, "_slot", "_list").agg(F.collect_list("_value").alias(out)).drop("_list")


def lists_met(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Each list of the left beside each one of the right with its key, for results with far more rows than either side has.

    Only lists are dealt out: each goes to all slots of the other side, so a key is SLOTS * SLOTS parts by a hash of key and slots, and no row
    of the result moves. The caller unpacks what has met, the left first: lists of the right then follow each other alike, which Parquet
    stores in little space.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1)))
    one = left.withColumnRenamed("_slot", "_l").withColumn("_r", slots).repartition(n, *key, "_l", "_r")
    other = right.withColumnRenamed("_slot", "_r").withColumn("_l", slots).repartition(n, *key, "_l", "_r")
    return one.join(other, [*key, "_l", "_r"]).drop("_l", "_r")
