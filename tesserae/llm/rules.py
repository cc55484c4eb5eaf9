"""Quality rules: fixed rules on word and line statistics, then an isolation forest on the same statistics.

The forest isolates rows by random splits of random samples; rows with short paths are anomalies. Each tree draws its SAMPLE rows from all
labelled rows that are not held out, and grows on all STATISTICS, without their labels. Labels set the threshold only: the one that, over all of
these rows, best tells the labels apart while at most MOST_LOST of the rows with label 1 are lost; it is found from counts by score, added up
over ranges of scores. The driver gets the trees' own draws and a few numbers. Every row is judged on its whole text, which is read once.

Defined results: a null text is an empty text: no words, base_failed; a very long text has one row of statistics; repeated rows get equal
verdicts; an anomaly equal to the threshold is kept; an empty table gives an empty table; extra columns are kept, and one named like a
result is replaced; without both labels only the base rules decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import trees
from tesserae.llm.common import append
from tesserae.llm.docstats import BLOCK, FEATURES, counts, features
from tesserae.llm.quality import labelled
from tesserae.operators.ranking import places
from tesserae.session import ensure_checkpoint_dir, ship

MOST_LOST = 0.005
#: Small samples, so that anomalies of one kind do not hide each other; picked on the rows that may be learnt from.
TREES = 300
SAMPLE = 64
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics that a rule can be stated on; sizes alone do not make an anomaly. The forest uses all of them.
STATISTICS = "symbols_word upper_word exclaim_word stutter_word dup_line repeat_word distinct_word top_word mean_word longest_word single_word".split()
USED = [FEATURES.index(k) for k in STATISTICS]


#: The base rules over their statistics.
FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base statistics, and _x: what the forest reads of each whole text."""
    fields = [T.StructField(k, T.LongType()) for k in BASE] + [T.StructField("_x", T.ArrayType(T.FloatType()))]

    def work(a):
        c = counts(a)
        return [*(c[k].astype(np.int64) for k in BASE), list(features(c)[:, USED])]

    return append(df, text, fields, lambda: work, BLOCK)


def scored(rows: DataFrame, model: dict, out: str) -> DataFrame:
    """rows with the anomaly of their _x."""
    if "trees" not in model:
        return rows.withColumn(out, F.lit(0.0))
    ship(rows.sparkSession)
    spread = rows.sparkSession.sparkContext.broadcast(model)  # set by the number of trees

    @F.arrow_udf("double")
    def anomaly(x: pa.Array) -> pa.Array:
        return pa.array(np.round(trees.anomaly(spread.value, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), len(USED))), 9))

    return rows.withColumn(out, anomaly("_x"))


def threshold(rows: DataFrame) -> float:
    """rows: score, y, both labels among them. The threshold that tells the labels apart best while few good rows are lost.

    Rows are counted by score; running counts come from ranges of scores and what lies in the ranges before, so no task holds all scores.
    """
    by = rows.groupBy("score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    dealt = by.repartitionByRange("score").withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = dealt.groupBy("_part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = sums.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in "gb"])
    here = Window.partitionBy("_part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    up_to = dealt.withColumns({"g": F.sum("good").over(here), "b": F.sum("bad").over(here)}).join(F.broadcast(before), "_part")
    up_to = up_to.select("score", "good", (F.col("g") + F.col("g_before")).alias("g"), (F.col("b") + F.col("b_before")).alias("b"))
    n_good, n_bad = sums.agg(F.sum("g"), F.sum("b")).first()
    spared = int(np.ceil((1 - MOST_LOST) * (n_good - 1)))
    least = up_to.where((F.col("good") > 0) & (F.col("g") > spared)).agg(F.min("score")).first()[0]
    gain = (n_bad - F.col("b")) * n_good - (n_good - F.col("g")) * n_bad  # bad rows caught less good ones lost, in whole numbers
    best = up_to.where(F.col("score") >= least).agg(F.max_by("score", F.struct(gain, -F.col("score")))).first()[0]
    above = dealt.where(F.col("score") > best).agg(F.min("score")).first()[0]
    return float((best + (best + 1e-9 if above is None else above)) / 2)  # scores have nine digits; the threshold lies between two


def learnt(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> dict:
    """The model from measured rows (_order beside them) and labels: all labelled rows that are not held out and pass the base rules."""
    ensure_checkpoint_dir(rows.sparkSession)
    known = labelled(labels, "quality", id_col)
    usable = rows.where(f"NOT ({FAILED})").join(known, id_col).select("_order", "_x", F.col("_y").cast("int").alias("y"))
    placed = places(usable, [], [F.col("_order"), F.col("y")], "_at").checkpoint()
    n, good = placed.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n < 20 or min(good, n - good) < 3:
        return {"cut": 2.0}
    drawn = trees.draws(n, TREES, SAMPLE)  # the draws of all trees: TREES * SAMPLE places at most
    wanted = rows.sparkSession.createDataFrame([(int(i) + 1,) for i in np.unique(drawn)], "_at long")
    got = placed.join(F.broadcast(wanted), "_at").select("_at", "_x").orderBy("_at").toPandas()
    x = np.array(got["_x"].tolist(), np.float32)
    forest = trees.isolate(x, trees=TREES, sample=SAMPLE, picked=np.searchsorted(got["_at"].to_numpy() - 1, drawn))
    return forest | {"cut": threshold(scored(placed, forest, "score").select("score", "y"))}


def ordered(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return measured(docs.select(id_col, text, F.xxhash64(id_col, text).alias("_order")), text).drop(text)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> dict:
    return learnt(ordered(docs, id_col, text), labels, id_col)


def decided(rows: DataFrame, model: dict) -> DataFrame:
    failed = F.expr(FAILED)
    return scored(rows, model, "anomaly").drop("_x").withColumns({"base_failed": failed, "kept": ~failed & (F.col("anomaly") <= model["cut"])})


def judge(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """df with the base statistics, base_failed, anomaly and kept."""
    return decided(measured(df, text), model)


def verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics of all texts are worked out once and checkpointed, some 100 bytes a row; the fit and the verdicts read them."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = ordered(docs, id_col, text).checkpoint()
    return decided(rows, learnt(rows, labels, id_col)).select(id_col, *BASE, "base_failed", "kept", "anomaly")
