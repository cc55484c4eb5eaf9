"""Quality classifier: gradient-boosted trees on histograms of document statistics, walked as flat arrays.

The trees are fitted on the driver on at most TRAIN_ROWS labelled rows, those of the smallest seeded hash, never on held-out
rows; the statistics come from each whole text, and every row is scored. Labels, language, source and id are no features.

Defined results: a null or empty text gets the score of an empty text; a very long text has one row of statistics; of splits of equal gain
the first statistic and the lowest threshold win; repeated rows get equal scores; an empty table gives an empty table; extra columns are
kept, and one named like a result is replaced; without usable labels, or with one class only, every score is the smoothed share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import trees
from tesserae.llm.common import append, aside, held_out
from tesserae.llm.docstats import BLOCK, FEATURES, counts, features

#: At most so many labelled rows are learnt from, at every size of input.
TRAIN_ROWS = 20_000
THRESHOLD = 0.7
WANTED = np.arange(len(FEATURES))


def labelled(labels: DataFrame, target: str, id_col: str = "doc_id") -> DataFrame:
    """Labelled ids that are not held out, with _y; ids with contrary labels are left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(target).isin(0, 1) & ~held_out(F.col(id_col)))
    one = one.groupBy(F.col(id_col)).agg(F.min(target).alias("_low"), F.max(target).alias("_y")).where("_low = _y")
    return one.select(id_col, "_y")


def sample(labels: DataFrame, target: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` of the labelled ids, chosen by a seeded hash."""
    return labelled(labels, target, id_col).orderBy(F.xxhash64(F.lit(17), F.col(id_col)), id_col).limit(rows)


def training_rows(docs: DataFrame, labels: DataFrame, target: str, id_col: str, text: str, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels on the driver: `rows` rows of a few numbers at most."""
    chosen = sample(labels, target, rows, id_col)  # bounded by `rows`, so the broadcast is
    field = T.StructField("_x", T.ArrayType(T.FloatType()))
    joined = docs.select(F.col(id_col), F.col(text)).join(F.broadcast(chosen), id_col)
    joined = joined.select("_y", text, F.xxhash64(F.col(id_col), F.col(text)).alias("_order"))
    found = append(joined, text, [field], lambda: lambda a: [list(features(counts(a)))], BLOCK)
    got = found.select("_y", "_x", "_order").orderBy("_order", "_y").limit(rows).toPandas()
    return (np.array(got["_x"].tolist(), np.float32).reshape(-1, len(FEATURES)), got["_y"].to_numpy().astype(float))


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text: str = "text") -> dict:
    x, y = training_rows(docs, labels, target, id_col, text)
    if len(y) < 20 or len(set(y.tolist())) < 2:
        return {"share": float((y.sum() + 1) / (len(y) + 2))}
    return trees.boost(x, y)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    return np.full(len(x), model["share"]) if "share" in model else trees.probability(model, x)


def score(df: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """df with each whole text's score; higher: label 1 likelier."""
    spread = df.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, set by the number of trees
    return append(df, text, [T.StructField(out, T.DoubleType())], lambda: lambda a: [np.round(predict(spread.value, features(counts(a))), 9)], BLOCK)


def accepted(df: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that score the threshold or more, as they are."""
    named, back = aside(df, text)
    return score(named, model, text, "_score").where(F.col("_score") >= threshold).select(*back)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs.select(id_col, text), fit(docs, labels, "quality", id_col, text), text).drop(text)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
