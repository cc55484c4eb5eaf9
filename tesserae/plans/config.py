"""Our own configuration: facet orders, generic tags, weights, synonyms, aliases, rules, seasons, tiers, flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TOPIC_ORDER = ["Brand#4", "Brand#2", "Brand#17", "Brand#9", "Brand#1"]
CLASS_ORDER = ["STANDARD", "PROMO", "SMALL", "MEDIUM"]
HIDDEN_TOPICS = ["Brand#13"]
CONCRETE = ["red", "blue", "small", "widget", "bolt"]
RESIDUAL = "other"
GENERIC = ["small", "large"]
WEIGHTS = {"title": 100, "id": 80, "tags": 60, "summary": 30}
#: first and last day (MM-dd), factor; in order, with an overlap and a turn of the year.
SEASONS = [("12-15", "01-15", 150), ("07-01", "08-31", 130), ("08-15", "09-10", 120), ("04-01", "04-01", 110)]
TIERS = ["999 and below", "1,000-2,999", "3000 – 5999", "6000~7999", "8,000 and above", "unreadable"]
#: Events: allowed types, longest target and context.
EVENT_TYPES = ["click", "purchase", "signup", "view"]


def seasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SEASONS)], "ord int, first string, last string, pct int")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(TIERS)), "ord int, label string")


#: Attachment baselines by category, questions with the rule they lead to, references of conclusions, labels that were renamed.
BASELINES = [("red", "Red list", 2), ("bolt", "Bolt list", 1), ("blue", "Blue list", 4)]
FAQS = [(1, "why this", 3), (2, "which one", 43), (3, "lost", 99)]
REFERENCES = [("f1", "c1", [3, 999_999_999]), ("f1", "c2", []), ("f1", "c3", [2, 11])]
RENAMED = {"red": "crimson list", "bolt": "fasteners"}
