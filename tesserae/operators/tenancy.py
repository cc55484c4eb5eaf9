"""Tenants: what they may see, what an expired licence leaves, and configuration in headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TENANT = "tenant_id string, visible_all boolean, visible array<string>, own array<string>, features array<string>, expires_at string"


def hidden_topics(tenants: DataFrame, topics: list[str]) -> DataFrame:
    """tenant_id, topic: known topics that are neither visible nor the tenant's own; none for one that sees all."""
    known = F.array(*map(F.lit, topics))
    empty = F.array().cast("array<string>")
    hidden = F.when(F.coalesce("visible_all", F.lit(False)), empty).otherwise(F.array_except(known, F.array_union(F.coalesce("visible", empty), F.coalesce("own", empty))))
    return tenants.select("tenant_id", F.explode(hidden).alias("topic"))


def visible_to(cards: DataFrame, tenants: DataFrame, topics: list[str], tenant: str) -> DataFrame:
    """Cards whose topic isn't hidden from the tenant; an unknown tenant sees all but the known topics."""
    one = tenants.where(F.col("tenant_id") == tenant).limit(1)
    hidden = hidden_topics(one, topics)
    return cards.join(hidden.select("topic"), "topic", "left_anti")


def effective(keys: DataFrame, licences: DataFrame, now: Column, default: str) -> DataFrame:
    """keys: key. licences: key, tenant_id, expires_at. The tenant, or the default one if the key is unknown, malformed or expired."""
    until = F.try_to_timestamp(F.col("expires_at"))
    met = keys.join(licences, "key", "left")
    fine = F.col("tenant_id").isNotNull() & (F.col("expires_at").isNull() | (until >= now))
    return met.select("key", F.when(F.coalesce(fine, F.lit(False)), F.col("tenant_id")).otherwise(F.lit(default)).alias("tenant_id"))


def to_header(config: Column) -> Column:
    return F.base64(F.to_json(config).cast("binary"))


def from_header(header: Column) -> Column:
    """Null for what isn't base64 of such JSON."""
    clean = F.rlike(header, F.lit("^[A-Za-z0-9+/]*={0,2}$"))
    return F.from_json(F.when(clean & (F.length(header) % 4 == 0), F.unbase64(header)).cast("string"), TENANT)
