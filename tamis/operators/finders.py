"""The base reads: equality filters with an order, counts, and point lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.lifecycle import NotFound

PUBLIC = ("PUBLISHED", "ANNULLED")


def find(df: DataFrame, *order: Column | str, **equal: object) -> DataFrame:
    """Rows whose columns equal the given values (a tuple: any of them), in order."""
    for c, v in equal.items():
        df = df.where(F.col(c).isin(*v) if isinstance(v, tuple) else F.col(c) == v)
    return df.orderBy(*order) if order else df


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def last(df: DataFrame, by: str) -> DataFrame:
    return df.orderBy(F.desc(by)).limit(1)


def between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return df.where(F.col(column).between(low, high)).orderBy(column)


def one(df: DataFrame, **equal: object) -> DataFrame:
    """The row with a key; an error if there is none."""
    found = find(df, **equal)
    if not found.limit(1).count():
        raise NotFound(f"nothing with {equal}")
    return found


def exists(df: DataFrame, **equal: object) -> bool:
    return bool(find(df, **equal).limit(1).count())


def either(df: DataFrame, a: str, b: str, value: object) -> DataFrame:
    return df.where((F.col(a) == value) | (F.col(b) == value))


def waitlist(selections: DataFrame, pool: str) -> DataFrame:
    return find(selections, "waitlist_position", outcome="WAITLISTED", pool_code=pool)


def explanation(apps: DataFrame, checks: DataFrame, selections: DataFrame, pools: DataFrame, allotments: DataFrame) -> DataFrame:
    """One row for each application: its status, checks, draw lines and allotments; selections are of published draws."""
    c = checks.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("decided_at", "check_code", "passed", "reason"))).alias("checks"))
    lines = selections.join(F.broadcast(pools.select(F.col("pool").alias("pool_code"), "seats", "candidates")), "pool_code", "left")
    line = F.struct("outcome", "pool_code", "seats", "candidates", "rank_in_pool", "waitlist_position", "ticket_hex", "reason_code", "reason_text")
    d = lines.groupBy("application_id").agg(F.collect_list(line).alias("draws"))
    a = allotments.groupBy("application_id").agg(F.array_sort(F.collect_list(F.struct("unit_id", "unit_type", "basis"))).alias("allotments"))
    return apps.join(c, "application_id", "left").join(d, "application_id", "left").join(a, "application_id", "left")


def cluster_purity(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """cluster_id, members and distinct true sources (application_id, source_id) of each cluster."""
    return clusters.join(truth, "application_id").groupBy("cluster_id").agg(F.count("*").alias("members"), F.countDistinct("source_id").alias("sources"))
