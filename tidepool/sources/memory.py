"""Base tables as the operators read them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.runtime import table

#: The project's as-of time. Operators take it as a parameter, never the clock.
AS_OF = "2025-12-31 00:00:00"


def as_of(at: str = AS_OF) -> Column:
    return F.lit(at).cast("timestamp")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """(memory_id, text, user_id, agent_id, text_hash, archived, archived_at, tier, created_at) of the base table, JSON
    fields projected from the payload, redelivered rows once."""
    field = lambda k: F.get_json_object("payload", f"$.{k}")
    rows = table(spark, d, "mem0").select("id", "payload", "created_at").distinct()
    return rows.select(
        F.col("id").alias("memory_id"), field("data").alias("text"), field("user_id").alias("user_id"), field("agent_id").alias("agent_id"), field("hash").alias("text_hash"),
        (F.lower(F.coalesce(field("archived"), F.lit("false"))) == "true").alias("archived"), field("archived_at").alias("archived_at"),
        F.coalesce(field("dream_tier").try_cast("int"), F.lit(1)).alias("tier"), F.col("created_at").cast("timestamp").alias("created_at"),
    )


def in_flight(spark: SparkSession, d: str) -> DataFrame:
    """The in-flight memories, redelivered rows once."""
    return table(spark, d, "dream_memory").dropDuplicates(["id"])


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, confidence): undirected match edges between ids, the smaller id first, with the greatest similarity."""
    t = lambda c: F.lower(F.trim(c))
    shape = r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"
    rows = table(spark, d, "dedup_log").select(t("kept_id").alias("a"), t("removed_id").alias("b"), "similarity")
    rows = rows.where(F.col("a").rlike(shape) & F.col("b").rlike(shape) & (F.col("a") != F.col("b")))
    return rows.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.max("similarity").alias("confidence"))
