"""Queries of the subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import bytebpe, components, crosssplit, forest, langs, leaks, lookalikes, neardup, pii, survivor
from tidepool.runtime import Scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_pairs(table(spark, d, "dream_memory"))


def p1_texts(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.consistent_texts(table(spark, d, "dream_memory"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.lookalike_classes(table(spark, d, "dream_memory"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    groups = components.match_groups(table(spark, d, "dedup_log"), Scratch(spark, "p2"))
    return groups.select("group_id", "id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(table(spark, d, "dream_memory"), table(spark, d, "name_lexicon"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "dream_memory"), table(spark, d, "name_lexicon"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "dream_memory"), Scratch(spark, "p4"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(table(spark, d, "dream_memory"), Scratch(spark, "p4"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, d, "dream_memory"), Scratch(spark, "p5"))


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.cross_split_classes(table(spark, d, "dream_memory"), Scratch(spark, "p5"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Records of val and test per split and source, how many of them are in a pair of ``p5_found``, and the mean fraction of
    their characters shared with the best record of train they are paired with."""
    rows = crosssplit.overlap_fractions(table(spark, d, "dream_memory"), Scratch(spark, "p5"), extra=("source",)).dropDuplicates(["id"])
    source = F.coalesce(F.nullif(F.lower(F.trim("source")), F.lit("")), F.lit("unknown"))
    share = F.round(F.avg("fraction"), 4)
    return rows.groupBy("split", source.alias("source")).agg(F.count("*").alias("records"), F.count_if("overlaps").alias("overlapping"), share.alias("mean_fraction"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return forest.similar_pairs(table(spark, d, "mem0"), Scratch(spark, "p6"))


def p6_classes(spark: SparkSession, d: str) -> DataFrame:
    return forest.similar_classes(table(spark, d, "mem0"), Scratch(spark, "p6"))


def p6_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar vectors of every vector whose id, as a number, is divisible by 50."""
    asks = F.conv(F.substring("id", 29, 8), 16, 10).cast("bigint") % 50 == 0
    return forest.nearest(table(spark, d, "mem0"), Scratch(spark, "p6"), asks)


def _groups(spark: SparkSession, d: str, scratch: Scratch) -> DataFrame:
    """Match groups, written once since several joins read them."""
    return scratch.save(components.match_groups(table(spark, d, "dedup_log"), scratch), "groups")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p7")
    return survivor.survivors(table(spark, d, "dream_memory"), table(spark, d, "dedup_log"), _groups(spark, d, scratch), scratch)


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "p7")
    return survivor.surviving_records(table(spark, d, "dream_memory"), table(spark, d, "dedup_log"), _groups(spark, d, scratch), scratch)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bytebpe.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "probe_items"), Scratch(spark, "p9"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langs.mislabelled(table(spark, d, "documents"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    return langs.segments(table(spark, d, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_texts, p1_classes, p2_found, p3_found, p3_redacted, p4_found, p4_groups, p5_found, p5_classes, p5_report, p6_found, p6_classes, p6_nearest, p7_found, p7_records, p8_ids, p9_found, p10_found, p10_segments)}

ORACLE: dict[str, str] = {}
