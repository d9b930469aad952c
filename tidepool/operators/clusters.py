"""Clusterings of memories: equal keys, topic keys, and the cascade in which each row goes to the first phase it fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.text import text_hash
from tidepool.operators.components import components, leaders
from tidepool.operators.similarity import text_classes
from tidepool.runtime import Scratch


def equal_groups(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, n, first_id): groups of more than one row with an equal key; null keys form no group."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where("n > 1")


def topic_key(text: Column, patterns: Sequence[str]) -> Column:
    """First match of each pattern's group in lower case, joined with a bar; empty without a match or text."""
    parts = [F.nullif(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit("")) for p in patterns]
    return F.concat_ws("|", *parts)


def cascade(rows: DataFrame, patterns: Sequence[str], id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, cluster): by topic key (``topic_``), else by equal text (``exact_``) where at least two rows share it, else
    alone (``sim_``). Null texts stand alone. One pass: the size of a text's group comes from an aggregate joined back.
    These are the first two phases; ``full_cascade`` has all four."""
    keyed = rows.select(F.col(id_col).alias("id"), topic_key(F.col(text_col), patterns).alias("topic"), text_hash(F.col(text_col)).alias("h"))
    rest = keyed.where("topic = ''")
    twins = rest.where("h is not null").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    label = F.when(F.col("n").isNotNull(), F.concat(F.lit("exact_"), "h")).otherwise(F.concat(F.lit("sim_"), "id"))
    return keyed.where("topic <> ''").select("id", F.concat(F.lit("topic_"), "topic").alias("cluster")).unionByName(rest.join(twins, "h", "left").select("id", label.alias("cluster")))


def text_leaders(rows: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(id, leader): the ``leaders`` of all pairs of rows (id, text) whose texts reach the threshold, without making the pairs of
    copies: a text's smallest id comes first and is linked with whatever its copies are, so they join what it joins, or it."""
    near, copies = text_classes(rows, threshold, scratch)
    led = leaders(near.select("a", "b"), scratch).withColumnRenamed("id", "lead")
    return led.join(copies, "lead", "full").select(F.coalesce("id", "lead").alias("id"), F.coalesce("leader", "lead").alias("leader"))


def full_cascade(rows: DataFrame, patterns: Sequence[str], close: DataFrame | None, scratch: Scratch, similarity: float = 0.70) -> DataFrame:
    """(id, cluster): each row (id, text) goes to the first phase it fits: its topic key (``topic_``), an equal text
    (``exact_``, two rows at least), a component of close vectors (``vec_`` and its smallest id, two rows at least), the first
    leader by id whose text is similar (``sim_`` and the leader's id). Rows that nothing joins lead themselves.

    ``close``: pairs (a, b) of ids with close vectors; links to rows that an earlier phase took don't count.
    """
    two = scratch.save(cascade(rows.select("id", "text").dropDuplicates(["id"]), patterns), "two")
    rest = two.where(F.col("cluster").startswith("sim_")).select("id")
    done = two.where(~F.col("cluster").startswith("sim_"))
    if close is not None:
        inside = close.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi")
        vec = scratch.save(components(inside, scratch).select("id", F.concat(F.lit("vec_"), "root").alias("cluster")), "vec")
        done, rest = done.unionByName(vec), rest.join(vec, "id", "left_anti")
    texts = rows.select("id", "text").dropDuplicates(["id"]).join(rest, "id", "left_semi")
    led = text_leaders(texts, similarity, scratch)
    alone = rest.join(led, "id", "left").select("id", F.concat(F.lit("sim_"), F.coalesce("leader", "id")).alias("cluster"))
    return done.unionByName(alone)
