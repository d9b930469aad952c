"""Whether changes harm search: the nearest texts of held-out queries before and after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators.similarity import top_similar


def queries_of(held: DataFrame, most: int = 20) -> DataFrame:
    """(id, text): the first held-out texts of 20 characters or more, cut to 500."""
    return held.where(F.length("text") >= 20).orderBy("id").limit(most).select("id", F.substring("text", 1, 500).alias("text"))


def _outcome(delta: Column, low: float, high: float = 0.02) -> Column:
    return F.when(delta > high, "improved").when(delta < low, "degraded").otherwise("same")


def summary(details: DataFrame, least_soft: float | None = -0.05, least_hard: float = 0.75) -> DataFrame:
    """One row (n, improved, same, degraded, hard, soft, accepted). No query at all is accepted."""
    n = F.count("*")
    count = lambda o: F.count_if(F.col("outcome") == o)
    s = details.agg(n.alias("n"), count("improved").alias("improved"), count("same").alias("same"), count("degraded").alias("degraded"), F.coalesce(1 - F.try_divide(count("degraded"), n), F.lit(1.0)).alias("hard"), F.coalesce(F.avg("delta"), F.lit(0.0)).alias("soft"))
    passed = F.col("hard") >= least_hard
    return s.withColumn("accepted", passed if least_soft is None else passed & (F.col("soft") >= least_soft)).withColumns({c: F.round(c, 4) for c in ("hard", "soft")})


def full(queries: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(query, before, after, delta, outcome): the best similarity of each query among the texts (id, text) before and after;
    0 where there is none. Rows with the query's own id are no result."""
    best = lambda rows, name: top_similar(queries, rows, 1).select("query", F.col("similarity").alias(name))
    q = queries.select(F.col("id").alias("query"))
    d = q.join(best(before, "before"), "query", "left").join(best(after, "after"), "query", "left").fillna(0.0, ["before", "after"])
    return d.withColumn("delta", F.round(F.col("after") - F.col("before"), 4)).withColumn("outcome", _outcome(F.col("delta"), -0.02))


def quick(queries: DataFrame, rows: DataFrame, removed: DataFrame) -> DataFrame:
    """(query, hit, delta, outcome): degraded only if a removed row (memory_id) was among a query's five best and the best
    similarity falls by more than 0.05."""
    gone = removed.select(F.col("memory_id").alias("id"), F.lit(True).alias("gone"))
    five = top_similar(queries, rows, 5).join(gone, "id", "left").groupBy("query").agg(F.max("similarity").alias("before"), F.max(F.coalesce("gone", F.lit(False))).alias("hit"))
    after = top_similar(queries, rows.join(gone, "id", "left_anti"), 1).select("query", F.col("similarity").alias("after"))
    d = queries.select(F.col("id").alias("query")).join(five, "query", "left").join(after, "query", "left").fillna(0.0, ["before", "after"]).fillna(False, ["hit"])
    d = d.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))
    return d.select("query", "hit", "delta", F.when(F.col("hit") & (F.col("delta") < -0.05), "degraded").when(F.col("delta") > 0.02, "improved").otherwise("same").alias("outcome"))


def probe(held: DataFrame, rows: DataFrame, least: float = 0.40) -> DataFrame:
    """One row (query, neighbour, similarity, rejected): the first held-out text whose best match among the rows that aren't
    held out reaches ``least``, and whether quick validation rejects that match's removal. Empty if there is none."""
    queries = queries_of(held)
    others = rows.join(held.select("id"), "id", "left_anti")
    near = top_similar(queries, others, 1).where(F.col("similarity") >= least).orderBy("query").limit(1).select("query", F.col("id").alias("neighbour"), "similarity")
    one = queries.join(near.select(F.col("query").alias("id")), "id", "left_semi")
    verdict = summary(quick(one, others, near.select(F.col("neighbour").alias("memory_id"))), least_soft=None).select((~F.col("accepted")).alias("rejected"))
    return near.join(F.broadcast(verdict))
