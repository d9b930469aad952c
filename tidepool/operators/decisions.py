"""Scores and what follows from them: boost and decay, promotion, contradictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import scores
from tidepool.functions.text import key_nouns
from tidepool.operators.similarity import best_matches, combined_similarity
from tidepool.operators.vectors import cosine_distance
from tidepool.functions.text import text_hash
from tidepool.runtime import Scratch


def recalls(log: DataFrame) -> DataFrame:
    """(memory_id, rc, sc): how often and in how many runs a memory was kept."""
    return log.groupBy(F.lower(F.trim("kept_id")).alias("memory_id")).agg(F.count("*").alias("rc"), F.countDistinct("dream_run_id").alias("sc"))


def scored(memories: DataFrame, recalled: DataFrame, as_of: Column, distances: DataFrame | None = None) -> DataFrame:
    """The memories with age, rc, sc and score, the weighted sum of seven dimensions. ``distances``: (memory_id, distance)
    of the nearest other memory; without it novelty has its default."""
    m = memories.join(recalled, "memory_id", "left").fillna(0, ["rc", "sc"])
    m = m.join(distances, "memory_id", "left") if distances is not None else m.withColumn("distance", F.lit(None).cast("double"))
    text, rc, sc = F.col("text"), F.col("rc"), F.col("sc")
    m = m.withColumn("age", scores.age_days(F.col("created_at"), as_of))
    dims = {
        "recency": scores.retention(scores.decay_tier(text), F.col("age")), "frequency": scores.frequency(rc), "query_diversity": scores.diversity(sc), "domain": scores.domain(text),
        "consolidation": scores.consolidation(rc, sc), "confidence": scores.confidence(text), "novelty": scores.novelty(F.col("distance")),
    }
    return m.withColumn("score", scores.importance(dims))


def promotion_gates(memories: DataFrame, least_score: float = 0.65, least_size: int = 3, least_days: int = 2) -> DataFrame:
    """(session_id, n, days, gate): sessions of several memories and whether they pass all gates."""
    good = F.when(F.col("importance").between(0, 1), F.col("importance"))
    g = memories.where("session_id is not null").groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct(F.substring("created_at", 1, 10)).alias("days"), F.max(good).alias("best"))
    passed = (F.col("best") >= least_score) & (F.col("n") >= least_size) & (F.col("days") >= least_days)
    return g.where("n > 1").select("session_id", "n", "days", F.when(passed, "all_3_gates").otherwise("partial").alias("gate"))


def contradictions(rows: DataFrame, opposed: Sequence[tuple[str, str]], id_col: str = "id", cluster_col: str = "session_id") -> DataFrame:
    """(cluster, marker, left_id, right_id): two memories of a cluster of which one has the first and the other the second
    phrase of an opposed pair, and which share a key noun. Joined on cluster, pair and noun, never on the cluster alone."""
    text = F.lower("text")
    pairs = F.array(*[F.struct(F.lit(i).alias("marker"), F.contains(text, F.lit(a.lower())).alias("first"), F.contains(text, F.lit(b.lower())).alias("second")) for i, (a, b) in enumerate(opposed)])
    marked = rows.where("text is not null").select(F.col(cluster_col).alias("cluster"), F.col(id_col).alias("id"), F.explode(pairs).alias("m"), key_nouns(F.col("text")).alias("nouns"))
    marked = marked.where("m.first or m.second").select("cluster", "id", "m.*", F.explode("nouns").alias("noun"))
    left = marked.where("first").select("cluster", "marker", "noun", F.col("id").alias("left_id"))
    right = marked.where("second").select("cluster", "marker", "noun", F.col("id").alias("right_id"))
    return left.join(right, ["cluster", "marker", "noun"]).where("left_id <> right_id").select("cluster", "marker", "left_id", "right_id").distinct()


def online_check(new: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action): SKIP a new text (id, text) whose hash a stored one (id, text) has or that is 0.92 similar to one, MERGE
    it from 0.85 on, else ADD it. Stored rows of the same id don't count; null texts don't come out. Both are read once, so that
    of an id delivered with several texts one is looked at."""
    scratch = Scratch(new.sparkSession, "check")
    new, stored = (scratch.save(df.where("text is not null").select("id", "text"), name) for df, name in ((new, "new"), (stored, "stored")))
    scratch.sweep()
    h = stored.groupBy(text_hash(F.col("text")).alias("h")).agg(F.min("id").alias("one"), F.max("id").alias("other"))
    rows = new.select("id", text_hash(F.col("text")).alias("h")).join(h, "h", "left")
    known = F.coalesce((F.col("one") != F.col("id")) | (F.col("other") != F.col("id")), F.lit(False))
    rows = rows.select("id", known.alias("known")).join(best_matches(new, stored, 0.85), "id", "left")
    return rows.select("id", F.when(F.col("known") | (F.col("similarity") >= 0.92), "SKIP").when(F.col("similarity") >= 0.85, "MERGE").otherwise("ADD").alias("action"))


def slot_conflicts(candidates: DataFrame, most: int = 10, near: float = 0.15, alike: float = 0.5) -> DataFrame:
    """(a, b, distance, similarity): pairs of the candidates (id, text, vector), which are few by a limit of the caller, whose
    vectors are close though their texts differ: the same thing said with another value. The closest ``most`` pairs."""
    c = candidates.limit(1000)
    x, y = (c.select(F.col("id").alias(s), F.col("text").alias(f"t{s}"), F.col("vector").alias(f"v{s}")) for s in "ab")
    met = x.join(y, F.col("a") < F.col("b")).withColumn("distance", F.round(cosine_distance(F.col("va"), F.col("vb")), 4)).where(F.col("distance") < near)
    told = met.withColumn("similarity", F.round(combined_similarity("ta", "tb"), 4)).where(F.col("similarity") < alike)
    return told.orderBy("distance", "a", "b").limit(most).select("a", "b", "distance", "similarity")


def resolved_slots(conflicts: DataFrame, ages: DataFrame, most: int = 5) -> DataFrame:
    """(a, b, archived_id): of the conflicts whose texts differ by more than half, the closest ones, with the older memory
    (ages: id, created_at), the first of two of one time, to be archived."""
    few = conflicts.where(1 - F.col("similarity") > 0.5).orderBy("distance", "a", "b").limit(most)
    at = lambda s: ages.select(F.col("id").alias(s), F.col("created_at").alias(f"at_{s}"))
    return few.join(at("a"), "a").join(at("b"), "b").select("a", "b", F.when(F.col("at_a") <= F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("archived_id"))


def hybrid_recall(memories: DataFrame, query: str, vector: Sequence[float], as_of: Column, dim: int = 64) -> DataFrame:
    """(memory_id, score): each memory (memory_id, text, vector, importance, tier, created_at) against one query: half the
    vector similarity, three tenths the part of the query's words that the text has plus a bonus for fresh rows, a fifth the
    importance; times the tier's weight. Unusable vectors count as similarity 0, missing importances as 0.5."""
    words = [w for w in dict.fromkeys(query.lower().split()) if len(w) > 1]
    q = F.array(*(F.lit(float(v)) for v in vector))
    v = F.col("vector")
    usable = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    close = F.coalesce(F.when(usable, F.greatest(F.lit(0.0), 1 - cosine_distance(v, q))), F.lit(0.0))
    low = F.lower(F.coalesce("text", F.lit("")))
    found = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) / float(max(len(words), 1))
    age = F.greatest(F.lit(0), F.datediff(as_of, F.col("created_at")))
    text = F.least(F.lit(1.0), found + 0.1 * F.pow(F.lit(2.0), -age / 7))
    weight = F.when(F.col("tier") == 1, 1.0).when(F.col("tier") == 2, 0.5).otherwise(0.25)
    given = F.when(F.col("importance").between(0, 1), F.col("importance")).otherwise(0.5)
    return memories.select("memory_id", F.round((0.5 * close + 0.3 * text + 0.2 * given) * weight, 6).alias("score"))
