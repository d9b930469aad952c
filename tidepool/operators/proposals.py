"""Changes as data: proposals, the edit budget, adoption, the manifest and the held-out split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations that cost an edit; boosting and degrading are free.
COSTLY = ("archive", "update_text", "delete", "extend")


def split_of(id_: Column) -> Column:
    """train, val or test by the first 32 bits of the id's SHA-256, in the proportions 7 : 2 : 1."""
    bucket = F.conv(F.substring(F.sha2(id_, 256), 1, 8), 16, 10).cast("bigint") % 10
    return F.when(bucket <= 6, "train").when(bucket <= 8, "val").otherwise("test")


def split_stats(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("split").agg(F.count("*").alias("n"))
    return counts.select("split", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share"))


def from_matches(log: DataFrame, dedup: float = 0.92, permanent: DataFrame | None = None) -> DataFrame:
    """(seq, memory_id, op, new_text, patch): what a match log proposes for the removed ids. ``permanent``: (memory_id) of
    memories that are never archived."""
    op = F.when(F.col("similarity") >= dedup, "archive").when(F.col("merged_text").isNotNull(), "update_text").otherwise("boost")
    rows = log.where(F.length(F.trim("removed_id")) == 36).select(F.col("id").alias("seq"), F.lower(F.trim("removed_id")).alias("memory_id"), op.alias("op"), F.col("merged_text").alias("new_text"), "kept_id")
    patch = F.when(F.col("op") == "archive", F.create_map(F.lit("archived"), F.lit("true"), F.lit("superseded_by"), "kept_id")).when(F.col("op") == "boost", F.create_map(F.lit("dream_boost"), F.lit("true")))
    rows = rows.withColumn("patch", patch).drop("kept_id")
    if permanent is None:
        return rows
    marked = permanent.select("memory_id").distinct().withColumn("marked", F.lit(True))
    return rows.join(marked, "memory_id", "left").where((F.col("op") != "archive") | F.col("marked").isNull()).drop("marked")


def within_budget(proposals: DataFrame, edits: int) -> DataFrame:
    """The proposals that pass: free ones, and the first costly ones in order. The last that passes is found by a top-k,
    so no task orders all proposals."""
    costly = F.col("op").isin(*COSTLY)
    passed = proposals.where(costly).orderBy("seq").limit(edits).select("seq").withColumn("ok", F.lit(True))
    return proposals.join(F.broadcast(passed), "seq", "left").where(~costly | F.col("ok")).drop("ok")


def stats(proposals: DataFrame) -> DataFrame:
    return proposals.groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("memory_id").alias("ids"))


def merged_patch(old: Column, new: Column) -> Column:
    """Right-wins merge of two maps; null counts as empty."""
    empty = F.create_map().cast("map<string,string>")
    new = F.coalesce(new, empty)
    return F.map_concat(F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def adopt(memories: DataFrame, proposals: DataFrame) -> DataFrame:
    """The memories after all proposals: the latest text in order of seq, archived if any proposal archives, deleted rows
    gone. The proposals of an id are folded by aggregates that combine before the shuffle. If proposals have a ``patch`` the
    memories get a map ``attrs``: their own, if any, with the patches merged into it, the later of two values winning."""
    when = lambda op, c: F.when(F.col("op") == op, c)
    folded = proposals.groupBy("memory_id").agg(
        F.max_by(when("update_text", F.col("new_text")), when("update_text", F.col("seq"))).alias("new_text"), F.max(F.col("op") == "archive").alias("gone"), F.max(F.col("op") == "delete").alias("deleted")
    )
    out = memories.join(folded, "memory_id", "left").where(~F.coalesce("deleted", F.lit(False)))
    out = out.withColumn("text", F.coalesce("new_text", "text")).withColumn("archived", F.col("archived") | F.coalesce("gone", F.lit(False))).drop("new_text", "gone", "deleted")
    if "patch" not in proposals.columns:
        return out
    out = out if "attrs" in out.columns else out.withColumn("attrs", F.lit(None).cast("map<string,string>"))
    return out.join(patches(proposals), "memory_id", "left").withColumn("attrs", merged_patch(F.col("attrs"), F.col("merged"))).drop("merged")


def patches(proposals: DataFrame) -> DataFrame:
    """(memory_id, merged): the patches of each memory as one map; of two values of a key the one of the later seq."""
    each = proposals.select("memory_id", "seq", F.explode("patch").alias("key", "value"))
    last = each.groupBy("memory_id", "key").agg(F.max_by("value", "seq").alias("value"))
    return last.groupBy("memory_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("merged"))


def skipped(proposals: DataFrame, edits: int) -> DataFrame:
    """(op, n): what the budget of edits doesn't let through, by operation."""
    return proposals.select("seq", "op").join(within_budget(proposals, edits).select("seq"), "seq", "left_anti").groupBy("op").agg(F.count("*").alias("n"))


def removed(proposals: DataFrame) -> DataFrame:
    """(memory_id) archived or deleted by any proposal, each once."""
    return proposals.where(F.col("op").isin("archive", "delete")).select("memory_id").distinct()


def budget_left(edits: tuple[int, int] = (0, 8), tokens: tuple[int, int] = (0, 200_000), seconds: tuple[float, float] = (0.0, 1200.0)) -> float:
    """The least of the fractions left of edits, tokens and seconds, each given as (spent, limit); 0 once one is used up."""
    return max(0.0, min(1.0, *(1.0 - spent / limit if limit else 0.0 for spent, limit in (edits, tokens, seconds))))


def depth(fraction: float) -> tuple[str, ...]:
    """The deep steps that a run of so much budget left still takes."""
    return tuple(step for step, least in (("beliefs", 0.20), ("contrast", 0.15)) if fraction >= least)


def upsert_manifest(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """(memory_id, process_count, status): the manifest with the seen memories counted once more and active."""
    old = manifest.groupBy("memory_id").agg(F.max("process_count").alias("n"), F.min(F.lower(F.trim("status"))).alias("status"))
    new = seen.select("memory_id").distinct().withColumn("hit", F.lit(1))
    return old.join(new, "memory_id", "full").select("memory_id", (F.coalesce("n", F.lit(0)) + F.coalesce("hit", F.lit(0))).alias("process_count"), F.when(F.col("hit") == 1, "active").otherwise(F.col("status")).alias("status"))


def claimable(manifest: DataFrame) -> DataFrame:
    """Memories that no run has consolidated."""
    return manifest.groupBy("memory_id").agg(F.count("consolidated_at").alias("c")).where("c = 0").select("memory_id")
