"""Signals, keywords, tiers and health of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import lexicons
from tidepool.functions.text import any_of, first_class


def signals(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """(id, session_id, signal): messages of 15 to 499 characters of known sessions with the class of their first signal;
    system notices are left out. Rows without a signal don't come out."""
    text = F.col("text")
    clean = messages.where(F.length(F.trim(text)).between(15, 499) & ~text.startswith("[IMPORTANT") & ~F.contains(text, F.lit("SYSTEM:")))
    rows = clean.join(sessions.select(F.col("id").alias("session_id")), "session_id")
    return rows.select("id", "session_id", first_class(text, lexicons.SIGNALS).alias("signal")).where("signal is not null")


def feedback(messages: DataFrame) -> DataFrame:
    """(id, outcome): messages of 6 to 299 characters with praise or complaint."""
    low = F.lower("text")
    rows = messages.where(F.length("text").between(6, 299)).select("id", any_of(low, lexicons.NEGATIVE).alias("neg"), any_of(low, lexicons.POSITIVE).alias("pos")).where("neg or pos")
    return rows.select("id", F.when(F.expr("neg and not pos"), "fail").when(F.expr("pos and not neg"), "success").otherwise("unknown").alias("outcome"))


def tokens(text: str) -> Column:
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), r"https?://\S+", ""), "[^a-z]+", " ")
    return F.filter(F.split(clean, " "), lambda w: F.length(w) >= 4)


def keywords(rows: DataFrame) -> DataFrame:
    """(token, n): words of four letters or more that are no stop words and no -ing forms."""
    t = rows.where("text is not null").select(F.explode(tokens("text")).alias("token"))
    return t.where(~F.col("token").isin(*lexicons.STOP) & ~F.col("token").endswith("ing")).groupBy("token").agg(F.count("*").alias("n"))


def neighbours(rows: DataFrame, reach: int) -> DataFrame:
    """(a, b): words that stand at most ``reach`` apart, from the positions of one array without a join."""
    t = rows.where("text is not null").select(tokens("text").alias("t"))

    def apart(k: int) -> Column:
        places = F.when(F.size("t") > k, F.sequence(F.lit(1), F.size("t") - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.get("t", i - 1).alias("a"), F.get("t", i + (k - 1)).alias("b")))

    pairs = [apart(k) for k in range(1, reach + 1)]
    return t.select(F.explode(F.concat(*pairs) if len(pairs) > 1 else pairs[0]).alias("p")).select("p.*")


def degraded(memories: DataFrame, as_of: Column, second: int = 30, third: int = 180) -> DataFrame:
    """(memory_id, tier, text): memories old enough for the next tier with their shorter text. The second tier has at most
    400 characters, cut after the last full stop beyond 200; the third keeps the sentences with a digit or an acronym, or of
    less than 80 characters, that still fit 200, and the first 200 characters if none does. A sentence ends at its mark only
    before white space, so numbers and paths stay whole."""
    age = F.datediff(as_of, "created_at")
    head = F.substring("text", 1, 400)
    stop = F.length(F.regexp_extract(head, r"(?s)^(.*\.)", 1))
    shorter = F.when(F.length("text") <= 400, F.col("text")).otherwise(F.when(stop > 200, F.substring(head, F.lit(1), stop)).otherwise(head))
    parts = F.filter(F.split("text", r"(?<=[.。!?])\s+"), lambda s: s.rlike(r"\d|[A-Z]{2,}") | (F.length(s) < 80))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(200).alias("left"))

    def take(acc: Column, s: Column) -> Column:
        return F.when(F.length(s) <= acc["left"], F.struct(F.array_append(acc["kept"], s).alias("kept"), (acc["left"] - F.length(s)).alias("left"))).otherwise(acc)

    kept = F.aggregate(parts, start, take, lambda acc: acc["kept"])
    joined = F.when(F.size(kept) > 0, F.substring(F.array_join(kept, " "), 1, 200)).otherwise(F.substring("text", 1, 200))
    two = memories.where((F.col("tier") == 1) & (age > second) & (F.length("text") >= 100)).select("memory_id", F.lit(2).alias("tier"), shorter.alias("text"))
    three = memories.where((F.col("tier") == 2) & (age > third) & (F.length("text") >= 30)).select("memory_id", F.lit(3).alias("tier"), joined.alias("text"))
    return two.unionByName(three)


def trigger(memories: DataFrame, log: DataFrame, as_of: Column) -> DataFrame:
    """(reasons, urgency): one row that says why a run is due; urgencies are compared by rank."""
    m = memories.agg(F.count_if(F.col("created_at") > as_of - F.expr("INTERVAL '6' HOUR")).alias("new"), (1 - F.least(F.lit(1.0), F.stddev_pop(F.length("text")) / F.avg(F.length("text")))).alias("conc"))
    c = log.agg(F.avg(F.col("merged_text").isNull().cast("double")).alias("density"))
    reasons = F.concat_ws(",", F.when(F.col("new") >= 10, "new"), F.when(F.col("density") >= 0.3, "conflicts"), F.when(F.col("conc") >= 0.9, "concentration"))
    urgency = F.when((F.col("new") >= 30) | (F.col("density") >= 0.3), "high").when((F.col("new") >= 10) | (F.col("conc") >= 0.9), "medium").otherwise("none")
    return m.join(F.broadcast(c)).select(reasons.alias("reasons"), urgency.alias("urgency"))


def run_health(total: Column, archived: Column, pages: Column, clusters: Column, contradictions: Column, deduped: Column, inferred: Column) -> Column:
    """Health of a run from 0 to 100: freshness, coverage, coherence, efficiency and reachability in fixed weights."""
    n = F.greatest(total, F.lit(1))
    part = lambda x: F.least(F.lit(1.0), x)
    whole = 0.25 * part((total - archived) / n) + 0.25 * part(pages / F.greatest(clusters, F.lit(1))) + 0.20 * part(1 - contradictions / n) + 0.15 * part(1 - deduped / n)
    return F.round(100 * (whole + 0.15 * part(inferred / F.greatest(total * 0.5, F.lit(1.0)))), 1)


def as_memories(signals: DataFrame, per_type: int = 5) -> DataFrame:
    """(id, text, importance): the first signals of each type (id, signal, text) as memories of their own."""
    order = Window.partitionBy("signal").orderBy("id")
    few = signals.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= per_type)
    weight = F.when(F.col("signal") == "identity", 0.85).otherwise(0.5)
    return few.select(F.concat_ws("_", F.lit("signal"), "signal", "id").alias("id"), F.concat(F.lit("["), "signal", F.lit("] "), F.substring("text", 1, 300)).alias("text"), weight.alias("importance"))


def query_matches(memories: DataFrame, queries: DataFrame, most: int = 200) -> DataFrame:
    """(memory_id, hits, queries): for each memory (memory_id, text) the queries (query, n) of whose words of more than two
    characters at least half are part of its text: their summed counts and their number. The queries are the ``most`` most
    frequent ones, sent to all executors."""
    some = queries.where("query is not null").orderBy(F.desc("n"), "query").limit(most)
    some = some.select("n", F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) > 2).alias("words")).where(F.size("words") > 0)
    met = F.size(F.filter("words", lambda w: F.contains(F.lower("text"), w))) >= 0.5 * F.size("words")
    return memories.join(F.broadcast(some), met).groupBy("memory_id").agg(F.sum("n").alias("hits"), F.count("*").alias("queries"))
