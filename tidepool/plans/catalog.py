"""Named queries of the engine's own operators, and the SQL that states the same results.

Where Spark SQL and ANSI SQL read alike, one statement serves both: its tables stand in braces. Otherwise the query is
built from the operators and the SQL is given beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import lexicons, scores, text
from tidepool.operators import clusters, decisions, graph, proposals, review, similarity, vectors
from tidepool.runtime import Scratch, table
from tidepool.sources import memory
from tidepool.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = f"TIMESTAMP '{memory.AS_OF}'"
VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"mem": memory.memories, "flight": memory.in_flight, "edges": memory.edges}
#: The same views for the other engine.
_JSON = "json_extract_string(CASE WHEN json_valid(payload) THEN payload END, '$.{}')"
WITH = f"""WITH mem AS (SELECT id AS memory_id, {_JSON.format("data")} AS text, {_JSON.format("user_id")} AS user_id, {_JSON.format("hash")} AS text_hash,
 lower(coalesce({_JSON.format("archived")}, 'false')) = 'true' AS archived, {_JSON.format("archived_at")} AS archived_at, coalesce(try_cast({_JSON.format("dream_tier")} AS int), 1) AS tier, created_at
 FROM (SELECT DISTINCT id, payload, created_at FROM mem0)),
flight AS (SELECT DISTINCT ON (id) * FROM dream_memory ORDER BY id),
edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, max(similarity) AS confidence FROM
 (SELECT lower(trim(kept_id)) AS a, lower(trim(removed_id)) AS b, similarity FROM dedup_log) WHERE a <> b
 AND regexp_full_match(a, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') AND regexp_full_match(b, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}') GROUP BY 1, 2)
"""


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = WITH + sql
        return f

    return register


def both(name: str, sql: str, other: str | None = None) -> None:
    """Register a statement that both engines read; ``other`` where the other engine's differs."""
    names = {n for n in (*VIEWS, "dedup_log", "processed_manifest", "sessions", "dream_runs", "events", "documents", "lineitem", "embeddings") if "{" + n + "}" in sql}

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(sql, **{n: VIEWS[n](spark, d) if n in VIEWS else table(spark, d, n) for n in names})

    QUERIES[name] = run
    stated = other or sql
    for n in (*VIEWS, "dedup_log", "processed_manifest", "sessions", "dream_runs", "events", "documents", "lineitem", "embeddings"):
        stated = stated.replace("{" + n + "}", n)
    ORACLE[name] = WITH + stated


# scans
both("recent_scan", f"SELECT memory_id, length(text) AS n FROM {{mem}} WHERE created_at > {NOW} - INTERVAL '48' HOUR AND length(text) > 20")
both("full_scan", "SELECT memory_id, length(text) AS n FROM {mem} WHERE length(text) > 20")
both("incremental_anti", f"SELECT memory_id FROM {{mem}} m WHERE created_at > {NOW} - INTERVAL '30' DAY AND length(text) > 20 AND NOT EXISTS (SELECT 1 FROM {{processed_manifest}} p WHERE p.memory_id = m.memory_id AND lower(trim(p.status)) = 'active')")
both("archived_scan", "SELECT memory_id, archived_at FROM {mem} WHERE archived AND length(text) > 20 ORDER BY archived_at DESC NULLS LAST, memory_id LIMIT 50")
both("conflict_candidates", f"SELECT memory_id, substring(text, 1, 300) AS head FROM {{mem}} WHERE NOT archived AND length(text) > 30 AND created_at > {NOW} - INTERVAL '7' DAY ORDER BY memory_id LIMIT 200")
both("tier1_candidates", f"SELECT memory_id FROM {{mem}} WHERE tier = 1 AND created_at < {NOW} - INTERVAL '30' DAY ORDER BY created_at, memory_id LIMIT 100")
both("tier2_candidates", f"SELECT memory_id FROM {{mem}} WHERE tier = 2 AND created_at < {NOW} - INTERVAL '180' DAY ORDER BY created_at, memory_id LIMIT 50")
both("keyed_fetch", "SELECT memory_id, length(text) AS n FROM {mem} WHERE memory_id IN (SELECT lower(trim(kept_id)) FROM {dedup_log})")
both("session_scan", "SELECT id, title, coalesce(estimated_cost_usd, 0) AS cost FROM {sessions} WHERE started_at > 1767139200 - 86400 * 30 AND length(title) > 5")
both("session_digest", "SELECT id, substring(title, 1, 50) AS title, message_count, coalesce(estimated_cost_usd, 0) AS cost FROM {sessions} WHERE length(title) > 5 ORDER BY coalesce(estimated_cost_usd, 0) DESC, id LIMIT 5")
both("recall_stats", "SELECT get_json_object(props, '$.k') AS query, count(*) AS n FROM {events} GROUP BY 1", "SELECT json_extract_string(props, '$.k') AS query, count(*) AS n FROM events GROUP BY 1")
both("run_history", "SELECT id, stage1_clusters, stage3_deduped FROM {dream_runs} ORDER BY id DESC LIMIT 10")
both("last_success", "SELECT max(id) AS id, count(*) AS runs FROM {dream_runs} WHERE error IS NULL AND finished_at IS NOT NULL")
both("run_window", "SELECT count(*) AS runs, count(error) AS failed, sum(stage3_deduped) AS deduped FROM {dream_runs} WHERE substring(started_at, 1, 10) >= '2025-12-24'")
# aggregates
both("hash_clusters", "SELECT text_hash, count(*) AS n, min(memory_id) AS first_id FROM {mem} WHERE text_hash IS NOT NULL GROUP BY text_hash HAVING count(*) > 1")
both("manifest_stats", "SELECT lower(trim(status)) AS status, count(*) AS n, round(avg(process_count), 6) AS mean_count, count(consolidated_at) AS consolidated FROM {processed_manifest} GROUP BY 1")
both("match_bands", "SELECT CASE WHEN similarity >= 0.92 THEN 'dedup' WHEN similarity >= 0.85 THEN 'merge' WHEN similarity >= 0.70 THEN 'cluster' ELSE 'below' END AS band, count(*) AS n, count(merged_text) AS merged FROM {dedup_log} GROUP BY 1")
both("concentration", "SELECT count(*) AS n, round(1 - least(1.0, stddev_pop(length(text)) / avg(length(text))), 6) AS concentration FROM {mem} WHERE text IS NOT NULL")
both("conflict_density", "SELECT count(*) AS n, round(avg(CASE WHEN merged_text IS NULL THEN 1.0D ELSE 0.0D END), 6) AS density FROM {dedup_log}",
     "SELECT count(*) AS n, round(avg(CASE WHEN merged_text IS NULL THEN 1.0 ELSE 0.0 END), 6) AS density FROM dedup_log")
both("days_per_session", "SELECT session_id, count(*) AS n, count(DISTINCT substring(created_at, 1, 10)) AS days FROM {flight} GROUP BY session_id")
both("best_of_session", "SELECT session_id, id, importance FROM (SELECT session_id, id, importance, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN importance BETWEEN 0 AND 1 THEN importance ELSE -1 END DESC, id) AS pos FROM {flight} WHERE session_id IS NOT NULL) WHERE pos = 1 AND importance BETWEEN 0 AND 1")
both("node_degree", "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) GROUP BY node")
both("entity_cooccurrence", """SELECT a.l_partkey AS left_part, b.l_partkey AS right_part, count(DISTINCT a.l_orderkey) AS shared, round(least(0.7, 0.3 + 0.1 * count(DISTINCT a.l_orderkey)), 6) AS confidence
 FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 ORDER BY shared DESC, left_part, right_part LIMIT 50""")
both("older_newer", """SELECT l.id, CASE WHEN a.created_at <= b.created_at THEN a.memory_id ELSE b.memory_id END AS older FROM {dedup_log} l JOIN {mem} a ON a.memory_id = lower(trim(l.kept_id)) JOIN {mem} b ON b.memory_id = lower(trim(l.removed_id))""")
both("session_outcome", "SELECT user_id, date_trunc('day', ts) AS day, CASE WHEN bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') THEN 'fail' WHEN bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error') THEN 'success' WHEN count(*) >= 3 AND NOT bool_or(event_type IN ('error', 'purchase')) THEN 'mixed' ELSE 'unknown' END AS outcome FROM {events} GROUP BY 1, 2",
     "SELECT user_id, cast(date_trunc('day', ts) AS timestamp) AS day, CASE WHEN bool_or(event_type = 'error') AND NOT bool_or(event_type = 'purchase') THEN 'fail' WHEN bool_or(event_type = 'purchase') AND NOT bool_or(event_type = 'error') THEN 'success' WHEN count(*) >= 3 AND NOT bool_or(event_type IN ('error', 'purchase')) THEN 'mixed' ELSE 'unknown' END AS outcome FROM events GROUP BY 1, 2")

_HASH = "substr(md5(regexp_replace(trim(lower(text), ' '), '[\\t\\n\\x0b\\x0c\\r ]+', ' ', 'g')), 1, 16)"


@query(f"SELECT {_HASH} AS text_key, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", text.text_hash(F.col("text")).alias("text_key"))
    return clusters.equal_groups(docs, "text_key", "doc_id").withColumnRenamed("first_id", "first_doc")


@query("SELECT memory_id, CASE WHEN b <= 6 THEN 'train' WHEN b <= 8 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT memory_id, ('0x' || substr(sha256(memory_id), 1, 8))::bigint % 10 AS b FROM mem)")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return memory.memories(spark, d).select("memory_id").distinct().select("memory_id", proposals.split_of(F.col("memory_id")).alias("split"))


@query("SELECT CASE WHEN b <= 6 THEN 'train' WHEN b <= 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS share FROM (SELECT ('0x' || substr(sha256(memory_id), 1, 8))::bigint % 10 AS b FROM (SELECT DISTINCT memory_id FROM mem)) GROUP BY 1")
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    return proposals.split_stats(hash_split(spark, d))


def _like(column: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w.lower()}')" for w in words) + ")"


def _sum(column: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({column}), '{w}')::int" for w in words) + ")"


_V, _S = _sum("text", lexicons.VOLATILE), _sum("text", lexicons.STABLE)
_TIER = f"CASE WHEN {_V} >= 2 THEN 'volatile' WHEN {_S} >= 2 THEN 'stable' WHEN {_V} > {_S} THEN 'volatile' WHEN {_S} > {_V} THEN 'stable' ELSE 'normal' END"
_AGE = f"(epoch_us({NOW}) - epoch_us(created_at)) / 8.64e10"
_RETAIN = "greatest(0.2, exp(-ln(2) / {h} * pow(greatest({age}, 0), {b})))"


def _retained(tier: str, age: str) -> str:
    return "CASE " + " ".join(f"WHEN {tier} = '{t}' THEN {_RETAIN.format(h=h, b=lexicons.BETA[t], age=age)}" for t, h in lexicons.HALF_LIFE.items()) + " END"


@query(f"SELECT memory_id, {_TIER} AS decay_tier FROM mem WHERE text IS NOT NULL")
def decay_tier(spark: SparkSession, d: str) -> DataFrame:
    return memory.memories(spark, d).where("text is not null").select("memory_id", scores.decay_tier(F.col("text")).alias("decay_tier"))


@query(f"SELECT memory_id, round({_retained('t', 'age')}, 6) AS retention FROM (SELECT memory_id, {_TIER} AS t, {_AGE} AS age FROM mem WHERE text IS NOT NULL)")
def retention(spark: SparkSession, d: str) -> DataFrame:
    m = memory.memories(spark, d).where("text is not null")
    age = scores.age_days(F.col("created_at"), memory.as_of())
    return m.select("memory_id", F.round(scores.retention(scores.decay_tier(F.col("text")), age), 6).alias("retention"))


_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_MARKED = "(" + " OR ".join(f"contains(text, '{m}')" for m in lexicons.PERMANENT) + ")"
_IMPORTANCE = f"""SELECT memory_id, round(0.12 * {_retained("t", "age")} + 0.18 * (CASE WHEN rc > 0 THEN least(1.0, log2(rc + 1) / 4) ELSE 0.1 END) + 0.12 * (CASE WHEN sc > 0 THEN least(1.0, sc / 5.0) ELSE 0.1 END)
 + 0.18 * (CASE WHEN inv THEN 0.9 WHEN tech THEN 0.6 ELSE 0.3 END) + 0.14 * (CASE WHEN rc >= 3 AND sc >= 2 THEN least(1.0, sqrt(rc * sc) / 4) WHEN sc >= 2 THEN 0.4 ELSE 0.1 END)
 + 0.08 * (CASE WHEN marked THEN 1.0 WHEN len(w) > 50 THEN least(1.0, 2.0 * len(list_distinct(w)) / len(w)) ELSE 0.3 END) + 0.18 * 0.9, 6) AS score
FROM (SELECT memory_id, {_TIER} AS t, {_AGE} AS age, {_like("text", lexicons.INVESTMENT)} AS inv, {_like("text", lexicons.TECHNICAL)} AS tech, {_MARKED} AS marked, {_WORDS} AS w,
 coalesce(rc, 0) AS rc, coalesce(sc, 0) AS sc FROM mem LEFT JOIN (SELECT coalesce(a, b) AS rid, count(*) AS rc, count(DISTINCT run) AS sc FROM (SELECT lower(trim(kept_id)) AS a, NULL AS b, dream_run_id AS run FROM dedup_log) GROUP BY 1) r ON r.rid = memory_id WHERE text IS NOT NULL)"""


@query(_IMPORTANCE)
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return decisions.scored(memory.memories(spark, d).where("text is not null"), decisions.recalls(table(spark, d, "dedup_log")), memory.as_of()).select("memory_id", F.round("score", 6).alias("score"))


@query(_IMPORTANCE.replace("SELECT memory_id, round(", "SELECT memory_id, CASE WHEN age > 90 AND s < 0.5 THEN 'decay' WHEN s > 0.7 THEN 'boost' WHEN s < 0.25 THEN 'decay' ELSE 'keep' END AS action FROM (SELECT memory_id, age, round(", 1).replace("AS score", "AS s", 1) + ")")
def boost_decay(spark: SparkSession, d: str) -> DataFrame:
    m = decisions.scored(memory.memories(spark, d).where("text is not null"), decisions.recalls(table(spark, d, "dedup_log")), memory.as_of())
    return m.select("memory_id", scores.decision(F.lit(1), F.round("score", 6), F.col("age")).alias("action"))


def _with_novelty(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest_distances(table(spark, d, "mem0"), Scratch(spark, "novelty"), 0.5, F.get_json_object("payload", "$.data") != "")
    return decisions.scored(memory.memories(spark, d).where("text is not null"), decisions.recalls(table(spark, d, "dedup_log")), memory.as_of(), near)


@query()
def importance_novelty(spark: SparkSession, d: str) -> DataFrame:
    """As importance_score, with novelty from the nearest vector of mem0 where that has the default."""
    return _with_novelty(spark, d).select("memory_id", F.round("score", 6).alias("score"))


@query()
def boost_decay_novelty(spark: SparkSession, d: str) -> DataFrame:
    return _with_novelty(spark, d).select("memory_id", scores.decision(F.lit(1), F.round("score", 6), F.col("age")).alias("action"))


@query("SELECT id, " + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for p in lexicons.DATED) + " AS is_dated FROM flight WHERE text IS NOT NULL")
def time_sensitive(spark: SparkSession, d: str) -> DataFrame:
    return memory.in_flight(spark, d).where("text is not null").select("id", text.dated(F.col("text")).alias("is_dated"))


@query(f"SELECT memory_id, CASE WHEN age > 7 AND dated THEN 'stale' WHEN age <= 1 THEN 'fresh' WHEN age <= 7 THEN 'recent' ELSE 'unknown' END AS label FROM (SELECT memory_id, {_AGE} AS age, " + " OR ".join(f"regexp_matches(text, '{p}', 'i')" for p in lexicons.DATED) + " AS dated FROM mem WHERE text IS NOT NULL)")
def freshness_label(spark: SparkSession, d: str) -> DataFrame:
    m = memory.memories(spark, d).where("text is not null")
    return m.select("memory_id", scores.freshness(scores.age_days(F.col("created_at"), memory.as_of()), text.dated(F.col("text"))).alias("label"))


_CLASS = "CASE " + " ".join(f"WHEN {_like('text', w)} THEN '{c}'" for c, w in lexicons.SIGNALS.items()) + " END"


@query(f"SELECT f.id, f.session_id, {_CLASS.replace('text', 'f.text')} AS signal FROM flight f JOIN sessions s ON s.id = f.session_id WHERE length(trim(f.text)) BETWEEN 15 AND 499 AND NOT starts_with(f.text, '[IMPORTANT') AND NOT contains(f.text, 'SYSTEM:') AND {_CLASS.replace('text', 'f.text')} IS NOT NULL")
def signal_scan(spark: SparkSession, d: str) -> DataFrame:
    return review.signals(memory.in_flight(spark, d), table(spark, d, "sessions"))


@query(f"SELECT id, CASE WHEN neg AND NOT pos THEN 'fail' WHEN pos AND NOT neg THEN 'success' ELSE 'unknown' END AS outcome FROM (SELECT id, {_like('text', lexicons.NEGATIVE)} AS neg, {_like('text', lexicons.POSITIVE)} AS pos FROM flight WHERE length(text) BETWEEN 6 AND 299) WHERE neg OR pos")
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    return review.feedback(memory.in_flight(spark, d))


_TOKENS = "list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', '', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda w: length(w) >= 4)"
_STOPS = ", ".join(f"'{w}'" for w in lexicons.STOP)


@query(f"SELECT token, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS token FROM flight) WHERE token NOT IN ({_STOPS}) AND NOT ends_with(token, 'ing') GROUP BY token ORDER BY n DESC, token LIMIT 100")
def keywords_top(spark: SparkSession, d: str) -> DataFrame:
    return review.keywords(memory.in_flight(spark, d)).orderBy(F.desc("n"), "token").limit(100)


@query(f"SELECT bigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1])) AS bigram FROM (SELECT {_TOKENS} AS t FROM flight)) GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100")
def bigrams_top(spark: SparkSession, d: str) -> DataFrame:
    return review.neighbours(memory.in_flight(spark, d), 1).select(F.concat_ws("-", "a", "b").alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


@query(f"SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(range(1, len(t)), lambda i: {{'a': t[i], 'b': t[i + 1]}}), list_transform(range(1, len(t) - 1), lambda i: {{'a': t[i], 'b': t[i + 2]}}))) AS p FROM (SELECT {_TOKENS} AS t FROM flight)), (SELECT 1) CROSS JOIN (SELECT 1)".split(", (SELECT 1)")[0].replace("least(a, b) AS a, greatest(a, b) AS b", "least(p.a, p.b) AS a, greatest(p.a, p.b) AS b") + " GROUP BY 1, 2")
def keyword_pairs_window(spark: SparkSession, d: str) -> DataFrame:
    p = review.neighbours(memory.in_flight(spark, d), 2)
    return p.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))


@query()
def valid_entities(spark: SparkSession, d: str) -> DataFrame:
    token = F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z][A-Za-z-]+)"), 1)).alias("name")
    return memory.in_flight(spark, d).select(token).distinct().where(text.valid_entity(F.col("name")))


@query("""SELECT concat_ws('|', CASE WHEN k <> '' THEN lower(k) END, CASE WHEN p <> '' THEN lower(p) END) AS topic, count(*) AS n, min(id) AS first_id FROM
 (SELECT id, regexp_extract(text, '(?i)(KD|ZL|OPS|MEM|TRK)-[0-9]+', 1) AS k, regexp_extract(text, '(?i)(srv|tmp|vault|notes|exports)/', 1) AS p FROM flight WHERE text IS NOT NULL) WHERE k <> '' OR p <> '' GROUP BY 1""")
def topic_key_clusters(spark: SparkSession, d: str) -> DataFrame:
    keyed = memory.in_flight(spark, d).select("id", clusters.topic_key(F.col("text"), ("(?i)(KD|ZL|OPS|MEM|TRK)-[0-9]+", "(?i)(srv|tmp|vault|notes|exports)/")).alias("topic"))
    return keyed.where("topic <> ''").groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query()
def cluster_cascade(spark: SparkSession, d: str) -> DataFrame:
    return clusters.cascade(memory.in_flight(spark, d), ("(?i)(KD|ZL|OPS|MEM|TRK)-[0-9]+",))


@query("SELECT session_id, n, days, CASE WHEN best >= 0.65 AND n >= 3 AND days >= 2 THEN 'all_3_gates' ELSE 'partial' END AS gate FROM (SELECT session_id, count(*) AS n, count(DISTINCT substring(created_at, 1, 10)) AS days, max(CASE WHEN importance BETWEEN 0 AND 1 THEN importance END) AS best FROM flight WHERE session_id IS NOT NULL GROUP BY session_id) WHERE n > 1")
def promotion_gates(spark: SparkSession, d: str) -> DataFrame:
    return decisions.promotion_gates(memory.in_flight(spark, d))


@query()
def contradiction_pairs(spark: SparkSession, d: str) -> DataFrame:
    return decisions.contradictions(memory.in_flight(spark, d).select("id", "session_id", "text"), (("更正", "不要"), ("Correction", "Contradiction"), *lexicons.OPPOSED))


# graph
@query("""SELECT e.src, e.dst, count(*) AS shared FROM edges e JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) x ON x.a = e.src JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) y ON y.a = e.dst AND y.b = x.b GROUP BY 1, 2""")
def shared_neighbors(spark: SparkSession, d: str) -> DataFrame:
    e = memory.edges(spark, d)
    return graph.shared_neighbours(e.select("src", "dst"), e)


@query("""SELECT src, dst, round(CASE WHEN pos <= k THEN confidence ELSE confidence * (1 - 0.15 * (pos - k + 1) / (n - k)) END, 4) AS confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence DESC, src, dst) AS pos, count(*) OVER () AS n, greatest(1, floor(0.2 * count(*) OVER ())) AS k FROM edges)
 WHERE pos <= k OR confidence * (1 - 0.15 * (pos - k + 1) / (n - k)) >= 0.08""")
def shy_downscale(spark: SparkSession, d: str) -> DataFrame:
    return graph.downscale(memory.edges(spark, d), Scratch(spark, "shy"))


@query("""SELECT src, dst, round(0.8 * CASE WHEN a.degree >= 5 AND b.degree >= 5 THEN least(1.0, confidence + 0.1) ELSE confidence END, 6) AS confidence FROM edges
 JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) a ON a.node = src JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) b ON b.node = dst""")
def hebbian_update(spark: SparkSession, d: str) -> DataFrame:
    return graph.hebbian(memory.edges(spark, d))


@query("""SELECT src, dst, round(least(0.7, 0.4 + least(0.2, 0.05 * shared)), 6) AS confidence FROM (SELECT e.src, e.dst, count(*) AS shared FROM edges e JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) x ON x.a = e.src JOIN (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges) y ON y.a = e.dst AND y.b = x.b GROUP BY 1, 2)""")
def waking_gate(spark: SparkSession, d: str) -> DataFrame:
    e = memory.edges(spark, d)
    return graph.waking_gate(e.select("src", "dst", F.lit(2).alias("hops"), F.lit(False).alias("jumped")), e)


@query("SELECT src, dst, confidence FROM edges WHERE confidence < 0.6 ORDER BY confidence DESC, src, dst LIMIT 20")
def threat_edges(spark: SparkSession, d: str) -> DataFrame:
    return memory.edges(spark, d).where("confidence < 0.6").orderBy(F.desc("confidence"), "src", "dst").limit(20)


@query("SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT lower(trim(kept_id)) AS a, lower(trim(removed_id)) AS b FROM dedup_log WHERE merged_text IS NULL) WHERE a <> b AND length(a) = 36 AND length(b) = 36 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.confidence >= 0.9 AND e.src = least(a, b) AND e.dst = greatest(a, b))")
def relation_dedup(spark: SparkSession, d: str) -> DataFrame:
    t = lambda c: F.lower(F.trim(c))
    new = table(spark, d, "dedup_log").where("merged_text is null").select(t("kept_id").alias("src"), t("removed_id").alias("dst")).where("src <> dst and length(src) = 36 and length(dst) = 36")
    return graph.new_relations(new, memory.edges(spark, d).where("confidence >= 0.9"))


@query()
def dream_walk(spark: SparkSession, d: str) -> DataFrame:
    return graph.dream_walk(memory.edges(spark, d), Scratch(spark, "walk"))


# proposals and adoption
_PROPOSED = "SELECT id AS seq, lower(trim(removed_id)) AS memory_id, CASE WHEN similarity >= 0.92 THEN 'archive' WHEN merged_text IS NOT NULL THEN 'update_text' ELSE 'boost' END AS op, merged_text AS new_text FROM dedup_log WHERE length(trim(removed_id)) = 36"


@query(f"SELECT seq, memory_id, op FROM (SELECT *, sum(CASE WHEN op IN ('archive', 'update_text') THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS spent FROM ({_PROPOSED})) WHERE op = 'boost' OR spent <= 8")
def edit_budget(spark: SparkSession, d: str) -> DataFrame:
    return proposals.within_budget(proposals.from_matches(table(spark, d, "dedup_log")), 8).select("seq", "memory_id", "op")


@query(f"SELECT op, count(*) AS n, count(DISTINCT memory_id) AS ids FROM ({_PROPOSED}) GROUP BY op")
def staging_stats(spark: SparkSession, d: str) -> DataFrame:
    return proposals.stats(proposals.from_matches(table(spark, d, "dedup_log")))


@query(f"""SELECT m.memory_id, coalesce(t.new_text, m.text) AS text, m.archived OR coalesce(x.n, 0) > 0 AS archived FROM mem m LEFT JOIN (SELECT memory_id, arg_max(new_text, seq) AS new_text FROM ({_PROPOSED}) WHERE op = 'update_text' GROUP BY 1) t ON t.memory_id = m.memory_id
 LEFT JOIN (SELECT memory_id, count(*) AS n FROM ({_PROPOSED}) WHERE op = 'archive' GROUP BY 1) x ON x.memory_id = m.memory_id""")
def apply_proposals(spark: SparkSession, d: str) -> DataFrame:
    return proposals.adopt(memory.memories(spark, d), proposals.from_matches(table(spark, d, "dedup_log"))).select("memory_id", "text", "archived")


@query("""SELECT coalesce(p.memory_id, m.memory_id) AS memory_id, coalesce(p.n, 0) + CASE WHEN m.memory_id IS NULL THEN 0 ELSE 1 END AS process_count, CASE WHEN m.memory_id IS NULL THEN p.status ELSE 'active' END AS status FROM (SELECT memory_id, max(process_count) AS n, min(lower(trim(status))) AS status FROM processed_manifest GROUP BY 1) p FULL JOIN (SELECT DISTINCT memory_id FROM mem) m ON m.memory_id = p.memory_id""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    return proposals.upsert_manifest(table(spark, d, "processed_manifest"), memory.memories(spark, d).select("memory_id"))


@query("SELECT memory_id FROM (SELECT memory_id, count(consolidated_at) AS c FROM processed_manifest GROUP BY 1) WHERE c = 0")
def claim_unclaimed(spark: SparkSession, d: str) -> DataFrame:
    return proposals.claimable(table(spark, d, "processed_manifest"))


# similarity, vectors
@query()
def text_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_texts(memory.in_flight(spark, d).where("length(text) > 20").select("id", "text"), 0.85)


@query()
def merge_decision(spark: SparkSession, d: str) -> DataFrame:
    return text_pairs(spark, d).withColumn("action", F.when(F.col("similarity") >= 0.92, "dedup").otherwise("merge"))


@query()
def validate_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.in_flight(spark, d).where("length(text) >= 20").select("id", "text")
    asked = rows.where(proposals.split_of(F.col("id")) == "val").orderBy("id").limit(20)
    return similarity.top_similar(asked, rows, 5)


@query("SELECT vec_id, nbr, pos FROM (SELECT a.vec_id, b.vec_id AS nbr, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6), b.vec_id) AS pos FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE pos <= 3")
def knn_top3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.where("vec_id % 50 = 0"), e, 3).select("vec_id", "nbr", "pos")


@query("SELECT b.label, b.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings b JOIN (SELECT label, min(vec_id) AS lead FROM embeddings GROUP BY 1) g ON g.label = b.label JOIN embeddings a ON a.vec_id = g.lead WHERE b.vec_id <> g.lead")
def best_vs_group(spark: SparkSession, d: str) -> DataFrame:
    return vectors.against_lead(table(spark, d, "embeddings"))


@query()
def vector_pairs(spark: SparkSession, d: str) -> DataFrame:
    return vectors.close_pairs(table(spark, d, "embeddings"), 0.65)


# tiers, health, streams
_SENTENCES = "string_split(regexp_replace(text, '([.。!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_KEPT = f"list_filter({_SENTENCES}, lambda s: regexp_matches(s, '[0-9]|[A-Z][A-Z]') OR length(s) < 80)"
_FOLD = "list_reduce({kept}, lambda acc, s: {{'t': CASE WHEN length(s) <= acc.left THEN acc.t || CASE WHEN acc.n > 0 THEN ' ' ELSE '' END || s ELSE acc.t END, 'left': CASE WHEN length(s) <= acc.left THEN acc.left - length(s) ELSE acc.left END, 'n': acc.n + CASE WHEN length(s) <= acc.left THEN 1 ELSE 0 END}}, {{'t': '', 'left': 200, 'n': 0}})"


@query(f"""SELECT memory_id, 2 AS tier, CASE WHEN length(text) <= 400 THEN text WHEN length(regexp_extract(substring(text, 1, 400), '(?s)^(.*[.])', 1)) > 200 THEN regexp_extract(substring(text, 1, 400), '(?s)^(.*[.])', 1) ELSE substring(text, 1, 400) END AS text
 FROM mem WHERE tier = 1 AND datediff('day', created_at::date, DATE '2025-12-31') > 30 AND length(text) >= 100
 UNION ALL SELECT memory_id, 3, CASE WHEN f.n > 0 THEN substring(f.t, 1, 200) ELSE substring(text, 1, 200) END FROM (SELECT memory_id, text, {_FOLD.format(kept=_KEPT)} AS f FROM mem WHERE tier = 2 AND datediff('day', created_at::date, DATE '2025-12-31') > 180 AND length(text) >= 30)""")
def tier_degrade(spark: SparkSession, d: str) -> DataFrame:
    return review.degraded(memory.memories(spark, d), memory.as_of())


@query("SELECT concat_ws(',', CASE WHEN new >= 10 THEN 'new' END, CASE WHEN density >= 0.3 THEN 'conflicts' END, CASE WHEN conc >= 0.9 THEN 'concentration' END) AS reasons, CASE WHEN new >= 30 OR density >= 0.3 THEN 'high' WHEN new >= 10 OR conc >= 0.9 THEN 'medium' ELSE 'none' END AS urgency FROM (SELECT (SELECT count(*) FROM mem WHERE created_at > " + NOW + " - INTERVAL '6' HOUR) AS new, (SELECT avg(CASE WHEN merged_text IS NULL THEN 1.0 ELSE 0.0 END) FROM dedup_log) AS density, (SELECT 1 - least(1.0, stddev_pop(length(text)) / avg(length(text))) FROM mem) AS conc)")
def trigger_check(spark: SparkSession, d: str) -> DataFrame:
    return review.trigger(memory.memories(spark, d), table(spark, d, "dedup_log"), memory.as_of())


@query()
def stream_incremental(spark: SparkSession, d: str) -> DataFrame:
    return streams.incremental(spark, f"{d}/mem0.parquet", Scratch(spark, "stream"))


@query()
def stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return streams.outcomes(spark, f"{d}/events.parquet", Scratch(spark, "stream"))


# health, review and recall as statements
both("store_health", """SELECT round(100 * (0.30 * least(1.0, 1.0 * covered / greatest(total, 1)) + 0.25 * (1 - 1.0 * open_pairs / greatest(pairs, 1)) + 0.20 * least(1.0, 1.0 * archived / greatest(total, 1) * 5) + 0.25 * least(1.0, 1.0 * linked / greatest(total, 1))), 4) AS health FROM
 (SELECT (SELECT count(*) FROM {mem}) AS total, (SELECT count(DISTINCT p.memory_id) FROM {processed_manifest} p JOIN {mem} m ON m.memory_id = p.memory_id) AS covered, (SELECT count(*) FROM {dedup_log} WHERE merged_text IS NULL) AS open_pairs, (SELECT count(*) FROM {dedup_log}) AS pairs,
 (SELECT count(*) FROM {mem} WHERE archived) AS archived, (SELECT count(DISTINCT m.memory_id) FROM {mem} m JOIN (SELECT src AS node FROM {edges} UNION SELECT dst FROM {edges}) e ON e.node = m.memory_id) AS linked) t""")
both("suggestion_review", "SELECT source, n, CASE WHEN n < 2 THEN 'rejected' WHEN words < 100 THEN 'needs_enrichment' ELSE 'reviewed' END AS status FROM (SELECT source, count(*) AS n, avg(n_chars) / 6 AS words FROM {documents} WHERE source IS NOT NULL GROUP BY source) t")
both("conflict_resolution", """SELECT l.id, CASE WHEN a.text IS NULL OR b.text IS NULL THEN 'false_positive' WHEN l.similarity >= 0.92 THEN 'supersede' ELSE 'extend' END AS verdict, CASE WHEN l.similarity >= 0.92 AND a.text IS NOT NULL AND b.text IS NOT NULL THEN CASE WHEN a.created_at <= b.created_at THEN a.memory_id ELSE b.memory_id END END AS archived_id
 FROM {dedup_log} l LEFT JOIN {mem} a ON a.memory_id = lower(trim(l.kept_id)) LEFT JOIN {mem} b ON b.memory_id = lower(trim(l.removed_id))""")
both("contrast_groups", "SELECT signal_type, count(CASE WHEN _outcome = 'success' THEN 1 END) AS good, count(CASE WHEN _outcome = 'fail' THEN 1 END) AS bad FROM {flight} GROUP BY signal_type HAVING count(CASE WHEN _outcome = 'success' THEN 1 END) > 0 AND count(CASE WHEN _outcome = 'fail' THEN 1 END) > 0")
both("mark_archived", "SELECT p.memory_id, CASE WHEN p.memory_id IN (SELECT lower(trim(removed_id)) FROM {dedup_log} WHERE similarity >= 0.92) THEN 'archived' ELSE lower(trim(p.status)) END AS status FROM {processed_manifest} p")
both("run_lifecycle", "SELECT id, CASE WHEN error IS NOT NULL THEN 'failed' WHEN finished_at IS NULL THEN 'zombie' ELSE 'done' END AS state FROM {dream_runs}")
both("relation_types", "SELECT upper(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_]', '_')) AS rel_type, count(*) AS n FROM {flight} GROUP BY 1", "SELECT upper(regexp_replace(coalesce(source, ''), '[^A-Za-z0-9_]', '_', 'g')) AS rel_type, count(*) AS n FROM flight GROUP BY 1")
both("permanent_guard", "SELECT memory_id FROM {mem} WHERE " + " OR ".join(f"text LIKE '%{m}%'" for m in lexicons.PERMANENT))
