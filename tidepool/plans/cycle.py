"""Named queries of whole steps: write checks, recall, validation, adoption, clusters; with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import lexicons
from tidepool.operators import clusters, components, decisions, graph, proposals, review, similarity, validation, vectors
from tidepool.plans import catalog
from tidepool.plans.catalog import _PROPOSED, NOW, ORACLE, QUERIES, both, query
from tidepool.runtime import Scratch, table
from tidepool.sources import memory

# the combined similarity of two texts for the other engine
_BLANK = "[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+"
_W = f"list_distinct(list_filter(string_split_regex(lower({{0}}), '{_BLANK}'), lambda w: w <> ''))"
_G = "list_distinct(list_transform(range(1, greatest(length(lower({0})) - 1, 1)), lambda i: substring(lower({0}), i, 3)))"
_J = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN len(list_intersect({0}, {1}))::double / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) ELSE 0 END"
_SIM = f"round(0.4::double * ({_J.format('x.w', 'y.w')}) + 0.6::double * ({_J.format('x.g', 'y.g')}), 6)"


def _sets(source: str, columns: str = "id") -> str:
    return f"(SELECT {columns}, {_W.replace('{0}', 'text')} AS w, {_G.format('text')} AS g FROM {source})"


def _flight(spark: SparkSession, d: str) -> DataFrame:
    return memory.in_flight(spark, d).select("id", "text", "session_id")


def _recent(spark: SparkSession, d: str, hours: int) -> DataFrame:
    m = memory.memories(spark, d).where(~F.col("archived") & (F.length("text") > 20))
    return m.where(F.col("created_at") > memory.as_of() - F.expr(f"INTERVAL '{hours}' HOUR")).select(F.col("memory_id").alias("id"), "text")


_HASH = "substr(md5(regexp_replace(trim(lower({}), ' '), '[\\t\\n\\x0b\\x0c\\r ]+', ' ', 'g')), 1, 16)"
_RECENT = f"(SELECT memory_id AS id, text FROM mem WHERE NOT archived AND length(text) > 20 AND created_at > {NOW} - INTERVAL '72' HOUR)"


@query(f"""SELECT f.id, CASE WHEN EXISTS (SELECT 1 FROM {_RECENT} r WHERE r.id <> f.id AND {_HASH.format('r.text')} = {_HASH.format('f.text')}) OR coalesce(s.sim, 0) >= 0.92 THEN 'SKIP' WHEN s.sim >= 0.85 THEN 'MERGE' ELSE 'ADD' END AS action
 FROM flight f LEFT JOIN (SELECT x.id, max({_SIM}) AS sim FROM {_sets('flight')} x JOIN {_sets(_RECENT)} y ON x.id <> y.id GROUP BY 1) s ON s.id = f.id WHERE f.text IS NOT NULL""")
def online_write_check(spark: SparkSession, d: str) -> DataFrame:
    """What to do with each in-flight text, against the base table's rows of the last 72 hours."""
    return decisions.online_check(_flight(spark, d).select("id", "text"), _recent(spark, d, 72))


_ARCHIVED = "(SELECT memory_id AS id, text FROM mem WHERE archived AND length(text) > 20 ORDER BY archived_at DESC NULLS LAST, memory_id LIMIT 50)"
_NEW = f"(SELECT memory_id AS id, text FROM mem WHERE NOT archived AND length(text) > 20 AND created_at > {NOW} - INTERVAL '720' HOUR)"


@query(f"SELECT y.id, max({_SIM}) AS similarity FROM {_sets(_ARCHIVED)} y JOIN {_sets(_NEW)} x ON x.id <> y.id GROUP BY 1 HAVING max({_SIM}) >= 0.55 ORDER BY similarity DESC, y.id LIMIT 10")
def associative_recall(spark: SparkSession, d: str) -> DataFrame:
    """The archived memories most like a new one, of the 50 archived last."""
    held = memory.memories(spark, d).where(F.col("archived") & (F.length("text") > 20)).orderBy(F.desc_nulls_last("archived_at"), "memory_id").limit(50).select(F.col("memory_id").alias("id"), "text")
    best = similarity.top_similar(held, _recent(spark, d, 720), 1).where("similarity >= 0.55")
    return best.select(F.col("query").alias("id"), "similarity").orderBy(F.desc("similarity"), "id").limit(10)


@query("""SELECT m.memory_id, sum(q.n)::bigint AS hits, count(*) AS queries FROM mem m JOIN (SELECT n, list_filter(string_split_regex(lower(title), '\\s+'), lambda w: length(w) > 2) AS words FROM
 (SELECT title, sum(message_count) AS n FROM sessions WHERE title IS NOT NULL GROUP BY 1 ORDER BY n DESC NULLS LAST, title LIMIT 200)) q ON len(q.words) > 0 AND len(list_filter(q.words, lambda w: contains(lower(m.text), w))) >= 0.5 * len(q.words) WHERE m.text IS NOT NULL GROUP BY 1""")
def recall_match(spark: SparkSession, d: str) -> DataFrame:
    """How often each memory is asked for, session titles standing for the queries."""
    asked = table(spark, d, "sessions").where("title is not null").groupBy(F.col("title").alias("query")).agg(F.sum("message_count").alias("n"))
    return review.query_matches(memory.memories(spark, d).where("text is not null").select("memory_id", "text"), asked)


_VEC = "(SELECT id, any_value(vector::DOUBLE[]) AS v FROM mem0 WHERE len(vector) = 64 AND NOT list_contains(list_transform(vector, lambda x: isnan(x)), true) AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY id)"
_SLOTS = f"(SELECT DISTINCT memory_id AS id, substring(text, 1, 300) AS text FROM mem WHERE NOT archived AND length(text) > 30 AND created_at > {NOW} - INTERVAL '7' DAY ORDER BY memory_id LIMIT 200)"
_SIM4 = _SIM.replace(", 6)", ", 4)")


def _usable(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vector")
    good = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "mem0").select("id", "vector").where(good).dropDuplicates(["id"])


@query(f"""SELECT a, b, distance, similarity FROM (SELECT x.id AS a, y.id AS b, round(1 - list_cosine_similarity(u.v, z.v), 4) AS distance, {_SIM4} AS similarity FROM {_sets(_SLOTS)} x JOIN {_sets(_SLOTS)} y ON x.id < y.id
 JOIN {_VEC} u ON u.id = x.id JOIN {_VEC} z ON z.id = y.id) WHERE distance < 0.6 AND similarity < 0.5 ORDER BY distance, a, b LIMIT 10""")
def slot_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """The closest pairs of recent memories with differing texts; 0.6 where the store's vectors are random."""
    m = memory.memories(spark, d).where(~F.col("archived") & (F.length("text") > 30) & (F.col("created_at") > memory.as_of() - F.expr("INTERVAL '7' DAY")))
    few = m.select(F.col("memory_id").alias("id"), F.substring("text", 1, 300).alias("text")).distinct().orderBy("id").limit(200)
    return decisions.slot_conflicts(few.join(_usable(spark, d), "id"), near=0.6)


@query()
def slot_resolution(spark: SparkSession, d: str) -> DataFrame:
    ages = memory.memories(spark, d).groupBy(F.col("memory_id").alias("id")).agg(F.min("created_at").alias("created_at"))
    return decisions.resolved_slots(slot_conflicts(spark, d), ages)


#: The query that recall is scored for.
ASKED, ASKED_VECTOR = "rebuild the index before friday", [float((k * 37) % 11 - 5) for k in range(64)]
_WORDS = list(dict.fromkeys(ASKED.split()))
_FOUND = "(" + " + ".join(f"contains(lower(coalesce(m.text, '')), '{w}')::int" for w in _WORDS) + f") / {float(len(_WORDS))}::double"


@query(f"""SELECT m.memory_id, round((0.5 * coalesce(greatest(0, list_cosine_similarity(v.v, {ASKED_VECTOR}::DOUBLE[])), 0) + 0.3 * least(1.0, {_FOUND} + 0.1 * power(2.0, -greatest(0, datediff('day', m.created_at::date, DATE '2025-12-31')) / 7.0))
 + 0.2 * CASE WHEN f.importance BETWEEN 0 AND 1 THEN f.importance ELSE 0.5 END) * CASE m.tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.25 END, 6) AS score FROM mem m LEFT JOIN {_VEC} v ON v.id = m.memory_id LEFT JOIN flight f ON f.id = m.memory_id""")
def hybrid_recall(spark: SparkSession, d: str) -> DataFrame:
    """All memories scored for one query by vector, words and importance."""
    m = memory.memories(spark, d).join(_usable(spark, d).withColumnRenamed("id", "memory_id"), "memory_id", "left")
    m = m.join(memory.in_flight(spark, d).select(F.col("id").alias("memory_id"), "importance"), "memory_id", "left")
    return decisions.hybrid_recall(m, ASKED, ASKED_VECTOR, memory.as_of())


_NEAREST = f"(SELECT x.id AS memory_id, round(min(greatest(1 - list_cosine_similarity(x.v, y.v), 0)), 4) AS distance FROM {_VEC} x JOIN {_VEC} y ON x.id <> y.id WHERE y.id IN (SELECT memory_id FROM mem WHERE text <> '') GROUP BY 1 HAVING min(1 - list_cosine_similarity(x.v, y.v)) < 0.5)"
ORACLE["importance_novelty"] = catalog.WITH + catalog._IMPORTANCE.replace("SELECT memory_id, round(", "SELECT s.memory_id, round(", 1).replace("0.18 * 0.9, 6", "0.18 * CASE WHEN z.distance IS NULL THEN 0.9 ELSE least(1.0, z.distance / 0.5) END, 6") + f" s LEFT JOIN {_NEAREST} z ON z.memory_id = s.memory_id"


# validation
_SPLIT = "CASE WHEN ('0x' || substr(sha256(id), 1, 8))::bigint % 10 <= 6 THEN 'train' WHEN ('0x' || substr(sha256(id), 1, 8))::bigint % 10 <= 8 THEN 'val' ELSE 'test' END"
_ROWS = "(SELECT id, text FROM flight WHERE length(text) >= 20)"
_QUERY = f"(SELECT id, substring(text, 1, 500) AS text FROM {_ROWS} WHERE {_SPLIT} = 'val' ORDER BY id LIMIT 20)"
_REMOVED = f"(SELECT DISTINCT memory_id FROM ({_PROPOSED}) WHERE op IN ('archive', 'delete'))"
_SIMS = f"(SELECT x.id AS query, y.id, {_SIM} AS similarity FROM {_sets(_QUERY)} x JOIN {_sets(_ROWS)} y ON x.id <> y.id)"
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS pos, id IN (SELECT memory_id FROM {_REMOVED}) AS gone FROM {_SIMS})"
_BEFORE_AFTER = f"(SELECT q.id AS query, coalesce(max(r.similarity), 0) AS b, coalesce(max(CASE WHEN NOT r.gone THEN r.similarity END), 0) AS a, coalesce(bool_or(r.gone AND r.pos <= 5), false) AS hit FROM {_QUERY} q LEFT JOIN {_RANKED} r ON r.query = q.id GROUP BY 1)"


def _validated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = memory.in_flight(spark, d).where("length(text) >= 20").select("id", "text")
    queries = validation.queries_of(rows.where(proposals.split_of(F.col("id")) == "val"))
    return queries, rows, proposals.removed(proposals.from_matches(table(spark, d, "dedup_log")))


@query(f"SELECT query, hit, round(a - b, 4) AS delta, CASE WHEN hit AND round(a - b, 4) < -0.05 THEN 'degraded' WHEN round(a - b, 4) > 0.02 THEN 'improved' ELSE 'same' END AS outcome FROM {_BEFORE_AFTER}")
def quick_validation(spark: SparkSession, d: str) -> DataFrame:
    return validation.quick(*_validated(spark, d))


@query(f"""SELECT count(*) AS n, count(*) FILTER (d > 0.02) AS improved, count(*) FILTER (d BETWEEN -0.02 AND 0.02) AS same, count(*) FILTER (d < -0.02) AS degraded, round(1 - count(*) FILTER (d < -0.02) / count(*), 4) AS hard, round(avg(d), 4) AS soft,
 1 - count(*) FILTER (d < -0.02) / count(*) >= 0.75 AND avg(d) >= -0.05 AS accepted FROM (SELECT round(a - b, 4) AS d FROM {_BEFORE_AFTER})""")
def full_validation(spark: SparkSession, d: str) -> DataFrame:
    """Before and after all removals that the match log proposes."""
    queries, rows, gone = _validated(spark, d)
    after = rows.join(gone.withColumnRenamed("memory_id", "id"), "id", "left_anti")
    return validation.summary(validation.full(queries, rows, after))


@query()
def safety_probe(spark: SparkSession, d: str) -> DataFrame:
    _, rows, _ = _validated(spark, d)
    return validation.probe(rows.where(proposals.split_of(F.col("id")) == "val"), rows)


# proposals
@query(f"SELECT op, count(*) AS n FROM (SELECT *, sum(CASE WHEN op IN ('archive', 'update_text') THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS spent FROM ({_PROPOSED})) WHERE op <> 'boost' AND spent > 8 GROUP BY op")
def skipped_ops(spark: SparkSession, d: str) -> DataFrame:
    return proposals.skipped(proposals.from_matches(table(spark, d, "dedup_log")), 8)


@query(f"SELECT memory_id FROM {_REMOVED}")
def removed_ids(spark: SparkSession, d: str) -> DataFrame:
    return proposals.removed(proposals.from_matches(table(spark, d, "dedup_log")))


@query(f"""SELECT memory_id, key, arg_max(value, seq) AS value FROM (SELECT memory_id, seq, 'archived' AS key, 'true' AS value FROM ({_PROPOSED}) WHERE op = 'archive' UNION ALL SELECT memory_id, seq, 'dream_boost', 'true' FROM ({_PROPOSED}) WHERE op = 'boost'
 UNION ALL SELECT p.memory_id, p.seq, 'superseded_by', l.kept_id FROM ({_PROPOSED}) p JOIN dedup_log l ON l.id = p.seq WHERE p.op = 'archive') WHERE memory_id IN (SELECT memory_id FROM mem) GROUP BY 1, 2""")
def payload_patch(spark: SparkSession, d: str) -> DataFrame:
    """What adoption leaves in the memories' attributes, one row for each key."""
    out = proposals.adopt(memory.memories(spark, d).dropDuplicates(["memory_id"]), proposals.from_matches(table(spark, d, "dedup_log")))
    return out.select("memory_id", F.explode("attrs").alias("key", "value"))


@query(f"SELECT p.seq, p.memory_id, p.op FROM ({_PROPOSED}) p WHERE p.op <> 'archive' OR p.memory_id NOT IN (SELECT memory_id FROM mem WHERE " + " OR ".join(f"text LIKE '%{m}%'" for m in lexicons.PERMANENT) + ")")
def guarded_proposals(spark: SparkSession, d: str) -> DataFrame:
    return proposals.from_matches(table(spark, d, "dedup_log"), permanent=QUERIES["permanent_guard"](spark, d)).select("seq", "memory_id", "op")


both("contradiction_status", "SELECT id, CASE WHEN lower(trim(kept_id)) IN (SELECT memory_id FROM {mem} WHERE archived) OR lower(trim(removed_id)) IN (SELECT memory_id FROM {mem} WHERE archived) THEN 'resolved' ELSE 'pending' END AS resolution FROM {dedup_log} WHERE merged_text IS NULL",
     "SELECT id, CASE WHEN coalesce(lower(trim(kept_id)) IN (SELECT memory_id FROM mem WHERE archived), false) OR coalesce(lower(trim(removed_id)) IN (SELECT memory_id FROM mem WHERE archived), false) THEN 'resolved' ELSE 'pending' END AS resolution FROM dedup_log WHERE merged_text IS NULL")
both("claim_memories", "SELECT memory_id, CASE WHEN count(consolidated_at) = 0 THEN true ELSE false END AS claimed, max(coalesce(consolidated_at, '2025-12-31T00:00:00Z')) AS consolidated_at FROM {processed_manifest} GROUP BY memory_id")
both("manifest_run", "SELECT memory_id, count(*) AS rows, max(last_dream_run_id) AS last_run FROM {processed_manifest} GROUP BY memory_id")
both("node_degree_all", "SELECT m.memory_id, count(e.node) AS degree FROM (SELECT DISTINCT memory_id FROM {mem}) m LEFT JOIN (SELECT src AS node FROM {edges} UNION ALL SELECT dst FROM {edges}) e ON e.node = m.memory_id GROUP BY m.memory_id")
both("freshness_by_score", "SELECT id, CASE WHEN importance < 0.15 THEN 'outdated' WHEN importance < 0.25 THEN 'stale' ELSE 'aging' END AS freshness FROM {flight} WHERE importance BETWEEN 0 AND 1")
both("session_outcome_lookup", "SELECT f.id, s.outcome FROM {flight} f LEFT JOIN (SELECT session_id, CASE WHEN max(CASE WHEN _outcome = 'fail' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN _outcome = 'success' THEN 1 ELSE 0 END) = 0 THEN 'fail' WHEN max(CASE WHEN _outcome = 'success' THEN 1 ELSE 0 END) = 1 AND max(CASE WHEN _outcome = 'fail' THEN 1 ELSE 0 END) = 0 THEN 'success' WHEN count(*) >= 3 THEN 'mixed' ELSE 'unknown' END AS outcome FROM {flight} WHERE session_id IS NOT NULL GROUP BY session_id) s ON s.session_id = f.session_id")
both("contrast_topics", "SELECT lower(substring(text, 1, 40)) AS topic, count(CASE WHEN _outcome = 'success' THEN 1 END) AS good, count(CASE WHEN _outcome = 'fail' THEN 1 END) AS bad FROM {flight} WHERE text IS NOT NULL GROUP BY 1 HAVING count(CASE WHEN _outcome = 'success' THEN 1 END) >= 1 AND count(CASE WHEN _outcome = 'fail' THEN 1 END) >= 1")
both("report_top", "SELECT 'dedup' AS list, kept_id AS item, count(*) AS n FROM {dedup_log} WHERE similarity >= 0.92 AND length(trim(kept_id)) = 36 GROUP BY 2 ORDER BY n DESC, item LIMIT 3")
both("orphan_pairs", "SELECT count(*) AS n FROM {dedup_log} l WHERE NOT EXISTS (SELECT 1 FROM {mem} m WHERE m.memory_id = lower(trim(l.kept_id))) AND NOT EXISTS (SELECT 1 FROM {mem} m WHERE m.memory_id = lower(trim(l.removed_id)))")


@query("SELECT session_id, arg_min(id, (coalesce(age, 9999), id)) AS id FROM (SELECT session_id, id, CASE WHEN regexp_full_match(created_at, '[0-9]{4}-[0-9]{2}-[0-9]{2}.*') THEN nullif(datediff('day', try_cast(substring(created_at, 1, 10) AS date), DATE '2025-12-31'), 0) END AS age FROM flight WHERE session_id IS NOT NULL) GROUP BY 1")
def freshest_sample(spark: SparkSession, d: str) -> DataFrame:
    """The youngest memory of each session; unreadable ages and those of 0 days count as 9999."""
    day = F.when(F.col("created_at").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring("created_at", 1, 10).try_cast("date"))
    age = F.coalesce(F.nullif(F.datediff(memory.as_of().cast("date"), day), F.lit(0)), F.lit(9999))
    rows = memory.in_flight(spark, d).where("session_id is not null")
    return rows.groupBy("session_id").agg(F.min_by("id", F.struct(age, "id")).alias("id"))


@query(f"""SELECT concat_ws('_', 'signal', signal, id) AS id, '[' || signal || '] ' || substring(text, 1, 300) AS text, CASE WHEN signal = 'identity' THEN 0.85 ELSE 0.5 END AS importance FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY id) AS pos FROM
 (SELECT f.id, f.text, {catalog._CLASS.replace('text', 'f.text')} AS signal FROM flight f JOIN sessions s ON s.id = f.session_id WHERE length(trim(f.text)) BETWEEN 15 AND 499 AND NOT starts_with(f.text, '[IMPORTANT') AND NOT contains(f.text, 'SYSTEM:')) WHERE signal IS NOT NULL) WHERE pos <= 5""")
def signals_as_memories(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.in_flight(spark, d)
    return review.as_memories(review.signals(rows, table(spark, d, "sessions")).join(rows.select("id", "text"), "id"))


@query("""SELECT round(100 * (0.25::double * least(1.0, (total - archived) / greatest(total, 1)) + 0.25::double * least(1.0, pages / greatest(groups, 1)) + 0.20::double * least(1.0, 1 - contra / greatest(total, 1)) + 0.15::double * least(1.0, 1 - dedup / greatest(total, 1)) + 0.15::double * least(1.0, infer / greatest(total * 0.5::double, 1))), 1) AS health FROM
 (SELECT (SELECT count(*) FROM mem)::double AS total, (SELECT count(*) FROM mem WHERE archived)::double AS archived, (SELECT count(DISTINCT kind) FROM documents)::double AS pages, (SELECT count(DISTINCT session_id) FROM flight)::double AS groups, 0::double AS contra, (SELECT count(*) FROM mem WHERE tier = 3)::double AS dedup, (SELECT count(*) FROM dream_runs)::double AS infer)""")
def run_health(spark: SparkSession, d: str) -> DataFrame:
    """Run health with stored counts in place of one run's: archived rows, kinds of pages, sessions, tier 3, runs."""
    m = memory.memories(spark, d).agg(F.count("*").alias("total"), F.count_if("archived").alias("archived"), F.count_if(F.col("tier") == 3).alias("dedup"))
    one = m
    for name, n in (("pages", table(spark, d, "documents").agg(F.countDistinct("kind"))), ("groups", memory.in_flight(spark, d).agg(F.countDistinct("session_id"))), ("infer", table(spark, d, "dream_runs").agg(F.count("*")))):
        one = one.join(F.broadcast(n.toDF(name)))
    c = F.col
    return one.select(review.run_health(c("total"), c("archived"), c("pages"), c("groups"), F.lit(0), c("dedup"), c("infer")).alias("health"))


# graph
@query("""SELECT node, target FROM (SELECT s.node, t.id AS target, row_number() OVER (PARTITION BY s.node ORDER BY g.degree DESC, t.id) AS pos FROM (SELECT node FROM (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) JOIN flight f ON f.id = node AND f.session_id IS NOT NULL ORDER BY degree DESC, node LIMIT 5) s
 JOIN flight o ON o.id = s.node JOIN flight t ON t.session_id = o.session_id AND t.id <> s.node JOIN (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) g ON g.node = t.id
 WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE (e.src = s.node AND e.dst = t.id) OR (e.dst = s.node AND e.src = t.id))) WHERE pos <= 3""")
def teleport_targets(spark: SparkSession, d: str) -> DataFrame:
    """Where a walk may jump from the five nodes of most edges, a memory's session being its label."""
    e = memory.edges(spark, d)
    labels = memory.in_flight(spark, d).where("session_id is not null").select(F.col("id").alias("node"), F.col("session_id").alias("label"))
    seeds = graph.degrees(e).join(labels.select("node"), "node").orderBy(F.desc("degree"), "node").limit(5)
    return graph.teleports(seeds, labels, e)


#: Pairs of names whose relation is looked at.
NAMES = (("ledger", "archive"), ("notes", "vault"), ("index", "cache"), ("rollup", "retriever"), ("budget", "notes"))
_NAMES = ", ".join(f"('{a}', '{b}')" for a, b in NAMES)


@query(f"""SELECT p.src, p.dst, coalesce(c.clusters, 0) AS clusters, coalesce(c.rows, 0)::bigint AS rows, coalesce(c.clusters, 0) >= 2 OR coalesce(c.rows, 0) >= 3 AS boost FROM (VALUES {_NAMES}) p(src, dst) LEFT JOIN (SELECT src, dst, count(*) FILTER (s AND t) AS clusters, sum(rows) AS rows FROM
 (SELECT src, dst, f.session_id, bool_or(contains(lower(substring(text, 1, 200)), src)) AS s, bool_or(contains(lower(substring(text, 1, 200)), dst)) AS t, count(*) FILTER (contains(lower(substring(text, 1, 200)), src) AND contains(lower(substring(text, 1, 200)), dst)) AS rows
 FROM flight f JOIN (VALUES {_NAMES}) v(src, dst) ON contains(lower(substring(text, 1, 200)), src) OR contains(lower(substring(text, 1, 200)), dst) WHERE text IS NOT NULL AND session_id IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2) c ON c.src = p.src AND c.dst = p.dst""")
def relation_boost(spark: SparkSession, d: str) -> DataFrame:
    rows = memory.in_flight(spark, d).where("session_id is not null").select(F.col("session_id").alias("cluster"), "text")
    return graph.boosted(spark.createDataFrame(list(NAMES), "src string, dst string"), rows)


# clusters
def _close(spark: SparkSession, d: str) -> DataFrame:
    m = _usable(spark, d).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding"))
    return vectors.close_pairs(m, 0.30).select("a", "b")


@query()
def cluster_phases(spark: SparkSession, d: str) -> DataFrame:
    """The cascade in its four phases."""
    return clusters.full_cascade(_flight(spark, d), ("(?i)(KD|ZL|OPS|MEM|TRK)-[0-9]+",), _close(spark, d), Scratch(spark, "cascade"))


@query()
def vector_components(spark: SparkSession, d: str) -> DataFrame:
    return components.components(_close(spark, d), Scratch(spark, "vectors"))


@query()
def text_components(spark: SparkSession, d: str) -> DataFrame:
    """(id, root): memories linked by texts of similarity 0.70, where at least three are: what beliefs are formed from."""
    rows = _flight(spark, d).where("length(text) > 20").select("id", "text")
    out = components.components(similarity.text_links(rows, 0.70), Scratch(spark, "texts"))
    large = out.groupBy("root").agg(F.count("*").alias("n")).where("n >= 3").select("root")
    return out.join(large, "root").select("id", "root")


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = _flight(spark, d).where("text is not null").select("id", "text")
    return clusters.text_leaders(rows, 0.70, Scratch(spark, "leaders"))
