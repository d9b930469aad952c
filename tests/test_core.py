import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import scores, text
from tidepool.functions.times import instant
from tidepool.functions import calls
from tidepool.operators import bands, blocks, clusters, components, decisions, graph, proposals, review, similarity, validation, vectors
from tidepool.plans import catalog, cycle
from tidepool.runtime import Scratch
from tidepool.sources import store
from tidepool.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_hash_ignores_case_and_blanks(spark):
    want = hashlib.md5(b"hello world").hexdigest()[:16]
    assert one(spark, text.text_hash(F.lit("  Hello \n WORLD "))) == want
    assert one(spark, text.text_hash(F.lit(None).cast("string"))) is None


def test_jaccard_examples(spark):
    w = lambda t: text.words(F.lit(t))
    assert one(spark, text.jaccard(w("hello world test"), w("hello world foo"))) == pytest.approx(0.5)
    assert one(spark, text.jaccard(w(""), w("a"))) == 0
    assert one(spark, F.size(text.ngrams(F.lit("ab")))) == 0
    assert one(spark, F.size(text.ngrams(F.lit("abcabc")))) == 3


@pytest.mark.parametrize(
    ("written", "utc"),
    [
        ("2025-01-04T02:27:21+08:00", "2025-01-03 18:27:21"), ("2025-05-21T11:05:27Z", "2025-05-21 11:05:27"), ("2025-07-12T20:01:22.000+0200", "2025-07-12 18:01:22"),
        ("2025/01/29 10:25", "2025-01-29 02:25:00"), ("2025-11-22", "2025-11-21 16:00:00"), ("1754271228", "2025-08-04 01:33:48"), ("unknown", None), ("  ", None), ("2025-13-40", None), (None, None),
    ],
)
def test_instant(spark, written, utc):
    got = one(spark, F.date_format(instant(F.lit(written).cast("string")), "yyyy-MM-dd HH:mm:ss"))
    assert got == utc


def test_retention_bounds(spark):
    r = lambda t, a: one(spark, scores.retention(F.lit(t), F.lit(a).cast("double")))
    assert r("volatile", 7.0) <= 0.21 and r("stable", 30.0) == pytest.approx(max(0.2, 2 ** -(30**0.8 / 30)))
    assert r("normal", 0.0) == 1.0 and r("normal", None) == 0.5 and r("normal", 7.0) == pytest.approx(0.5)


def test_decay_tier(spark):
    t = lambda x: one(spark, scores.decay_tier(F.lit(x)))
    assert t("the price and spread today") == "volatile" and t("I always prefer this server setup") == "stable" and t("hello") == "normal" and t("") == "normal"


def test_decisions(spark):
    d = lambda n, s, a: one(spark, scores.decision(F.lit(n), F.lit(s), F.lit(a)))
    assert d(1, 0.45, 91.0) == "decay" and d(1, 0.7, 1.0) == "keep" and d(2, 0.7, 1.0) == "boost" and d(2, 0.2, 1.0) == "decay"


def test_split_shares(spark):
    rows = spark.range(1000).select(F.concat(F.lit("dist-test-"), "id").alias("m")).select(proposals.split_of(F.col("m")).alias("split"))
    got = {r.split: r.n for r in proposals.split_stats(rows).collect()}
    assert 640 < got["train"] < 760 and 150 < got["val"] < 250 and 60 < got["test"] < 140


def test_budget_and_adoption(spark):
    p = spark.createDataFrame([(1, "a", "archive", None), (2, "b", "update_text", "new"), (3, "b", "update_text", "newer"), (4, "c", "delete", None), (5, "d", "boost", None)], "seq long, memory_id string, op string, new_text string")
    assert [r.seq for r in proposals.within_budget(p, 2).orderBy("seq").collect()] == [1, 2, 5]
    assert [r.seq for r in proposals.within_budget(p, 0).collect()] == [5]
    m = spark.createDataFrame([(x, "old", False) for x in "abcd"], "memory_id string, text string, archived boolean")
    got = {r.memory_id: (r.text, r.archived) for r in proposals.adopt(m, p).collect()}
    assert got == {"a": ("old", True), "b": ("newer", False), "d": ("old", False)}


def test_patch_right_wins(spark):
    a, b = F.create_map(F.lit("x"), F.lit("1"), F.lit("y"), F.lit("1")), F.create_map(F.lit("x"), F.lit("2"))
    assert one(spark, proposals.merged_patch(a, b)) == {"y": "1", "x": "2"}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.5), ("a", "c", 0.4), ("c", "d", 0.05)], "src string, dst string, confidence double")
    assert {(r.src, r.dst): r.shared for r in graph.shared_neighbours(e.select("src", "dst"), e).collect()} == {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 1}
    down = {(r.src, r.dst): r.confidence for r in graph.downscale(e, Scratch(spark, "t")).collect()}
    assert down[("a", "b")] == 0.9 and ("c", "d") not in down and down[("b", "c")] == pytest.approx(0.5 * (1 - 0.15 * 2 / 3), abs=1e-4)
    rel = graph.new_relations(spark.createDataFrame([("b", "a"), ("a", "a"), ("z", "y"), ("y", "z")], "src string, dst string"), e)
    assert [tuple(r) for r in rel.collect()] == [("y", "z")]
    walk = graph.dream_walk(e, Scratch(spark, "t"), seeds=1, steps=3)
    assert all(r.src < r.dst and r.hops >= 2 for r in walk.collect())


def test_walk_over_edges_without_weight(spark):
    rows = [("a", "b", 0.0), ("a", "c", 0.0), ("a", "d", -1.0), ("c", "d", None), ("d", "e", float("nan")), ("e", "f", 0.3)]
    e = spark.createDataFrame(rows, "src string, dst string, confidence double")
    assert {r.src for r in graph.dream_walk(e, Scratch(spark, "t"), seeds=6, steps=4).collect()} <= set("abcdef")
    tied = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.5), ("b", "x", 0.0), ("c", "d", 0.5)], "src string, dst string, confidence double")
    assert "x" not in {n for r in graph.dream_walk(tied, Scratch(spark, "t"), seeds=1, steps=5).collect() for n in (r.src, r.dst)}


def test_similar_texts_equal_brute_force(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [("a", base), ("b", base.replace("mu", "nu")), ("c", base.upper()), ("d", "something else entirely"), ("e", None), ("f", ""), ("g", base + " xi")]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {(r.a, r.b): r.similarity for r in similarity.similar_texts(df, 0.85).collect()}
    full = [(i, t) for i, t in rows if t]
    want = {}
    for i, s in full:
        for j, t in full:
            if i < j and (v := similarity.combined(similarity.features(s), similarity.features(t))) >= 0.85:
                want[i, j] = round(v, 6)
    assert ("a", "c") in got and got["a", "c"] == 1.0
    lead = lambda p: (min(p), max(p))
    assert {lead(p) for p in got} <= {lead(p) for p in want}
    assert {("a", "b"), ("a", "g")} <= set(got) or not {("a", "b"), ("a", "g")} <= set(want)


def copied_texts():
    """Texts of which some are alike, with copies: of the first and of the later of two alike, and of texts too short to be like anything."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [base, base + " xi", base.upper() + " XI", base + " xi", base, "something else entirely", "ok", "ok", "   ", "   ", "", "", None, "Something else entirely", base.replace("mu", "nu"), base + " xi omikron pi"]
    return [(f"{i:02d}", t) for i, t in enumerate(texts)] + [("99", base + " xi omikron pi")]


def similar_pairs(rows, threshold):
    """All pairs with their similarity, one by one."""
    sets = [(i, similarity.features(t)) for i, t in rows if t is not None]
    return {(i, j): s for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if (s := round(similarity.combined(x, y), 6)) >= threshold}


def test_copies_join_the_leader_that_their_text_joins(spark, tmp_path):
    rows = copied_texts()
    near = similar_pairs(rows, 0.70)
    leader = {}
    for x in sorted({i for p in near for i in p}):
        leader[x] = next((o for o in sorted(leader) if leader[o] == o and (o, x) in near), x)
    assert leader["02"] == leader["03"] == leader["04"] == leader["99"] == "00" and leader["13"] == "05" and not {"06", "07", "08", "09"} & set(leader)
    spark.createDataFrame([(i, t, "s") for i, t in rows], "id string, text string, session_id string").write.parquet(f"{tmp_path}/dream_memory.parquet")
    got = [tuple(r) for r in cycle.QUERIES["leader_clusters"](spark, str(tmp_path)).collect()]
    assert len(got) == len(leader) and dict(got) == leader


def test_merge_decision_of_every_pair_of_copies(spark, tmp_path):
    rows = copied_texts()
    want = {(*p, s, "dedup" if s >= 0.92 else "merge") for p, s in similar_pairs([r for r in rows if r[1] and len(r[1]) > 20], 0.85).items()}
    assert {w[3] for w in want} == {"dedup", "merge"} and {("02", "03"), ("03", "04"), ("15", "99")} <= {w[:2] for w in want}
    spark.createDataFrame(rows, "id string, text string").write.parquet(f"{tmp_path}/dream_memory.parquet")
    got = [tuple(r) for r in cycle.QUERIES["merge_decision"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_text_pairs_of_every_id(spark, tmp_path):
    """Copies are paired with each other and with what is like their text, whichever id is smaller; links of them have the same components."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(400)]
    texts = [" ".join(rng.sample(words, 14)) for _ in range(8)]
    texts += [f"{t} {words[k]}" for k, t in enumerate(texts[:5])]
    texts = [t.upper() if rng.random() < 0.3 else t for t in texts for _ in range(rng.randrange(1, 5))] + ["ok"] * 3 + [" " * 30] * 3 + [None]
    ids = rng.sample(range(1000), len(texts))
    rows = sorted((f"{i:03d}", t) for i, t in zip(ids, texts))
    want = similar_pairs([r for r in rows if r[1] and len(r[1]) > 20], 0.85)
    spark.createDataFrame(rows, "id string, text string").repartition(3).write.parquet(f"{tmp_path}/dream_memory.parquet")
    got = [tuple(r) for r in catalog.QUERIES["text_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) > 40 and set(got) == {(*p, s) for p, s in want.items()}
    df = spark.createDataFrame(rows, "id string, text string")
    by_links, by_pairs = ({tuple(r) for r in components.components(x, Scratch(spark, "t")).collect()} for x in (similarity.text_links(df, 0.85), spark.createDataFrame(list(want), "a string, b string")))
    assert by_links == by_pairs


def test_texts_of_common_words_make_few_candidates(spark):
    rng = random.Random(3)
    phrases = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(12)) for _ in range(6)]
    texts = [" ".join(rng.sample(phrases, 2)) + " " + " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(9)) for _ in range(300)]
    for t in texts[:60]:
        w = t.split()
        w[rng.randrange(len(w)) : rng.randrange(len(w)) + 1] = ["changed"] * rng.randrange(1, 4)
        texts.append(" ".join(w))
    rows = [(f"{i:04d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "lead string, t string")
    sets = [(i, similarity.features(t)) for i, t in rows]
    for threshold, first in ((0.70, (128, 256)), (0.85, (128, 0))):
        want = {(i, j) for n, (i, x) in enumerate(sets) for j, y in sets[n + 1 :] if round(similarity.combined(x, y), 6) >= threshold}
        met = {(r.a, r.b) for r in blocks.candidates(df, None, similarity.MEASURE, threshold, Scratch(spark, "t"), "lead", "t", first).collect()}
        assert len(want) >= 20 and want <= met and len(met) < 4 * len(want) + 50
        assert {(r.a, r.b) for r in similarity.similar_texts(df, threshold, "lead", "t").collect()} == want
        split = blocks.candidates(df.where("lead < '0200'"), df.where("lead >= '0200'"), similarity.MEASURE, threshold, Scratch(spark, "t"), "lead", "t", first)
        assert {(r.a, r.b) for r in split.collect()} == {p for p in met if p[0] < "0200" <= p[1]}


def test_texts_of_short_words_lose_no_pair(spark):
    """Texts of one-letter words have more words than the bound of kinds allows for, and meet the others all the same."""
    rng = random.Random(4)
    phrases = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(10)) for _ in range(8)]
    texts = [" ".join(rng.sample(phrases, 3)) + " " + " ".join("".join(rng.choices("klmnopqrst", k=6)) for _ in range(6)) for _ in range(300)]
    texts += [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=60)) for _ in range(60)]
    texts += [t + " " + " ".join(rng.choices("abcdefghij", k=12)) for t in texts[:60]] + [" ".join(t.split()[:-2]) for t in texts[300:360]] + ["", "x", "ab cd"]
    sets = [(f"{i:04d}", similarity.features(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(f"{i:04d}", t) for i, t in enumerate(texts)], "lead string, t string")
    like = bands.Like(0.70, (0.6, 0.4), lambda some: similarity._kinds(some)[::-1], similarity.WEIGHT)
    n = np.array([[len(f[1]), len(f[0])] for _, f in sets])
    assert 60 <= like.odd(bands.Block(n, None, None, n)).sum() < 200
    want = {(i, j) for k, (i, x) in enumerate(sets) for j, y in sets[k + 1 :] if round(similarity.combined(x, y), 6) >= 0.70}
    met = {(r.a, r.b) for r in bands.banded_pairs(df, like, Scratch(spark, "t"), "lead", "t").collect()}
    assert len(want) > 60 and any(j >= "0420" for _, j in want) and want <= met and len(met) < 4 * len(want) + 50


def test_vectors(spark):
    v = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 0, [0.9, 0.1]), (2, 0, [0.0, 1.0]), (3, 1, [1.0, 0.0])], "vec_id long, label int, embedding array<float>")
    near = {(r.vec_id, r.pos): r.nbr for r in vectors.nearest(v.where("vec_id = 0"), v, 2).collect()}
    assert near == {(0, 1): 3, (0, 2): 1}
    assert {r.vec_id for r in vectors.against_lead(v).collect()} == {1, 2}
    assert {(r.a, r.b) for r in vectors.close_pairs(v, 0.1).collect()} >= {(0, 3)}


def test_close_pairs_leave_out_none(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    at = rng.standard_normal((40, 16))
    v = np.concatenate([at + 0.6 * rng.standard_normal(at.shape) for _ in range(6)])
    odd = [(1000, [0.0] * 16), (1001, [float("nan")] * 16), (1002, [1.0, 2.0]), (1003, [2.0, 4.0]), (1004, None), (1005, [])]
    df = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *odd], "vec_id int, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in np.argwhere(1 - u @ u.T < 0.3) if i < j} | {(1002, 1003)}
    got = [(r.a, r.b) for r in vectors.close_pairs(df, 0.3).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 300


def test_novelty_from_the_nearest_vector(spark, tmp_path):
    v = lambda x, y: [x, y] + [0.0] * 62
    rows = [("a", v(1.0, 0.0)), ("a", v(1.0, 0.0)), ("b", v(3.0, 4.0)), ("c", v(-1.0, 0.0)), ("h", v(2.0, 0.1)), ("d", None), ("e", [1.0]), ("f", v(0.0, 0.0)), ("g", [float("nan")] * 64)]
    mem = spark.createDataFrame([(i, x, None if i == "h" else f'{{"data": "a plain text {i}"}}', dt.datetime(2025, 12, 31)) for i, x in rows], "id string, vector array<float>, payload string, created_at timestamp")
    near = {r.memory_id: r.distance for r in vectors.nearest_distances(mem, Scratch(spark, "t"), 0.5, F.col("payload").isNotNull()).collect()}
    assert near == {"a": 0.4, "b": 0.4, "h": 0.0012}  # h has no text: it looks for others, but is none's neighbour
    mem.write.parquet(f"{tmp_path}/mem0.parquet")
    spark.createDataFrame([], "id long, dream_run_id long, kept_id string").write.parquet(f"{tmp_path}/dedup_log.parquet")
    with_, without = ({r.memory_id: r.score for r in catalog.QUERIES[q](spark, str(tmp_path)).collect()} for q in ("importance_novelty", "importance_score"))
    assert {i: round(without[i] - with_[i], 6) for i in without} == {i: 0.018 if i in "ab" else 0.0 for i in "abcdefg"}


def test_clusters_and_review(spark):
    rows = spark.createDataFrame([("1", "see KD-1 now"), ("2", "same text"), ("3", "Same  TEXT"), ("4", None), ("5", "alone")], "id string, text string")
    got = {r.id: r.cluster for r in clusters.cascade(rows, ("(?i)(KD)-[0-9]+",)).collect()}
    assert got["1"] == "topic_kd" and got["2"] == got["3"] and got["2"].startswith("exact_") and got["4"] == "sim_4" and got["5"] == "sim_5"
    m = spark.createDataFrame([("m", 1, dt.datetime(2025, 1, 1), "x" * 150 + ". " + "y" * 400)], "memory_id string, tier int, created_at timestamp, text string")
    short = review.degraded(m, F.lit("2025-12-31").cast("timestamp")).first()
    assert short.tier == 2 and len(short.text) <= 400


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, text string")
    assert similarity.similar_texts(none, 0.85).count() == 0 and clusters.cascade(none, ("(x)",)).count() == 0
    e = spark.createDataFrame([], "src string, dst string, confidence double")
    assert graph.hebbian(e).count() == 0 and graph.downscale(e, Scratch(spark, "t")).count() == 0


def test_valid_entity(spark):
    names = ["KD", "ab", "the", "12-3", "aaaa", "running", "Krona", "x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n for r in df.where(text.valid_entity(F.col("n"))).collect()} == {"KD", "Krona"}


def links(spark, n=40, m=45, seed=4):
    rng = random.Random(seed)
    pairs = [(f"{rng.randrange(n):03d}", f"{rng.randrange(n):03d}") for _ in range(m)]
    return pairs, spark.createDataFrame([*pairs, (None, "001"), ("002", "002"), pairs[0], pairs[0][::-1]], "a string, b string")


def test_components_and_leaders_equal_one_by_one(spark):
    pairs, df = links(spark)
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    root, leader = {}, {}
    for x in sorted(near):
        todo = [x]
        while todo:
            y = todo.pop()
            if y not in root:
                root[y] = x
                todo += near[y]
        mine = [o for o in sorted(near[x]) if leader.get(o) == o]
        leader[x] = mine[0] if mine else x
    assert {r.id: r.root for r in components.components(df, Scratch(spark, "t")).collect()} == root
    assert {r.id: r.leader for r in components.leaders(df, Scratch(spark, "t")).collect()} == leader
    none = df.where("false")
    assert components.components(none, Scratch(spark, "t")).count() == 0 and components.leaders(none, Scratch(spark, "t")).count() == 0


def test_components_of_wide_graphs_in_few_rounds(spark):
    rng = random.Random(2)
    names = [f"{i:06d}" for i in rng.sample(range(10**6), 4000)]
    pairs = [(names[i], names[i + d]) for i in range(3990) for d in (1, rng.randrange(2, 9)) if i % 1000 < 985]
    root = {n: n for n in names}
    for _ in range(4000):
        last = dict(root)
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
        if last == root:
            break
    df = spark.createDataFrame(rng.sample(pairs, len(pairs)), "a string, b string").repartition(8)
    got = {r.id: r.root for r in components.components(df, Scratch(spark, "t"), max_rounds=6).collect()}
    assert got == {n: root[n] for p in pairs for n in p}


def test_stars_of_a_chain(spark):
    chain = [(f"{i:05d}", f"{i + 1:05d}") for i in range(3000)]
    random.Random(2).shuffle(chain)
    got = components.stars(spark.createDataFrame(chain, "a string, b string").coalesce(1)).collect()
    assert sorted(map(tuple, got)) == [("00000", f"{i + 1:05d}") for i in range(3000)]


def test_full_cascade(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [("1", "see KD-1 now"), ("2", "same text"), ("3", "Same  TEXT"), ("4", None), ("5", base), ("6", base.replace("mu", "nu")), ("7", "far away from all of it"), ("8", "another thing"), ("5", base)]
    close = spark.createDataFrame([("7", "8"), ("2", "7")], "a string, b string")
    got = {r.id: r.cluster for r in clusters.full_cascade(spark.createDataFrame(rows, "id string, text string"), ("(?i)(KD)-[0-9]+",), close, Scratch(spark, "t")).collect()}
    assert got["1"] == "topic_kd" and got["2"] == got["3"] and got["2"].startswith("exact_") and got["7"] == got["8"] == "vec_7" and got["5"] == got["6"] == "sim_5" and got["4"] == "sim_4"


def test_online_check_and_best_matches(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    stored = spark.createDataFrame([("s", base), ("t", base), ("n", None), ("e", "")], "id string, text string")
    new = spark.createDataFrame([("a", base.upper() + " "), ("b", base + " xi"), ("c", base.replace("alpha beta", "omega")), ("d", "nothing of the kind"), ("s", base), ("x", None), ("e", "")], "id string, text string")
    got = {r.id: r.action for r in decisions.online_check(new, stored).collect()}
    assert got["a"] == got["s"] == "SKIP" and got["d"] == "ADD" and got["e"] == "ADD" and "x" not in got
    assert {r.id: r.match for r in similarity.best_matches(new, stored, 0.85).collect()}["s"] == "t"
    for i, t in (("b", base + " xi"), ("c", base.replace("alpha beta", "omega"))):
        s = similarity.combined(similarity.features(t), similarity.features(base))
        assert got[i] == ("SKIP" if s >= 0.92 else "MERGE" if s >= 0.85 else "ADD")
    assert decisions.online_check(new.where("false"), stored).count() == 0


def test_write_check_reads_each_text_once_and_shuffles_no_text_at_the_end(spark):
    """Rows read anew for every use may differ, and their shuffles all take disk."""
    read = spark.sparkContext.accumulator(0)

    def once(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    new = spark.createDataFrame([(f"n{k}", f"{base} {k}") for k in range(40)], "id string, text string").mapInArrow(once, "id string, text string")
    stored = spark.createDataFrame([("s", base), ("t", f"{base} 7")], "id string, text string")
    got = decisions.online_check(new, stored)
    assert "hashpartitioning(t" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.action for r in got.collect()} == {"SKIP"} and read.value == 40


def test_validation(spark):
    held = [("q1", "the quick brown fox jumps over the lazy dog"), ("q2", "a totally different sentence about boats"), ("q3", "short")]
    rows = [*held, ("r1", "the quick brown fox jumps over a lazy dog"), ("r2", "nothing like it at all, my friend")]
    schema = "id string, text string"
    q, r = validation.queries_of(spark.createDataFrame(held, schema)), spark.createDataFrame(rows, schema)
    gone = spark.createDataFrame([("r1",)], "memory_id string")
    quick = {x.query: (x.hit, x.outcome) for x in validation.quick(q, r, gone).collect()}
    assert quick["q1"] == (True, "degraded") and "q3" not in quick
    s = validation.summary(validation.full(q, r, r)).first()
    assert (s.n, s.same, s.hard, s.accepted) == (2, 2, 1.0, True)
    p = validation.probe(spark.createDataFrame(held, schema), r).first()
    assert (p.query, p.neighbour, p.rejected) == ("q1", "r1", True)
    assert validation.summary(validation.full(q.where("false"), r, r)).first().accepted


def test_patches_budget_and_guard(spark):
    p = spark.createDataFrame([(1, "a", "archive", None, {"archived": "true", "superseded_by": "k"}), (2, "a", "boost", None, {"archived": "no"}), (3, "b", "boost", None, None)], "seq long, memory_id string, op string, new_text string, patch map<string,string>")
    m = spark.createDataFrame([(x, "old", False) for x in "abc"], "memory_id string, text string, archived boolean")
    got = {r.memory_id: r.attrs for r in proposals.adopt(m, p).collect()}
    assert got == {"a": {"archived": "no", "superseded_by": "k"}, "b": {}, "c": {}}
    log = spark.createDataFrame([(1, "k" * 36, "r" * 36, 0.95, None), (2, "k" * 36, "s" * 36, 0.95, None)], "id long, kept_id string, removed_id string, similarity double, merged_text string")
    kept = proposals.from_matches(log, permanent=spark.createDataFrame([("r" * 36,)], "memory_id string"))
    assert [r.memory_id for r in kept.collect()] == ["s" * 36]
    assert proposals.budget_left((4, 8), (0, 100), (0, 10)) == 0.5 and proposals.budget_left((9, 8)) == 0.0 and proposals.budget_left((7, 8)) == 0.125
    assert proposals.depth(0.5) == ("beliefs", "contrast") and proposals.depth(0.16) == ("contrast",) and proposals.depth(0.1) == ()
    assert [tuple(r) for r in proposals.skipped(p, 0).collect()] == [("archive", 1)] and proposals.removed(p).count() == 1


def test_tier_three_keeps_numbers_and_paths(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", 2, t, "Release 1.2.3 costs 3.14 dollars at docs/plan.md today. Next one."), ("b", 2, t, "x" * 120 + " " + "y" * 179 + "."), ("c", 2, t, None)]
    got = {r.memory_id: r.text for r in review.degraded(spark.createDataFrame(rows, "memory_id string, tier int, created_at timestamp, text string"), F.lit("2025-12-31").cast("timestamp")).collect()}
    assert got == {"a": rows[0][3], "b": rows[1][3][:200]}


def test_shared_neighbours_of_a_hub(spark):
    e = spark.createDataFrame([("h", f"n{i}", 1.0) for i in range(50)] + [("n0", "n1", 1.0), ("n2", "n3", 1.0)], "src string, dst string, confidence double")
    got = {(r.src, r.dst): r.shared for r in graph.shared_neighbours(e.select("src", "dst"), e).collect()}
    assert got[("n0", "n1")] == got[("h", "n0")] == 1 and len(got) == 6


def test_stream_outcomes_close_all_sessions(spark, tmp_path):
    rows = [(1, dt.datetime(2025, 1, 1, h), k) for h, k in ((0, "view"), (1, "error"), (20, "purchase"))] + [(2, dt.datetime(2025, 1, 1, 20), "view")]
    spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.user_id, r.n, r.outcome) for r in streams.outcomes(spark, f"{tmp_path}/events.parquet", Scratch(spark, "t")).collect()}
    assert got == {(1, 2, "fail"), (1, 1, "success"), (2, 1, "unknown")}


def test_calls(spark):
    asked = []

    def model(prompts):
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (4, None)], "n long, t string")
    cache = spark.createDataFrame([(hashlib.sha256(b"default:y").hexdigest()[:24], "cached", dt.datetime(2025, 1, 1))], "prompt_hash string, response string, created_at timestamp")
    got = {r.n: r.answer for r in calls.answered(df, F.col("t"), model, cache=cache, as_of=F.lit("2025-01-01 12:00:00").cast("timestamp")).collect()}
    assert got == {1: "X", 2: "cached", 3: "X", 4: None} and not asked
    assert {r.answer for r in calls.answered(df, F.col("t"), None).collect()} == {None}
    assert calls.tolerant_json('so: {"a": [1]} end') == {"a": [1]} and calls.tolerant_json("```json\n[1, 2]\n```") == [1, 2] and calls.tolerant_json("none") is None and calls.tolerant_json(None) is None
    assert one(spark, calls.merged_text(F.array(F.lit("ab"), F.lit("abc")), F.lit(None).cast("string"))) == "abc" and one(spark, calls.verdict(F.lit("I say extend it"))) == "EXTEND"
    rows = spark.createDataFrame([("k", f"{i:08d}", f"text {i}", "2025-01-01T00") for i in range(60)], "cluster string, id string, text string, created_at string")
    prompt = calls.cluster_prompt(rows).first().prompt
    assert prompt.startswith("[00000000] (2025-01-01) text 0\n") and prompt.count("\n") == 49


def test_store(spark, tmp_path):
    p = spark.createDataFrame([(1, "a", "update_text", "new", {"k": "v"}), (2, "b", "delete", None, None)], "seq long, memory_id string, op string, new_text string, patch map<string,string>")
    m = spark.createDataFrame([(x, "old", False) for x in "abc"], "memory_id string, text string, archived boolean")
    root = f"{tmp_path}/staging"
    path, refused = store.stage(p, root, 7, True), store.stage(p, root, 8, False)
    assert {r.memory_id: (r.text, r.attrs) for r in store.adopt(m, path, 7).collect()} == {"a": ("new", {"k": "v"}), "c": ("old", {})}
    with pytest.raises(ValueError, match="rejected"):
        store.adopt(m, refused, 8)
    assert {tuple(r) for r in store.staging_status(spark, root).select("run_id", "proposals", "accepted", "adopted").collect()} == {(7, 2, True, True), (8, 2, False, False)}
    assert spark.read.parquet(f"{path}/backup").count() == 2
    store.append(m, f"{tmp_path}/log", 7), store.append(m, f"{tmp_path}/log", 8)
    assert spark.read.parquet(f"{tmp_path}/log").groupBy("dream_run_id").count().count() == 2
    (tmp_path / "pages/sub").mkdir(parents=True)
    (tmp_path / "pages/a.md").write_text("---\ntitle: A\ndata_freshness: \"stale\"\n---\n# A"), (tmp_path / "pages/sub/b.txt").write_text("plain"), (tmp_path / "pages/README.md").write_text("x"), (tmp_path / "pages/c.png").write_text("x")
    assert {(r.name, r.freshness) for r in store.pages(spark, f"{tmp_path}/pages").collect()} == {("a.md", "stale"), ("b.txt", None)}
    assert one(spark, store.stale_daily(F.lit("x/daily/2025-01-01.md"), F.lit("2025-12-31").cast("date"))) and not one(spark, store.stale_daily(F.lit("x/b.md"), F.lit("2025-12-31").cast("date")))
    stub = one(spark, store.page_stub(F.lit("KD"), F.lit("projects"), F.array(F.lit("a"), F.lit("b")), F.lit("fresh"), F.lit("About."), "2025-12-31"))
    assert "tags: [a, b]" in stub and one(spark, store.frontmatter(F.lit(stub), "data_freshness")) == "fresh"


def test_graph_targets_and_boost(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0), ("a", "d", 1.0)], "src string, dst string, confidence double")
    labels = spark.createDataFrame([(x, "l") for x in "abcdz"], "node string, label string")
    assert {tuple(r) for r in graph.teleports(labels.where("node = 'a'"), labels, e).collect()} == {("a", "c")}
    rows = spark.createDataFrame([("1", "Cache and index"), ("2", "index the cache"), ("2", "cache"), ("3", None)], "cluster string, text string")
    got = {(r.src, r.dst): (r.clusters, r.rows, r.boost) for r in graph.boosted(spark.createDataFrame([("cache", "index"), ("no", "such")], "src string, dst string"), rows).collect()}
    assert got == {("cache", "index"): (2, 2, True), ("no", "such"): (0, 0, False)}


def test_every_query_has_a_function():
    assert set(cycle.ORACLE) <= set(cycle.QUERIES) and "hybrid_recall" in cycle.ORACLE
