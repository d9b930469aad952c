"""Text similarity joins on the combined measure 0.4 words + 0.6 trigrams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.bands import Like, banded_pairs
from tidepool.operators.blocks import Measure, candidates, trigram_keys
from tidepool.runtime import Scratch


def features(text: str) -> tuple[frozenset[str], frozenset[str]]:
    """Distinct words and trigrams of a text in lower case."""
    low = text.lower()
    return frozenset(low.split()), frozenset(low[i : i + 3] for i in range(len(low) - 2))


def combined(a: tuple[frozenset, frozenset], b: tuple[frozenset, frozenset]) -> float:
    def jaccard(x: frozenset, y: frozenset) -> float:
        shared = len(x & y)
        return shared / (len(x) + len(y) - shared) if x and y else 0.0

    return 0.4 * jaccard(a[0], b[0]) + 0.6 * jaccard(a[1], b[1])


def _kinds(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The features of some texts for bitmaps."""
    low = [t.lower() for t in texts]
    known = {w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in {w for t in low for w in t.split()}}
    sets = [{known[w] for w in t.split()} for t in low]
    row = np.repeat(np.arange(len(low)), [len(w) for w in sets])
    return [(row, np.array([w for s in sets for w in s], np.uint64)), trigram_keys(low)]


#: The combined measure, for comparing all pairs.
MEASURE = Measure(_kinds, (0.4, 0.6), (128, 1024))
#: Sequences that a word counts as, where texts of one table meet.
WEIGHT = 3


@F.pandas_udf(T.DoubleType())
def combined_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    known = {t: features(t) for t in {*left, *right}}
    return pd.Series([combined(known[x], known[y]) for x, y in zip(left, right)], dtype="float64")


def similar_texts(rows: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(a, b, similarity): all pairs of different ids, a < b, whose texts reach the threshold (above 0.6).

    All pairs of different texts are compared by the bitmaps of their words and trigrams, see ``blocks``. Equal texts are
    compared once, and then each of their ids is paired with each. Texts without words or without trigrams reach nothing.
    """
    near, copies = text_classes(rows, threshold, Scratch(rows.sparkSession, "texts"), id_col, text_col)
    x, y = (copies.select(F.col("lead").alias(lead), F.col("id").alias(name)) for lead, name in (("a", "x"), ("b", "y")))
    apart = near.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "similarity")
    same = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return apart.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def text_links(rows: DataFrame, threshold: float, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(a, b): links of the same components as the pairs of ``similar_texts``, copies of a text with its smallest id only."""
    near, copies = text_classes(rows, threshold, Scratch(rows.sparkSession, "texts"), id_col, text_col)
    return near.select("a", "b").unionByName(copies.where("lead <> id").select(F.col("lead").alias("a"), F.col("id").alias("b")))


def text_classes(rows: DataFrame, threshold: float, scratch: Scratch, id_col: str = "id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity), (lead, id)): pairs of different texts that reach the threshold (above 0.6), each by the smallest id
    that has it, a < b; and the ids of each text that several have, the smallest too. A text without words or without
    trigrams doesn't even reach itself: its copies are in neither. The rows are read once."""
    rows = scratch.save(rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")), "rows")
    classes = scratch.save(rows.groupBy("t").agg(F.min("id").alias("lead"), F.count("*").alias("copies")), "classes")
    twins = classes.where("copies > 1").where(F.round(combined_similarity("t", "t"), 6) >= threshold).select("lead", F.sha2("t", 256).alias("h"))
    copies = scratch.save(rows.select("id", F.sha2("t", 256).alias("h")).join(twins, "h").select("lead", "id").distinct(), "copies")
    scratch.drop(rows)
    scratch.sweep()
    return near_classes(classes, threshold, scratch), copies


def near_classes(classes: DataFrame, threshold: float, scratch: Scratch, others: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): pairs of the classes (lead, t) of different texts that reach the threshold, by their leads; with
    ``others`` a of the one and b of the other classes. The classes are read several times."""
    if others is None:
        like = Like(threshold, (0.6, 0.4), lambda texts: _kinds(texts)[::-1], WEIGHT)
        pairs = scratch.save(banded_pairs(classes, like, scratch, "lead", "t"), "pairs")
    else:
        pairs = _met(classes, others, threshold, scratch)
    first, second = classes.select(F.col("lead").alias("a"), F.col("t").alias("ta")), (classes if others is None else others).select(F.col("lead").alias("b"), F.col("t").alias("tb"))
    full = pairs.join(first, "a").join(second, "b")
    return full.select("a", "b", F.round(combined_similarity("ta", "tb"), 6).alias("similarity")).where(F.col("similarity") >= threshold)


def _met(classes: DataFrame, others: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    blocks = Scratch(classes.sparkSession, "blocks")
    # above 0.6 + 0.4 / 2 few texts have words enough in common for another look
    pairs = scratch.save(candidates(classes, others, MEASURE, threshold, blocks, "lead", "t", first=(128, 0 if threshold > 0.8 else 256)), "pairs")
    blocks.clear()
    return pairs


def best_matches(new: DataFrame, stored: DataFrame, threshold: float) -> DataFrame:
    """(id, match, similarity): for each new text (id, text) the most similar stored one of another id that reaches the
    threshold (above 0.6), ties to the smaller id. Each different text is compared once, whatever its copies."""
    low = lambda df, name: df.where("text is not null").select(F.col("id").alias(name), F.lower("text").alias("t"))
    both = low(new, "id").withColumn("new", F.lit(True)).unionByName(low(stored, "id").withColumn("new", F.lit(False)))
    scratch = Scratch(new.sparkSession, "matches")
    classes = both.groupBy("t").agg(F.sha2("t", 256).alias("lead"), F.max("new").alias("has_new"), F.max(~F.col("new")).alias("has_stored"))
    classes = scratch.save(classes, "classes")
    scratch.sweep()
    near = near_classes(classes.where("has_new"), threshold, scratch, classes.where("has_stored"))
    same = classes.where("has_new and has_stored and t <> ''").select(F.col("lead").alias("a"), F.col("lead").alias("b"), F.lit(1.0).alias("similarity"))
    x, y = (low(df, name).select(name, F.sha2("t", 256).alias(lead)) for df, name, lead in ((new, "id", "a"), (stored, "match", "b")))  # no text travels
    # of a class of stored copies the two smallest ids are enough: one of them isn't the new id itself
    y = y.groupBy("b").agg(F.min("match").alias("one"), F.max("match").alias("other"))
    met = x.join(near.unionByName(same), "a").join(y, "b").select("id", "similarity", F.when(F.col("one") != F.col("id"), F.col("one")).otherwise(F.nullif("other", "id")).alias("match")).where("match is not null")
    best = met.groupBy("id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "match")).alias("m"))
    return best.select("id", F.col("m.match").alias("match"), (-F.col("m.d")).alias("similarity"))


def top_similar(asked: DataFrame, rows: DataFrame, k: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(query, id, similarity, pos): the k most similar other texts of each asked text. The asked texts are few by a limit
    of the caller, which is checked; all rows meet them in blocks, and each block hands on k rows for each."""
    held = asked.select(id_col, text_col).limit(1001).collect()
    if len(held) > 1000:
        raise ValueError("top_similar takes at most 1000 asked texts")
    queries = [(q, features(t)) for q, t in held if t]

    def run(blocks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in blocks:
            known = [(i, features(t)) for i, t in zip(block.iloc[:, 0], block.iloc[:, 1]) if t]
            out = []
            for q, f in queries:
                best = sorted(((round(combined(f, g), 6), i) for i, g in known if i != q), key=lambda x: (-x[0], x[1]))[:k]
                out += [(q, i, s) for s, i in best]
            yield pd.DataFrame(out, columns=["query", "id", "similarity"])

    kind = rows.schema[id_col].dataType.simpleString()
    scored = rows.select(id_col, text_col).mapInPandas(run, f"query {kind}, id {kind}, similarity double")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)
