"""Near-duplicate texts: all pairs of like size, bounded by bitmaps, then exact.

Texts are put in blocks in the order of their sizes, and blocks whose sizes' ratio allows the threshold meet: numbers of kinds
of sequences and then the bitmaps of every pair bound the overlap (see ``bands``), and what is left is intersected exactly. No
pair that reaches the threshold is left out, and the work grows with the square of the texts.

``every=False`` only pairs texts that share an anchor: pairs of a text's twelve-character sequences that stand next to each
other among those it is sampled by, and for short texts also of five-character ones. The same holds for every script, with
blanks or without. Frequent sequences, counted over all texts, are sampled last; the others in the order of their hashes, the
same in all texts at any size, so that edited places don't push out those that stayed. That grows with the texts, and loses
pairs; no query takes it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.bands import banded_pairs
from tidepool.llm.components import star_components
from tidepool.llm.grams import ROWS, Frequent, anchors, checked, frequent, id_pairs, sampled, sizes, text_classes, unseen
from tidepool.runtime import Scratch

THRESHOLD = 0.70
#: Characters of a sequence; sequences a text is sampled by: one in ``PART``, FEWEST at least. A sequence is frequent from
#: one in ``SHARE`` of all occurrences.
WIDTH, FEWEST, PART, SHARE = 12, 24, 10, 1 << 20
#: Characters up to which a text is short, and what it is sampled by besides.
SHORT, NARROW, FEW = 80, 5, 12
_MIX = np.uint64(0xD6E8FEB86659FD93)


def sequences(forms: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each sequence of ``width`` characters, in order; shorter texts are filled up."""
    forms = [f.ljust(width, "\0") for f in forms]
    length = np.array([len(f) for f in forms], np.int64)
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = length - (width - 1)
    doc = np.repeat(np.arange(len(forms)), number)
    at = np.arange(len(doc)) + (np.cumsum(length) - length - np.cumsum(number) + number)[doc]
    h = np.full(len(doc), width, np.uint64)
    for k in range(width):
        h = (h ^ c[at + k]) * _MIX
        h ^= h >> np.uint64(29)
    return doc, h * _MIX


def keys(forms: list[str], known: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """(text number, anchor) of each text."""
    doc, digest = sequences(forms)
    at = sampled(doc, digest, known, FEWEST, PART)
    row, key = anchors(doc[at], digest[at])
    few = np.array([k for k, f in enumerate(forms) if len(f) <= SHORT], np.int64)
    if len(few):
        doc, digest = sequences([forms[k] for k in few], NARROW)
        at = sampled(doc, digest, known, FEW, NARROW)
        more, other = anchors(doc[at], digest[at])
        row, key = np.concatenate((row, few[more])), np.concatenate((key, other))
    return row, key


def tiles(forms: DataFrame, known: Frequent) -> DataFrame:
    """(anchor, cls, n): each class in its tiles, mostly once for each input partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                new = [(c, f) for c, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if unseen(seen, c)]
                if not new:
                    continue
                cls, text = zip(*new)
                row, key = keys(list(text), known)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(cls, np.int64)[row]), pa.array(sizes(list(text)).astype(np.int32)[row])], ["anchor", "cls", "n"])

    return forms.select("cls", "form").mapInArrow(run, "anchor bigint, cls bigint, n int")


def near_classes(forms: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, every: bool = True) -> DataFrame:
    """(a, b, similarity): pairs of classes of different forms, a < b."""
    if every:
        reps = forms.select("cls", "form").dropDuplicates(["cls"])
        return checked(scratch.save(banded_pairs(reps, threshold, scratch, "cls", "form", forms), "pairs"), forms, threshold, bounded=True)
    known = frequent(forms, lambda texts: np.concatenate((sequences(texts)[1], sequences([t for t in texts if len(t) <= SHORT], NARROW)[1])), SHARE)
    posted = tiles(forms, known)
    a, b = (posted.select("anchor", F.col("cls").alias(s), F.col("n").alias(f"n{s}")) for s in "ab")
    like = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("a") < F.col("b"))
    pairs = scratch.save(a.join(b, "anchor").where(like).select("a", "b").distinct(), "pairs")
    del posted, a, b, like
    scratch.sweep()  # the tiles' shuffle files are no longer needed
    return checked(pairs, forms, threshold)


def near_pairs(df: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b): two ids, id_a < id_b, with texts of more than 20 characters and at least the given similarity.

    Exact copies count; a redelivered id counts once; null, empty and short texts form no pair.
    """
    forms = text_classes(df, scratch, id_col, text_col)
    near = scratch.save(near_classes(forms, scratch, threshold), "near").select("a", "b")
    members = forms.select("cls", "id").distinct()
    same = members.groupBy("cls").count().where("count > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return id_pairs(near.unionByName(same), members, members)


def near_groups(df: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, group_id, links): each id with a text of more than 20 characters, its group (the smallest id of the texts
    linked directly or through others, itself included) and how many other texts its text is near to. Copies of one text
    are one text here and aren't expanded."""
    forms = text_classes(df, scratch, id_col, text_col)
    near = scratch.save(near_classes(forms, scratch, threshold), "near").select("a", "b")
    members = forms.select("cls", "id").distinct()
    degree = near.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    root = star_components(near.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch).select(F.col("u").alias("cls"), F.col("v").alias("root"))
    rows = members.join(root, "cls", "left").join(degree, "cls", "left").select("id", F.coalesce("root", "cls").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    low = rows.groupBy("root").agg(F.min("id").alias("group_id"))
    return rows.join(low, "root").select("id", "group_id", "links")
