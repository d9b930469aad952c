"""The same or nearly the same text across splits, found by content-defined chunks.

A record's consistent form is cut where a rolling hash of the last characters has a given pattern, so an edit changes
only the chunks around it. Single chunks are met by chance ever more often as the records grow, so digests of two chunks in a
row are joined across splits, in pairs of neighbours among those a record is sampled by: frequent ones, counted over all
records, come last, the others in the order of their digests, the same at any size. What they join is checked exactly, and the
summed lengths of the chunks that a pair shares give the overlap of its records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.grams import ROWS, Frequent, anchors, checked, frequent, id_pairs, sampled, sizes, text_classes, unseen
from tidepool.runtime import Scratch

#: Characters the rolling hash sees; a cut after one position in CUT on average.
WINDOW, CUT = 2, 5
#: Chunk pairs a record is sampled by: one in ``PART``, FEWEST at least. One is frequent from one in ``SHARE`` of all.
FEWEST, PART, SHARE = 14, 3, 1 << 18
THRESHOLD = 0.70
# How the splits are written, in lower case without outer blanks.
SPLITS = {"train": ("train", "training"), "val": ("val", "validation", "valid", "dev"), "test": ("test", "testing")}
#: What separates texts that are cut together; as long as the rolling hash looks back.
PAD = "\0" * (WINDOW - 1)
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


def split_of(c: Column) -> Column:
    """train, val or test; null if the spelling is no known split."""
    t = F.lower(F.btrim(c))
    out = F.lit(None).cast("string")
    for name, spellings in SPLITS.items():
        out = F.when(t.isin(*spellings), name).otherwise(out)
    return out


def cut(forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, digest, length) of each chunk of the texts, in order. The cuts of a text depend on itself only."""
    text = "".join(f + PAD for f in forms)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    width = np.array([len(f) for f in forms], np.int64)
    last = np.cumsum(width + len(PAD))
    x = (c + np.uint64(1)) * _MIX
    x ^= x >> np.uint64(29)
    for k in range(1, len(PAD) + 1):
        x[last - k] = 0
    roll = x.copy()
    for k in range(1, WINDOW):
        roll[k:] += x[:-k] * np.uint64(_BASE >> k | 1)
    roll = (roll ^ roll >> np.uint64(31)) * _MIX >> np.uint64(32)
    full = width > 0
    mark = roll % np.uint64(CUT) == 0
    for k in range(1, len(PAD) + 1):
        mark[last - k] = False
    mark[(last - len(PAD) - 1)[full]] = True
    ends = np.flatnonzero(mark) + 1
    doc = np.searchsorted(last, ends, "left")
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))
    starts = np.maximum(starts, (last - width - len(PAD))[doc])
    sizes = ends - starts
    if not len(ends):
        return doc, np.empty(0, np.uint64), sizes
    local = np.arange(len(c))
    local[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(c))))
    power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(local.max()), _BASE, np.uint64))), dtype=np.uint64)
    digest = np.add.reduceat(x * power[local], starts)  # a text's blanks after its end count as zero
    return doc, (digest ^ digest >> np.uint64(32)) * _MIX + sizes.astype(np.uint64), sizes


def rows_of_two(doc: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, digest) of each two chunks in a row; of the single chunk of texts with no more."""
    same = doc[:-1] == doc[1:]
    alone = np.bincount(doc, minlength=1)[doc] == 1
    out = np.concatenate((doc[:-1][same], doc[alone])), np.concatenate(((digest[:-1] * np.uint64(31) ^ digest[1:])[same] * _MIX, digest[alone]))
    order = np.argsort(out[0], kind="stable")
    return out[0][order], out[1][order]


def _posted(forms: DataFrame, known: Frequent) -> DataFrame:
    """(anchor, cls, n): each class at its anchors, mostly once for each input partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                new = [(c, f) for c, f in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if unseen(seen, c)]
                if not new:
                    continue
                cls, text = zip(*new)
                doc, digest = rows_of_two(*cut(list(text))[:2])
                keep = sampled(doc, digest, known, FEWEST, PART)
                row, key = anchors(doc[keep], digest[keep])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(cls, np.int64)[row]), pa.array(sizes(list(text)).astype(np.int32)[row])], ["anchor", "cls", "n"])

    return forms.select("cls", "form").mapInArrow(run, "anchor bigint, cls bigint, n int")


def _classes(df: DataFrame, scratch: Scratch, id_col: str, text_col: str, split_col: str) -> DataFrame:
    split = split_of(F.col(split_col))
    return text_classes(df.where(split.isNotNull()), scratch, id_col, text_col, extra={"held": split != "train"})


def _near(forms: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """(a, b): a class of val or test and another one of train whose forms reach the threshold."""
    known = frequent(forms, lambda texts: rows_of_two(*cut(texts)[:2])[1], SHARE)
    a, b = (_posted(forms.where(side), known).select("anchor", F.col("cls").alias(s), F.col("n").alias(f"n{s}")) for side, s in (("held", "a"), ("not held", "b")))
    like = (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & (F.col("a") != F.col("b"))
    pairs = scratch.save(a.join(b, "anchor").where(like).select("a", "b").distinct(), "pairs")
    del a, b
    scratch.sweep()  # the anchors' shuffle files are no longer needed
    return scratch.save(checked(pairs, forms, threshold), "near").select("a", "b")


def cross_split_pairs(df: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "text", split_col: str = "_split") -> DataFrame:
    """(id_a, id_b): two ids, id_a < id_b, one in train and the other in val or test, whose texts of more than 20
    characters have at least the given similarity.

    Records without a known split, and null, empty and short texts, form no pair; exact copies count; a redelivered id
    counts once. Candidates share two neighbouring chunks among those each is sampled by, and their numbers of distinct
    sequences allow the threshold.
    """
    forms = _classes(df, scratch, id_col, text_col, split_col)
    near = _near(forms, scratch, threshold)
    held, train = (forms.where(w).select("cls", "id").distinct() for w in ("held", "not held"))
    same = held.select("cls").distinct().join(train, "cls", "left_semi").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return id_pairs(near.unionByName(same), held, train)


def cross_split_classes(df: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "text", split_col: str = "_split") -> DataFrame:
    """(id, side, class_id, links): each record in a pair of ``cross_split_pairs`` on its side (train or held), with the
    smallest id of its side with the same text and the number of different texts of the other side its text is near or
    equal to. Copies of one text are one text here and aren't expanded."""
    forms = _classes(df, scratch, id_col, text_col, split_col)
    member = forms.select("cls", "held", "id").distinct()
    both = member.select("cls", "held").distinct().groupBy("cls").count().where("count = 2").select("cls")
    near = _near(forms, scratch, threshold).unionByName(both.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    link = near.select(F.col("a").alias("cls"), F.lit(True).alias("held")).unionByName(near.select(F.col("b").alias("cls"), F.lit(False).alias("held")))
    low = member.groupBy("cls", "held").agg(F.min("id").alias("class_id")).join(link.groupBy("cls", "held").agg(F.count("*").alias("links")), ["cls", "held"])
    return member.join(low, ["cls", "held"]).select("id", F.when(F.col("held"), "held").otherwise("train").alias("side"), "class_id", "links")


def shared_fraction(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """(a, b, fraction): of each pair of classes the fraction of the first form's characters in chunks that the second has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                (doc, digest, size), (other, theirs, _) = (cut(part.column(i).to_pylist()) for i in (2, 3))
                both = set(zip(other.tolist(), theirs.tolist()))
                hit = np.array([k in both for k in zip(doc.tolist(), digest.tolist())], bool)
                total = np.bincount(doc, size, part.num_rows)
                fraction = np.bincount(doc, size * hit, part.num_rows) / np.maximum(total, 1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fraction)], ["a", "b", "fraction"])

    reps = forms.select("cls", "form").dropDuplicates(["cls"])
    texts = pairs.join(reps.select(F.col("cls").alias("a"), F.col("form").alias("fa")), "a").join(reps.select(F.col("cls").alias("b"), F.col("form").alias("fb")), "b")
    return texts.select("a", "b", "fa", "fb").mapInArrow(run, "a bigint, b bigint, fraction double")


def overlap_fractions(df: DataFrame, scratch: Scratch | None = None, threshold: float = THRESHOLD, id_col: str = "id", text_col: str = "text", split_col: str = "_split", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, split, extras, overlaps, fraction): for each record of val and test whether ``cross_split_pairs`` pairs it with a
    record of train, and the fraction of its characters in chunks shared with one such record, the best; 0 without a pair.
    Repeated rows come out repeated.

    Chunks shared with train as a whole say nothing: most are met there by chance.
    """
    scratch = scratch or Scratch(df.sparkSession, "fractions")
    forms = _classes(df, scratch, id_col, text_col, split_col)
    near = _near(forms, scratch, threshold)
    scratch.sweep()  # nor are the check's
    part = scratch.save(shared_fraction(near, forms), "fractions").groupBy(F.col("a").alias("cls")).agg(F.max("fraction").alias("fraction"))
    held, train = (forms.where(w).select("cls", "id").distinct() for w in ("held", "not held"))
    same = held.select("cls").distinct().join(train, "cls", "left_semi").select("cls", F.lit(1.0).alias("fraction"))
    best = held.join(part.unionByName(same), "cls").groupBy("id").agg(F.max("fraction").alias("fraction"))
    rows = df.select(F.col(id_col).alias("id"), split_of(F.col(split_col)).alias("split"), *extra).where("split <> 'train'").join(best, "id", "left")
    return rows.select("id", "split", *extra, F.col("fraction").isNotNull().alias("overlaps"), F.coalesce("fraction", F.lit(0.0)).alias("fraction"))
