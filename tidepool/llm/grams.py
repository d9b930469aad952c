"""Shared parts of the text joins: consistent forms by class, frequent features, and the exact check of pairs.

The similarity is that of distinct three-character sequences of the consistent form in lower case: those in both texts
divided by those in either. Three code points fit a 64-bit integer, so a text's sequences are an exact sorted array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.textform import consistent
from tidepool.operators.blocks import trigram_keys
from tidepool.runtime import Scratch

#: Counters by which features are counted; what reaches the driver is at most that many sums.
SLOTS, BLOCK = 1 << 20, 1 << 12
#: Occurrences up to which no feature is frequent: so few texts may share any tile.
COMMON = 64
#: Texts whose features are taken at once, and known texts a worker remembers to pass over their copies.
ROWS, SEEN = 2_000, 1 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a text's bitmap signature.
BITMAP = 512


def text_classes(df: DataFrame, scratch: Scratch, id_col: str = "id", text_col: str = "text", min_chars: int = 20, extra: dict[str, Column] | None = None) -> DataFrame:
    """(cls, id, form, extras): texts of more than ``min_chars`` characters in consistent form and lower case, each with
    a 64-bit key of its form. Written to the shared folder; keys are drawn anew should two forms share one."""
    extra = extra or {}
    kinds = {c.name: c.dataType.simpleString() for c in df.select(F.col(id_col).alias("id"), *(v.alias(k) for k, v in extra.items())).schema}
    source = df.where(F.length(text_col) > min_chars).select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *(v.alias(k) for k, v in extra.items()))
    for seed in range(8):

        def run(batches: Iterable[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                forms = [consistent(t).lower() for t in batch.column(0).to_pylist()]
                cls = np.array([xxhash.xxh3_64_intdigest(f, seed) for f in forms], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(forms), *batch.columns[1:]], ["cls", "form", *kinds])

        out = scratch.save(source.mapInArrow(run, "cls bigint, form string, " + ", ".join(f"{k} {v}" for k, v in kinds.items())), "forms")
        other = F.xxhash64("form")
        if out.groupBy("cls").agg(F.min(other).alias("lo"), F.max(other).alias("hi")).where("lo <> hi").isEmpty():
            return out
        scratch.drop(out)
    raise RuntimeError("text keys collide under every seed")


class Frequent:
    """Ranks of the frequent features by number of occurrences, 0 for all others. A feature is frequent if its counter has more than
    one in ``share`` of all occurrences, and more than ``COMMON``. A counter has one in ``SLOTS`` on average, so as long as ``share`` is well below that
    number, rare features that share a counter don't become frequent, at any size of the corpus; those that share one with
    a frequent feature do, in all texts alike."""

    def __init__(self, total: np.ndarray, share: int):
        rank = 4 * np.log2(np.maximum(total, 1))
        self.n = np.where((total * share > total.sum()) & (total > COMMON), rank, 0).astype(np.uint8)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        return self.n[(hashes % np.uint64(SLOTS)).astype(np.int64)]


def frequent(forms: DataFrame, features: Callable[[list[str]], np.ndarray], share: int) -> Frequent:
    """The frequent features, counted over all texts. ``features`` gives the hashes of all features of some texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                hashes = features(batch.column(0).slice(at, ROWS).to_pylist())
                total += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[k].tobytes() for k in some], pa.binary())], ["block", "n"])

    def add(group: pa.Table) -> pa.Table:
        n = np.sum([np.frombuffer(b, np.int64) for b in group["n"].to_pylist()], axis=0)
        return pa.table({"block": group["block"].slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    total = np.zeros((SLOTS // BLOCK, BLOCK), np.int64)
    sums = forms.select("form").mapInArrow(count, "block int, n binary").groupBy("block").applyInArrow(add, "block int, n binary").toArrow()
    for block, n in zip(sums["block"].to_pylist(), sums["n"].to_pylist()):
        total[block] = np.frombuffer(n, np.int64)
    return Frequent(total.reshape(-1), share)


def sampled(doc: np.ndarray, digest: np.ndarray, known: Frequent, fewest: int, part: int) -> np.ndarray:
    """The features each text is sampled by, as increasing places: one in ``part`` of its distinct ones, ``fewest`` at
    least. All texts use one order: by number of occurrences if frequent, then by digest."""
    order = np.lexsort((digest, known[digest], doc))
    d, g = doc[order], digest[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    order, d = order[first], d[first]
    number = np.bincount(d)
    place = np.arange(len(d)) - (np.cumsum(number) - number)[d]
    return np.sort(order[place < np.maximum(fewest, number // part)[d]])


def anchors(doc: np.ndarray, digest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of features that stand next to each other among those their text is sampled by, in either order;
    the single features of texts with less than three."""
    few = np.bincount(doc, minlength=1)[doc] < 3
    a, b, same = digest[:-1], digest[1:], doc[:-1] == doc[1:]
    keys = ((a ^ b) * _MIX + np.minimum(a, b))[same]
    return np.concatenate((doc[few], doc[:-1][same])), np.concatenate((digest[few] * np.uint64(3), keys)).view(np.int64)


def unseen(seen: set, key: object) -> bool:
    """Whether a worker meets a key for the first time, as far as it remembers."""
    if key in seen:
        return False
    if len(seen) >= SEEN:
        seen.clear()
    seen.add(key)
    return True


def trigrams(form: str) -> np.ndarray:
    """The distinct three-character sequences as a sorted array; empty for texts of less than three characters."""
    c = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:]) if len(c) > 2 else np.empty(0, np.uint64)


def sizes(forms: list[str]) -> np.ndarray:
    """The number of distinct three-character sequences of each text."""
    if not forms:
        return np.empty(0, np.int64)
    width = np.array([max(len(f) - 2, 0) for f in forms], np.int64)
    c = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(f) for f in forms], np.int64)
    doc = np.repeat(np.arange(len(forms)), width)
    at = np.arange(len(doc)) + (np.cumsum(length) - length - np.cumsum(width) + width)[doc]
    key = c[at] << np.uint64(42) | c[at + 1] << np.uint64(21) | c[at + 2] if len(doc) else np.empty(0, np.uint64)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[first], minlength=len(forms))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Hashed bitmap signature."""
    bits = np.zeros(BITMAP, np.uint8)
    bits[(grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(BITMAP)] = 1
    return np.packbits(bits).view(np.uint64)


def signatures(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(number of sequences, bitmap) of each text; a text that repeats is looked at once."""
    known: dict[str, int] = {}
    at = np.array([known.setdefault(f, len(known)) for f in forms], np.int64)
    grams = [trigrams(f) for f in known]
    size = np.array([len(g) for g in grams], np.int64)
    return size[at], np.array([bitmap(g) for g in grams], np.uint64).reshape(-1, BITMAP // 64)[at]


def may_reach(size_a: np.ndarray, map_a: np.ndarray, size_b: np.ndarray, map_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether bit counts leave the threshold possible: what a text has beyond its ones can at best be shared as well."""
    ones_a, ones_b, both = (np.bitwise_count(m).sum(axis=1).astype(np.int64) for m in (map_a, map_b, map_a & map_b))
    bound = np.minimum(np.minimum(size_a - ones_a, size_b - ones_b) + both, np.minimum(size_a, size_b))
    return bound >= threshold * (size_a + size_b - bound)


def similarities(forms_a: list[str], forms_b: list[str], threshold: float) -> np.ndarray:
    """Similarity of each pair by exact intersection of sorted arrays, 0 where it is below the threshold."""
    forms = list({*forms_a, *forms_b})
    row, key = trigram_keys(forms)
    known = dict(zip(forms, np.split(key, np.searchsorted(row, np.arange(1, len(forms))))))
    out = np.zeros(len(forms_a))
    for p, (x, y) in enumerate(zip(forms_a, forms_b)):
        a, b = known[x], known[y]
        n = len(np.intersect1d(a, b, assume_unique=True))
        either = len(a) + len(b) - n
        if either and n >= threshold * either:
            out[p] = n / either
    return out


def checked(pairs: DataFrame, forms: DataFrame, threshold: float, bounded: bool = False) -> DataFrame:
    """(a, b, similarity): the pairs of classes whose forms reach the threshold. ``forms``: (cls, form), repeated rows
    harmless. The first text of a pair travels as its signature until the bit counts have spoken; of pairs that are few as
    they are ``bounded`` already, only the texts in them travel."""
    reps = forms.select("cls", "form")
    if bounded:
        reps = reps.join(pairs.select(F.explode(F.array("a", "b")).alias("cls")), "cls", "left_semi")
    reps = reps.dropDuplicates(["cls"])
    first = reps.select(F.col("cls").alias("a"), F.col("form").alias("fa"))
    second = reps.select(F.col("cls").alias("b"), F.col("form").alias("fb"))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, maps = signatures(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size.astype(np.int32)), pa.array([m.tobytes() for m in maps], pa.binary())], ["a", "b", "n", "bits"])

    def bound(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size, maps = signatures(batch.column(4).to_pylist())
                other = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
                keep = pa.array(np.flatnonzero(may_reach(batch.column(2).to_numpy().astype(np.int64), other, size, maps, threshold)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = similarities(batch.column(2).to_pylist(), batch.column(3).to_pylist(), threshold)
            keep = pa.array(np.flatnonzero(s > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(s[s > 0])], ["a", "b", "similarity"])

    left = pairs
    if not bounded:
        signed = pairs.join(first, "a").select("a", "b", "fa").mapInArrow(sign, "a bigint, b bigint, n int, bits binary")
        left = signed.join(second, "b").select("a", "b", "n", "bits", "fb").mapInArrow(bound, "a bigint, b bigint")
    both = left.join(first, "a").join(second, "b")
    return both.select("a", "b", "fa", "fb").mapInArrow(exact, "a bigint, b bigint, similarity double")


def id_pairs(classes: DataFrame, members_a: DataFrame, members_b: DataFrame) -> DataFrame:
    """(id_a, id_b): class pairs and the pairs within classes as pairs of different ids, the smaller id first."""
    ids = classes.join(members_a.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(members_b.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
    return ids.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
