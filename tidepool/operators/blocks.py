"""Pairs of texts whose sets of features may be alike: every pair is compared, in blocks and without a shuffle of pairs.

A text's distinct features toggle bits of a bitmap by their hashes. Two bitmaps differ in at most as many bits as one set has
elements that the other lacks, so the bits bound the Jaccard similarity from above: with n elements in both sets together
and d differing bits it is at most (n - d) / (n + d). No pair that reaches the threshold is passed over; the work grows
with the square of the texts, at about one nanosecond for each 128 bits of a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import Scratch

#: Distinct features of some texts, one kind after the other: (text number, 64-bit hash) of each.
Features = Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]]

#: Texts of a block; texts that meet a block at a time; texts whose bitmaps are made at a time.
BLOCK, STEP, ROWS = 4096, 16, 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair (row, key) once, in order."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[first], key[first]


def trigram_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, key) of each distinct three-character sequence; three code points fit a 64-bit integer."""
    length = np.array([len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    number = np.maximum(length - 2, 0)
    row = np.repeat(np.arange(len(texts)), number)
    at = np.arange(len(row)) + (np.cumsum(length) - length - np.cumsum(number) + number)[row]
    used = np.zeros(0x110000, bool)
    used[c] = True
    letters = np.flatnonzero(used).astype(np.uint64)
    bits = np.uint64(len(letters).bit_length())
    if 3 * int(bits) + len(texts).bit_length() > 64:
        return distinct(row, c[at] << np.uint64(42) | c[at + 1] << np.uint64(21) | c[at + 2])
    # text number and the three letters' ranks fit one integer, which sorts fast
    rank = (np.cumsum(used) - 1).astype(np.uint64)[c]
    all_ = np.sort(row.astype(np.uint64) << np.uint64(3) * bits | rank[at] << np.uint64(2) * bits | rank[at + 1] << bits | rank[at + 2])
    first = np.ones(len(all_), bool)
    first[1:] = all_[1:] != all_[:-1]
    all_ = all_[first]
    part = (np.uint64(1) << bits) - np.uint64(1)
    a, b, c = (letters[all_ >> k * bits & part] for k in (np.uint64(2), np.uint64(1), np.uint64(0)))
    return (all_ >> np.uint64(3) * bits).astype(np.int64), a << np.uint64(42) | b << np.uint64(21) | c


def parity(row: np.ndarray, key: np.ndarray, rows: int, bits: int) -> np.ndarray:
    """The bitmaps of some texts, one row of 64-bit words each; of two bits a feature can be at, the later halves fold on
    the earlier ones."""
    out = np.zeros((rows, bits // 64), np.uint64)
    slot = (key * _MIX >> np.uint64(40)).astype(np.int64) % bits
    for at in range(0, rows, ROWS):
        some = slice(*np.searchsorted(row, (at, at + ROWS)))
        n = min(ROWS, rows - at)
        odd = np.bincount((row[some] - at) * bits + slot[some], minlength=n * bits).astype(np.uint8) & 1
        out[at : at + n] = np.packbits(odd, bitorder="little").view(np.uint64).reshape(n, -1)
    return out


def folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of so many words; what differs less in them differs less in the whole."""
    while bitmaps.shape[1] > words:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from each column of y (words first). Of 256 bits a pair that differs in all may
    come out as 0, which lets it through."""
    both = np.empty((len(x), y.shape[1]), np.uint64)
    some, out = np.empty(both.shape, np.uint8), None
    for at in range(0, len(y), 4):
        part = np.zeros(both.shape, np.uint8)
        for k in range(at, min(at + 4, len(y))):
            np.bitwise_xor(x[:, k, None], y[k], out=both)
            np.bitwise_count(both, out=some)
            np.add(part, some, out=part)
        out = part if out is None else out.astype(np.uint16) + part
    return out


def bound(n: np.ndarray, d: np.ndarray) -> np.ndarray:
    """The greatest Jaccard similarity of sets of n elements together whose bitmaps differ in d bits."""
    return np.maximum(n - d, 0) / (n + d)


class Measure:
    """A weighted sum of Jaccard similarities, one for each kind of features. ``bits``: of the bitmaps of each kind."""

    def __init__(self, features: Features, weights: tuple[float, ...], bits: tuple[int, ...]):
        self.features, self.weights, self.bits = features, weights, bits


def packed(rows: DataFrame, measure: Measure, scratch: Scratch, id_col: str, text_col: str) -> DataFrame:
    """(n, ids, sizes, maps, at): blocks of texts in the order of the sizes of their last kind of features, which ``n`` has the
    least and the greatest of. Texts without features of some kind, and null ones, are in no block: nothing is like them."""
    kind = rows.schema[id_col].dataType.simpleString()
    total = sum(measure.bits) // 64
    width = total * 8

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * ROWS):
                part = batch.slice(at, 4 * ROWS)
                texts = part.column(1).to_pylist()
                kinds = measure.features(texts)
                sizes = np.stack([np.bincount(row, minlength=len(texts)) for row, _ in kinds], axis=1).astype(np.int32)
                maps = np.concatenate([parity(row, key, len(texts), bits) for (row, key), bits in zip(kinds, measure.bits)], axis=1)
                keep = np.flatnonzero((sizes > 0).all(axis=1))
                raw = pa.Array.from_buffers(pa.binary(width), len(keep), [None, pa.py_buffer(np.ascontiguousarray(maps[keep]).tobytes())]).cast(pa.binary())
                size = pa.Array.from_buffers(pa.binary(4 * len(kinds)), len(keep), [None, pa.py_buffer(np.ascontiguousarray(sizes[keep]).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(sizes[keep, -1]), size, raw], ["id", "n", "size", "map"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            n = rows["n"].to_numpy()
            columns = [pa.array([[int(n.min()), int(n.max())]], pa.list_(pa.int32())), pa.array([rows["id"].to_pylist()], pa.list_(rows["id"].type))]
            return pa.RecordBatch.from_arrays(columns + [pa.array([b"".join(rows[c].to_pylist())], pa.binary()) for c in ("size", "map")], ["n", "ids", "sizes", "maps"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                all_ = pa.Table.from_batches(held)
                yield block(all_.slice(0, BLOCK))
                held = all_.slice(BLOCK).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    signed = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, f"id {kind}, n int, size binary, map binary")
    signed = scratch.save(signed, "signed")  # ranges are drawn from a sample, which would make the bitmaps twice
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    ordered = signed.repartitionByRange(parts, "n").sortWithinPartitions("n").mapInArrow(pack, f"n array<int>, ids array<{kind}>, sizes binary, maps binary")
    out = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "blocks")
    scratch.drop(signed)
    scratch.sweep()
    return out


def candidates(left: DataFrame, right: DataFrame | None, measure: Measure, threshold: float, scratch: Scratch, id_col: str, text_col: str, first: tuple[int, ...]) -> DataFrame:
    """(a, b): pairs of different ids whose texts may reach the threshold by the bounds, a < b of one table if ``right`` is None,
    else a of ``left`` and b of ``right``. Ids are distinct within a table. ``first``: bits of each kind that are looked at
    first; a kind of 0 bits counts as alike there."""
    kind = left.schema[id_col].dataType.simpleString()
    t = threshold - 1e-6  # measures are rounded to six places
    weights, words = measure.weights, [b // 64 for b in measure.bits]
    kinds, starts = range(len(weights)), np.cumsum([0, *words])
    # what each kind's similarity must be if all others are 1. From there up (n - d) / (n + d) is at most 1 - (1 + least) d / n
    least = [max((t - sum(weights) + w) / w, 0.0) for w in weights]
    slope = [w * (1 + j) for w, j in zip(weights, least)]
    spare = sum(weights) - t

    def unpacked(sizes: pa.Scalar, maps: pa.Scalar) -> tuple[list[np.ndarray], list[np.ndarray]]:
        size = np.frombuffer(sizes.as_buffer(), np.int32).reshape(-1, len(weights)).astype(np.int64)
        bits = np.frombuffer(maps.as_buffer(), np.uint64).reshape(-1, starts[-1])
        return list(np.ascontiguousarray(size.T)), [np.ascontiguousarray(bits[:, i:j]) for i, j in zip(starts, starts[1:])]

    def alike(nx: list, x: list, ny: list, y: list, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        look = [b // 64 for b in first]
        if len(weights) == 1:  # bits enough for the sizes at hand
            while look[0] < words[0] and look[0] * 64 < 2.4 * spare / slope[0] * (nx[0].max() + ny[0].max()):
                look[0] *= 2
        seen = [k for k in kinds if look[k]]
        fx, fy = {k: folded(x[k], look[k]) for k in seen}, {k: np.ascontiguousarray(folded(y[k], look[k]).T) for k in seen}
        lx, ly = ([np.ceil(spare / slope[k] * n[k]).astype(np.int64) for k in kinds] for n in (nx, ny))
        for at in range(0, len(nx[0]), STEP):
            some = slice(at, at + STEP)
            n = nx[-1][some]
            lo, hi = np.searchsorted(ny[-1], least[-1] * n.min() - 1e-6), np.searchsorted(ny[-1], n.max() / least[-1] + 1e-6, "right") if least[-1] else len(ny[-1])
            if same:
                lo = max(lo, at)
            if lo >= hi:
                continue
            to = slice(lo, hi)
            d = {k: differing(fx[k][some], fy[k][:, to]) for k in seen}
            if len(seen) == 1:  # one limit for all, as the sizes are alike, and then each pair's own
                k = seen[0]
                most = int(lx[k][some].max()) + int(ly[k][to].max())
                at_, = np.nonzero((d[k] <= min(most, np.iinfo(d[k].dtype).max)).ravel())
                i, j = np.divmod(at_, hi - lo)
                keep = d[k].ravel()[at_] <= lx[k][some][i] + ly[k][to][j]
                i, j = i[keep], j[keep]
            else:
                # whole numbers at the greatest sizes, rounded in the pair's favour, and then each pair's own sizes
                part = [slope[k] / (int(nx[k][some].max()) + int(ny[k][to].max())) for k in seen]
                scale = 65000 / sum(c * 64 * look[k] for c, k in zip(part, seen))
                cost = None
                for c, k in zip(part, seen):
                    some_cost = d[k].astype(np.uint16)
                    some_cost *= np.uint16(scale * c)
                    cost = some_cost if cost is None else np.add(cost, some_cost, out=cost)
                at_, = np.nonzero((cost <= min(int(np.ceil(spare * scale)), 65535)).ravel())
                i, j = np.divmod(at_, hi - lo)
                own = sum(slope[k] * d[k].ravel()[at_] / (nx[k][some][i] + ny[k][to][j]) for k in seen)
                i, j = i[own <= spare + 1e-9], j[own <= spare + 1e-9]
            if not len(i):
                continue
            i, j = i + at, j + lo
            if same:
                i, j = i[i < j], j[i < j]
            most = sum(w * bound(nx[k][i] + ny[k][j], np.bitwise_count(x[k][i] ^ y[k][j]).sum(axis=1, dtype=np.int64)) for k, w in zip(kinds, weights))
            yield i[most >= t], j[most >= t]

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids_x, sizes_x, maps_x, ids_y, sizes_y, maps_y, same in zip(*(batch.column(i) for i in range(7))):
                found = list(alike(*unpacked(sizes_x, maps_x), *unpacked(sizes_y, maps_y), same.as_py()))
                if found and len(i := np.concatenate([i for i, _ in found])):
                    a, b = ids_x.values.take(pa.array(i)), ids_y.values.take(pa.array(np.concatenate([j for _, j in found])))
                    yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    x = packed(left, measure, scratch, id_col, text_col)
    y = x if right is None else packed(right, measure, scratch, id_col, text_col)
    y = y.select(*(F.col(c).alias(f"{c}_y") for c in ("at", "n", "ids", "sizes", "maps"))).hint("shuffle_replicate_nl")
    near = (F.col("n")[1] >= least[-1] * F.col("n_y")[0]) & (F.col("n_y")[1] >= least[-1] * F.col("n")[0])
    once, same = (F.col("at") <= F.col("at_y"), F.col("at") == F.col("at_y")) if right is None else (F.lit(True), F.lit(False))
    met = x.join(y, near & once).select("ids", "sizes", "maps", "ids_y", "sizes_y", "maps_y", same.alias("same"))
    pairs = met.mapInArrow(meet, f"a {kind}, b {kind}").where("a <> b")
    return pairs if right is not None else pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
