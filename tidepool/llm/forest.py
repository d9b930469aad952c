"""Most similar vectors by a forest of hash prefixes.

Each tree gives a vector a long string of hash bits (signs of projections on fixed random directions). A tree's sorted
strings are descended to the longest prefixes that still hold enough vectors: a node is split while it holds more than
``LEAF`` vectors, so prefixes are as long as the data are dense there, and a split that would leave one side nearly empty
is undone (the search ascends to the parent). Vectors of one node, in any tree, are compared by one matrix product of
their 8-bit forms, whose error is bounded per pair; only pairs that the bound can't decide are compared again exactly.
Equal vectors form a class that travels once. The k nearest of asked vectors (``nearest``) don't use the forest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.grams import unseen
from tidepool.runtime import Scratch

#: Fewest trees; bits of a hash string; bits by which nodes are counted; vectors in a node that isn't split further.
TREES, BITS, COUNTED, LEAF = 10, 32, 14, 4096
#: Part of the pairs at the threshold that may be in no common node; the number of trees grows with the vectors to keep it.
MISSED = 0.005
SEED = 20240131
#: Undecided pairs up to which their classes are sent to all executors (16 bytes each); beyond, they are joined by a shuffle.
UNDECIDED = 50_000
#: Vectors, and asked vectors, in a block of ``nearest``.
TILE, ASKED = 32_768, 4_096


def trees_for(n: int, threshold: float) -> int:
    """Trees for so many vectors: two vectors at the threshold share each bit with probability 1 - angle / pi, and a node of
    ``LEAF`` vectors lies about log2(n / LEAF) bits deep."""
    together = (1 - np.arccos(threshold) / np.pi) ** max(0.0, np.log2(max(n, 1) / LEAF))
    return max(TREES, int(np.ceil(np.log(MISSED) / np.log1p(-min(together, 1 - 1e-9)))))


def directions(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, trees * BITS)).astype(np.float32)


def coded(df: DataFrame, id_col: str, vector_col: str, dim: int, trees: int) -> DataFrame:
    """(cls, id, q, s, e, codes): of each usable vector its class, 8-bit form with scale and error, and hash strings.

    Null vectors, those of another length, with null, NaN or infinite elements and those that are all zero are left out.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = directions(dim, trees)
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim))
            if not batch.num_rows:
                continue
            raw = pc.list_flatten(batch.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
            raw, ids = raw[good], batch.column(0).filter(pa.array(good))
            u = raw / np.abs(raw).max(axis=1, keepdims=True, initial=0)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            s = np.abs(u).max(axis=1, initial=0) / 127
            q = np.rint(u / s[:, None]).astype(np.int8)
            e = np.linalg.norm(u - q * s[:, None], axis=1)
            codes = np.packbits(u.astype(np.float32) @ h > 0, axis=1)
            cls = [xxhash.xxh3_128_digest(r.tobytes()) for r in raw.astype(np.float32)]
            fixed = lambda a, w: pa.array(map(bytes, a.view(np.uint8).reshape(-1, w)), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), ids, fixed(q, dim), pa.array(s, pa.float32()), pa.array(e, pa.float32()), fixed(codes, codes.shape[1])], ["cls", "id", "q", "s", "e", "codes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, vector_col).mapInArrow(run, f"cls binary, id {kind}, q binary, s float, e float, codes binary")


def _codes(column: pa.Array) -> np.ndarray:
    """(rows, trees) of hash strings as unsigned integers."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.dtype(">u4"))
    return flat.reshape(len(column), -1).astype(np.uint32)


def nodes(codes: DataFrame, leaf: int, trees: int) -> np.ndarray:
    """(trees, 2**COUNTED): the node of each counted prefix, -1 where a node holds less than two vectors, and in the high
    bits how much deeper a node that is still too large goes. What comes to the driver is at most that many counts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, 1 << COUNTED), np.int64)
        for batch in batches:
            if batch.num_rows:
                c = _codes(batch.column(0)) >> (BITS - COUNTED)
                for t in range(trees):
                    total[t] += np.bincount(c[:, t], minlength=1 << COUNTED)
        t, p = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(p, pa.int32()), pa.array(total[t, p])], ["t", "p", "n"])

    counts = np.zeros((trees, 1 << COUNTED), np.int64)
    for t, p, n in codes.select("codes").mapInArrow(count, "t int, p int, n bigint").groupBy("t", "p").agg(F.sum("n")).collect():
        counts[t, p] = n
    out = np.full((trees, 1 << COUNTED), -1, np.int64)
    for t in range(trees):
        sums = np.concatenate(([0], np.cumsum(counts[t])))
        todo = [(0, 1 << COUNTED)]
        while todo:
            a, b = todo.pop()
            n, mid = sums[b] - sums[a], (a + b) // 2
            if n < 2:
                continue
            lesser = min(sums[mid] - sums[a], sums[b] - sums[mid])
            if n <= leaf or (lesser < leaf // 16 and n <= 4 * leaf):
                out[t, a:b] = a
            elif b - a > 1:
                todo += [(a, mid), (mid, b)]
            else:
                deeper = min(BITS - COUNTED, int(np.ceil(np.log2(n / leaf))))
                out[t, a] = a | deeper << COUNTED
    return out


def postings(rows: DataFrame, node: np.ndarray, asks: Column | None = None) -> DataFrame:
    """(t, node, sub, cls, q, s, e, asks): each class in its node of each tree, mostly once for each input partition."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            cls = batch.column(0).to_pylist()
            first = np.array([unseen(seen, c) for c in cls], bool)
            batch = batch.filter(pa.array(first))
            if not batch.num_rows:
                continue
            codes = _codes(batch.column(4))
            for t in range(len(node)):
                at = node[t, codes[:, t] >> (BITS - COUNTED)]
                keep = np.flatnonzero(at >= 0)
                deeper = at[keep] >> COUNTED
                sub = (codes[keep, t].astype(np.int64) & ((1 << (BITS - COUNTED)) - 1)) >> (BITS - COUNTED - deeper)
                part = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), t), pa.int32()), pa.array(at[keep] & ((1 << COUNTED) - 1), pa.int32()), pa.array(np.where(deeper > 0, sub, 0), pa.int32()), *(part.column(i) for i in (0, 1, 2, 3, 5))],
                    ["t", "node", "sub", "cls", "q", "s", "e", "asks"],
                )

    asks = F.lit(True) if asks is None else asks
    cols = rows.select("cls", "q", "s", "e", "codes", asks.alias("asks"))
    return cols.mapInArrow(run, "t int, node int, sub int, cls binary, q binary, s float, e float, asks boolean")


def _members(group: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cls = np.array(group["cls"].to_pylist(), object)
    cls, first = np.unique(cls, return_index=True)
    q = np.frombuffer(b"".join(group["q"].to_pylist()), np.int8).reshape(-1, dim)[first].astype(np.float32)
    s, e = (group[c].to_numpy()[first].astype(np.float32) for c in "se")
    return cls, q * s[:, None], e, group["asks"].to_numpy()[first]


def close_classes(posted: DataFrame, threshold: float, dim: int) -> DataFrame:
    """(a, b, sure): pairs of classes, a < b, whose cosine may reach the threshold; ``sure`` if it certainly does."""

    def run(group: pa.Table) -> pa.Table:
        cls, u, e, _ = _members(group, dim)
        left, right, sure = [], [], []
        for at in range(0, len(cls), 512):
            dot = u[at : at + 512] @ u[at:].T
            err = e[at : at + 512, None] + e[None, at:] + e[at : at + 512, None] * e[None, at:] + 1e-5
            i, j = np.nonzero(dot + err >= threshold)
            i, j = i[i < j], j[i < j]
            left.append(i + at), right.append(j + at), sure.append(dot[i, j] - err[i, j] >= threshold)
        left, right = np.concatenate(left), np.concatenate(right)
        return pa.table({"a": pa.array(cls[left], pa.binary()), "b": pa.array(cls[right], pa.binary()), "sure": np.concatenate(sure)})

    pairs = posted.groupBy("t", "node", "sub").applyInArrow(run, "a binary, b binary, sure boolean")
    return pairs.groupBy("a", "b").agg(F.max("sure").alias("sure"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two arrays in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def close(df: DataFrame, scratch: Scratch, threshold: float, id_col: str, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of classes of equal vectors, members (cls, id)) with at least the given cosine."""
    trees = trees_for(df.count(), threshold)
    rows = scratch.save(coded(df, id_col, vector_col, dim, trees), "coded")
    pairs = scratch.save(close_classes(postings(rows, nodes(rows, LEAF, trees)), threshold, dim), "pairs")
    open_, sure = pairs.where("not sure"), pairs.where("sure").select("a", "b")
    if n := open_.count():
        ids = open_.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
        owner = rows.groupBy("cls").agg(F.min("id").alias(id_col))
        owner = owner.join(F.broadcast(ids) if n <= UNDECIDED else ids, "cls")
        vec = owner.join(df.select(id_col, F.col(vector_col).alias("v")).dropDuplicates([id_col]), id_col).select("cls", "v")
        both = open_.join(vec.select(F.col("cls").alias("a"), F.col("v").alias("va")), "a").join(vec.select(F.col("cls").alias("b"), F.col("v").alias("vb")), "b")
        sure = sure.unionByName(both.where(cosine("va", "vb") >= threshold).select("a", "b"))
    return sure, rows.select("cls", "id").distinct()


def similar_pairs(df: DataFrame, scratch: Scratch, threshold: float = 0.92, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id_a, id_b): two different ids, id_a < id_b, whose vectors have at least the given cosine.

    A redelivered id counts once; unusable vectors (see ``coded``) have no partner. Pairs of one node in any tree are
    found for certain; a pair that no tree keeps together is missed. The number of trees grows with the vectors so that this
    happens to about ``MISSED`` of the pairs at the threshold, and to fewer above it.
    """
    sure, member = close(df, scratch, threshold, id_col, vector_col, dim)
    same = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    ids = sure.unionByName(same).join(member.select(F.col("cls").alias("a"), F.col("id").alias("x")), "a").join(member.select(F.col("cls").alias("b"), F.col("id").alias("y")), "b")
    return ids.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def similar_classes(df: DataFrame, scratch: Scratch, threshold: float = 0.92, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id, class_id, links): each id with a usable vector, the smallest id with an equal vector, and how many other vectors
    its vector is near to. Copies of one vector are one vector here and aren't expanded."""
    sure, member = close(df, scratch, threshold, id_col, vector_col, dim)
    links = sure.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    low = member.groupBy("cls").agg(F.min("id").alias("class_id")).join(links, "cls", "left").select("cls", "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return member.join(low, "cls").select("id", "class_id", "links")


def tiles(df: DataFrame, id_col: str, vector_col: str, dim: int, size: int) -> DataFrame:
    """(ids, vectors): the usable vectors (see ``coded``) of each partition in blocks of at most ``size``, a redelivered id
    once a block, the vectors as the bytes of one float matrix."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []

        def block() -> pa.RecordBatch:
            names, first = np.unique(np.array(ids, object), return_index=True)
            raw = np.concatenate(held)[first]
            return pa.RecordBatch.from_arrays([pa.array([list(names)], pa.list_(batch.column(0).type)), pa.array([raw.tobytes()], pa.binary())], ["ids", "vectors"])

        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                raw = pc.list_flatten(part.column(1)).cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
                if ids and len(ids) + good.sum() > size:
                    yield block()
                    ids, held = [], []
                ids += part.column(0).filter(pa.array(good)).to_pylist()
                held.append(raw[good])
        if ids:
            yield block()

    return df.select(id_col, vector_col).mapInArrow(run, f"ids array<{kind}>, vectors binary")


def _units(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, whatever their scale."""
    u = raw / np.abs(raw).max(axis=1, keepdims=True).astype(np.float64)
    return u / np.linalg.norm(u, axis=1, keepdims=True)


def nearest(df: DataFrame, scratch: Scratch, asks: Column, k: int = 10, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(id, neighbour, rank, cosine): for each usable vector that ``asks``, its k most similar vectors of other ids, ties to
    the smaller id; ranked by the exact cosine, which comes out rounded to three places.

    Every asked vector meets every vector: 10th neighbours are so far apart here that a forest only keeps nine in ten of
    them when its nodes together hold a third of all vectors, at any size. Blocks of vectors meet blocks of asked vectors
    without a shuffle, and each meeting hands on k rows for each asked vector. The work grows with asked times all.
    """
    kind = df.schema[id_col].dataType.simpleString()
    asked = df.where(asks).select(id_col, vector_col).repartition(id_col)
    all_ = scratch.save(tiles(df, id_col, vector_col, dim, TILE), "all")
    asked = scratch.save(tiles(asked, id_col, vector_col, dim, ASKED), "asked").select(F.col("ids").alias("xs"), F.col("vectors").alias("q"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, xs, q in zip(*(batch.column(i) for i in range(4))):
                ids, xs = np.array(ids.as_py(), object), np.array(xs.as_py(), object)
                u, w = (_units(np.frombuffer(b.as_buffer(), np.float32).reshape(-1, dim)) for b in (raw, q))
                u32, w32 = u.astype(np.float32), w.astype(np.float32)
                place = {i: n for n, i in enumerate(ids)}
                own = np.array([place.get(x, -1) for x in xs])
                for at in range(0, len(xs), 256):
                    dot = w32[at : at + 256] @ u32.T
                    here = np.flatnonzero(own[at : at + 256] >= 0)
                    dot[here, own[at : at + 256][here]] = -2
                    top = min(k, len(ids))
                    least = np.partition(dot, len(ids) - top, axis=1)[:, len(ids) - top]
                    i, j = np.nonzero(dot >= np.maximum(least, -1.5)[:, None] - 1e-5)  # what single precision can't decide stays
                    cos = np.round(np.einsum("ij,ij->i", w[at + i], u[j]), 9)
                    order = np.lexsort((j, -cos, i))  # a block's ids are in order
                    i, j, cos = i[order], j[order], cos[order]
                    begin = np.searchsorted(i, i, "left")
                    keep = np.arange(len(i)) - begin < k
                    yield pa.RecordBatch.from_arrays([pa.array(list(xs[at + i[keep]])), pa.array(list(ids[j[keep]])), pa.array(cos[keep])], schema=pa.schema([("x", batch.column(2).type.value_type), ("y", batch.column(0).type.value_type), ("c", pa.float64())]))

    found = all_.crossJoin(asked).mapInArrow(run, f"x {kind}, y {kind}, c double").distinct()
    best = found.groupBy("x").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("d"), "y"))), 1, k).alias("top"))
    return best.select(F.col("x").alias("id"), F.posexplode("top").alias("pos", "hit")).select("id", F.col("hit.y").alias("neighbour"), (F.col("pos") + 1).alias("rank"), F.round(-F.col("hit.d"), 3).alias("cosine"))
