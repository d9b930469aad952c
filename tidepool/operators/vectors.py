"""Vector operators: exact nearest neighbours of a stated query set, a group's lead against its members, close pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.operators.blocks import BLOCK
from tidepool.runtime import Scratch


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest(asked: DataFrame, rows: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, nbr, distance, pos): the k nearest other rows of each asked row; the limit is applied before the shuffle."""
    q = asked.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("q"))
    met = rows.select(F.col(id_col).alias("nbr"), F.col(vector_col).alias("v")).join(F.broadcast(q), F.col("nbr") != F.col("vec_id"))
    scored = met.select("vec_id", "nbr", F.round(cosine_distance(F.col("v"), F.col("q")), 6).alias("distance"))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "nbr"))).where(F.col("pos") <= k)


def against_lead(rows: DataFrame, group_col: str = "label", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(label, vec_id, distance): each member of a group against the group's first row, a star and not all pairs."""
    lead = rows.groupBy(group_col).agg(F.min(id_col).alias("lead"), F.min_by(vector_col, id_col).alias("lv"))
    return rows.join(lead, group_col).where(F.col(id_col) != F.col("lead")).select(group_col, id_col, F.round(cosine_distance(F.col(vector_col), F.col("lv")), 6).alias("distance"))


def close_pairs(rows: DataFrame, distance: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a, b, distance): pairs a < b below a cosine distance. Every vector meets every other, in blocks and without a
    shuffle of pairs, so none is missed and the work grows with their square. Only vectors of one length meet; those with
    null, NaN or infinite elements, or all zero, have no pair."""
    kind = rows.schema[id_col].dataType.simpleString()
    element = rows.schema[vector_col].dataType.elementType.simpleString()
    scratch = Scratch(rows.sparkSession, "close")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def block(dim: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(dim))
            flat = np.concatenate([pc.list_flatten(c).cast(pa.float32() if element == "float" else pa.float64()).to_numpy(zero_copy_only=False) for c in t.column(1).chunks])
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([t.column(0).to_pylist()], pa.list_(t.column(0).type)), pa.array([flat.tobytes()], pa.binary())], ["dim", "ids", "v"])

        for batch in batches:
            size = pc.list_value_length(batch.column(1))
            for dim in filter(None, pc.unique(size.drop_null()).to_pylist()):
                some = batch.filter(pc.equal(size, dim))
                raw = pc.list_flatten(some.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
                some = some.filter(pa.array(np.isfinite(raw).all(axis=1) & raw.any(axis=1)))
                for at in range(0, some.num_rows, BLOCK):
                    held.setdefault(dim, []).append(some.slice(at, BLOCK))
                    if sum(b.num_rows for b in held[dim]) >= BLOCK:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    def units(raw: pa.Scalar, dim: int) -> np.ndarray:
        v = np.frombuffer(raw.as_buffer(), np.float32 if element == "float" else np.float64).astype(np.float64).reshape(-1, dim)
        v = v / np.abs(v).max(axis=1, keepdims=True)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, xs, x, ys, y, same in zip(*(batch.column(i) for i in range(6))):
                u, v = (units(w, dim.as_py()) for w in (x, y))
                u32, v32 = u.astype(np.float32), v.astype(np.float32)
                for at in range(0, len(u), 256):
                    first = at if same.as_py() else 0
                    i, j = np.nonzero(u32[at : at + 256] @ v32[first:].T > 1 - distance - 1e-4)
                    i, j = i + at, j + first
                    if same.as_py():
                        i, j = i[i < j], j[i < j]
                    apart = 1 - np.einsum("ij,ij->i", u[i], v[j])
                    i, j, apart = (z[apart < distance] for z in (i, j, apart))
                    if len(i):
                        yield pa.RecordBatch.from_arrays([xs.values.take(pa.array(i)), ys.values.take(pa.array(j)), pa.array(np.maximum(apart, 0))], ["a", "b", "distance"])

    full = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    x = scratch.save(full.mapInArrow(pack, f"dim int, ids array<{kind}>, v binary").withColumn("at", F.monotonically_increasing_id()), "vectors")
    y = x.select("dim", F.col("ids").alias("ids_y"), F.col("v").alias("v_y"), F.col("at").alias("at_y")).hint("shuffle_replicate_nl")
    met = x.alias("x").join(y.alias("y"), F.expr("x.dim = y.dim and at <= at_y")).select("x.dim", "ids", "v", "ids_y", "v_y", F.expr("at = at_y").alias("same"))
    pairs = met.mapInArrow(meet, f"a {kind}, b {kind}, distance double").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("distance", 6).alias("distance"))


def nearest_distances(rows: DataFrame, scratch: Scratch, within: float, partners: Column, id_col: str = "id", vector_col: str = "vector", dim: int = 64) -> DataFrame:
    """(memory_id, distance): the cosine distance, to four places, of each vector's nearest vector of another id among the
    rows that are ``partners``, where it is below ``within``.

    Every vector meets every other, in blocks and without a shuffle, so none is missed and the work grows with their
    square. Vectors of another length, with null, NaN or infinite elements, or all zero have no neighbour.
    """
    kind = rows.schema[id_col].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column(1)), dim))
            raw = pc.list_flatten(batch.column(1)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(raw).all(axis=1) & raw.any(axis=1)
            ids = batch.column(0).filter(pa.array(good)).to_pylist()
            if ids:
                u = raw[good] / np.abs(raw[good]).max(axis=1, keepdims=True)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(batch.column(0).type)), pa.array([u.tobytes()], pa.binary())], ["ids", "u"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, x, ys, y in zip(*(batch.column(i) for i in range(4))):
                u, v = (np.frombuffer(b.as_buffer(), np.float64).reshape(-1, dim) for b in (x, y))
                u32, v32 = u.astype(np.float32), v.astype(np.float32)
                xs, place = xs.as_py(), {}
                for j, i in enumerate(ys.as_py()):
                    place.setdefault(i, []).append(j)
                cos = np.empty(len(xs))
                for at in range(0, len(xs), 512):
                    dot = u32[at : at + 512] @ v32.T
                    for i, name in enumerate(xs[at : at + 512]):
                        if name in place:
                            dot[i, place[name]] = -2
                    best = dot.argmax(axis=1)
                    met = dot[np.arange(len(dot)), best] > -1.5
                    cos[at : at + 512] = np.where(met, np.einsum("ij,ij->i", u[at : at + 512], v[best]), -2)
                keep = np.flatnonzero(1 - cos < within)
                yield pa.RecordBatch.from_arrays([pa.array(xs, batch.column(0).type.value_type).take(pa.array(keep)), pa.array(np.maximum(1 - cos[keep], 0))], ["memory_id", "distance"])

    packed, met = (scratch.save(r.select(id_col, vector_col).mapInArrow(pack, f"ids array<{kind}>, u binary"), "vectors") for r in (rows, rows.where(partners)))
    pairs = packed.crossJoin(met.select(F.col("ids").alias("ids_b"), F.col("u").alias("u_b")))
    return pairs.mapInArrow(meet, f"memory_id {kind}, distance double").groupBy("memory_id").agg(F.round(F.min("distance"), 4).alias("distance"))
