"""Pairs of texts whose sets of three-character sequences may be alike: size bands, in which all pairs meet by tables.

Sequences are told apart by kinds, learned from some texts as those that mostly stand together. The numbers of sequences of
each kind bound what one text has beyond another: with y sequences of a kind where the other has at most x, at least y - x
are not in it. A text's numbers are levels, and a table holds what each text of a tile has beyond the levels of several kinds,
so that a pair costs one addition of bytes for ``JOINT`` kinds. Texts of a block are in the order of groups, mostly languages:
sums over the kinds that one group has more of than another bound what a whole tile has beyond a text or a text beyond it, and
such a text doesn't meet the tile. What these bounds leave meets by bitmaps, see ``blocks``.
Kinds that tell little make more work and lose no pair. The work grows with the square of the texts. A second sort of features,
as words, counts as several sequences each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.blocks import _MIX, ROWS, bound, differing, parity, trigram_keys
from tidepool.runtime import Scratch

#: Kinds of sequences, the last one for those not learned; texts they are learned from at least, by their first characters, and sequences
#: that are learned at most, the most frequent ones. These numbers bear on the work, not on the result.
KINDS, LEARNED, FIRST, MOST = 64, 1500, 2000, 1 << 14
#: Directions in which the learned sequences are told apart; slots of each learned one by which it is looked up.
DIRECTIONS, SLOTS = 128, 16
#: Shares of the learned texts that have at most a level's number; kinds of a table; tables.
LEVELS, JOINT = (0.3, 0.6, 0.85), 4
TABLES = KINDS // JOINT
#: Groups of texts.
GROUPS = 6
#: Texts of a block; smaller texts a table is made for and larger ones that meet them at a time.
BLOCK, TILE, TURN = 16384, 512, 1024
BITS, MORE_BITS = 1024, 128
#: Bits looked at first for each bit that may differ: unlike texts differ in half of them.
LOOK = 2.5


class Like:
    """A weighted sum of Jaccard similarities that reaches a threshold: of three-character sequences, and perhaps of other
    features. With sizes N and differences d of a pair, slope * d / N of both sorts sum up to ``spare`` at most; one of the
    others counts as ``weight`` sequences in the numbers of kinds. Texts with too many of those are odd, and not bounded by kinds."""

    def __init__(self, threshold: float, shares: tuple[float, ...] = (1.0,), features: Callable[[list[str]], list[tuple[np.ndarray, np.ndarray]]] = lambda texts: [trigram_keys(texts)], weight: int = 0):
        self.threshold, self.shares, self.features, self.weight, self.spare = threshold, shares, features, weight, 1 - threshold
        self.least = [max((threshold - 1 + w) / w, 0.0) for w in shares]  # of each sort, if the other is all alike
        self.slope = [w * (1 + j) for w, j in zip(shares, self.least)]
        self.half = self.spare / (2 * self.slope[0])
        self.words = (0, BITS // 64, (BITS + MORE_BITS) // 64)[: len(shares) + 1]

    @classmethod
    def of(cls, x: Like | float) -> Like:
        return x if isinstance(x, Like) else cls(x)

    def room(self, b: Block) -> np.ndarray:
        """What each text may have beyond another, without what the other needs."""
        return (0.5 + self.half) * b.n + self.weight * b.more / 2

    def need(self, b: Block) -> np.ndarray:
        return (0.5 - self.half) * b.n + self.weight * b.more / 2

    def odd(self, b: Block) -> np.ndarray:
        return self.slope[-1] * b.n < self.weight * self.slope[0] * b.more if self.weight else np.zeros(len(b.n), bool)

    def numbers(self, found: list[tuple[np.ndarray, np.ndarray]], rows: int, keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return sum(w * numbers(row, key, rows, keys, kind) for w, (row, key) in zip((1, self.weight), self.joint(found)))

    def joint(self, found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The features with keys that tell the sorts apart."""
        return [found[0], *((row, key | np.uint64(1 << 63)) for row, key in found[1:])]


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)


def groups(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre of each group, kinds that are summed for each pair of groups) from the numbers of some texts: k-means."""
    v = v.astype(np.float32)
    place = unit(v)
    centre = place[:1]
    while len(centre) < min(GROUPS, len(v)):
        centre = np.concatenate((centre, place[[(place @ centre.T).max(axis=1).argmin()]]))
    for _ in range(20):
        own = (place @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (own == k).any():
                centre[k] = place[own == k].sum(axis=0)
        centre = unit(centre)
    mean = [v[own == k].mean(axis=0) if (own == k).any() else np.zeros(KINDS, np.float32) for k in range(len(centre))]
    sums = [x > y for x in mean for y in mean if x is not y and (x > y).any()]
    return centre, np.unique(np.array(sums, np.float32).reshape(-1, KINDS), axis=0).T


def coarse(v: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The sums of each text, cut off where they don't fit the type."""
    return np.minimum(v.astype(np.float64) @ sums, 65535).astype(np.uint16)


def kinds(texts: list[str], like: Like | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys in order, kind of each, greatest number of each level and kind): k-means over the directions in which the sequences'
    presence varies most."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((len(LEVELS), KINDS), np.int64)
    if len(texts) < 2:
        return none
    like = Like.of(like)
    found = like.features(texts)
    row, key = (np.concatenate(x) for x in zip(*like.joint(found)))
    known, at, count = np.unique(key, return_inverse=True, return_counts=True)
    good = (count >= max(2, len(texts) // 500)) & (count < len(texts))
    if good.sum() > MOST:
        good[np.argsort(np.where(good, count, 0), kind="stable")[:-MOST]] = False
    if good.sum() < 4 * KINDS:
        return none
    number = np.cumsum(good) - 1
    seen = np.zeros((int(good.sum()), len(texts)), np.float32)
    seen[number[at][good[at]], row[good[at]]] = 1
    seen -= seen.mean(axis=1, keepdims=True)
    vary = np.einsum("ij,ij->i", seen, seen)[:, None]  # what varies more bears on more pairs, and weighs as much
    rng = np.random.default_rng(0)
    base = rng.standard_normal((len(texts), min(DIRECTIONS, len(texts)))).astype(np.float32)
    for _ in range(3):
        base, _ = np.linalg.qr(seen.T @ (seen @ base))
    place = seen @ base
    place /= np.linalg.norm(place, axis=1, keepdims=True) + 1e-9
    centre = place[rng.choice(len(place), KINDS - 1, replace=False)]
    for _ in range(12):
        kind = (place @ centre.T).argmax(axis=1)
        for k in range(KINDS - 1):
            if (own := kind == k).any():
                centre[k] = (vary[own] * place[own]).sum(axis=0)
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    v = like.numbers(found, len(texts), known[good], kind)
    return known[good], kind, np.quantile(v, LEVELS, axis=0, method="higher").astype(np.int64)


def numbers(row: np.ndarray, key: np.ndarray, rows: int, keys: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many sequences of each kind each text has."""
    own = np.full(len(key), KINDS - 1)
    if len(keys):
        shift = np.uint64(64 - (SLOTS * len(keys)).bit_length())
        place = (keys * _MIX >> shift).astype(np.int64)
        slot = np.full(1 << (64 - int(shift)), -1, np.int32)
        slot[place] = np.arange(len(keys))
        late = np.setdiff1d(np.arange(len(keys)), slot)  # those whose slot another one has
        slot[place[late]] = -2
        at = slot[(key * _MIX >> shift).astype(np.int64)]
        some = np.flatnonzero(at == -2)
        at[some] = np.minimum(np.searchsorted(keys, key[some]), len(keys) - 1)
        some = np.flatnonzero(at >= 0)
        some = some[keys[at[some]] == key[some]]
        own[some] = kind[at[some]]
    return np.bincount(row * KINDS + own, minlength=rows * KINDS).reshape(rows, KINDS)


def levels(v: np.ndarray, top: np.ndarray) -> np.ndarray:
    """For each text and table, the levels of its kinds as one number. ``top``: the greatest number of each level and kind;
    above the last one, nothing is known."""
    level = np.zeros(v.shape, np.uint8)
    for t in top:
        level += v > t
    return (level.reshape(len(v), TABLES, JOINT) << np.arange(0, 2 * JOINT, 2)).sum(axis=2).astype(np.uint8)


def table(v: np.ndarray, top: np.ndarray) -> np.ndarray:
    """(level number, text): how many sequences each text has at least beyond a text of such levels; v: the numbers of the
    kinds of one table, kinds first. A sum that doesn't fit the type comes out as less."""
    out = np.zeros((1, v.shape[1]), v.dtype)
    for k in range(JOINT):
        own = np.zeros((len(top) + 1, v.shape[1]), v.dtype)
        for at, t in enumerate(top[:, k]):
            own[at] = np.where(v[k] > t, v[k] - np.minimum(t, v[k]), 0)
        out = (own[:, None] + out[None]).reshape(-1, v.shape[1])
    return out


class Block:
    """Texts of a block: sizes, one for each sort of features, numbers of each kind if tables are made of it, level numbers if it meets them, bitmaps, sums
    over kinds."""

    def __init__(self, n: np.ndarray, v: np.ndarray | None, level: np.ndarray | None, maps: np.ndarray, sums: np.ndarray | None = None):
        sizes = n.astype(np.int64).reshape(len(n), -1)
        self.n, self.more, self.v, self.level, self.maps, self.made = np.ascontiguousarray(sizes[:, 0]), sizes[:, 1:].sum(axis=1), v, level, maps, {}
        self.unit_of: dict[int, int] = {}  # as a power of two
        self.sums = (np.zeros((len(n), 0)) if sums is None else sums).astype(np.int32)
        self.bounds: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, n: pa.Scalar, v: pa.Scalar | None, level: pa.Scalar | None, maps: pa.Scalar, sums: pa.Scalar, like: Like) -> Block:
        read = lambda x, kind, width: None if x is None else np.frombuffer(x.as_buffer(), kind).reshape(-1, width)
        n = read(n, np.int32, len(like.shares))
        return cls(n, read(v, np.uint16, KINDS), read(level, np.uint8, TABLES), read(maps, np.uint64, like.words[-1]), np.frombuffer(sums.as_buffer(), np.uint16).reshape(len(n), -1))

    def rooms(self, like: Like) -> tuple[np.ndarray, np.ndarray]:
        """Each sum of each text without the text's need, and without its room; made once for a threshold."""
        if like.threshold not in self.bounds:
            self.bounds[like.threshold] = np.ceil(self.sums.T - like.need(self)).astype(np.int32, "C"), np.floor(self.sums.T - like.room(self)).astype(np.int32, "C")
        return self.bounds[like.threshold]

    def tables(self, low: int, top: np.ndarray, like: Like | float) -> tuple[int, list[np.ndarray]]:
        """Tables of the tile from ``low`` on, made once. The first one also counts how much less than the most, which is
        given too, a text may have beyond one of no size. Those of two sorts of features count in units of ``unit_of``."""
        if low not in self.made:
            like, tile = Like.of(like), slice(low, low + TILE)
            room = np.floor(like.room(self)[tile] + 1e-6).astype(np.int64)
            most, v = int(room.max()), self.v[tile]
            if like.weight:
                # what one text has beyond an unlike one is mostly less than half of it; a sum that doesn't fit comes out as less
                shift = max(0, int((v.sum(axis=1, dtype=np.int64) + most - room).max() * 9 // 16).bit_length() - 8)
                wide, level = np.ascontiguousarray(v.astype(np.int32).T), top.astype(np.int32)
                out = [table(wide[k : k + JOINT], level[:, k : k + JOINT]) for k in range(0, KINDS, JOINT)]
                out[0] = out[0] + (most - room)
                out = [(x >> shift).astype(np.uint8) for x in out]
            else:
                shift = 0
                kind = np.uint8 if most - (0.5 - like.half) * like.least[0] * self.n[tile].min() < 250 and most - room.min() < 255 else np.uint16
                cap = np.iinfo(kind).max  # numbers are cut off there, and tell less
                v, level = np.ascontiguousarray(np.minimum(v, cap).astype(kind).T), np.minimum(top, cap).astype(kind)
                out = [table(v[k : k + JOINT], level[:, k : k + JOINT]) for k in range(0, KINDS, JOINT)]
                out[0] = out[0] + np.minimum(most - room, cap).astype(kind)
            self.made[low], self.unit_of[low] = (most, out), shift
        return self.made[low]


def meeting(y: Block, tile: slice, x: Block, like: Like | float) -> np.ndarray:
    """Which texts of x may be like some text of the tile, by their sizes and sums."""
    like = Like.of(like)
    least, n, odd = like.least[0], y.n[tile], like.odd(x)
    may = (x.n >= least * n.min() - 1e-6) & (x.n * least <= n.max() + 1e-6)
    if y.sums.shape[1] and not like.odd(y)[tile].any():
        sums, near = y.sums[tile], np.ones(len(may), bool)
        over, under = x.rooms(like)  # a text passes with over >= low - most and under <= high - least; both are rounded in its favour
        most, needed = like.room(y)[tile].max(), like.need(y)[tile].min()
        for k, (low, high) in enumerate(zip(np.floor(sums.min(axis=0) - most - 1e-6), np.ceil(sums.max(axis=0) - needed + 1e-6))):
            near &= over[k] >= np.int32(low)
            near &= under[k] <= np.int32(high)
        may &= near | odd
    return np.flatnonzero(may)


def alike(y: Block, x: Block, top: np.ndarray, like: Like | float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(j, i): pairs of a text of y and one of x that the bounds leave; j < i of one block."""
    like = Like.of(like)
    spare = like.spare / like.slope[0]  # of both sizes together, what differs at most
    words = 4
    while not like.weight and words < BITS // 64 and words * 64 < LOOK * spare * (x.n.max() + y.n.max()):
        words *= 2
    rows, rows_y = (merged(b.maps[:, : BITS // 64], words) for b in (x, y))
    fx, fy = (np.ascontiguousarray(b.T) for b in (rows, rows_y))
    other, (ox, oy) = x.maps[:, BITS // 64 :], (np.ascontiguousarray(b.maps[:, BITS // 64 :].T) for b in (x, y))
    mx, my = (spare * b.n + 1e-6 for b in (x, y))
    need, odd_x, odd_y = like.need(x), like.odd(x), like.odd(y)
    for low in range(0, len(y.n), TILE):
        tile = slice(low, min(low + TILE, len(y.n)))
        n, met = y.n[tile], meeting(y, tile, x, like)
        if same:
            met = met[met > low]
        if not len(met):
            continue
        most, tables = y.tables(low, top, like)
        kind, limit = tables[0].dtype, (np.floor(most - need[met] + 1e-6).astype(np.int64) >> y.unit_of[low]) + 1
        cap = np.iinfo(kind).max
        flags = np.empty(-(-TURN * len(n) // 8) * 8, bool)
        sum_, more = np.empty((TURN, len(n)), kind), np.empty((TURN, len(n)), kind)
        for at in range(0, len(met), TURN):
            some = met[at : at + TURN]
            level, count = x.level[some].T.astype(np.intp), len(some)
            total, part = sum_[:count], more[:count]
            np.take(tables[0], level[0], axis=0, out=total, mode="clip")
            for k in range(1, TABLES):
                np.take(tables[k], level[k], axis=0, out=part, mode="clip")
                np.add(total, part, out=total)
            own = limit[at : at + count]
            small = flags[: total.size].reshape(total.shape)
            np.less_equal(total, np.clip(own, 0, cap).astype(kind)[:, None], out=small)
            small[:, odd_y[tile]] = True
            small[odd_x[some]] = True
            flags[total.size :] = False
            found = np.count_nonzero(flags)
            if like.weight and found > total.size // 6:
                parts = (c / (int(a[some].max()) + int(b[tile].max())) for c, a, b in zip(like.slope, (x.n, x.more), (y.n, y.more)))
                cost = sum(differing(a[some], b[:, tile]) * np.float32(c) for c, a, b in zip(parts, (rows, other), (fy, oy)))
                small &= cost <= like.spare + 1e-4
            elif not like.weight and found > total.size // 3:  # the kinds tell little here
                d = differing(rows[some], fy[:, tile])
                flags[: total.size] &= (d <= min(int(mx[some].max() + my[tile].max()), np.iinfo(d.dtype).max)).ravel()
            eight = np.flatnonzero(flags.view(np.uint64) != 0)
            if not len(eight):
                continue
            one = np.flatnonzero(np.take(flags.view(np.uint64), eight).view(bool))
            near = 8 * eight[one >> 3] + (one & 7)
            i = near // len(n)
            j = near - i * len(n) + low
            i = some[i]
            if same:
                i, j = i[j < i], j[j < i]
            if like.weight:  # the fewer bits of the other features first
                d = sum(np.bitwise_count(wx[i] ^ wy[j]).astype(np.int32) for wx, wy in zip(ox, oy))
                rest = like.spare - like.slope[1] * d / (x.more[i] + y.more[j]) + 1e-9
                left = np.flatnonzero(rest >= 0)
                i, j, at_most = i[left], j[left], rest[left] / like.slope[0]
                at_most *= x.n[i] + y.n[j]
                d = np.zeros(len(i), np.uint16)
                for wx, wy in zip(fx, fy):
                    d += np.bitwise_count(wx[i] ^ wy[j])
                left = np.flatnonzero(d <= at_most)
            else:  # one limit for all, and then each pair's own
                d = ones(np.take(rows, i, axis=0), np.take(rows_y, j, axis=0))
                left = np.flatnonzero(d <= int(mx[some].max() + my[tile].max()))
                left = left[d[left] <= mx[i[left]] + my[j[left]]]
            i, j = i[left], j[left]
            sizes = (x.n[i] + y.n[j], x.more[i] + y.more[j])
            reach = sum(w * bound(size, np.bitwise_count(x.maps[i, a:b] ^ y.maps[j, a:b]).sum(axis=1, dtype=np.int64)) for w, size, a, b in zip(like.shares, sizes, like.words, like.words[1:])) >= like.threshold
            if reach.any():
                yield j[reach], i[reach]


def ones(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each row of x differs from the row of y, of a multiple of four words. Four words that differ in all bits
    count as none, which lets the pair through."""
    np.bitwise_xor(x, y, out=x)
    four = np.bitwise_count(x).view(np.uint32)
    four *= np.uint32(0x01010101)
    four >>= np.uint32(24)
    return sum(four[:, k] for k in range(four.shape[1]))


def merged(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps of so many words, each of which several words fold on; what differs less in them differs less in the whole."""
    out = maps[:, :words].copy()
    for k in range(words, maps.shape[1]):
        out[:, k % words] ^= maps[:, k]
    return out


def banded_pairs(rows: DataFrame, like: Like | float, scratch: Scratch, id_col: str, text_col: str, some: DataFrame | None = None) -> DataFrame:
    """(a, b): pairs of different ids, a < b, whose texts may reach the threshold by the bounds. Ids are distinct; texts
    without a sequence or another feature asked for, and null ones, are in no pair. ``some``: what kinds are learned from, if not the rows."""
    kind = rows.schema[id_col].dataType.simpleString()
    like = Like.of(like)
    like = Like(like.threshold - 1e-6, like.shares, like.features, like.weight)  # for rounding
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    base = (rows if some is None else some).where(F.col(text_col).isNotNull())
    base = base.where(F.pmod(F.xxhash64(id_col), F.lit(max(1, base.count() // LEARNED))) == 0)
    learned = [r[0] for r in base.select(F.substring(text_col, 1, FIRST)).collect()]
    keys, kind_of, top = kinds(learned, like)
    centre, sums = groups(like.numbers(like.features(learned), len(learned), keys, kind_of)) if learned else (np.zeros((1, KINDS), np.float32), np.zeros((KINDS, 0), np.float32))

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binary = lambda a: pa.Array.from_buffers(pa.binary(a.shape[1] * a.itemsize), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 4 * ROWS):
                part = batch.slice(at, 4 * ROWS)
                found = like.features(part.column(1).to_pylist())
                v = like.numbers(found, part.num_rows, keys, kind_of)
                n = np.stack([np.bincount(row, minlength=part.num_rows) for row, _ in found], axis=1).astype(np.int32)
                maps = np.concatenate([parity(row, key, part.num_rows, bits) for (row, key), bits in zip(found, (BITS, MORE_BITS))], axis=1)
                keep = np.flatnonzero((n > 0).all(axis=1))
                columns = [binary(a[keep]) for a in (n, np.minimum(v, 65535).astype(np.uint16), levels(v, top), maps)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(n[keep, 0]), *columns], ["id", "n", "sizes", "v", "level", "map"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            v = np.frombuffer(b"".join(rows["v"].to_pylist()), np.uint16).reshape(-1, KINDS)
            near = unit(v.astype(np.float32)) @ centre.T
            sizes = np.frombuffer(b"".join(rows["sizes"].to_pylist()), np.int32).reshape(len(v), -1)
            order = np.lexsort((near.max(axis=1), near.argmax(axis=1), like.odd(Block(sizes, None, None, sizes))))
            rows, v, sizes = rows.take(pa.array(order)), v[order], sizes[order]
            n = sizes[:, 0]
            columns = [pa.array([[int(n.min()), int(n.max())]], pa.list_(pa.int32())), pa.array([rows["id"].to_pylist()], pa.list_(rows["id"].type))]
            columns += [pa.array([a.tobytes()], pa.binary()) for a in (sizes, v, coarse(v, sums))]
            return pa.RecordBatch.from_arrays(columns + [pa.array([b"".join(rows[c].to_pylist())], pa.binary()) for c in ("level", "map")], ["n", "ids", "sizes", "v", "sums", "levels", "maps"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK:
                all_ = pa.Table.from_batches(held)
                yield block(all_.slice(0, BLOCK))
                held = all_.slice(BLOCK).to_batches()
        if held:
            yield block(pa.Table.from_batches(held))

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # of the same block, which comes several times in a row, the tables stay
        for batch in batches:
            for at, ids_y, n_y, v_y, maps_y, sums_y, ids_x, n_x, level_x, maps_x, sums_x, same in zip(*(batch.column(i) for i in range(12))):
                if last != at.as_py():
                    last, held = at.as_py(), Block.of(n_y, v_y, None, maps_y, sums_y, like)
                found = list(alike(held, Block.of(n_x, None, level_x, maps_x, sums_x, like), top, like, same.as_py()))
                if found:
                    j, i = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([ids_y.values.take(pa.array(j)), ids_x.values.take(pa.array(i))], ["a", "b"])

    signed = scratch.save(texts.mapInArrow(sign, f"id {kind}, n int, sizes binary, v binary, level binary, map binary"), "signed")  # ranges are drawn from a sample, which would make the bitmaps twice
    parts = 2 * rows.sparkSession.sparkContext.defaultParallelism
    ordered = signed.repartitionByRange(parts, "n").sortWithinPartitions("n").mapInArrow(pack, f"n array<int>, ids array<{kind}>, sizes binary, v binary, sums binary, levels binary, maps binary")
    y = scratch.save(ordered.withColumn("at", F.monotonically_increasing_id()), "blocks")
    scratch.drop(signed)
    x = y.select(*(F.col(c).alias(f"{c}_x") for c in ("at", "n", "ids", "sizes", "sums", "levels", "maps"))).hint("shuffle_replicate_nl")
    near = (F.col("n")[1] >= like.least[0] * F.col("n_x")[0] - 1e-6) & (F.col("n_x")[1] >= like.least[0] * F.col("n")[0] - 1e-6) & (F.col("at") <= F.col("at_x"))
    met = y.join(x, near).select("at", "ids", "sizes", "v", "maps", "sums", "ids_x", "sizes_x", "levels_x", "maps_x", "sums_x", (F.col("at") == F.col("at_x")).alias("same"))
    pairs = met.mapInArrow(meet, f"a {kind}, b {kind}").where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
