"""Consolidating pairwise matches into groups: alternating large-star and small-star rewrites of an edge table.

Every node ends linked to the smallest node of its component. Nodes are 64-bit keys whose order is the order of the ids,
so each round aggregates, joins and deduplicates pairs of longs; components that are already a star leave the edge table
early. No round collects a neighbourhood: the minimum is a partially combined aggregate. What a node has been found to be is
joined back to its edges without moving the edges of hubs: those, of which there can only be few, meet a broadcast of the
hubs' rows where they stand, and only the edges of the other nodes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import Scratch

#: A memory id: 8-4-4-4-12 hexadecimal digits in lower case.
ID_PATTERN = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

BLANKS = " \t\n\r\x0b\x0c\xa0\u3000"


def clean_id(c: Column) -> Column:
    """An id without outer blanks and in lower case; null if the value is no memory id."""
    t = F.lower(F.btrim(c, F.lit(BLANKS)))
    return F.when(t.rlike(ID_PATTERN), t)


def id_key(c: Column) -> Column:
    """The first 64 bits of an id as a long with the same order."""
    return F.conv(F.concat(F.substring(c, 1, 8), F.substring(c, 10, 4), F.substring(c, 15, 4)), 16, -10).cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))


#: Edges from which a node is a hub, and the number that hubs can't exceed however many edges there are.
HUB, HUBS = 1_000_000, 1 << 17


def hubs(e: DataFrame, n: int, hub: int, scratch: Scratch) -> DataFrame | None:
    """(node) of more than ``hub`` of the ``n`` edges, in either direction, or more than their 2 n / HUBS if that is more;
    so there are at most HUBS. None if there can be none."""
    least = max(hub, 2 * n // HUBS)
    if n <= least:
        return None
    ends = e.select(F.explode(F.array("u", "v")).alias("node"))
    return scratch.save(ends.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > least).select("node"), "hubs")


def meet(e: DataFrame, key: str, known: DataFrame, hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``e`` joined with ``known``, which has one row for each of some values of ``key``. Rows of hubs stay where they are."""
    if hot is None:
        return e.join(known, key, how)
    few = F.broadcast(hot.withColumnRenamed("node", key))
    at_hubs = F.broadcast(known.join(few, key, "left_semi"))
    return e.join(few, key, "left_anti").join(known, key, how).unionByName(e.join(few, key, "left_semi").join(at_hubs, key, how))


def large_star(e: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Link each node's larger neighbours to the smallest of the node and its neighbours. ``e``: pairs (u, v), u > v."""
    sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return meet(sym.where("v > u"), "u", low, hot).select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(e: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = meet(e, "u", low, hot).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.withColumnRenamed("m", "v")).distinct()


def unfinished(e: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """The edges (u, v, live): ``live`` unless the edge's component already is a star around its minimum."""
    node = e.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    bad = node.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("parent")).where("ups > 1 or (ups > 0 and parent = 0)").select("n")
    above = meet(e, "u", bad.select(F.col("n").alias("u")), hot).select(F.col("v").alias("n"))
    tainted = bad.unionByName(above).distinct().select(F.col("n").alias("v"), F.lit(True).alias("live"))
    return meet(e, "v", tainted, hot, "left").select("u", "v", F.coalesce("live", F.lit(False)).alias("live"))


def star_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 100, hub: int = HUB) -> DataFrame:
    """(u, v): each node that isn't the smallest of its component, with that smallest node.

    ``edges``: pairs (u, v) of longs; nulls and loops are ignored, repeated and reversed pairs are harmless, an empty
    table gives an empty result.
    """
    e = scratch.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    done: list[DataFrame] = []
    seen, n = None, e.count()
    for k in range(max_rounds):
        big = scratch.save(large_star(e, hubs(e, n, hub, scratch)), "large")
        star = scratch.save(small_star(big, hubs(big, n, hub, scratch)), "small")
        new = scratch.save(unfinished(star, hubs(star, n, hub, scratch)), "edges")
        for t in (e, big, star):
            scratch.drop(t)
        state = new.where("live").agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        done.append(new.where("not live").select("u", "v"))
        e = new.where("live").select("u", "v")
        if state[0] == 0 or state == seen:
            done.append(e)
            break
        seen, n = state, state[0]
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def match_groups(log: DataFrame, scratch: Scratch, left: str = "kept_id", right: str = "removed_id") -> DataFrame:
    """(id, group_id): each memory id of a match log with the smallest id it is linked with, itself included.

    Ids are trimmed and in lower case. A null, blank or placeholder on one side links nothing, the id on the other side
    still comes out, as its own group if nothing else links it. Repeated, reversed and self-naming rows are harmless.
    The long keys are the ids' first 64 bits if those are unique in the data, else dense ranks in id order.
    """
    pairs = log.select(clean_id(F.col(left)).alias("a"), clean_id(F.col(right)).alias("b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    ids = scratch.save(ids.select(id_key(F.col("id")).alias("k"), F.unhex(F.replace("id", F.lit("-"), F.lit(""))).alias("id16")), "ids")
    if ids.groupBy("k").count().where("count > 1").isEmpty():
        edges = pairs.where("a <> b").select(id_key(F.col("a")).alias("u"), id_key(F.col("b")).alias("v"))
    else:
        return _grouped(pairs, _ranked(ids, scratch), scratch)
    return _labelled(ids, star_components(edges, scratch))


def _ranked(ids: DataFrame, scratch: Scratch) -> DataFrame:
    """Keys by position in a global sort: partition number and row number, increasing with the id."""
    ranged = ids.select("id16").repartitionByRange("id16").sortWithinPartitions("id16")
    return scratch.save(ranged.select(F.monotonically_increasing_id().alias("k"), "id16"), "ranks")


def _grouped(pairs: DataFrame, ranks: DataFrame, scratch: Scratch) -> DataFrame:
    hexed = pairs.where("a <> b").select(*(F.unhex(F.replace(c, F.lit("-"), F.lit(""))).alias(c) for c in "ab"))
    edges = hexed.join(ranks.select(F.col("id16").alias("a"), F.col("k").alias("u")), "a").join(ranks.select(F.col("id16").alias("b"), F.col("k").alias("v")), "b").select("u", "v")
    return _labelled(ranks, star_components(edges, scratch))


def _dashed(c: str) -> Column:
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *(F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _labelled(ids: DataFrame, stars: DataFrame) -> DataFrame:
    own = ids.join(stars.withColumnRenamed("u", "k"), "k", "left").select("k", "id16", F.coalesce("v", "k").alias("root"))
    roots = ids.select(F.col("k").alias("root"), F.col("id16").alias("root16"))
    return own.join(roots, "root").select(_dashed("id16").alias("id"), _dashed("root16").alias("group_id"))
