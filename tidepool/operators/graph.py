"""Operators on an undirected graph of weighted edges (src, dst, confidence)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.runtime import Scratch


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, nbr, ...): each edge from either end."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("nbr"), *rest).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("nbr"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def shared_neighbours(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, shared): how many neighbours the nodes of each given pair share; pairs without any don't come out.

    Only the neighbours of a pair's node of the lower degree are looked up against those of the other, so a hub's neighbours
    are listed for pairs of two hubs alone: over the edges themselves the work is at most edges ** 1.5.
    """
    near = both_ways(edges).select("node", "nbr")
    n = near.groupBy("node").agg(F.count("*").alias("degree"))
    p = pairs.select("src", "dst").join(n.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(n.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    first = F.col("ds") <= F.col("dd")
    p = p.select("src", "dst", F.when(first, F.col("src")).otherwise(F.col("dst")).alias("low"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("high"))
    step = p.join(near.withColumnRenamed("node", "low"), "low")
    return step.join(near.withColumnRenamed("node", "high"), ["high", "nbr"]).groupBy("src", "dst").agg(F.count("*").alias("shared"))


def waking_gate(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, confidence): walked pairs (src, dst, hops, jumped) that share a neighbour, with the confidence of a new
    edge: less for longer paths, more for shared neighbours and for paths that jumped."""
    base = F.greatest(F.lit(0.25), F.lit(0.5) - 0.05 * F.col("hops")) + F.least(F.lit(0.2), 0.05 * F.col("shared")) + F.when(F.col("jumped"), 0.1).otherwise(0.0)
    return walked.join(shared_neighbours(walked, edges), ["src", "dst"]).select("src", "dst", F.round(F.least(F.lit(0.7), base), 6).alias("confidence"))


def downscale(edges: DataFrame, scratch: Scratch, protected: float = 0.20, factor: float = 0.15, least: float = 0.08) -> DataFrame:
    """Weaken all edges but the strongest fifth, more the lower they rank; drop those below ``least``.

    Ranks are global without one task that sorts all: edges are range-partitioned by rank order, numbered within their
    partition, and shifted by the counts of the partitions before, of which there is one number each.
    """
    order = [F.desc("confidence"), "src", "dst"]
    placed = scratch.save(edges.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(Window.partitionBy()).alias("n"))
    ranked = placed.join(offsets, "part").withColumn("pos", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    keep = F.greatest(F.lit(1), F.floor(F.lit(protected) * F.col("n")))
    weak = F.col("confidence") * (1 - factor * (F.col("pos") - keep + 1) / (F.col("n") - keep))
    out = ranked.withColumn("scaled", F.when(F.col("pos") <= keep, F.col("confidence")).otherwise(weak))
    return out.where((F.col("pos") <= keep) | (F.col("scaled") >= least)).select("src", "dst", F.round("scaled", 4).alias("confidence"))


def hebbian(edges: DataFrame, least_degree: int = 5, rate: float = 0.1, decay: float = 0.8) -> DataFrame:
    """Strengthen edges between well-connected nodes, then scale all edges down."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("node").alias("src"), F.col("degree").alias("da")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("db")), "dst")
    grown = F.when((F.col("da") >= least_degree) & (F.col("db") >= least_degree), F.least(F.lit(1.0), F.col("confidence") + rate)).otherwise(F.col("confidence"))
    return both.select("src", "dst", F.round(decay * grown, 6).alias("confidence"))


def new_relations(new: DataFrame, existing: DataFrame) -> DataFrame:
    """(src, dst): relations not known in either direction, each once; loops are left out."""
    pair = new.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    known = existing.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    return pair.join(known, ["src", "dst"], "left_anti")


def dream_walk(edges: DataFrame, scratch: Scratch, seeds: int = 5, steps: int = 5, seed: int = 7) -> DataFrame:
    """(src, dst, hops): pairs at least two steps apart on weighted random walks from the nodes of the highest degree.

    A step picks the neighbour with the greatest log(u) / weight, u a hash of walk, step and edge, less for nodes already
    visited; the choice is an aggregate with partial combination, and a rerun walks alike. Edges without a confidence weigh
    0.5; neighbours without a positive weight are picked, all alike, only where there is no other.
    """
    near = both_ways(edges)
    walk = degrees(edges).orderBy(F.desc("degree"), "node").limit(seeds).select(F.col("node").alias("start"), "node", F.array("node").alias("path"))
    for k in range(steps):
        nexts = walk.join(near, "node")
        u = (F.pmod(F.xxhash64("start", F.lit(k), "nbr", F.lit(seed)), F.lit(1 << 40)) + 1) / float((1 << 40) + 2)
        given = F.coalesce(F.nanvl("confidence", F.lit(None).cast("double")), F.lit(0.5))
        weight = F.when(given > 0, given * F.when(F.array_contains("path", F.col("nbr")), 0.37).otherwise(1.0))
        best = nexts.groupBy("start", "path").agg(F.max_by("nbr", F.struct(weight.isNotNull().alias("usual"), F.coalesce(F.log(u) / weight, F.log(u)).alias("w"), "nbr")).alias("node"))
        walk = scratch.save(best.select("start", "node", F.concat("path", F.array("node")).alias("path")), "walk")
    pos = walk.select("start", F.posexplode("path").alias("i", "a"))
    pairs = pos.alias("x").join(pos.alias("y"), "start").where("y.i - x.i >= 2 and x.a <> y.a")
    return pairs.groupBy(F.least("x.a", "y.a").alias("src"), F.greatest("x.a", "y.a").alias("dst")).agg(F.min(F.expr("y.i - x.i")).alias("hops"))


def teleports(seeds: DataFrame, labels: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(node, target): for each seed (node), of which there are few, nodes (node, label) of the same label that have edges
    but none to it; those of the highest degree first."""
    n = degrees(edges)
    own = F.broadcast(seeds.select("node").limit(1000)).join(labels, "node")
    far = own.join(labels.select(F.col("node").alias("target"), "label"), "label").where("node <> target")
    known = both_ways(edges).select("node", F.col("nbr").alias("target"))
    ranked = far.join(known, ["node", "target"], "left_anti").join(n.select(F.col("node").alias("target"), "degree"), "target")
    order = Window.partitionBy("node").orderBy(F.desc("degree"), "target")
    return ranked.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("node", "target")


def boosted(pairs: DataFrame, rows: DataFrame, least_clusters: int = 2, least_rows: int = 3) -> DataFrame:
    """(src, dst, clusters, rows, boost): for each pair of names, of which there are few, in how many clusters of the rows
    (cluster, text) both occur within the first 200 characters of texts, in how many single texts, and whether that is enough
    to ask for a firmer relation. All pairs come out."""
    p = F.broadcast(pairs.select("src", "dst").distinct().limit(1000))
    text = F.lower(F.substring("text", 1, 200))
    has = rows.where("text is not null").join(p, F.contains(text, F.lower("src")) | F.contains(text, F.lower("dst")))
    has = has.select("src", "dst", "cluster", F.contains(text, F.lower("src")).alias("s"), F.contains(text, F.lower("dst")).alias("d"))
    per = has.groupBy("src", "dst", "cluster").agg(F.count_if(F.col("s") & F.col("d")).alias("rows"), F.max("s").alias("s"), F.max("d").alias("d"))
    sums = per.groupBy("src", "dst").agg(F.count_if(F.col("s") & F.col("d")).alias("clusters"), F.sum("rows").alias("rows"))
    out = pairs.select("src", "dst").distinct().join(sums, ["src", "dst"], "left").fillna(0, ["clusters", "rows"])
    return out.withColumn("boost", (F.col("clusters") >= least_clusters) | (F.col("rows") >= least_rows))
