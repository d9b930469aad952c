"""Groups over links: connected components, and greedy leaders with their members."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import Scratch


#: Ids whose links a worker holds at a time.
HELD = 1_000_000


def stars(links: DataFrame) -> DataFrame:
    """(a, b): links of the same components, at most one less than there are ids in a partition: each id with the smallest
    one it is linked with there."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x: object) -> object:
            top = x
            while parent.setdefault(top, top) != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        def out() -> pa.RecordBatch:
            rows = [(root(x), x) for x in list(parent) if root(x) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k in (0, 1)], ["a", "b"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) > HELD:
                yield out()
        if parent:
            yield out()

    kind = links.schema["a"].dataType.simpleString()
    return links.mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(id, root): each id of some link (a, b) with the smallest id it is linked with, directly or through others.

    In a round every id links its larger neighbours to the least id it sees, and then its smaller ones, until each component
    is a star around its smallest id. Null ends and loops link nothing. Before the first round each partition's links are
    replaced by stars, which have the same components.
    """
    e = stars(links.where("a <> b").select("a", "b")).distinct()
    e = scratch.save(e.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")), "links")
    for _ in range(max_rounds):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")).where("lo <> hi")
        new = scratch.save(stars(small.select(F.col("lo").alias("a"), F.col("hi").alias("b"))).select(F.col("a").alias("lo"), F.col("b").alias("hi")).distinct(), "links")
        scratch.drop(e)
        scratch.drop(large)
        e = new
        if e.groupBy("hi").count().where("count > 1").isEmpty() and e.join(e.select(F.col("lo").alias("hi")), "hi", "left_semi").isEmpty():
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def leaders(links: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(id, leader): the groups that arise if ids are gone through in order and each joins the first leader it is linked
    with, or becomes one itself. Ids without a link don't come out.

    The same result without going through one by one: in a round, ids without a smaller linked id that is a leader or still
    open become leaders, and open ids linked to a smaller leader become members.
    """
    e = links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    e = scratch.save(e, "links")
    state = scratch.save(e.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("is", F.lit("open")), "state")
    for _ in range(max_rounds):
        below = e.join(state.select(F.col("id").alias("lo"), F.col("is").alias("was")), "lo").groupBy(F.col("hi").alias("id")).agg(F.max(F.col("was") == "leader").alias("led"), F.max(F.col("was") == "open").alias("waits"))
        now = F.when(F.col("is") != "open", F.col("is")).when(F.coalesce("led", F.lit(False)), "member").when(F.coalesce("waits", F.lit(False)), "open").otherwise("leader")
        new = scratch.save(state.join(below, "id", "left").select("id", now.alias("is")), "state")
        scratch.drop(state)
        state = new
        if state.where("`is` = 'open'").isEmpty():
            break
    else:
        raise RuntimeError(f"leaders not settled after {max_rounds} rounds")
    first = state.where("`is` = 'leader'").select(F.col("id").alias("lo")).join(e, "lo").groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("leader"))
    return state.join(first, "id", "left").select("id", F.when(F.col("is") == "leader", F.col("id")).otherwise(F.col("leader")).alias("leader"))
