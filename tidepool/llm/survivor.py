"""Best representative of each group: whole bundles of dependent fields, chosen by branch and bound.

A bundle is a set of fields that must come from one source row (a time with the row that has it, a text with its log
row). Each candidate value of a bundle has a trust; a record takes one candidate for each bundle so that the summed
trust is greatest and no functional dependency is broken: where two chosen bundles agree on the determining field they
must agree on the dependent one. Candidates beyond the best ``WIDTH`` of a bundle are only looked at for groups where the
best ones don't settle the choice, with a width that doubles until it is settled, so no candidate is ever dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions.times import instant
from tidepool.llm.components import clean_id
from tidepool.runtime import Scratch

#: Candidates of a bundle that are looked at first.
WIDTH = 4
#: The project's as-of time; later times are no times.
AS_OF = "2025-12-31 00:00:00"

Candidate = tuple[float, str, dict[str, str]]


def compatible(chosen: Sequence[dict[str, str]], new: dict[str, str], rules: Sequence[tuple[str, str]]) -> bool:
    for have in chosen:
        for source, target in rules:
            if source in have and target in have and have[source] == new.get(source) and new.get(target, have[target]) != have[target]:
                return False
    return True


def branch_and_bound(bundles: Sequence[Sequence[Candidate]], rules: Sequence[tuple[str, str]], more: Sequence[float | None] | None = None) -> tuple[float, list[Candidate]] | None:
    """The compatible choice, one candidate of each bundle, of the greatest summed trust; ties go to the candidates that
    come first, earlier bundles deciding. Candidates stand in falling trust. ``more``: the greatest trust of candidates
    that aren't given, None where all are; the result is None if one of them might belong to a better choice or if no
    choice is compatible."""
    n = len(bundles)
    rest = [0.0] * (n + 1)
    for k in reversed(range(n)):
        rest[k] = rest[k + 1] + (bundles[k][0][0] if bundles[k] else 0.0)
    best: tuple[float, list[Candidate]] | None = None

    def go(k: int, total: float, taken: list[Candidate]) -> None:
        nonlocal best
        if best is not None and total + rest[k] <= best[0]:
            return
        if k == n:
            best = total, list(taken)
            return
        if not bundles[k]:
            go(k + 1, total, taken)
        for c in bundles[k]:
            if best is not None and total + c[0] + rest[k + 1] <= best[0]:
                break
            if compatible([t[2] for t in taken], c[2], rules):
                taken.append(c)
                go(k + 1, total + c[0], taken)
                taken.pop()

    go(0, 0.0, [])
    for k, hidden in enumerate(more or ()):
        if hidden is not None and (best is None or hidden + rest[0] - bundles[k][0][0] > best[0]):
            return None
    return best


def choose(candidates: DataFrame, bundles: Sequence[str], rules: Sequence[tuple[str, str]], scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """(group_id, fields): for each group the fields of its best record as a map.

    ``candidates``: (group_id, bundle, trust, tie, fields); equal trust goes to the smaller tie. A group without any
    candidate of a bundle lacks its fields; a group whose every choice breaks a rule takes the best candidate of each
    bundle on its own. Candidates are ranked with a limit that is applied before the shuffle, so a large group costs at
    most ``width`` rows for each input partition.
    """
    out: list[DataFrame] = []
    rest = candidates
    while True:
        order = Window.partitionBy("group_id", "bundle").orderBy(F.desc("trust"), "tie")
        top = rest.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= width + 1)
        groups = top.groupBy("group_id").agg(F.collect_list(F.struct("bundle", "pos", "trust", "tie", F.to_json("fields").alias("fields"))).alias("rows"))

        def run(batches: Iterable[pa.RecordBatch], width: int = width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, fields, settled = [], [], []
                for g, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    sets: list[list[Candidate]] = [[] for _ in bundles]
                    more: list[float | None] = [None] * len(bundles)
                    for r in sorted(rows, key=lambda r: r["pos"]):
                        k = bundles.index(r["bundle"])
                        if r["pos"] <= width:
                            sets[k].append((r["trust"], r["tie"], json.loads(r["fields"])))
                        else:
                            more[k] = r["trust"]
                    found = branch_and_bound(sets, rules, more)
                    if found is None and not any(m is not None for m in more):
                        found = 0.0, [s[0] for s in sets if s]
                    ids.append(g), settled.append(found is not None)
                    fields.append([] if found is None else list({k: v for c in found[1] for k, v in c[2].items()}.items()))  # later bundles win
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(settled)], ["group_id", "fields", "settled"])

        kind = candidates.schema["group_id"].dataType.simpleString()
        done = groups.mapInArrow(run, f"group_id {kind}, fields map<string,string>, settled boolean")
        if not rules:  # each bundle's best candidate is the choice
            return done.select("group_id", "fields")
        done = scratch.save(done, "chosen")
        out.append(done.where("settled").select("group_id", "fields"))
        open_ = done.where("not settled").select("group_id")
        if open_.isEmpty():
            break
        rest, width = candidates.join(open_, "group_id", "left_semi"), width * 2
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def memory_candidates(memories: DataFrame, log: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates of the bundles time (``created_at``), weight (``importance``) and text (``merged_text``) for each group
    with at least two ids among the memories.

    Unreadable times, times after the as-of time and importances outside 0 to 1 are missing and rank lowest. A merged
    text counts if it has more than 20 characters without outer blanks; its trust is its length.
    """
    m = memories.select("id", instant(F.col("created_at")).alias("at"), "importance").dropDuplicates(["id"])
    m = m.join(groups, "id")
    large = m.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    m = m.join(large, "group_id")
    at = F.when(F.col("at") <= F.lit(AS_OF).cast("timestamp"), F.unix_micros("at").cast("double"))
    weight = F.when(F.col("importance").between(0, 1), F.col("importance"))
    lowest = F.lit(float("-inf"))
    time = m.select("group_id", F.lit("time").alias("bundle"), F.coalesce(at, lowest).alias("trust"), F.col("id").alias("tie"), F.create_map(F.lit("latest_id"), "id").alias("fields"))
    heavy = m.select("group_id", F.lit("weight").alias("bundle"), F.coalesce(weight, lowest).alias("trust"), F.col("id").alias("tie"), F.create_map(F.lit("top_id"), "id").alias("fields"))
    text = F.btrim("merged_text", F.lit(" \t\n\r\x0b\x0c\xa0　"))
    full = log.where(F.length(text) > 20).select(F.col("id").alias("log_id"), F.length(text).cast("double").alias("trust"), F.coalesce(clean_id(F.col("kept_id")), clean_id(F.col("removed_id"))).alias("id"))
    full = full.where("id is not null").join(groups, "id").join(large, "group_id", "left_semi")
    merged = full.select("group_id", F.lit("text").alias("bundle"), "trust", F.format_string("%020d", "log_id").alias("tie"), F.create_map(F.lit("merge_log_id"), F.col("log_id").cast("string")).alias("fields"))
    return time.unionByName(heavy).unionByName(merged)


def survivors(memories: DataFrame, log: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(group_id, latest_id, top_id, merge_log_id): the sources of each group's surviving record; -1 without a text."""
    chosen = choose(memory_candidates(memories, log, groups), ("time", "weight", "text"), (), scratch)
    f = F.col("fields")
    return chosen.select("group_id", f["latest_id"].alias("latest_id"), f["top_id"].alias("top_id"), F.coalesce(f["merge_log_id"].cast("bigint"), F.lit(-1)).alias("merge_log_id"))


#: Bundles of a whole record, the one that decides ties first, and what depends on what: a session has one source.
RECORD, RULES = ("weight", "text", "origin"), (("session_id", "source"),)


def record_candidates(memories: DataFrame, log: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates of whole records: the bundles origin (time, session and source of one memory) and weight (importance,
    session and source of one memory) and text, all with a trust from 0 to 1.

    A time's trust is its share of the time from 1970 to the as-of time, an importance is its own trust, and a merged text's
    grows with its length (n / (n + 200)). Missing and unreadable values have trust 0.
    """
    base = memory_candidates(memories, log, groups)
    m = memories.dropDuplicates(["id"]).select(F.col("id").alias("tie"), F.nullif(F.trim("session_id"), F.lit("")).alias("session_id"), F.nullif(F.lower(F.trim("source")), F.lit("")).alias("source"))
    both = base.where("bundle <> 'text'").join(m, "tie")
    time = F.col("bundle") == "time"
    trust = F.when(F.col("trust") > float("-inf"), F.when(time, F.greatest(F.lit(0.0), F.col("trust")) / F.unix_micros(F.lit(AS_OF).cast("timestamp"))).otherwise(F.col("trust"))).otherwise(0.0)
    extra = F.map_filter(F.create_map(F.lit("session_id"), "session_id", F.lit("source"), "source"), lambda _, v: v.isNotNull())
    placed = both.select("group_id", F.when(time, "origin").otherwise("weight").alias("bundle"), F.round(trust, 9).alias("trust"), "tie", F.map_concat("fields", extra).alias("fields"))
    text = base.where("bundle = 'text'").select("group_id", "bundle", F.round(F.col("trust") / (F.col("trust") + 200), 9).alias("trust"), "tie", "fields")
    return placed.unionByName(text)


def surviving_records(memories: DataFrame, log: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """(group_id, latest_id, top_id, merge_log_id, text, created_at, importance, session_id, source): one record for each
    group, its bundles chosen together under ``RULES``: time, session and source from ``latest_id``, importance from ``top_id``,
    text from the log row ``merge_log_id``, else from ``top_id``. Two memories of one session that name different sources are
    never mixed; the pair of the greatest summed trust without such a clash is taken.
    """
    chosen = choose(record_candidates(memories, log, groups), RECORD, RULES, scratch)
    f = F.col("fields")
    s = chosen.select("group_id", f["latest_id"].alias("latest_id"), f["top_id"].alias("top_id"), F.coalesce(f["merge_log_id"].cast("bigint"), F.lit(-1)).alias("merge_log_id"), f["session_id"].alias("session_id"), f["source"].alias("source"))
    m = memories.dropDuplicates(["id"])
    out = s.join(m.select(F.col("id").alias("latest_id"), instant(F.col("created_at")).alias("created_at")), "latest_id")
    out = out.join(m.select(F.col("id").alias("top_id"), "importance", F.col("text").alias("own_text")), "top_id")
    out = out.join(log.select(F.col("id").alias("merge_log_id"), "merged_text"), "merge_log_id", "left")
    weight = F.when(F.col("importance").between(0, 1), F.col("importance"))
    at = F.when(F.col("created_at") <= F.lit(AS_OF).cast("timestamp"), F.col("created_at"))
    return out.select("group_id", "latest_id", "top_id", "merge_log_id", F.coalesce(F.trim("merged_text"), "own_text").alias("text"), at.alias("created_at"), weight.alias("importance"), "session_id", "source")
