"""Calls of a model as columns: pluggable, cached by prompt, with a deterministic default where no model is given."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], Sequence[str | None]]


def prompt_key(prompt: Column, model_name: str) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", F.lit(model_name), prompt), 256), 1, 24)


def answered(rows: DataFrame, prompt: Column, model: Model | None, model_name: str = "default", cache: DataFrame | None = None, as_of: Column | None = None, hours: int = 24) -> DataFrame:
    """The rows with ``prompt_hash`` and ``answer``. Answers of the cache (prompt_hash, response, created_at) that are at
    most ``hours`` old at ``as_of`` are used; the model, if any, is asked once for each other prompt, in batches; a failed
    call, or no model, gives null."""
    keyed = rows.withColumn("prompt", prompt).withColumn("prompt_hash", prompt_key(F.col("prompt"), model_name))
    known = None
    if cache is not None:
        fresh = cache if as_of is None else cache.where(F.col("created_at") >= as_of - F.expr(f"INTERVAL '{hours}' HOUR"))
        known = fresh.groupBy("prompt_hash").agg(F.max_by("response", "created_at").alias("answer"))
    asked = keyed.where("prompt is not null").select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    if known is not None:
        asked = asked.join(known, "prompt_hash", "left_anti")

    def run(blocks: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in blocks:
            try:
                answers = list(model(b["prompt"].tolist()))
            except Exception:  # noqa: BLE001 - a call that fails leaves its default
                answers = [None] * len(b)
            yield pd.DataFrame({"prompt_hash": b["prompt_hash"], "answer": answers})

    new = asked.mapInPandas(run, "prompt_hash string, answer string") if model else asked.select("prompt_hash", F.lit(None).cast("string").alias("answer"))
    both = new if known is None else new.unionByName(known)
    return keyed.drop("prompt").join(both, "prompt_hash", "left")


def tolerant_json(text: str | None) -> object | None:
    """The value that a text states as JSON: as a whole, within a fence, or as its first object or array; else None."""
    if not text:
        return None
    fence = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for part in (text, fence[1] if fence else ""):
        try:
            return json.loads(part)
        except ValueError:
            pass
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[{\[]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def merged_text(texts: Column, answer: Column) -> Column:
    """The model's merged text if it has more than 10 characters, else the longest of the texts, the first of several."""
    longest = F.aggregate(texts, F.lit(""), lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc))
    return F.when(F.length(F.trim(answer)) > 10, F.trim(answer)).otherwise(longest)


def verdict(answer: Column) -> Column:
    """SUPERSEDE, EXTEND or FALSE_POSITIVE as the answer names first; null if it names none."""
    return F.nullif(F.regexp_extract(F.upper(answer), "(SUPERSEDE|EXTEND|FALSE_POSITIVE)", 1), F.lit(""))


def cluster_prompt(rows: DataFrame) -> DataFrame:
    """(cluster, prompt): one line for each row (cluster, id, text, created_at) with the first characters of its id, day and
    text; at most 50 lines a cluster, the smallest ids."""
    line = F.format_string("[%s] (%s) %s", F.substring("id", 1, 8), F.coalesce(F.substring(F.col("created_at").cast("string"), 1, 10), F.lit("?")), F.substring("text", 1, 300))
    kept = F.slice(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), 1, 50)
    few = rows.where("text is not null").withColumn("pos", F.expr("row_number() over (partition by cluster order by id)")).where("pos <= 50")
    return few.groupBy("cluster").agg(F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("prompt"))
