"""Visually identical text with different characters: classes of values that look the same, by SQL and collation.

Workers map each value letter by letter (``textform.consistent``, the one definition of the mapping). The mapped values are
grouped in SQL under an accent-sensitive Unicode collation, and the smallest of a class by code points stands for it. Texts are
shuffled once, for the grouping; what is joined back travels by 64-bit keys of the mapped values, to both sides of an
equi-join that adaptive execution splits where one class holds much of the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.textform import consistent

#: Accent-sensitive, case-sensitive; canonically equivalent compositions are equal.
COLLATION = "UNICODE"


def mapped(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, raw, key, form): each row's mapped value with 64-bit keys of the stored and of the mapped value; null for null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            forms = [consistent(t) for t in texts]
            keys = [[None if t is None else int(np.uint64(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))).view(np.int64)) for t in col] for col in (texts, forms)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(forms, pa.string())], ["id", "raw", "key", "form"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, raw bigint, key bigint, form string")


def classes(rows: DataFrame) -> DataFrame:
    """(text, lo, hi, keys): for each class its canonical member, the least and greatest key of its stored values, and the
    keys of its mapped values, of which there is more than one only where the collation joins different ones."""
    grouped = rows.where("form is not null").groupBy(F.collate("form", COLLATION).alias("like"))
    return grouped.agg(F.min(F.collate("form", "UTF8_BINARY")).alias("text"), F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.collect_set("key").alias("keys"))


def consistent_texts(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text): every row's text replaced by the canonical member of its class.

    A null text stays null, an empty one empty; repeated rows come out as often as they came in. Only mapped values that
    the collation joins with another are looked up, all others are canonical as they are.
    """
    rows = mapped(df, id_col, text_col)
    canon = classes(rows).where(F.size("keys") > 1).select(F.explode("keys").alias("key"), F.col("text").alias("canonical"))
    return rows.join(canon, "key", "left").select("id", F.coalesce("canonical", "form").alias("text"))


def lookalike_pairs(df: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(id_a, id_b): two ids with texts of more than ``min_chars`` characters that are the same in the consistent form
    but not as stored. A redelivered id counts once; null texts form no pair.

    Classes whose texts are all stored alike are dropped before anything is joined, so exact copies cost one aggregate.
    """
    rows = mapped(df.where(F.length(text_col) > min_chars), id_col, text_col)
    mixed = classes(rows).where("lo <> hi").select(F.array_min("keys").alias("cls"), F.explode("keys").alias("key"))
    member = rows.select("id", "raw", "key").join(mixed, "key").select("cls", "raw", "id").distinct()
    a, b = (member.select("cls", F.col("raw").alias(f"raw_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    return a.join(b, "cls").where("raw_a <> raw_b and id_a < id_b").select("id_a", "id_b").distinct()


def lookalike_classes(df: DataFrame, id_col: str = "id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(id, class_id, variants): each id of a class of ``lookalike_pairs`` with the smallest id of its class and in how many
    ways its texts are stored, one row an id however many belong to the class."""
    rows = mapped(df.where(F.length(text_col) > min_chars), id_col, text_col)
    mixed = classes(rows).where("lo <> hi").select(F.array_min("keys").alias("cls"), F.explode("keys").alias("key"))
    member = rows.select("id", "raw", "key").join(mixed, "key").select("cls", "raw", "id").distinct()
    low = member.groupBy("cls").agg(F.min("id").alias("class_id"), F.countDistinct("raw").alias("variants"))
    return member.select("cls", "id").distinct().join(low, "cls").select("id", "class_id", "variants")
