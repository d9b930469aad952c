"""What runs leave behind: staged proposals, logs and page files, in folders that all executors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.operators import proposals as ops

#: Schema of a staged proposal.
PROPOSAL = "seq bigint, memory_id string, op string, new_text string, patch map<string,string>"


def append(rows: DataFrame, path: str, run_id: int) -> None:
    """Add rows to a log with the number of the run that wrote them."""
    rows.withColumn("dream_run_id", F.lit(run_id).cast("bigint")).write.mode("append").parquet(path)


def stage(rows: DataFrame, root: str, run_id: int, accepted: bool) -> str:
    """Write proposals and their manifest below ``root``; the folder's name."""
    path = f"{root.rstrip('/')}/run-{run_id:08d}"
    rows.select("seq", "memory_id", "op", "new_text", "patch").write.mode("errorifexists").json(f"{path}/proposals")
    counts = ops.stats(rows).select("op", "n", "ids", F.lit(run_id).cast("bigint").alias("run_id"), F.lit(accepted).alias("accepted"))
    counts.coalesce(1).write.json(f"{path}/manifest")
    return path


def staged(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROPOSAL).json(f"{path}/proposals")


def staging_status(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, proposals, accepted, adopted) of each staged run."""
    rows = spark.read.schema("op string, n bigint, ids bigint, run_id bigint, accepted boolean").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(root)
    rows = rows.where("run_id is not null and op is not null")
    done = rows.where("op = '#adopted'").select("run_id", F.lit(True).alias("adopted")).distinct()
    by = rows.where("op <> '#adopted'").groupBy("run_id").agg(F.sum("n").alias("proposals"), F.max("accepted").alias("accepted"))
    return by.join(done, "run_id", "left").fillna(False, ["adopted"])


def adopt(memories: DataFrame, path: str, run_id: int, forced: bool = False) -> DataFrame:
    """The memories after a staged run's proposals. A run that validation rejected is refused unless ``forced``. The rows it
    touches are kept in the run's folder as they were, and the run is marked as adopted."""
    spark = memories.sparkSession
    manifest = spark.read.schema("op string, n bigint, ids bigint, run_id bigint, accepted boolean").json(f"{path}/manifest")
    if not forced and not manifest.where("not accepted").isEmpty():
        raise ValueError("the run was rejected by validation")
    rows = staged(spark, path)
    memories.join(rows.select("memory_id").distinct(), "memory_id", "left_semi").write.mode("overwrite").parquet(f"{path}/backup")
    spark.range(1).select(F.lit("#adopted").alias("op"), F.lit(0).alias("n"), F.lit(0).alias("ids"), F.lit(run_id).cast("bigint").alias("run_id"), F.lit(True).alias("accepted")).coalesce(1).write.mode("overwrite").json(f"{path}/adopted")
    return ops.adopt(memories, rows)


def pages(spark: SparkSession, root: str, skip: str = r"(?i)(^|/)(\.|_|readme)") -> DataFrame:
    """(path, name, kind, freshness, size): the page files below a folder (md, pdf, txt, docx) but those whose name is to be
    skipped, with the ``data_freshness`` of the header of text pages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    head = F.when(kind.isin("md", "txt"), F.substring(F.decode("content", "UTF-8"), 1, 2000))
    return files.where(kind.isin("md", "pdf", "txt", "docx") & ~name.rlike(skip)).select("path", name.alias("name"), kind.alias("kind"), frontmatter(head, "data_freshness").alias("freshness"), F.col("length").alias("size"))


def frontmatter(text: Column, key: str) -> Column:
    """The value of a key in the header between two lines of dashes at the beginning of a text; null without one."""
    header = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)^\s*---\s*\n(.*?)\n---", 1)
    return F.nullif(F.trim(F.regexp_extract(header, rf"(?m)^{key}:[ \t]*[\"']?([^\"'\n]*)", 1)), F.lit(""))


def page_stub(entity: Column, category: Column, keywords: Column, freshness: Column, overview: Column, day: str) -> Column:
    """The text of a new page."""
    return F.format_string(
        "---\ntitle: %s\ndate: " + day + "\ncategory: %s\ntags: [%s]\nexplored: false\nconfidence: low\nprovenance: inferred\ndata_freshness: %s\n---\n\n# %s\n\n%s\n",
        entity, category, F.array_join(keywords, ", "), freshness, entity, F.substring(overview, 1, 300),
    )


def stale_daily(path: Column, as_of: Column, days: int = 14) -> Column:
    """Whether a file of a daily folder is named by a day more than ``days`` before."""
    day = F.regexp_extract(path, r"/daily/(\d{4}-\d{2}-\d{2})[^/]*$", 1)
    return F.coalesce(F.datediff(as_of, F.nullif(day, F.lit("")).try_cast("date")) > days, F.lit(False))
