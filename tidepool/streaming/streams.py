"""Structured Streaming forms: each new memory once, and outcomes of user sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.runtime import Scratch


def _source(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the files of a table; a single file is read by its own name."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8)
    folder, _, name = path.rpartition("/")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_dir = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(fs).isDirectory()
    return reader.parquet(path) if is_dir else reader.option("pathGlobFilter", name).parquet(folder)


def _drain(stream: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder."""
    path = f"{scratch.root}/{name}"
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return scratch.spark.read.schema(stream.schema).parquet(path)


def incremental(spark: SparkSession, path: str, scratch: Scratch, late: str = "60 days") -> DataFrame:
    """(memory_id, created_at): each memory once, however often it is delivered within the watermark; state older than the
    watermark is dropped, rows without a time are not seen."""
    rows = _source(spark, path).select(F.col("id").alias("memory_id"), F.col("created_at").cast("timestamp").alias("created_at")).where("created_at is not null")
    return _drain(rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["memory_id"]), scratch, "new")


def outcomes(spark: SparkSession, path: str, scratch: Scratch, gap: str = "6 hours") -> DataFrame:
    """(user_id, started_at, n, outcome): sessions of events separated by a gap. A session is written once the watermark has
    passed it; those still open when the input ends are closed by one last event far ahead, which belongs to nobody."""
    events = spark.read.parquet(path).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ends = f"{scratch.root}/ends"
    events.limit(0).write.parquet(ends)
    both = _source(spark, path).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type").unionByName(spark.readStream.schema(events.schema).parquet(ends))
    s = both.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("neg"), F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("pos"))
    outcome = F.when(F.expr("neg = 1 and pos = 0"), "fail").when(F.expr("pos = 1 and neg = 0"), "success").when(F.expr("n >= 3 and neg = 0 and pos = 0"), "mixed").otherwise("unknown")
    out = s.select("user_id", F.col("w.start").alias("started_at"), "n", outcome.alias("outcome"))
    _drain(out, scratch, "outcomes")
    last = events.select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("2200-01-01 00:00:00").cast("timestamp").alias("ts"), F.lit("end").cast(events.schema["event_type"].dataType).alias("event_type"))
    last.limit(1).write.mode("append").parquet(ends)
    return _drain(out, scratch, "outcomes").where(F.col("started_at") < F.lit("2199-01-01").cast("timestamp"))
