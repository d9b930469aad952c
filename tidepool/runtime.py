"""Session helpers: reading tables, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table under a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only a local session without the setting gets a temporary folder."""
    conf = spark.sparkContext.getConf()
    if d := conf.get("spark.checkpoint.dir", None):
        return d
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    jvm = spark.sparkContext._jvm
    if not (d := jvm.System.getProperty("tidepool.scratch")):
        d = tempfile.mkdtemp(prefix="tidepool-")
        jvm.System.setProperty("tidepool.scratch", d)
    return d


class Scratch:
    """Tables that cut lineage: written once to the shared folder, read back as plain scans.

    A table outlives the operator that made it, since its result is lazy; what an operator no longer reads it drops
    itself, the rest goes when the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/tidepool/{name}-{uuid.uuid4().hex[:12]}", 0
        atexit.register(self._remove, self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Remove a saved table that no plan reads any more."""
        if df is not None and (path := getattr(df, "_scratch_path", None)):
            self._remove(path)

    def clear(self) -> None:
        """Remove all its tables, when no plan reads them any more, and what shuffle files are left of them."""
        self._remove(self.root)
        self.sweep()

    def sweep(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session is gone; the folder is the cluster's to clean
            pass
