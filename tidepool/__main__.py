"""Command line: runs a named query on a folder of tables, or a step on staged proposals."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidepool.plans import cycle
from tidepool.sources import memory, store

#: Reports by their flag.
REPORTS = {"history": "run_history", "manifest-stats": "manifest_stats", "trigger-check": "trigger_check", "health": "store_health", "dedup-check": "online_write_check", "resolve-all": "conflict_resolution", "vault-review": "suggestion_review", "backlog": "claim_unclaimed"}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tidepool")
    p.add_argument("data", help="folder of the tables")
    p.add_argument("--query", choices=sorted(cycle.QUERIES))
    for flag in REPORTS:
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--out", help="folder for the result; without it 20 rows are shown")
    p.add_argument("--staging", help="folder of staged runs")
    p.add_argument("--staging-status", action="store_true")
    p.add_argument("--adopt", type=int, metavar="RUN", help="write the memories after a staged run to --out")
    p.add_argument("--force", action="store_true", help="adopt a run that validation rejected")
    a = p.parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    results = [cycle.QUERIES[name](spark, a.data) for flag, name in REPORTS.items() if getattr(a, flag.replace("-", "_"))]
    if a.query:
        results.append(cycle.QUERIES[a.query](spark, a.data))
    if a.staging_status:
        results.append(store.staging_status(spark, a.staging))
    if a.adopt is not None:
        results.append(store.adopt(memory.memories(spark, a.data), f"{a.staging}/run-{a.adopt:08d}", a.adopt, a.force))
    for k, df in enumerate(results):
        if a.out:
            df.write.mode("errorifexists").parquet(a.out if len(results) == 1 else f"{a.out}/{k}")
        else:
            df.show(truncate=80)


if __name__ == "__main__":
    main()
