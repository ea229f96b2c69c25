"""Tables that grow by runs: each run writes folders of its own and takes effect when it is committed.

Below a base folder, ``<table>/run=K`` holds what run K wrote and ``commits/run=K`` one row
about it, written last. Readers take committed runs only, so a run that was lost
half-way has no effect, and the next one takes its number and writes over it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def committed(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the committed runs, ascending."""
    path, fs = _path(spark, f"{base}/commits")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = sorted(int(m[1]) for m in map(re.compile(r"run=(\d+)$").match, names) if m)
    return [k for k in numbers if fs.exists(_path(spark, f"{base}/commits/run={k}/_SUCCESS")[0])]


def commit(facts: DataFrame, base: str, run: int) -> None:
    """Let run ``run`` take effect; ``facts`` is one row about it."""
    facts.coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/run={run}")


def read(spark: SparkSession, base: str, table: str, schema: str, runs: list[int]) -> DataFrame:
    """The rows that ``runs`` wrote to ``table``, with the number of their run."""
    frame = spark.read.schema(f"{schema}, run int").option("basePath", f"{base}/{table}")
    return frame.parquet(*[f"{base}/{table}/run={k}" for k in runs])


def drop(spark: SparkSession, base: str, tables: list[str], runs: list[int]) -> None:
    """Delete runs that no reader needs any more; their commits go first."""
    for table in ["commits", *tables]:
        for k in runs:
            path, fs = _path(spark, f"{base}/{table}/run={k}")
            fs.delete(path, True)
