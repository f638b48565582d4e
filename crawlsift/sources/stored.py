"""Intermediate tables: Parquet in the folder that all executors share, so that a job that uses one twice reads the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once under spark.checkpoint.dir and read again; a temporary folder serves only where that is unset on a
    local master, as in tests."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("crawlsift.scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='crawlsift-')}"
        spark.conf.set("crawlsift.scratch", root)
    path = f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, rows: int, *by: str) -> DataFrame:
    """A stored table dealt to tasks of about so many rows (by columns, if there are any), and to each core at least: bytes
    do not tell the work of rows that are small and take long, or that grow."""
    n = max(-(-table.count() // rows), table.sparkSession.sparkContext.defaultParallelism)
    return table.repartition(n, *by)
