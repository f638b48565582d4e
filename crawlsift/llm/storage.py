"""Tables that cut lineage: Parquet in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset on a local master, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = spark.conf.get("crawlsift.scratch", None) or f"file://{tempfile.mkdtemp(prefix='crawlsift-')}"
        spark.conf.set("crawlsift.scratch", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Of a job that writes an intermediate table: its shuffle files go as soon as it is done, as only the table is used
#: afterwards, and Python gets its rows in batches of few megabytes, however long the texts are.
WHILE_SAVING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


@contextmanager
def saving(spark: SparkSession) -> Iterator[None]:
    """Settings for jobs of which only the result is used afterwards."""
    before = {k: spark.conf.get(k, None) for k in WHILE_SAVING}
    for k, v in WHILE_SAVING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again, so that a lost executor costs no recomputation of it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with saving(spark):
        df.write.parquet(path, compression=compression)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes saved tables that nothing reads any more: all that read them are saved themselves."""
    for t in tables:
        spark = t.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._saved_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
