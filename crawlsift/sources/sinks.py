"""Results: keyed appends, CSV tables and line lists, by Spark's writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def insert_absent(spark: SparkSession, rows: DataFrame, path: str, key: Sequence[str]) -> None:
    """Appends rows whose key the table at path does not have yet, one a key."""
    fresh = rows.dropDuplicates(list(key))
    try:
        known = spark.read.parquet(path).select(*key).distinct()
    except Exception as e:  # the first write
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    (fresh if known is None else fresh.join(known, list(key), "left_anti")).write.mode("append").parquet(path)


def append_events(events: DataFrame, instances: DataFrame, path: str, file: str = "file") -> None:
    """Raw events with the id of the capture instance that they are of, appended."""
    events.join(instances.select(file, F.col("id").alias("instance_id")), file).write.mode("append").parquet(path)


def upsert_groups(spark: SparkSession, groups: DataFrame, path: str, key: Sequence[str] = ("crawl_group_name", "crawl_type"), tries: int = 10) -> str:
    """Merges diff groups into a new version of the table at path, and returns the version's folder.

    Discarded groups replace what the table has; real ones are inserted where it has none. A version's rows are written
    to a folder of their own, then the version's number is claimed by a rename that fails where the number is taken: a
    lost writer leaves nothing that readers or later writers see, and of two writers the second merges again into what
    the first one wrote. Numbers only rise.
    """
    fresh = groups.dropDuplicates(list(key))
    for _ in range(tries):
        versions = table_versions(spark, path)
        whole = fresh
        if versions:
            old = latest_groups(spark, path)
            kept = old.join(fresh.where("discard").select(*key), list(key), "left_anti")
            new = fresh.where(~F.col("discard")).join(old.select(*key), list(key), "left_anti")
            whole = kept.unionByName(fresh.where("discard")).unionByName(new)
        folder = f"data-{uuid.uuid4().hex}"
        whole.write.partitionBy("discard").parquet(f"{path}/{folder}")
        number = int(versions[-1][1:]) + 1 if versions else 0
        if _claim(spark, path, f"v{number:08d}", folder):
            return f"{path}/{folder}"
    raise RuntimeError(f"{tries} other writers were faster; the table at {path} is as they left it")


def _claim(spark: SparkSession, path: str, version: str, folder: str) -> bool:
    """Names the folder as a version, by the rename of a file that is complete; False if the version exists."""
    jvm = spark.sparkContext._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    store = at(version).getFileSystem(conf)
    out = store.create(at(f".{folder}"), False)
    out.write(bytearray(folder.encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(version).toUri() if at(version).toUri().getScheme() else store.getUri(), conf)
    try:
        files.rename(at(f".{folder}"), at(version), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        store.delete(at(f".{folder}"), False)
        return False
    return True


def latest_groups(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table of groups."""
    name = f"{path}/_versions/{table_versions(spark, path)[-1]}"
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(name)
    stream = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(file)
    try:
        folder = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return spark.read.parquet(f"{path}/{folder}").withColumn("discard", F.col("discard").cast("boolean"))


def table_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's versions, oldest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(root):
        return []
    return sorted(n for n in (f.getPath().getName() for f in store.listStatus(root)) if n.startswith("v"))


def diff_groups(captures: DataFrame, trials: int) -> DataFrame:
    """A row a (key, signal): file ids of both arms in trial order, as lists and joined; discard if a trial lacks."""
    ids = lambda a: F.transform(F.array_sort(F.collect_list(F.when(F.col("arm") == a, F.struct("trial", "file")))), lambda x: x["file"])
    out = captures.groupBy("key", "signal").agg(F.first("url").alias("url"), ids("control").alias("control_ids"), ids("variant").alias("variant_ids"))
    out = out.withColumns({"control_ids_str": F.array_join("control_ids", ","), "variant_ids_str": F.array_join("variant_ids", ",")})
    return out.withColumn("discard", (F.size("control_ids") != trials) | (F.size("variant_ids") != trials))


def feature_csv(rows: DataFrame, path: str, url: str = "crawl_url", label: str = "cv_detect") -> None:
    """Site first, features by name, label last; commas in the site become two underscores."""
    names = sorted(c for c in rows.columns if c not in (url, label))
    rows.select(F.replace(F.col(url), F.lit(","), F.lit("__")).alias(url), *names, label).write.mode("overwrite").option("header", True).csv(path)


def variant_urls(rows: DataFrame, path: str) -> None:
    """Lines of page;;sld;;url;;type."""
    rows.select(F.concat_ws(";;", "page", "sld", "url", "type")).write.mode("overwrite").text(path)


def trial_growth_csv(cumulative: DataFrame, by: str, trial: str, trials: int, path: str) -> None:
    """A row a site, a column a trial."""
    wide = cumulative.groupBy(by).pivot(trial, list(range(trials))).agg(F.first("seen"))
    wide.select(by, *(F.col(str(t)).alias(f"trial_{t}") for t in range(trials))).write.mode("overwrite").option("header", True).csv(path)


def truncated_csv(rows: DataFrame, path: str, columns: Sequence[str], label: str = "cv_detect") -> None:
    """Labelled and unlabelled rows apart, with only the named features, sorted by site."""
    kept = rows.select("crawl_url", *columns, label)
    for name, part in (("ground_truth", kept.where(F.col(label) >= 0)), ("unlabelled", kept.where(F.col(label) < 0))):
        part.orderBy("crawl_url").write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


def save_parameters(spark: SparkSession, parameters: dict[str, tuple[float, float]], path: str) -> None:
    """A fitted scaler as a small table (column, centre, spread)."""
    spark.createDataFrame([(c, *p) for c, p in parameters.items()], "column string, centre double, spread double").coalesce(1).write.mode("overwrite").parquet(path)


def load_parameters(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    """A saved scaler: as many rows as it has columns."""
    return {r["column"]: (r.centre, r.spread) for r in spark.read.parquet(path).collect()}


def scaled_csv(rows: DataFrame, parameters: dict[str, tuple[float, float]], path: str) -> None:
    """Rows scaled by a fitted scaler, sorted by site, and the scaler beside them."""
    from crawlsift.operators.features import scaled

    scaled(rows, parameters).orderBy("crawl_url").write.mode("overwrite").option("header", True).csv(f"{path}/rows")
    save_parameters(rows.sparkSession, parameters, f"{path}/scaler")
