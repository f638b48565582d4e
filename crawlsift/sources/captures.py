"""Capture files of page loads: web requests, DOM mutations and page sources, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = """url STRING, startTime STRING, endTime BIGINT, _corrupt_record STRING,
cvwebrequests ARRAY<STRUCT<type STRING, event STRUCT<tabId BIGINT, requestId STRING, url STRING, requestTime DOUBLE, status STRING, details STRING>>>"""
NODE = "STRUCT<id STRING, NoChildNodes INT, NodeType INT, NodeValue STRING, nodeName STRING, localName STRING, namespaceURI STRING, parentNode STRING, NodesAttributes ARRAY<ARRAY<STRING>>>"
MUTATIONS = f"""url STRING, startTime STRING, endTime BIGINT, _corrupt_record STRING,
dommutation ARRAY<STRUCT<type STRING, time BIGINT, event STRUCT<type STRING, target STRING, nodes STRING, nodeInfo ARRAY<ARRAY<{NODE}>>,
targetType STRING, parentNode STRING, attribute STRING, oldValue STRING, newValue STRING, recd ARRAY<{NODE}>>>>"""
DETAILS = "statusCode INT, type STRING, initiator STRING, error STRING, responseHeaders ARRAY<STRUCT<name STRING, value STRING>>"
BLOCKED = "ERR_BLOCKED_BY_CLIENT"


def file_parts(name: Column) -> list[Column]:
    """prefix, key, trial, signal and arm of a capture's path: `<site>__<key>__trial<n>--<signal>[vanilla].json`.

    The arm is read from the file's directory or its `vanilla` ending, not from anywhere in the path.
    """
    file = F.substring_index(name, "/", -1)
    folder = F.element_at(F.split(name, "/"), -2)
    prefix = F.regexp_extract(file, r"^(.*)__trial\d+", 1)
    vanilla = file.rlike(r"vanilla\.json$") | folder.rlike("(?i)control|vanilla")
    return [
        prefix.alias("prefix"),
        F.substring_index(prefix, "_", -1).alias("key"),
        F.regexp_extract(file, r"__trial(\d+)", 1).try_cast("int").alias("trial"),
        F.when(file.contains("webrequests"), "requests").when(file.contains("dommutation"), "mutations").when(file.endswith(".html"), "source").alias("signal"),
        F.when(vanilla, "control").otherwise("variant").alias("arm"),
    ]


def read_files(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(captures with file_parts, rejects): files that are not JSON go to the rejects, nothing fails later."""
    texts = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    rows = texts.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), F.input_file_name().alias("file"), "value")
    named = rows.select("*", *file_parts(F.col("file")))
    bad = F.col("j").isNull() | F.col("j._corrupt_record").isNotNull()
    good = named.where(~bad).select("j.*", *(c for c in named.columns if c not in ("j", "value"))).drop("_corrupt_record")
    return good, named.where(bad).select("file", F.col("value").alias("_corrupt_record"))


def inventory(captures: DataFrame) -> DataFrame:
    """One row a file: the capture instance without its events.

    crawl_group_name, file_name and arm are its natural key, id a hash of them; is_control tells the arm, which the
    folder may decide alone. Of several files of one key, the one of the least path counts.
    """
    kept = [c for c in captures.columns if c not in ("cvwebrequests", "dommutation")]
    name = F.substring_index("file", "/", -1)
    rows = captures.select(*kept).withColumns({"crawl_group_name": F.col("prefix"), "file_name": name, "file_path": F.substring_index("file", "/", -2), "is_control": F.col("arm") == "control"})
    rows = rows.withColumn("id", F.xxhash64("crawl_group_name", "file_name", "arm"))
    key = ["crawl_group_name", "file_name", "arm"]
    least = rows.groupBy(*key).agg(F.min_by(F.struct(*(c for c in rows.columns if c not in key)), "file").alias("_r"))
    return least.select(*(c if c in key else F.col(f"_r.`{c}`").alias(c) for c in rows.columns))


def instance_of(rows: DataFrame, instances: DataFrame) -> DataFrame:
    """Rows with the id of the instance of their group, file and (where they tell it) arm, null where there is none."""
    key = ["crawl_group_name", "file_name", *["arm"] * ("arm" in rows.columns)]
    return rows.join(instances.groupBy(*key).agg(F.min("id").alias("instance_id")), key, "left")


def group_instances(groups: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row an arm and trial of each group with its instance's columns, ids that no instance has).

    groups: control_ids and variant_ids in trial order. Trials are numbered from 0 by their place.
    """
    each = groups.select(*(c for c in groups.columns if c not in ("control_ids", "variant_ids")), F.explode(F.map_from_arrays(F.array(F.lit("control"), F.lit("variant")), F.array("control_ids", "variant_ids"))).alias("arm", "_ids"))
    placed = each.select(*(c for c in each.columns if c != "_ids"), F.posexplode("_ids").alias("trial", "file"))
    known = instances.select("file", *(c for c in instances.columns if c not in placed.columns))
    return placed.join(known, "file"), placed.join(known, "file", "left_anti").select("arm", "trial", "file")


def paired_groups(requests: DataFrame, mutations: DataFrame) -> DataFrame:
    """Request groups with the mutation group of the same name and site; discarded ones are left out, of several the first."""
    order = [F.array_join("variant_ids", ",")]
    live = lambda g, p: g.where(~F.col("discard")).groupBy("key", "url").agg(*(F.min_by(c, order[0]).alias(f"{p}_{c}") for c in ("control_ids", "variant_ids")))
    return live(requests, "request").join(live(mutations, "mutation"), ["key", "url"])


def request_events(captures: DataFrame, status: str | None = None) -> DataFrame:
    """A row an event: site, arm, trial, place, and the event's fields with parsed details (null where malformed)."""
    rows = captures.select("key", F.col("url").alias("site"), "arm", "trial", F.posexplode("cvwebrequests").alias("place", "e"))
    out = rows.select("key", "site", "arm", "trial", "place", "e.type", "e.event.*").withColumn("parsed", F.from_json("details", DETAILS))
    return out if status is None else out.where(F.col("type") == status)


def blocked_requests(events: DataFrame) -> DataFrame:
    """Requests that the blocker stopped."""
    return events.where((F.col("type") == "onErrorOccurred") & F.contains(F.coalesce(F.get_json_object("details", "$.error"), F.lit("")), F.lit(BLOCKED)))


def mutation_events(captures: DataFrame) -> DataFrame:
    """A row a DOM event. target is text; target_selector is null where it is no object (alerts)."""
    rows = captures.select("key", F.col("url").alias("site"), "arm", "trial", F.posexplode("dommutation").alias("place", "e"))
    out = rows.select("key", "site", "arm", "trial", "place", F.col("e.time").alias("time"), "e.event.*").where(F.col("type").isNotNull())
    return out.withColumn("target_selector", F.get_json_object("target", "$.selector"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Page sources: file parts and html, one row a file."""
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.html").text(path).withColumn("file", F.input_file_name())
    return rows.select("file", *file_parts(F.col("file")), F.col("value").alias("html"))


def source_names(captures: DataFrame) -> DataFrame:
    """(key, arm, trial, source_name): the page source's file name that goes with each capture of requests or mutations."""
    stem = F.regexp_replace(F.substring_index("file", "/", -1), r"--cv(webrequests|dommutation)(vanilla)?\.json$", "")
    return captures.select("key", "arm", "trial", F.concat(stem, F.lit(".html")).alias("source_name")).distinct()


def with_sources(captures: DataFrame, sources: DataFrame) -> DataFrame:
    """(key, arm, trial, html): each load's page source, by its exact name, else the first that starts with its stem."""
    names = source_names(captures)
    named = sources.withColumn("_name", F.substring_index("file", "/", -1))
    stem = F.regexp_replace("source_name", r"\.html$", "")
    both = names.join(named.select(F.col("arm").alias("_arm"), F.col("key").alias("_key"), F.col("trial").alias("_trial"), "_name", "html"), (F.col("key") == F.col("_key")) & (F.col("trial") == F.col("_trial")) & (F.col("arm") == F.col("_arm")) & F.startswith("_name", stem))
    exact = F.when(F.col("_name") == F.col("source_name"), 0).otherwise(1)
    return both.groupBy("key", "arm", "trial").agg(F.min_by("html", F.struct(exact, "_name")).alias("html"))
