"""Lists beside the captures: sites, ground truth, tracking, image sizes, categories, series, features, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = "bin_norm INT, Date STRING, blocked INT, web_req_blocked INT, elem_blocked INT, snippet_blocked INT, nodes_added INT, nodes_removed INT, attribute_changed INT, text_changed INT, dom_content_loaded INT, iframe_src_changed INT, iframe_blocked INT, total_changes INT"


def read_sites(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, by_rank: bool = True) -> DataFrame:
    """(rank, url); start..end selects ranks, or places in rank order (end exclusive) if by_rank is false."""
    rows = spark.read.schema("rank INT, url STRING").csv(path)
    if start is None or end is None:
        return rows
    if by_rank:
        return rows.where(F.col("rank").between(start, end))
    return rows.orderBy("rank", "url").offset(start).limit(end - start)


def _line() -> Column:
    """Order of lines over files of a folder: by path, then by place."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def _last(rows: DataFrame, key: str) -> DataFrame:
    """The last line of each key, by file and line."""
    w = Window.partitionBy(key).orderBy(F.col("_line").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_line")


def _split_lines(spark: SparkSession, path: str, fields: int) -> DataFrame:
    rows = spark.read.text(path).select(F.split("value", ";;").alias("p"), _line().alias("_line"))
    return rows.where(F.size("p") == fields)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(url, label): a leading ! marks label 0; a url with both labels is positive."""
    line = F.trim("value")
    rows = spark.read.text(path).where(line != "").select(F.regexp_replace(line, "^!", "").alias("url"), F.when(line.startswith("!"), 0).otherwise(1).alias("label"))
    return rows.groupBy("url").agg(F.max("label").alias("label"))


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    """(page, sld, url, type) of `page;;sld;;url;;type` lines; other lines are skipped, repeated ones kept once."""
    p = lambda i: F.col("p")[i]
    return _split_lines(spark, path, 4).select(p(0).alias("page"), p(1).alias("sld"), p(2).alias("url"), p(3).alias("type")).distinct()


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(url without its scheme, width, height); the last line of a url wins."""
    size = lambda i: F.col("p")[i].try_cast("double").cast("int")
    rows = _split_lines(spark, path, 3).select(F.regexp_replace(F.col("p")[0], r"^https?:", "").alias("url"), size(1).alias("width"), size(2).alias("height"), "_line")
    return _last(rows, "url")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(domain, language, categories)."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.col(rows.columns[0]).alias("domain"), F.col("Language").alias("language"), F.col("Categories").alias("categories"))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SERIES).option("header", True).csv(path).withColumn("file", F.input_file_name())


def read_series_mapping(spark: SparkSession, path: str) -> DataFrame:
    """The mapping of sites to series files; the last row of a site wins."""
    rows = spark.read.option("header", True).csv(path).withColumn("_line", _line()).withColumnRenamed("URL Crawled", "url")
    return _last(rows, "url")


def read_feature_names(spark: SparkSession, path: str) -> list[str]:
    """Column names, one a line: a few hundred strings that decide a projection."""
    return [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a list of public suffixes, with its wildcards and exceptions, for urls.with_listed_suffix."""
    line = F.trim(F.substring_index("value", " ", 1))
    return spark.read.text(path).select(F.lower(line).alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """(url, chunk, cv_detect, trial, signal, arm, file) of a groups file: a header, then four paths a trial.

    The paths of a trial are the control's and the variant's requests, then both arms' mutations; empty ones are left out.
    """
    rows = spark.read.option("header", True).csv(path)
    paths = rows.columns[3:]
    kinds = [("requests", "control"), ("requests", "variant"), ("mutations", "control"), ("mutations", "variant")]
    each = [F.struct(F.lit(i // 4).alias("trial"), F.lit(kinds[i % 4][0]).alias("signal"), F.lit(kinds[i % 4][1]).alias("arm"), F.col(f"`{c}`").alias("file")) for i, c in enumerate(paths)]
    head = [F.col(f"`{c}`").alias(n) for c, n in zip(rows.columns[:3], ("url", "chunk", "cv_detect"), strict=True)]
    return rows.select(*head, F.explode(F.array(*each)).alias("p")).select("url", "chunk", F.col("cv_detect").try_cast("int").alias("cv_detect"), "p.*").where(F.coalesce("file", F.lit("")) != "")


def of_group(table: DataFrame, group: str, one: bool = False, name: str = "crawl_group_name", **equal: object) -> DataFrame:
    """Rows of one crawl group with the given values; one: a single row, the first by all columns."""
    rows = table.where(F.col(name) == group)
    for column, value in equal.items():
        rows = rows.where(F.col(column) == F.lit(value))
    return rows.orderBy(*rows.columns).limit(1) if one else rows


def with_url(rows: DataFrame, instances: DataFrame, key: str, found: str = "url") -> DataFrame:
    """Adds the URL of the instance that each row names: one join in place of a lookup a row."""
    known = instances.groupBy(F.col("id").alias(key)).agg(F.min("url").alias(found))
    return rows.join(known, key, "left")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in an earlier result: resuming is an anti join."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def in_ranks(rows: DataFrame, ranks: DataFrame, url: str, start: int, end: int) -> DataFrame:
    return rows.join(ranks.where(F.col("rank").between(start, end)).select(F.col("url").alias(url)).distinct(), url)


#: Snippets that hide elements; fixed values.
HIDING_SNIPPETS = ("hide-if-contains-visible-text", "hide-if-contains-and-matches-style", "hide-if-has-and-matches-style", "hide-if-contains-image", "hide-if-contains-image-hash", "hide-if-shadow-contains", "hide-if-contains")
RULE_CLASSES = ("request_blocking", "element_hiding", "whitelist", "snippet_hide", "snippet_abort", "snippet_misc")


def rule_class(rule: Column) -> Column:
    """Kind of a filter rule: the first that holds; null for comments and empty lines."""
    hides = F.exists(F.array(*map(F.lit, HIDING_SNIPPETS)), lambda s: F.contains(rule, s))
    snippet = F.when(rule.contains("abort"), "snippet_abort").when(hides, "snippet_hide").otherwise("snippet_misc")
    kind = (
        F.when(rule.startswith("@@") | rule.contains("#@#"), "whitelist")
        .when(rule.contains("#$#"), snippet)
        .when(rule.contains("#?#") | rule.contains("##"), "element_hiding")
        .otherwise("request_blocking")
    )
    return F.when(~rule.startswith("!") & (F.trim(rule) != ""), kind)


def rule_domains(rule: Column) -> Column:
    """Domains a rule names: `domain=` options but for excepted ones, `||host^`, or the list before a hiding mark.

    Exceptions, comments, popups and third-party rules name none.
    """
    none = F.array().cast("array<string>")
    options = F.filter(F.split(F.regexp_extract(rule, r"domain=([^,]*)", 1), r"\|"), lambda d: ~d.startswith("~"))
    hiding = F.split(F.regexp_extract(rule, r"^(.*?)(?:#\$#|#\?#|##)", 1), ",")
    found = (
        F.when(rule.isNull() | (F.trim(rule) == "") | rule.startswith("!") | rule.startswith("@@") | rule.contains("$popup") | rule.contains("third-party"), none)
        .when(rule.contains("domain="), options)
        .when(rule.startswith("||"), F.when(rule.contains("^"), F.array(F.substring_index(F.replace(rule, F.lit("||"), F.lit("")), "^", 1))).otherwise(none))
        .when(rule.rlike(r"#\$#|#\?#|##"), hiding)
        .otherwise(none)
    )
    return F.filter(F.transform(found, lambda d: F.trim(F.regexp_replace(d, "^-", ""))), lambda d: d != "")


def rule_histogram(rules: DataFrame, by: list[str], rule: str = "rule") -> DataFrame:
    """(by, RULE_CLASSES...): rules of each class."""
    kind = rule_class(F.col(rule))
    return rules.withColumn("_kind", kind).groupBy(*by).agg(*(F.count_if(F.coalesce(F.col("_kind") == c, F.lit(False))).alias(c) for c in RULE_CLASSES))


def merged_histograms(histograms: list[DataFrame], by: list[str]) -> DataFrame:
    """Histograms of any columns put together: sums by name, a missing column counting as 0."""
    whole = histograms[0]
    for h in histograms[1:]:
        whole = whole.unionByName(h, allowMissingColumns=True)
    return whole.groupBy(*by).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in whole.columns if c not in by))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, class, domains) of the rules of filter lists; comments and headers are skipped."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("rule")).where((line != "") & ~line.rlike(r"^(!|\[)"))
    return rows.withColumn("class", rule_class(F.col("rule"))).withColumn("domains", rule_domains(F.col("rule")))


def changed_rules(diff_lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """(by, sign, rule) of unified diff lines, without headers and files that hold no rules (documents, licenses, ignores).

    order tells the lines of a commit apart; each file's lines follow its header.
    """
    text = F.col(line)
    other = F.contains(text, F.lit(".md")) | F.contains(text, F.lit("LICENSE")) | F.contains(text, F.lit("gitignore"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = diff_lines.withColumn("_skip", F.coalesce(F.last(F.when(text.startswith("diff"), other), ignorenulls=True).over(w), F.lit(False)))
    live = rows.where(~F.col("_skip") & text.rlike(r"^[+-]") & ~text.startswith("---") & ~text.startswith("+++"))
    return live.select(*by, F.substring(text, 1, 1).alias("sign"), F.expr(f"substring({line}, 2)").alias("rule"))


def commit_rule_types(diff_lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """(by, RULE_CLASSES...): changed rules of each class, of every commit."""
    return rule_histogram(changed_rules(diff_lines, by, order, line), by)


def commit_domains(diff_lines: DataFrame, line: str = "line") -> DataFrame:
    """(domain, change) from unified diff lines of rule files: added, removed, or modified if on both sides."""
    text = F.col(line)
    rules = diff_lines.where(text.rlike(r"^[+-](?![+-])")).select(F.substring(text, 1, 1).alias("sign"), F.expr(f"substring({line}, 2)").alias("rule"))
    each = rules.select("sign", F.explode(rule_domains(F.col("rule"))).alias("domain"))
    sides = each.groupBy("domain").agg(F.max(F.col("sign") == "+").alias("plus"), F.max(F.col("sign") == "-").alias("minus"))
    return sides.select("domain", F.when(F.col("plus") & F.col("minus"), "modified").when(F.col("plus"), "added").otherwise("removed").alias("change"))
