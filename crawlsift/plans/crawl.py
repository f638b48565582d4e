"""The main query over captures that are made of the driver's pages: four neighbouring pages are two loads of both arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.plans.site_rows import site_rows as rows_of_sites
from crawlsift.sources import captures
from crawlsift.sources.stored import stored

TRIALS = 2
_HEADERS = '"responseHeaders":[{"name":"content-type","value":"application/javascript"},{"name":"content-length","value":"5000"}]'


def _call(url: Column, at: Column, kind: str, event: str = "onCompleted", error: str | None = None) -> Column:
    details = f'{{"error":"{error}"}}' if error else f'{{"statusCode":200,"type":"{kind}",{_HEADERS}}}'
    fields = {"tabId": F.lit(1).cast("long"), "requestId": F.lit("1"), "url": url, "requestTime": at.cast("double"), "status": F.lit(event), "details": F.lit(details)}
    return F.struct(F.lit(event).alias("type"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("event"))


def _added(at: Column, tag: str) -> Column:
    event = (
        f"named_struct('type', 'nodes added', 'target', '{{\"selector\":\"BODY\"}}', 'nodes', '[{{\"selector\":\"{tag.upper()}\",\"nodeId\":2}}]', 'nodeInfo', "
        f"array(array(named_struct('id', '', 'NoChildNodes', 0, 'NodeType', 1, 'NodeValue', string(null), 'nodeName', '{tag.upper()}', 'localName', '{tag}', 'namespaceURI', '', 'parentNode', '', 'NodesAttributes', array(array(''))))), "
        "'targetType', 'BODY', 'parentNode', string(null), 'attribute', string(null), 'oldValue', string(null), 'newValue', string(null), 'recd', "
        "array(named_struct('id', '', 'NoChildNodes', 0, 'NodeType', 1, 'NodeValue', string(null), 'nodeName', '', 'localName', '', 'namespaceURI', '', 'parentNode', '', 'NodesAttributes', array(array('')))))"
    )
    return F.struct(F.lit("event").alias("type"), at.cast("long").alias("time"), F.expr(event).alias("event"))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture of both signals and a page source for each page of a whole group of four."""
    n = F.col("page_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").where(n.isNotNull()).withColumn("g", F.floor(n / 4))
    whole = pages.groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("page_id").alias("d")).where("c = 4 and d = 4").select("g")
    text = n.cast("string")
    variant = n % 2 == 1
    extra = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: _call(F.concat(F.lit("http://t"), text, F.lit(".example.net/js/"), i.cast("string"), F.lit(".js?a=1")), F.lit(1100) + i, "script"))
    calls = F.concat(
        F.array(_call(F.concat(F.lit("http://site"), F.col("g").cast("string"), F.lit(".com/")), F.lit(1000), "main_frame"), _call(F.col("url"), F.lit(1010), "script")),
        F.when(variant, F.slice(extra, F.lit(1), (n % 3).cast("int"))).otherwise(F.slice(extra, 1, 0)),
        F.slice(F.array(_call(F.lit("http://ads.example.org/a.js"), F.lit(1020), "script", "onErrorOccurred", captures.BLOCKED)), F.lit(1), F.when(variant, (n % 5 == 1).cast("int")).otherwise(0)),
    )
    changes = F.transform(F.sequence(F.lit(0), F.when(variant, n % 5).otherwise(n % 3).cast("int")), lambda i: _added(F.lit(1200) + i, "img"))
    html = F.when(variant & (n % 3 == 0), F.concat("html", F.lit("<p>adblocker found</p>"))).otherwise(F.col("html"))
    return pages.join(whole, "g").select(
        F.concat(F.lit("k"), F.col("g").cast("string")).alias("key"), F.concat(F.lit("http://site"), F.col("g").cast("string"), F.lit(".com/")).alias("url"),
        F.when(variant, "variant").otherwise("control").alias("arm"), (F.floor(n / 2) % 2).cast("int").alias("trial"), calls.alias("cvwebrequests"), changes.alias("dommutation"), html.alias("html"),
    )


SHOWN = ["variant_trials_urls", "variant_content_type__js", "dom_node_changed_added__img", "ts_blocked_spikes", "pagesource_var_adblock_keyword"]


def site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each site's feature row, a column or two of each family: requests, mutations, series and page source."""
    made = stored(loads(spark, sf_dir), "loads")
    calls, changes = captures.request_events(made), captures.mutation_events(made)
    sources = made.select("key", F.col("url").alias("site"), "arm", "trial", "html")
    rows, _ = rows_of_sites(calls, changes, sources, TRIALS)
    return rows.select("crawl_url", *SHOWN, "cv_detect")


SITE_ROWS_SQL = """
WITH p AS (
  SELECT page_id AS n, page_id // 4 AS g, page_id % 2 = 1 AS variant, url FROM pages WHERE page_id IS NOT NULL
), whole AS (
  SELECT g FROM p GROUP BY g HAVING count(*) = 4 AND count(DISTINCT n) = 4
), q AS (
  SELECT p.*, list(url) FILTER (WHERE NOT variant) OVER (PARTITION BY g) AS others FROM p JOIN whole USING (g)
)
SELECT 'http://site' || g || '.com/' AS crawl_url,
  CAST(1 + count(DISTINCT url) FILTER (WHERE variant) + sum(n % 3) FILTER (WHERE variant) AS DOUBLE) AS variant_trials_urls,
  CAST(count(DISTINCT url) FILTER (WHERE variant AND NOT list_contains(others, url)) + sum(n % 3) FILTER (WHERE variant) AS DOUBLE) AS variant_content_type__js,
  CAST(greatest(0, sum(CASE WHEN variant THEN n % 5 + 1 ELSE -(n % 3 + 1) END)) AS DOUBLE) AS dom_node_changed_added__img,
  count(*) FILTER (WHERE variant AND n % 5 = 1) / 2 AS ts_blocked_spikes,
  CAST(max(CASE WHEN variant AND n % 3 = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS pagesource_var_adblock_keyword, -1 AS cv_detect
FROM q GROUP BY g
"""
