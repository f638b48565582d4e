"""Groups of like hosts as a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.functions import urls
from crawlsift.operators import diff


def host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages, in blocks by their last two labels and the number of the others: groups of like names, led by those of odd pages."""
    h = F.split(urls.host(F.col("url")), r"\.")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where(F.size(h) > 2)
    block = F.array_join(F.slice(h, F.size(h) - 1, F.lit(2)), ".")
    rows = p.select(block.alias("block"), F.array_join(F.slice(h, F.lit(1), F.size(h) - 2), ".").alias("name"), F.when(F.col("page_id") % 2 == 0, "control").otherwise("variant").alias("arm"))
    return diff.leader_groups(rows, ["block"], "name").withColumn("similarity", F.round("similarity", 6))


HOST_GROUPS_SQL = r"""WITH RECURSIVE h AS (
  SELECT page_id % 2 = 0 AS control, string_split(lower(regexp_extract(url, '^(?:[^:/?#]+:)?(?://([^/?#:]*))?', 1)), '.') AS l FROM pages
), n AS (
  SELECT DISTINCT array_to_string(l[-2:], '.') AS block, array_to_string(l[:len(l) - 2], '.') AS name, CASE WHEN control THEN 'control' ELSE 'variant' END AS arm FROM h WHERE len(l) > 2
), o AS (
  SELECT block, list(name ORDER BY md5(name)) AS names FROM n WHERE arm = 'variant' GROUP BY block
), g AS (
  SELECT block, names, 0 AS i, []::VARCHAR[] AS leaders FROM o
  UNION ALL
  SELECT block, names, i + 1, CASE WHEN len(list_filter(leaders, lambda x: 1 - levenshtein(x, names[i + 1]) / greatest(len(x), len(names[i + 1])) >= 0.7)) > 0 THEN leaders ELSE list_append(leaders, names[i + 1]) END
  FROM g WHERE i < len(names)
), f AS (
  SELECT block, unnest(leaders) AS leader FROM g WHERE i = len(names)
), a AS (
  SELECT block, arm, name, leader, 1 - levenshtein(name, leader) / greatest(len(name), len(leader)) AS similarity FROM n JOIN f USING (block) WHERE arm = 'control' OR md5(leader) <= md5(name)
)
SELECT block, arm, name, leader, round(similarity, 6) AS similarity FROM a WHERE similarity >= 0.7
QUALIFY row_number() OVER (PARTITION BY block, arm, name ORDER BY similarity DESC, md5(leader) DESC) = 1"""

QUERIES = {"host_groups": host_groups}
ORACLES = {"host_groups": HOST_GROUPS_SQL}
