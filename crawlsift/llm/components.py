"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.storage import drop, saved


def _least(edges: DataFrame) -> DataFrame:
    """(a, m): the least of a and all a's neighbours."""
    return saved(edges.groupBy("a").agg(F.least(F.min("b"), F.min("a")).alias("m")), "cc-least")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of edges (a, b); root is its component's least vertex.

    Alternating large-star and small-star steps: every step hangs neighbours under their least neighbour, so the
    number of edges never grows and rounds go with the logarithm of a component's width. A vertex with very many
    neighbours is pre-aggregated before its shuffle, and joined by a join that Spark may split. Tables of a round go
    with it.
    """
    edges = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        hung = saved(large.where(F.col("a") != F.col("b")).distinct(), "cc-large")
        drop(edges, least)
        least = _least(hung)
        small = hung.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = saved(small.where(F.col("a") != F.col("b")).distinct(), "cc-small")
        drop(hung, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
