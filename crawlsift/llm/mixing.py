"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.storage import saved

#: A word, for sizes: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Newton's method ends when every source's words are within TOLERANCE of its target (relative), after NEWTON_STEPS at most.
NEWTON_STEPS, TOLERANCE, LARGEST_STEP = 60, 1e-9, 2.0


def numbered_sources(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n) for each source, n from 0 by code point, null last.

    Ranges of sources are numbered apart; what lies before a range comes from the ranges' counts, a row a partition.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ranged = saved(ranged, "mix-ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    numbered = ranged.withColumn("place", place).join(starts, "part").select("source", "source_size", (F.col("before") + F.col("place") - 1).alias("n"))
    return saved(numbered, "mix-sources")


def with_targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target: the sources share all words by weight, none above `most` times its size.

    The excess over the bound goes to the others by weight until none is above. Each pass sums over the sources
    where they lie; the driver holds three numbers.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("n") % len(weights) + 1).cast("int")).cast("double")
    sources = sources.withColumn("weight", weight).withColumn("bound", F.col("source_size") * float(most))
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = math.inf, -1
    while True:
        # sources with bound < level * weight are at their bound; the level only rises from pass to pass
        full = F.lit(False) if capped < 0 else F.col("bound") < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(full, F.col("bound")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
        if row[2] == capped or not row[1]:
            break
        level, capped = (total - row[0]) / row[1], row[2]
    return sources.withColumn("target", F.least(F.col("bound"), F.col("weight") * F.lit(0.0 if math.isinf(level) else level)))


def balanced(targets: DataFrame, statistics: DataFrame, most: int, tolerance: float = TOLERANCE, steps: int = NEWTON_STEPS) -> DataFrame:
    """Adds rate, the expected copies of a source's documents.

    Entropy balancing: of all mixes m that meet each source's target, the one nearest to the present words in relative
    entropy, with m at most `most` times a document's size, is m = size * min(most, exp(tilt of its source)). The tilts
    solve the convex dual, the sum of m less target * tilt. Each iteration adds up gradient and Hessian over the
    documents' statistics (n, size, docs: how many documents of a source have a size) and takes a damped Newton step;
    the Hessian is diagonal, as a document belongs to one source. The driver holds two numbers an iteration: the
    largest error left and the number of sources still moving.
    """
    wanted = (F.col("source_size") > 0) & (F.col("target") > 0)
    solved = saved(targets.withColumn("tilt", F.when(wanted, F.lit(0.0))), "mix-tilts")
    for _ in range(steps):
        at = statistics.join(solved.where(F.col("tilt").isNotNull()).select("n", "tilt"), "n")
        words = F.col("size") * F.col("docs")
        free = F.exp("tilt") < most
        sums = at.groupBy("n").agg(
            F.sum(words * F.least(F.lit(float(most)), F.exp("tilt"))).alias("taken"),
            # at the bound the curvature is that of the bound itself, so that a step back is finite
            F.sum(words * F.when(free, F.exp("tilt")).otherwise(F.lit(float(most)))).alias("curve"),
        )
        error = F.col("target") - F.col("taken")
        step = F.greatest(F.lit(-LARGEST_STEP), F.least(F.lit(LARGEST_STEP), F.try_divide(error, F.col("curve"))))
        both = solved.join(sums, "n", "left").withColumn("error", F.when(F.col("tilt").isNotNull(), F.try_divide(F.abs(error), F.col("target"))))
        moved = both.withColumn("tilt", F.when(F.col("error") <= tolerance, F.col("tilt")).when(F.col("tilt").isNotNull(), F.least(F.lit(math.log(most)), F.col("tilt") + step)))
        moved = saved(moved.drop("taken", "curve"), "mix-tilts")
        left = moved.agg(F.max("error")).first()[0]
        solved = moved.drop("error")
        if left is None or left <= tolerance:
            break
    return solved.withColumn("rate", F.coalesce(F.exp("tilt"), F.lit(0.0))).drop("tilt")


def _walk(most: int):
    def walk(sizes: pd.DataFrame) -> pd.DataFrame:
        sizes = sizes.sort_values("size", ascending=False)
        over, extra = 0.0, []
        for size, docs, rate in zip(sizes["size"].tolist(), sizes["docs"].tolist(), sizes["rate"].tolist(), strict=True):
            low = min(most, int(rate)) * docs
            high = low if int(rate) >= most else low + docs
            wanted = rate * docs * size + over
            copies = min(high, max(low, round(wanted / size))) if size else low
            over = wanted - copies * size
            extra.append(copies - low)
        return sizes.assign(extra=extra)[["n", "size", "extra"]]

    return walk


def with_copies(docs: DataFrame, most: int, bucket_docs: int = 2000) -> DataFrame:
    """Adds copies: each document's rate rounded down or up, so that each source's words come near its target.

    docs: doc_id, size, n (number of the source), rate. Documents of one source and size are told apart only by a
    hash of doc_id. Sizes are walked from the largest down; what rounding leaves over passes to the next smaller
    size. The walk sees a source's distinct sizes (at most about sqrt(2 * words)), not its documents. Buckets split
    a size that very many documents share, so that no window holds more than a small part of them.
    """
    buckets = max(1, math.ceil(docs.count() / bucket_docs))
    order = F.xxhash64("doc_id", F.lit(7))
    docs = docs.withColumn("order", order).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    parts = docs.groupBy("n", "size", "bucket").agg(F.count("*").alias("docs"), F.max("rate").alias("rate"))
    parts = saved(parts, "mix-parts")
    extra = parts.groupBy("n", "size").agg(F.sum("docs").alias("docs"), F.max("rate").alias("rate")).groupBy("n").applyInPandas(_walk(most), "n long, size long, extra long")
    before = F.sum("docs").over(Window.partitionBy("n", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    left = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(extra, ["n", "size"]).select("n", "size", "bucket", (F.col("extra") - F.col("before")).alias("left"))
    left = saved(left, "mix-left")
    rank = F.row_number().over(Window.partitionBy("n", "size", "bucket").orderBy("order", "doc_id"))
    ranked = docs.withColumn("place", rank).join(left, ["n", "size", "bucket"])
    copies = F.least(F.lit(most), F.floor("rate")) + (F.col("place") <= F.col("left")).cast("long")
    return ranked.withColumn("copies", copies).drop("order", "bucket", "place", "left")


def mix(documents: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """Copies of each document so that the sources' words meet weighted targets.

    Returns one row per input row: doc_id, size, source, source_size, target, rate, copies, taken. size is the
    number of words (null text: 0); taken is copies * size and at most `most` times size. Null sources form one
    source, the last. Documents without words get the copies of their rate's whole part, which take no words; a
    source without words has target 0 and rate 0. Repeated rows count each. Empty tables give no rows.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = saved(documents.select("doc_id", "source", size.alias("size")), "mix-sizes")
    targets = with_targets(numbered_sources(sizes), weights, most)
    numbers = targets.select(F.col("source").alias("of"), "n")
    counts = sizes.groupBy("source", "size").agg(F.count("*").alias("docs"))
    statistics = saved(counts.join(numbers, F.col("source").eqNullSafe(F.col("of"))).select("n", "size", "docs"), "mix-statistics")
    rates = balanced(targets, statistics, most)
    known = saved(rates.select(F.col("source").alias("of"), "n", "source_size", "target", "rate"), "mix-rates")
    docs = saved(sizes.join(known, F.col("source").eqNullSafe(F.col("of"))).drop("of"), "mix-docs")
    return with_copies(docs, most).withColumn("taken", F.col("copies") * F.col("size"))


def op7_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs.

    Rows that agree in every column are one document that the mix takes as often as all of them together.
    """
    whole = F.struct(*docs.columns)
    key = F.struct("doc_id", F.xxhash64(F.to_json(whole)).alias("h1"), F.xxhash64(F.lit(1), F.to_json(whole)).alias("h2"))
    taken = mix(docs.withColumn("doc_id", key)).groupBy("doc_id").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("rows"))
    taken = saved(taken.where(F.col("copies") > 0).select(F.col("doc_id.doc_id").alias("id"), "doc_id.h1", "doc_id.h2", "copies", "rows"), "mix-taken")
    keyed = docs.select(whole.alias("doc"), key.alias("key")).alias("d")
    same = F.col("d.key.doc_id").eqNullSafe(F.col("t.id")) & (F.col("d.key.h1") == F.col("t.h1")) & (F.col("d.key.h2") == F.col("t.h2"))
    once = keyed.join(taken.where(F.col("rows") == 1).alias("t"), same).select("doc", "copies")
    # equal rows meet in partial aggregates first, so very many of them are few rows of the shuffle
    more = keyed.join(taken.where(F.col("rows") > 1).alias("t"), same)
    more = more.groupBy("key").agg(F.first("doc").alias("doc"), F.first("copies").alias("copies")).select("doc", "copies")
    return once.unionByName(more).select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("doc.*")
