"""Feature tables: projections, labels, filters, scaling and scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.sources.stored import stored


def without(columns: Sequence[str], exact: Sequence[str] = (), parts: Sequence[str] = ()) -> list[str]:
    """Names that are not in exact and hold none of parts."""
    return [c for c in columns if c not in exact and not any(p in c for p in parts)]


def variant_only(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(("var_", "variant"))]


def present(rows: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that rows have."""
    return [c for c in wanted if c in rows.columns]


def feature_row(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Feature tables joined by site; a site without some part gets zeros there."""
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts).fillna(0)


def complete_rows(parts: Sequence[DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """(sites that every part has, audit of the others with what they lack)."""
    seen = reduce(DataFrame.unionByName, [p.select(key, F.lit(i).alias("part")).distinct() for i, p in enumerate(parts)])
    found = seen.groupBy(key).agg(F.collect_set("part").alias("have"))
    every = F.array(*map(F.lit, range(len(parts))))
    return found.where(F.size("have") == len(parts)).select(key), found.where(F.size("have") < len(parts)).select(key, F.array_sort(F.array_except(every, "have")).alias("missing"))


def labelled(rows: DataFrame, truth: DataFrame, url: str) -> DataFrame:
    """Adds cv_detect: the label of the url, -1 where there is none; of two labels the positive."""
    one = truth.groupBy(F.col("url").alias(url)).agg(F.max("label").alias("cv_detect"))
    return rows.join(one, url, "left").fillna({"cv_detect": -1})


def row_sum(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns), F.lit(0.0))


def training_split(rows: DataFrame, features: Sequence[str], label: str = "cv_detect") -> tuple[DataFrame, DataFrame]:
    """(rows with labels 0 or 1 but for positive ones whose features sum to nothing, rows without a label)."""
    filled = rows.fillna(0, list(features))
    if "ts__last_time_diff" in features:  # milliseconds to bins
        filled = filled.withColumn("ts__last_time_diff", F.bround(F.col("ts__last_time_diff") / 100, 2))
    empty = (F.col(label) == 1) & (row_sum(features) == 0)
    return filled.where(F.col(label).isin(0, 1) & ~empty), filled.where(F.col(label) == -1)


def in_categories(rows: DataFrame, categories: DataFrame, domain: str, languages: Sequence[str] = (), wanted: Sequence[str] = (), unwanted: Sequence[str] = ()) -> DataFrame:
    """Rows whose domain has a language of those named and a category that contains a wanted and no unwanted word."""
    keep = F.lit(True)
    if languages:
        keep &= F.col("language").isin(*languages)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("categories", w))
    if wanted:
        keep &= has(wanted)
    if unwanted:
        keep &= ~has(unwanted)
    return rows.join(categories.where(keep).select(F.col("domain").alias(domain)).distinct(), domain, "left_semi")


def ranked_value(values: DataFrame, column: str, shares: Sequence[float], parts: int | None = None) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours, by ranges: no task or driver holds its distinct values.

    Rows are dealt to ordered ranges and counted; only those ranges that hold a wanted rank are numbered.
    """
    spark = values.sparkSession
    n_parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = values.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    bounds = rows.groupBy("x").agg(F.count("*").alias("n"))
    ranged = stored(bounds.repartitionByRange(n_parts, "x").withColumn("part", F.spark_partition_id()), "ranks")
    counts = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before)
    total = F.sum("n").over(Window.partitionBy())
    wanted = starts.withColumn("total", total)
    upto = F.col("before") + F.coalesce(F.sum("n_").over(Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    ranks = F.array(*(F.lit(float(s)) for s in shares))
    low, high = lambda s: F.floor(s * (F.col("total") - 1)), lambda s: F.ceil(s * (F.col("total") - 1))
    inside = lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n"))
    live = wanted.where(F.exists(ranks, lambda s: inside(low(s)) | inside(high(s))))
    numbered = ranged.withColumnRenamed("n", "n_").join(live, "part").withColumn("upto", upto)
    at = lambda r: (r >= F.col("upto") - F.col("n_")) & (r < F.col("upto"))
    out = numbered.agg(F.max("total").alias("total"), *(F.max(F.when(at(f(F.lit(float(s)))), F.col("x"))).alias(f"{k}{i}") for i, s in enumerate(shares) for k, f in (("low", low), ("high", high)))).first()
    if out is None or out.total is None:
        return [None] * len(shares)
    part = [s * (out.total - 1) - math.floor(s * (out.total - 1)) for s in shares]
    return [out[f"low{i}"] + (out[f"high{i}"] - out[f"low{i}"]) * part[i] for i in range(len(shares))]


def scale_parameters(rows: DataFrame, columns: Sequence[str], how: str) -> dict[str, tuple[float, float]]:
    """{column: (centre, spread)}: standard and minmax by one aggregation, robust by ranked ranges. A spread of 0 counts as 1."""
    if how == "robust":
        cuts = {c: ranked_value(rows, c, (0.25, 0.5, 0.75)) for c in columns}
        return {c: (q[1] or 0.0, ((q[2] or 0.0) - (q[0] or 0.0)) or 1.0) for c, q in cuts.items()}
    forms = {
        "standard": lambda c: (F.avg(c), F.stddev_pop(c)),
        "minmax": lambda c: (F.min(c), F.max(c) - F.min(c)),
    }
    out = [x.cast("double").alias(f"{c}_{i}") for c in columns for i, x in enumerate(forms[how](c))]
    r = rows.agg(*out).first()
    return {c: (r[f"{c}_0"] or 0.0, r[f"{c}_1"] or 1.0) for c in columns}


def scaled(rows: DataFrame, parameters: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns less their centre, by their spread: fitted on one table, applied to any."""
    return rows.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in parameters.items()})


def quantile_scaled(fit: DataFrame, rows: DataFrame, columns: Sequence[str], quantiles: int = 100) -> DataFrame:
    """Each value as its share in the fitted quantiles, linear between them; outside them 0 and 1."""
    steps = [i / quantiles for i in range(quantiles + 1)]
    r = {c: ranked_value(fit, c, steps) for c in columns}

    def place(c: str) -> Column:
        cuts = F.array(*(F.lit(float(v)) for v in r[c]))
        below = F.size(F.filter(cuts, lambda q: q <= F.col(c)))
        low, high = F.element_at(cuts, F.greatest(below, F.lit(1))), F.element_at(cuts, F.least(below + 1, F.lit(quantiles + 1)))
        inside = F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(F.lit(0.0))
        return F.when(below == 0, 0.0).when(below == quantiles + 1, 1.0).otherwise((below - 1 + inside) / quantiles)

    return rows.withColumns({c: place(c) for c in columns})


def yeo_johnson(c: Column, power: float) -> Column:
    """Power transform for values of either sign."""
    up = F.log1p(c) if abs(power) < 1e-9 else (F.pow(c + 1, F.lit(power)) - 1) / power
    down = -F.log1p(-c) if abs(power - 2) < 1e-9 else -(F.pow(1 - c, F.lit(2 - power)) - 1) / (2 - power)
    return F.when(c >= 0, up).otherwise(down)


def fit_power(rows: DataFrame, column: str, powers: Sequence[float] = tuple(i / 4 for i in range(-8, 13))) -> float:
    """The power of greatest likelihood on a grid, all tried in one aggregation."""
    c = F.col(column).cast("double")
    log = F.signum(c) * F.log1p(F.abs(c))
    r = rows.agg(F.count(c).alias("n"), F.sum(log).alias("s"), *(F.var_pop(yeo_johnson(c, p)).alias(f"v{i}") for i, p in enumerate(powers))).first()
    gain = lambda i, p: -r["n"] / 2 * math.log(max(r[f"v{i}"] or 0.0, 1e-300)) + (p - 1) * (r["s"] or 0.0)
    return max(enumerate(powers), key=lambda x: gain(*x))[1]


def train_classifier(rows: DataFrame, features: Sequence[str], label: str = "cv_detect", seed: int = 0) -> PipelineModel:
    """A random forest over the features; the pipeline is saved and loaded by Spark ML."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="keep")
    return Pipeline(stages=[assembler, RandomForestClassifier(featuresCol="_features", labelCol=label, seed=seed)]).fit(rows.fillna(0, list(features)))


def scored(rows: DataFrame, model: PipelineModel, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Adds score, the chance of class 1, and predicted, 1 if it is above the threshold."""
    out = model.transform(rows.fillna(0, list(features)))
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("predicted", (F.col("score") > threshold).cast("int")).drop("_features", "rawPrediction", "probability", "prediction")
