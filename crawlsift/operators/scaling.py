"""Five scalers as one Spark ML estimator: fitted on labelled rows, saved, loaded and applied to any; flags stay as they are."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.sources.stored import stored

HOW = ("standardscale", "minmax", "robust", "quantile", "powertrans")
#: Columns that no scaler changes; fixed values.
UNSCALED = (
    "crawl_url", "var_1_dom_as_path", "var_1_spec_char_path", "var_3rd_dom_as_path", "var_3rd_spec_char_path", "pagesource_var_adblock_keyword",
    "variant_subdomain_length_more5", "peak_sync_total_changes_offset_ispositive", "cv_detect",
)
#: Points of a round of the search for a power, first bracket, and width at which it ends.
POINTS, BRACKET, CLOSE = 11, (-5.0, 5.0), 1e-6


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, x): a row a value; nulls and NaN are left out."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns))
    return rows.select(F.inline(pairs)).where(F.col("x").isNotNull() & ~F.isnan("x"))


def even_quantiles(long: DataFrame, steps: int) -> DataFrame:
    """(column, i, value) for i from 0 to steps: exact quantiles i / steps of each column, linear between neighbours.

    All columns go through one range partitioning of their distinct values; ranges are counted, so each value knows
    the ranks that it fills, and of these the wanted ones by arithmetic. No task holds a column.
    """
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = long.groupBy("column", "x").agg(F.count("*").alias("n"))
    ranged = stored(counted.repartitionByRange(parts, "column", "x").withColumn("part", F.spark_partition_id()), "ranks")
    sums = ranged.groupBy("column", "part").agg(F.sum("n").alias("s"))
    whole = Window.partitionBy("column")
    starts = sums.select("column", "part", (F.sum("s").over(whole.orderBy("part")) - F.col("s")).alias("before"), (F.sum("s").over(whole) - 1).alias("t"))
    upto = F.sum("n").over(Window.partitionBy("column", "part").orderBy("x"))
    rows = ranged.withColumn("b", upto).join(starts, ["column", "part"]).withColumns({"b": F.col("b") + F.col("before"), "a": F.col("b") + F.col("before") - F.col("n")})
    span = lambda first, last: F.expr(f"CASE WHEN t = 0 THEN sequence(0L, {steps}L) WHEN {first} <= {last} THEN sequence({first}, {last}) ELSE array() END")
    low = span(f"(a * {steps} + t - 1) div t", f"least({steps}L, (b * {steps} + t - 1) div t - 1)")
    high = span(f"CASE WHEN a = 0 THEN 0L ELSE ((a - 1) * {steps}) div t + 1 END", f"least({steps}L, ((b - 1) * {steps}) div t)")
    hits = rows.select("column", "x", "t", F.explode(F.concat(F.transform(low, lambda i: F.struct(i.alias("i"), F.lit(True).alias("low"))), F.transform(high, lambda i: F.struct(i.alias("i"), F.lit(False).alias("low"))))).alias("h"))
    ends = hits.groupBy("column", "t", "h.i").agg(F.max(F.when(F.col("h.low"), F.col("x"))).alias("lo"), F.max(F.when(~F.col("h.low"), F.col("x"))).alias("hi"))
    return ends.select("column", "i", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("i") * F.col("t") % steps / steps)).alias("value"))


def power(x: Column, p: Column) -> Column:
    """The power transform for values of either sign (Yeo and Johnson)."""
    up = F.when(F.abs(p) < 1e-12, F.log1p(x)).otherwise(F.expm1(p * F.log1p(x)) / p)
    down = F.when(F.abs(p - 2) < 1e-12, -F.log1p(-x)).otherwise(-F.expm1((2 - p) * F.log1p(-x)) / (2 - p))
    return F.when(x >= 0, up).otherwise(down)


def fitted_powers(long: DataFrame) -> dict[str, tuple[float, float, float]]:
    """{column: (power, mean, deviation)}: the power of greatest likelihood of each column, and what it makes of the values.

    A round tries POINTS powers of each column's bracket in one aggregation; the bracket closes around the best one, or
    moves on where that is its end. A column of one value keeps the power 1. The driver holds a bracket a column.
    """
    spark = long.sparkSession
    counts = stored(long.groupBy("column", "x").agg(F.count("*").alias("n")), "values")
    log = F.sum(F.col("n") * F.signum("x") * F.log1p(F.abs("x"))).alias("log")
    known = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), log, (F.min("x") < F.max("x")).alias("varies")).collect()}
    brackets = {c: BRACKET for c, r in known.items() if r.varies}
    best = {c: 1.0 for c in known}

    def tried(points: list[tuple[str, float]]) -> dict[tuple[str, float], tuple[float, float]]:
        """Mean and variance after each power: from sums about the first moments of two passes over distinct values."""
        table = F.broadcast(spark.createDataFrame(points, "column string, p double"))
        y = counts.join(table, "column").withColumn("y", power(F.col("x"), F.col("p")))
        mean = y.groupBy("column", "p").agg((F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("m"))
        spread = y.join(F.broadcast(mean), ["column", "p"]).groupBy("column", "p", "m").agg((F.sum(F.col("n") * F.pow(F.col("y") - F.col("m"), F.lit(2.0))) / F.sum("n")).alias("v"))
        return {(r["column"], r.p): (r.m, r.v) for r in spread.collect()}

    while brackets:
        points = {c: [lo + (hi - lo) * i / (POINTS - 1) for i in range(POINTS)] for c, (lo, hi) in brackets.items()}
        seen = tried([(c, p) for c, ps in points.items() for p in ps])
        for c, ps in points.items():
            gain = [(p - 1) * known[c].log - known[c].n / 2 * math.log(v) if math.isfinite(v) and v > 0 else -math.inf for p, v in ((p, seen[c, p][1]) for p in ps)]
            k = max(range(POINTS), key=gain.__getitem__)
            best[c], step, wide = ps[k], ps[1] - ps[0], ps[-1] - ps[0]
            brackets[c] = (ps[k] - step, ps[k] + step) if 0 < k < POINTS - 1 else (ps[k] - wide / 2, ps[k] + wide / 2)
            if 0 < k < POINTS - 1 and step < CLOSE or abs(ps[k]) > 64:
                del brackets[c]
    end = tried(list(best.items())) if best else {}
    return {c: (p, end[c, p][0], math.sqrt(end[c, p][1]) if known[c].varies else 1.0) for c, p in best.items()}


class _Shared(Params):
    how = Param(Params._dummy(), "how", "one of " + ", ".join(HOW), TypeConverters.toString)
    columns = Param(Params._dummy(), "columns", "columns to scale", TypeConverters.toListString)
    steps = Param(Params._dummy(), "steps", "quantiles of the quantile scaler, less one", TypeConverters.toInt)


class Scaler(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits one scaler to columns, those of UNSCALED left out.

    Nulls and NaN take no part in a fit and stay as they are. A spread of 0 counts as 1; a column without values is not
    changed. Quantiles are over all rows (1,000 steps), ties stand in the middle of their shares.
    """

    @keyword_only
    def __init__(self, *, how: str = "standardscale", columns: Sequence[str] = (), steps: int = 1000):
        super().__init__()
        self._setDefault(how="standardscale", columns=[], steps=1000)
        self._set(**self._input_kwargs)

    def _fit(self, rows: DataFrame) -> ScalerModel:
        how, steps = self.getOrDefault("how"), self.getOrDefault("steps")
        if how not in HOW:
            raise ValueError(f"no scaler {how}")
        names = [c for c in self.getOrDefault("columns") if c not in UNSCALED]
        long = _long(rows, names) if names else None
        found: dict[str, list[float]] = {}
        if long is None:
            pass
        elif how == "powertrans":
            found = {c: list(v) for c, v in fitted_powers(long).items()}
        elif how in ("robust", "quantile"):
            for r in even_quantiles(long, 4 if how == "robust" else steps).groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]).alias("q")).collect():
                found[r["column"]] = list(r.q) if how == "quantile" else [r.q[2], (r.q[3] - r.q[1]) or 1.0]
        else:
            form = (F.avg("x"), F.stddev_pop("x")) if how == "standardscale" else (F.min("x"), F.max("x") - F.min("x"))
            found = {r["column"]: [r.m, r.d or 1.0] for r in long.groupBy("column").agg(form[0].alias("m"), form[1].alias("d")).collect()}
        return ScalerModel(how=how, fitted=json.dumps(found, sort_keys=True))


class ScalerModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted scaler: numbers a column, kept with its parameters."""

    fitted = Param(Params._dummy(), "fitted", "numbers of each column, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, how: str = "standardscale", fitted: str = "{}"):
        super().__init__()
        self._setDefault(how="standardscale", fitted="{}")
        self._set(**self._input_kwargs)

    def _transform(self, rows: DataFrame) -> DataFrame:
        how = self.getOrDefault("how")
        form = {"quantile": _share, "powertrans": lambda x, f: (power(x, F.lit(f[0])) - F.lit(f[1])) / F.lit(f[2])}.get(how, lambda x, f: (x - F.lit(f[0])) / F.lit(f[1]))
        return rows.withColumns({c: form(F.col(f"`{c}`").cast("double"), f) for c, f in json.loads(self.getOrDefault("fitted")).items() if c in rows.columns})


def _share(x: Column, cuts: Sequence[float]) -> Column:
    """A value's share in even quantiles: linear between them, ties in the middle, 0 up to the first and 1 from the last."""
    q, n = F.array(*map(F.lit, cuts)), len(cuts) - 1
    upto, under = F.size(F.filter(q, lambda v: v <= x)), F.size(F.filter(q, lambda v: v < x))
    low, high = F.get(q, upto - 1), F.get(q, upto)
    at = F.when(upto > under, (upto + under - 1) / 2).otherwise(upto - 1 + (x - low) / (high - low))
    return F.when(x.isNull() | F.isnan(x), x).when(x <= cuts[0], 0.0).when(x >= cuts[-1], 1.0).otherwise(at / n)


def scaled_training(known: DataFrame, unknown: DataFrame, columns: Sequence[str], path: str | None = None) -> dict[str, tuple[DataFrame, DataFrame]]:
    """{scaler: (labelled rows, rows without a label)} for the five scalers: each fitted on the labelled, saved below path."""
    out = {}
    for how in HOW:
        model = Scaler(how=how, columns=list(columns)).fit(known)
        if path:
            model.write().overwrite().save(f"{path}/scaler_{how}")
        out[how] = (model.transform(known), model.transform(unknown))
    return out
