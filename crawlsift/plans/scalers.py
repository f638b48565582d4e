"""Scalers as queries: fitted on labelled rows, applied to all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.operators import scaling

COLUMNS = ["l_extendedprice", "l_quantity", "l_tax"]
STEPS = 100


def scale_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantile shares of line items, fitted on those with a label (of two return flags), with a flag that stays as it is."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", "l_returnflag", *(F.col(c).cast("double").alias(c) for c in COLUMNS), (F.col("l_linenumber") > 3).cast("double").alias("var_1_dom_as_path"))
    model = scaling.Scaler(how="quantile", columns=[*COLUMNS, "var_1_dom_as_path"], steps=STEPS).fit(rows.where("l_returnflag <> 'N'"))
    out = model.transform(rows)
    shown = [F.round(f(c), 6).alias(f"{n}_{c}") for c in (*COLUMNS, "var_1_dom_as_path") for n, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
    return out.groupBy("l_linenumber", "l_returnflag").agg(*shown)


def _knots(c: str) -> str:
    """The even quantiles of a column as a list."""
    return f"""(SELECT list_transform(range({STEPS + 1}), lambda i: v[i * (len(v) - 1) // {STEPS} + 1] + (v[(i * (len(v) - 1) + {STEPS - 1}) // {STEPS} + 1] - v[i * (len(v) - 1) // {STEPS} + 1]) * (i * (len(v) - 1) % {STEPS} / {STEPS}))
      FROM (SELECT list(CAST({c} AS DOUBLE) ORDER BY {c}) AS v FROM lineitem WHERE l_returnflag <> 'N')) AS q_{c}"""


def _place(c: str) -> str:
    """A distinct value's share in the quantiles."""
    upto, under = f"len(list_filter(q_{c}, lambda v: v <= x))", f"len(list_filter(q_{c}, lambda v: v < x))"
    return f"""s_{c} AS (SELECT x, CASE WHEN x <= q_{c}[1] THEN 0 WHEN x >= q_{c}[-1] THEN 1 WHEN {upto} > {under} THEN ({upto} + {under} - 1) / 2 / {STEPS}
      ELSE ({upto} - 1 + (x - q_{c}[{upto}]) / (q_{c}[{upto} + 1] - q_{c}[{upto}])) / {STEPS} END AS s FROM (SELECT DISTINCT CAST({c} AS DOUBLE) AS x FROM lineitem), k)"""


_SHOWN = ", ".join(f"round({f}(s_{c}.s), 6) AS {f}_{c}" for c in COLUMNS for f in ("avg", "max", "min"))
QUANTILE_SQL = f"""WITH k AS (SELECT {", ".join(map(_knots, COLUMNS))}), {", ".join(map(_place, COLUMNS))}
SELECT l_linenumber, l_returnflag, {_SHOWN}, {", ".join(f"CAST(l_linenumber > 3 AS DOUBLE) AS {f}_var_1_dom_as_path" for f in ("avg", "max", "min"))}
FROM lineitem {" ".join(f"JOIN s_{c} ON s_{c}.x = CAST({c} AS DOUBLE)" for c in COLUMNS)} GROUP BY l_linenumber, l_returnflag"""

QUERIES = {"scale_quantile": scale_quantile}
ORACLES = {"scale_quantile": QUANTILE_SQL}
