"""Vectors as the two search operators see them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.storage import saved
from crawlsift.llm.words import mix


def usable(v: Column) -> Column:
    """True for vectors without null, NaN or infinite components; null vectors give false."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & ok, F.lit(False))


def clean(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, v array<double>), one row an id. Rows without an id or with an unusable vector take no part.

    An id that occurs more than once stands for one vector, the smallest in array order.
    """
    v = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


#: Shards of a table at most, so that their bounds can be broadcast: 4096 boxes. Beyond 4096 * shard_rows points the
#: shards grow instead. Values of the sample that the splits are fitted to.
MAX_SHARDS, SAMPLE_VALUES = 4096, 1 << 22


@dataclass
class Splits:
    """Median splits of a sample of vectors of one dimension into leaves, and each leaf's mean in the sample."""

    axis: np.ndarray
    value: np.ndarray
    child: np.ndarray
    centre: np.ndarray

    def leaf(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The leaf of each point; where no axis told the sample apart, a hash of the id decides."""
        at = np.zeros(len(points), np.int64)
        chance = (mix(ids.astype(np.int64).view(np.uint64), 7) >> np.uint64(11)).astype(np.float64) / 2.0**53
        live = np.flatnonzero(self.axis[at] > -2)
        while len(live):
            node = at[live]
            axis = self.axis[node]
            x = np.where(axis >= 0, points[live, np.maximum(axis, 0)], chance[live])
            at[live] = self.child[node, (x > self.value[node]).astype(int)]
            live = live[self.axis[at[live]] > -2]
        return self.child[at, 0]


def fitted(points: np.ndarray, ids: np.ndarray, leaves: int) -> Splits:
    axis, value, child, centres = [], [], [], []

    def grow(rows: np.ndarray, wanted: int) -> int:
        k = len(axis)
        axis.append(-2)
        value.append(0.0)
        child.append([len(centres), -1])
        box = points[rows]
        if wanted < 2 or len(rows) < 2:
            centres.append(box.mean(axis=0) if len(rows) else np.zeros(points.shape[1]))
            return k
        spread = box.max(axis=0) - box.min(axis=0)
        a = int(spread.argmax()) if spread.size and spread.max() > 0 else -1
        x = box[:, a] if a >= 0 else (mix(ids[rows].astype(np.int64).view(np.uint64), 7) >> np.uint64(11)).astype(np.float64) / 2.0**53
        cut = float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2])
        if (x > cut).sum() == 0:  # the median is the largest value: cut below it
            cut = float(x[x < cut].max())
        axis[k], value[k] = a, cut
        child[k] = [grow(rows[x <= cut], wanted // 2), grow(rows[x > cut], wanted - wanted // 2)]
        return k

    grow(np.arange(len(points)), leaves)
    return Splits(np.array(axis), np.array(value), np.array(child), np.array(centres))


@dataclass
class Shards:
    """The points by shard, and of each dimension: number of each shard, bounding box, radius about its centre, least id."""

    points: DataFrame
    splits: dict[int, tuple[int, Splits]]
    number: dict[int, np.ndarray]
    low: dict[int, np.ndarray]
    high: dict[int, np.ndarray]
    centre: dict[int, np.ndarray]
    radius: dict[int, np.ndarray]
    least: dict[int, np.ndarray]


def placed(points: DataFrame, splits: dict[int, tuple[int, Splits]]) -> DataFrame:
    """(id, v, shard): the shard of each vector; a dimension that the sample lacks has shard -dimension - 1."""
    shared = points.sparkSession.sparkContext.broadcast(splits)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            shard, ids = np.zeros(batch.num_rows, np.int64), batch.column(0).to_numpy()
            for d, (rows, matrix) in by_dimension(table).items():
                base, s = shared.value.get(d, (0, None))
                shard[rows] = base + s.leaf(matrix, ids[rows]) if s is not None else -d - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shard)], ["id", "v", "shard"])

    return points.select("id", "v").mapInArrow(place, "id long, v array<double>, shard long")


def sharded(points: DataFrame, shard_rows: int, name: str) -> Shards:
    """Deals points to shards of about shard_rows, near ones to the same shard, by splits fitted to a bounded sample.

    Every point is dealt. Of the shards only their bounds reach the driver, MAX_SHARDS boxes at most.
    """
    dims = {r.d: r["count"] for r in points.groupBy(F.size("v").alias("d")).count().collect()}
    n, spark = sum(dims.values()), points.sparkSession
    widest = max(dims, default=1)
    taken = points.orderBy(F.xxhash64("id"), "id").limit(max(256, SAMPLE_VALUES // max(1, widest))).toArrow()
    splits, base = {}, 0
    total = min(MAX_SHARDS, max(1, math.ceil(n / shard_rows)))
    for d, (rows, matrix) in by_dimension(taken).items():
        leaves = max(1, round(total * dims[d] / n))
        s = fitted(matrix, taken.column("id").to_numpy()[rows], leaves)
        splits[d] = (base, s)
        base += len(s.centre)
    table = saved(placed(points, splits), name)
    centres = spark.sparkContext.broadcast({base + i: c for _, (base, s) in splits.items() for i, c in enumerate(s.centre)})

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            shard, ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            for _, (rows, m) in by_dimension(pa.Table.from_batches([batch])).items():
                order = np.argsort(shard[rows], kind="stable")
                names, first = np.unique(shard[rows][order], return_index=True)
                for s, i, j in zip(names.tolist(), first, np.append(first[1:], len(order)), strict=True):
                    part, at = m[order[i:j]], rows[order[i:j]]
                    centre = centres.value.get(s, np.zeros(part.shape[1]))
                    mine = [part.min(axis=0), part.max(axis=0), float(np.sqrt(((part - centre) ** 2).sum(axis=1)).max()), int(ids[at].min())]
                    if s in seen:
                        o = seen[s]
                        mine = [np.minimum(o[0], mine[0]), np.maximum(o[1], mine[1]), max(o[2], mine[2]), min(o[3], mine[3])]
                    seen[s] = mine
        if seen:
            yield pa.RecordBatch.from_pydict({"shard": pa.array(list(seen), pa.int64()), "low": [x[0] for x in seen.values()], "high": [x[1] for x in seen.values()], "radius": [x[2] for x in seen.values()], "least": pa.array([x[3] for x in seen.values()], pa.int64())})

    parts = table.mapInArrow(bounds, "shard long, low array<double>, high array<double>, radius double, least long")
    each = parts.select("shard", F.size("low").alias("d"), "radius", "least", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b"))
    boxes = each.groupBy("shard", "d", "i").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"), F.max("radius").alias("radius"), F.min("least").alias("least"))
    whole = boxes.groupBy("shard", "d").agg(F.array_sort(F.collect_list(F.struct("i", "low", "high"))).alias("b"), F.max("radius").alias("radius"), F.min("least").alias("least")).collect()
    out = Shards(table, splits, {}, {}, {}, {}, {}, {})
    empty = {r.shard: r for r in parts.where(F.size("low") == 0).groupBy("shard").agg(F.min("least").alias("least")).collect()} if 0 in dims else {}
    for d in dims:
        rows = sorted((r for r in whole if r.d == d), key=lambda r: r.shard)
        if d == 0:
            out.number[0], out.least[0] = np.array(sorted(empty)), np.array([empty[s].least for s in sorted(empty)])
            out.low[0] = out.high[0] = out.centre[0] = np.zeros((len(empty), 0))
            out.radius[0] = np.zeros(len(empty))
            continue
        out.number[d] = np.array([r.shard for r in rows])
        out.low[d], out.high[d] = (np.array([[x[k] for x in r.b] for r in rows]).reshape(len(rows), d) for k in ("low", "high"))
        out.centre[d] = np.array([centres.value.get(r.shard, np.zeros(d)) for r in rows]).reshape(len(rows), d)
        out.radius[d], out.least[d] = np.array([r.radius for r in rows]), np.array([r.least for r in rows])
    return out


def met(points: DataFrame, asked: DataFrame, block_rows: int) -> tuple:
    """Points and queries grouped by shard and block: a shard that very many queries ask goes to several tasks.

    asked: (id, v, shard, ...). Only shards that a query asks move, once for each block of their queries.
    """
    blocks = asked.groupBy("shard").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    p = points.join(blocks, "shard").select("id", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    q = asked.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")).drop("blocks")
    return p.groupBy("shard", "block"), q.groupBy("shard", "block")


def by_dimension(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{dimension: (row numbers, matrix of doubles)}; vectors of different lengths are never compared."""
    if not table.num_rows:
        return {}
    v = table.column("v").combine_chunks()
    lengths = np.diff(v.offsets.to_numpy())
    values, starts = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()[:-1]
    return {int(d): (rows, values[starts[rows][:, None] + np.arange(d)]) for d in np.unique(lengths) for rows in [np.flatnonzero(lengths == d)]}
