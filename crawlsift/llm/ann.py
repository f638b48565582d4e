"""Nearest neighbours by a block matrix join of int8 tiles."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.storage import saved
from crawlsift.llm.vectors import Shards, by_dimension, clean, met, placed, sharded

RESULT = "query_id long, vec_id long, score double"
#: Relative room for the rounding of the bounds themselves.
SLACK = 1e-9


def int8_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows as scale * int8: (int8 matrix, scale a row, length of the error a row, squared length of the int8 row)."""
    scale = np.maximum(np.abs(m).max(axis=1), np.finfo(np.float64).tiny) / 127
    codes = np.clip(np.rint(m / scale[:, None]), -127, 127).astype(np.int8)
    wide = codes.astype(np.float64)
    return codes, scale, np.sqrt(((m - wide * scale[:, None]) ** 2).sum(axis=1)), (wide**2).sum(axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, summed component by component in order."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        d = a[:, i] - b[:, i]
        total += d * d
    return np.sqrt(total)


def _tiles(k: int, tile_rows: int):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        ids, qids = points.column("id").to_numpy(), queries.column("id").to_numpy()
        cells = by_dimension(points)
        for d, (rows, wanted) in by_dimension(queries).items():
            if d not in cells:
                continue
            mine, matrix = cells[d]
            q, q_scale, q_error, q_square = int8_rows(wanted)
            best: list[list[tuple[float, int]]] = [[] for _ in rows]  # heaps of (-distance, -id)
            own = qids[rows]
            for at in range(0, len(mine), tile_rows):
                part, part_ids = matrix[at : at + tile_rows], ids[mine[at : at + tile_rows]]
                c, c_scale, c_error, c_square = int8_rows(part)
                # 127 * 127 * d stays under 2^24 up to 1040 dimensions: float32 then holds the int8 products exactly
                kind = np.float32 if d <= 1040 else np.float64
                product = (q.astype(kind) @ c.astype(kind).T).astype(np.float64)
                square = (q_scale**2 * q_square)[:, None] + (c_scale**2 * c_square)[None, :] - 2 * np.outer(q_scale, c_scale) * product
                # the square is off by (d + 8) roundings of (|q| + |c|)^2 at most, its root by the root of that
                sizes = np.sqrt(q_scale**2 * q_square)[:, None] + np.sqrt(c_scale**2 * c_square)[None, :]
                about, room = np.sqrt(np.maximum(square, 0)), q_error[:, None] + c_error[None, :] + (SLACK + np.sqrt((d + 8) * np.finfo(float).eps)) * sizes
                # components so large that squares overflow leave a bound undefined: such a pair is computed
                low, high = about - room - SLACK * about, np.nan_to_num(about + room + SLACK * about, nan=np.inf, posinf=np.inf)
                same = own[:, None] == part_ids[None, :]
                high[same] = np.inf
                limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(rows), np.inf)
                limit = np.minimum(limit, [-b[0][0] if len(b) == k else np.inf for b in best])
                i, j = np.nonzero(~(low > limit[:, None]) & ~same)
                exact = distances(wanted[i], part[j])
                order = np.lexsort((part_ids[j], exact, i))
                starts = np.searchsorted(i[order], np.arange(len(rows) + 1))
                for r in range(len(rows)):
                    for x in order[starts[r] : starts[r + 1]][:k]:
                        pair = (-float(exact[x]), -int(part_ids[j[x]]))
                        if len(best[r]) < k:
                            heapq.heappush(best[r], pair)
                        elif pair > best[r][0]:
                            heapq.heapreplace(best[r], pair)
                        else:
                            break
            out += [(int(own[r]), -neg, -dist) for r in range(len(rows)) for dist, neg in best[r]]
        return pa.table({"query_id": pa.array([x[0] for x in out], pa.int64()), "vec_id": pa.array([x[1] for x in out], pa.int64()), "score": pa.array([x[2] for x in out], pa.float64())})

    return search


ASKED = "id long, v array<double>, kth double, shard long"


def _asking(shards: Shards) -> Callable:
    shared = shards.points.sparkSession.sparkContext.broadcast((shards.number, shards.low, shards.high, shards.centre, shards.radius))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard that may hold a point as near as the query's kth one so far: by the shard's box,
        and by its centre and radius."""
        number, low, high, centre, radius = shared.value
        for batch in batches:
            home, kth = batch.column(3).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            at, to = [], []
            for d, (rows, m) in by_dimension(pa.Table.from_batches([batch])).items():
                if d not in number:
                    continue
                size = np.sqrt((m**2).sum(axis=1))
                for i, r in enumerate(rows):
                    box = np.sqrt((np.maximum(np.maximum(low[d] - m[i], m[i] - high[d]), 0) ** 2).sum(axis=1))
                    ball = np.sqrt(((centre[d] - m[i]) ** 2).sum(axis=1)) - radius[d]
                    room = SLACK * (1 + size[i] + kth[r] if np.isfinite(kth[r]) else 1)
                    some = ~(np.maximum(box, ball) - SLACK * (box + radius[d]) - room > kth[r]) if np.isfinite(kth[r]) else np.ones(len(number[d]), bool)
                    names = number[d][some & (number[d] != home[r])]
                    at += [int(r)] * len(names)
                    to += names.tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:3], pa.array(to, pa.int64())], [x.split()[0] for x in ASKED.split(", ")])

    return ask


def nearest(points: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = 2048, block_rows: int = 1024, tile_rows: int = 512) -> DataFrame:
    """The k points of smallest Euclidean distance for each query, ties to the smaller id.

    points, queries: (id long, v array<double>). Returns query_id, rank, vec_id, score (the distance). A query's own
    shard gives its kth distance, and with it the shards that it asks. int8 tiles give each pair's distance within a
    proven error; only pairs whose lower bound reaches the k-th smallest upper bound are computed in double precision,
    so nothing that belongs in the result is lost. Fewer than k points: all are returned; no points or queries: no rows.
    Vectors of different lengths are not compared.
    """
    shards = sharded(points, shard_rows, "ann-shards")
    home = saved(placed(queries, shards.splits), "ann-queries")
    p, q = met(shards.points, home, block_rows)
    first = saved(p.cogroup(q).applyInArrow(_tiles(k, tile_rows), RESULT), "ann-home")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("kth")).where(F.col("n") == k)
    known = home.join(kth.select(F.col("query_id").alias("id"), "kth"), "id", "left").select("id", "v", F.coalesce("kth", F.lit(float("inf"))).alias("kth"), "shard")
    away = saved(known.mapInArrow(_asking(shards), ASKED), "ann-away")
    p, q = met(shards.points, away, block_rows)
    found = first.unionByName(p.cogroup(q).applyInArrow(_tiles(k, tile_rows), RESULT))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_approximate_neighbours(spark, sf_dir: str) -> DataFrame:
    """Rows with a null id or vector, a zero one, or one with null or non-finite components take no part; of rows that
    repeat an id, the smallest vector does. Ties go to the smaller id; an empty table gives no rows."""
    points = clean(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    points = saved(points.where(F.exists("v", lambda x: x != 0)), "ann-points")  # zero vectors take no part
    return nearest(points, points.where(F.col("id") % 100 == 0))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
    sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda t, x: t + x)) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
