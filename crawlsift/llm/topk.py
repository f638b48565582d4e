"""Exact top-k search by inner product with a KD-tree per shard."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlsift.llm.storage import saved
from crawlsift.llm.vectors import Shards, by_dimension, clean, met, placed, sharded

RESULT = "query_id long, vec_id long, score long"


class KDTree:
    """Median splits of the widest dimension; each node keeps its points' tight bounding box and smallest id."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        nodes: list[tuple[int, int, int, int]] = []
        lows, highs, least = [], [], []

        def grow(rows: np.ndarray, at: int) -> int:
            box = points[rows]
            lo, hi = box.min(axis=0), box.max(axis=0)
            k = len(nodes)
            nodes.append((at, at + len(rows), -1, -1))
            lows.append(lo)
            highs.append(hi)
            least.append(int(ids[rows].min()))
            spread = hi - lo
            if len(rows) > leaf and spread.size and spread.max() > 0:
                axis, half = int(spread.argmax()), len(rows) // 2
                parts = np.argpartition(box[:, axis], half)
                left = grow(rows[np.sort(parts[:half])], at)
                right = grow(rows[np.sort(parts[half:])], at + half)
                nodes[k] = (at, at + len(rows), left, right)
            else:
                leaves.append(rows)
            return k

        leaves: list[np.ndarray] = []
        grow(order, 0)
        order = np.concatenate(leaves)
        self.points, self.ids, self.nodes = points[order], ids[order], nodes
        self.low, self.high, self.least = np.array(lows), np.array(highs), least

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Of each query and node: the largest inner product that a point in the node's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, kth: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, -id), without id `own`, best-first; kth is a pair that k points elsewhere reach already."""
        best: list[tuple[int, int]] = []
        floor = kth
        todo = [(-int(bounds[0]), self.least[0], 0)]
        while todo:
            bound, least, at = heapq.heappop(todo)
            if floor is not None and (-bound, -least) <= floor:
                if -bound < floor[0]:
                    break
                continue
            start, end, left, right = self.nodes[at]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(todo, (-int(bounds[child]), self.least[child], child))
                continue
            scores = self.points[start:end] @ query
            ids = self.ids[start:end]
            near = np.flatnonzero((scores >= floor[0]) & (ids != own)) if floor is not None else np.flatnonzero(ids != own)
            if len(near) > k:
                near = near[np.lexsort((ids[near], -scores[near]))[:k]]
            for i in near:
                pair = (int(scores[i]), -int(ids[i]))
                if len(best) < k:
                    heapq.heappush(best, pair)
                elif pair > best[0]:
                    heapq.heapreplace(best, pair)
            if len(best) == k and (floor is None or best[0] > floor):
                floor = best[0]
        return best


def _searcher(k: int, home_only: bool):
    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        cells = by_dimension(points)
        ids, qids = points.column("id").to_numpy(), queries.column("id").to_numpy()
        floors = None if home_only else list(zip(queries.column("kth_score").to_pylist(), queries.column("kth_id").to_pylist(), strict=True))
        for d, (rows, wanted) in by_dimension(queries).items():
            if d not in cells:
                continue
            mine, matrix = cells[d]
            # products and sums beyond 2^53 are not exact in doubles
            if d and d * float(np.abs(wanted).max()) * float(np.abs(matrix).max()) >= 2.0**53:
                wanted, matrix = wanted.astype(np.int64), matrix.astype(np.int64)
            tree = KDTree(matrix, ids[mine])
            bounds = tree.bounds(wanted)
            for i, row in enumerate(rows):
                kth = None if floors is None or floors[row][0] is None else (floors[row][0], -floors[row][1])
                out += [(int(qids[row]), -neg, score) for score, neg in tree.search(wanted[i], int(qids[row]), bounds[i], k, kth)]
        a = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({"query_id": a[:, 0], "vec_id": a[:, 1], "score": a[:, 2]})

    return search


ASKED = "id long, v array<double>, kth_score long, kth_id long, shard long"


def _asking(shards: Shards) -> Callable:
    shared = shards.points.sparkSession.sparkContext.broadcast((shards.number, shards.low, shards.high, shards.least))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard whose box can hold a pair better than the query's kth one so far."""
        number, low, high, least = shared.value
        for batch in batches:
            home, score, kth = (batch.column(i).to_pylist() for i in (4, 2, 3))
            at, to = [], []
            for d, (rows, m) in by_dimension(pa.Table.from_batches([batch])).items():
                if d not in number:
                    continue
                bound = np.maximum(m, 0) @ high[d].T + np.minimum(m, 0) @ low[d].T
                # sums of products beyond 2^53 are rounded
                room = 1e-12 * (np.abs(m) @ np.maximum(np.abs(high[d]), np.abs(low[d])).T)
                for i, r in enumerate(rows):
                    some = np.ones(len(number[d]), bool) if score[r] is None else (bound[i] + room[i] > score[r]) | ((bound[i] + room[i] >= score[r]) & (least[d] < kth[r]))
                    names = number[d][some & (number[d] != home[r])]
                    at += [r] * len(names)
                    to += names.tolist()
            taken = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns[:4], pa.array(to, pa.int64())], [x.split()[0] for x in ASKED.split(", ")])

    return ask


def top_k(points: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 2048, block_rows: int = 4096) -> DataFrame:
    """The k points of largest inner product for each query, ties to the smaller id.

    points, queries: (id long, v array<double>) with integral components. Returns query_id, rank, vec_id, score. A query
    first searches the shard that it falls in itself; the kth pair found there decides which other shards its box bound
    lets it ask at all, and goes with it to close most of their trees at once. Equal vectors are told apart by id, so
    very many of them are many shards. Fewer than k points: all are returned. No points or queries: no rows. Repeated
    ids are for the caller to settle (clean does); vectors of different lengths are not compared.
    """
    shards = sharded(points, shard_rows, "topk-shards")
    home = saved(placed(queries, shards.splits), "topk-queries")
    p, q = met(shards.points, home, block_rows)
    first = saved(p.cogroup(q).applyInArrow(_searcher(k, True), RESULT), "topk-home")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("neg"))).alias("kth"))
    kth = kth.where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("kth.score").alias("kth_score"), (-F.col("kth.neg")).alias("kth_id"))
    known = home.join(kth, "id", "left").select("id", "v", "kth_score", "kth_id", "shard")
    away = saved(known.mapInArrow(_asking(shards), ASKED), "topk-away")
    p, q = met(shards.points, away, block_rows)
    rest = p.cogroup(q).applyInArrow(_searcher(k, False), RESULT)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v) with each component x turned into floor(scale * x), x as double."""
    return clean(embeddings, id_col, vec_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    """Rows with a null id or vector, or one with null or non-finite components, take no part; of rows that repeat an id,
    the smallest vector does. Ties go to the smaller id; an empty table gives no rows."""
    points = saved(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "topk-points")
    return top_k(points, points.where(F.col("id") % 50 == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
