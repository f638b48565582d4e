"""Both vector searches against comparing each query with every row."""

import math
import random

import numpy as np

from pyspark.sql import functions as F

from crawlsift.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<float>, v string, id string"


def table(spark, seed, n=400, d=7):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(d)]) for i in range(n)]
    rows += [(i, rows[3][1]) for i in range(n, n + 150)]  # many equal vectors
    rows += [(9001, None), (9002, [1.0, None] + [0.0] * (d - 2)), (9003, [float("nan")] * d), (9004, [float("inf")] * d), (9005, [0.0] * d), (9006, [1.0, 2.0]), (9010, [2.0, 1.0]), (None, [1.0] * d), (7, rows[7][1])]
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)


def points_of(frame):
    return {r.id: list(r.v) for r in frame.collect()}


def test_top_k(spark):
    points = topk.quantised(table(spark, 1))
    got = topk.top_k(points, points.where(F.col("id") % 50 == 0), k=5, shard_rows=60, block_rows=4)
    p = points_of(points)
    want = []
    for q in sorted(x for x in p if x % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(p[q], p[c])), c) for c in p if c != q and len(p[c]) == len(p[q]))[:5]
        want += [(q, i + 1, c, int(-s)) for i, (s, c) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == want


def test_large_components_stay_exact(spark):
    frame = spark.createDataFrame([(0, [1e7, 1.0]), (50, [1e7, -1.0]), (1, [3.0, 1e7])], "vec_id long, embedding array<double>")
    points = topk.quantised(frame)
    got = {(r.query_id, r.vec_id): r.score for r in topk.top_k(points, points.where("id % 50 = 0")).collect()}
    assert got[0, 50] == 2560000000**2 - 256 * 256 and got[0, 1] == 2560000000 * 768 + 256 * 2560000000


def test_nearest(spark):
    points = vectors.clean(table(spark, 2), "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    got = ann.nearest(points, points.where(F.col("id") % 20 == 0), k=10, shard_rows=90, block_rows=8, tile_rows=16)
    p = points_of(points)
    want = []
    for q in sorted(x for x in p if x % 20 == 0):
        best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(p[q], p[c]))), c) for c in p if c != q and len(p[c]) == len(p[q]))[:10]
        want += [(q, i + 1, c) for i, (_, c) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got.collect()) == want
    assert 9005 not in p


def test_empty(spark):
    points = vectors.clean(spark.createDataFrame([], SCHEMA), "vec_id", "embedding")
    assert topk.top_k(points, points).count() == 0 and ann.nearest(points, points).count() == 0


def test_components_whose_squares_overflow(spark):
    rows = [(i, [x, 1.0]) for i, x in enumerate([1e200, -1e200, 1e200, 3e200, 1.0, 2.0, 5e-200, 1e308])]
    points = spark.createDataFrame(rows, "id long, v array<double>")
    got = [tuple(r) for r in ann.nearest(points, points, k=3, shard_rows=2, tile_rows=2).orderBy("query_id", "rank").collect()]
    want = []
    for q, v in rows:
        with np.errstate(over="ignore"):
            near = sorted((float(np.sqrt(np.sum((np.array(v) - np.array(u)) ** 2))), i) for i, u in rows if i != q)[:3]
        want += [(q, k + 1, i, d) for k, (d, i) in enumerate(near)]
    assert got == want
