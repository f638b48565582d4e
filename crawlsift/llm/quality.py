"""Quality scores by a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.sample import binary_labels, fold
from crawlsift.llm.storage import saved
from crawlsift.llm.words import ascii_lower, steps, words

FOLDS, HELD_OUT, CUT = 5, 0, 0.3
NAMES = ("words", "word_length", "word_length_spread", "capitals", "digits", "stops", "symbols", "spaces", "wide", "lines", "distinct_words", "distinct_pairs", "repeats")
LIMIT = 500.0


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = 1
    kind[[*b"0123456789"]] = 2
    kind[[*b".,;:?'\"()-"]] = 3
    kind[[*b"!#$%&*+/<=>@[\\]^_`{|}~"]] = 4
    kind[[*b" \t\r\x0b\x0c"]] = 5
    kind[128:] = 6
    kind[10] = 7
    return kind


_KIND = _kinds()


def _logit(part: np.ndarray, whole: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of a share, drawn to its prior where there is little to count."""
    p = (part + 5 * prior) / (whole + 5)
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _distinct(row: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.bincount(row[new], minlength=texts).astype(np.float64)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics a text; an empty text has those of nothing seen."""
    texts = len(offsets) - 1
    kind, length = _KIND[data], np.diff(offsets).astype(np.float64)
    capitals, digits, stops, symbols, spaces, wide, lines = (_per_text(kind == k, offsets) for k in range(1, 8))
    w = words(ascii_lower(data), offsets)
    size = (w.end - w.start).astype(np.float64)
    n = np.bincount(w.row, minlength=texts).astype(np.float64)
    mean = (np.bincount(w.row, size, texts) + 5 * 5) / (n + 5)
    spread = np.sqrt((np.bincount(w.row, (size - mean[w.row]) ** 2, texts) + 5 * 6) / (n + 5))
    same = np.zeros(len(w.row), bool)
    same[1:] = (w.row[1:] == w.row[:-1]) & (w.hash[1:] == w.hash[:-1])
    repeats = np.bincount(w.row, same, texts)
    pair = w.hash[:-1] * np.uint64(3) + w.hash[1:] if len(w.row) else w.hash
    inside = w.row[:-1] == w.row[1:] if len(w.row) else np.zeros(0, bool)
    distinct, pairs = _distinct(w.row, w.hash, texts), _distinct(w.row[:-1][inside], pair[inside], texts)
    return np.stack([
        np.log1p(n), np.log(mean), np.log(spread),
        _logit(capitals, length, 0.02), _logit(digits, length, 0.001), _logit(stops, length, 0.02), _logit(symbols, length, 0.0005),
        _logit(spaces, length, 0.15), _logit(wide, length, 0.02), _logit(lines, length, 0.004),
        (np.log(distinct + 5) - np.log(n + 5)), (np.log(pairs + 5) - np.log(np.maximum(n - 1, 0) + 5)), _logit(repeats, n, 0.01),
    ], axis=1)


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """factor^-1 b of a lower triangular factor, row by row for all columns of b at once."""
    z = np.empty_like(b)
    for i in range(len(factor)):
        z[i] = (b[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class QDA:
    """Of each class 0, 1: mean, Cholesky factor of the shrunk covariance, log-determinant and log-share."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of class 1: log-densities by Mahalanobis distances through the factors, as a difference."""
        density = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            z = forward(factor, (x - mean).T)
            density.append(constant - 0.5 * (z**2).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -LIMIT, LIMIT)))


def discriminant(count: np.ndarray, total: np.ndarray, square: np.ndarray, shrink: float = 0.05, ridge: float = 1e-3) -> QDA:
    """From each class's number of rows, sums and sums of products.

    A class's covariance is drawn to the pooled one as to `shrink`, more where the class has few rows for its
    dimensions; a ridge on the scale of the pooled variances keeps it invertible. A class without rows stands at
    the pooled mean and covariance.
    """
    d = total.shape[1]
    n = count.sum()
    mean = total.sum(axis=0) / max(n, 1)
    pooled = square.sum(axis=0) / max(n, 1) - np.outer(mean, mean) + 1e-9 * np.eye(d)
    scale = np.diag(np.diag(pooled)) + 1e-9 * np.eye(d)
    means, factors, constants = [], [], []
    for c in range(2):
        m = total[c] / count[c] if count[c] else mean
        own = square[c] / count[c] - np.outer(m, m) if count[c] else pooled
        part = min(1.0, shrink + d / (count[c] + d))
        covariance = (1 - part) * own + part * pooled + ridge * scale
        factor = np.linalg.cholesky((covariance + covariance.T) / 2)
        means.append(m)
        factors.append(factor)
        constants.append(-np.log(np.diag(factor)).sum() + math.log((count[c] + 1) / (n + 2)))
    return QDA(np.array(means), np.array(factors), np.array(constants))


def measured(documents: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row's whole text, a null one as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in steps(batch.column(1)):
                x = statistics(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(np.arange(b - a + 1, dtype=np.int32) * x.shape[1], x.ravel())], ["doc_id", "x"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fit(rows: DataFrame, labels: DataFrame) -> QDA:
    """From all labelled rows outside the held-out fold: sums and products, added up by Spark."""
    known = binary_labels(labels, "quality", FOLDS, HELD_OUT)
    both = rows.join(known, "doc_id").select("y", F.concat(F.array(F.lit(1.0)), "x").alias("x"))
    products = both.select("y", F.posexplode(F.flatten(F.transform("x", lambda a: F.transform(F.col("x"), lambda b: a * b)))).alias("i", "v"))
    size = len(NAMES) + 1
    sums = np.zeros((2, size * size))
    for r in products.groupBy("y", "i").agg(F.sum("v").alias("v")).collect():  # 2 * size^2 numbers
        sums[int(r.y > 0), r.i] = r.v
    sums = sums.reshape(2, size, size)
    return discriminant(sums[:, 0, 0], sums[:, 0, 1:], sums[:, 1:, 1:])


def scored(rows: DataFrame, model: QDA, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted from measured rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = shared.value.score(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """One row a row of documents. Repeated labels of an id count once, as the largest; a null doc_id is not held out."""
    rows = saved(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-rows")
    model = fit(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(rows, model).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
