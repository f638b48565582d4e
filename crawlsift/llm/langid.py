"""Language of texts: averaged embeddings of hashed subwords under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.sample import fold, sample
from crawlsift.llm.words import Rolling, ascii_lower, steps, words

FOLDS, HELD_OUT, UNKNOWN = 3, 1, "und"
BITS, SIZE, LENGTHS = 16, 16, (2, 3, 4)
#: Training texts of a language, and of all languages together; every language has one at least. Texts of one step.
PER_LANGUAGE, ALL_TEXTS, BATCH = 800, 40_000, 16


def subwords(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place in the embedding table) of each byte n-gram inside a word, word ends marked."""
    low = ascii_lower(data)
    w = words(low, offsets, hashed=False)
    rolling, rows, places = Rolling(low), [], []
    length = w.end - w.start
    for n in LENGTHS:
        count = np.maximum(length - n + 1, 0)
        word = np.repeat(np.arange(len(count)), count)
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = w.start[word] + inside
        edge = (inside == 0).astype(np.uint64) + np.uint64(2) * (inside == count[word] - 1).astype(np.uint64)
        h = rolling.of(start, start + n, n) + edge * np.uint64(0x9E3779B97F4A7C15)
        places.append((h >> np.uint64(64 - BITS)).astype(np.int32))
        rows.append(w.row[word])
    whole = rolling.of(w.start, w.end, 99)
    return np.concatenate([*rows, w.row]), np.concatenate([*places, (whole >> np.uint64(64 - BITS)).astype(np.int32)])


@dataclass
class Model:
    """table: each place's share in each language's logit (its embedding times the softmax weights)."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def chances(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        texts = len(offsets) - 1
        row, place = subwords(data, offsets)
        n = np.maximum(np.bincount(row, minlength=texts), 1)
        logits = np.stack([np.bincount(row, self.table[place, k], texts) for k in range(len(self.languages))], axis=1)
        return softmax((logits / n[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(embeddings: np.ndarray, weights: np.ndarray, bias: np.ndarray, bags: list[np.ndarray], y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(loss, places, gradient of those embeddings, of weights, of bias): cross entropy summed over the texts of a batch.

    A text is the mean of its subwords' embeddings; no bag is empty.
    """
    size = np.array([len(b) for b in bags])
    place, of = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
    first = np.cumsum(size) - size
    mean = np.add.reduceat(embeddings[place], first, axis=0) / size[:, None]
    p = softmax(mean @ weights + bias)
    loss = -np.log(p[np.arange(len(y)), y] + 1e-300).sum()
    p[np.arange(len(y)), y] -= 1
    back = (p @ weights.T) / size[:, None]
    places, inverse = np.unique(place, return_inverse=True)
    g = np.stack([np.bincount(inverse, back[of, k], len(places)) for k in range(back.shape[1])], axis=1)
    return loss, places, g, mean.T @ p, p.sum(axis=0)


def train(bags: list[np.ndarray], y: np.ndarray, classes: int, rounds: int = 8, rate: float = 4.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, weights, bias) by stochastic gradient descent on batches of texts, the rate falling to zero."""
    rng = np.random.default_rng(8)
    embeddings = rng.uniform(-1 / SIZE, 1 / SIZE, (1 << BITS, SIZE))
    weights, bias = np.zeros((SIZE, classes)), np.zeros(classes)
    full = np.array([i for i, b in enumerate(bags) if len(b)], np.int64)
    steps_left = total = rounds * max(1, -(-len(full) // BATCH))
    for _ in range(rounds):
        for at in range(0, len(full), BATCH):
            if not at:
                order = rng.permutation(full)
            chosen = order[at : at + BATCH]
            lr = rate * steps_left / total
            steps_left -= 1
            _, places, g, g_weights, g_bias = gradients(embeddings, weights, bias, [bags[i] for i in chosen], y[chosen])
            embeddings[places] -= lr * g
            weights -= lr * 0.1 * g_weights
            bias -= lr * 0.01 * g_bias
    return embeddings, weights, bias


def calibrated(logits: np.ndarray, truth: np.ndarray) -> tuple[float, float]:
    """(temperature of least cross entropy, the chance that 1% of the answers do not reach)."""
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    return temperature, float(np.quantile(softmax(logits / temperature).max(axis=1), 0.01))


def fit(documents: DataFrame) -> Model:
    """Trains on a bounded sample of the documents outside the held-out fold, from text and lang alone.

    Every lang value is learned; an id that occurs repeatedly has its least one. A fifth of the sample sets the
    temperature and the least chance below which an answer counts as rejected: the one that rejects 1% of it. Null ids,
    languages and texts teach nothing; without any labelled text the model knows no language.
    """
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("lang").alias("y"))
    languages = sorted(r.y for r in known.select("y").distinct().collect())  # as many as the model has outputs
    rows = sample(documents, known, languages, max(1, min(PER_LANGUAGE, ALL_TEXTS // max(1, len(languages)))))
    if not rows:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    bags: list[np.ndarray] = []
    for _, _, data, offsets in steps(pa.array([t for t, _ in rows], pa.string())):
        row, place = subwords(data, offsets)
        place, row = place[np.argsort(row, kind="stable")], np.sort(row)
        bags += np.split(place, np.searchsorted(row, np.arange(1, len(offsets) - 1)))
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for _, v in rows])
    test = np.arange(len(rows)) % 5 == 4
    # pieces of texts of varying length, so that short texts are learned too
    rng = np.random.default_rng(9)
    pieces, of = [], []
    for i in np.flatnonzero(~test):
        n = len(bags[i])
        for size in (min(n, 2000), min(n, 300), min(n, 40)):
            at = rng.integers(0, n - size + 1)
            pieces.append(bags[i][at : at + size])
            of.append(y[i])
    embeddings, weights, bias = train(pieces, np.array(of), len(languages))
    model = Model(languages, (embeddings @ weights).astype(np.float32), bias)
    held = [i for i in np.flatnonzero(test) if len(bags[i])]
    if held:
        logits = np.array([model.table[bags[i]].mean(axis=0) + bias for i in held])
        model.temperature, model.reject_below = calibrated(logits, y[held])
    return model


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each whole text.

    A text that is null or has no letter is `und` with score 0; any other gets the likeliest learned language, also
    where the answer is rejected (its chance is below the calibrated bound). No language learned: all are `und`. Each
    row of documents gives one, repeated rows and rows without a doc_id as well; no rows give none.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in steps(batch.column(1)):
                some = letters[a:b] if m.languages else np.zeros(b - a, bool)
                p = m.chances(data, offsets) if m.languages else np.zeros((b - a, 1))
                best = np.where(some, p.argmax(axis=1), len(m.languages))
                score = np.where(some, p.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), pa.array(score < m.reject_below)], ["doc_id", "lang_pred", "score", "rejected"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letter.alias("letter")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def op8_language(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(documents, fit(documents)).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_OUT)
