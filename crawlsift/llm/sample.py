"""Bounded samples of labelled texts, for models that are trained on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: rows of each class, and characters of a text (of a longer one, a piece of that length).
PER_CLASS, TEXT_CHARS = 1000, 8_000


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id is fold -1."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(-1))


def binary_labels(labels: DataFrame, column: str, folds: int, held_out: int) -> DataFrame:
    """(doc_id, y) of the labelled documents outside the held-out fold; repeated labels of one id: the largest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    return known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def class_counts(labels: DataFrame) -> dict:
    """Rows of each class, over the whole table."""
    return {r.y: r["count"] for r in labels.groupBy("y").count().collect()}


def sample(documents: DataFrame, labels: DataFrame, classes: list, per_class: int | dict = PER_CLASS, chars: int = TEXT_CHARS) -> list[tuple[str, object]]:
    """(text, y) of up to per_class labelled documents a class, the same ones at each run.

    labels: (doc_id, y), one row a doc_id. per_class: one bound, or one for each class. Only documents with a text are
    chosen from, by a hash of their id; a repeated doc_id stands for its text of least hash. Of a text longer than
    `chars`, a piece at a place that its hash gives is taken. At most per_class ids a class are broadcast, and as many
    pieces of text reach the driver.
    """
    some = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    usable = labels.join(some.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for y in classes:
        part = usable.where(F.col("y") == F.lit(y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y] if isinstance(per_class, dict) else per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    start = (F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - chars + 1)) + 1).cast("int")
    texts = some.select("doc_id", F.xxhash64("text").alias("h"), F.substring("text", start, F.lit(chars)).alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id", "y")), "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.struct("h", "text")).alias("r"))
    found = rows.select("doc_id", "r.text", "r.y").toArrow()
    found = zip(found.column("doc_id").to_pylist(), found.column("text").to_pylist(), found.column("y").to_pylist(), strict=True)
    return [(t, y) for _, t, y in sorted(found, key=lambda r: r[0])]
