"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact set comparison decides."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.components import components
from crawlsift.llm.marks import among, marked
from crawlsift.llm.storage import drop, saved
from crawlsift.llm.words import mix, shingles, steps, words

SIGNED = "doc_id long, k1 long, k2 long, n long, signature binary"
SETS = "doc_id long, k1 long, k2 long, shingles binary"
LINKS = "doc_id long, links long, root long"


@dataclass(frozen=True)
class Forest:
    """trees sorted prefix tries, each over depth MinHash values. recall: chance by which any one similar pair is found."""

    words: int = 5
    threshold: float = 0.8
    trees: int = 20
    depth: int = 6
    recall: float = 0.999
    chunk: int = 256

    def found(self, similarity: float, depth: int) -> float:
        """Chance that a pair of this similarity shares a prefix of `depth` values in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def prefix(self) -> int:
        """The longest prefix that finds a pair just at the threshold, the hardest one, with the chance asked for.

        Pairs of more similarity are found with a higher chance, so no mix of pairs in the data can lower it.
        """
        enough = [d for d in range(1, self.depth + 1) if self.found(self.threshold, d) >= self.recall]
        if not enough:
            raise ValueError(f"{self.trees} trees cannot find pairs at {self.threshold} with a chance of {self.recall}")
        return enough[-1]


def distinct_shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes without repeats within a text, first of each text that has any, those texts' numbers)."""
    row, value = shingles(words(data, offsets), size)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[keep], value[keep]
    texts, first = np.unique(row, return_index=True)
    return value, first, texts


def set_keys(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """128 bits that tell sets apart, as two longs."""
    if not len(first):
        return [np.zeros(0, np.int64)] * 2
    return [np.add.reduceat(mix(value, seed), first).view(np.int64) for seed in (1, 2)]


def _sign(f: Forest) -> Callable:
    rng = np.random.default_rng(20)
    factor = rng.integers(1, 1 << 63, f.trees * f.depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in steps(batch.column(1)):
                value, first, texts = distinct_shingles(data, offsets, f.words)
                n, keys, signature = np.zeros(b - a, np.int64), np.zeros((2, b - a), np.int64), np.zeros((b - a, len(factor)), ">u4")  # big-endian: bytes sort as the values do
                if len(value):
                    n[texts] = np.diff(np.append(first, len(value)))
                    keys[:, texts] = set_keys(value, first)
                    for k, x in enumerate(factor):
                        signature[texts, k] = np.minimum.reduceat((value * x) >> np.uint64(32), first)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(keys[0]), pa.array(keys[1]), pa.array(n), pa.array([s.tobytes() for s in signature], pa.binary())], ["doc_id", "k1", "k2", "n", "signature"])

    return sign


def _sets(f: Forest, bits: Broadcast) -> Callable:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(among(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in steps(batch.column(1)):
                value, first, texts = distinct_shingles(data, offsets, f.words)
                k1, k2 = set_keys(value, first)
                end = np.append(first[1:], len(value))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][texts]), pa.array(k1), pa.array(k2), pa.array([value[i:j].tobytes() for i, j in zip(first, end, strict=True)], pa.binary())], ["doc_id", "k1", "k2", "shingles"])

    return sets


def similar_pairs(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix: which of these sets have a Jaccard similarity of the threshold or more.

    Set sizes of intersections come from a matrix product over the shingles that two or more sets share, those
    with equal occurrences taken together as one weighted column.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.float64)
    of = np.repeat(np.arange(m), sizes.astype(np.int64))
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = seen[column] > 1
    of, column = of[keep], column[keep]
    pattern = np.zeros(len(seen), np.uint64)
    np.add.at(pattern, column, mix(of.astype(np.uint64) + np.uint64(1), 9))
    live = np.flatnonzero(seen > 1)
    _, kept, kind, weight = np.unique(pattern[live], return_index=True, return_inverse=True, return_counts=True)
    place = np.full(len(seen), -1)
    place[live[kept]] = np.arange(len(kept))
    chosen = place[column] >= 0
    of, column = of[chosen], place[column[chosen]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    inter = np.zeros((m, m))
    for at in range(0, len(kept), 4096):
        a, b = np.searchsorted(column, [at, at + 4096])
        block = np.zeros((m, min(4096, len(kept) - at)), np.float32)
        block[of[a:b], column[a:b] - at] = 1
        inter += (block * weight[at : at + 4096].astype(np.float32)) @ block.T
    return inter * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6


def _verify(f: Forest) -> Callable:
    def verify(key: tuple, rows: pa.Table) -> pa.Table:
        _, i, j = (x.as_py() for x in key)
        ids, chunk, copies = (rows.column(c).to_numpy() for c in ("doc_id", "part", "copies"))
        near = similar_pairs([np.frombuffer(s, np.uint64) for s in rows.column("shingles").to_pylist()], f.threshold)
        np.fill_diagonal(near, False)
        if i != j:  # pairs inside either part are another task's
            near &= chunk[:, None] != chunk[None, :]
        links = near @ copies
        root = ids.copy()
        while True:  # least id reachable inside this task: few rounds, as near copies are mostly near each other
            least = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (least == root).all():
                break
            root = least
        some = links > 0
        return pa.table({"doc_id": ids[some], "links": links[some], "root": root[some]})

    return verify


def _walk(f: Forest, depth: int) -> Callable:
    width = 4 * depth

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted keys of trees, depth first through their tries: the documents below each node of `depth` values.

        A node's head is its first document; its members are given once it has two. What is open at a partition's
        ends goes out as an edge, as the node may go on in the next partition.
        """
        part = TaskContext.get().partitionId()
        open_key, head, told, first_key, first_head = None, 0, True, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), -1)[:, : 1 + width]
            new = np.ones(len(ids), bool)
            new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
            new[0] = open_key is None or keys[0].tobytes() != open_key
            if first_key is None:
                first_key, first_head = keys[0].tobytes(), int(ids[0])
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), -1))
            heads = np.where(start >= 0, ids[np.maximum(start, 0)], head)
            run, doc = [heads[~new]], [ids[~new]]
            # heads of nodes that turn out to have a second member
            second = np.flatnonzero(~new & np.append(not told, new[:-1]))
            run.append(heads[second])
            doc.append(heads[second])
            told, open_key, head = not new[-1], keys[-1].tobytes(), int(heads[-1])
            run, doc = np.concatenate(run), np.concatenate(doc)
            n = len(run)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int32()), "edge": pa.array([0] * n, pa.int32()), "node": pa.nulls(n, pa.binary()), "run": run, "doc_id": doc})
        if first_key is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * 2, pa.int32()), "edge": pa.array([1, 2], pa.int32()), "node": pa.array([first_key, open_key], pa.binary()), "run": pa.array([first_head, head], pa.int64()), "doc_id": pa.array([first_head, head], pa.int64())})

    return walk


def tries(reps: DataFrame, f: Forest, depth: int) -> DataFrame:
    """(run, doc_id) of documents below a node of `depth` values in some tree's trie, with a document that names the node.

    Signatures sorted by tree and value are the tries; ranges of them are walked in parallel, so a node with very many
    documents is many ranges. Nodes that go over the end of a range get one name: the ranges' ends, two rows a range,
    are all that meets in one place.
    """
    width = 4 * f.depth
    keyed = reps.select("doc_id", "signature", F.explode(F.sequence(F.lit(0), F.lit(f.trees - 1))).alias("tree"))
    keyed = keyed.select("doc_id", F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")), F.expr(f"substring(signature, tree * {width} + 1, {width})")).alias("key"))
    ordered = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
    walked = saved(ordered.mapInArrow(_walk(f, depth), "part int, edge int, node binary, run long, doc_id long"), "near-walk")
    name, before, joined = {}, None, set()
    for r in walked.where("edge > 0").orderBy("part", "edge").collect():
        if r.edge == 1 and before is not None and before.node == r.node:
            name[r.run] = name.get(before.run, before.run)
            joined |= {r.run, before.run}
        before = r
    spark = reps.sparkSession
    members = walked.where("edge = 0").select("run", "doc_id")
    if not joined:
        return members
    same = spark.createDataFrame([(a, name.get(a, a)) for a in joined], "run long, name long")
    # a head alone in its range is a member by its node's other ranges
    alone = same.select(F.col("name").alias("run"), F.col("run").alias("doc_id"))
    return members.join(F.broadcast(same), "run", "left").select(F.coalesce("name", "run").alias("run"), "doc_id").unionByName(alone).distinct()


def _placed(groups: DataFrame, reps: DataFrame, f: Forest) -> DataFrame:
    """(root, id, part, copies, k1, k2): members of groups in parts of about f.chunk, alike ones in one part where possible."""
    sizes = saved(groups.groupBy("root").agg(F.ceil(F.count("*") / f.chunk).cast("int").alias("parts")), "near-sizes")
    bucket = F.when(F.col("parts") == 1, 0).otherwise(F.pmod(F.xxhash64(F.expr("substring(signature, 1, 8)")), "parts")).cast("long")
    known = reps.select(F.col("doc_id").alias("id"), "copies", "k1", "k2", "signature")
    members = groups.join(sizes, "root").join(known, "id").select("root", "id", "copies", "k1", "k2", "parts", bucket.alias("bucket"))
    members = saved(members, "near-members")
    filled = members.where("parts > 1").groupBy("root", "bucket").agg(F.ceil(F.count("*") / f.chunk).cast("int").alias("subs"))
    sub = F.pmod(F.xxhash64("id"), F.coalesce("subs", F.lit(1)))
    out = members.join(filled, ["root", "bucket"], "left").select("root", "id", "copies", "k1", "k2", "parts", (F.col("bucket") * (1 << 24) + sub).alias("part"))
    out = saved(out, "near-parts")
    drop(sizes, members)
    return out


def _meeting(placed: DataFrame, runs: DataFrame) -> DataFrame:
    """(root, i, j) of parts, i <= j, whose members share a node: only such parts are compared."""
    alone = placed.select("root", F.col("part").alias("i"), F.col("part").alias("j")).distinct()
    large = placed.where("parts > 1").select("root", F.col("id").alias("doc_id"), "part")
    at = saved(runs.join(large, "doc_id").select("run", "root", "part").distinct(), "near-at")
    both = at.alias("x").join(at.alias("y"), (F.col("x.run") == F.col("y.run")) & (F.col("x.root") == F.col("y.root")) & (F.col("x.part") < F.col("y.part")))
    pairs = saved(alone.unionByName(both.select("x.root", F.col("x.part").alias("i"), F.col("y.part").alias("j")).distinct()), "near-pairs")
    drop(at)
    return pairs


def near_duplicates(documents: DataFrame, f: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links of each document: one row a row of documents that has a doc_id.

    Two documents are linked if the sets of their shingles of f.words words (lower case; all words if they are
    fewer) have a Jaccard similarity of f.threshold or more. A class is a connected component of links and has its
    least doc_id as class_id; n_links counts a document's links, copies included. A text without words, empty or
    null has no links and is its own class. Texts that share a doc_id share a class. No rows give none; columns but
    doc_id and text take no part.

    Equal sets are one candidate, whatever their number. Two documents are compared if they are below a common node in
    some tree's trie, at a depth that was shortened until pairs at the threshold are found with the recall asked for.
    Documents that nodes connect form a group; a large one is cut into parts, and parts are compared exactly, as matrix
    products, if members of theirs share a node. A task gives counts and roots but no pairs.
    """
    docs = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text"))
    signed = saved(docs.mapInArrow(_sign(f), SIGNED), "near-signed")
    reps = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    reps = saved(reps, "near-reps")
    runs = saved(tries(reps, f, f.prefix()), "near-runs")
    placed = _placed(saved(components(runs.select(F.col("doc_id").alias("a"), F.col("run").alias("b"))), "near-groups"), reps, f)
    pairs = _meeting(placed, runs)
    drop(runs)
    marks = marked(placed.select("id"))
    sets = docs.mapInArrow(_sets(f, marks), SETS)
    sets = sets.groupBy("doc_id", "k1", "k2").agg(F.first("shingles").alias("shingles"))
    whole = placed.withColumnRenamed("id", "doc_id").join(sets, ["doc_id", "k1", "k2"])
    asked = pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("part"))
    paired = whole.join(asked, ["root", "part"]).select("root", "i", "j", "doc_id", "part", "copies", "shingles")
    links = saved(paired.groupBy("root", "i", "j").applyInArrow(_verify(f), LINKS), "near-links")
    marks.destroy()
    classes = components(links.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    totals = links.groupBy("doc_id").agg(F.sum("links").alias("links"))
    judged = reps.select("k1", "k2", "doc_id", "copies").join(totals, "doc_id", "left").join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    judged = saved(judged.select("k1", "k2", F.coalesce("root", "doc_id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "near-judged")
    drop(reps, placed, pairs, links)
    rows = signed.select("doc_id", F.when(F.col("n") > 0, F.col("k1")).alias("k1"), "k2").join(judged, ["k1", "k2"], "left")
    return rows.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op9_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of docs: of the document with the class's id, the row of least hashes.

    Rows without a doc_id are documents by their texts, after all others, so of equal ones one stays. Rows that repeat a doc_id are in
    one class, whatever their texts.
    """
    unnamed = F.lit(1 << 62) + F.pmod(F.xxhash64("text"), F.lit(1 << 61))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("id"))
    found = near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("doc.text").alias("text")))
    # ids that stay, and in how many rows; a repeated id is few rows after the partial count
    found = saved(found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("class_id")).alias("stays"), F.count("*").alias("rows")).where(~F.col("stays") | (F.col("rows") > 1)), "near-found")
    kept = rows.join(found.select(F.col("doc_id").alias("id")), "id", "left_anti").select("doc.*")
    again = rows.join(found.where("stays").select(F.col("doc_id").alias("id")), "id")
    order = F.struct(F.xxhash64("doc.text").alias("h"), F.xxhash64(F.to_json("doc")).alias("g"))
    return kept.unionByName(again.groupBy("id").agg(F.min_by("doc", order).alias("doc")).select("doc.*"))


OP9_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(lower(text), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
  FROM w WHERE len(w) > 0
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT x.a, x.b FROM (
    SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS c FROM s JOIN s t USING (g) WHERE s.doc_id <> t.doc_id GROUP BY ALL
  ) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE x.c * 1.8 >= 0.8 * (na.n + nb.n) - 1e-6
), reach AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
), k AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
c AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(k.m, d.doc_id)) AS class_id, coalesce(c.n_links, 0) AS n_links
FROM documents d LEFT JOIN k ON k.a = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
