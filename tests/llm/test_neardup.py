"""Near duplicates against comparing all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from crawlsift.llm import neardup, storage
from crawlsift.llm.components import components

SCHEMA = "doc_id long, text string, class_id string, links string"


def shingle_set(text):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [(i, shingle_set(t)) for i, t in docs if i is not None]
    n = len(sets)
    parent, links = list(range(n)), [0] * n

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for a in range(n):
        least[find(a)] = min(sets[a][0], least.get(find(a), sets[a][0]))
    return sorted((sets[a][0], least[find(a)], links[a]) for a in range(n))


def test_against_all_pairs(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" for i in range(400)]
    docs = [(1, None), (2, ""), (3, "...  !!"), (4, "one two"), (5, "One, two!"), (6, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (8, "word " * 30_000)]
    at = 100
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((at, " ".join(copy).capitalize()))
            at += 1
    for i in range(120):  # one group larger than several parts
        copy = [f"k{j}" for j in range(200)]
        copy[i] = "z"
        docs.append((1000 + i, " ".join(copy)))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    found = neardup.near_duplicates(frame, neardup.Forest(chunk=32)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in found) == brute(docs)
    kept = neardup.stage(spark, frame, "")
    assert kept.columns == frame.columns
    heads = {c for _, c, _ in brute(docs)}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(heads)


def test_pair_at_the_threshold_beside_a_large_group(spark):
    f = neardup.Forest()
    assert f.found(f.threshold, f.prefix()) >= f.recall
    with pytest.raises(ValueError):
        neardup.Forest(trees=1).prefix()
    # pairs of 40 shingles each with 36 in both (36 / 44 = 0.82), of which the longest prefixes miss a few
    pairs = [([f"p{i}x{j}" for j in range(44)], [f"p{i}x{j}" if j < 40 else f"p{i}y{j}" for j in range(44)]) for i in range(3000)]
    texts = [" ".join(w) for pair in pairs for w in pair]
    batches = neardup._sign(f)([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])])
    signed = np.concatenate([np.frombuffer(b"".join(b.column(4).to_pylist()), ">u4").reshape(-1, f.trees, f.depth) for b in batches])
    same = signed[::2] == signed[1::2]
    shares = lambda depth: same[:, :, :depth].all(axis=2).any(axis=1)
    hard = np.flatnonzero(~shares(f.depth) & shares(f.prefix()))
    assert len(hard)
    docs = [(2 * int(i) + k, " ".join(pairs[i][k])) for i in hard for k in (0, 1)]
    for i in range(300):  # close copies, found at any depth
        docs.append((10_000 + i, " ".join("z" if j == i else f"k{j}" for j in range(400))))
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in neardup.near_duplicates(frame).collect()) == brute(docs)


def test_tries_over_small_batches_and_ranges(spark, monkeypatch):
    """Nodes that go over batches and ranges have one name each and all their documents."""
    monkeypatch.setitem(storage.WHILE_SAVING, "spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setitem(storage.WHILE_SAVING, "spark.sql.shuffle.partitions", "24")
    monkeypatch.setitem(storage.WHILE_SAVING, "spark.sql.adaptive.coalescePartitions.enabled", "false")
    f, rng = neardup.Forest(trees=3, depth=3), np.random.default_rng(2)
    values = rng.integers(0, 3, (400, f.trees, f.depth))
    values[:150] = values[0]
    reps = spark.createDataFrame([(int(i), bytearray(v.astype(">u4").tobytes())) for i, v in enumerate(values)], "doc_id long, signature binary")
    found = {}
    for r in neardup.tries(reps, f, 2).collect():
        found.setdefault(r.run, []).append(r.doc_id)
    want = {}
    for i, v in enumerate(values):
        for t in range(f.trees):
            want.setdefault((t, *v[t, :2]), set()).add(i)
    # a head may name a node in several trees, so nodes of one name are put together
    parts = [tuple(sorted(d)) for d in want.values() if len(d) > 1]
    assert all(len(d) == len(set(d)) or set(d) for d in found.values())
    for docs in parts:
        assert any(set(docs) <= set(d) for d in found.values())
    for d in found.values():
        assert set(d) == set().union(*(p for p in parts if set(p) <= set(d)))


def test_stage_keeps_one_row_of_a_class(spark):
    text = "one two three four five six seven"
    docs = [(7, text, "x", "y"), (7, text, "x", "y"), (8, text.upper(), "x", "y"), (None, text, "x", "y"), (None, "other words are here", "x", "y"), (None, "other words are here", "x", "y"), (None, None, "x", "y"), (9, None, None, None)]
    out = neardup.stage(spark, spark.createDataFrame(docs, SCHEMA), "")
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(7, text), (0, "other words are here"), (0, ""), (9, "")])


def test_empty(spark):
    assert neardup.stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
