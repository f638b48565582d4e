"""Removal of repeats against a plain count of all windows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from crawlsift.llm import recompress


def plain(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [*(f"w{i}" for i in range(rng.choice([2, 3, 30, 3000]))), "é漢", "x" * 90]
    stretch = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [stretch(rng.randrange(20, 120)) for _ in range(8)]
    out = [None, "", "  ", "one two", "a " * 34, "a " * 35, "b " * 36, "a " * 90, "ab cd " * 70, "cd ab " * 40]
    for _ in range(60):
        t = []
        for _ in range(rng.randrange(1, 6)):
            part = rng.choice(shared) if rng.random() < 0.5 else stretch(rng.randrange(1, 80))
            cut = rng.randrange(len(part))
            t += part if rng.random() < 0.5 else part[cut:]
        if rng.random() < 0.3:
            t[rng.randrange(len(t))] = "changed"
        out.append(rng.choice([" ", "\n", " \t\x0b "]).join(t))
    return out + rng.choices(out, k=12)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("sizes", [(8 << 20, 1 << 20, 1 << 21), (600, 300, 40)])
def test_against_plain(spark, seed, sizes):
    window = [35, 35, 10, 4, 35, 35][seed]
    given = texts(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(given)], "doc_id long, text string, n_words int").repartition(3)
    block, piece, names = sizes
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in recompress.deduplicated(docs, window, block, piece, names).collect()}
    want = plain(given, window)
    for i, t in enumerate(given):
        assert got[i] == want[i], (i, t)


def test_cores_of_equal_windows_are_equal():
    rng = random.Random(1)
    same = " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(60))
    around = [" ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(50)) for _ in range(4)]
    p = recompress.parse([f"{around[0]} {same} {around[1]}".encode(), f"{around[2]} x {same} {around[3]}".encode()])
    core = dict(zip(p.at.tolist(), p.core.tolist(), strict=True))
    second = int(p.words.bounds[1]) + 51
    assert [core[50 + i] for i in range(26)] == [core[second + i] for i in range(26)]


def test_no_rows_and_texts(spark):
    docs = spark.createDataFrame([(None, "one  two"), (None, None)], "doc_id long, text string")
    rows = recompress.deduplicated(docs).collect()
    assert sorted(r.n_words for r in rows) == [0, 2]
    assert sorted(r.text for r in recompress.deduplicated(docs, with_text=True).collect()) == ["", "one two"]
    many = spark.createDataFrame([(i, "x y " * 40 + str(i)) for i in range(3)], "doc_id long, text string")
    assert sorted(r.text for r in recompress.deduplicated(many, with_text=True).collect()) == ["0", "1", "2"]
    assert recompress.deduplicated(docs.limit(0)).count() == 0
