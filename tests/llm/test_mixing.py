"""Mixing against a plain reckoning of targets, and how near the words taken come to them."""

import math
import re
from collections import Counter, defaultdict

import pytest

from crawlsift.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"


def reckoned_targets(rows, weights=(1, 2, 3), most=3):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(most * size[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if share[s] > most * size[s]}
        if not over:
            return {s: most * size[s] if s in full else share[s] for s in names}
        full |= over


def test_targets_and_taken(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "big" if i % 3 else f"s{i % 15}") for i in range(600)]
    rows += [(1000, None, "big"), (1001, "", None), (1002, "a\tb\x0bc", None), (1003, "x", None), (1003, "x", None)]
    docs = spark.createDataFrame([(i, t, None, s, 0, "clash") for i, t, s in rows], SCHEMA)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    want = reckoned_targets(rows)
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs.repartition(3)).collect() if r.doc_id < 1000}
    assert again == {(r.doc_id, r.size): r.taken for r in out if r.doc_id < 1000}


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rates_solve_the_dual(spark):
    """Against a direct solver of each source's constraint, at, under and at the very bound."""
    sizes = {0: {1: 3, 7: 5}, 1: {4: 10}, 2: {2: 1, 1000: 2}, 3: {5: 4}, 4: {0: 3}, 5: {3: 2}}
    words = {n: sum(s * d for s, d in x.items()) for n, x in sizes.items()}
    target = {0: 19.0, 1: 40.0, 2: 2.5, 3: 60.0, 4: 0.0, 5: 17.9}
    targets = spark.createDataFrame([(f"s{n}", words[n], n, target[n]) for n in sizes], "source string, source_size long, n long, target double")
    statistics = spark.createDataFrame([(n, s, d) for n, x in sizes.items() for s, d in x.items()], "n long, size long, docs long")
    rates = {r.n: r.rate for r in mixing.balanced(targets, statistics, 3).collect()}

    def direct(n):
        low, high = -60.0, math.log(3)
        for _ in range(200):
            mid = (low + high) / 2
            taken = sum(d * min(3 * s, s * math.exp(mid)) for s, d in sizes[n].items())
            low, high = (mid, high) if taken < target[n] else (low, mid)
        return math.exp(high)

    assert rates.pop(4) == 0
    for n, rate in rates.items():
        assert rate == pytest.approx(direct(n), rel=1e-6)
    # no mix that meets a source's target is nearer to its words: the gradient is the same for all its documents
    divergence = lambda m: sum(x * math.log(x / s) - x + s for x, s in zip(m, (1, 7), strict=True))
    best = [rates[0], 7 * rates[0]]
    for move in (0.01, -0.01):
        other = [best[0] + move, best[1] - move * 3 / 5]  # 3 documents of one word, 5 of seven
        weigh = lambda m: 3 * divergence([m[0], 7]) + 5 * divergence([1, m[1]])
        assert weigh(other) > weigh(best)


def test_numbers_by_code_point(spark):
    names = ["b", "a", "Z", "é", "", None, "aa", "語"]
    sizes = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "source string, size long")
    found = {r.source: r.n for r in mixing.numbered_sources(sizes.repartition(5)).collect()}
    assert found == {n: i for i, n in enumerate([*sorted(x for x in names if x is not None), None])}


def test_stage_keeps_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", None, "s", 5, "x") for i in range(10)] + [(3, "a b c", None, "s", 5, "x")], SCHEMA)
    out = mixing.stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == 11


def test_stage_takes_what_the_mix_takes(spark):
    """Equal rows share what is taken of them: source a is to give half of its words, b twice its own."""
    rows = [(7, "w " * 100, None, "a", 1, "x")] * 8 + [(i, "w " * 100, None, "a", 1, None) for i in range(100, 112)]
    rows += [(None, "v " * 50, None, "b", 1, "x")] * 4 + [(i, "v " * 50, None, "b", 1, "x") for i in range(200, 216)]
    docs = spark.createDataFrame(rows, SCHEMA)
    mixed = mixing.mix(docs)
    wanted = {r.source: r.target for r in mixed.select("source", "target").distinct().collect()}
    assert wanted["a"] == 1000 and wanted["b"] == 2000
    out = mixing.stage(spark, docs, "").collect()
    taken = Counter(r.source for r in out)
    assert taken["a"] * 100 == 1000 and taken["b"] * 50 == 2000
    assert all(r.size == "x" for r in out if r.doc_id in (7, None) or r.doc_id >= 200)


def test_stage_of_nothing(spark):
    assert mixing.stage(spark, spark.createDataFrame([], SCHEMA), "").count() == 0
