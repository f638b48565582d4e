"""Held-out accuracy of the three trained operators, their edge cases, and their arithmetic against plain forms."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from crawlsift.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, y string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=700, seed=4):
    rng = random.Random(seed)
    stems = {"xx": ["thae", "onder", "ingly", "ertio"], "yy": ["çaru", "élle", "ouvir", "mentè"]}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(["xx", "yy"])
        w = ["".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(15, 150))]
        toxic, good = int(rng.random() < 0.2), int(rng.random() > 0.25)
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                w[rng.randrange(len(w))] = rng.choice(["Grubble", "snark", "bofo" + rng.choice(stems[lang])])
        if not good:
            w = [x + "$$$" for x in w] if rng.random() < 0.5 else list(itertools.chain.from_iterable([x] * 9 for x in w[:12]))
        docs.append((i, " ".join(w) + ".\nEnd.", lang, "s", 0, "", "", ""))
        labels.append((i, good, toxic, "clash"))
    docs += [(10_001, None, None, None, None, None, None, None), (10_002, "", "xx", None, 0, "", "", ""), (10_003, "12 !!\n", None, "s", 0, "", "", ""), (None, "thae onder", "xx", "s", 0, "", "", ""), (10_004, "onderthae " * 20_000, "xx", "s", 0, "", "", "")]
    labels += [(5, 1, 0, ""), (None, 1, 1, ""), (10_002, None, None, "")]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t, _ in labels[:700]}


def test_toxicity(spark, tables):
    docs, labels, truth = tables
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id][1] for r in held]) > 0.95
    text = {r.doc_id: r.text for r in docs.collect()}
    found = [text[r.doc_id][s.start : s.end].lower() for r in rows for s in r.spans]
    assert found and np.mean([any(x in f for x in ("grubble", "snark", "bofo")) for f in found]) > 0.9
    assert all(r.predicted == 0 for r in rows if r.doc_id in (10_001, 10_002, 10_003, 10_004))
    kept = toxicity.stage(spark, docs, _saved(spark, labels))
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in rows)


def test_rare_toxic_words(spark, monkeypatch):
    """Toxic words that under 1.2% of the toxic documents have each, and one or two texts of the sample or none."""
    monkeypatch.setattr(toxicity, "PER_CLASS", {0: 250, 1: 150})
    rng = random.Random(12)
    stem = [a + b for a in ("than", "onde", "ingl", "erti", "ouvi", "ment", "caru", "elle") for b in ("ra", "so", "ti", "mu", "ke", "vo")]
    rare = ["".join(rng.sample("bcdfghjklmnpqrstvwxz", 9)) for _ in range(90)]
    docs, labels = [], []
    for i in range(3000):
        w = [rng.choice(stem) + rng.choice(stem) for _ in range(rng.randrange(15, 40))]
        toxic = int(i % 3 == 0)
        if toxic:
            w[rng.randrange(len(w))] = rare[i // 3 % 90]
        docs.append((i, " ".join(w), "xx", "s", 0, "", "", ""))
        labels.append((i, 1, toxic, ""))
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    rows = toxicity.scored(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted for r in held if r.doc_id % 3 == 0]) > 0.9
    assert np.mean([r.predicted for r in held if r.doc_id % 3]) < 0.05


def _saved(spark, labels):
    import tempfile

    path = tempfile.mkdtemp()
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_quality(spark, tables):
    docs, labels, truth = tables
    measured = quality.measured(docs)
    rows = quality.scored(measured, quality.fit(measured, labels)).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id][0] for r in held]) > 0.95


def test_language(spark, tables):
    docs, _, _ = tables
    rows = langid.predicted(docs, langid.fit(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(lang)
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 10_000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (10_001, 10_002, 10_003))
    assert all(r.lang_pred in ("xx", "yy") and 0 <= r.score <= 1 for r in rows if r.doc_id not in (10_001, 10_002, 10_003))


def test_nothing_to_learn_from(spark, tables):
    docs, labels, _ = tables
    none, no_docs = labels.limit(0), docs.limit(0)
    assert toxicity.scored(docs.limit(3), toxicity.fit(docs, none)).count() == 3
    assert toxicity.scored(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    few = quality.measured(docs.limit(3))
    assert quality.scored(few, quality.fit(few, none)).count() == 3
    assert {r.lang_pred for r in langid.predicted(docs.limit(3), langid.fit(no_docs)).collect()} == {"und"}


def test_marginals_against_all_labellings(monkeypatch):
    """Lines of one block and, cut after three words, of several: the cut changes nothing."""
    monkeypatch.setattr(toxicity, "CHAIN", 3)
    rng = np.random.default_rng(0)
    crf = toxicity.CRF(np.zeros(1 << toxicity.BITS), rng.normal(size=(2, 2)), 0.3)
    crf.weights[:50] = rng.normal(size=50)
    line = np.array([0] * 8 + [1, 1, 1] + [2] + [3] * 4 + [4] * 6)
    places = rng.integers(0, 50, (len(line), 8)).astype(np.int32)
    within = np.concatenate([np.arange(n) for n in np.bincount(line)])
    block, place = np.cumsum(within % 3 == 0) - 1, within[within % 3 == 0] // 3
    got = crf.marginals(places, block, place)
    for c in range(5):
        at = np.flatnonzero(line == c)
        e, total, one = crf.weights[places[at]].sum(axis=1), 0.0, np.zeros(len(at))
        for y in itertools.product((0, 1), repeat=len(at)):
            s = math.exp(crf.start * y[0] + sum(a * b for a, b in zip(e, y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
            total += s
            one += s * np.array(y)
        assert got[at] == pytest.approx(one / total)


def test_language_gradients_against_differences():
    rng = np.random.default_rng(3)
    e, w, b = rng.normal(size=(9, 4)), rng.normal(size=(4, 3)), rng.normal(size=3)
    bags, y = [np.array([0, 1, 1, 8]), np.array([2]), np.array([3, 4, 5, 1])], np.array([0, 2, 1])
    loss, places, g_e, g_w, g_b = langid.gradients(e, w, b, bags, y)

    def plain(e, w, b):
        total = 0.0
        for bag, k in zip(bags, y):
            z = sum(e[i] for i in bag) / len(bag) @ w + b
            total += math.log(sum(math.exp(v) for v in z)) - z[k]
        return total

    assert loss == pytest.approx(plain(e, w, b)) and sorted(places) == [0, 1, 2, 3, 4, 5, 8]
    for array, g, rows in ((e, g_e, places), (w, g_w, range(4))):
        for i, row in enumerate(rows):
            for k in range(array.shape[1]):
                kept = array[row, k]
                array[row, k] = kept + 1e-6
                up = plain(e, w, b)
                array[row, k] = kept - 1e-6
                down = plain(e, w, b)
                array[row, k] = kept
                assert g[i, k] == pytest.approx((up - down) / 2e-6, abs=1e-5)
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert g_b[k] == pytest.approx((plain(e, w, b + step) - plain(e, w, b - step)) / 2e-6, abs=1e-5)


def test_language_calibration():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(4000, 3))
    truth = np.array([rng.choice(3, p=p) for p in langid.softmax(z)])
    temperature, bound = langid.calibrated(z * 5, truth)
    assert 4 < temperature < 6.2
    top = langid.softmax(z * 5 / temperature).max(axis=1)
    assert np.mean(top < bound) == pytest.approx(0.01, abs=0.002)


def test_repeated_and_long_rows(spark):
    """Repeated ids, conflicting languages and labels, and languages of long texts alone: defined and the same at each run."""
    long = {"aa": "boku zano " * 3000, "bb": "lirt mesp " * 3000}
    docs = [(i, long["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb", "s", 0, "", "", "") for i in range(60)]
    docs += [(1, "boku", "bb", "s", 0, "", "", ""), (1, "boku", "bb", "s", 0, "", "", "")]
    table = spark.createDataFrame(docs, DOCS)
    first = langid.fit(table)
    again = langid.fit(table.repartition(7))
    assert first.languages == ["aa", "bb"] and (first.table == again.table).all()
    rows = langid.predicted(table, first).collect()
    assert len(rows) == 62 and all(r.lang_pred == ("aa" if r.doc_id % 2 else "bb") for r in rows if r.doc_id > 1)
    labels = spark.createDataFrame([(i, i % 2, i % 2, "") for i in range(60)] + [(2, 1, 1, "")], LABELS)
    assert toxicity.scored(table, toxicity.fit(table, labels)).count() == 62
    measured = quality.measured(table)
    assert quality.scored(measured, quality.fit(measured, labels)).count() == 62


def test_statistics_against_plain_counts():
    texts = ["Hello hello World, 12 apples!\n\nTwo lines $$", "", "x", "é é é 漢字", "a b a b a b a b"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    got = quality.statistics(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, r, x in zip(texts, raw, got):
        w = [m.lower() for m in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", t)]
        size, n, length = [len(m.encode()) for m in w], len(w), len(r)
        mean = (sum(size) + 25) / (n + 5)
        logit = lambda part, whole, prior: math.log((p := min(1 - 1e-6, max(1e-6, (part + 5 * prior) / (whole + 5)))) / (1 - p))
        of = lambda chars: sum(c in chars for c in r)
        pairs = {a + " " + b for a, b in zip(w, w[1:])}
        want = [
            math.log1p(n), math.log(mean), math.log(math.sqrt((sum((s - mean) ** 2 for s in size) + 30) / (n + 5))),
            logit(of(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), length, 0.02), logit(of(b"0123456789"), length, 0.001), logit(of(b".,;:?'\"()-"), length, 0.02), logit(of(b"!#$%&*+/<=>@[\\]^_`{|}~"), length, 0.0005),
            logit(of(b" \t\r\x0b\x0c"), length, 0.15), logit(sum(c >= 128 for c in r), length, 0.02), logit(of(b"\n"), length, 0.004),
            math.log(len(set(w)) + 5) - math.log(n + 5), math.log(len(pairs) + 5) - math.log(max(n - 1, 0) + 5), logit(sum(a == b for a, b in zip(w, w[1:])), n, 0.01),
        ]
        assert list(x) == pytest.approx(want)


def test_sums_of_quality_against_plain_ones(spark):
    rng = np.random.default_rng(5)
    d = len(quality.NAMES)
    rows = [(i, [float(v) for v in rng.normal(i % 2, 1, d)]) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0, "") for i in range(70)] + [(0, 1, 0, "")], LABELS)
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, x array<double>"), labels)
    used = [(x, 1 if i == 0 else i % 2) for i, x in rows[:70] if zlib.crc32(str(i).encode()) % 5]
    for c in (0, 1):
        mine = np.array([x for x, y in used if y == c])
        assert model.means[c] == pytest.approx(mine.mean(axis=0))
        every = np.array([x for x, _ in used])
        pooled = every.T @ every / len(every) - np.outer(every.mean(axis=0), every.mean(axis=0))
        own = mine.T @ mine / len(mine) - np.outer(mine.mean(axis=0), mine.mean(axis=0))
        part = min(1.0, 0.05 + d / (len(mine) + d))
        want = (1 - part) * own + part * pooled + 1e-3 * np.diag(np.diag(pooled))
        assert model.factors[c] @ model.factors[c].T == pytest.approx(want, abs=1e-6)


def test_densities_against_the_formula():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(60, 3)), rng.normal(2, 3, size=(90, 3))]
    count, total = np.array([60, 90]), np.array([a.sum(axis=0) for a in x])
    qda = quality.discriminant(count, total, np.array([a.T @ a for a in x]))
    point = rng.normal(size=(5, 3))
    log = []
    for m, f, n in zip(qda.means, qda.factors, count):
        s = f @ f.T
        log.append([-0.5 * (p - m) @ np.linalg.inv(s) @ (p - m) - 0.5 * math.log(np.linalg.det(s)) + math.log((n + 1) / 152) for p in point])
    assert qda.score(point) == pytest.approx(1 / (1 + np.exp(np.array(log[0]) - np.array(log[1]))))
