"""Line dedup against comparing every line with all earlier ones."""

import random
import re

from pyspark.sql import functions as F

from crawlsift.llm import lines

SCHEMA = "doc_id long, text string, n int, version string"


def brute(docs, t=0.8, least=5):
    earlier, out = [], {}
    for i, text in sorted(docs):
        removed = []
        for k, line in enumerate(text.split("\n")):
            w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))
            if len(w) < least:
                continue
            s = set(w)
            if any(len(s & e) >= t * len(s | e) - 1e-9 for e in earlier):
                removed.append(k)
            earlier.append(s)
        out[i] = removed
    return out


def made(seed, docs=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(3000)] + ["the", "of"] * 300
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 6, 9, 20, 60, 130]))] for _ in range(60)]
    out = []
    for i in range(docs):
        text = []
        for _ in range(rng.randrange(0, 7)):
            line = list(rng.choice(bases)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(12)]
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            text.append(" ".join(line))
        out.append((i, "\n".join(text)))
    return out


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    found = {r.doc_id: r.removed for r in lines.duplicate_lines(frame).collect()}
    want = brute([(i, t) for i, t in docs if t])
    assert {i: r for i, r in want.items() if r} == {i: r for i, r in found.items() if r}


def test_against_all_earlier(spark):
    docs = made(1)
    check(spark, [*docs, (1000, None), (1001, ""), (1002, "%%% !!\n\n"), (1003, "A b c d e\na B, c d e!"), (1004, "long " * 20_000)])


def test_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(lines, "FREQUENT", 0)
    check(spark, made(2))


def test_stage(spark):
    docs = [(1, "a b c d e\nkept"), (2, "a b c d e f\nother"), (3, "A b c d e"), (4, None), (5, ""), (6, "x"), (None, "q r s t u"), (7, "q r s t u\nmore"), (8, "same of this very text"), (8, "same of this very text")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    got = lines.stage(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id or -1), r.text) for r in got.collect() if r.text is not None) == [(-1, "q r s t u"), (1, "a b c d e\nkept"), (2, "other"), (5, ""), (6, "x"), (7, "more"), (8, "same of this very text"), (8, "same of this very text")]
    assert lines.stage(spark, frame.limit(0), "").count() == 0


def test_short_lines(spark, tmp_path):
    docs = [(1, "All rights reserved.\nOne\none two three four"), (2, "all rights  reserved\nnew"), (3, "ONE!\n\n"), (4, "one two three four five"), (5, "one two three six"), (6, "---"), (7, "---")]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.removed) for r in lines.op1_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {1: (3, []), 2: (2, [0]), 3: (1, [0]), 4: (1, [0]), 5: (1, []), 6: (0, []), 7: (0, [])}
    # of text 3 only line feeds are left
    assert sorted((r.doc_id, r.text) for r in lines.stage(spark, frame, "").collect()) == [(1, docs[0][1]), (2, "new"), (5, "one two three six"), (6, "---"), (7, "---")]


def test_scripts_without_spaces(spark):
    chinese, thai, korean = "敏捷的棕色狐狸跳过了懒狗然后回家", "สุนัขจิ้งจอกสีน้ำตาลกระโดด", "빠른갈색여우가게으른개를뛰어넘는다"
    docs = [(1, chinese), (2, chinese[:-1] + "去"), (3, "𠀀" + thai), (4, thai + "นะ"), (5, korean), (6, korean + "요"), (7, "漢字 " + chinese[:4])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA)
    found = {r.doc_id: r.removed for r in lines.duplicate_lines(frame, lines.EVERY).collect()}
    assert found == {1: [], 2: [0], 3: [], 4: [0], 5: [], 6: [], 7: []}


def test_stage_with_clashing_columns(spark):
    line = "all of these words stand in one line"
    docs = [(1, line, "a", "b"), (2, f"{line}\nand a line of its own here", "a", "b"), (3, None, None, None), (3, "", "c", "d")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, removed string, of_id string").withColumns({c: F.lit(1) for c in ("version", "id", "hash", "doc", "lines", "of_version")})
    out = lines.stage(spark, frame, "")
    assert out.columns == frame.columns
    assert sorted((r.doc_id, r.text or "", r.removed or "") for r in out.collect()) == [(1, line, "a"), (2, "and a line of its own here", "a"), (3, "", ""), (3, "", "c")]
