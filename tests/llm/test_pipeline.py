"""The stages in a row on a small corpus with known copies, toxic documents and tokens."""

import random
import tempfile

import corpus_pipeline
from crawlsift.llm import bpe
from crawlsift.llm.storage import saved

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs, labels = [], []
    for i in range(260):
        text = "\n".join(sentence(rng.randrange(12, 40)) for _ in range(3))
        toxic = int(i % 4 == 0)
        if toxic:
            w = text.split(" ")
            for _ in range(6):
                w.insert(rng.randrange(len(w)), rng.choice(["grubble", "snarfle"]))
            text = " ".join(w)
        docs.append((i, text, "xx", f"s{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    docs += [(1001, docs[1][1], "xx", "s0", 0), (1002, docs[2][1].replace(docs[2][1].split()[4], "other"), "xx", "s1", 0), (1003, None, None, None, None), (1004, "", "xx", "s2", 0), (None, sentence(30), "xx", "s0", 0)]
    return docs, labels


def test_stages(spark):
    docs, labels = corpus()
    path = tempfile.mkdtemp()
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = saved(stage(spark, now, path), name)
        seen[name] = now.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == [c.split(" ")[0] for c in COLUMNS.split(", ")]
    ids = {n: {r.doc_id for r in rows} for n, rows in seen.items()}
    clean = {i for i, _, t in labels if not t}
    assert clean <= ids["toxicity"] and len(ids["toxicity"] & {i for i, _, t in labels if t}) <= 2
    assert {1003, 1004, None} <= ids["toxicity"]
    # the exact copy has no line left, the near copy keeps none that is similar
    assert 1001 not in ids["line_dedup"] and clean <= ids["line_dedup"] and {1003, 1004, None} <= ids["line_dedup"]
    assert clean <= ids["ngram_join"]
    text = {r.doc_id: r.text for r in seen["mixing"]}
    assert {r.doc_id for r in seen["bpe"]} == set(text) and len(seen["bpe"]) == len(seen["mixing"])
    tok = bpe.tokenizer(open(bpe.RANKS, "rb").read())
    for r in seen["bpe"][:20]:
        assert r.n_tokens == len(tok.encode([text[r.doc_id] or ""])[0])


def test_names_and_registration():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert names["pipeline"] is corpus_pipeline.run
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
