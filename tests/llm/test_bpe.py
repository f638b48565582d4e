"""Encoding against the tiktoken library; decoding as an exact round trip."""

import base64
import hashlib
import random
import resource
import time

import numpy as np
import public_tokenizers
import tiktoken

from crawlsift.llm import bpe


def reference():
    with open(bpe.RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_the_library(spark):
    rng = random.Random(5)
    odd = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　aZ'sé9٣²…!?漢字🙂👩‍👩‍👧ßİ́<|endoftext|>"
    texts = [None, "", " ", "\n\n  x", "it's we'll I'd", "aaaaaaaaaaaaaaaa" * 200, "word " * 50_000]
    texts += ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None)], "doc_id long, text string")
    enc = reference()
    rows = bpe.encoded(docs, with_ids=True).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = texts[r.doc_id] or ""
        want = enc.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want), repr(text)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_words_in_about_linear_time():
    """Unbroken letters, one word each: random ones, repeats, and scripts of several bytes a letter."""
    rng, enc = random.Random(6), reference()
    with open(bpe.RANKS, "rb") as f:
        tok = bpe.Tokenizer(f.read())
    letters = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    texts = [letters(n, "abcdefghijklmnopqrstuvwxyz") for n in (64, 65, 66, 129, 1000, 1_000_000)]
    texts += ["a" * n for n in (64, 65, 127, 40_000)] + ["ab" * 20_000, letters(20_000, "ab"), letters(20_000, "漢字語文ßé"), "thering" * 3000]
    for text in texts:
        began = time.process_time()
        assert tok.encode([text])[0].tolist() == enc.encode_ordinary(text), text[:20]
        assert time.process_time() - began < 60


def test_long_texts(spark):
    """8 and 50 MB of prose and odd white space: as the library has them, in bounded memory; 4 MB also through Spark."""
    rng, enc = random.Random(8), reference()
    words = ["".join(rng.choice("etaoinshrdlué漢") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    prose = "".join(rng.choice([" ", " ", " ", "\n", "  ", "\t", "\xa0 ", ", ", "'s "]) + rng.choice(words) for _ in range(1_000_000))
    with open(bpe.RANKS, "rb") as f:
        tok = bpe.Tokenizer(f.read())
    for text in (prose[: 8 << 20], (prose * 20)[: 40_000_000]):
        began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        parts, sha, decoded = tok.long_text(text)
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - began < 300 << 10
        ids = np.concatenate(parts)
        want = enc.encode_ordinary(text) if len(text) < 10 << 20 else [i for s in bpe.slices(text, 7 << 20) for i in enc.encode_ordinary(s)]
        assert ids.tolist() == want
        whole = hashlib.sha256()
        for at in range(0, len(ids), 1 << 20):
            whole.update((("," if at else "") + ",".join(map(str, ids[at : at + (1 << 20)].tolist()))).encode())
        assert sha == whole.hexdigest() and decoded == hashlib.sha256(text.encode()).hexdigest()
    text = prose[:4_000_000]
    row = bpe.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_ids=True).first()
    assert row.ids == enc.encode_ordinary(text) and row.n_tokens == len(row.ids) and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_forgetting_changes_no_result(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 20_000)
    rng, enc = random.Random(7), reference()
    with open(bpe.RANKS, "rb") as f:
        tok = bpe.Tokenizer(f.read())
    for _ in range(30):
        texts = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(1, 7))) for _ in range(60)) for _ in range(3)] + ["x" * rng.randrange(200)]
        ids, bounds = tok.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [enc.encode_ordinary(t) for t in texts]
    tok.make_room()
    assert tok.held <= bpe.CACHE_BYTES


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 3), (None, None, None, None)], "doc_id long, text string, n_tokens string, ids int")
    rows = {r.doc_id: r for r in bpe.encoded(docs, with_ids=True).collect()}
    assert rows[1].n_tokens == 2 == len(rows[1].ids) and rows[None].n_tokens == 0


def test_empty_table(spark):
    assert bpe.encoded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
