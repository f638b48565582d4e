"""Alignment against both libraries over whole texts and a plain account of every link."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from crawlsift.llm import align


def libraries():
    a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def ends(tokens: list[bytes]) -> list[int]:
    out = []
    for t in tokens:
        out.append((out[-1] if out else 0) + len(t))
    return out


def plain(texts):
    """Brute force: (rows, groups) from the libraries' own tokens of whole texts."""
    a, b = libraries()
    byte = align.Pair(open(align.A_FILE, "rb").read(), open(align.B_FILE, "rb").read())
    docs = []
    for t in texts:
        x = a.encode(f" {t}", add_special_tokens=False).ids if t else []
        y = b.encode(t, num_threads=1) if t else []
        xs, ys = [byte.a_bytes[i] for i in x], [byte.b_bytes[i] for i in y]
        good = bool(t) and b"".join(xs) == b"".join(ys) == f" {t}".encode()
        docs.append((x, y, ends(xs), ends(ys)) if good else ([], [], [], []))
    links = []
    for x, y, ex, ey in docs:
        mine = []
        for i, e in enumerate(ex):
            for j, f in enumerate(ey):
                if max(e - (e - (ex[i - 1] if i else 0)), ey[j - 1] if j else 0) < min(e, f):
                    mine.append((x[i], y[j]))
        links.append(mine)
    count = Counter(p for mine in links for p in mine)
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    rows = []
    for (x, y, ex, ey), mine in zip(docs, links, strict=True):
        cuts, parts, i, j = sorted(set(ex) & set(ey)), [], 0, 0
        for c in cuts:
            u, v = ex.index(c) + 1, ey.index(c) + 1
            parts.append((x[i:u], y[j:v]))
            i, j = u, v
        s = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in parts)
        rows.append((len(x), len(y), len(parts), len(mine), sum(count[p] == best[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(s.encode()).hexdigest() if parts else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = " \n\t\r\x0b \xa0　aZ'sé9²…!?漢字🙂👩‍👩‍👧ßİ́<|endoftext|></s>\x00▁"


def texts():
    rng = random.Random(11)
    out = [None, "", " ", "\n", "  two  spaces ", "line\nline\n\n  end", "it's we'll", "<s> </s> <|endoftext|>", "a▁b", "word " * 300, "漢字" * 200, "x" * 700]
    out += ["".join(rng.choice(ODD[:-1]) for _ in range(rng.randrange(1, 60))) for _ in range(150)]
    out += [" ".join("".join(rng.choice("etaoinéü.") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(20)]
    return out + out[-3:]


@pytest.mark.parametrize("size,shared", [(1 << 16, 1 << 21), (40, 50)])
def test_against_plain(spark, size, shared):
    given = texts()
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(given)], "doc_id long, text string, n_a int").repartition(3)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align.aligned(docs, shared_pairs=shared, slice_chars=size).collect()}
    want = plain(given)
    for i, t in enumerate(given):
        assert got[i] == want[i], repr(t)


def test_groups(spark):
    docs = spark.createDataFrame([(1, "Étion 漢字 words"), (None, "it"), (3, None)], "doc_id long, text string")
    rows = sorted(align.groups(docs).collect(), key=lambda r: (r.doc_id or 0, r.end))
    a, b = libraries()
    mine = [r for r in rows if r.doc_id == 1]
    assert [i for r in mine for i in r.a] == a.encode(" Étion 漢字 words").ids
    assert [i for r in mine for i in r.b] == b.encode("Étion 漢字 words")
    assert mine[-1].end == len(" Étion 漢字 words".encode()) and {r.doc_id for r in rows} == {None, 1}


def test_repeated_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "one two"), (None, "one two"), (2, "one")], "doc_id long, text string")
    rows = align.aligned(docs).collect()
    assert len(rows) == 3 and sorted(r.count_sum for r in rows) == [3, 5, 5]
    assert align.aligned(docs.limit(0)).count() == 0


def test_both_libraries_split_latin_alike():
    pair = align.Pair(open(align.A_FILE, "rb").read(), open(align.B_FILE, "rb").read())
    assert pair.plain is not None
    letters = [c for c in map(chr, range(0x180)) if align._LATIN.fullmatch(c)]
    texts = [a + b for a in letters for b in letters] + [a + b + c for a in " \n'a1.é" for b in " \n'a1.²s" for c in letters]
    want = [e.ids for e in pair.a.encode_batch_fast(texts, add_special_tokens=False)]
    assert [list(x) for x in map(pair.plain.encode_ordinary, texts)] == want
