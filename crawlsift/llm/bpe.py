"""Byte-level BPE encoding and decoding with recursive DuckDB queries in each partition."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsift.llm.words import steps

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text that one step encodes, bytes of words that one query contracts, and bytes of words that a worker
#: remembers. All three bound memory only.
STEP_BYTES, QUERY_BYTES, CACHE_BYTES = 1 << 20, 160 << 10, 80 << 20
#: Bytes that a remembered word takes beside its own, about.
WORD_BYTES = 200
#: Longer words are contracted in pieces of so many bytes, whose seams are then contracted anew over so many tokens.
PIECE, SEAM = 64, 8
RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Each round unrolls every word to its token positions, joins neighbours with the merge table and contracts the
#: pair of least rank, the leftmost among equals; a word without such a pair is at its fixpoint. The recursion keeps
#: each word's last state only.
ENCODE = """
WITH RECURSIVE t(w, tokens) USING KEY (w) AS (
  SELECT w, list(tok ORDER BY pos) FROM start GROUP BY w
  UNION
  SELECT t.w, list_concat(list_append(tokens[:best.k - 1], best.id), tokens[best.k + 2:])
  FROM t JOIN (
    SELECT w, arg_min(i, m.id * 4294967296 + i) AS k, CAST(min(m.id) AS INTEGER) AS id
    FROM (SELECT w, unnest(tokens[:-2]) AS a, unnest(tokens[2:]) AS b, unnest(range(1, len(tokens))) AS i FROM t WHERE len(tokens) > 1) p
    JOIN merges m ON m.pair = CAST(p.a AS BIGINT) * 65536 + p.b
    GROUP BY w
  ) best USING (w)
)
SELECT w, tokens FROM t ORDER BY w
"""

DECODE = """
SELECT d, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM tokens JOIN vocabulary USING (id) GROUP BY d
"""
#: Tokens that one query decodes; a text's bytes go through its digest slice by slice.
DECODE_TOKENS = 1 << 17
#: A text may be cut where a space or a line feed follows anything but white space: a match of the pattern ends there,
#: and the next one does not look back.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def slices(text: str, size: int) -> Iterator[str]:
    """The text in slices of about `size` characters that are encoded apart; a single word is never cut."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Tokenizer:
    """A rank file's vocabulary and merges as DuckDB tables, and the words encoded so far."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        if max(self.ranks.values()) >= 65536:
            raise ValueError("ids of 65536 or more do not fit the pair key")
        pairs, ids = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs.append(left * 65536 + right)
                    ids.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        merges = pa.table({"pair": pa.array(pairs, pa.int64()), "id": pa.array(ids, pa.int64())})  # noqa: F841
        vocabulary = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]})  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.decimal = {r: str(r) for r in self.ranks.values()}
        self.bytes = {r: t for t, r in self.ranks.items()}
        self.split = regex.compile(pattern())
        self.known: dict[str, int] = {}
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.forget()

    def forget(self, kept: np.ndarray | None = None) -> None:
        """Drops all words but those with the numbers in kept."""
        kept = np.zeros(0, np.int64) if kept is None else np.sort(kept)
        words = np.array(list(self.known), object)[kept] if len(kept) else []
        count = np.diff(self.first)[kept] if len(kept) else kept
        places = np.repeat(self.first[kept] - np.cumsum(count) + count, count) + np.arange(count.sum()) if len(kept) else kept
        self.flat = self.flat[places] if len(kept) else np.zeros(0, np.int32)
        self.known = {w: i for i, w in enumerate(words)}
        self.first = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        self.uses = np.zeros(len(kept), np.int64)
        self.held = sum(map(len, self.known)) + WORD_BYTES * len(self.known)

    def make_room(self) -> None:
        """Beyond CACHE_BYTES, only the words that were used most since the last time are remembered, a third of them."""
        if self.held > CACHE_BYTES:
            self.forget(np.argsort(-self.uses, kind="stable")[: len(self.known) // 3])
        if self.held > CACHE_BYTES:  # very long words
            self.forget()

    def contract(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each word, all tokens in a row), from the recursive query."""
        upto = np.cumsum([len(w) for w in raw])
        counts, tokens, at = [], [], 0
        while at < len(raw):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + QUERY_BYTES, "right")))
            data = np.frombuffer(b"".join(raw[at:end]), np.uint8)
            number = np.repeat(np.arange(end - at, dtype=np.int32), [len(w) for w in raw[at:end]])
            start = pa.table({"w": number, "pos": np.arange(len(data), dtype=np.int64), "tok": self.byte[data]})
            self.db.register("start", start)
            lists = self.db.sql(ENCODE).to_arrow_table().column("tokens").combine_chunks()
            self.db.unregister("start")
            counts.append(lists.value_lengths().to_numpy())
            tokens.append(lists.flatten().to_numpy())
            at = end
        return np.concatenate(counts).astype(np.int64), np.concatenate(tokens).astype(np.int32)

    def contract_lists(self, raw: list[bytes]) -> list[list[int]]:
        if not raw:
            return []
        counts, tokens = self.contract(raw)
        return [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])]

    def contract_long(self, raw: list[bytes]) -> list[list[int]]:
        """Tokens of words of any length, in a time that grows with the length and its logarithm.

        A sequence of tokens is a text's encoding if and only if each two neighbours are the encoding of their own
        bytes: the first merge across a boundary in the whole text would be the first one across it in those two
        tokens as well. So pieces are contracted apart, and at a seam the last tokens of one and the first of the
        next are contracted together; where that gives a token that the piece has too, at the same place, the rest
        of the piece stands. Where it gives none, more tokens are taken, all of both pieces in the end.
        """
        parts = [[w[i : i + PIECE] for i in range(0, len(w), PIECE)] for w in raw]
        flat = iter(self.contract_lists([p for w in parts for p in w]))
        lists = [[next(flat) for _ in w] for w in parts]
        while any(len(x) > 1 for x in lists):
            seams = [(i, j) for i, x in enumerate(lists) for j in range(0, len(x) - 1, 2)]
            span = dict.fromkeys(seams, SEAM)
            while span:
                windows = [(lists[i][j][-m:], lists[i][j + 1][:m]) for (i, j), m in span.items()]
                found = self.contract_lists([b"".join(self.bytes[t] for t in [*a, *b]) for a, b in windows])
                for ((i, j), m), (a, b), between in zip(list(span.items()), windows, found, strict=True):
                    left, right = lists[i][j], lists[i][j + 1]
                    head = 0 if len(a) == len(left) else self._shared(a, between)
                    tail = 0 if len(b) == len(right) else self._shared(b[::-1], between[::-1])
                    if head is None or tail is None:
                        span[i, j] = 4 * m
                        continue
                    del span[i, j]
                    lists[i][j] = self._joined(left, a, right, b, between, head, tail)
                    lists[i][j + 1] = []
            lists = [[p for p in x if p] for x in lists]
        return [x[0] if x else [] for x in lists]

    def _shared(self, own: list[int], window: list[int]) -> int | None:
        """Bytes from the start to the end of the last token that both sequences have at the same place, else None.

        Only places inside own count: window goes on beyond it.
        """
        ends, at = {}, 0
        for t in own:
            at += len(self.bytes[t])
            ends[at] = t
        total, at, last = at, 0, None
        for t in window:
            at += len(self.bytes[t])
            if at > total:
                break
            if ends.get(at) == t:
                last = at
        return last

    def _joined(self, left: list[int], a: list[int], right: list[int], b: list[int], between: list[int], head: int, tail: int) -> list[int]:
        """left as far as the token that ends head bytes into a, between's middle, right from its mirror image on."""

        def upto(tokens: list[int], size: int) -> int:
            n = 0
            while size > 0:
                size -= len(self.bytes[tokens[n]])
                n += 1
            return n

        first, last = upto(between, head), len(between) - upto(between[::-1], tail)
        return left[: len(left) - len(a)] + a[: upto(a, head)] + between[first:last] + b[len(b) - upto(b[::-1], tail) :] + right[len(b) :]

    def learn(self, found: set[str]) -> None:
        """Encodes words that are not known yet."""
        new = list(found)
        raw = [w.encode() for w in new]
        whole = np.array([self.ranks.get(w, -1) for w in raw], np.int64)
        length = np.array([len(w) for w in raw])
        groups = [np.flatnonzero(whole >= 0), np.flatnonzero((whole < 0) & (length <= PIECE)), np.flatnonzero((whole < 0) & (length > PIECE))]
        counts, tokens = np.ones(len(new), np.int64), [whole[groups[0]]]
        if len(groups[1]):
            counts[groups[1]], short = self.contract([raw[i] for i in groups[1]])
            tokens.append(short)
        if len(groups[2]):
            long = self.contract_long([raw[i] for i in groups[2]])
            counts[groups[2]] = [len(x) for x in long]
            tokens += long
        order = np.concatenate(groups)
        tokens = np.concatenate([np.asarray(t, np.int32) for t in tokens])[np.argsort(np.repeat(order, counts[order]), kind="stable")]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, tokens])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.held += int(length.sum() + 4 * counts.sum()) + WORD_BYTES * len(new)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's begin and the last's end)."""
        self.make_room()
        flat, upto = [], [0]
        for t in texts:
            flat += self.split.findall(t)
            upto.append(len(flat))
        words = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(words < 0)
        if len(missing):
            new = [flat[i] for i in missing.tolist()]
            self.learn(set(new))
            words[missing] = np.fromiter(map(self.known.__getitem__, new), np.int64, len(new))
        self.uses += np.bincount(words, minlength=len(self.uses))
        begin, count = self.first[words], self.first[words + 1] - self.first[words]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(begin - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.array(upto)]

    def decoded_sha256(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """SHA-256 of each text's bytes, put together from its ids by an ordered aggregation."""
        d = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
        out = [hashlib.sha256() for _ in range(len(bounds) - 1)]
        self.decode(d, ids, out)
        return [x.hexdigest() for x in out]

    def decode(self, d: np.ndarray, ids: np.ndarray, digests: list) -> None:
        """Puts the bytes of ids through the digests that d names, in order, DECODE_TOKENS at a time."""
        for at in range(0, len(ids), DECODE_TOKENS):
            some = slice(at, at + DECODE_TOKENS)
            tokens = pa.table({"d": d[some], "pos": np.arange(len(ids[some]), dtype=np.int64), "id": ids[some]})  # noqa: F841
            for text, data in self.db.execute(DECODE).fetchall():
                digests[text].update(data)

    def long_text(self, text: str) -> tuple[list[np.ndarray], str, str]:
        """(ids by slice, digest of the ids, digest of the bytes decoded from them) of a text of any length."""
        parts, sha, decoded = [], hashlib.sha256(), hashlib.sha256()
        for s in slices(text, STEP_BYTES):
            ids, _ = self.encode([s])
            for at in range(0, len(ids), DECODE_TOKENS):
                sha.update((("," if parts or at else "") + ",".join(map(self.decimal.__getitem__, ids[at : at + DECODE_TOKENS].tolist()))).encode())
            self.decode(np.zeros(len(ids), np.int32), ids, [decoded])
            parts.append(ids)
        return parts, sha.hexdigest(), decoded.hexdigest()


def pattern() -> str:
    """The tokenizer's pattern with white space as Unicode's White_Space property, as tiktoken's library has it."""
    space = r"\t-\r \x85\xa0  -     　"
    inner = public_tokenizers.PATTERN.replace(r"[^\s", rf"[^{space}").replace(r"\S", rf"[^{space}]")
    return inner.replace(r"\s", f"[{space}]")


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(rank_file: bytes) -> Tokenizer:
    """One a worker process and vocabulary: words encoded for one task serve the next."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(rank_file)
    return _tokenizers[key]


def encoded(documents: DataFrame, rank_path: str = RANKS, with_ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of each whole text beside all columns of documents but text.

    with_ids adds ids (array<int>). A null text is an empty one: no tokens, the digests of nothing. Extra columns
    pass through, but for those that have a result's name: the result takes their place. Repeated rows give a row
    each; no rows give none. Texts are not shuffled; a task holds one Arrow batch and about STEP_BYTES of text in
    queries: a longer text goes through in slices, its digests running on; only a single word is never cut.
    """
    with open(rank_path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    made = {"text", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids}
    kept = [c for c in documents.columns if c not in made]
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name in kept), RESULT, *["ids array<int>"] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(ranks.value)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for a, b, _, _ in steps(column, STEP_BYTES):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                if b - a == 1 and len(texts[0]) > STEP_BYTES:
                    parts, sha, decoded = tok.long_text(texts[0])
                    bounds, shas, decodeds = np.array([0, sum(map(len, parts))]), [sha], [decoded]
                    ids = np.concatenate(parts) if with_ids else None
                else:
                    ids, bounds = tok.encode(texts)
                    shas, decimal = [], tok.decimal
                    for i in range(b - a):
                        joined = ",".join(map(decimal.__getitem__, ids[bounds[i] : bounds[i + 1]].tolist()))
                        shas.append(hashlib.sha256(joined.encode()).hexdigest())
                    decodeds = tok.decoded_sha256(ids, bounds)
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                columns += [pa.array(np.diff(bounds), pa.int64()), pa.array(shas, pa.string()), pa.array(decodeds, pa.string())]
                columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, [*kept, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    return documents.select(*kept, F.col("text")).mapInArrow(run, kind)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document of docs: doc_id, n_tokens and both digests."""
    return encoded(docs.select("doc_id", "text"))
