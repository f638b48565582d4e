"""WARC archives of pages, and their capture index by external merge."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsift.llm.storage import new_path, saved

CRLF = "\r\n"
#: Payloads shorter than this are always stored whole.
REVISIT_BYTES = 1000
#: Bounds of an archive file: records, and bytes before compression as far as an average tells; one step of inflating it.
RECORDS_PER_FILE, FILE_BYTES, CHUNK = 1000, 64 << 20, 1 << 20
START = "2024-01-01T00:00:00Z"
RUN = "urlkey string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long, run string"


def planned(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, refers_to and record_type.

    Of equal payloads of REVISIT_BYTES or more, that of the largest page_id is the response. Digests are counted
    before they meet the payloads, so a payload that very many pages share is one row of the smaller side; the
    larger side's hot partition is one that Spark may split.
    """
    body = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit("").cast("binary"))
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    shared = sized.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    shared = saved(shared.where(F.col("n") > 1).select(F.col("payload_digest").alias("digest"), "kept"), "warc-shared")
    known = sized.join(shared, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return known.withColumn("refers_to", F.when(other, F.col("kept"))).withColumn("record_type", F.when(other, "revisit").otherwise("response")).drop("digest", "kept")


def record(started: str) -> Column:
    """The WARC record of a planned row, but for the two line ends after its block."""
    base = F.to_timestamp(F.lit(started))
    at = F.date_format(F.timestamp_seconds(F.unix_timestamp(base) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    urn = lambda page: F.concat(F.lit("<urn:page:"), page.cast("string"), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    # line ends inside a URL would end its header line; a null one has no line
    url = F.regexp_replace("url", r"[\r\n]", "%0A")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), F.coalesce(urn(F.col("page_id")), F.lit("<urn:page:null>"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Date: "), at),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
    ]
    return F.concat(F.concat_ws(CRLF, *head), F.lit(CRLF + CRLF), F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write_archives(pages: DataFrame, path: str, started: str = START, records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Gzip-compressed WARC files under path, by Spark's own writer, so that lost tasks leave nothing half-written.

    Files hold fewer records where pages are large on average, so that a reading task's file stays near file_bytes.
    """
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    most = max(1, min(records_per_file, int(file_bytes / max(1.0, mean))))
    rows = planned(pages).select(record(started).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """Sort-friendly form of a URL: host labels reversed, without scheme, user, default port, www and fragment."""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url.strip().lower()
    host = re.sub(r"^www\d*\.", "", host)
    shown = f":{port}" if port not in (None, 80, 443) else ""
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{shown}){(parts.path or '/').lower()}{query}"


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of a gzip-compressed WARC file; offsets before compression.

    The file is inflated a step at a time: beside it, one record and one step are in memory.
    """
    inflate, tail = zlib.decompressobj(31), content
    held, base, at = bytearray(), 0, 0  # what is inflated and not given yet begins at `at`, byte `base` of the archive

    def more() -> bool:
        nonlocal tail, at
        if inflate.eof or not tail:
            return False
        del held[:at]
        at = 0
        held.extend(inflate.decompress(tail, CHUNK))
        tail = inflate.unconsumed_tail
        return True

    while True:
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if len(held) > at:
                    raise ValueError(f"no WARC record at byte {base}")
                return
        lines = bytes(held[at:end]).decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {base}")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = end + 4 - at
        size = block + int(head["Content-Length"]) + 4
        while len(held) - at < size:
            if not more():
                raise ValueError(f"the record at byte {base} is cut short")
        yield base, size, head, bytes(held[at + block : at + size - 4])
        at += size
        base += size


def _page(urn: str | None) -> int | None:
    return None if urn is None or urn == "<urn:page:null>" else int(urn[len("<urn:page:") : -1])


def _read(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each file's captures as one run, sorted by URL key, timestamp and page."""
    names = [x.strip().split(" ")[0] for x in RUN.split(",")]
    longs = {"page_id", "refers_to", "payload_bytes", "offset", "length"}
    for batch in files:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = []
            for offset, length, head, block in records(content.as_py()):
                kind = head["WARC-Type"]
                size, digest = len(block), hashlib.sha1(block).hexdigest()
                stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "revisit":
                    size, digest = int(head["X-Payload-Length"]), stated
                elif digest != stated:
                    raise ValueError(f"{name}: payload at byte {offset} does not have its digest")
                url = head.get("WARC-Target-URI")
                stamp = re.sub(r"\D", "", head["WARC-Date"])
                rows.append((url_key(url or ""), stamp, _page(head["WARC-Record-ID"]), url, kind, _page(head.get("WARC-Refers-To")), size, digest, name, offset, length, name))
            rows.sort(key=order)
            yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64() if n in longs else pa.string()) for i, n in enumerate(names)})


def order(row: tuple) -> tuple:
    """URL key, timestamp, page (null first), place."""
    return row[0], row[1], row[2] is not None, row[2] or 0, row[8], row[9]


class LoserTree:
    """k-way merge: inner nodes keep the loser of their match, so each row out costs one path of log2(k) matches."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [order(r[0]) if r else None for r in runs]
        self.losers = [-1] * max(1, self.k)
        winners = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.first(a, b) else (b, a)
        self.winner = winners[1] if self.k > 1 else (0 if self.k else -1)

    def first(self, a: int, b: int) -> bool:
        """Run a's head comes before run b's; ended runs come last."""
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and x <= y

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            at = self.at[run]
            yield self.runs[run][at]
            self.at[run] = at = at + 1
            self.heads[run] = order(self.runs[run][at]) if at < len(self.runs[run]) else None
            node = (run + self.k) // 2
            while node:
                other = self.losers[node]
                if self.first(other, run):
                    self.losers[node], run = run, other
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key range's pieces of sorted runs, merged."""
    runs: dict[str, list[tuple]] = {}
    schema = None
    for batch in batches:
        schema = batch.schema
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[-1], []).append(row)
    if schema is None:
        return
    # a run's rows arrive in order within a shuffle block; a file read in two tasks would give two sorted pieces
    pieces: list[list[tuple]] = []
    for run in runs.values():
        cut = [0, *(i for i in range(1, len(run)) if order(run[i]) < order(run[i - 1])), len(run)]
        pieces += [run[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    out: list[tuple] = []
    tree = LoserTree(pieces)
    for row in tree:
        out.append(row)
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def capture_index(spark: SparkSession, path: str, rows_per_range: int = 20_000) -> DataFrame:
    """The captures in the archives under path, ordered globally by URL key, timestamp and page.

    Every archive is a locally sorted run. Ranges of the whole key (a URL captured very often still splits) are
    dealt to tasks, each of which merges its pieces of all runs by a loser tree; range i's rows all come before
    range i+1's. Memory: one range's rows in a task.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    runs = saved(files.mapInArrow(_read, RUN), "warc-runs")
    ranges = max(1, -(-runs.count() // rows_per_range))
    return runs.repartitionByRange(ranges, "urlkey", "timestamp", "page_id").mapInArrow(_merge, RUN).drop("run")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Per page, as its archive gives it back. A null page_id or url is kept as such; its payload counts as any."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return capture_index(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
  SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN k.kept IS NOT NULL AND k.kept IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.kept IS DISTINCT FROM p.page_id THEN k.kept END AS refers_to
FROM p LEFT JOIN k ON p.payload_bytes >= {REVISIT_BYTES} AND p.payload_digest = k.payload_digest
"""
