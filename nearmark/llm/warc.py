"""WARC archives of pages, and capture histories merged from the archives' indexes.

Writing: one record per page, in text files whose record separator is that of WARC, so Spark writes them to any
file system; each file is one gzip stream, and offsets count its decompressed bytes. Of pages with equal payloads the
one with the largest id is a response, the others are revisits that refer to it.

Reading: every archive gives its captures as a run sorted by URL key, time and page. Runs are dealt out by ranges of that
key, a range task merges its pieces of the runs with a loser tree, and the ranges in order are the global history.

Defined results: a null payload is empty; a null URL has an empty key and no URL header; a page with a null id is a
response and refers to nothing; rows with the largest id of equal payloads that occur more than once are all responses;
control characters and blanks in URLs are written percent-encoded; an empty table gives an empty archive and no captures.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import io
import re
from collections.abc import Iterator
from typing import Any
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmark.llm.tables import few
from nearmark.session import cut, scratch_folder

RECORDS_PER_FILE = 2000
# Captures that one range task merges on average.
RANGE_ROWS = 100_000
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n"
CAPTURE = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
           "url string, url_key string, captured string, archive string, offset long")
_KEY = ["url_key", "captured", "page_id"]


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base32: five bytes are ten hexadecimal digits and eight letters."""
    hexed = F.sha1(payload)
    letters = []
    for i in range(4):
        bits = F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long")
        for j in range(8):
            at = F.shiftright(bits, 35 - 5 * j).bitwiseAND(F.lit(31)) + 1
            letters.append(F.substring(F.lit(_ALPHABET), at.cast("int"), F.lit(1)))
    return F.concat(*letters)


def _lines(*lines: Column | str) -> Column:
    return F.concat(*[F.concat(F.lit(x) if isinstance(x, str) else x, F.lit(_END)) for x in lines], F.lit(_END))


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def records(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """``value``: the text of one WARC record per page."""
    body = F.coalesce(F.col(payload), F.lit(""))
    held = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"),
                        base32_sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("bytes"))
    same = ["digest", "bytes"]
    twice = cut(held.groupBy(*same).agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where(
        "n > 1 AND original IS NOT NULL").drop("n"), "equal-payloads")
    marked = held.join(F.broadcast(twice) if few(twice) else twice, same, "left").withColumn(
        "revisit", F.coalesce(F.col("page_id") < F.col("original"), F.lit(False)))
    # Pages carry no time of their own: the capture time follows from the id.
    seconds = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2_000_000_000))
    date = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    safe = F.col("url")
    for code in [*range(0x21), 0x7F]:
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", _header("Content-Length", F.col("bytes").cast("string")))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload")))

    def urn(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    optional = F.concat(
        F.when(F.col("url").isNull(), "").otherwise(F.concat(_header("WARC-Target-URI", safe), F.lit(_END))),
        F.when(F.col("revisit"), F.concat(
            _header("WARC-Refers-To", urn("original")),
            F.lit(f"{_END}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{_END}"))).otherwise(""))
    head = F.concat(
        F.lit(f"WARC/1.1{_END}"), _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), F.lit(_END),
        optional, _lines(
            _header("WARC-Record-ID", urn("page_id")), _header("WARC-Date", date),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            "Content-Type: application/http;msgtype=response", _header("Content-Length", F.octet_length(block).cast("string"))))
    return marked.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    records(pages, key, url, payload).write.option("lineSep", _END * 2).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str | None) -> str:
    """Host labels from the right, then the rest, so that pages of a site are neighbours; no fragment, no scheme."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url
    known = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port != known else "") + ")" + (
        parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _number(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _headers(stream: io.BufferedIOBase) -> tuple[dict[str, str], int]:
    """Header lines up to the blank one, and how many bytes they took."""
    out: dict[str, str] = {}
    size = 0
    while line := stream.readline():
        size += len(line)
        line = line.rstrip(b"\r\n")
        if not line:
            break
        name, _, value = line.decode("utf-8", "surrogateescape").partition(": ")
        out[name.lower()] = value
    return out, size


def parse_archive(content: bytes, archive: str) -> Iterator[tuple[Any, ...]]:
    """Captures of one archive in file order; payload digests of responses are computed from what was read."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)), 1 << 16)
    offset = 0
    while line := stream.readline():
        start, size = offset, len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{archive}: no record at byte {offset}")
        head, more = _headers(stream)
        length = int(head["content-length"])
        block = stream.read(length)
        offset += size + more + length + len(stream.read(len(_END) * 2))
        http, _, payload = block.partition(b"\r\n\r\n")
        kind = head["warc-type"]
        if kind == "response":
            total, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if head["warc-payload-digest"] != f"sha1:{digest}":
                raise ValueError(f"{archive}: the payload at byte {start} does not have its digest")
        else:
            total = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
            digest = head["warc-payload-digest"].removeprefix("sha1:")
        url = head.get("warc-target-uri")
        yield (_number(head["warc-record-id"]), total, digest, kind, _number(head.get("warc-refers-to")), url, url_key(url),
               head["warc-date"], archive, start)


def _order(row: tuple[Any, ...]) -> tuple:
    """URL key, time, page; a null page comes first."""
    return row[6], row[7], row[0] is not None, row[0] or 0, row[8], row[9]


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CAPTURE.split(", "))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted run per archive."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            run = sorted(parse_archive(content.as_py(), path.rsplit("/", 1)[-1]), key=_order)
            if run:
                columns = zip(*run, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _schema(), strict=True)], schema=_schema())


class LoserTree:
    """Merges sorted iterators: inner nodes keep the loser of their match, so a new head replays one path to the top."""

    def __init__(self, runs: list[Iterator[tuple[tuple, Any]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads: list[tuple[tuple, Any] | None] = [next(r, None) for r in runs] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:  # the first to come waits here for its opponent
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while True:
            top = self.losers[0]
            head = self.heads[top]
            if head is None:
                return
            yield head[1]
            self.heads[top] = next(self.runs[top], None)
            self._replay(top)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the pieces of runs in one range; rows come sorted by archive and place in its run."""
    pieces: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pieces.setdefault(row[8], []).append(row)
    if not pieces:
        return
    number = TaskContext.get().partitionId()
    merged = list(LoserTree([((_order(r), r) for r in rows) for rows in pieces.values()]))
    for at in range(0, len(merged), 10_000):
        part = merged[at:at + 10_000]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), _schema(), strict=True)]
        places = pa.array(range(at, at + len(part)), pa.int64())
        yield pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(part), pa.int32()), places],
                                         [*_schema().names, "range_no", "range_place"])


def capture_history(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives in a folder; ordered by ``range_no, range_place`` they are sorted by URL key and time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = cut(files.mapInArrow(_runs, CAPTURE), "runs")
    ranges = max(1, -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(ranges, *_KEY, "archive").sortWithinPartitions("archive", *_KEY, "offset")
    return dealt.mapInArrow(_merge, f"{CAPTURE}, range_no int, range_place long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives to the shared scratch folder and give the captures that are read back."""
    path = scratch_folder(pages.sparkSession, "archives")
    write_archives(pages, path, key, url, payload)
    return capture_history(pages.sparkSession, path)
