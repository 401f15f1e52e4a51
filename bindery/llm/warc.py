"""WARC archives with revisit records, and a merged capture index.

Writing: each row becomes one WARC/1.1 record. Of records with equal payloads (by SHA-1 and
length) of at least ``min_bytes`` bytes, the one with the largest id is a response, the
others are revisits that refer to it and carry no payload. Records end with two line breaks,
so Spark's text sink, with those as its line separator, writes well-formed archives through
its own commit protocol to any file system. The records of a file are so many that even
records of the largest payload keep it below ``FILE_BYTES``, if not below 16 of them.

Reading: each archive is parsed as a stream, record by record, by its declared lengths,
response payloads are checked against their digests, and the captures of one archive form
one run, sorted by URL key, timestamp, id, file and offset. Merging: runs are dealt out by
ranges of that order; within a range a loser tree merges the runs' stretches, held as Arrow
columns and read row by row, so partitions in order give the globally ordered capture
history. A range holds about ``RANGE_ROWS`` captures, also where one host, one URL or one
page holds most of them, as the order ends with the place in the archives.

Defined cases: null html is an empty payload; a null URL is written as ``urn:page:<id>``;
a null id is written as ``urn:page:`` and read back as null, and never is the response of
equal payloads unless all are null; repeated rows give a record each, those with the
largest id all being responses; captures that tie in key, time and id follow their places
in the archives; very long payloads make records of their own length; an empty table gives
an empty result; extra columns are not carried.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from base64 import b32encode
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.storage import discard, materialize, shared_dir

MIN_BYTES = 0
#: Records of a file at most, bytes of a file before compression, and of a record's heads.
RECORDS_PER_FILE = 5000
FILE_BYTES = 1 << 30
RECORD_BYTES = 2048
RANGE_ROWS = 200_000
#: Captures without a time of their own: seconds from this moment (2024-01-01) by id.
EPOCH = 1704067200
BREAK = "\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "urlkey string, timestamp string, page_id long, record_type string, payload_bytes long, "
    "payload_digest string, refers_to long, file string, offset long, length long"
)
ORDER = ["urlkey", "timestamp", "page_id", "file", "offset"]


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, from groups of five hexadecimal digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payloads(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(digest, bytes, top): the largest id of equal payloads, as a written table."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(page_id).cast("long").alias("id"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("digest"),
    )
    return materialize(keyed.groupBy("digest", "bytes").agg(F.max("id").alias("top")), "payloads")


def records(pages: DataFrame, first: DataFrame, page_id: str, url: str, html: str, min_bytes: int) -> DataFrame:
    """(value): each row as the text of one WARC record, without its end."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    keyed = pages.select(
        F.col(page_id).cast("long").alias("id"),
        F.col(url).cast("string").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("bytes"),
        base32_sha1(payload).alias("digest"),
    )
    met = keyed.join(first, ["digest", "bytes"]).withColumn(
        "revisit", (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("top"))
    )
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    seconds = F.lit(EPOCH) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(31_536_000))
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    target = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), urn(F.col("id")))
    head = F.concat_ws(
        BREAK,
        F.lit("HTTP/1.1 200 OK"),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.col("bytes")),
        F.lit(BREAK),
    )
    block = F.when(F.col("revisit"), head).otherwise(F.concat(head, F.col("payload")))
    return met.withColumn("block", block).select(
        F.concat_ws(
            BREAK,
            F.lit("WARC/1.1"),
            F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
            F.concat(F.lit("WARC-Record-ID: <"), urn(F.col("id")), F.lit(">")),
            F.concat(F.lit("WARC-Date: "), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            F.concat(F.lit("WARC-Target-URI: "), target),
            F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
            F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <"), urn(F.col("top")), F.lit(">"))),
            F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
            F.lit("Content-Type: application/http; msgtype=response"),
            F.concat(F.lit("Content-Length: "), F.octet_length("block")),
            F.concat(F.lit(BREAK), F.col("block")),
        ).alias("value")
    )


def write_archives(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_bytes: int = MIN_BYTES,
) -> None:
    """Write the rows to gzipped WARC files in the folder ``path``.

    Small records share files by their number; those over a file's bytes by that number go
    into files of their own, by doubling sizes, so one large page makes no others' files small
    and no file is over its bytes unless one record is."""
    first = payloads(pages, page_id, html)
    share = FILE_BYTES // RECORDS_PER_FILE
    held = F.col("bytes") + RECORD_BYTES
    kind = F.when(held <= share, 0).otherwise(F.ceil(F.log2(held / share))).cast("int")
    kinds = [r["k"] for r in first.select(kind.alias("k")).distinct().orderBy("k").collect()]
    for k in kinds or [0]:
        (
            records(pages, first.filter(kind == k), page_id, url, html, min_bytes)
            .write.mode("append")
            .option("lineSep", END.decode())
            .option("compression", "gzip")
            .option("maxRecordsPerFile", max(1, FILE_BYTES // (share << k)))
            .text(path)
        )
    discard(first)


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, then port, path and query; no fragment."""
    scheme, mark, rest = url.partition("://")
    if not mark:
        return url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, tail = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    name, _, port = host.rpartition(":") if re.search(r":\d*$", host) and not host.endswith("]") else (host, "", "")
    labels = [name] if name.startswith("[") else name.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    own = f":{port}" if port and (scheme.lower(), port) not in (("http", "80"), ("https", "443")) else ""
    return f"{','.join(reversed(labels))}{own}){tail}"


def _id_of(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(digits) if digits else None


def parse_archive(data: bytes, name: str) -> Iterator[tuple]:
    """Index rows of an archive in file order; ``offset`` is in its uncompressed bytes."""
    raw = io.BytesIO(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == b"\x1f\x8b" else raw
    at = 0
    while head_bytes := _header(stream):
        version, *fields = head_bytes.decode("utf-8").split(BREAK)
        if not version.startswith("WARC/"):
            raise ValueError(f"{name}: no record at {at}")
        head = {k.lower(): v for k, _, v in (f.partition(": ") for f in fields)}
        length = int(head["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(len(END)) != END:
            raise ValueError(f"{name}: the record at {at} does not end after {length} bytes")
        inner = block.index(END) + len(END)
        http = dict(f.partition(": ")[::2] for f in block[:inner].decode("utf-8").split(BREAK) if ": " in f)
        size, digest = int(http["Content-Length"]), head["warc-payload-digest"].removeprefix("sha1:")
        kind = head["warc-type"]
        if kind == "response":
            payload = memoryview(block)[inner:]
            if len(payload) != size or b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{name}: the payload of the record at {at} does not match its digest")
        stamp = "".join(c for c in head["warc-date"] if c.isdigit())
        whole = len(head_bytes) + length + 2 * len(END)
        yield (
            url_key(head["warc-target-uri"]), stamp, _id_of(head["warc-record-id"]), kind, size, digest,
            _id_of(head.get("warc-refers-to")), name, at, whole,
        )
        at += whole


def _header(stream) -> bytes:
    """The lines before the next empty one, without the breaks at their end; empty at the end."""
    found = []
    while (line := stream.readline()) not in (b"", BREAK.encode()):
        found.append(line)
    return b"".join(found).removesuffix(BREAK.encode())


def _key(row: tuple) -> tuple:
    return row[0], row[1], -(2**63) if row[2] is None else row[2], row[7], row[8]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


_SCHEMA = pa.schema(
    [
        ("urlkey", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
        ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
    ]
)


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives below ``path`` as index rows, each archive's rows a sorted run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                rows = sorted(parse_archive(content.as_py(), name.as_py()), key=_key)
                for at in range(0, len(rows), 10_000):
                    yield _table(rows[at : at + 10_000], _SCHEMA)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, INDEX)


class LoserTree:
    """k-way merge: inner nodes hold the loser of their match, the root's winner leaves."""

    def __init__(self, runs: Iterable[Iterable[tuple]], key):
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = max(1, len(self.runs))
        self.heads = [self._next(r) for r in range(len(self.runs))]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.runs else -1

    def _next(self, run: int):
        row = next(self.runs[run], None)
        return None if row is None else (self.key(row), run, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            one = self.winner
            yield self.heads[one][2]
            self.heads[one] = self._next(one)
            node = (one + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], one):
                    one, self.losers[node] = self.losers[node], one
                node //= 2
            self.winner = one


def _rows(parts: list[pa.RecordBatch]) -> Iterator[tuple]:
    for part in parts:
        for at in range(0, part.num_rows, 1000):
            yield from zip(*(c.to_pylist() for c in part.slice(at, 1000).columns))


def merge_runs(runs: DataFrame) -> DataFrame:
    """Runs -> the capture history: partitions in order, and rows in order within each."""
    rows = runs.count()
    spark = runs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The stretch of one file is slices of consecutive batches, kept as columns.
        stretches: dict[str, list[pa.RecordBatch]] = {}
        for batch in batches:
            files = batch.column(7).to_pylist()
            cuts = [0, *(k for k in range(1, len(files)) if files[k] != files[k - 1]), len(files)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    stretches.setdefault(files[a], []).append(batch.slice(a, b - a))
        ready: list[tuple] = []
        for row in LoserTree(map(_rows, stretches.values()), _key):
            ready.append(row)
            if len(ready) == 10_000:
                yield _table(ready, _SCHEMA)
                ready = []
        if ready:
            yield _table(ready, _SCHEMA)

    dealt = runs.repartitionByRange(ranges, *ORDER).sortWithinPartitions("file", *ORDER[:3], "offset")
    return dealt.mapInArrow(merge, INDEX)


def op5_warc(spark, sf_dir) -> DataFrame:
    """All pages written to archives, read back and merged into one capture history."""
    path = shared_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    history = merge_runs(materialize(capture_runs(spark, path), "capture-runs"))
    return history.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp"
    )


ORACLE = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT *, array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform(range(4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (1 + 5 * k)::BIGINT, 5))::BIGINT >> (15 - 5 * j)::BIGINT) & 31) + 1)::BIGINT, 1)), '')), '') AS payload_digest
  FROM p
), w AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top FROM d),
u AS (
  SELECT *, string_split(regexp_replace(url, '^[^:]*://', ''), '#')[1] AS rest,
    strftime(make_timestamp((1704067200 + page_id % 31536000) * 1000000), '%Y%m%d%H%M%S') AS timestamp FROM w
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
  array_to_string(list_reverse(list_filter(string_split(regexp_extract(rest, '^[^/?]*'), '.'), lambda x: x <> 'www')), ',') || ')'
    || coalesce(nullif(regexp_replace(rest, '^[^/?]*', ''), ''), '/') AS urlkey,
  timestamp
FROM u
"""
