"""WARC archives and their capture index (operator 6).

Writing: a record for each page. Of records with equal payloads of at least ``min_revisit_bytes`` bytes, the one with
the smallest page_id is a response, the others are revisits that name it and carry no payload. Smaller payloads take no part in that
join. Each record is a gzip member of its own, so its offset in the archive is where to begin reading. Members are rows of Spark's
text writer, with an empty member between them as the line separator, so archives land in any file system Spark can
write to, under its commit protocol.

Reading: archives are read back as files, member by member, and records are parsed by Content-Length. Each archive gives a run of
index entries, sorted by URL key and timestamp; runs are written once. The index is an external merge: runs are range-partitioned by URL key,
timestamp and page, into ranges of about ``merge_rows`` entries, which is what a task holds, and every range merges its parts of the k runs
with a loser tree, which gives capture histories in global order. A URL with most of the captures is split over ranges by time.

Defined results: null html is an empty payload; payloads below the size are always responses. Rows that repeat
the smallest page_id of a payload are the same capture and all responses. A null page_id is written as an empty
header field and read back as null; it comes after all others, and if only such rows hold a payload, all are responses. A null
url is written as an empty target. Timestamps are those given, or else derived from page_id, a second later for each page and beginning
again after 2**30 pages; they are written in UTC whatever the session's time zone, years 1 to 9999. Empty tables give no rows.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gyrolens.llm.common import materialise, new_path

#: Fixed values of the format.
CRLF = "\r\n"
RECORD_END = "\r\n\r\n"
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
#: Time of page 0, when pages bring no time (seconds since 1970), and the number of pages after which times begin again.
FIRST_SECOND = 1_700_000_000
PAGE_SECONDS = 1 << 30
#: Payload bytes of an archive, on average; records of a larger payload have an archive of their own or share it with few.
ARCHIVE_BYTES = 16 << 20
#: Entries of a range of the index, about.
MERGE_ROWS = 20_000
#: An empty gzip member (fixed values): its header ends a row, the rest is the line separator.
EMPTY_HEADER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff"
EMPTY_REST = "\x03\x00" + "\x00" * 8
CHUNK = 1 << 16

ENTRY_SCHEMA = "url_key string, captured long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, archive string, offset long"


def _long_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, bytes, seconds (since 1970), refers_to (null: a response)."""
    page = F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    seconds = F.unix_seconds(F.col(time_col).cast("timestamp")) if time_col else F.pmod(page, F.lit(PAGE_SECONDS)) + FIRST_SECOND
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    slim = pages.select(F.col(id_col).alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    first = slim.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).drop("n")
    whole = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"), F.coalesce(seconds, F.lit(0)).alias("seconds"))
    # Small payloads share digests by the thousand and never match, so each goes its own way.
    own_way = F.concat(F.lit("small "), F.monotonically_increasing_id().cast("string"))
    joined = whole.withColumn("key", F.when(F.col("bytes") >= min_bytes, F.col("digest")).otherwise(own_way)).join(first.withColumnRenamed("digest", "key"), "key", "left").drop("key")
    return joined.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def _utc(seconds: Column) -> Column:
    """WARC-Date of a number of seconds since 1970."""
    low, high = -62_135_596_800, 253_402_300_799
    held = F.greatest(F.least(seconds, F.lit(high)), F.lit(low))
    clock = F.pmod(held, F.lit(86_400))
    part = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    day = F.date_from_unix_date(F.floor(held / 86_400).cast("int"))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), part(F.floor(clock / 3600)), F.lit(":"), part(F.floor(F.pmod(clock, F.lit(3600)) / 60)), F.lit(":"), part(F.pmod(clock, F.lit(60))), F.lit("Z"))


def _record() -> Column:
    """The record of a row of plan_records."""
    revisit = F.col("refers_to").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda page: F.concat(F.lit("<urn:page:"), _long_or_empty(page), F.lit(">"))
    return F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", "")),
        line("WARC-Date", _utc(F.col("seconds"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("X-Payload-Bytes", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
        F.when(revisit, F.lit("")).otherwise(F.col("payload")),
        F.lit(RECORD_END),
    )


def _member(record: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(record) + pack.flush() + EMPTY_HEADER


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([pa.array([_member(r.as_buffer()) for r in batch.column(0)], pa.binary())], names=["value"])


def records_for(pages: DataFrame, payload_col: str, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Records of an archive: as many as hold so many bytes of payload on average."""
    size = pages.agg(F.avg(F.coalesce(F.octet_length(payload_col), F.lit(0))).alias("mean")).first()["mean"]
    return max(1, int(archive_bytes / (1000 + (size or 0))))  # a thousand for the headers


def write_archives(pages: DataFrame, path: str, records_a_file: int | None = None, **columns) -> None:
    """Writes a folder of archives, a gzip member for each record. columns: those of plan_records()."""
    members = plan_records(pages, **columns).select(_record().cast("binary").alias("value")).mapInArrow(_members, "value binary")
    records = records_a_file or records_for(pages, columns.get("payload_col", "html"))
    members.select(F.col("value").cast("string")).write.option("lineSep", EMPTY_REST).option("maxRecordsPerFile", records).text(path)


# Reading.


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query, in lower case; without scheme, port, www and fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url
    host = re.sub(r"^www\d*\.", "", host)
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + ")" + (parts.path.rstrip("/") or "/") + query


def read_members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member that isn't empty."""
    at, view = 0, memoryview(raw)
    while at < len(raw):
        unpack, parts, end = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if end >= len(raw):
                raise ValueError(f"the member at {at} has no end")
            parts.append(unpack.decompress(view[end : end + CHUNK]))
            end = min(end + CHUNK, len(raw))
        end -= len(unpack.unused_data)
        if content := b"".join(parts):
            yield at, content
        at = end


def parse_record(raw: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers and payload of a record."""
    head_end = raw.index(b"\r\n\r\n")
    lines = raw[:head_end].decode().split(CRLF)
    if lines[0] != VERSION:
        raise ValueError("not a record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    start = head_end + 4
    end = start + int(headers["Content-Length"])
    if raw[end:] != RECORD_END.encode():
        raise ValueError("the record has no end")
    return headers, memoryview(raw)[start:end]


def _page(urn: str | None) -> int | None:
    digits = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(digits[1]) if digits else None


def _entries(archive: str, raw: bytes) -> list[tuple]:
    """A run: an archive's index entries, sorted. Payload sizes and digests of responses are those of the bytes read."""
    run = []
    for offset, record in read_members(raw):
        h, payload = parse_record(record)
        kind, digest, size = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Bytes"])
        if kind == "response":
            found = hashlib.sha256(payload).hexdigest()
            if found != digest or len(payload) != size:
                raise ValueError(f"{archive}: the payload at {offset} is damaged")
        when = int(datetime.strptime(h["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
        run.append((url_key(h["WARC-Target-URI"]), when, _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, size, digest, _page(h.get("WARC-Refers-To")), archive, offset))
    return sorted(run, key=_order)


def _order(entry: tuple) -> tuple:
    return entry[0], entry[1], entry[2] is None, entry[2] or 0, entry[8], entry[9]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text, number = pa.string(), pa.int64()
    kinds = [text, number, number, text, text, number, text, number, text, number]
    names = [x.split()[0] for x in ENTRY_SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            if rows := _entries(path.as_py().rpartition("/")[2], content.as_py()):
                yield _batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of a folder of archives: a sorted run for each archive (see ENTRY_SCHEMA)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_parse_files, ENTRY_SCHEMA)


class LoserTree:
    """Merges k sorted runs: inner nodes hold the loser of their match, so each row takes log2(k) comparisons."""

    def __init__(self, runs: list[Iterable[tuple]], key=_order):
        self.key, self.runs = key, [iter(r) for r in runs]
        self.heads = [self._next(i) for i in range(len(runs))]
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _play(self, node: int) -> int:
        """The winner below a node; leaf i is node k + i."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        a, b = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i][1]
            self.heads[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range partition: its share of every archive's run, merged."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            runs.setdefault(row[8], []).append(row)
    for run in runs.values():  # a shuffle may hand a run over in pieces; sorting one that is sorted is linear
        run.sort(key=_order)
    block = []
    for row in LoserTree(list(runs.values())):
        block.append(row)
        if len(block) == 4096:
            yield _batch(block)
            block = []
    if block:
        yield _batch(block)


def merge_index(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All runs as one index, ordered over and within partitions: capture histories by URL key and time."""
    place = ["url_key", "captured", F.col("page_id").asc_nulls_last(), "archive", "offset"]
    ranges = max(1, -(-runs.count() // merge_rows))
    return runs.repartitionByRange(ranges, *place).mapInArrow(merge_runs, ENTRY_SCHEMA)


def warc_index(pages: DataFrame, path: str | None = None, merge_rows: int = MERGE_ROWS, **options) -> DataFrame:
    """Writes pages as archives (in the shared folder by default), reads them back and merges the index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(pages, path, **options)
    return merge_index(materialise(read_archives(spark, path), "runs"), merge_rows)
