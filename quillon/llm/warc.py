"""WARC archives: written as text with Spark's writer, read back, and indexed by an external merge.

A payload that an earlier capture has already is written as a revisit record without a body. The
archive files are plain WARC/1.1, records ended by two line ends, on any storage that Spark reaches.
A file has at most FILE_BYTES, and more only if it is a single record.

The index: each file's captures are a sorted run, kept in the shared folder. Ranges of about
RANGE_ROWS captures, cut on a key that no two captures share, are dealt to tasks, and each merges its
pieces of the runs by a loser tree. So a task holds one range, whatever the number of captures of a URL.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import arrow_schema, batched, materialise, new_path, partitions, record_batch

_END = "\r\n\r\n"
#: Bytes of an archive file, but for a single record that is larger; it is one cell as it is written and read.
FILE_BYTES = 16 << 20
#: First captures of payloads that occur again are broadcast up to so many bytes.
BROADCAST_BYTES = 16 << 20
#: Captures of a range of the index, about.
RANGE_ROWS = 50_000
#: Captures without a time of their own are dated this epoch second plus their page_id, as far as years have four digits.
EPOCH, LAST = 1_600_000_000, 253_402_300_799
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: reversed host, then path and query, in lower case."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname or ""
    except ValueError:
        return (url or "").lower()
    return (",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")).lower()


def _date(page_id: int | None) -> str:
    return datetime.fromtimestamp(EPOCH + (page_id or 0) % (LAST - EPOCH), timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", "%20", url or "")


def _record_id(page_id: int | None, sha1: str, url: str | None) -> str:
    own = f"{'' if page_id is None else page_id} {sha1} {url or ''}".encode("utf-8", "surrogatepass")
    return f"<urn:md5:{hashlib.md5(own).hexdigest()}>"


def _record(page_id, url, html, sha1, size, first_id, first_url) -> str:
    """A record without its end; first_id: the response's page_id if this is a revisit."""
    revisit = first_id is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, sha1, url)}", f"WARC-Date: {_date(page_id)}", f"WARC-Target-URI: {_target(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"X-Payload-Length: {size}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(first_id, sha1, first_url)}", f"WARC-Refers-To-Target-URI: {_target(first_url)}", f"WARC-Refers-To-Date: {_date(first_id)}", f"X-Refers-To-Page-ID: {first_id}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else size}"]
    return "\r\n".join(head) + _END + ("" if revisit else html)


_COLUMNS = ("page_id", "url", "html", "sha1", "payload_bytes", "first_id", "first_url")


def _files(file_bytes: int):
    """Whole archive files, a row each, but for the end of the last record."""
    schema = arrow_schema("value string")

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in _COLUMNS), strict=True):
                record = _record(*(x.as_py() for x in row))
                own = len(record.encode("utf-8", "surrogatepass")) + len(_END)
                if held and size + own > file_bytes:
                    yield record_batch(schema, [_END.join(held)])
                    held, size = [], 0
                held.append(record)
                size += own
        if held:
            yield record_batch(schema, [_END.join(held)])

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """One record per row of pages (page_id, url, html; null html is an empty payload) under path.

    Of equal payloads of at least min_bytes, the row with the smallest page_id (null last) is a
    response; rows with other ids are revisits of it. Repeated rows get a record each. Other
    columns are ignored; an empty table makes an empty archive. Digests are taken in the JVM.
    """
    html = F.coalesce("html", F.lit(""))
    found = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("payload_bytes"))
    least = F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url")))
    first = found.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha1").agg(least.alias("first"), F.count(F.lit(1)).alias("n"))
    # only payloads that occur twice need their first; a null id may repeat one that occurs once beside it
    again = found.where(F.col("page_id").isNull()).select("sha1").distinct().withColumn("null_too", F.lit(True))
    first = materialise(first.join(again, "sha1", "left").where("n > 1 or null_too").select("sha1", "first"), "first")
    size = first.agg(F.sum(F.octet_length("first.url") + 100)).first()[0] or 0
    # beyond the bound payloads are shuffled; rows of a hot one are many on one side only, which AQE splits
    both = found.join(F.broadcast(first) if size <= BROADCAST_BYTES else first, "sha1", "left")
    revisit = ~F.col("first.page_id").eqNullSafe(F.col("page_id"))
    rows = both.select("page_id", "url", "html", "sha1", "payload_bytes", F.when(revisit, F.col("first.page_id")).alias("first_id"), F.when(revisit, F.col("first.url")).alias("first_url"))
    rows.mapInArrow(_files(file_bytes), "value string").write.option("lineSep", _END).option("maxRecordsPerFile", 1).text(path)


def parse(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers (names in lower case) and payload of each record of an archive file."""
    data, at = bytes(data), 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:] if ": " in x)
        head = {k.lower(): v for k, v in head.items()}
        size = int(head.get("content-length", 0))
        stop = end + 4 + size
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} isn't ended where its length says")
        yield at, stop + 4 - at, head, data[end + 4 : stop]
        at = stop + 4


_CAPTURES = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, url_key string, timestamp string, file string, at long, length long"


def _captures(batches):
    schema = arrow_schema(_CAPTURES)
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
            run = []
            for at, length, head, payload in parse(data.as_buffer()):
                kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest(payload) != said:
                    raise ValueError(f"{path}: the record at {at} has another digest")
                size = len(payload) if kind == "response" else int(head["x-payload-length"])
                page, refers, url = head.get("x-page-id"), head.get("x-refers-to-page-id"), head.get("warc-target-uri", "")
                run.append((page and int(page), size, said, kind, refers and int(refers), url, url_key(url), re.sub(r"\D", "", head["warc-date"]), path, at, length))
            if run:
                run.sort(key=_order)
                yield record_batch(schema, *map(list, zip(*run, strict=True)))


def _order(r) -> tuple:
    return r[6], r[7], r[0] is None, r[0] or 0, r[8], r[9]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of the archive files under path, one run per file, sorted by URL key and time.

    A response's digest is computed anew and held against its header.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_captures, _CAPTURES)


class LoserTree:
    """k-way merge of sorted iterators: one path of comparisons, from leaf to root, for each item."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.heads = [None] * self.k
        for i in range(len(runs)):
            self._advance(i)
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _advance(self, i: int) -> None:
        item = next(self.runs[i], None)
        self.heads[i] = None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self.tree[node] == -1:  # the first to come waits for its rival
                self.tree[node] = winner
                return
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.runs and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield self.heads[winner][2]
            self._advance(winner)
            self._play(winner)


def _merge(batches):
    """The runs' pieces of one key range, each in its order, merged."""
    runs: dict[str, list] = {}
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            runs.setdefault(r[8], []).append(r)
    yield from batched(_CAPTURES, LoserTree([iter(x) for x in runs.values()], _order))


def capture_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Captures in global order of URL key, time, page_id, file and place, over partitions that follow on each other.

    Ranges are cut on all five, which no two captures share, so a URL or a page with very many
    captures spans several; there are as many as the captures need. Each task merges what the
    sorted runs hold of its range by a loser tree.
    """
    runs = materialise(captures, "runs")
    n = max(partitions(captures.sparkSession), -(-runs.count() // range_rows))
    page = F.col("page_id").asc_nulls_last()
    return runs.repartitionByRange(n, "url_key", "timestamp", page, "file", "at").sortWithinPartitions("file", "url_key", "timestamp", page, "at").mapInArrow(_merge, _CAPTURES)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages written as archives in the shared folder and read back through the merged capture index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return capture_index(read_archives(spark, path))


__all__ = ["LoserTree", "archive_round_trip", "capture_index", "digest", "parse", "read_archives", "url_key", "write_archives"]
