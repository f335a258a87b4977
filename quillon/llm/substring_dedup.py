"""Removal of repeated passages: Rabin-Karp hashes of every window of `width` words, counted in Spark.

Each scan task hashes the windows of a stretch of documents, keeps the earliest of equal ones and
deals the rest into hash buckets, a few bytes a window. A bucket's group finds the windows that
also start earlier; their starts, dealt by document into a row for each range of document hashes,
merge into maximal intervals.
A hot passage reaches its bucket once for each stretch, whatever the number of its copies.

A window is told by 56 bits of one hash, 32 of a second and its bucket, which comes of the other 32:
100 bits or so. Words are not compared, so of n windows about n * n / 2^101 pairs are taken for equal
that aren't: 2e-11 at 30 GB of text (5e9 windows), under one in a thousand at 100 TB. The number of
buckets follows the number of words, so a bucket's group stays as large as it is.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow_schema, hash_words, materialise, mix, partitions, record_batch, texts

WIDTH = 20
#: Odd bases of the two rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Characters of text for each hash bucket, some million windows.
BUCKET_CHARS = 6_000_000
#: Removal intervals up to this size are broadcast; beyond it the texts are shuffled to them.
BROADCAST_BYTES = 16 << 20
_NONE = np.iinfo(np.int64).min
_BLOB = "bucket int, hashes binary, checks binary, starts binary, wide boolean, ids binary, runs binary"


def rolling(w: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp hash modulo 2^64 of each window: sum of w[i + k] * base^(width - 1 - k)."""
    n = len(w)
    if n < width:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        back = np.concatenate([[U64(1)], np.cumprod(np.full(n, pow(base, -1, 1 << 64), dtype=U64))])
        forth = np.concatenate([[U64(1)], np.cumprod(np.full(n + width, base, dtype=U64))])
        sums = np.concatenate([[U64(0)], np.cumsum(w * back[:n])])
        return (sums[width:] - sums[:-width]) * forth[width - 1 : n]


def _stretches(lists, width):
    """Per stretch, in order of doc_id: ids, first word of each document, and hashes, document and start of the windows."""
    for ids, rows in lists:
        ids = np.array([_NONE if x is None else x for x in ids], dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        words = [(rows[i] or "").encode("utf-8", "surrogatepass").split() for i in order]
        sizes = np.array([len(x) for x in words], dtype=np.int64)
        w = hash_words([x for ws in words for x in ws])
        first = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(len(w)) - first[doc]
        fits = np.flatnonzero(start + width <= sizes[doc]) if len(w) else np.zeros(0, dtype=np.int64)
        if len(fits):
            a, b = (mix(rolling(w, width, base)[fits], base) for base in BASES)
            yield ids[order], a, b, doc[fits], start[fits]


def _blob(bucket, hashes, checks, ids, starts):
    cuts = np.flatnonzero(np.diff(ids)) + 1
    at = np.concatenate([[0], cuts]).astype(np.int64)
    runs = np.diff(np.concatenate([at, [len(ids)]])).astype(np.uint32)
    wide = bool(len(starts)) and int(starts.max()) > 0xFFFF
    return bucket, hashes, checks, starts.astype(np.uint32 if wide else np.uint16).tobytes(), wide, ids[at].tobytes(), runs.tobytes()


def _dealer(width: int, buckets: int):
    schema = arrow_schema(_BLOB)

    def deal(batches):
        for ids, a, b, doc, start in _stretches(texts(batches, "doc_id", "text"), width):
            _, first, inverse = np.unique(a, return_index=True, return_inverse=True)
            lead = first[inverse]
            twin = b[lead] == b
            earlier = twin & ((ids[doc[lead]] < ids[doc]) | ((ids[doc[lead]] == ids[doc]) & (start[lead] < start)))
            bucket = ((b >> U64(32)) % U64(buckets)).astype(np.int64)
            out = []
            if earlier.any():
                out.append(_blob(int(bucket[0]), b"", b"", ids[doc[earlier]], start[earlier]))
            first = np.sort(np.concatenate([first, np.flatnonzero(~twin)]))
            to = bucket[first]
            order = np.argsort(to, kind="stable")
            ends = np.searchsorted(to[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(ends)):
                i = first[order[ends[k] : ends[k + 1]]]
                out.append(_blob(int(k), a[i].view(np.uint8).reshape(-1, 8)[:, :7].tobytes(), b[i].astype(np.uint32).tobytes(), ids[doc[i]], start[i]))
            yield record_batch(schema, *map(list, zip(*out, strict=True)))

    return deal


def _read(blob):
    ids = np.repeat(np.frombuffer(blob["ids"], np.int64), np.frombuffer(blob["runs"], np.uint32))
    starts = np.frombuffer(blob["starts"], np.uint32 if blob["wide"] else np.uint16).astype(np.int64)
    seven = np.frombuffer(blob["hashes"], np.uint8).reshape(-1, 7)
    hashes = np.zeros((len(seven), 8), np.uint8)
    hashes[:, :7] = seven
    return ids, starts, hashes.view(np.uint64).ravel(), np.frombuffer(blob["checks"], np.uint32)


_FOUND = "deal int, ids binary, runs binary, starts binary"


def _find(group: pa.Table, buckets: int) -> pa.Table:
    """The windows of a bucket that start earlier too, a row for all documents of a deal."""
    done, ids, starts, hashes, checks = [], [], [], [], []
    for batch in group.to_batches():
        for blob in batch.to_pylist():
            i, s, h, g = _read(blob)
            if len(h):
                ids.append(i), starts.append(s), hashes.append(h), checks.append(g)
            else:
                done.append((i, s))
    if hashes:
        h, g, i, s = map(np.concatenate, (hashes, checks, ids, starts))
        order = np.argsort(h)
        same = h[order][1:] == h[order][:-1]
        twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        order = twice[np.lexsort((s[twice], i[twice], g[twice], h[twice]))]
        h, g, i, s = h[order], g[order], i[order], s[order]
        if len(h):
            other = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
            lead = np.maximum.accumulate(np.where(other, np.arange(len(h)), 0))
            late = (i > i[lead]) | (s > s[lead])
            done.append((i[late], s[late]))
    i = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in done)])
    s = np.concatenate([np.zeros(0, np.int64), *(x for _, x in done)])
    deal = (mix(i.view(U64), BASES[1]) % U64(buckets)).astype(np.int64)
    order = np.lexsort((s, i, deal))
    deal, i, s = deal[order], i[order], s[order].astype(np.uint32)
    rows = []
    for j in np.split(np.arange(len(i)), np.flatnonzero(np.diff(deal)) + 1):
        if len(j):
            ids, runs = np.unique(i[j], return_counts=True)
            rows.append((int(deal[j[0]]), ids.tobytes(), runs.astype(np.uint32).tobytes(), s[j].tobytes()))
    schema = arrow_schema(_FOUND)
    return pa.Table.from_batches([record_batch(schema, *map(list, zip(*rows, strict=True)))] if rows else [], schema)


def _merge(group: pa.Table, width: int) -> pa.Table:
    """The maximal intervals of a deal's documents."""
    ids, starts = [], []
    for batch in group.to_batches():
        for r in batch.to_pylist():
            ids.append(np.repeat(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["runs"], np.uint32)))
            starts.append(np.frombuffer(r["starts"], np.uint32))
    i, s = np.concatenate(ids), np.concatenate(starts).astype(np.int64)
    order = np.lexsort((s, i))
    i, s = i[order], s[order]
    first = np.concatenate([[True], i[1:] != i[:-1]])
    at = np.flatnonzero(first | np.concatenate([[True], s[1:] > s[:-1] + width]))
    spans = np.stack([s[at], s[np.concatenate([at[1:], [len(s)]]) - 1] + width], axis=1).astype(np.uint32)
    docs = np.flatnonzero(first[at])
    out = [x.tobytes() for x in np.split(spans, docs[1:])]
    return pa.table({"doc_id": pa.array([None if x == _NONE else int(x) for x in i[at[docs]]], pa.int64()), "spans": pa.array(out, pa.binary())})


def removal_intervals(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and its maximal removal intervals (pairs of word numbers, end exclusive, unsigned 32-bit).

    docs has doc_id and text. A null text has no words; a null doc_id comes before all others. Of
    rows that share a doc_id none is earlier than the other, and what is removed in one is removed
    in each. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-chars // BUCKET_CHARS))
    blobs = docs.mapInArrow(_dealer(width, buckets), _BLOB)

    def find(group: pa.Table) -> pa.Table:
        return _find(group, buckets)

    def merge(group: pa.Table) -> pa.Table:
        return _merge(group, width)

    return blobs.groupBy("bucket").applyInArrow(find, _FOUND).groupBy("deal").applyInArrow(merge, "doc_id long, spans binary")


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _cutter(keep_text: bool):
    schema = arrow_schema(_KEPT if keep_text else _KEPT.replace("kept_text", "kept_sha256"))

    def cut(batches):
        for ids, spans, rows in texts(batches, "doc_id", "spans", "text"):
            n_words, n_removed, out = [], [], []
            for span, text in zip(spans, rows, strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(words))
                if span:
                    drop = np.zeros(len(words) + 1, dtype=bool)
                    for a, b in np.frombuffer(span, np.uint32).reshape(-1, 2):
                        drop[a:b] = True
                    words = [w for w, x in zip(words, drop, strict=False) if not x]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                out.append(kept.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(kept).hexdigest())
            yield record_batch(schema, ids, n_words, n_removed, out)

    return cut


def dedup_passages(docs: DataFrame, width: int = WIDTH, keep_text: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed and kept_text, or its kept_sha256 without keep_text.

    See removal_intervals for nulls, repeated rows and extra columns.
    """
    spans = materialise(removal_intervals(docs, width), "spans")
    size = spans.agg(F.sum(F.octet_length("spans") + 24)).first()[0] or 0
    spans = F.broadcast(spans) if size <= BROADCAST_BYTES else spans
    docs = docs.select("doc_id", "text")
    joined = docs.join(spans.withColumnRenamed("doc_id", "__id"), docs.doc_id.eqNullSafe(F.col("__id")), "left")
    return joined.select("doc_id", "spans", "text").mapInArrow(_cutter(keep_text), _KEPT if keep_text else _KEPT.replace("kept_text", "kept_sha256"))
