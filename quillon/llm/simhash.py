"""SimHash: hashed word shingles, weighted by 1 + ln(count), vote on the signed bits of a fingerprint.

Fingerprints within a Hamming radius are found by permuted block tables: each table keys the
different fingerprints by some of their blocks, and those that share a key are compared in blocks of
bounded size, so a key that very many share is spread over tasks. A pair counts in its first table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import U64, arrow_schema, batched, discard, grouped, hash_words, materialise, mix, partitions, record_batch

BITS, SHINGLE = 256, 3
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
_NONE = -(1 << 63)
#: Within 7 of 256 bits a likeness is 0.996 or more; then one of 8 blocks of 32 bits is equal, and chance seldom shares one.
RADIUS = 7
#: Fingerprints of a key that meet in one task, and bytes of results and keys that are broadcast.
BLOCK, BROADCAST_BYTES = 2048, 8 << 20


def fingerprint(text: str | None) -> np.ndarray:
    """The BITS / 8 bytes of a text's fingerprint; all zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(BITS // 8, dtype=np.uint8)
    h = hash_words(words)
    n = min(SHINGLE, len(h))
    m = len(h) - n + 1
    with np.errstate(over="ignore"):
        terms = np.zeros(m, dtype=U64)
        for i in range(n):
            terms = terms * U64(0x9E3779B97F4A7C15) + h[i : i + m]
        terms, counts = np.unique(terms, return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        votes = np.zeros(BITS, dtype=np.float64)
        for a in range(0, len(terms), 4096):
            part = terms[a : a + 4096]
            wide = np.stack([mix(part, s) for s in _SEEDS], axis=1)
            bits = np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)
            w = weights[a : a + 4096]
            votes += 2 * (w @ bits).astype(np.float64) - float(w.sum())
    return np.packbits(votes > 0)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of the angle that the share of differing bits stands for; 0 from a right angle on."""
    return max(0.0, float(np.cos(np.pi * int(np.unpackbits(a ^ b).sum()) / BITS)))


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches):
    schema = arrow_schema(_EDITS)
    held = None  # the row before, whose next document is yet to come
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("pid", "sentinel", "doc_id", "text")]
        for pid, sentinel, doc_id, text in zip(*cols, strict=True):
            text = text or ""
            prints = fingerprint(text)
            if held is not None and held[0] == pid:
                _, before, was, own = held
                new = edited(was, text)
                changed = fingerprint(new)
                out.append((before, len(was), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, prints)))
            held = None if sentinel else (pid, doc_id, text, prints)
        if out:
            yield record_batch(schema, *map(list, zip(*out, strict=True)))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    docs has doc_id and text. Documents are ordered by doc_id (null first), equal ids by text; the
    last one's next is the first, and a single document's is itself. A null text counts as empty.
    Ids are cut into ranges, and the first document of each range also closes the range before,
    so a text is shuffled once.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_NONE)).alias("key"))
    n = partitions(spark)
    bounds = np.array(sorted(set(docs.approxQuantile("key", [i / n for i in range(1, n)], 0.001))) if n > 1 else [])

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype("int32"))

    cut = docs.withColumn("pid", range_of("key"))
    heads = sorted(tuple(r) for r in docs.select("key").withColumn("pid", range_of("key")).groupBy("pid").agg(F.min("key")).collect())
    firsts = [(heads[i - 1][0], key) for i, (_, key) in enumerate(heads)]  # one row a range; the first closes the last
    close = spark.createDataFrame(firsts, "close int, first long")
    sentinels = docs.join(F.broadcast(close), docs.key == close["first"]).groupBy("close", "key").agg(F.min(F.struct(F.col("text").isNotNull(), "text"))["text"].alias("text"))  # null comes first
    both = cut.select("pid", F.lit(False).alias("sentinel"), "key", "doc_id", "text").unionByName(sentinels.select(F.col("close").alias("pid"), F.lit(True).alias("sentinel"), "key", F.lit(None).cast("long").alias("doc_id"), "text"))
    return both.repartition(n, "pid").sortWithinPartitions("pid", "sentinel", "key", "text").drop("key").mapInArrow(_compare, _EDITS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint (lowercase hex) of every row; a null text counts as empty."""

    @F.pandas_udf("string")
    def hexed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fingerprint(t).tobytes().hex())

    return docs.select("doc_id", hexed("text").alias("fingerprint"))


def _neighbours(tables: list[tuple[int, ...]], cuts: list[int], radius: int):
    """(fingerprint, other documents near it) of the fingerprints of a key, or of a pair of its blocks."""

    def near(table, i, j, rows):
        bits = np.frombuffer(b"".join(r["print"] for r in rows), np.uint8).reshape(len(rows), BITS // 8)
        wide, block = bits.view(U64), np.array([r["block"] for r in rows])
        copies = np.array([r["copies"] for r in rows], dtype=np.int64)
        nibbles = np.stack([bits >> 4, bits & 15], axis=2).reshape(len(rows), -1)
        for a in range(0, len(rows), 256):
            part = slice(a, a + 256)
            close = sum(np.bitwise_count(wide[part, None, k] ^ wide[None, :, k]).astype(np.int16) for k in range(BITS // 64)) <= radius
            close[np.arange(len(close)), np.arange(a, a + len(close))] = False
            if i != j:
                close &= block[part, None] != block[None, :]
            x, y = np.nonzero(close)
            same = np.stack([(nibbles[a + x, c:d] == nibbles[y, c:d]).all(axis=1) for c, d in zip(cuts, cuts[1:], strict=False)]) if len(x) else np.zeros((len(cuts) - 1, 0), bool)
            met = np.zeros(len(x), dtype=bool)
            for earlier in tables[:table]:
                met |= same[list(earlier)].all(axis=0)
            n = np.bincount(x[~met], copies[y[~met]], len(close)).astype(np.int64)
            yield from ((rows[a + k]["print"], int(n[k])) for k in np.flatnonzero(n))

    def run(batches):
        groups = grouped(batches, "table", "key", "i", "j")
        yield from batched("print binary, near long", (x for (table, _, i, j), rows in groups if len(rows) > 1 for x in near(table, i, j, rows)))

    return run


def near_counts(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """fingerprint and n_near of those that have other documents within the radius.

    prints has fingerprint (hex), a row for each document; n_near counts its other documents and all of
    other fingerprints within the Hamming radius. The bits are cut into `blocks` blocks (radius + 1 by
    default, each of whole hex digits). Two fingerprints within the radius agree on at least
    blocks - radius of them, so each choice of so many blocks is a table keyed by them, and none is
    missed. Rows with a null fingerprint count nowhere. Only counts leave the tasks, never pairs.
    """
    blocks = blocks or radius + 1
    if not radius < blocks <= BITS // 4:
        raise ValueError("more blocks than the radius are needed, of a hex digit each at least")
    spark, digits = prints.sparkSession, BITS // 4
    classes = prints.where(F.col("fingerprint").isNotNull()).groupBy(F.unhex("fingerprint").alias("print")).agg(F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "prints")
    cuts = [i * digits // blocks for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))
    text = F.hex("print")
    part = [F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(F.lit(t), *[part[i] for i in chosen]).alias("key")) for t, chosen in enumerate(tables)])
    keyed = classes.select("print", "copies", F.explode(keys).alias("at")).select("at.*", "print", "copies")
    shared = materialise(keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "keys")
    few = shared.count() * 24 <= BROADCAST_BYTES
    met = keyed.join(F.broadcast(shared) if few else shared, ["table", "key"])
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    own = met.withColumn("block", F.pmod(F.xxhash64("print", "key"), count).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), count - 1)))
    own = own.select("table", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "print", "copies")
    by = ["table", "key", "i", "j"]
    found = own.repartition(partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(_neighbours(tables, cuts, radius), "print binary, near long")
    near = found.groupBy("print").agg(F.sum("near").alias("near"))
    counts = classes.join(near, "print", "left").select("print", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")).where("n_near > 0")
    counts = materialise(counts.select(F.lower(F.hex("print")).alias("fingerprint"), "n_near"), "near")
    discard(classes)
    discard(shared)
    return counts


def edits_and_neighbours(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """edit_likeness, with n_near: the other documents whose fingerprint is within the radius of the document's own.

    Documents with equal fingerprints are near each other; those without words all have the same one.
    """
    told = materialise(edit_likeness(docs), "fingerprints")
    near = near_counts(told.select("fingerprint"), radius)
    near = F.broadcast(near) if near.count() * 80 <= BROADCAST_BYTES else near
    return told.join(near, "fingerprint", "left").select(*told.columns, F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))
