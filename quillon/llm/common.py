"""Shared helpers: shared-folder tables, word hashes, batches of whole texts."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or in its absence the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


_written: dict[str, SparkSession] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A folder of our own in the shared one; it goes at the program's end, or before by discard."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(clean)
    _written[path] = spark
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lost executors cost nothing, lineage ends."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised df that nothing reads any more."""
    _delete(df._written_at)


def _delete(path: str) -> None:
    spark = _written.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean() -> None:
    """Deletes all that new_path gave out; no DataFrame made of it works after that."""
    for path in list(_written):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _delete(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def mix(h: np.ndarray, by: int) -> np.ndarray:
    """Another well-spread 64-bit hash of 64-bit hashes."""
    h = (h ^ (h >> U64(31))) * U64(by | 1)
    h = (h ^ (h >> U64(29))) * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def shingle_hashes(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; a text of fewer words has one shingle of all, one of none has none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, dtype=U64)
    h = hash_words(words)
    if len(h) < n:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=U64), 0x2545F4914F6CDD1D)
    m = len(h) - n + 1
    out = np.zeros(m, dtype=U64)
    for i in range(n):
        out = (out * U64(0x9E3779B97F4A7C15)) + h[i : i + m]
    return np.unique(mix(out, 0xD6E8FEB86659FD93))


def texts(batches: Iterator[pa.RecordBatch], *columns: str, most: int = 4_000_000) -> Iterator[list[list]]:
    """Lists of the columns, the last being text, of at most about `most` characters together (or one row)."""
    for b in batches:
        cols = [b.column(c).to_pylist() for c in columns]
        start = size = 0
        for i, t in enumerate(cols[-1]):
            size += len(t or "")
            if size >= most:
                yield [c[start : i + 1] for c in cols]
                start, size = i + 1, 0
        if start < len(cols[-1]):
            yield [c[start:] for c in cols]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    """pyarrow schema of a short DDL of long, int, double, boolean, string and binary columns and arrays of them."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}
    out = []
    for part in ddl.split(","):
        name, kind = part.split()
        out.append((name, pa.list_(kinds[kind[6:-1]]) if kind.startswith("array<") else kinds[kind]))
    return pa.schema(out)


def row_key() -> list[Column]:
    """A row's doc_id and text in 128 bits, as two longs; nulls are told from values."""
    own = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(F.lit(k), *own) for k in (1, 2)]


def grouped(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each key, which come one after the other."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            own = tuple(r[k] for k in key)
            if own != at:
                if rows:
                    yield at, rows
                at, rows = own, []
            rows.append(r)
    if rows:
        yield at, rows


def batched(ddl: str, rows) -> Iterator[pa.RecordBatch]:
    schema, part = arrow_schema(ddl), []
    for r in rows:
        part.append(r)
        if len(part) == 4096:
            yield record_batch(schema, *map(list, zip(*part, strict=True)))
            part = []
    if part:
        yield record_batch(schema, *map(list, zip(*part, strict=True)))
