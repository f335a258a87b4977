"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks, each compressed once with either dictionary. The normalised differences
of the compressed sizes become a score by logistic regression on labelled rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_schema, discard, materialise, partitions, record_batch, texts

BLOCK, LEVEL, DICT_BYTES = 4096, 3, 112_640
#: Labelled rows of either class that the dictionaries and the calibration each learn from, at most, and the characters of
#: whole texts of a class that the dictionaries learn from (the driver holds them): rows that don't fit are not drawn for them.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 16_000_000


class Model:
    """Two dictionaries and the weights of the calibrated score; pickled to the tasks, about 250 KB."""

    def __init__(self, good: list[bytes], bad: list[bytes]):
        self.dicts = [_dictionary(x) for x in (good, bad)]
        self.weights, self.mean, self.scale = np.zeros(4), np.zeros(3), np.ones(3)
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def features(self, text: str | None) -> list[float]:
        """Difference of the sizes by those with no use of the other, its square root by length, and the plain ratio."""
        if self._open is None:
            self._open = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in self.dicts]
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (sum(len(c.compress(data[i : i + BLOCK])) - 6 for i in range(0, len(data), BLOCK)) for c in self._open)
        n = max(1, len(data))
        return [(bad - good) / max(1, bad + good), (bad - good) / (n + 200), min(good, bad) / n]

    def fit(self, rows: list[tuple[list[float], int]], steps: int = 60, ridge: float = 1e-3) -> None:
        """Newton's method on the features of whole labelled texts."""
        x = np.array([f for f, _ in rows], dtype=float).reshape(-1, 3)
        y = np.array([q for _, q in rows], dtype=float)
        if not len(y):
            return
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(y))]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(4), x.T @ (y - p) - ridge * len(y) * self.weights)
            self.weights = self.weights + step
            if np.abs(step).max() < 1e-9:
                break

    def score(self, text: str | None) -> float:
        z = float(np.clip((np.array(self.features(text)) - self.mean) / self.scale, -8, 8) @ self.weights[:3] + self.weights[3])
        return 1 / (1 + np.exp(-min(30.0, max(-30.0, z))))


def _dictionary(samples: list[bytes]) -> bytes:
    blocks = [x[i : i + 1024] for x in samples for i in range(0, len(x), 1024)]
    if len(blocks) < 16:
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, blocks)) // 8)), blocks, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # samples too few or too alike to train on
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8


def _chosen(labels: DataFrame, q: int, total: int) -> list[int]:
    """Ids of about the 2 * SAMPLE_ROWS labelled ones of a class with the least hashes, in their order."""
    key, most = F.xxhash64(F.lit("quality"), "doc_id"), 2 * SAMPLE_ROWS
    # a cut that leaves a tenth more than are needed, so few rows come to the driver, however many tasks there are
    cut = min((1 << 63) - 1, -(1 << 63) + (int(1.1 * most * (1 << 64)) // max(1, total)))
    rows = labels.where(F.col("quality") == q).select("doc_id", key.alias("k")).where(F.col("k") <= cut).collect()
    return [r.doc_id for r in sorted(rows, key=lambda r: (r.k, r.doc_id))[:most]]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, quality: 0 or 1; rows with another are ignored).

    Up to 2 * SAMPLE_ROWS ids of either class are drawn by a hash of doc_id; alternate ones feed the
    dictionaries and the calibration, with their whole texts. The calibration's features are computed
    in tasks. Repeated ids and labels count once, by the least of their texts; null ids have no
    label. Without rows the score is 0.5 for every text. Only ids are shuffled, and the chosen texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    pairs = materialise(pairs.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")
    total = {r.quality: r.n for r in pairs.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    counts = [total.get(q, 0) for q in (1, 0)]
    chosen = [(i, q) for q in (1, 0) for i in _chosen(pairs, q, total.get(q, 0))]
    both, ddl = chosen[::2], "doc_id long"
    least = docs.join(F.broadcast(spark.createDataFrame([(i,) for i in sorted({i for i, _ in chosen})], ddl)), "doc_id")
    least = materialise(least.groupBy("doc_id").agg(F.min("text").alias("text")), "drawn")
    size, fits = {r.doc_id: r.n for r in least.select("doc_id", F.length("text").alias("n")).collect()}, []
    for want in (1, 0):
        used = 0
        for i, q in both:
            if q == want and used + size[i] <= SAMPLE_CHARS:
                used += size[i]
                fits.append((i, q))
    wanted = spark.createDataFrame([(i,) for i in sorted({i for i, _ in fits})], ddl)
    text = {r.doc_id: r.text for r in least.join(F.broadcast(wanted), "doc_id").collect()}  # at most 2 * SAMPLE_CHARS characters
    good, bad = ([text[i].encode() for i, q in fits if q == want] for want in (1, 0))
    model = Model(good, bad)
    rest = chosen[1::2]
    wanted = spark.createDataFrame([(i,) for i in sorted({i for i, _ in rest})], ddl)
    found = {r.doc_id: r.f for r in least.join(F.broadcast(wanted), "doc_id").repartition(partitions(spark)).mapInArrow(_features(model), "doc_id long, f array<double>").collect()}
    discard(least)
    rest = [(found[i], q) for i, q in rest]
    model.fit(rest)
    # the classes were drawn by number, not by share: put the shares back
    n = [sum(q == want for _, q in rest) for want in (1, 0)]
    if all(n) and all(counts):
        model.weights[3] += np.log(counts[0] / counts[1]) - np.log(n[0] / n[1])
    return model


def _features(model: Model):
    schema = arrow_schema("doc_id long, f array<double>")

    def run(batches):
        for ids, rows in texts(batches, "doc_id", "text"):
            yield record_batch(schema, ids, [model.features(t) for t in rows])

    return run


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs' doc_id with score (0 to 1) and predicted (1 if score >= threshold); a null text counts as empty."""
    ddl = "doc_id long, score double, predicted int"
    schema = arrow_schema(ddl)

    def apply(batches):
        for ids, rows in texts(batches, "doc_id", "text"):
            scores = [model.score(t) for t in rows]
            yield record_batch(schema, ids, scores, [int(s >= threshold) for s in scores])

    return docs.select("doc_id", "text").mapInArrow(apply, ddl)


def kept_by_quality(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with all columns, whose own text scores at least threshold; a null text counts as empty."""

    def keep(batches):
        for b in batches:
            for at, rows in texts(iter([b.select(["text"]).append_column("__at", pa.array(range(b.num_rows)))]), "__at", "text"):
                kept = [i for i, t in zip(at, rows, strict=True) if model.score(t) >= threshold]
                if kept:
                    yield b.take(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)
