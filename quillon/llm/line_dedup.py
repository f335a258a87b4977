"""Cross-site line deduplication, in DataFrame operations only.

A HyperLogLog sketch of the sites per line hash, merged by aggregation, gives each line's spread.
Lines near the threshold get exact distinct counts. Boilerplate lines stay in their first place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialise

MIN_SITES = 10
#: log2 of the sketch's registers, and the share by which an estimate must pass the threshold to count alone (over 6 standard errors).
LG_K, BAND = 12, 0.1
#: Boilerplate lines up to this number are broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_LINES = 500_000


def _lines(docs: DataFrame) -> DataFrame:
    split = docs.select("doc_id", "source", F.xxhash64("text").alias("version"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return split.select("doc_id", "source", "version", "pos", F.trim("line").alias("line")).where("line <> ''").withColumn("hash", F.xxhash64("line")).drop("line")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """hash of each line that min_sites sites have, with its first place (doc_id, null first, and pos)."""
    lines = _lines(docs).select("hash", "source", "doc_id", "pos")
    spread = lines.groupBy("hash").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LG_K))).alias("sites"), F.min(F.struct("doc_id", "pos")).alias("first"))
    likely = materialise(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "lines")
    sure = likely.where(F.col("sites") > min_sites * (1 + BAND))
    near = likely.where(F.col("sites") <= min_sites * (1 + BAND)).select("hash", "first")
    exact = lines.join(near, "hash").groupBy("hash", "first").agg(F.count_distinct("source").alias("exact")).where(F.col("exact") >= min_sites)
    return sure.select("hash", "first").unionByName(exact.select("hash", "first"))


def kept_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """All columns of docs, and __n_lines, __n_removed and __kept_text of each row: see dedup_lines."""
    common = materialise(boilerplate(docs.select("doc_id", "source", "text"), min_sites), "boilerplate")
    common = F.broadcast(common) if common.count() <= BROADCAST_LINES else common
    place = F.struct("doc_id", "pos")
    hit = _lines(docs.select("doc_id", "source", "text")).select("doc_id", "version", "pos", "hash").join(common, "hash").where(~place.eqNullSafe(F.col("first")))
    gone = hit.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("__gone")).select(F.col("doc_id").alias("__id"), F.col("version").alias("__of"), "__gone")
    own = docs.withColumn("__version", F.xxhash64("text"))
    text = F.coalesce("text", F.lit(""))
    rows = own.join(gone, own.doc_id.eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__of")), "left").withColumn("__lines", F.split(text, "\n"))
    kept = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone"), lambda i: F.get("__lines", i)))
    rows = rows.withColumn("__kept", kept)
    new = F.when(F.col("__gone").isNull(), text).otherwise(F.array_join("__kept", "\n"))
    return rows.select(*docs.columns, F.size("__lines").alias("__n_lines"), (F.size("__lines") - F.size("__kept")).alias("__n_removed"), new.alias("__kept_text"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per row of docs (doc_id, source, text): doc_id, n_lines, n_removed and kept_text.

    Lines are compared without the spaces around them; blank ones always stay. A line that at least
    min_sites distinct non-null sources have stays only at its first place. A null text has one
    blank line. Rows that share doc_id and text get the same result; other columns are ignored.
    """
    rows = kept_lines(docs.select("doc_id", "source", "text"), min_sites)
    return rows.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("n_lines", "n_removed", "kept_text")])
