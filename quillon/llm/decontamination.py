"""Benchmark decontamination by MinHash containment search, in DataFrame operations only.

Items are parted by size (powers of two). Each part keeps of every item's shingle hashes the smallest
ones (a bottom-k MinHash sketch), so its rate fits the items' size, not that of the documents: a
document is sketched at each part's rate, and that sketch probes the part's items. One hit makes a
candidate pair; candidates are verified by the exact share of the item's distinct shingles in the document.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialise

SHINGLE, THRESHOLD = 5, 0.8
#: Sketch hashes of an item. An item contained by 0.8 is missed if none of them is in the document: at most 0.2^8, under 3 in a million.
SKETCH = 8
#: Sketches (24 bytes a row) and shingles of items up to so many bytes are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _starts(n: Column, words: str = "words") -> Column:
    """Places of the n-word shingles, empty if there are fewer words."""
    return F.when(F.size(words) >= n, F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _hashes(n: int) -> Column:
    return F.transform(_starts(F.lit(n)), lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(n)]))


def _sketched(n: int, tops: dict[int, int]) -> Column:
    """part and hash of the n-word shingles at the rate of each part of items: tops has the largest sketch hash by part."""

    def parted(hashes):
        below = lambda part, top: F.transform(F.filter(hashes, lambda h: h <= F.lit(top)), lambda h: F.struct(F.lit(part).alias("part"), h.alias("hash")))
        return F.concat(*[below(part, top) for part, top in sorted(tops.items())])

    # a lambda variable holds the hashes, else they would be computed anew for each part
    return F.element_at(F.transform(F.array(_hashes(n)), parted), 1)


def _grams(n: int) -> Column:
    return F.transform(_starts(F.lit(n)), lambda i: F.array_join(F.slice("words", i, n), " "))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, sketch: int = SKETCH, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id (or what by names), item_id, n_shared, containment of all pairs with at least threshold of the item's distinct shingles in the document.

    Words are runs of letters and digits in lower case; an item of fewer than SHINGLE words is one
    shingle of all its words, an item or document without words is in no pair. Rows that share a
    doc_id (or item_id) count as one document (item) with the shingles of all; null ids are ids
    of no one and are left out. by names other columns that tell documents. Other columns are ignored.
    """
    known_ids = [F.col(c).isNotNull() for c in by]
    docs, items = docs.select(*by, "text").where(reduce(and_, known_ids)), items.select("item_id", "text").where("item_id is not null")
    cut = items.select("item_id", _words("text").alias("words")).where(F.size("words") > 0).withColumn("n", F.least(F.size("words"), F.lit(SHINGLE)))
    parts = [r.n for r in cut.select("n").distinct().collect()]  # 1 to SHINGLE
    shingle = F.explode(F.transform(_starts(F.col("n")), lambda i: F.slice("words", i, F.col("n"))))
    grams = cut.select("item_id", "n", shingle.alias("gram")).distinct()
    grams = materialise(grams.withColumn("gram", F.array_join("gram", " ")).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("item_id"))), "grams")
    by_words = F.split("gram", " ")
    hashed = F.lit(None).cast("long")
    for n in parts:
        hashed = F.when(F.col("n") == n, F.xxhash64(*[F.element_at(by_words, k + 1) for k in range(n)])).otherwise(hashed)
    low = Window.partitionBy("item_id").orderBy("hash")
    sketches = grams.withColumn("hash", hashed).withColumn("part", F.floor(F.log2("size")).cast("int")).withColumn("rank", F.row_number().over(low)).where(F.col("rank") <= sketch)
    sketches = materialise(sketches.select("item_id", "n", "part", "hash"), "sketches")
    tops: dict[int, dict[int, int]] = {}
    for r in sketches.groupBy("n", "part").agg(F.max("hash").alias("top")).collect():  # a row per size
        # hashes of other numbers of words are other hashes, so parts need no n
        tops.setdefault(r.n, {})[r.part] = r.top
    probe = sketches.select("item_id", "part", "hash").distinct()
    probe = F.broadcast(probe) if sketches.count() * 24 <= BROADCAST_BYTES else probe
    words = docs.select(*by, _words("text").alias("words"))
    empty = F.array().cast("array<struct<part:int,hash:bigint>>")
    hits = words.select(*by, F.explode(F.concat(empty, *[_sketched(n, tops[n]) for n in sorted(tops)])).alias("at")).select(*by, "at.*").join(probe, ["part", "hash"])
    pairs = materialise(hits.select(*by, "item_id").distinct(), "pairs")
    found = docs.join(pairs.select(*by).distinct(), [*by], "left_semi").select(*by, _words("text").alias("words"))
    every = F.concat(F.array().cast("array<string>"), *[_grams(n) for n in parts])
    known = grams.select("item_id", "n", "gram", "size")
    known = F.broadcast(known) if (known.agg(F.sum(F.octet_length("gram") + 24)).first()[0] or 0) <= BROADCAST_BYTES else known
    own = found.select(*by, F.explode(F.array_distinct(every)).alias("gram"))
    shared = own.join(known, "gram").join(pairs, [*by, "item_id"], "left_semi")
    counts = shared.groupBy(*by, "item_id", "size").agg(F.count_distinct("gram").alias("n_shared"))
    return counts.select(*by, "item_id", "n_shared", (F.col("n_shared") / F.col("size")).alias("containment")).where(F.col("containment") >= threshold)
