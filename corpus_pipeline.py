"""The corpus pipeline: quality, line deduplication, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import discard, materialise, row_key
from quillon.llm.compression_quality import kept_by_quality, train
from quillon.llm.decontamination import contaminated
from quillon.llm.jaccard_join import distinct_documents
from quillon.llm.line_dedup import kept_lines
from quillon.llm.packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier scores under 0.7 go, each judged by its own text.

    A null text is judged as an empty one. Rows with a null or repeated doc_id are judged one by one,
    repeated rows alike; only labels need ids, so rows without one teach nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return kept_by_quality(docs, train(docs, labels))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from all but their first place; a row that had nothing else goes too.

    A changed row has the n_chars of its new text; others stay as they are, null and empty texts too.
    Rows that share a doc_id keep a text each; rows that share doc_id and text are changed alike.
    A null doc_id comes before all others; a null source is no site.
    """
    rows, changed = kept_lines(docs), F.col("__n_removed") > 0
    rows = rows.where(~changed | (F.trim(F.regexp_replace("__kept_text", r"\s+", " ")) != ""))
    n_chars = F.when(changed, F.length("__kept_text").cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", n_chars).withColumn("text", F.when(changed, F.col("__kept_text")).otherwise(F.col("text"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays, that of the least non-null doc_id.

    Rows are told by doc_id and text: of repeated rows one stays, rows that share only the doc_id are
    judged each by its text, and null ids hold no group together. Texts without words all stay.
    """
    return distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text contains a benchmark item go, each judged by its own text.

    So rows with a null or repeated doc_id are judged one by one, repeated rows alike; a null text
    contains nothing.
    """
    items, names = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ["__row1", "__row2"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    keyed = docs.withColumns(dict(zip(names, row_key(), strict=True)))
    found = contaminated(keyed, items, by=tuple(names)).select(*names).distinct()
    return keyed.join(found, names, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed one by one: repeated rows and null ids too; a null text is its end token alone."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("packing", packing)]
#: The classifier, the chosen paths and the packing can't be told in SQL; tests hold the stages' operators against brute force or held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet and read again; a table goes once its successor is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
