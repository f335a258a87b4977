"""The operators' queries over the whole tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(by: int):
    """crc32 of doc_id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by


@query
def op7_substring_dedup(spark, d):
    from quillon.llm.substring_dedup import dedup_passages

    return dedup_passages(table(spark, d, "documents"), keep_text=False)


@query
def op8_quality_classifier(spark, d):
    from quillon.llm.compression_quality import score_quality, train

    docs = table(spark, d, "documents").select("doc_id", "text")
    labels = table(spark, d, "labels").select("doc_id", "quality")
    model = train(docs.where(remainder(4) != 2), labels.where(remainder(4) != 2))
    return score_quality(docs, model).withColumn("held_out", remainder(4) == 2).select("doc_id", "held_out", "score", "predicted")


@query
def op2_simhash(spark, d):
    from quillon.llm.simhash import edits_and_neighbours

    return edits_and_neighbours(table(spark, d, "documents"))


@query
def op10_warc(spark, d):
    from quillon.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, d, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op10_warc"] = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
coded AS (
  SELECT page_id, strlen(html) AS payload_bytes,
    list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4), 5))::int >> (15 - 5 * (i % 4))) & 31), 1) FOR i IN range(0, 32)], lambda a, b: a || b) AS payload_digest
  FROM hashed),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS f FROM coded)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM firsts
"""


@query
def op4_packing(spark, d):
    from quillon.llm.packing import pack

    return pack(table(spark, d, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op9_line_dedup(spark, d):
    from quillon.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, d, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE["op9_line_dedup"] = """
WITH lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
spread AS (SELECT trim(raw) AS line FROM lines WHERE trim(raw) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10),
ranked AS (SELECT l.*, s.line IS NOT NULL AND row_number() OVER (PARTITION BY trim(raw) ORDER BY doc_id, pos) > 1 AS gone FROM lines l LEFT JOIN spread s ON trim(l.raw) = s.line)
SELECT doc_id, count(*)::int AS n_lines, count(*) FILTER (gone)::int AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""


@query
def op3_decontamination(spark, d):
    from quillon.llm.decontamination import contaminated

    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


ORACLE["op3_decontamination"] = """
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, least(5, len(w)) AS n, unnest([array_to_string(w[i : i + least(5, len(w)) - 1], ' ') FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS gram FROM iw WHERE len(w) > 0),
sizes AS (SELECT item_id, count(*) AS size FROM grams GROUP BY 1),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT DISTINCT n FROM grams),
own AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i : i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS gram FROM dw, lens)
SELECT doc_id, item_id, count(DISTINCT gram) AS n_shared, count(DISTINCT gram) / any_value(size) AS containment
FROM own JOIN grams USING (gram) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(DISTINCT gram) / any_value(size) >= 0.8
"""


@query
def op5_secret_scan(spark, d):
    from quillon.llm.secret_scan import digest, scan

    return digest(scan(table(spark, d, "documents")))


@query
def op1_jaccard_join(spark, d):
    from quillon.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, d, "documents"))


@query
def op6_recurrent_lm(spark, d):
    from quillon.llm.recurrent_lm import score_documents

    return score_documents(table(spark, d, "documents"))
