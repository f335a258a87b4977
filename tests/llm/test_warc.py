import random

from oracle import check
from pyspark.sql import functions as F

from quillon.llm.queries import ORACLE, QUERIES
from quillon.llm.warc import LoserTree, archive_round_trip, capture_index, parse, read_archives, write_archives


def test_same_rows_as_sql(spark):
    check(spark, QUERIES["op10_warc"], ORACLE["op10_warc"])


def test_loser_tree():
    rnd = random.Random(3)
    for k in range(9):
        runs = [sorted(rnd.randrange(50) for _ in range(rnd.randrange(12))) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_edges(spark, tmp_path):
    body = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nb"
    rows = [(3, "http://x.org/a b", body), (1, "http://x.org/", body), (1, None, body), (None, "u", ""), (7, "http://[bad", None), (8, "http://x.org/", "é" * 200_000), (9, "http://x.org/", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"first": F.lit(1), "value": F.lit("x"), "payload_digest": F.lit(0)})
    out = archive_round_trip(df).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [
        (-1, 0, "revisit", 7),
        (1, len(body), "response", None),
        (1, len(body), "response", None),
        (3, len(body), "revisit", 1),
        (7, 0, "response", None),
        (8, 400_000, "response", None),
        (9, 1, "response", None),
    ]
    keys = [(r.url_key, r.timestamp) for r in out]
    assert keys == sorted(keys)
    assert archive_round_trip(df, 5).where("refers_to is not null").count() == 1
    assert archive_round_trip(df.limit(0)).count() == 0
    write_archives(df, f"file://{tmp_path}/w")
    records = [h for p in (tmp_path / "w").glob("part-*") for _, _, h, _ in parse(p.read_bytes())]
    assert len(records) == len(rows) and all(h["warc-record-id"].startswith("<urn:") for h in records)


def test_huge_ids_big_files_and_revisit_headers(spark, tmp_path):
    rows = [(2**63 - 1, "http://a.org/", "same"), (-(2**63), "http://b.org/x y", "same"), (5, "http://c.org/", "é" * 3_000_000), (6, None, "z" * 5_000_000), *((100 + i, f"http://d.org/{i}", f"page {i}") for i in range(3000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in archive_round_trip(df).collect()}
    assert len(out) == len(rows) and out[2**63 - 1].refers_to == -(2**63) and out[5].payload_bytes == 6_000_000
    write_archives(df.coalesce(1), f"file://{tmp_path}/w", file_bytes=1 << 20)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    heads = [h for x in files for _, _, h, _ in parse(x)]
    assert len(heads) == len(rows) and len(files) >= 4
    assert sum(len(x) > 1 << 20 for x in files) == 2  # only single records are larger
    (again,) = [h for h in heads if h["warc-type"] == "revisit"]
    (first,) = [h for h in heads if h.get("x-page-id") == str(-(2**63))]
    assert again["warc-refers-to"] == first["warc-record-id"] and again["warc-refers-to-date"] == first["warc-date"]
    assert again["warc-refers-to-target-uri"] == first["warc-target-uri"] == "http://b.org/x%20y"


def test_many_captures_of_a_url_span_ranges(spark, tmp_path):
    df = spark.createDataFrame([(7, "http://a.org/", f"v{i}") for i in range(400)] + [(i, f"http://{i % 5}.org/", "x") for i in range(100)], "page_id long, url string, html string")
    write_archives(df.repartition(6), f"file://{tmp_path}/w")
    index = capture_index(read_archives(spark, f"file://{tmp_path}/w"), 40)
    parts = index.rdd.glom().map(len).collect()
    assert sum(parts) == 500 and max(parts) <= 120
    keys = [(r.url_key, r.timestamp, r.page_id, r.file, r.at) for r in index.collect()]
    assert keys == sorted(keys)
