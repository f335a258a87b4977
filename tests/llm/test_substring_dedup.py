import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillon.llm.substring_dedup import dedup_passages


def brute(rows, width):
    """Windows by their words; those that also start earlier are cut."""
    docs = sorted({(i if i is not None else -(10**18), t) for i, t in rows}, key=lambda r: (r[0], r[1] or ""))
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, (i, k)), (i, k))
    out = {}
    for i, t in docs:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def got(df):
    return {r.doc_id if r.doc_id is not None else -(10**18): (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def fixture(seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["a", "b", "ç", "dd", "e"])
    passage = [str(rnd.random()) for _ in range(60)]
    rows = []
    for i in range(60):
        body = [word() for _ in range(rnd.randrange(0, 80))]
        if i % 3 == 0:
            a = rnd.randrange(0, 30)
            body += passage[a : a + rnd.randrange(5, 40)] + [str(rnd.random())]
        if i % 7 == 0:
            body = body + ["x"] * 45
        rows.append((i * 3 - 20, rnd.choice([" ", "\n", "\t "]).join(body)))
    rows += [(900 + i, rows[5][1]) for i in range(40)]
    return [*rows, (500, None), (501, ""), (None, rows[6][1]), (502, " ".join(["z"] * 70000))]


@pytest.mark.parametrize("width", [4, 20])
def test_as_brute_force(spark, width):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "starts": F.lit("x"), "bucket": F.lit(None)})
    assert got(dedup_passages(df.repartition(7), width, keep_text=False)) == brute(rows, width)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(dedup_passages(docs, keep_text=False)) == brute(rows, 20)


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_passages(none).count() == 0
    text = " ".join(map(str, range(30)))
    same = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in dedup_passages(same).collect()) == [(1, 0), (1, 0), (2, 30)]


def test_clashing_hashes(spark, monkeypatch):
    """Windows whose first hashes clash are told by the second, and many buckets give the same result."""
    import quillon.llm.substring_dedup as d

    real = d.mix
    monkeypatch.setattr(d, "mix", lambda h, by: real(h, by) & d.U64(0xFFF) if by == d.BASES[0] else real(h, by))
    rows = fixture(3)
    lists = [([i for i, _ in rows[k::3]], [t for _, t in rows[k::3]]) for k in range(3)]
    found = {}
    monkeypatch.setattr(d, "texts", lambda batches, *a: iter(batches))
    blobs = [r for part in lists for b in d._dealer(4, 5)(iter([part])) for r in b.to_pylist()]
    for k in range(5):
        own = [r for r in blobs if r["bucket"] == k]
        if own:
            for r in d._find(d.pa.Table.from_pylist(own, d.arrow_schema(d._BLOB)), 5).to_pylist():
                ids = d.np.repeat(d.np.frombuffer(r["ids"], d.np.int64), d.np.frombuffer(r["runs"], d.np.uint32))
                for i, s in zip(ids.tolist(), d.np.frombuffer(r["starts"], d.np.uint32).tolist(), strict=True):
                    found.setdefault(i, set()).add(s)
    want = {}
    order = sorted((i if i is not None else -(2**63), t or "") for i, t in rows)
    seen = {}
    for i, t in order:
        w = t.split()
        for k in range(len(w) - 3):
            seen.setdefault(tuple(w[k : k + 4]), []).append((i, k))
    for places in seen.values():
        low = min(places)
        for i, k in places:
            if (i, k) > low:
                want.setdefault(i, set()).add(k)
    assert found == want


def test_buckets_follow_the_text(spark, monkeypatch):
    import quillon.llm.substring_dedup as d

    monkeypatch.setattr(d, "BUCKET_CHARS", 500)
    rows = fixture(2)[:70]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(dedup_passages(df.repartition(5), keep_text=False)) == brute(rows, 20)
