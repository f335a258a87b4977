import hashlib

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import simhash
from quillon.llm.simhash import edit_likeness, edited, edits_and_neighbours, fingerprint, fingerprints, near_counts


def test_edits_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in edit_likeness(docs).collect()}
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        new = edited(text, after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == fingerprint(text).tobytes().hex() and r.edited_fingerprint == fingerprint(new).tobytes().hex()
    long = [r for r in got.values() if r.n_chars > 1500]
    assert np.mean([r.near_edited > r.near_next + 0.1 for r in long]) > 0.9


def test_edges(spark):
    rows = [(5, None), (7, ""), (None, "null id"), (9, "one"), (9, "one"), (9, "other"), (11, "w " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pid": F.lit(1), "key": F.lit("k")})
    out = edit_likeness(df).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 3, 3, 5, 7, 400_000]
    assert edit_likeness(df.limit(0)).count() == 0
    alone = edit_likeness(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.near_next, r.edited_sha256) for r in alone] == [(1.0, hashlib.sha256(b"abab").hexdigest())]


def test_near_counts_as_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (30, 256), dtype=np.uint8)
    rows = []
    for i in range(400):
        b = base[0 if i % 2 else i % 30].copy()
        b[rng.choice(256, rng.integers(0, 6), replace=False)] ^= 1
        rows.append(np.packbits(b).tobytes().hex())
    rows += rows[:5]
    bits = np.array([np.unpackbits(np.frombuffer(bytes.fromhex(h), np.uint8)) for h in rows]).astype(int)
    away = np.abs(bits[:, None, :] - bits[None, :, :]).sum(axis=2)
    df = spark.createDataFrame([*zip(rows), (None,)], "fingerprint string").withColumns({"key": F.lit("x"), "print": F.lit(1)})
    for radius, blocks, block in ((7, None, 2048), (7, None, 16), (4, 6, 32)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        want = {h: int(n) for h, n in zip(rows, (away <= radius).sum(axis=1) - 1) if n}
        assert {r.fingerprint: r.n_near for r in near_counts(df, radius, blocks).collect()} == want
    assert near_counts(df.limit(0)).count() == 0
    assert fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).distinct().count() == 2


def test_near_copies_are_found(spark):
    """Long texts with one changed word are near; others aren't, and the query's rows are those of edit_likeness."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 4000)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t.replace(" ", " new ", 1)) for i, t in enumerate(texts)] + [(200, None), (201, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = edits_and_neighbours(df).collect()
    near = {r.doc_id: r.n_near for r in out}
    assert near[200] == near[201] == 1 and all(n <= 1 for n in near.values())
    assert sum(near[i] for i in range(20)) >= 18
    drop = lambda rs: sorted(map(repr, (tuple(r)[:7] for r in rs)))
    assert drop(out) == drop(edit_likeness(df).collect())
    assert edits_and_neighbours(df.limit(0)).count() == 0


def test_null_text_is_next(spark):
    rows = [(1, None), (1, "bbbb"), (2, "cccc"), (3, "dddd")]
    out = edit_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = {t: hashlib.sha256(edited(t or "", n or "").encode()).hexdigest() for t, n in ((None, "bbbb"), ("bbbb", "cccc"), ("cccc", "dddd"), ("dddd", None))}
    assert sorted(r.edited_sha256 for r in out) == sorted(want.values())
