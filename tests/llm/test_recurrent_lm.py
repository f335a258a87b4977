import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import recurrent_lm as lm


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    counts = Counter(w for i, t in rows if not lm.is_held_out(i) for w in words(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = words(t)
        out.append((i, lm.is_held_out(i), len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 6)))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(4)
    tongues = [[f"{k}{rnd.randrange(300)}" for _ in range(200)] for k in "abç"]
    rows = []
    for i in range(400):
        own = tongues[i % 3]
        rows.append((i * 7 - 100, rnd.choice([" ", "\n", "\t \x0b"]).join(rnd.choice(own) if rnd.random() < 0.9 else f"Rare{rnd.random()}" for _ in range(rnd.randrange(0, 150)))))
    return [*rows, (5000, None), (5001, ""), (5002, "  \n"), (None, rows[3][1]), (rows[8][0], rows[8][1]), (5003, "Éa ÉA b c " * 3), (5004, "x y " * 30000)]


def test_counts_and_base_as_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"codes": F.lit(1), "chunk": F.lit("x"), "score": F.lit(None)})
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_documents(df.repartition(5)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_counts_of_a_batch_of_many_chunks(spark, monkeypatch):
    """A batch's later chunks are slices of it; with and without nulls they have the words that their texts have."""
    monkeypatch.setattr(lm, "CHUNK_CHARS", 2000)
    for rows in (fixture()[:400], fixture()[:-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_documents(df).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_score_beats_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lm.score_documents(docs).where("held_out").collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table_and_no_training_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(empty).collect() == []
    held = next(i for i in range(100) if lm.is_held_out(i))
    r = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert math.isfinite(r.score)


def test_training_beats_the_start_on_held_out(spark, monkeypatch):
    """Context is learned: held-out scores with the trained parameters, against those of the unigram start."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    held = lambda: sum(r.score for r in lm.score_documents(docs).where("held_out").select("score").collect())
    trained = held()
    monkeypatch.setattr(lm, "_fit", lambda coded, vocabulary: vocabulary.sizes.flat(vocabulary.start()))
    untrained = held()
    print("held-out log10: trained", trained, "start", untrained)
    assert trained > 0.97 * untrained


def test_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 3000)
    df = spark.createDataFrame(fixture(), "doc_id long, text string")
    own = lambda n: np.array([r.score for r in sorted(lm.score_documents(df.repartition(n)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))])
    assert np.allclose(own(2), own(9), rtol=1e-4)


def test_head_grows_with_the_types():
    sizes = [lm.head_size(10**k) for k in range(10)]
    assert sizes == sorted(sizes) and sizes[0] == 256 and sizes[5] >= 1024 and sizes[9] >= 65_536


def test_a_long_text_fills_no_other_lane():
    import tracemalloc

    p, rng = model(), np.random.default_rng(4)
    docs = [rng.integers(0, Z.codes, n).astype(Z.kind) for n in (40_000, *[20] * 200)]
    tracemalloc.start()
    lm._run(p, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10e6  # 41 MB if all lanes were as long


Z = lm.Sizes(256)


def model(seed=1):
    rng = np.random.default_rng(seed)
    return {k: (rng.standard_normal(s) * 0.3).astype(np.float32) for k, s in Z.shapes.items()}


def test_probabilities_sum_to_one():
    p = model()
    h = np.random.default_rng(2).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    ll, _ = lm._output(p, np.repeat(h, Z.codes, axis=0), np.arange(Z.codes))
    assert abs(np.exp(ll.astype(float)).sum() - 1) < 1e-4


def test_state_is_carried_across_windows(monkeypatch):
    monkeypatch.setattr(lm, "LANES", 2)
    p = model()
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, Z.codes, n).astype(np.uint16) for n in (1, 200, 33, 32, 70)]
    got = lm._run(p, docs)
    sig = lambda x: 1 / (1 + np.exp(-x))
    for doc, one in zip(docs, got, strict=True):
        h, total, d = np.zeros(lm.HIDDEN), 0.0, lm.HIDDEN
        for k, c in enumerate(doc):
            g = p["b"] + (p["embed"][doc[k - 1]] @ p["wx"] if k else 0)
            u = h @ p["wh"]
            z, r = sig(g[:d] + u[:d]), sig(g[d : 2 * d] + u[d : 2 * d])
            n = np.tanh(g[2 * d :] + r * u[2 * d :])
            h = (1 - z) * n + z * h
            total += lm._output(p, h[None].astype(np.float32), np.array([int(c)]))[0][0]
        assert abs(one - total) < 1e-2


@pytest.mark.parametrize("name", list(Z.shapes))
def test_gradient(name):
    p = {k: v.astype(np.float64) for k, v in model(5).items()}
    rng = np.random.default_rng(6)
    code = rng.integers(0, Z.codes, (6, 3))
    before = np.vstack([np.full((1, 3), -1), code[:-1]])
    before[3, 1] = -1
    live = np.array([6, 6, 4])
    h = np.zeros((3, lm.HIDDEN), np.float32)
    grad = lm._window(p, code, before, live, h, True)[2][name]
    at = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
    eps, out = 1e-2, []
    for sign in (1, -1):
        q = {k: v.copy() for k, v in p.items()}
        q[name][at] += sign * eps
        out.append(-lm._window(q, code, before, live, h, False)[0].astype(float).sum())
    assert abs((out[0] - out[1]) / (2 * eps) - grad[at]) < 0.02 * max(1, abs(grad[at]))


def test_a_long_text_is_trained_side_by_side(monkeypatch):
    """In training a long text's pieces go in several lanes: each token is learned once, in few windows, and knows the code before it."""
    rng, seen, real = np.random.default_rng(9), [], lm._window
    docs = [rng.integers(0, Z.codes, n).astype(Z.kind) for n in (40_000, *[20] * 200)]

    def spy(p, code, before, live, *rest):
        ok = np.arange(len(code))[:, None] < live[None, :]
        seen.append((int(live.sum()), np.bincount(code[ok], minlength=Z.codes), int((before[ok] < 0).sum())))
        return real(p, code, before, live, *rest)

    monkeypatch.setattr(lm, "_window", spy)
    ids = list(range(len(docs)))
    group = pa.table({"doc_id": ids, "codes": [x.tobytes() for x in docs], "shard": pa.array([0] * len(docs), pa.int32())})
    lm._trainer(Z.flat(model()), 0.01, Z)(group)
    assert sum(n for n, _, _ in seen) == 44_000 and sum(k for _, _, k in seen) == len(docs)
    assert (sum(c for _, c, _ in seen) == np.bincount(np.concatenate(docs), minlength=Z.codes)).all()
    assert len(seen) < 100  # 1250 when the long text filled a lane by itself


def test_windows_of_few_lanes_score_as_others(monkeypatch):
    p, rng = model(), np.random.default_rng(10)
    docs = [rng.integers(0, Z.codes, n).astype(Z.kind) for n in (1, 3000, 700, 32, 70)]
    long = lm._run(p, docs)
    monkeypatch.setattr(lm, "FEW_LANES", 1)
    monkeypatch.setattr(lm, "LANES", 2)
    assert np.allclose(long, lm._run(p, docs), rtol=1e-5)


def test_large_weights_do_not_overflow():
    p = model()
    p["wc"] *= 100
    p["ww"] *= 100
    h = np.random.default_rng(2).uniform(-1, 1, (1, lm.HIDDEN)).astype(np.float32)
    ll, _ = lm._output(p, np.repeat(h, Z.codes, axis=0), np.arange(Z.codes))
    assert np.isfinite(ll).all() and abs(np.exp(ll.astype(float)).sum() - 1) < 1e-4
