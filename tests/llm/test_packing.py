import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.packing import Plan, default_tokenizer, encoder, pack, patterns, solve


def whole(texts):
    t = Tokenizer.from_file(default_tokenizer())
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_tokenizers(text):
    assert encoder(default_tokenizer())([text]) == whole([text])


def test_same_ids_on_odd_texts():
    assert encoder(default_tokenizer())(["<|endoftext|>", "x<|endoftext|>y"]) == [[50256], [87, 50256, 88]]
    texts = ["<|endoftext|> <|endoftext", "a" * 9000, " " * 9000 + "b", "\x1c\x85 x ½²́", "it's  'LL 12345 \n\n\t x", ""]
    assert encoder(default_tokenizer())(texts) == whole(texts)


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), max_size=40))
def test_plan_places_every_token_once(demand):
    plan = Plan(demand, 64)
    seen, sizes = set(), {}
    for length, n in demand.items():
        for rank in range(n):
            placed = plan.pieces(length, rank)
            assert sum(k for _, k, _, _ in placed) == length
            for _, k, sequence, offset in placed:
                for t in range(offset, offset + k):
                    assert (sequence, t) not in seen
                    seen.add((sequence, t))
                sizes[sequence] = sizes.get(sequence, 0) + k
    assert all(max(t for s, t in seen if s == q) == n - 1 for q, n in sizes.items())
    assert all(n & (n - 1) == 0 for n in sizes.values()) and sum(n < 64 for n in sizes.values()) <= 6


def test_linear_program():
    rnd = random.Random(5)
    demand = {x: rnd.randrange(50, 90) for x in range(10, 500, 3)}
    used = patterns(demand, 512)
    tokens = sum(a * b for a, b in demand.items())
    assert sum(n for _, n in used) * 512 >= 0.8 * tokens
    lengths, basis, x = solve(demand, 512, pivots=400)
    assert np.allclose(basis @ x, [demand[v] for v in lengths]) and (x > -1e-6).all()
    assert (lengths @ basis <= 512).all() and x.sum() <= 1.05 * tokens / 512
    for x in demand:
        assert sum(p.get(x, 0) * n for p, n in used) <= demand[x]


def check(spark, docs, n):
    rows = docs.collect()
    want = {}
    for r, ids in zip(rows, whole([r.text or "" for r in rows]), strict=True):
        want.setdefault(r.doc_id, []).append(sorted([*ids, 0]) and [*ids, 0])
    out = pack(docs).toPandas()
    sequences = {}
    for (s,), g in out.groupby(["sequence_id"]):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all()
        sequences[s] = int(g.length.sum())
    assert all(x <= 1024 and x & (x - 1) == 0 for x in sequences.values())
    assert sum(x < 1024 for x in sequences.values()) <= 10
    assert len(out) >= n
    return out, want


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out, want = check(spark, docs, 200)
    for doc, g in out.groupby("doc_id"):
        ids = np.array(want[doc][0], dtype="<u4")
        g = g.sort_values("start")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids) == g.doc_tokens.iloc[0]
        for _, p in g.iterrows():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32


def test_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "some text"), (3, "word " * 5000), (4, "x"), (4, "x"), (5, "one<|endoftext|>two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit("a"), "rest": F.lit(1), "salt": F.lit(2)})
    out, want = check(spark, df, 8)
    assert out.length.sum() == sum(len(x) for xs in want.values() for x in xs)
    assert pack(df.limit(0)).count() == 0
