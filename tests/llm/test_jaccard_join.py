import random

import numpy as np
from pyspark.sql import functions as F

import quillon.llm.jaccard_join as j
from quillon.llm.common import shingle_hashes
from quillon.llm.components import components
from quillon.llm.jaccard_join import distinct_documents, similar_documents


def brute(rows, t=0.8):
    sets = {k: set(shingle_hashes(x).tolist()) for k, (_, x) in enumerate(rows)}
    up = {k: k for k in sets}
    find = lambda k: k if up[k] == k else find(up[k])
    links = dict.fromkeys(sets, 0)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if n >= t * (len(sets[a]) + len(sets[b]) - n):
                    links[a] += 1
                    links[b] += 1
                    up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), i), i)
    return sorted((i, low[find(k)], links[k]) for k, (i, _) in enumerate(rows))


def got(df):
    return sorted((r.doc_id if r.doc_id is not None else -(2**63), r.class_id if r.class_id is not None else -(2**63), r.n_links) for r in df.collect())


def fixture(groups=25, large=150):
    rnd = random.Random(4)
    text = lambda n: [f"w{rnd.randrange(300)}" for _ in range(n)]
    rows = []
    for g in range(groups):
        words = text(rnd.randrange(3, 200))
        for _ in range(rnd.randrange(1, 6)):
            new = list(words)
            for _ in range(rnd.randrange(0, 5)):
                new[rnd.randrange(len(new))] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows) * 3 + g, " ".join(new)))
    hot = text(160)
    for _ in range(large):
        new = list(hot)
        for _ in range(rnd.randrange(0, 3)):
            new[rnd.randrange(len(new))] = f"h{rnd.randrange(10**6)}"
        rows.append((len(rows) * 3 + 1000, " ".join(new)))
    common = text(30)
    rows += [(5000 + i, " ".join(common + text(100))) for i in range(80)]
    return rows


def test_as_brute_force(spark):
    rows = [*fixture(), (8000, ""), (8001, None), (8002, "one two"), (8003, "one  two"), (8003, "one two")]
    df = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").withColumns({"path": F.lit(1), "id": F.lit("x"), "own": F.lit(2)})
    assert got(similar_documents(df)) == brute([*rows, (-(2**63), rows[0][1])])
    assert similar_documents(df.limit(0)).count() == 0


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 8)
    monkeypatch.setattr(j, "BLOCK", 16)
    rows = fixture(6, 70)
    assert got(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (300, 300)]
    out = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}


def test_components_of_a_long_chain(spark):
    ids = random.Random(5).sample(range(10**9), 2000)
    out = {r.node: r.label for r in components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()}
    assert out == dict.fromkeys(ids, min(ids))


def test_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    words = [[f"g{g}w{rnd.randrange(10**6)}" for _ in range(120)] for g in range(6)]
    near = lambda g, k: " ".join([*words[g][: 10 * k], f"n{k}", *words[g][10 * k + 1 :]])
    rows = [(10, near(0, 0)), (None, near(0, 1)), (11, near(0, 2)), (12, near(0, 0))]  # one null id
    rows += [(None, near(1, k)) for k in range(4)] + [(None, near(1, 0))] * 3  # null ids alone
    rows += [(None, near(2, k)) for k in range(3)] + [(20, near(2, 5)), (21, near(2, 6))]  # several
    rows += [(30, near(3, 0)), (31, near(3, 1)), (31, near(4, 0)), (40, near(4, 1))]  # 31 in two groups
    rows += [(50, near(5, 0)), (50, near(5, 0)), (None, near(5, 3))]
    rows += [(None, ""), (None, None), (60, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    low = lambda rows: sorted((-1 if i is None else i, t or "") for i, t in rows)
    out = distinct_documents(df)
    assert out.columns == df.columns
    got = low((r.doc_id, r.text) for r in out.collect())
    alone = [x for x in got if x[0] == -1 and x[1]]
    assert len(alone) == 1 and alone[0][1] in {near(1, k) for k in range(4)}
    assert low(x for x in got if x != alone[0]) == low([(10, near(0, 0)), (20, near(2, 5)), (30, near(3, 0)), (31, near(4, 0)), (50, near(5, 0)), (None, ""), (None, None), (60, " ")])

    numbered = [(-(2**63) if i is None else i, t) for i, t in rows]
    assert sorted(got_links(similar_documents(df))) == sorted((i, n) for i, _, n in brute(numbered))
    assert distinct_documents(df.limit(0)).count() == 0


def got_links(df):
    return [(i, n) for i, _, n in got(df)]


def hot_group(copies, seed=8):
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(200)]
    out = []
    for k in range(copies):
        new = list(base)
        for _ in range(rnd.randrange(0, 6)):
            new[rnd.randrange(len(new))] = f"e{k}x{rnd.randrange(10**6)}"
        out.append(" ".join(new))
    return out


def linked(texts, t=0.8):
    """Matrix of the links of all pairs, by the shingles that more than one text has."""
    sets = [shingle_hashes(x) for x in texts]
    size = np.array([len(s) for s in sets], dtype=np.float32)
    known, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.zeros((len(sets), len(known)), dtype=np.float32)
    own[np.repeat(np.arange(len(sets)), size.astype(int)), of] = 1
    own = own[:, n > 1]
    both = own @ own.T
    out = both >= t * (size[:, None] + size[None, :] - both) - 1e-4
    np.fill_diagonal(out, False)
    return out


def test_recall_in_a_hot_group(spark):
    texts = hot_group(3000)
    want = linked(texts).sum(axis=1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    found = {r.doc_id: r.n_links for r in similar_documents(df).collect()}
    got = np.array([found[i] for i in range(len(texts))])
    print("links", got.sum(), "of", want.sum())
    assert (got <= want).all() and got.sum() >= 0.999 * want.sum() > 10**6


def test_more_runs_follow_until_the_target(spark, monkeypatch):
    """Two runs miss many links; the estimate sees it, and later turns find them and count none twice."""
    texts = hot_group(150, 9) + [" ".join(hot_group(1, 20 + k)[0].split()[:199] + [f"t{j}"]) for k in range(30) for j in range(2)]
    want, turns = linked(texts).sum(axis=1), []
    real = j._buckets
    monkeypatch.setattr(j, "_buckets", lambda heads, turn, *a: (turns.append(turn), real(heads, turn, *a))[1])
    monkeypatch.setattr(j, "SMALL", 16)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.n_links for r in similar_documents(df, runs=2).collect()}
    got = np.array([found[i] for i in range(len(texts))])
    assert len(turns) > 2 and (got <= want).all() and got.sum() >= 0.98 * want.sum()


def test_large_paths_by_a_join(spark, monkeypatch):
    """Beyond the broadcast's bound the recursion goes by a join, with the same links."""
    monkeypatch.setattr(j, "SMALL", 8)
    monkeypatch.setattr(j, "BROADCAST_IDS", 0)
    monkeypatch.setattr(j, "BLOCK_SHINGLES", 3000)
    rows = fixture(6, 70)
    assert got(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_very_long_texts(spark):
    words = [f"w{k % 70_001}x{k % 31}" for k in range(600_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, " ".join(words[::-1])), (4, "short text")]
    assert got(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_cores_are_not_met_in_blocks(spark, monkeypatch):
    """A group near its leader sends a small part of the rows that all pairs of blocks take, and has the same links."""
    monkeypatch.setattr(j, "SMALL", 8)
    monkeypatch.setattr(j, "BLOCK", 16)
    base, texts = hot_group(1, 30)[0].split(), []
    texts = [" ".join([*base[:k], f"e{k}", *base[k + 1 :]]) for k in range(200)]
    real, sent = j._blocked, []

    def spy(members, sketches, cores):
        if cores is not None and not sent:
            sent.extend([real(members, sketches, cores).count(), real(members, sketches, None).count()])
        return real(members, sketches, cores)

    monkeypatch.setattr(j, "_blocked", spy)
    rows = list(enumerate(texts))
    assert got(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    print("rows", sent)
    assert sent[0] < sent[1] / 3


def test_buckets_are_joined_with_their_members_once(spark, monkeypatch):
    """Cores and blocks read the members that were written; the plan they get joins nothing anew."""
    monkeypatch.setattr(j, "SMALL", 8)
    monkeypatch.setattr(j, "BLOCK", 16)
    plans = {}
    for name, at in (("_cores", 2), ("_blocked", 0)):
        real = getattr(j, name)
        monkeypatch.setattr(j, name, lambda *a, name=name, at=at, real=real: (plans.setdefault(name, a[at]._jdf.queryExecution().optimizedPlan().toString()), real(*a))[1])
    rows = list(enumerate(hot_group(70, 31)))
    assert got(similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    assert set(plans) == {"_cores", "_blocked"} and not any("Join" in p for p in plans.values())
