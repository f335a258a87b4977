import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm.common import materialise
from quillon.llm.compression_quality import train
from quillon.llm.packing import default_tokenizer

SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """sf0.001 with a line that 14 sources have, near copies, a text around a benchmark item, a null and an empty text."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet")
    labels, items = spark.read.parquet(f"{SOURCE}/labels.parquet"), spark.read.parquet(f"{SOURCE}/benchmark.parquet")
    good = [r.text for r in docs.join(labels.where("quality = 1"), "doc_id").where("length(text) > 600").orderBy("doc_id").select("text").collect()]
    item = items.orderBy("item_id").first().text
    rows = [(1_000_000 + i, f"{good[i % len(good)]}\nfirst published {i} and seen {i * 7}\nShare this page with a friend", "en", f"site{i}.example") for i in range(14)]
    words = good[0].split()
    rows += [(1_000_100 + i, " ".join([*words[: 10 * i], f"new{i}", *words[10 * i + 1 :]]), "en", "copies.example") for i in range(1, 4)]
    rows += [(1_000_200, f"{good[1]} {item} {good[2]}", "en", "leak.example"), (1_000_201, None, "en", "none.example"), (1_000_202, "", None, None)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    docs.unionByName(more.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])).write.parquet(f"{out}/documents.parquet")
    labels.write.parquet(f"{out}/labels.parquet")
    items.write.parquet(f"{out}/benchmark.parquet")
    return out


def quality(spark, rows, d):
    model = train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"))
    return {i: (t, s, n) for i, (t, s, n) in rows.items() if model.score(t) >= 0.7}


def lines(spark, rows, d):
    sites, first = {}, {}
    for i in sorted(rows):
        text, source, _ = rows[i]
        for line in (x.strip(" ") for x in (text or "").split("\n")):
            sites.setdefault(line, set()).update([source] if source is not None else [])
            first.setdefault(line, i)
    common, out = {x for x, s in sites.items() if x and len(s) >= 10}, {}
    for i, (text, source, n) in rows.items():
        seen, kept = set(), []
        for line in (text or "").split("\n"):
            x = line.strip(" ")
            if x not in common or (first[x] == i and x not in seen):
                kept.append(line)
            seen.add(x)
        new = "\n".join(kept)
        if new == (text or ""):
            out[i] = text, source, n
        elif new.strip():
            out[i] = new, source, len(new)
    return out


def shingles(words, n=5):
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def near_duplicates(spark, rows, d):
    sets = {i: shingles((t or "").encode().split()) for i, (t, _, _) in rows.items()}
    low = {i: i for i in rows}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a in sorted(rows):
        for b in sorted(rows):
            if a < b and sets[a] and sets[b] and (both := len(sets[a] & sets[b])) and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: r for i, r in rows.items() if root(i) == i}


def decontaminate(spark, rows, d):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = [w for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() if (w := words(r.text))]
    needles = [shingles(w, min(5, len(w))) for w in items]

    def leaks(t):
        own = {n: shingles(words(t), n) for n in range(1, 6)}
        return any(len(x & own[len(next(iter(x)))]) >= 0.8 * len(x) for x in needles)

    return {i: r for i, r in rows.items() if not leaks(r[0])}


def test_stages_as_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = {r.doc_id: (r.text, r.source, r.n_chars) for r in docs.collect()}
        docs = materialise(stage(spark, docs, tables), name)
        got = {r.doc_id: (r.text, r.source, r.n_chars) for r in docs.collect()}
        want = globals()[name](spark, rows, tables)
        assert docs.columns == names and docs.count() == len(got)
        assert got == want, name
        sizes.append((len(rows), len(got), sum(rows[i] != got[i] for i in got)))
    # every stage has something to do
    assert sizes[0][1] < sizes[0][0] and sizes[1][2] >= 10 and sizes[2][1] <= sizes[2][0] - 3 and sizes[3][1] < sizes[3][0]

    packed = corpus_pipeline.run(spark, tables).toPandas()
    whole = Tokenizer.from_file(default_tokenizer())
    assert set(packed.doc_id) == set(got)
    for i, pieces in packed.groupby("doc_id"):
        n = len(whole.encode(got[i][0] or "", add_special_tokens=False).ids) + 1
        pieces = pieces.sort_values("start")
        assert list(pieces.start) == [0, *np.cumsum(pieces.length)[:-1]] and pieces.length.sum() == n
    assert packed.groupby("sequence_id").length.sum().max() <= 1024


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_lines_of_null_and_repeated_ids(spark):
    rows = [(i, f"own {i}\nShare this page", f"s{i}", 0) for i in range(12)]
    rows += [(50, "one\nShare this page", "s1", 1), (50, "two\nShare this page", "s2", 2), (50, "three", "s3", 3)]
    ddl = "doc_id long, text string, source string, n_chars long"
    out = sorted(map(tuple, corpus_pipeline.lines(spark, spark.createDataFrame(rows, ddl), "").collect()))
    want = [(0, "own 0\nShare this page", "s0", 0), *((i, f"own {i}", f"s{i}", len(f"own {i}")) for i in range(1, 12))]
    assert out == sorted([*want, (50, "one", "s1", 3), (50, "two", "s2", 3), (50, "three", "s3", 3)])
    nulls = [(None, f"null {i}\nShare this page", f"s{i}", 0) for i in range(12)]
    out = corpus_pipeline.lines(spark, spark.createDataFrame([*nulls, (5, "five\nShare this page", "s", 0)], ddl), "").collect()
    assert {r.text for r in out if r.doc_id == 5} == {"five"} and len(out) == 13


def test_near_duplicates_of_null_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text, "en"), (7, text + " more", "en"), (8, text, "en"), (None, "alone", None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted((r.doc_id or 0, r.text, r.lang or "") for r in out.collect()) == [(0, "alone", ""), (7, text + " more", "en")]


def test_quality_and_decontamination_judge_rows(spark, tables):
    """Rows that share an id, or have none, are judged by their own texts; other columns stay."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    item = spark.read.parquet(f"{tables}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(70, f"before {item} after", "leak"), (70, "a clean text of its own", "clean"), (None, f"so {item}", "leak"), (None, "another clean text", "clean"), (71, f"x {item}", "leak"), (71, f"x {item}", "leak"), (72, None, "clean"), (73, "", "clean"), (74, "same", "clean"), (74, "same", "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row1 string").withColumns({"words": F.lit(1), "item_id": F.lit("x"), "part": F.lit(2.5)})
    out = corpus_pipeline.decontaminate(spark, df, tables)
    assert out.columns == df.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, df.where("__row1 = 'clean'").collect()))

    texts = [r.text for r in docs.limit(60).collect()]
    rows = [(None if i % 3 == 0 else 80 + i // 4, t, i) for i, t in enumerate([*texts, *texts[:5], None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("predicted", F.lit("x"))
    both = df.unionByName(docs.select("doc_id", "text", F.lit(-1).alias("score"), F.lit("").alias("predicted")))
    out = corpus_pipeline.quality(spark, both, tables)
    model = train(both, spark.read.parquet(f"{tables}/labels.parquet").select("doc_id", "quality"))
    got = sorted(r.score for r in out.where("score >= 0").collect())
    assert got == [i for _, t, i in rows if model.score(t) >= 0.7] and 0 < len(got) < len(rows)


def test_packing_of_odd_rows(spark):
    rows = [(None, "some text"), (1, None), (1, None), (2, "x"), (2, "x"), (2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rank": F.lit(1), "start": F.lit("s")})
    out = corpus_pipeline.packing(spark, df, "")
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in out.where("start = 0").collect()) == [(0, 3), (1, 1), (1, 1), (2, 2), (2, 2), (2, 2)]
