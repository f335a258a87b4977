from pyspark.sql import functions as F

from quillon.llm.compression_quality import score_quality, train
from quillon.llm.queries import op8_quality_classifier


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    out = op8_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = ((out.score >= 0.5) == (out.quality == 1)).mean()
    good, bad = out[out.quality == 1], out[out.quality == 0]
    print(len(out), right, (good.predicted == 1).mean(), (bad.predicted == 0).mean())
    assert right >= 0.9
    assert (good.predicted == 1).mean() >= 0.93 and (bad.predicted == 0).mean() >= 0.7


def test_edges(spark):
    ddl = "doc_id long, text string, quality int, score double, label string"
    rows = [(i, f"a fine sentence number {i} of words " * 3, 1, None, None) for i in range(30)] + [(100 + i, f"BUY!! {i} NOW!! " * 9, 0, None, None) for i in range(30)]
    rows += [(None, "x", 1, None, None), (500, None, 1, None, None), (501, "", 0, None, None), (502, "y", None, None, None), (503, "é" * 300_000, 1, None, None)]
    df = spark.createDataFrame(rows, ddl)
    model = train(df, df)
    out = {r.doc_id: r.score for r in score_quality(df, model).collect()}
    assert len(out) == len(rows) and all(0 <= s <= 1 for s in out.values())
    assert out[500] == out[501]
    assert score_quality(df.limit(0), model).count() == 0
    untaught = train(df, df.where(F.lit(False)))
    assert {r.score for r in score_quality(df, untaught).collect()} == {0.5}
    one_class = train(df, df.where("quality = 1"))
    assert score_quality(df, one_class).count() == len(rows)
    twice = train(df.union(df), df.union(df))
    assert {r.doc_id: r.score for r in score_quality(df, twice).collect()} == out
