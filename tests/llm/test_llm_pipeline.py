"""The pipeline's stages, each on its own input."""

from pyspark.sql import functions as F

import corpus_pipeline
from mapmill.storage import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), name)
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where(F.col("n_chars") != F.length("text")).count() == 0
        docs = out
    before, after = seen["quality"]
    assert 0 < after.count() < before.count() and after.join(before, before.columns, "left_anti").count() == 0
    before, after = seen["line_dedup"]
    assert after.count() == before.count()
    before, after = seen["near_dedup"]
    assert after.select("doc_id").distinct().count() == after.count() < before.count()
    assert after.groupBy("text").count().where("count > 1 and length(text) > 0").count() == 0
    words = lambda d: d.select(F.sum(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))).first()[0]
    before, after = seen["mixing"]
    assert abs(words(after) - words(before)) <= 40
    before, after = seen["packing"]
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert after.where("start = 0").count() == before.count()


def test_run_registered(spark, sf):
    import __spark_entry__

    out = __spark_entry__.queries()["pipeline"](spark, sf)
    assert out.columns[0] == "doc_id" and out.where("length > 0").count() == out.count() > 0


LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ODD = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n ", "en", "a", 3), (None, "no id here", "en", "b", 10), (None, "no id here", "en", "b", 10), (4, LONG, None, "a", len(LONG)), (4, LONG, None, "a", len(LONG)), (5, LONG, "de", None, len(LONG)), (None, None, None, None, None)]
CLASH = ["kept", "size", "n_lines", "one", "text_hash", "label", "part", "row", "sequence_id", "start"]


def test_stages_take_odd_rows(spark, sf):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("own"))
    got = {name: stage(spark, docs, sf) for name, stage in corpus_pipeline.STAGES}
    for name, out in got.items():
        got[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and all(r[c] == "own" for r in got[name] for c in CLASH)
    key = lambda rows: sorted((str(r.doc_id), len(r.text or "")) for r in rows)
    assert len(got["quality"]) == sum(ODD[i][1] in {r.text for r in got["quality"]} for i in range(len(ODD)))
    assert key(got["line_dedup"]) == sorted((str(i), 0 if i == 5 else len(t or "")) for i, t, *_ in ODD)
    assert key(got["near_dedup"]) == sorted([("1", 0), ("2", 0), ("3", 3), ("None", 10), ("4", len(LONG)), ("None", 0)])
    assert {str(r.doc_id) for r in got["mixing"]} <= {"None", "4", "5"} and all(r.text for r in got["mixing"])
    ends = [r for r in got["packing"] if r.start + r.length == r.doc_tokens]
    assert sorted(str(r.doc_id) for r in ends) == sorted(str(i) for i, *_ in ODD)


def test_stages_take_an_empty_table(spark, sf):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
