"""The pipeline's stages take effect, keep the columns and leave clean documents alone."""

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, labels = docs.columns, spark.read.parquet(f"{SF}/labels.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids.append({r.doc_id for r in docs.select("doc_id").distinct().collect()})
        assert ids[-1] <= ids[-2]
        if name != "packing":
            assert docs.columns == first and docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    assert len(good & ids[1]) > 0.97 * len(good) and not ({r.doc_id for r in labels.filter("quality = 0").collect()} & ids[1])
    assert ids[5] == ids[4] and [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "repeats", "packing"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "quite another text with some words of its own"), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in P.near_duplicates(spark, docs, "").collect()) == [1, 4, 5, 6]


def test_repeated_row_stays_in_the_repeats_stage(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (1, text), (2, "short")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in P.repeats(spark, docs, "").collect()) == [(1, text), (1, text), (2, "short")]


def test_repeats_stage_keeps_one_occurrence(spark):
    passage, rest = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "rest"))
    rows = [(1, passage), (2, "before " + passage + " " + rest), (3, rest + " after")]
    got = {r.doc_id: r.text for r in P.repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {1: passage, 2: "before  " + rest, 3: " after"}
