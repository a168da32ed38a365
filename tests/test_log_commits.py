"""Commits of many files, a commit a micro-batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_netwatch.streaming import twins


def test_each_commit_has_its_files(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in (0, 1, 2, 500, 501, 999)], "row_id bigint, text string")
    path = twins.scratch(spark, "commits")
    twins.stage_files(df, path, "row_id", slices=3, files=4)
    out = twins.run_to_table(spark, twins.source(spark, path, df.schema, 4).withColumn("at", F.current_timestamp()), "commits")
    times = {r["row_id"]: r["at"] for r in out.collect()}
    assert sorted(times) == [0, 1, 2, 500, 501, 999]
    assert times[0] == times[1] == times[2] < times[500] == times[501] < times[999]
