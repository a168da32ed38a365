"""Streams over several micro-batches give what the batch operators give over all rows."""

from pyspark.sql import functions as F

from spark_netwatch.operators.correlate import correlate
from spark_netwatch.operators.greedy import greedy_accept
from spark_netwatch.sources import logs
from spark_netwatch.streaming import twins

US = 1_000_000


def batches(spark, frames, name):
    """A stream with one micro-batch a frame."""
    path = twins.scratch(spark, name)
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return twins.source(spark, path, frames[0].schema, 1)


def test_cooldown_goes_on_over_batches_and_absorbs_late_events(spark):
    schema = "k string, ts long, id string"
    rows = [("hot", t * 40 * US, f"h{t}") for t in range(30)] + [("b", 500 * US, "b0"), (None, 7 * US, "n0"), (None, 800 * US, "n1")]
    rows.sort(key=lambda r: r[1])
    frames = [spark.createDataFrame(rows[i:i + 11], schema) for i in (0, 11, 22)]
    want = {r.id for r in greedy_accept(spark.createDataFrame(rows, schema).withColumn("k", F.coalesce("k", F.lit("-"))),
                                        "k", "ts", "id", 300 * US).filter("accepted").collect()}
    late = spark.createDataFrame([("hot", 1100 * US, "late")], schema)      # after h25 (1000 s) was accepted
    got = twins.greedy_stream(batches(spark, [*frames, late], "t-greedy"), "k", "ts", "id", 300, "t")
    assert sorted(r.id for r in got.collect()) == sorted(want)


def test_correlation_meets_tactics_of_earlier_batches(spark):
    schema = "source_ip string, event_id string, ts_us long, mitre_tactic string, severity double"
    tactics = ["Discovery", "Execution", None, "Impact", "Unknown", "Discovery"]
    rows = [("9.9.9.9", f"e{i}", i * 200 * US, tactics[i % 6], 5.0) for i in range(12)] + [("8.8.8.8", "x", 900 * US, "Impact", 5.0)]
    rows.sort(key=lambda r: r[2])
    whole = correlate(spark.createDataFrame(rows, schema).withColumn("confidence", F.lit(1.0)))
    got = twins.correlation_stream(batches(spark, [spark.createDataFrame(rows[i:i + 5], schema) for i in (0, 5, 10)], "t-corr"), name="t")
    assert sorted((r.event_id, r.tactics, r.stages) for r in got.collect()) == sorted((r.event_id, r.tactics, r.stages) for r in whole.collect())


def test_flush_keeps_the_first_row_of_an_id_over_batches(spark):
    schema = "row_id long, Event_ID string, Source_IP string, Label string"
    frames = [spark.createDataFrame(rows, schema) for rows in (
        [(3, "a", "ip3", "1"), (1, "a", "ip1", "1"), (2, "b", "ip2", "0")],
        [(4, "a", "ip4", "1"), (5, "b", "ip5", "1"), (6, None, "ip6", "1"), (7, "b", "ip7", "1")],
        [(8, None, "ip8", "1"), (9, "", "ip9", "1"), (10, "c", "ip10", "1")])]
    got = twins.flush_threats(batches(spark, frames, "t-flush"), "t")
    assert sorted((r.event_id, r.source_ip) for r in got.collect()) == [("", "ip6"), ("a", "ip1"), ("b", "ip5"), ("c", "ip10")]
    assert got.columns == [c for c, _, _ in logs.THREAT_COLUMNS]


def test_minutes_close_by_watermark_and_count_sources_once(spark):
    schema = "ts_us long, source_ip string, label int, severity double"
    rows = [(5 * US, "a", 1, 8.0), (6 * US, "a", 1, 8.0), (7 * US, "b", 1, 5.0), (8 * US, None, 0, 1.0), (61 * US, "a", 0, 0.0)]
    end = [(90_000 * US, None, None, None)]
    got = twins.minute_metrics(batches(spark, [spark.createDataFrame(r, schema) for r in (rows, end)], "t-min"))
    out = sorted(tuple(r) for r in twins.run_to_table(spark, got, "t-min").collect())
    assert out == [("1970-01-01 00:00:00.000000", 4, 3, 2, 1), ("1970-01-01 00:01:00.000000", 1, 0, 1, 0)]
