"""Cases that the given tables don't reach: peers, id collisions, white space, late matches, micro-batches."""

from pyspark.sql import functions as F

from conftest import SF001
from spark_netwatch.functions.text import base64_unwrap, byte_entropy
from spark_netwatch.operators import clean, dpi
from spark_netwatch.operators.correlate import correlate
from spark_netwatch.sources.fixtures import view
from spark_netwatch.streaming import twins


def test_base64_is_unwrapped_with_white_space_around_it(spark):
    df = spark.createDataFrame([("Y2F0IC9ldGMvcGFzc3dk\r\n",), ("\t Y2F0IC9ldGMvcGFzc3dk\x0b",), ("Y2F0IC9ldGMvcGFzc3dk",)], "t string")
    text, flag = base64_unwrap(F.col("t"))
    assert [(r.x, r.y) for r in df.select(text.alias("x"), flag.alias("y")).collect()] == [("cat /etc/passwd", True)] * 3


def test_events_of_one_instant_are_peers(spark):
    rows = [("9.9.9.9", 10**9, f"e{i}", t, 5.0, 50.0) for i, t in enumerate(["Discovery", "Execution", "Impact"])]
    df = spark.createDataFrame(rows, "source_ip string, ts_us long, event_id string, mitre_tactic string, severity double, confidence double")
    for parts in (1, 9):
        assert [(r.stages, r.tactics) for r in correlate(df, parts=parts).collect()] == [(3, ["Discovery", "Execution", "Impact"])] * 3


def test_suffixed_ids_pass_over_ids_in_the_log(spark):
    ids = ["X_dup1", "X", "X", "X", "X_dup1", "Y", "Y"]
    df = spark.createDataFrame(list(enumerate(ids)), "row_id long, Event_ID string")
    for parts in (1, 5):
        out = [r.Event_ID for r in clean._suffix_ids(df, "row_id", parts=parts).orderBy("row_id").collect()]
        assert out == ["X_dup1", "X", "X_dup2", "X_dup3", "X_dup1_dup1", "Y", "Y_dup1"]


def test_a_match_after_64_kib_is_found(spark):
    df = spark.createDataFrame([(1, "a" * 70000 + " /etc/passwd")], "id long, payload string")
    assert dpi.dpi_scan(df).first().dpi_rule_id == "DPI-005"
    assert dpi.all_matches(df).first().matched_rules == ["DPI-005"]


def test_entropy(spark):
    df = spark.createDataFrame([(b"",), (None,), (b"aaaa",), (b"ab" * 8,), (bytes(range(256)),)], "b binary")
    assert [r.e for r in df.select(byte_entropy("b").alias("e")).collect()] == [0.0, 0.0, 0.0, 1.0, 8.0]


def test_streamed_cleaning_keeps_all_rows_for_any_batch_size(spark):
    raw = view(spark, SF001, "raw_event_log")
    path = twins.scratch(spark, "t")
    twins.stage_files(raw, path, "row_id")
    found = [sorted(r.row_id for r in twins.incremental_clean(twins.source(spark, path, raw.schema, n), "2024-01-31 00:00:00").collect()) for n in (1, 8)]
    assert found[0] == found[1] and len(found[0]) == 1000
