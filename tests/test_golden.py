"""Golden values read from the reference."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from spark_netwatch.operators import classify, correlate, dpi, flows
from spark_netwatch.operators.greedy import greedy_accept
from spark_netwatch.functions.text import base64_unwrap, text_entropy
from spark_netwatch.sources.fixtures import PAYLOADS, view

US = 1_000_000


def test_cooldown_sequence(spark):
    times = [0, 100, 299, 300, 550, 600, 901]
    df = spark.createDataFrame([("x", t * US, i) for i, t in enumerate(times)], "k string, ts long, id long")
    out = greedy_accept(df, "k", "ts", "id", 300 * US).filter("accepted").orderBy("ts")
    assert [r.ts // US for r in out.collect()] == [0, 300, 600, 901]


def test_cooldown_on_packets_sf001(spark):
    from spark_netwatch.operators.respond import alert_gate
    p = view(spark, SF01, "net_packets")
    g = alert_gate(p, key="src_ip", eid="packet_id", threshold=None)
    assert g.filter(F.col("alert_status") == "sent").count() == 1580


def test_sessions_sf001(spark):
    s = flows.flow_summary(view(spark, SF01, "net_packets"))
    assert s.count() == 185


def test_correlation_window_sets(spark):
    rows = [("x", "e0", 0 * US, "Reconnaissance", 5.0, 60.0), ("x", "e1", 100 * US, "Initial Access", 5.0, 60.0),
            ("x", "e2", 800 * US, "Reconnaissance", 5.0, 60.0)]
    df = spark.createDataFrame(rows, "source_ip string, event_id string, ts_us long, mitre_tactic string, severity double, confidence double")
    out = {r.event_id: r.tactics for r in correlate.correlate(df).collect()}
    assert out == {"e0": ["Reconnaissance"], "e1": ["Initial Access", "Reconnaissance"], "e2": ["Reconnaissance"]}


def test_correlation_escalation_three_tactics(spark):
    rows = [("1.2.3.4", f"e{i}", i * US, t, 5.0, 60.0) for i, t in enumerate(["Discovery", "Execution", "Impact"])]
    df = spark.createDataFrame(rows, "source_ip string, event_id string, ts_us long, mitre_tactic string, severity double, confidence double")
    last = correlate.correlate(df).filter("event_id = 'e2'").first()
    assert last.escalated and last.corr_severity == 9.5 and last.corr_confidence == 80.0
    assert last.action_taken == "Correlated & Escalated"
    one = correlate.correlate(df.limit(1)).first()
    assert not one.escalated and one.corr_severity == 5.0


def test_correlation_independent_ips(spark):
    rows = [("a", "e0", 0, "Discovery", 5.0, 60.0), ("b", "e1", 1, "Execution", 5.0, 60.0)]
    df = spark.createDataFrame(rows, "source_ip string, event_id string, ts_us long, mitre_tactic string, severity double, confidence double")
    assert all(not r.escalated for r in correlate.correlate(df).collect())


def test_entropy(spark):
    df = spark.createDataFrame([("aab",), ("",)], "t string")
    vals = [r.e for r in df.select(text_entropy("t").alias("e")).collect()]
    assert vals == [0.9183, 0.0]


def test_base64_unwrap(spark):
    df = spark.createDataFrame([("Y2F0IC9ldGMvcGFzc3dk",), ("@@@",)], "t string")
    text, flag = base64_unwrap(F.col("t"))
    got = [(r.x, r.f) for r in df.select(text.alias("x"), flag.alias("f")).collect()]
    assert got == [("cat /etc/passwd", True), ("@@@", False)]


EXPECTED_FIRST_RULE = {
    0: "DPI-005", 1: "DPI-001", 2: "DPI-001", 3: "DPI-003", 4: "DPI-003", 5: "DPI-004", 6: "DPI-004", 7: "DPI-004",
    8: "DPI-004", 9: "DPI-005", 10: "DPI-005", 11: "DPI-003", 12: "DPI-001", 13: "DPI-004", 14: None, 15: "DPI-001",
    16: "DPI-005", 17: "DPI-005", 18: "DPI-005", 19: "DPI-003", 20: "DPI-007", 21: "DPI-008", 22: "DPI-005", 23: None,
    24: "DPI-005", 25: "DPI-004", 26: None, 27: None, 28: None, 29: None, 30: None,
}


def test_payload_first_rules(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "pid long, text string")
    scanned = dpi.dpi_scan(df, "text").collect()
    got = {r.pid: (r.dpi_rule_id if r.dpi_rule_id != "DPI-AI" else None) for r in scanned}
    assert got == EXPECTED_FIRST_RULE
    b64 = {r.pid for r in scanned if r.dpi_base64}
    assert b64 == {18, 19}


def test_compat_mode_flags_every_long_unmatched_payload(spark):
    df = spark.createDataFrame(list(enumerate(PAYLOADS)), "pid long, text string")
    ai = {r.pid for r in dpi.dpi_scan(df, "text", compat=True).collect() if r.dpi_rule_id == "DPI-AI"}
    assert ai == {14, 23, 26, 27, 28, 29}


def test_classifier_confidences(spark):
    texts = ["port scan detected", "normal status update", "an attack happened", "suspicious activity", "bash -c ls"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = classify.classify_text(df, "t").collect()
    assert {r.confidence for r in out} <= {95.0, 93.0, 85.0}
    by = {r.t: r for r in out}
    assert by["normal status update"].is_threat is False and by["normal status update"].threat_type == "Normal Traffic"
    assert by["an attack happened"].method == "GenAI Threat Intel"
    assert by["suspicious activity"].confidence == 93.0
    assert by["bash -c ls"].threat_type == "Remote Code Execution Attempt"
    assert by["bash -c ls"].explanation.endswith("[MITRE ATT&CK: T1059 - Command and Scripting Interpreter]")
