"""Cleaner matrix: each rule x {missing, valid, dirty, out of range}."""

import pytest

from spark_netwatch.operators.clean import clean_cells, clean_event_log, cleaning_stats

AS_OF = "2024-02-01 00:00:00"


def clean_one(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"row_id long, {column} string")
    return [(r[column], r._missing, r._invalid) for r in clean_cells(df, AS_OF).orderBy("row_id").collect()]


def test_timestamps(spark):
    got = clean_one(spark, "Timestamp", ["2024-01-02 03:04:05", "2024-01-02T03:04:05", "13/01/2024 03:04:05",
                                         "01/13/2024 03:04:05", "2024-01-02 03:04:05.123456", "N/A", "garbage"])
    assert got == [("2024-01-02 03:04:05", 0, 0), ("2024-01-02 03:04:05", 0, 1), ("2024-01-13 03:04:05", 0, 1),
                   ("2024-01-13 03:04:05", 0, 1), ("2024-01-02 03:04:05", 0, 1), (AS_OF, 1, 1), ("garbage", 0, 0)]


def test_booleans(spark):
    assert clean_one(spark, "Base64_Detected", ["Yes", "YES", "0", "undefined", "maybe"]) == [
        ("Yes", 0, 0), ("Yes", 0, 1), ("No", 0, 1), ("No", 1, 0), ("maybe", 0, 0)]
    assert clean_one(spark, "Admin_Mode", ["yes", "", "False"]) == [("True", 0, 1), ("False", 1, 0), ("False", 0, 0)]


def test_flags(spark):
    assert clean_one(spark, "Label", ["1", "true", "7", "", "1.0"]) == [
        ("1", 0, 0), ("1", 0, 1), ("0", 0, 1), ("0", 1, 0), ("1", 0, 1)]


def test_ips(spark):
    assert clean_one(spark, "Source_IP", ["10.0.0.1", "null", "300.1.1.1"]) == [
        ("10.0.0.1", 0, 0), ("0.0.0.0", 1, 0), ("300.1.1.1", 0, 1)]
    assert clean_one(spark, "Blocked_IP", [""]) == [("", 0, 0)]


def test_ports(spark):
    assert clean_one(spark, "Destination_Port", ["80", "70000", "-5", "abc", "443.0", ""]) == [
        ("80", 0, 0), ("65535", 0, 1), ("0", 0, 1), ("0", 0, 1), ("443", 0, 1), ("0", 1, 0)]


def test_confidence(spark):
    assert clean_one(spark, "AI_Confidence", ["45%", "150", "-", "bad", "12.345"]) == [
        ("45.0", 0, 0), ("100.0", 0, 1), ("0.0", 1, 0), ("0.0", 0, 1), ("12.35", 0, 0)]


def test_packet_counts(spark):
    assert clean_one(spark, "Packet_Count", ["5", "-1", "2.0", "x"]) == [
        ("5", 0, 0), ("0", 0, 1), ("2", 0, 1), ("0", 0, 1)]


def test_numerics_and_non_finite(spark):
    assert clean_one(spark, "Duration", ["42", "3.14159", "12s", "1e5", "inf", "3.0"]) == [
        ("42", 0, 0), ("3.1416", 0, 0), ("0", 0, 1), ("100000", 0, 0), ("0", 0, 1), ("3.0", 0, 0)]


def test_categoricals(spark):
    assert clean_one(spark, "Protocol", ["tcp", " TCP ", "Udp", "n/a", "GRE"]) == [
        ("TCP", 0, 1), ("TCP", 0, 0), ("UDP", 0, 1), ("TCP", 1, 0), ("GRE", 0, 0)]


def test_control_chars_and_nfc(spark):
    got = clean_one(spark, "Detection_Method", ["a\x00b", "é"])
    assert got == [("ab", 0, 0), ("é", 0, 0)]


def test_required_id_and_uniqueness(spark):
    rows = [(1, "EVT-1", "tcp"), (2, "EVT-1", "udp"), (3, "", "tcp"), (4, "EVT-1", "icmp"), (5, "EVT-1", "icmp")]
    df = spark.createDataFrame(rows, "row_id long, Event_ID string, Protocol string")
    out = {r.row_id: r.Event_ID for r in clean_event_log(df, AS_OF).collect()}
    # row 5 is an exact duplicate of row 4 after cleaning: dropped before ids are made unique
    assert out == {1: "EVT-1", 2: "EVT-1_dup1", 3: "EVT-RECOVERED-3", 4: "EVT-1_dup2"}
    compat = {r.row_id: r.Event_ID for r in clean_event_log(df, AS_OF, compat=True).collect()}
    assert compat == {1: "EVT-1", 2: "EVT-1_dup1", 3: "EVT-RECOVERED-3", 4: "EVT-1_dup2", 5: "EVT-1_dup3"}
    s = cleaning_stats(df, AS_OF).first()
    assert (s.total_rows, s.duplicate_rows_removed) == (5, 1)


def test_id_suffixes_over_many_stretches_equal_one(spark):
    rows = [(i, "EVT-HOT" if i % 3 else f"EVT-{i}", f"m{i}") for i in range(2500)]
    df = spark.createDataFrame(rows, "row_id long, Event_ID string, Detection_Method string")
    a, b = ({(r.row_id, r.Event_ID) for r in clean_event_log(df, AS_OF, parts=n).collect()} for n in (1, 40))
    assert a == b and len([1 for _, e in a if "_dup" in e]) == 1665


def test_id_suffixes_pass_over_many_taken_numbers(spark):
    # every third row the hot id, every third one of its numbers; odd numbers, repeats and look-alikes besides
    ids = [("H", f"H_dup{i // 2 + 1}", f"E{i}")[i % 3] for i in range(6000)]
    ids += ["H_dup03", "H_dup0", "H_dup1_dup1", "H_dup2", "H_dup2", "_dup1", "_dup1", "H_dup9999999999", "H_dup99999999999999999999", "H_dupx", "E0", "E2"]
    df = spark.createDataFrame([(i, v, f"m{i}") for i, v in enumerate(ids)], "row_id long, Event_ID string, Detection_Method string")
    want, seen, last, stored = [], set(), {}, set(ids)
    for v in ids:
        out = v
        if v in seen:
            k = last.get(v, 0) + 1
            while f"{v}_dup{k}" in stored:
                k += 1
            last[v], out = k, f"{v}_dup{k}"
        seen.add(v)
        want.append(out)
    assert len(set(want)) == len(want)
    for parts in (1, 30):
        rows = clean_event_log(df, AS_OF, parts=parts)
        plan = rows._jdf.queryExecution().toString()
        assert "collect_set" not in plan and "sequence(" not in plan
        assert [r.Event_ID for r in sorted(rows.collect(), key=lambda r: r.row_id)] == want
