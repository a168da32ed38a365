"""Registered source / sink jobs: S1-S5, S11, S13-S15.

Round trips write data derived from the given tables under the session's
checkpoint folder (the shared folder a cluster names), then read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import logs
from ..sources.packets import evidence, packets_with_payload, read_packets
from .registry import duck_ts, job, ts_text, v, w

RAW_COLS = ["row_id", "Timestamp", "Event_ID", "Source_IP", "Destination_Port", "Protocol", "AI_Confidence",
            "Base64_Detected", "Label", "Duration", "Detection_Method"]


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/netwatch-{name}-{uuid.uuid4().hex}"


def _raw_text(spark, sf):
    r = v(spark, sf, "raw_event_log")
    return r.select(*[F.col(c).cast("string").alias(c) for c in RAW_COLS])


RAW_TEXT_SQL = w("raw_event_log") + "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in RAW_COLS) + " FROM raw_event_log"
# an empty CSV field reads back as null, as in pandas
RAW_CSV_SQL = w("raw_event_log") + "SELECT " + ", ".join(f"NULLIF(CAST({c} AS VARCHAR), '') AS {c}" for c in RAW_COLS) + " FROM raw_event_log"


@job("S1_read_event_log", RAW_CSV_SQL)
def s1_read(spark, sf):
    path = scratch(spark, "s1")
    _raw_text(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    return logs.read_event_log(spark, path, RAW_COLS)


@job("S2_write_event_log", w("raw_event_log") + """SELECT COALESCE(substr(Timestamp, 1, 10), 'unknown') AS date,
  CAST(count(*) AS BIGINT) AS rows FROM raw_event_log GROUP BY 1""")
def s2_write(spark, sf):
    path = scratch(spark, "s2")
    logs.write_event_log(_raw_text(spark, sf), path, max_records_per_file=2000)
    return _written_log(spark, path).groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


def _written_log(spark, path):
    schema = ", ".join(f"{c} string" for c in [*RAW_COLS, "date"])
    return (spark.read.option("header", True).option("basePath", path).option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False).schema(schema).csv(path))


@job("S2_written_rows", RAW_CSV_SQL.replace(" FROM raw_event_log", ", COALESCE(substr(Timestamp, 1, 10), 'unknown') AS date FROM raw_event_log"))
def s2_rows(spark, sf):
    path = scratch(spark, "s2r")
    logs.write_event_log(_raw_text(spark, sf), path, max_records_per_file=2000)
    return _written_log(spark, path)


@job("S3_write_jsonl", w("threat_events") + "SELECT event_id, source_ip, severity FROM threat_events")
def s3_jsonl(spark, sf):
    path = scratch(spark, "s3")
    logs.write_jsonl(v(spark, sf, "threat_events").select("event_id", "source_ip", "severity"), path)
    return spark.read.schema("event_id string, source_ip string, severity double").json(path)


S4_SQL = w("raw_event_log") + """, t AS (SELECT row_id, COALESCE(Event_ID, '') AS event_id, COALESCE(Timestamp, '') AS timestamp,
  COALESCE(Source_IP, '') AS source_ip, CAST(COALESCE(TRY_CAST(Destination_Port AS DOUBLE), 0.0) AS INTEGER) AS destination_port,
  COALESCE(Protocol, 'TCP') AS protocol, COALESCE(Detection_Method, '') AS detection_method,
  COALESCE(TRY_CAST(AI_Confidence AS DOUBLE), 0.0) AS confidence, COALESCE(TRY_CAST(Duration AS DOUBLE), 0.0) AS duration
  FROM raw_event_log WHERE Label = '1')
SELECT event_id, arg_min(timestamp, row_id) AS timestamp, arg_min(source_ip, row_id) AS source_ip,
  arg_min(destination_port, row_id) AS destination_port, arg_min(protocol, row_id) AS protocol,
  arg_min(detection_method, row_id) AS detection_method, arg_min(confidence, row_id) AS confidence,
  arg_min(duration, row_id) AS duration FROM t GROUP BY event_id"""


@job("S4_sink_threats", S4_SQL)
def s4_sink(spark, sf):
    out = logs.sink_threats(v(spark, sf, "raw_event_log"), order_col="row_id")
    return out.select("event_id", "timestamp", "source_ip", "destination_port", "protocol", "detection_method",
                      "confidence", "duration")


@job("S4_store_threats", S4_SQL)
def s4_store(spark, sf):
    """The log in two batches, the second against what the first stored."""
    raw, path = v(spark, sf, "raw_event_log"), scratch(spark, "s4")
    middle = F.lit(raw.agg(F.percentile_approx("row_id", 0.5)).first()[0])
    logs.store_threats(raw.filter(F.col("row_id") < middle), path, "row_id")
    out = logs.store_threats(raw.filter(F.col("row_id") >= middle), path, "row_id")
    return out.select("event_id", "timestamp", "source_ip", "destination_port", "protocol", "detection_method",
                      "confidence", "duration")


@job("U4_event_id_dedupe", S4_SQL.replace("SELECT event_id, arg_min(timestamp", "SELECT event_id, CAST(count(*) AS BIGINT) AS copies, arg_min(timestamp")
     .replace(" AS timestamp, arg_min(source_ip, row_id) AS source_ip,\n  arg_min(destination_port, row_id) AS destination_port, arg_min(protocol, row_id) AS protocol,\n  arg_min(detection_method, row_id) AS detection_method, arg_min(confidence, row_id) AS confidence,\n  arg_min(duration, row_id) AS duration", " AS timestamp"))
def u4_dedupe(spark, sf):
    rows = logs.threat_rows(v(spark, sf, "raw_event_log"), keep=["row_id"])
    counts = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"),
                                         F.min_by("timestamp", F.col("row_id")).alias("timestamp"))
    return counts


@job("S5_export_threats", w("threat_events") + f"""SELECT event_id, {duck_ts('timestamp')} AS ts, source_ip, severity
FROM threat_events ORDER BY timestamp_epoch DESC, event_id DESC LIMIT 10000""")
def s5_export(spark, sf):
    path = scratch(spark, "s5")
    events = v(spark, sf, "threat_events")
    logs.export_threats(events, path, "json")
    out = spark.read.schema(events.schema).json(path)
    return out.select("event_id", ts_text("timestamp").alias("ts"), "source_ip", "severity")


@job("S11_read_packets", w("net_packets") + "SELECT packet_id, src_ip, dst_port FROM net_packets WHERE protocol = 'TCP' AND src_ip IS NOT NULL")
def s11_packets(spark, sf):
    return read_packets(v(spark, sf, "net_packets")).select("packet_id", "src_ip", "dst_port")


@job("S13_evidence")
def s13_evidence(spark, sf):
    from .verdict_jobs import run_verdicts
    vd = run_verdicts(spark, sf).select("packet_id", "is_threat", "method", F.col("dpi_rule_id").alias("rule_id"))
    return evidence(packets_with_payload(spark, sf), vd, scratch(spark, "s13")).select(
        "packet_id", "src_ip", "method", "rule_id", F.octet_length("payload").alias("payload_bytes"), "date")


@job("S14_honeypot_threats", w("honeypot_captures") + """SELECT 'HP-' || CAST(floor(epoch(ts)) AS BIGINT) || '-' || client_ip AS event_id,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, client_ip AS source_ip, client_port AS source_port,
  '127.0.0.1' AS destination_ip, port AS destination_port, 'TCP' AS protocol, 'Active Honeypot Trap' AS detection_method,
  100.0 AS confidence, 10.0 AS severity, 'Honeypot Interaction' AS threat_type,
  'Captured payload: ' || substr(regexp_replace(payload_text, '^\\s+|\\s+$', '', 'g'), 1, 200) AS threat_intel,
  'T1190' AS mitre_technique_id, 'Initial Access' AS mitre_tactic
FROM honeypot_captures WHERE length(COALESCE(payload_text, '')) > 0""")
def s14_honeypot(spark, sf):
    return logs.honeypot_to_threats(v(spark, sf, "honeypot_captures"))


@job("S15_raw_json")
def s15_json(spark, sf):
    t = v(spark, sf, "threat_events").select("event_id", "source_ip", "severity", "mitre_tactic")
    return logs.with_raw_json(t).select("event_id", "raw_json")


@job("S15_raw_json_parsed", w("threat_events") + """SELECT event_id, source_ip, destination_port, label, severity, confidence,
  mitre_tactic, detection_method FROM threat_events""")
def s15_parsed(spark, sf):
    t = v(spark, sf, "threat_events")
    kinds = dict(t.dtypes)
    cols = ["event_id", "source_ip", "destination_port", "label", "severity", "confidence", "mitre_tactic", "detection_method"]
    return logs.from_raw_json(logs.with_raw_json(t), ", ".join(f"{c} {kinds[c]}" for c in cols))
