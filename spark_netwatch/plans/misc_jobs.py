"""Registered jobs: D7, F16, F20, F28, J12, S7, S10, U2."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions.net import split_endpoint
from ..operators import dpi, flows, respond
from ..operators.features import flow_rate_features
from ..session import spread
from .flow_jobs import A1_SQL
from .registry import ORACLE, job, v, w
from .source_jobs import RAW_COLS, RAW_CSV_SQL, _raw_text, scratch
from .sqlgen import SIG_VALUES
from .verdict_jobs import VERDICT_BASE, run_verdicts


@job("D7_quality_columns", VERDICT_BASE + """SELECT packet_id, 0.0 AS Detection_Accuracy, 0.0 AS False_Positive_Rate,
  0.0 AS False_Negative_Rate, 0.0 AS Precision_Score, 0.0 AS Recall_Score, 0.0 AS F1_Score FROM vd""")
def d7_quality(spark, sf):
    from ..operators.verdict import event_row
    row = event_row(run_verdicts(spark, sf))
    cols = ["Detection_Accuracy", "False_Positive_Rate", "False_Negative_Rate", "Precision_Score", "Recall_Score", "F1_Score"]
    return row.select(F.col("Dataset_Row_ID").cast("bigint").alias("packet_id"), *[F.col(c).cast("double").alias(c) for c in cols])


@job("F16_port_scan_proxy", f"SELECT src_ip, sess, packets, CASE WHEN packets > 15 THEN 1 ELSE 0 END AS Is_Port_Scan FROM ({A1_SQL})")
def f16_proxy(spark, sf):
    return flow_rate_features(flows.flow_summary(v(spark, sf, "net_packets"))).select("src_ip", "sess", "packets", "Is_Port_Scan")


@job("F20_endpoint_split", w("net_packets") + """SELECT packet_id, split_part(ep, ':', 1) AS ip,
  CASE WHEN contains(ep, ':') THEN substr(ep, strpos(ep, ':') + 1) ELSE '' END AS port
FROM (SELECT packet_id, src_ip || ':' || CAST(src_port AS VARCHAR) AS ep FROM net_packets)""")
def f20_split(spark, sf):
    p = v(spark, sf, "net_packets").select("packet_id", F.concat_ws(":", "src_ip", F.col("src_port").cast("string")).alias("ep"))
    ip, port = split_endpoint("ep")
    return p.select("packet_id", ip.alias("ip"), port.alias("port"))


@job("F28_rounding", f"SELECT packet_id, Duration, Rate, Byte_Rate FROM ({ORACLE['D1_feature_vector']})")
def f28_rounding(spark, sf):
    from .flow_jobs import d1_feature_vector
    return d1_feature_vector(spark, sf).select("packet_id", "Duration", "Rate", "Byte_Rate")


def _auto_signature_file(spark, sf, *more: dict) -> str:
    """The playbook's Level-5 rule (D5 ``AUTO_SIGNATURE``) and ``more``, written once as a custom-signature JSON file."""
    acts = respond.playbook(v(spark, sf, "threat_events")).filter(F.col("action") == "AUTO_SIGNATURE")
    first = acts.orderBy("ts_us", "event_id").select(F.unix_seconds("timestamp").alias("s")).first()
    sigs = [] if first is None else [{"id": f"AUTO-SIG-UEBA-{first['s']}", "name": "Level 5 Auto-Generated Rule",
                                      "regex": "UEBA-BEHAVIOR-BLOCK-.*", "severity": "Critical", "mitre": "T1566"}]
    path = scratch(spark, "sigs") + ".json"
    sigs += more
    spark.createDataFrame([(json.dumps(sigs),)], "value string").coalesce(1).write.text(path)
    return path


AUTO_SQL = w("threat_events") + """, u AS (SELECT CAST(floor(epoch(arg_min(timestamp, (ts_us, event_id)))) AS BIGINT) AS s
  FROM threat_events WHERE contains(detection_method, 'UEBA Predictive Engine')
    AND source_ip IS NOT NULL AND source_ip <> '' AND source_ip <> '127.0.0.1' HAVING count(*) > 0)
"""


@job("S7_load_signatures", AUTO_SQL + f"""SELECT sig_order, id, name, severity, confidence, cwe FROM {SIG_VALUES}
UNION ALL SELECT 10, 'AUTO-SIG-UEBA-' || CAST(s AS VARCHAR), 'Level 5 Auto-Generated Rule', 'Critical', 100.0, 'Custom' FROM u""")
def s7_signatures(spark, sf):
    sigs = dpi.load_signatures(spark, _auto_signature_file(spark, sf))
    return sigs.select("sig_order", "id", "name", "severity", "confidence", "cwe")


TRACKER = {"id": "CUSTOM-TRACK", "name": "Tracking call", "pattern": r"track\(\d*[02468]\)", "severity": "Low"}


@job("U2_signature_union_scan", AUTO_SQL + f"""SELECT page_id, CAST(regexp_matches(html, 'UEBA-BEHAVIOR-BLOCK-.*') AND EXISTS (FROM u) AS INTEGER)
  + CAST(regexp_matches(html, '{TRACKER["pattern"]}') AS INTEGER) AS custom_hits FROM pages""")
def u2_union_scan(spark, sf):
    """Custom rules beside the built-in ones; one of them stands in about half of the pages."""
    sigs = dpi.load_signatures(spark, _auto_signature_file(spark, sf, TRACKER))
    pages = spread(spark.read.parquet(f"{sf}/pages.parquet"), "page_id")
    m = dpi.all_matches(pages, "html", sigs)
    return m.select("page_id", F.size(F.filter("matched_rules", lambda r: r.startswith("AUTO-SIG") | r.startswith("CUSTOM-"))).alias("custom_hits"))


_F26 = ORACLE["F26_incident_brief"]
_TE = w("threat_events")


@job("J12_enrichment_join", _TE + ", b AS (" + _F26[len(_TE):] + """)
SELECT t.event_id, t.severity, b.brief FROM threat_events t LEFT JOIN b USING (event_id)""")
def j12_enrichment(spark, sf):
    from ..operators import threats
    te = v(spark, sf, "threat_events")
    briefs = threats.incident_brief(te.filter("severity >= 9.0"))
    return threats.attach_enrichment(te.select("event_id", "severity"), briefs)


@job("S10_stream_event_log", RAW_CSV_SQL)
def s10_stream(spark, sf):
    """New CSV files appended to the log folder are read as new rows (file stream, availableNow)."""
    from ..sources import logs
    from ..streaming import twins
    path = scratch(spark, "s10")
    text = _raw_text(spark, sf)
    n = text.agg(F.max(F.col("row_id").cast("long"))).first()[0] or 0
    for i in range(4):                               # four appends, in row order
        part = text.filter(F.floor(F.col("row_id").cast("long") * 4 / (n + 1)) == i)
        (part.write.mode("append").option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    stream = logs.stream_event_log(spark, path, RAW_COLS, max_files_per_trigger=4)
    return twins.run_to_table(spark, stream, "s10")
