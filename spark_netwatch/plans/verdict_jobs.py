"""Registered verdict jobs: D4 (flagship), P6-P9, P14, P15, D6."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import service_flags
from ..operators import intel, verdict
from ..sources.packets import evidence, packets_with_payload
from .flow_jobs import STATE_SQL
from .intel_jobs import FUSE_SQL, IOC_SQL, VENDOR_SQL
from .registry import job, v, w
from .source_jobs import scratch
from .sqlgen import dpi_sql


def run_verdicts(spark, sf, compat=False):
    pk = packets_with_payload(spark, sf)
    osint = intel.fuse_reputation(intel.vendor_scores(v(spark, sf, "vendor_raw")))
    iocs = intel.read_ioc_feed(v(spark, sf, "ioc_feed"), "line")
    return verdict.verdicts(pk, osint=osint, iocs=iocs, compat=compat)


OUT = ["packet_id", "src_ip", "is_threat", "method", "confidence", "severity", "intel", "technique_id",
       "technique_name", "tactic", "ai_label", "correlated"]

FUSE_CTE = FUSE_SQL.replace("\nSELECT ip,", "\n, osint AS (SELECT ip,", 1) + ")"

VERDICT_BASE = (w("net_packets", "payloads", "vendor_raw", "ioc_feed") + ", " + STATE_SQL.strip() + """,
fl AS (SELECT *, ts_us - start_us AS dur,
  max(CASE WHEN u_rate > 150 THEN 1 ELSE 0 END) OVER wr = 1 AS flag_high_rate,
  max(CASE WHEN size_anomaly THEN 1 ELSE 0 END) OVER wr = 1 AS flag_size,
  max(CASE WHEN unique_ports > 10 THEN 1 ELSE 0 END) OVER wr = 1 AS flag_ports
  FROM rk WINDOW wr AS (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
pk AS (SELECT packet_id, payload_text FROM net_packets JOIN payloads USING (payload_id)),
dp AS (""" + dpi_sql("pk", "payload_text", "packet_id") + ")" + VENDOR_SQL + FUSE_CTE + ", " + IOC_SQL + """,
c1 AS (SELECT fl.*, dp.* EXCLUDE (packet_id),
  CASE WHEN COALESCE(dpi_is_threat, false) THEN 'dpi' WHEN risk10 > 5 THEN 'ueba' ELSE 'none' END AS stage
  FROM fl JOIN dp USING (packet_id)),
c2 AS (SELECT *, stage <> 'none' AS t1,
  CASE stage WHEN 'dpi' THEN 'DPI Security Rule' WHEN 'ueba' THEN 'UEBA Predictive Engine' ELSE 'Heuristic Check' END AS m1,
  CASE stage WHEN 'dpi' THEN dpi_confidence WHEN 'ueba' THEN least(risk10 * 2.0, 99.0) ELSE 0.0 END AS c1,
  CASE stage WHEN 'dpi' THEN (CASE dpi_severity WHEN 'Critical' THEN 9.8 WHEN 'High' THEN 8.0 WHEN 'Medium' THEN 6.0
                                                 WHEN 'Low' THEN 3.0 ELSE 7.0 END)
             WHEN 'ueba' THEN (CASE WHEN least(risk10 * 2.0, 99.0) > 80 THEN 8.0 ELSE 6.0 END) ELSE 0.0 END AS v1,
  CASE stage WHEN 'dpi' THEN dpi_reason || ' (Severity: ' || dpi_severity || ') [' || dpi_rule_id || ']'
             WHEN 'ueba' THEN 'Predictive Anomaly Detected: ' || array_to_string(list_filter([
                 CASE WHEN flag_high_rate THEN 'High Connection Rate' END, CASE WHEN flag_size THEN 'Anomalous Packet Size' END,
                 CASE WHEN flag_ports THEN 'Suspicious Port Enumeration' END], lambda x: x IS NOT NULL), ', ')
               || ' (Risk Score: ' || printf('%.1f', risk10 / 10.0) || ')'
             ELSE 'Normal traffic profile.' END AS i1,
  CASE stage WHEN 'dpi' THEN dpi_technique WHEN 'ueba' THEN 'T1566' END AS tid1,
  CASE stage WHEN 'dpi' THEN 'Exploit Public-Facing Application' WHEN 'ueba' THEN 'Behavioral Anomaly / Lateral Movement' END AS tn1,
  CAST(NULL AS VARCHAR) AS ta1,
  CASE WHEN stage <> 'none' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS ai1 FROM c1),
c3 AS (SELECT c2.*, COALESCE(o.is_flagged, false) AS oflag, o.threat_score AS oscore, o.tags AS otags,
  o.vendor_reports AS oreport FROM c2 LEFT JOIN osint o ON c2.src_ip = o.ip),
c4 AS (SELECT *, t1 OR oflag AS t2, CASE WHEN oflag THEN 'Global OSINT Threat Intel' ELSE m1 END AS m2,
  CASE WHEN oflag THEN greatest(c1, oscore) ELSE c1 END AS cv2, CASE WHEN oflag THEN 9.5 ELSE v1 END AS v2,
  CASE WHEN oflag THEN 'IP flagged globally. ' || oreport || ' Tags: ' || array_to_string(otags, ', ') ELSE i1 END AS i2,
  CASE WHEN oflag THEN 'T1583' ELSE tid1 END AS tid2, CASE WHEN oflag THEN 'Acquire Infrastructure' ELSE tn1 END AS tn2,
  CASE WHEN oflag THEN 'Resource Development' ELSE ta1 END AS ta2 FROM c3),
cm AS (SELECT packet_id, COALESCE(list_sort(list_distinct(list(COALESCE(ta2, 'Unknown'))
    FILTER (WHERE COALESCE(ta2, 'Unknown') <> 'Unknown')
    OVER (PARTITION BY src_ip ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW))), []) AS tactics
  FROM c4 WHERE v2 <> 0 AND src_ip IS NOT NULL AND src_ip <> '' AND src_ip <> '127.0.0.1'),
c5 AS (SELECT c4.*, COALESCE(len(cm.tactics), 0) >= 2 AS esc, COALESCE(len(cm.tactics), 0) AS k,
  'Multi-Stage: ' || array_to_string(cm.tactics, ', ') AS ctac FROM c4 LEFT JOIN cm USING (packet_id)),
c6 AS (SELECT *, t2 OR esc AS t3, CASE WHEN esc THEN 'Log Correlation Engine' ELSE m2 END AS m3,
  CASE WHEN esc THEN least(100.0, cv2 + 20) ELSE cv2 END AS cv3, CASE WHEN esc THEN least(10.0, v2 + k * 1.5) ELSE v2 END AS v3,
  CASE WHEN esc THEN 'CORRELATED ATTACK: ' || ctac ELSE i2 END AS i3, CASE WHEN esc THEN ctac ELSE ta2 END AS ta3 FROM c5),
c7 AS (SELECT c6.*, NOT t3 AND ioc.ip IS NOT NULL AS iochit FROM c6 LEFT JOIN ioc ON c6.src_ip = ioc.ip),
vd AS (SELECT packet_id, src_ip, t3 OR iochit AS is_threat,
  CASE WHEN iochit THEN 'Threat Intel Feed Match' ELSE m3 END AS method,
  CASE WHEN iochit THEN 99.9 ELSE cv3 END AS confidence, CASE WHEN iochit THEN 9.0 ELSE v3 END AS severity,
  CASE WHEN iochit THEN 'Source IP matched a known malicious indicator on a public OSINT blocklist (EmergingThreats).' ELSE i3 END AS intel,
  CASE WHEN iochit THEN 'T1136' ELSE tid2 END AS technique_id,
  CASE WHEN iochit THEN 'Create Account (Compromised IP)' ELSE tn2 END AS technique_name,
  CASE WHEN iochit THEN NULL ELSE ta3 END AS tactic,
  CASE WHEN iochit THEN 'NEGATIVE' ELSE ai1 END AS ai_label, esc AS correlated,
  dst_port, src_port, dst_ip, wall_ts, packet_size, payload_id, n, unique_ports, dur / 1000000.0 AS dur_s,
  CASE WHEN dur > 0 THEN n / (dur / 1000000.0) ELSE 1.0 END AS rate_raw,
  dpi_is_threat, dpi_reason, dpi_snippet, dpi_base64 FROM c7)
""")
VERDICT_SQL = VERDICT_BASE + """SELECT packet_id, src_ip, is_threat, method, confidence, severity, intel, technique_id,
  technique_name, tactic, ai_label, correlated FROM vd"""


@job("D4_verdicts", VERDICT_SQL)
def d4_verdicts(spark, sf):
    return run_verdicts(spark, sf).select(*OUT)


def _compat_sql() -> str:
    """The cascade twin in compat mode: compat DPI, plus the behaviour sentence classified for
    flows over the port / packet thresholds (the forest is off, so it always clears them)."""
    from .sqlgen import classify_sql
    rate = "(CASE WHEN dur > 0 THEN n / (dur / 1000000.0) ELSE 1.0 END)"
    act = (f"COALESCE(NULLIF(array_to_string(list_filter([CASE WHEN unique_ports > 3 THEN 'port scan reconnaissance' END, "
           f"CASE WHEN {rate} > 5 THEN 'high-frequency abnormal rate' END], lambda x: x IS NOT NULL), ' and '), ''), 'suspicious activity')")
    sentence = (f"'IP ' || src_ip || ' performed ' || {act} || ' on ' || CAST(unique_ports AS VARCHAR) || ' ports over ' || "
                f"printf('%.1f', dur / 1000000.0) || ' seconds, sending ' || CAST(n AS VARCHAR) || ' packets at ' || "
                f"printf('%.1f', {rate}) || ' pps.'")
    sv = classify_sql(f"(SELECT packet_id, {sentence} AS sent FROM c1 WHERE stage = 'vol')", "sent", "packet_id")
    base = VERDICT_BASE
    edits = [
        (dpi_sql("pk", "payload_text", "packet_id"), dpi_sql("pk", "payload_text", "packet_id", compat=True)),
        ("WHEN risk10 > 5 THEN 'ueba' ELSE 'none' END AS stage",
         "WHEN risk10 > 5 THEN 'ueba' WHEN unique_ports > 3 OR n > 15 THEN 'vol' ELSE 'none' END AS stage"),
        ("c2 AS (SELECT *, stage <> 'none' AS t1,",
         f"""c1s AS (SELECT c1.*, s.is_threat AS s_threat, s.method AS s_method, s.confidence AS s_conf, s.severity AS s_sev,
  s.explanation AS s_expl, s.technique_id AS s_tid, s.technique_name AS s_tname, s.tactic AS s_tactic, s.raw_ai_label AS s_ai
  FROM c1 LEFT JOIN ({sv}) s USING (packet_id)),
c2 AS (SELECT *, CASE WHEN stage = 'vol' THEN s_threat ELSE stage <> 'none' END AS t1,"""),
        ("WHEN 'ueba' THEN 'UEBA Predictive Engine' ELSE", "WHEN 'ueba' THEN 'UEBA Predictive Engine' WHEN 'vol' THEN s_method ELSE"),
        ("WHEN 'ueba' THEN least(risk10 * 2.0, 99.0) ELSE 0.0 END AS c1",
         "WHEN 'ueba' THEN least(risk10 * 2.0, 99.0) WHEN 'vol' THEN s_conf ELSE 0.0 END AS c1"),
        ("ELSE 6.0 END) ELSE 0.0 END AS v1", "ELSE 6.0 END) WHEN 'vol' THEN s_sev ELSE 0.0 END AS v1"),
        ("ELSE 'Normal traffic profile.' END AS i1", "WHEN 'vol' THEN s_expl ELSE 'Normal traffic profile.' END AS i1"),
        ("WHEN 'ueba' THEN 'T1566' END AS tid1", "WHEN 'ueba' THEN 'T1566' WHEN 'vol' THEN s_tid END AS tid1"),
        ("Lateral Movement' END AS tn1", "Lateral Movement' WHEN 'vol' THEN s_tname END AS tn1"),
        ("CAST(NULL AS VARCHAR) AS ta1", "CASE WHEN stage = 'vol' THEN s_tactic END AS ta1"),
        ("CASE WHEN stage <> 'none' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS ai1 FROM c1)",
         "CASE WHEN stage = 'vol' THEN s_ai WHEN stage <> 'none' THEN 'NEGATIVE' ELSE 'POSITIVE' END AS ai1 FROM c1s)"),
    ]
    for old, new in edits:
        if old not in base:
            raise ValueError(f"compat twin: pattern not found: {old[:60]}")
        base = base.replace(old, new, 1)
    return base + """SELECT packet_id, src_ip, is_threat, method, confidence, severity, intel, technique_id,
  technique_name, tactic, ai_label, correlated FROM vd"""


@job("D4_verdicts_compat", _compat_sql())
def d4_verdicts_compat(spark, sf):
    return run_verdicts(spark, sf, compat=True).select(*OUT)


@job("D4_threat_summary", f"""SELECT method, is_threat, CAST(count(*) AS BIGINT) AS packets FROM ({VERDICT_SQL}) GROUP BY ALL""")
def d4_summary(spark, sf):
    return run_verdicts(spark, sf).groupBy("method", "is_threat").agg(F.count(F.lit(1)).alias("packets"))


@job("P6_service_flags", w("net_packets") + """SELECT packet_id, dst_port,
  CAST(dst_port = 53 AS INTEGER) AS DNS_Request, CAST(dst_port = 80 AS INTEGER) AS HTTP_Request,
  CAST(dst_port = 443 AS INTEGER) AS HTTPS_Request, CAST(dst_port = 22 AS INTEGER) AS SSH_Attempt,
  CAST(dst_port = 3389 AS INTEGER) AS RDP_Attempt, CAST(dst_port IN (3306, 5432, 1433, 27017) AS INTEGER) AS Database_Access
FROM net_packets""")
def p6_services(spark, sf):
    p = v(spark, sf, "net_packets")
    return p.select("packet_id", "dst_port", *[c.alias(n) for n, c in service_flags("dst_port").items()])


def _verdict_cols(spark, sf, fn):
    vd = run_verdicts(spark, sf)
    return vd.select("packet_id", *[c.alias(n) for n, c in fn(vd).items()])


@job("P7_attack_flags", VERDICT_BASE + """SELECT packet_id,
  CAST(is_threat AND dst_port IN (80, 443, 8080) AS INTEGER) AS Web_Attack_Indicator,
  CAST(contains(lower(COALESCE(dpi_reason, '')), 'traversal') AS INTEGER) AS Directory_Traversal,
  CAST(contains(lower(COALESCE(dpi_reason, '')), 'rce') OR contains(lower(COALESCE(dpi_reason, '')), 'remote code') AS INTEGER) AS Remote_Code_Execution,
  CAST(is_threat AS INTEGER) AS Exploit_Pattern FROM vd""")
def p7_attack(spark, sf):
    return _verdict_cols(spark, sf, verdict.attack_flags)


@job("P8_behaviour_flags", VERDICT_BASE + """SELECT packet_id,
  CASE WHEN n > 10 THEN 'High' WHEN n > 5 THEN 'Medium' ELSE 'Low' END AS Scan_Intensity,
  CAST(dur_s > 30 AND is_threat AS INTEGER) AS Slow_Scan_Flag, CAST(unique_ports > 2 AS INTEGER) AS Multi_Port_Access,
  CAST(unique_ports > 3 AS INTEGER) AS Port_Scan_Flag, CAST(rate_raw > 5 OR is_threat AS INTEGER) AS Automated_Behavior,
  CASE WHEN is_threat THEN round(rate_raw, 4) ELSE 0.0 END AS Attack_Frequency,
  CAST(is_threat AS INTEGER) AS Suspicious_Behavior, CAST(is_threat AS INTEGER) AS Reconnaissance_Flag FROM vd""")
def p8_behaviour(spark, sf):
    return _verdict_cols(spark, sf, verdict.behaviour_flags)


@job("P9_keyword_evidence", VERDICT_BASE + """, kb AS (SELECT packet_id, COALESCE(dpi_is_threat, false) AS hit,
  lower(COALESCE(dpi_reason, '')) AS r, contains(lower(COALESCE(dpi_snippet, '')), 'passwd') AS pw,
  COALESCE(dpi_is_threat, false) AND COALESCE(dpi_base64, false) AS b64 FROM vd),
kc AS (SELECT *, CASE WHEN NOT hit THEN 0 WHEN contains(r, 'cat /etc/passwd') OR pw THEN 1 WHEN contains(r, 'sql injection') THEN 2
  WHEN contains(r, 'xss') OR contains(r, 'cross-site') THEN 3 WHEN contains(r, 'rce') OR contains(r, 'remote code') THEN 4
  WHEN contains(r, 'traversal') THEN 5 WHEN contains(r, 'malicious payload') THEN 6 ELSE 0 END AS b FROM kb)
SELECT packet_id, CASE b WHEN 1 THEN 'cat /etc/passwd' WHEN 2 THEN 'UNION SELECT' WHEN 3 THEN '<script>' WHEN 4 THEN 'cmd.exe'
  WHEN 5 THEN '../' WHEN 6 THEN 'malicious_payload' ELSE '' END AS Malicious_Keyword, CAST(b > 0 AS INTEGER) AS Keyword_Count,
  CASE WHEN b64 THEN 'Yes' ELSE 'No' END AS Encoded_Content, CASE WHEN b64 THEN 'Yes' ELSE 'No' END AS Base64_Detected,
  CASE WHEN b IN (1, 6) THEN 'Yes' ELSE 'No' END AS Shell_Command_Detected, CASE WHEN b = 4 THEN 'Yes' ELSE 'No' END AS Exec_Command,
  'No' AS Eval_Command, CASE WHEN b = 4 THEN 'Yes' ELSE 'No' END AS CMD_Usage,
  CASE WHEN b = 1 THEN 'Yes' ELSE 'No' END AS Linux_Shell_Usage, CASE WHEN b = 1 THEN 'Yes' ELSE 'No' END AS Passwd_Access_Attempt
FROM kc""")
def p9_keywords(spark, sf):
    return _verdict_cols(spark, sf, verdict.keyword_evidence)


@job("D6_block_columns", VERDICT_BASE + """SELECT packet_id,
  CASE WHEN is_threat THEN 'Blocked' ELSE 'Not Blocked' END AS Firewall_Status,
  CASE WHEN is_threat THEN 'Blocked' ELSE 'Not Blocked' END AS Firewall_Action,
  CASE WHEN is_threat THEN src_ip ELSE '' END AS Blocked_IP,
  CASE WHEN is_threat THEN 'BLOCK_STEALTH_' || src_ip ELSE '' END AS Block_Rule_Name,
  CASE WHEN is_threat THEN 'Terminated' ELSE 'Active' END AS Flow_State FROM vd""")
def d6_block(spark, sf):
    return _verdict_cols(spark, sf, verdict.block_columns)


@job("P14_ui_event", VERDICT_BASE + """, pe AS (SELECT payload_id, COALESCE(round(entropy(substr(h, 2 * i + 1, 2)), 4), 0.0) AS ent
  FROM (SELECT payload_id, hex(encode(payload_text)) AS h FROM payloads) b, range(0, length(h) // 2) r(i) GROUP BY payload_id)
SELECT packet_id AS id, strftime(wall_ts, '%Y-%m-%d %H:%M:%S') AS timestamp, method, src_ip AS source, src_port AS source_port,
  dst_ip AS destination, dst_port AS destination_port, 'TCP' AS protocol, packet_size,
  round(COALESCE(pe.ent, 0.0), 2) AS payload_entropy,
  CASE WHEN COALESCE(dpi_is_threat, false) THEN dpi_reason ELSE '' END AS dpi_result, ai_label,
  printf('%.2f', confidence) AS confidence, intel, severity, COALESCE(technique_id, '') AS mitre_technique,
  COALESCE(tactic, '') AS mitre_tactic FROM vd LEFT JOIN pe USING (payload_id)""")
def p14_ui(spark, sf):
    return verdict.ui_event(run_verdicts(spark, sf))


@job("P15_counters", VERDICT_BASE + """, fs AS (SELECT src_ip, sess, min(ts_us) AS f, max(ts_us) + 300000000 AS t FROM rk GROUP BY 1, 2),
ft AS (SELECT src_ip, min(ts_us) AS f FROM vd JOIN net_packets USING (packet_id, src_ip) WHERE is_threat GROUP BY 1),
marks AS (SELECT ts_us AS mark_us, packet_id, 0 AS flow, 0 AS threat FROM net_packets WHERE packet_id IN (SELECT packet_id FROM vd)
  UNION ALL SELECT f, NULL, 1, 0 FROM fs UNION ALL SELECT t + 1, NULL, -1, 0 FROM fs UNION ALL SELECT f, NULL, 0, 1 FROM ft)
SELECT packet_id, CAST(active AS BIGINT) AS active_flows, CAST(threats AS BIGINT) AS threat_sources,
  CAST(greatest(active - threats, 0) AS BIGINT) AS safe_flows
FROM (SELECT packet_id, sum(flow) OVER w AS active, sum(threat) OVER w AS threats FROM marks
      WINDOW w AS (ORDER BY mark_us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE packet_id IS NOT NULL""")
def p15_counters(spark, sf):
    rows = verdict.event_row(run_verdicts(spark, sf))
    return rows.select(F.col("Dataset_Row_ID").cast("bigint").alias("packet_id"), F.col("Active_Flow_Count").cast("bigint").alias("active_flows"),
                       F.col("Threat_Count").cast("bigint").alias("threat_sources"), F.col("Safe_Traffic_Count").cast("bigint").alias("safe_flows"))


@job("P15_event_row")
def p15_row(spark, sf):
    return verdict.event_row(run_verdicts(spark, sf))


@job("S13_evidence_rows", VERDICT_BASE + """SELECT packet_id, vd.src_ip, vd.dst_port, method, CAST(octet_length(encode(payload_text)) AS INTEGER) AS payload_bytes,
  strftime(vd.wall_ts, '%Y-%m-%d') AS date FROM vd LEFT JOIN payloads USING (payload_id) WHERE is_threat""")
def s13_rows(spark, sf):
    """The evidence written by date and read back."""
    threats = run_verdicts(spark, sf).select("packet_id", "is_threat", "method", F.col("dpi_rule_id").alias("rule_id"))
    rows = evidence(packets_with_payload(spark, sf), threats, scratch(spark, "s13r"))
    return rows.select("packet_id", "src_ip", "dst_port", "method", F.octet_length("payload").alias("payload_bytes"),
                       F.date_format("date", "yyyy-MM-dd").alias("date"))
