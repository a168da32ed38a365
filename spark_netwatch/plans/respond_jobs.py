"""Registered correlation and response jobs: W5, W6, W7, W8, A24, A25, P13,
J2, D5, J11, A28, T5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlate, intel, respond
from .registry import job, v, w
from .sqlgen import greedy_sql

US = 1_000_000
AS_OF_US = 1704067200000000 + 1800 * US


def rw(*names):
    return w(*names).replace("WITH ", "WITH RECURSIVE ", 1)


def te(spark, sf):
    return v(spark, sf, "threat_events")


CORR_SQL = w("threat_events") + """, b AS (SELECT * FROM threat_events
  WHERE source_ip IS NOT NULL AND source_ip <> '' AND source_ip <> '127.0.0.1' AND severity <> 0),
c AS (SELECT *, COALESCE(list_sort(list_distinct(list(COALESCE(mitre_tactic, 'Unknown'))
    FILTER (WHERE COALESCE(mitre_tactic, 'Unknown') <> 'Unknown')
    OVER (PARTITION BY source_ip ORDER BY ts_us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW))), []) AS tactics FROM b)
SELECT event_id, source_ip, tactics, CAST(len(tactics) AS INTEGER) AS stages, len(tactics) >= 2 AS escalated,
  CASE WHEN len(tactics) >= 2 THEN least(10.0, severity + len(tactics) * 1.5) ELSE severity END AS corr_severity,
  CASE WHEN len(tactics) >= 2 THEN least(100.0, confidence + 20) ELSE confidence END AS corr_confidence,
  CASE WHEN len(tactics) >= 2 THEN 'Multi-Stage: ' || array_to_string(tactics, ', ') ELSE COALESCE(mitre_tactic, 'Unknown') END AS corr_tactic
FROM c"""


@job("W5_correlation", CORR_SQL)
def w5_correlation(spark, sf):
    c = correlate.correlate(te(spark, sf))
    return c.select("event_id", "source_ip", "tactics", "stages", "escalated", "corr_severity", "corr_confidence",
                    "corr_tactic")


@job("W6_alert_gate", rw("threat_events") + ", " + greedy_sql(
    "(SELECT * FROM threat_events WHERE severity >= 7.0)", "source_ip", "ts_us", "event_id", 300 * US) + """
SELECT event_id, source_ip, CASE WHEN severity < 7.0 THEN 'below_threshold'
  WHEN event_id IN (SELECT id FROM g_acc) THEN 'sent' ELSE 'suppressed' END AS alert_status FROM threat_events""")
def w6_alert_gate(spark, sf):
    return respond.alert_gate(te(spark, sf)).select("event_id", "source_ip", "alert_status")


@job("W6_cooldown_packets", rw("net_packets") + ", " + greedy_sql("net_packets", "src_ip", "ts_us", "packet_id", 300 * US) + """
SELECT packet_id, src_ip, CASE WHEN packet_id IN (SELECT id FROM g_acc) THEN 'sent' ELSE 'suppressed' END AS alert_status
FROM net_packets""")
def w6_packets(spark, sf):
    p = v(spark, sf, "net_packets")
    g = respond.alert_gate(p, key="src_ip", eid="packet_id", threshold=None, severity="packet_size")
    return g.select("packet_id", "src_ip", "alert_status")


GATE_SQL = rw("threat_events") + ", " + greedy_sql(
    "(SELECT * FROM threat_events WHERE severity >= 7.0)", "source_ip", "ts_us", "event_id", 300 * US) + """,
gate AS (SELECT *, CASE WHEN severity < 7.0 THEN 'below_threshold'
  WHEN event_id IN (SELECT id FROM g_acc) THEN 'sent' ELSE 'suppressed' END AS alert_status FROM threat_events)
"""


@job("A25_alert_counters", GATE_SQL + "SELECT alert_status, CAST(count(*) AS BIGINT) AS alerts FROM gate GROUP BY 1")
def a25_counters(spark, sf):
    return respond.alert_counters(respond.alert_gate(te(spark, sf)))


@job("P13_alert_payload", GATE_SQL + """SELECT 'stealth_recon_detection' AS alert_type,
  CASE WHEN severity >= 9.0 THEN 'CRITICAL' WHEN severity >= 7.0 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  severity AS severity_score, event_id, source_ip, destination_ip, detection_method,
  CAST(confidence AS VARCHAR) AS confidence, 'N/A' AS threat_intel, '' AS mitre_technique, mitre_tactic,
  'N/A' AS firewall_action, '2.0.0' AS system_version FROM gate WHERE alert_status = 'sent'""")
def p13_payload(spark, sf):
    g = respond.alert_gate(te(spark, sf)).filter(F.col("alert_status") == "sent")
    p = respond.alert_payload(g)
    return p.select("alert_type", "severity", "severity_score", "event_id", "source_ip", "destination_ip",
                    "detection_method", "confidence", "threat_intel",
                    F.col("mitre_attack.technique").alias("mitre_technique"),
                    F.col("mitre_attack.tactic").alias("mitre_tactic"), "firewall_action", "system_version")


BLOCK_SQL = rw("threat_events") + ", " + greedy_sql(
    "(SELECT * FROM threat_events WHERE label = 1 AND severity >= 7.0)", "source_ip", "ts_us", "event_id", 3600 * US, "b") + """,
blocks AS (SELECT source_ip AS ip, ts_us AS from_us, ts_us + 3600000000 AS until_us,
  CASE WHEN starts_with(source_ip, '10.') OR starts_with(source_ip, '192.168.') OR starts_with(source_ip, '172.')
       THEN 'QUARANTINE' ELSE 'BLOCK' END AS action,
  CASE WHEN severity >= 9.0 THEN 'CRITICAL' ELSE 'HIGH' END || ' Playbook: ' || COALESCE(mitre_tactic, 'Unknown') AS reason, event_id
  FROM threat_events WHERE event_id IN (SELECT id FROM b_acc))
"""


def _blocks(spark, sf):
    return respond.block_intervals(te(spark, sf).filter("label = 1 AND severity >= 7.0"))


@job("W7_block_intervals", BLOCK_SQL + "SELECT * FROM blocks")
def w7_blocks(spark, sf):
    return _blocks(spark, sf)


@job("W8_block_rate", BLOCK_SQL + """SELECT CAST(floor(from_us / 60000000) AS BIGINT) AS minute, CAST(count(*) AS BIGINT) AS blocks,
  count(*) > 50 AS over_limit FROM blocks GROUP BY 1""")
def w8_rate(spark, sf):
    return respond.block_rate(_blocks(spark, sf))


@job("W8_trailing_block_rate", BLOCK_SQL + """SELECT event_id, ip, from_us, CAST(count(*) OVER w AS BIGINT) AS recent_blocks,
  count(*) OVER w > 50 AS over_limit FROM blocks WINDOW w AS (ORDER BY from_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""")
def w8_trailing(spark, sf):
    return respond.trailing_block_rate(_blocks(spark, sf))


@job("A24_active_blocks", BLOCK_SQL + f"""SELECT ip, action, greatest(0, (until_us - {AS_OF_US}) / 1000000) AS remaining_s
FROM blocks WHERE from_us <= {AS_OF_US} AND until_us > {AS_OF_US}""")
def a24_active(spark, sf):
    return respond.active_blocks(_blocks(spark, sf), AS_OF_US)


@job("J2_drop_blocked", BLOCK_SQL.replace("WITH RECURSIVE ", "WITH RECURSIVE " + w("net_packets")[5:].rstrip() + ",\n", 1) + """
SELECT packet_id, src_ip FROM net_packets p WHERE NOT EXISTS (SELECT 1 FROM blocks b
  WHERE b.ip = p.src_ip AND p.ts_us >= b.from_us AND p.ts_us < b.until_us)""")
def j2_drop(spark, sf):
    return intel.drop_blocked(v(spark, sf, "net_packets"), _blocks(spark, sf)).select("packet_id", "src_ip")


PB_SQL = w("threat_events") + """, base AS (SELECT *, COALESCE(mitre_tactic, 'Unknown') AS tac,
  starts_with(source_ip, '10.') OR starts_with(source_ip, '192.168.') OR starts_with(source_ip, '172.') AS internal,
  CASE WHEN len(string_split(source_ip, '.')) = 4 THEN split_part(source_ip, '.', 1) || '.' || split_part(source_ip, '.', 2)
       || '.' || split_part(source_ip, '.', 3) || '.0/24' END AS sub,
  contains(COALESCE(detection_method, ''), 'UEBA Predictive Engine') AS ueba FROM threat_events
  WHERE source_ip IS NOT NULL AND source_ip <> '' AND source_ip <> '127.0.0.1'),
lv AS (SELECT *, CASE WHEN ueba THEN 'LEVEL5' WHEN severity >= 9.0 THEN 'CRITICAL' WHEN severity >= 7.0 THEN 'HIGH'
  WHEN severity >= 5.0 THEN 'MEDIUM' ELSE 'NONE' END AS level FROM base),
acts AS (
  SELECT event_id, ts_us, source_ip, level, tac, 0 AS step, 'AUTO_SIGNATURE' AS action, source_ip AS target, 0 AS delta,
    'Level 5 Auto-Generated Rule' AS details FROM lv WHERE level = 'LEVEL5'
  UNION ALL SELECT event_id, ts_us, source_ip, level, tac, 1, CASE WHEN internal THEN 'QUARANTINE' ELSE 'BLOCK' END, source_ip, 0,
    CASE WHEN level = 'HIGH' THEN 'HIGH' ELSE 'CRITICAL' END || ' Playbook: ' || tac FROM lv WHERE level IN ('LEVEL5', 'CRITICAL', 'HIGH')
  UNION ALL SELECT event_id, ts_us, source_ip, level, tac, 2, 'BLOCK_CIDR', sub, 0, 'CRITICAL Subnet isolation for ' || source_ip
    FROM lv WHERE level IN ('LEVEL5', 'CRITICAL') AND sub IS NOT NULL
  UNION ALL SELECT event_id, ts_us, source_ip, level, tac, CASE WHEN level = 'HIGH' THEN 2 ELSE 3 END, 'ALERT', source_ip, 0, ''
    FROM lv WHERE level IN ('LEVEL5', 'CRITICAL', 'HIGH')
  UNION ALL SELECT event_id, ts_us, source_ip, level, tac, CASE WHEN level = 'HIGH' THEN 3 WHEN level = 'MEDIUM' THEN 1 ELSE 4 END,
    'REPUTATION', source_ip, CASE WHEN level = 'HIGH' THEN -20 WHEN level = 'MEDIUM' THEN -5 ELSE -50 END, tac
    FROM lv WHERE level IN ('LEVEL5', 'CRITICAL', 'HIGH', 'MEDIUM'))
"""


def _actions(spark, sf):
    return respond.playbook(te(spark, sf))


@job("D5_playbook", PB_SQL + "SELECT event_id, source_ip, level, tac AS tactic, step, action, target, delta, details FROM acts")
def d5_playbook(spark, sf):
    return _actions(spark, sf).select("event_id", "source_ip", "level", "tactic", "step", "action", "target", "delta", "details")


@job("J11_reputation_deltas", PB_SQL + """SELECT source_ip, CAST(sum(delta) AS BIGINT) AS osint_score,
  CASE WHEN arg_min(tac, (ts_us, event_id)) <> '' THEN '["' || arg_min(tac, (ts_us, event_id)) || '"]' ELSE '[]' END AS tags
FROM acts WHERE action = 'REPUTATION' GROUP BY source_ip""")
def j11_deltas(spark, sf):
    a = _actions(spark, sf).filter(F.col("action") == "REPUTATION").withColumn("timestamp", F.lit(None).cast("timestamp"))
    return respond_deltas(a)


def respond_deltas(a):
    from ..operators.threats import reputation_deltas
    return reputation_deltas(a).select("source_ip", "osint_score", "tags")


@job("A28_block_audit", PB_SQL + """SELECT event_id, action, target, details FROM acts
WHERE action IN ('BLOCK', 'QUARANTINE', 'BLOCK_CIDR')""")
def a28_audit(spark, sf):
    return respond.block_audit(_actions(spark, sf)).select("event_id", "action", "target", "details")


@job("A28_audit_counts", PB_SQL + """SELECT action, CAST(count(*) AS BIGINT) AS entries FROM acts
WHERE action IN ('BLOCK', 'QUARANTINE', 'BLOCK_CIDR') GROUP BY 1""")
def a28_counts(spark, sf):
    return respond.audit_counts(respond.block_audit(_actions(spark, sf)))


@job("T5_latest_audit", PB_SQL + """SELECT event_id, action, target, details FROM acts
WHERE action IN ('BLOCK', 'QUARANTINE', 'BLOCK_CIDR') ORDER BY ts_us DESC, event_id DESC, action LIMIT 50""")
def t5_latest(spark, sf):
    a = respond.block_audit(_actions(spark, sf))
    return a.orderBy(F.desc("ts_us"), F.desc("event_id"), "action").limit(50).select("event_id", "action", "target", "details")
