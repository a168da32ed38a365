"""Registered flow jobs: W0-W4, A1-A6, D1, P5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import decode_flags
from ..functions.text import text_entropy
from ..operators import flows
from .registry import job, v, w

# DuckDB twins of the session and running-state windows
SESS_SQL = """
g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id) > 300000000
                     THEN 1 ELSE 0 END AS new_s FROM net_packets),
s AS (SELECT * EXCLUDE (new_s), CAST(sum(new_s) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sess FROM g)"""

R4 = "floor(({n} * 2 + {d} * 100) / ({d} * 200.0)) / 10000.0"


def r4(n, d="1"):
    return R4.format(n=n, d=d)


STATE_SQL = SESS_SQL + """,
pf AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY src_ip, sess, dst_port ORDER BY ts_us, packet_id) = 1 THEN 1 ELSE 0 END AS port_first,
       ts_us - lag(ts_us) OVER (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id) AS iv_us FROM s),
st AS (SELECT *,
  CAST(row_number() OVER ws AS BIGINT) AS n,
  CAST(sum(port_first) OVER wr AS BIGINT) AS unique_ports,
  min(ts_us) OVER wr AS start_us,
  CAST(sum(packet_size) OVER wr AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS syn_count,
  CAST(sum(CASE WHEN tcp_flags & 16 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS ack_count,
  CAST(sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS fin_count,
  CAST(sum(CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS rst_count,
  CAST(sum(CASE WHEN tcp_flags & 8 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS psh_count,
  CAST(sum(CASE WHEN tcp_flags & 32 <> 0 THEN 1 ELSE 0 END) OVER wr AS BIGINT) AS urg_count,
  sum(iv_us) OVER wi AS iv_sum, count(iv_us) OVER wi AS iv_cnt, stddev_pop(iv_us) OVER wi AS iv_sd
  FROM pf
  WINDOW ws AS (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id),
         wr AS (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         wi AS (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id ROWS BETWEEN 98 PRECEDING AND CURRENT ROW)),
sz AS (SELECT *, count(packet_size) OVER wz AS sz_cnt, avg(packet_size) OVER wz AS sz_avg FROM st
  WINDOW wz AS (PARTITION BY src_ip, sess, packet_size > 0 ORDER BY ts_us, packet_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
fx AS (SELECT *, ts_us - start_us AS dur_us,
  (packet_size > 0 AND sz_cnt >= 20 AND packet_size > sz_avg * 3 AND packet_size > 1000) AS size_anomaly,
  CASE WHEN ts_us - start_us > 1000 THEN n / ((ts_us - start_us) / 1000000.0) ELSE n * 1000.0 END AS u_rate FROM sz),
rk AS (SELECT *, CAST(sum((CASE WHEN u_rate > 150 THEN 1 ELSE 0 END) + (CASE WHEN size_anomaly THEN 2 ELSE 0 END)
          + (CASE WHEN unique_ports > 10 THEN 5 ELSE 0 END)) OVER (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS risk10 FROM fx)"""


@job("W0_sessions", w("net_packets") + ", " + SESS_SQL.strip() + """
SELECT src_ip, CAST(count(DISTINCT sess) AS BIGINT) AS flows, CAST(count(*) AS BIGINT) AS packets,
       CAST(max(sess) AS BIGINT) AS last_sess FROM s GROUP BY src_ip""")
def w0_sessions(spark, sf):
    s = flows.sessionize(v(spark, sf, "net_packets"))
    return s.groupBy("src_ip").agg(F.countDistinct("sess").alias("flows"), F.count(F.lit(1)).alias("packets"),
                                   F.max("sess").alias("last_sess"))


A1_SQL = w("net_packets") + ", " + SESS_SQL.strip() + f""",
a AS (SELECT src_ip, sess, CAST(count(*) AS BIGINT) AS packets, CAST(count(DISTINCT dst_port) AS BIGINT) AS unique_ports,
  min(ts_us) AS start_us, max(ts_us) AS last_us, CAST(sum(packet_size) AS BIGINT) AS bytes,
  CAST(sum(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS syn_count,
  CAST(sum(CASE WHEN tcp_flags & 16 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ack_count,
  CAST(sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fin_count,
  CAST(sum(CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rst_count,
  CAST(sum(CASE WHEN tcp_flags & 8 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS psh_count,
  CAST(sum(CASE WHEN tcp_flags & 32 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS urg_count
  FROM s GROUP BY src_ip, sess)
SELECT *, {r4('(last_us - start_us)')} AS duration,
  round(CASE WHEN last_us > start_us THEN packets / ((last_us - start_us) / 1000000.0) ELSE CAST(packets AS DOUBLE) END, 4) AS rate,
  CASE WHEN last_us > start_us THEN round(bytes / ((last_us - start_us) / 1000000.0), 4) ELSE CAST(bytes AS DOUBLE) END AS byte_rate
FROM a"""


@job("A1_flow_summary", A1_SQL)
def a1_flow_summary(spark, sf):
    return flows.flow_summary(v(spark, sf, "net_packets"))


@job("A1_top_flows_by_ports", A1_SQL.replace("\nFROM a", "\nFROM a ORDER BY unique_ports DESC, packets DESC, src_ip, sess LIMIT 20"))
def a1_top_flows(spark, sf):
    """Slice 0: top 20 flows by distinct destination ports (a top-k report)."""
    return (flows.flow_summary(v(spark, sf, "net_packets"))
            .orderBy(F.desc("unique_ports"), F.desc("packets"), "src_ip", "sess").limit(20))


@job("A2_flag_totals", w("net_packets") + ", " + SESS_SQL.strip() + """
SELECT src_ip, sess,
  CAST(sum(CASE WHEN tcp_flags & 2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS syn_count,
  CAST(sum(CASE WHEN tcp_flags & 16 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS ack_count,
  CAST(sum(CASE WHEN tcp_flags & 1 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fin_count,
  CAST(sum(CASE WHEN tcp_flags & 4 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rst_count,
  CAST(sum(CASE WHEN tcp_flags & 8 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS psh_count,
  CAST(sum(CASE WHEN tcp_flags & 32 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS urg_count
FROM s GROUP BY src_ip, sess""")
def a2_flag_totals(spark, sf):
    return flows.flow_summary(v(spark, sf, "net_packets")).select(
        "src_ip", "sess", "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "urg_count")


@job("P5_decode_flags", w("net_packets") + """
SELECT packet_id, tcp_flags,
  CAST(tcp_flags & 2 <> 0 AS INTEGER) AS is_syn, CAST(tcp_flags & 16 <> 0 AS INTEGER) AS is_ack,
  CAST(tcp_flags & 1 <> 0 AS INTEGER) AS is_fin, CAST(tcp_flags & 4 <> 0 AS INTEGER) AS is_rst,
  CAST(tcp_flags & 8 <> 0 AS INTEGER) AS is_psh, CAST(tcp_flags & 32 <> 0 AS INTEGER) AS is_urg
FROM net_packets""")
def p5_decode_flags(spark, sf):
    p = v(spark, sf, "net_packets")
    return p.select("packet_id", "tcp_flags", *[c.alias(n) for n, c in decode_flags("tcp_flags").items()])


def _state(spark, sf):
    return flows.flow_state(v(spark, sf, "net_packets"))


@job("W1_running_flow_state", w("net_packets") + ", " + STATE_SQL.strip() + f"""
SELECT packet_id, src_ip, sess, n, unique_ports, start_us, {r4('(ts_us - start_us)')} AS duration,
  round(CASE WHEN ts_us > start_us THEN n / ((ts_us - start_us) / 1000000.0) ELSE CAST(n AS DOUBLE) END, 4) AS rate,
  round(CASE WHEN ts_us > start_us THEN n / ((ts_us - start_us) / 1000000.0) ELSE 1.0 END, 2) AS log_rate
FROM rk""")
def w1_running_flow_state(spark, sf):
    return _state(spark, sf).select("packet_id", "src_ip", "sess", "n", "unique_ports", "start_us", "duration",
                                    F.round("rate", 4).alias("rate"), "log_rate")


@job("W2_interval_frame", w("net_packets") + ", " + STATE_SQL.strip() + f"""
SELECT packet_id, CASE WHEN n < 2 THEN 0.0 ELSE {r4('iv_sum', 'iv_cnt')} END AS connection_interval,
  CASE WHEN n < 3 THEN 0.0 ELSE round(iv_sd / 1000000, 4) END AS jitter FROM rk""")
def w2_interval_frame(spark, sf):
    return _state(spark, sf).select("packet_id", "connection_interval", "jitter")


@job("W3_size_anomaly", w("net_packets") + ", " + STATE_SQL.strip() + """
SELECT packet_id, size_anomaly FROM rk""")
def w3_size_anomaly(spark, sf):
    return _state(spark, sf).select("packet_id", "size_anomaly")


@job("W4_risk_accumulation", w("net_packets") + ", " + STATE_SQL.strip() + """
SELECT packet_id, src_ip, risk10, risk10 > 5 AS ueba,
  CAST(max(CASE WHEN u_rate > 150 THEN 1 ELSE 0 END) OVER wr = 1 AS BOOLEAN) AS flag_high_rate,
  CAST(max(CASE WHEN size_anomaly THEN 1 ELSE 0 END) OVER wr = 1 AS BOOLEAN) AS flag_size,
  CAST(max(CASE WHEN unique_ports > 10 THEN 1 ELSE 0 END) OVER wr = 1 AS BOOLEAN) AS flag_ports
FROM rk WINDOW wr AS (PARTITION BY src_ip, sess ORDER BY ts_us, packet_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w4_risk(spark, sf):
    return _state(spark, sf).select("packet_id", "src_ip", "risk10", (F.col("risk10") > 5).alias("ueba"),
                                    "flag_high_rate", "flag_size", "flag_ports")


@job("A3_byte_rate", w("net_packets") + ", " + STATE_SQL.strip() + """
SELECT packet_id, bytes, CASE WHEN ts_us > start_us THEN round(bytes / ((ts_us - start_us) / 1000000.0), 4)
  ELSE CAST(bytes AS DOUBLE) END AS byte_rate FROM rk""")
def a3_byte_rate(spark, sf):
    return _state(spark, sf).select("packet_id", "bytes", "byte_rate")


@job("A4_mean_interval", w("net_packets") + ", " + STATE_SQL.strip() + f"""
SELECT src_ip, sess, max(n) AS packets,
  arg_max(CASE WHEN n < 2 THEN 0.0 ELSE {r4('iv_sum', 'iv_cnt')} END, n) AS connection_interval
FROM rk GROUP BY src_ip, sess""")
def a4_mean_interval(spark, sf):
    st = _state(spark, sf)
    return st.groupBy("src_ip", "sess").agg(F.max("n").alias("packets"),
                                            F.max_by("connection_interval", "n").alias("connection_interval"))


@job("A5_jitter", w("net_packets") + ", " + STATE_SQL.strip() + """
SELECT src_ip, sess, arg_max(CASE WHEN n < 3 THEN 0.0 ELSE round(iv_sd / 1000000, 4) END, n) AS jitter
FROM rk GROUP BY src_ip, sess""")
def a5_jitter(spark, sf):
    st = _state(spark, sf)
    return st.groupBy("src_ip", "sess").agg(F.max_by("jitter", "n").alias("jitter"))


@job("A6_text_entropy", """
WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
y AS (SELECT doc_id, substr(h, 2 * i + 1, 2) AS byte FROM b, range(0, length(h) // 2) r(i))
SELECT b.doc_id, COALESCE(round(e.ent, 4), 0.0) AS entropy FROM b LEFT JOIN
  (SELECT doc_id, entropy(byte) AS ent FROM y GROUP BY doc_id) e ON b.doc_id = e.doc_id""")
def a6_text_entropy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text_entropy("text").alias("entropy"))


@job("D1_feature_vector", w("net_packets", "payloads") + ", " + STATE_SQL.strip() + f""",
pe AS (SELECT payload_id, COALESCE(round(entropy(substr(h, 2 * i + 1, 2)), 4), 0.0) AS ent
       FROM (SELECT payload_id, hex(encode(payload_text)) AS h FROM payloads) b, range(0, length(h) // 2) r(i) GROUP BY payload_id)
SELECT packet_id, src_ip, n AS Connection_Count, {r4('(ts_us - start_us)')} AS Duration,
  round(CASE WHEN ts_us > start_us THEN n / ((ts_us - start_us) / 1000000.0) ELSE CAST(n AS DOUBLE) END, 4) AS Rate,
  unique_ports AS Unique_Ports, CAST(unique_ports > 3 AS INTEGER) AS Is_Port_Scan,
  CAST(hour(wall_ts) >= 22 OR hour(wall_ts) <= 5 AS INTEGER) AS Is_Night,
  COALESCE(pe.ent, 0.0) AS Payload_Entropy, packet_size AS Packet_Size,
  CASE WHEN n < 2 THEN 0.0 ELSE {r4('iv_sum', 'iv_cnt')} END AS Connection_Interval,
  syn_count AS SYN_Count, ack_count AS ACK_Count, fin_count AS FIN_Count, rst_count AS RST_Count,
  psh_count AS PSH_Count, urg_count AS URG_Count, ttl AS TTL_Value, window_size AS Window_Size,
  CAST(octet_length(encode(p.payload_text)) AS BIGINT) AS Payload_Size,
  CAST(hour(wall_ts) AS INTEGER) AS Hour,
  CASE WHEN n < 3 THEN 0.0 ELSE round(iv_sd / 1000000, 4) END AS Jitter,
  CASE WHEN ts_us > start_us THEN round(bytes / ((ts_us - start_us) / 1000000.0), 4) ELSE CAST(bytes AS DOUBLE) END AS Byte_Rate
FROM rk JOIN payloads p USING (payload_id) LEFT JOIN pe USING (payload_id)""")
def d1_feature_vector(spark, sf):
    from ..sources.packets import packets_with_payload
    f = flows.extract_features(packets_with_payload(spark, sf))
    return f.select("packet_id", "src_ip", "Connection_Count", "Duration", "Rate", "Unique_Ports", "Is_Port_Scan",
                    "Is_Night", "Payload_Entropy", "Packet_Size", "Connection_Interval", "SYN_Count", "ACK_Count",
                    "FIN_Count", "RST_Count", "PSH_Count", "URG_Count", "TTL_Value", "Window_Size", "Payload_Size",
                    F.col("Hour").cast("int").alias("Hour"), "Jitter", "Byte_Rate")
