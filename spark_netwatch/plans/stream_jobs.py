"""Registered streaming twins X1-X8: each runs a file stream (availableNow) over
data staged from the given tables and is checked against its batch twin's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dpi import dpi_scan
from ..sources.fixtures import view
from ..sources.packets import packets_with_payload
from ..streaming import twins
from .clean_jobs import AS_OF, CELLS, COLS, COLS_SQL
from .dpi_jobs import DPI_COLS, PKT
from .flow_jobs import A1_SQL
from .registry import ORACLE, job, v
from .respond_jobs import BLOCK_SQL, CORR_SQL, GATE_SQL
from .source_jobs import S4_SQL
from .sqlgen import dpi_sql


DAY_US = 86_400_000_000


def _stream_of(spark, df, name, order_col, files_per_trigger=8, closing=None, files=1):
    path = twins.scratch(spark, name)
    twins.stage_files(df, path, order_col, closing=closing, files=files)
    return twins.source(spark, path, df.schema, files_per_trigger)


@job("X1_session_flows", f"SELECT src_ip, start_us, last_us, packets, unique_ports FROM ({A1_SQL})")
def x1_flows(spark, sf):
    p = v(spark, sf, "net_packets")
    s = twins.session_flows(_stream_of(spark, p, "x1", "ts_us", closing=DAY_US))
    out = twins.run_to_table(spark, s, "x1")
    return out.select("src_ip", "start_us", "last_us", "packets", F.col("unique_ports").cast("bigint").alias("unique_ports"))


@job("X7_minute_metrics", ORACLE["A26_minute_activity"])
def x7_minutes(spark, sf):
    t = v(spark, sf, "threat_events").select(F.unix_micros("timestamp").alias("event_us"), "source_ip", "label", "severity")
    s = twins.minute_metrics(_stream_of(spark, t, "x7", "event_us", closing=DAY_US), "event_us")
    out = twins.run_to_table(spark, s, "x7")
    return out.select("minute", "events", "threats", F.col("active_flows").cast("bigint").alias("active_flows"),
                      F.col("blocked_ips").cast("bigint").alias("blocked_ips"))


@job("X5_microbatch_flush", S4_SQL)
def x5_flush(spark, sf):
    out = twins.flush_threats(_stream_of(spark, v(spark, sf, "raw_event_log"), "x5", "row_id", 1))
    return out.select("event_id", "timestamp", "source_ip", "destination_port", "protocol", "detection_method", "confidence", "duration")


@job("X3_alert_cooldown_stream", GATE_SQL + "SELECT source_ip, event_id, ts_us FROM gate WHERE alert_status = 'sent'")
def x3_cooldown(spark, sf):
    t = v(spark, sf, "threat_events").filter("severity >= 7.0").select("source_ip", "event_id", "ts_us")
    return twins.greedy_stream(_stream_of(spark, t, "x3", "ts_us", 1), "source_ip", "ts_us", "event_id", 300, "x3")


@job("X4_block_ttl_stream", BLOCK_SQL + "SELECT ip AS source_ip, event_id, from_us AS ts_us FROM blocks")
def x4_blocks(spark, sf):
    t = v(spark, sf, "threat_events").filter("label = 1 AND severity >= 7.0").select("source_ip", "event_id", "ts_us")
    return twins.greedy_stream(_stream_of(spark, t, "x4", "ts_us", 1), "source_ip", "ts_us", "event_id", 3600, "x4")


@job("X2_correlation_stream", f"SELECT event_id, source_ip, tactics, stages FROM ({CORR_SQL})")
def x2_correlation(spark, sf):
    t = v(spark, sf, "threat_events").select("source_ip", "event_id", "ts_us", "mitre_tactic", "severity")
    return twins.correlation_stream(_stream_of(spark, t, "x2", "ts_us", 1), name="x2").select("event_id", "source_ip", "tactics", "stages")


def _log_stream(spark, sf, name):
    """The raw log by row id, a commit a micro-batch, in as many files as there are shuffle partitions."""
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _stream_of(spark, view(spark, sf, "raw_event_log", "event_id"), name, "row_id", files, files=files)


@job("X6_incremental_clean", CELLS + f"SELECT min(row_id) AS row_id, {COLS_SQL} FROM cells GROUP BY {COLS_SQL}")
def x6_clean(spark, sf):
    return twins.incremental_clean(_log_stream(spark, sf, "x6"), AS_OF).select("row_id", *COLS)


@job("X6_incremental_clean_ids", ORACLE["D10_clean_event_log"])
def x6_clean_ids(spark, sf):
    return twins.incremental_clean(_log_stream(spark, sf, "x6i"), AS_OF, "x6i", unique_ids=True).select("row_id", *COLS)


@job("X8_packet_handoff", PKT + dpi_sql("pk", "payload_text", "packet_id"))
def x8_handoff(spark, sf):
    p = packets_with_payload(spark, sf).select("packet_id", "ts_us", "src_ip", "payload")
    s = dpi_scan(_stream_of(spark, p, "x8", "ts_us"), "payload")
    return twins.run_to_table(spark, s, "x8").select("packet_id", *DPI_COLS)
