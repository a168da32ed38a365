"""Spark jobs vs their DuckDB twins on the sf0.001 tables (a fast cross-section)."""

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as entry
from scripts.oracle_check import TABLES, rows

PICK = ["A1_flow_summary", "W1_running_flow_state", "W2_interval_frame", "W4_risk_accumulation", "D1_feature_vector",
        "P1_query_threats", "A10_ip_reputation", "A13_minute_timeline", "W10_newest_per_ip", "J10_reputation_merge",
        "D2_dpi_packets", "D2_dpi_pages", "D3_classify_conversations", "J4_osint_fusion", "J6_geo_lookup",
        "J3_cidr_blocked", "W5_correlation", "W6_alert_gate", "W7_block_intervals", "D5_playbook",
        "D10_clean_event_log", "A21_cleaning_stats", "D11_ml_dataset", "D4_verdicts", "P9_keyword_evidence",
        "S1_read_event_log", "S14_honeypot_threats", "S4_store_threats", "S15_raw_json_parsed", "X3_alert_cooldown_stream", "X1_session_flows", "A20_model_quality"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", PICK)
def test_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF001).toPandas()
    ddf = duck.execute(entry.oracle_sql()[name]).df()
    assert rows(sdf) == rows(ddf)
