"""Registered cleaning jobs: D10, U1, W9, A21 and the per-rule checks F1-F13."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.cleaning import null_like, safe_float, safe_int
from ..operators import clean
from .registry import job, v, w
from .sqlgen import _nl, _sf, _si, clean_cells_sql

AS_OF = "2024-01-31 00:00:00"
COLS = ["Timestamp", "Event_ID", "Source_IP", "Destination_Port", "Protocol", "AI_Confidence", "Base64_Detected",
        "Label", "Duration", "Detection_Method"]
RAW = w("raw_event_log")
CELLS = RAW + f", cells AS ({clean_cells_sql('raw_event_log', COLS, 'row_id', AS_OF)})\n"
COLS_SQL = ", ".join(COLS)
TAKEN = """coalesce(list(Event_ID) FILTER (WHERE regexp_matches(Event_ID, '_dup[0-9]+$'))
  OVER (PARTITION BY regexp_replace(Event_ID, '(_dup[0-9]+)+$', '')), []) AS taken"""
UNIQUE_ID = """CASE WHEN _suffixed THEN list_filter(list_transform(range(1, rn + len(taken)), lambda k: Event_ID || '_dup' || CAST(k AS VARCHAR)),
  lambda x: NOT list_contains(taken, x))[rn - 1] ELSE Event_ID END AS Event_ID"""
KEPT = CELLS + f""", kept AS (SELECT min(row_id) AS row_id, {COLS_SQL}, arg_min(_dirty, row_id) AS _dirty
  FROM cells GROUP BY {COLS_SQL}),
suf AS (SELECT *, row_number() OVER (PARTITION BY Event_ID ORDER BY row_id) > 1 AS _suffixed,
  row_number() OVER (PARTITION BY Event_ID ORDER BY row_id) AS rn, {TAKEN} FROM kept),
fin AS (SELECT row_id, {COLS_SQL.replace('Event_ID', UNIQUE_ID)},
  _dirty, _suffixed FROM suf)
"""
COMPAT = CELLS + f""", suf AS (SELECT *, row_number() OVER (PARTITION BY Event_ID ORDER BY row_id) > 1 AS _suffixed,
  row_number() OVER (PARTITION BY Event_ID ORDER BY row_id) AS rn, {TAKEN} FROM cells),
s2 AS (SELECT row_id, {COLS_SQL.replace('Event_ID', UNIQUE_ID)},
  _dirty, _suffixed FROM suf),
fin AS (SELECT min(row_id) AS row_id, {COLS_SQL}, arg_min(_dirty, row_id) AS _dirty, arg_min(_suffixed, row_id) AS _suffixed
  FROM s2 GROUP BY {COLS_SQL})
"""


def raw(spark, sf):
    return v(spark, sf, "raw_event_log")


@job("D10_clean_event_log", KEPT + f"SELECT row_id, {COLS_SQL} FROM fin")
def d10_clean(spark, sf):
    return clean.clean_event_log(raw(spark, sf), AS_OF).select("row_id", *COLS)


@job("D10_clean_event_log_compat", COMPAT + f"SELECT row_id, {COLS_SQL} FROM fin")
def d10_clean_compat(spark, sf):
    return clean.clean_event_log(raw(spark, sf), AS_OF, compat=True).select("row_id", *COLS)


STATS = """SELECT t.n AS total_rows, k.c AS cleaned_rows, t.n - k.k AS duplicate_rows_removed,
  t.m AS missing_values_corrected, t.i + k.s AS invalid_values_corrected
FROM (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(_missing) AS BIGINT) AS m, CAST(sum(_invalid) AS BIGINT) AS i FROM cells) t,
     (SELECT CAST(count(*) AS BIGINT) AS k, CAST(count(*) FILTER (WHERE _dirty OR _suffixed) AS BIGINT) AS c,
             CAST(count(*) FILTER (WHERE _suffixed) AS BIGINT) AS s FROM fin) k"""


@job("A21_cleaning_stats", KEPT + STATS)
def a21_stats(spark, sf):
    return clean.cleaning_stats(raw(spark, sf), AS_OF)


@job("A21_cleaning_stats_compat", COMPAT + STATS)
def a21_stats_compat(spark, sf):
    return clean.cleaning_stats(raw(spark, sf), AS_OF, compat=True)


@job("U1_exact_dedupe", CELLS + f"SELECT min(row_id) AS row_id, CAST(count(*) AS BIGINT) AS copies FROM cells GROUP BY {COLS_SQL}")
def u1_dedupe(spark, sf):
    cells = clean.clean_cells(raw(spark, sf), AS_OF)
    return cells.groupBy(*COLS).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copies")).select("row_id", "copies")


@job("W9_event_id_unique", KEPT + "SELECT row_id, Event_ID FROM fin WHERE _suffixed")
def w9_unique(spark, sf):
    return clean.clean_event_log(raw(spark, sf), AS_OF).filter("_suffixed").select("row_id", "Event_ID")


def _cells(spark, sf):
    return clean.clean_cells(raw(spark, sf), AS_OF)


def _rule_job(name: str, column: str):
    sql = RAW + f""", c1 AS ({clean_cells_sql(f"(SELECT row_id, {column} FROM raw_event_log)", [column], 'row_id', AS_OF)})
SELECT r.row_id, r.{column} AS raw, c1.{column} AS cleaned, c1._missing AS missing, c1._invalid AS invalid
FROM (SELECT DISTINCT row_id, {column} FROM raw_event_log) r JOIN (SELECT DISTINCT * FROM c1) c1 ON r.row_id = c1.row_id"""

    @job(name, sql)
    def run(spark, sf):
        r = raw(spark, sf).select("row_id", column).distinct()
        c = clean.clean_cells(r, AS_OF).select("row_id", F.col(column).alias("cleaned"),
                                               F.col("_missing").alias("missing"), F.col("_invalid").alias("invalid"))
        return r.join(c, "row_id").select("row_id", F.col(column).alias("raw"), "cleaned", "missing", "invalid")
    return run


_rule_job("F4_timestamps", "Timestamp")
_rule_job("F5_booleans", "Base64_Detected")
_rule_job("F6_flags", "Label")
_rule_job("F7_ipv4", "Source_IP")
_rule_job("F8_ports", "Destination_Port")
_rule_job("F9_confidence", "AI_Confidence")
_rule_job("F11_numerics", "Duration")
_rule_job("F12_categoricals", "Protocol")
_rule_job("F13_required_ids", "Event_ID")
_rule_job("F2_clean_string", "Detection_Method")


@job("F10_packet_counts", RAW + f""", c1 AS ({clean_cells_sql("(SELECT DISTINCT row_id, Destination_Port AS Packet_Count FROM raw_event_log)", ['Packet_Count'], 'row_id', AS_OF)})
SELECT row_id, Packet_Count AS cleaned, _missing AS missing, _invalid AS invalid FROM c1""")
def f10_packets(spark, sf):
    r = raw(spark, sf).select("row_id", F.col("Destination_Port").alias("Packet_Count")).distinct()
    return clean.clean_cells(r, AS_OF).select("row_id", F.col("Packet_Count").alias("cleaned"),
                                              F.col("_missing").alias("missing"), F.col("_invalid").alias("invalid"))


@job("F1_null_like", RAW + f"""SELECT DISTINCT row_id, {_nl('Source_IP')} AS ip_missing, {_nl('AI_Confidence')} AS conf_missing,
  {_nl('Protocol')} AS proto_missing, {_nl('Base64_Detected')} AS b64_missing FROM raw_event_log""")
def f1_null_like(spark, sf):
    return raw(spark, sf).select("row_id", null_like(F.col("Source_IP")).alias("ip_missing"),
                                 null_like(F.col("AI_Confidence")).alias("conf_missing"),
                                 null_like(F.col("Protocol")).alias("proto_missing"),
                                 null_like(F.col("Base64_Detected")).alias("b64_missing")).distinct()


@job("F3_safe_numbers", RAW + f"""SELECT DISTINCT row_id, {_sf('AI_Confidence')} AS conf_float, {_si('Destination_Port')} AS port_int,
  {_sf('Duration')} AS duration_float FROM raw_event_log""")
def f3_safe(spark, sf):
    return raw(spark, sf).select("row_id", safe_float(F.col("AI_Confidence")).alias("conf_float"),
                                 safe_int(F.col("Destination_Port")).alias("port_int"),
                                 safe_float(F.col("Duration")).alias("duration_float")).distinct()
