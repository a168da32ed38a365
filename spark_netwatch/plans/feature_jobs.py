"""Registered ML-dataset jobs: D11, F14-F19, P16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, flows
from ..functions.text import strip_units
from .flow_jobs import A1_SQL
from .registry import job, v, w
from .sqlgen import _DUCK_FMT

RAW = w("raw_event_log")
TS_PARSE = "COALESCE(" + ", ".join(f"try_strptime(Timestamp, '{f}')" for f in _DUCK_FMT) + ")"
CODES = "codes AS (SELECT m, CAST(dense_rank() OVER (ORDER BY m) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT Detection_Method AS m FROM raw_event_log WHERE Detection_Method IS NOT NULL))"


def raw(spark, sf):
    return v(spark, sf, "raw_event_log")


@job("D11_ml_dataset", RAW + ", " + CODES + f"""
SELECT row_id, Protocol, COALESCE(TRY_CAST(trim(replace(AI_Confidence, '%', '')) AS DOUBLE), 0.0) AS AI_Confidence,
  Base64_Detected, Label, COALESCE(TRY_CAST(trim(replace(Duration, 's', '')) AS DOUBLE), 0.0) AS Duration,
  COALESCE(codes.code, -1) AS Method_Code, CAST(COALESCE(hour({TS_PARSE}), 0) AS INTEGER) AS Hour,
  CASE WHEN hour({TS_PARSE}) >= 22 OR hour({TS_PARSE}) <= 5 THEN 1 ELSE 0 END AS Is_Night
FROM raw_event_log LEFT JOIN codes ON raw_event_log.Detection_Method = codes.m""")
def d11_dataset(spark, sf):
    return features.ml_dataset(raw(spark, sf))


@job("P16_drop_for_ml", RAW + "SELECT row_id, Protocol, AI_Confidence, Base64_Detected, Label, Duration FROM raw_event_log")
def p16_drop(spark, sf):
    return features.drop_for_ml(raw(spark, sf), "Detection_Method")


@job("F14_strip_units", RAW + """SELECT row_id, COALESCE(TRY_CAST(trim(replace(AI_Confidence, '%', '')) AS DOUBLE), 0.0) AS ai_confidence,
  COALESCE(TRY_CAST(trim(replace(Duration, 's', '')) AS DOUBLE), 0.0) AS duration FROM raw_event_log""")
def f14_units(spark, sf):
    r = raw(spark, sf)
    return r.select("row_id", strip_units(F.col("AI_Confidence"), ["%"]).alias("ai_confidence"),
                    strip_units(F.col("Duration"), ["s"]).alias("duration"))


@job("F15_packets_per_second", A1_SQL.replace("\nFROM a", ", packets / CASE WHEN (" + "floor(((last_us - start_us) * 2 + 1 * 100) / (1 * 200.0)) / 10000.0" + ") = 0 THEN 1.0 ELSE floor(((last_us - start_us) * 2 + 1 * 100) / (1 * 200.0)) / 10000.0 END AS Packets_Per_Second,\n  CASE WHEN packets > 15 THEN 1 ELSE 0 END AS Is_Port_Scan\nFROM a"))
def f15_pps(spark, sf):
    return features.flow_rate_features(flows.flow_summary(v(spark, sf, "net_packets")))


@job("F17_method_code", RAW + ", " + CODES + " SELECT m AS Detection_Method, code AS Method_Code FROM codes")
def f17_codes(spark, sf):
    r = raw(spark, sf).select("Detection_Method").distinct()
    return features.method_codes(r, "Detection_Method")


@job("F18_time_features", RAW + f"""SELECT row_id, Timestamp, CAST(COALESCE(hour({TS_PARSE}), 0) AS INTEGER) AS Hour,
  CASE WHEN hour({TS_PARSE}) >= 22 OR hour({TS_PARSE}) <= 5 THEN 1 ELSE 0 END AS Is_Night FROM raw_event_log""")
def f18_time(spark, sf):
    r = raw(spark, sf)
    hour = F.hour(features.parse_log_time(F.col("Timestamp")))
    return r.select("row_id", "Timestamp", F.coalesce(hour, F.lit(0)).alias("Hour"),
                    F.when((hour >= 22) | (hour <= 5), 1).otherwise(0).alias("Is_Night"))


@job("F19_label_from_method", RAW + """SELECT row_id, Detection_Method,
  CAST(contains(COALESCE(Detection_Method, ''), 'GenAI') OR contains(COALESCE(Detection_Method, ''), 'DPI') AS INTEGER) AS Label
FROM raw_event_log""")
def f19_label(spark, sf):
    r = raw(spark, sf).drop("Label").select("row_id", "Detection_Method")
    out = features.ml_dataset(r.withColumn("_keep", F.col("Detection_Method")))
    return out.select("row_id", F.col("_keep").alias("Detection_Method"), "Label")
