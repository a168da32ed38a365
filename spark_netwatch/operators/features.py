"""ML-ready dataset job (D11): unit stripping (F14), packets per second (F15),
port-scan proxy (F16), method code (F17), time features (F18), label (F19)
and the drop of non-ML columns (P16).

Column aliases (old vs new log schema) resolve through ``first_existing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import strip_units


def first_existing(df: DataFrame, names: list[str]) -> str | None:
    for n in names:
        if n in df.columns:
            return n
    return None


def parse_log_time(text: Column) -> Column:
    """Timestamp text in any of the log's five formats, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in C.TIMESTAMP_FORMATS])


def method_codes(df: DataFrame, method: str) -> DataFrame:
    """category code in sorted order of the distinct values; null -> -1.

    The code table is built from the distinct methods (a small aggregate) and
    joined back; AQE broadcasts it when it is small.
    """
    codes = (df.select(F.col(method).alias("_mv")).filter(F.col("_mv").isNotNull()).distinct()
             .withColumn("Method_Code", (F.dense_rank().over(Window.orderBy("_mv")) - 1).cast("int")))
    out = df.join(codes, F.col(method) == F.col("_mv"), "left").drop("_mv")
    return out.withColumn("Method_Code", F.coalesce(F.col("Method_Code"), F.lit(-1)))


def ml_dataset(log: DataFrame) -> DataFrame:
    """D11 over an event log (raw or cleaned text columns)."""
    df = log
    conf = first_existing(df, ["AI_Confidence", "AI Confidence"])
    if conf:
        df = df.withColumn(conf, strip_units(F.col(conf), ["%"]))
    if "Duration" in df.columns:
        df = df.withColumn("Duration", strip_units(F.col("Duration"), ["s"]))
    if "Rate" in df.columns:
        df = df.withColumn("Rate", strip_units(F.col("Rate"), [" pps"]))
    for feat in ["Payload_Entropy", "Packet_Size", "Connection_Interval", "SYN_Count", "ACK_Count"]:
        if feat in df.columns:
            df = df.withColumn(feat, F.coalesce(F.col(feat).cast("string").try_cast("double"), F.lit(0.0)))
    packets = first_existing(df, ["Packet_Count", "Connection_Count", "Packets"])
    if packets:
        p = F.col(packets).cast("string").try_cast("double")
        if "Duration" in df.columns:
            dur = F.col("Duration")
            df = df.withColumn("Packets_Per_Second", p / F.when(dur == 0, F.lit(1.0)).otherwise(dur))
        df = df.withColumn("Is_Port_Scan", F.when(p > C.PACKET_COUNT_THRESHOLD, 1).otherwise(0))
    method = first_existing(df, ["Detection_Method", "Method"])
    if method:
        df = method_codes(df, method)
    if "Timestamp" in df.columns:
        hour = F.hour(parse_log_time(F.col("Timestamp").cast("string")))
        df = (df.withColumn("Hour", F.coalesce(hour, F.lit(0)))
              .withColumn("Is_Night", F.when((hour >= C.NIGHT_START_HOUR) | (hour <= C.NIGHT_END_HOUR), 1).otherwise(0)))
    if "Label" not in df.columns:
        if method:
            m = F.coalesce(F.col(method), F.lit(""))
            df = df.withColumn("Label", (m.contains("GenAI") | m.contains("DPI")).cast("int"))
        else:
            df = df.withColumn("Label", F.lit(0))
    return drop_for_ml(df, method)


def drop_for_ml(df: DataFrame, method: str | None = None) -> DataFrame:
    """Drop the non-ML columns that exist."""
    cols = [c for c in C.NON_ML_COLUMNS + ([method] if method else []) if c in df.columns]
    return df.drop(*cols)


def flow_rate_features(flows: DataFrame) -> DataFrame:
    """F15 + F16 on a flow table (packets, duration)."""
    dur = F.col("duration")
    return flows.select("*", (F.col("packets") / F.when(dur == 0, F.lit(1.0)).otherwise(dur)).alias("Packets_Per_Second"),
                        F.when(F.col("packets") > C.PACKET_COUNT_THRESHOLD, 1).otherwise(0).alias("Is_Port_Scan"))
