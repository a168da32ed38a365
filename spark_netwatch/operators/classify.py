"""Behaviour-text classifier (D3) and the threat-type -> MITRE lookup.

Keyword groups are lower-case substring tests, evaluated JVM-side. The MITRE
dimension is a fixed 7-row table joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def _any(lower: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | lower.contains(w)
    return out


def mitre_table(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("threat_type", T.StringType(), False),
        T.StructField("technique_id", T.StringType(), True),
        T.StructField("technique_name", T.StringType(), True),
        T.StructField("tactic", T.StringType(), True),
        T.StructField("mitre_severity", T.DoubleType(), False),
    ])
    from ..sources.fixtures import constant_table
    return constant_table(spark, C.MITRE_MAP, schema)


def with_mitre(df: DataFrame, type_col: str = "threat_type") -> DataFrame:
    """Attach technique, name, tactic and severity; unknown types get the Normal Traffic entry."""
    spark = df.sparkSession
    m = mitre_table(spark)
    normal = [r for r in C.MITRE_MAP if r[0] == "Normal Traffic"][0]
    j = df.join(F.broadcast(m.withColumnRenamed("threat_type", "_tt")), F.col(type_col) == F.col("_tt"), "left")
    return j.select(
        *[F.col(c) for c in df.columns],
        F.when(F.col("_tt").isNull(), F.lit(normal[1])).otherwise(F.col("technique_id")).alias("technique_id"),
        F.when(F.col("_tt").isNull(), F.lit(normal[2])).otherwise(F.col("technique_name")).alias("technique_name"),
        F.when(F.col("_tt").isNull(), F.lit(normal[3])).otherwise(F.col("tactic")).alias("tactic"),
        F.coalesce(F.col("mitre_severity"), F.lit(normal[4])).alias("mitre_severity"),
    )


def classify_columns(text: Column) -> dict[str, Column]:
    """D3 without the MITRE lookup: label, score, groups, threat flag, type, method."""
    low = F.lower(text)
    neg = _any(low, C.NEGATIVE_KEYWORDS)
    recon, payload = _any(low, C.RECON_KEYWORDS), _any(low, C.PAYLOAD_KEYWORDS)
    cmd, web, anomaly = _any(low, C.CMD_KEYWORDS), _any(low, C.WEB_KEYWORDS), _any(low, C.ANOMALY_KEYWORDS)
    keyword = recon | payload | cmd | web | anomaly
    label = F.when(neg, "NEGATIVE").otherwise("POSITIVE")
    base = F.when(neg, C.NEGATIVE_SCORE).otherwise(C.POSITIVE_SCORE)
    score = F.when(keyword & (base < 90), F.lit(92.0) + F.pmod(base, F.lit(7.0))).otherwise(base)
    is_threat = neg | keyword
    ttype = (F.when(~is_threat, "Normal Traffic").when(cmd, "Remote Code Execution Attempt")
             .when(web, "Web Application Attack").when(payload, "Malicious Payload Delivery")
             .when(recon, "Stealth Reconnaissance").when(anomaly, "High-Frequency Anomalous Traffic")
             .otherwise("Anomalous AI-Detected Threat"))
    explain = (F.when(~is_threat, C.EXPLANATIONS["normal"]).when(cmd, C.EXPLANATIONS["cmd"])
               .when(web, C.EXPLANATIONS["web"]).when(recon, C.EXPLANATIONS["recon"])
               .when(payload, C.EXPLANATIONS["payload"]).when(anomaly, C.EXPLANATIONS["anomaly"])
               .otherwise(F.replace(F.lit(C.EXPLANATIONS["other"]), F.lit("{label}"), label)))
    method = F.when(neg & ~keyword, "GenAI Threat Intel").otherwise("Heuristic Check")
    return {"is_threat": is_threat, "threat_type": ttype, "method": method, "confidence": score,
            "_explain": explain, "raw_ai_label": label}


def classify_text(df: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    """D3: classify a text column; adds is_threat, threat_type, method, confidence,
    explanation, raw_ai_label, severity and the MITRE fields."""
    cols = classify_columns(F.col(text_col))
    out = df.select("*", *[c.alias(prefix + n) for n, c in cols.items()])
    out = with_mitre(out, prefix + "threat_type")
    suffix = F.when(F.col(prefix + "is_threat") & F.col("technique_id").isNotNull(),
                    F.format_string(" [MITRE ATT&CK: %s - %s]", F.col("technique_id"), F.col("technique_name"))
                    ).otherwise(F.lit(""))
    return (out.withColumn(prefix + "explanation", F.concat(F.col(prefix + "_explain"), suffix))
            .withColumn(prefix + "severity", F.col("mitre_severity"))
            .withColumnRenamed("technique_id", prefix + "technique_id")
            .withColumnRenamed("technique_name", prefix + "technique_name")
            .withColumnRenamed("tactic", prefix + "tactic")
            .drop(prefix + "_explain", "mitre_severity"))
