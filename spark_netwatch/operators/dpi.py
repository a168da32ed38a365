"""Deep payload inspection: decode (F24), base64 unwrap (F23), first matching
signature (J8), all matches (J9), text fallback (D2) and hit counts (A27).

Signatures are data (built-ins plus custom JSON, S7/U2). The rule list is a
dimension: it is read once on the driver and compiled into one ``CASE WHEN
rlike`` chain, so every task scans each payload, whole, with literal patterns
(compiled once per task) and stops at the first hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.text import base64_unwrap, decode_utf8_ignore
from .classify import classify_columns, with_mitre

SIG_SCHEMA = T.StructType([
    T.StructField("sig_order", T.IntegerType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("severity", T.StringType(), False),
    T.StructField("confidence", T.DoubleType(), False),
    T.StructField("cwe", T.StringType(), False),
    T.StructField("mitre_technique", T.StringType(), False),
    T.StructField("references", T.ArrayType(T.StringType()), False),
    T.StructField("pattern", T.StringType(), False),
])


def builtin_signatures(spark: SparkSession) -> DataFrame:
    from ..sources.fixtures import constant_table
    return constant_table(spark, [(i, *row) for i, row in enumerate(C.SIGNATURES)], SIG_SCHEMA)


def load_signatures(spark: SparkSession, path: str | None = None) -> DataFrame:
    """S7 + U2: built-ins followed by custom rules from a JSON array file.

    ``pattern`` falls back to ``regex``; confidence 100, cwe ``Custom`` by default.
    """
    base = builtin_signatures(spark)
    if not path:
        return base
    raw = spark.read.option("multiLine", True).json(path)
    cols = set(raw.columns)

    def opt(name):
        return F.col(name) if name in cols else F.lit(None).cast("string")
    custom = raw.select(
        F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"),
        F.col("severity").cast("string").alias("severity"),
        F.lit(C.CUSTOM_SIG_CONFIDENCE).alias("confidence"),
        F.coalesce(opt("cwe"), F.lit(C.CUSTOM_SIG_CWE)).alias("cwe"),
        F.lit(C.CUSTOM_SIG_TECHNIQUE).alias("mitre_technique"),
        F.array(*[F.lit(r) for r in C.CUSTOM_SIG_REFERENCES]).alias("references"),
        F.coalesce(opt("pattern"), opt("regex")).alias("pattern"),
        F.monotonically_increasing_id().alias("_pos"),
    ).filter(F.col("pattern").isNotNull())
    from pyspark.sql import Window
    custom = custom.withColumn("sig_order", (F.row_number().over(Window.orderBy("_pos")) + len(C.SIGNATURES) - 1).cast("int")).drop("_pos")
    return base.unionByName(custom)


def compile_rules(sigs: DataFrame | None = None) -> list:
    """The rules in order: the built-in ones without a job, others read once."""
    if sigs is None:
        names = [f.name for f in SIG_SCHEMA.fields]
        return [dict(zip(names, (i, *row))) for i, row in enumerate(C.SIGNATURES)]
    return sigs.orderBy("sig_order").collect()


def first_match_index(text: Column, rules: list) -> Column:
    """Position of the first matching rule, null when none matches."""
    out = None
    for i, r in enumerate(rules):
        cond = text.rlike(r["pattern"])
        out = F.when(cond, F.lit(i)) if out is None else out.when(cond, F.lit(i))
    return out if out is not None else F.lit(None).cast("int")


def _rule_array(rules: list) -> Column:
    return F.array(*[F.struct(F.lit(r["id"]).alias("id"), F.lit(r["name"]).alias("name"),
                              F.lit(r["severity"]).alias("severity"), F.lit(float(r["confidence"])).alias("confidence"),
                              F.lit(r["cwe"]).alias("cwe"), F.lit(r["mitre_technique"]).alias("mitre_technique"),
                              F.array(*[F.lit(x) for x in r["references"]]).cast("array<string>").alias("references"))
                     for r in rules])


def inspect_text(payload: Column, is_binary: bool = True) -> tuple[Column, Column]:
    """F24 + F23: decode ignoring bad bytes, unwrap base64."""
    return base64_unwrap(decode_utf8_ignore(payload if is_binary else F.encode(payload, "UTF-8")))


def dpi_scan(df: DataFrame, payload_col: str = "payload", sigs: DataFrame | None = None,
             compat: bool = False, prefix: str = "dpi_") -> DataFrame:
    """The DPI verdict per row as ``dpi_*`` columns.

    Signature hit -> that rule. Otherwise, text longer than 10 characters goes
    to the keyword classifier: the payload alone (default) or the reference's
    ``Payload content detected: ...`` sentence (``compat=True``, SURVEY Q1).
    """
    rules = compile_rules(sigs)
    is_binary = isinstance(df.schema[payload_col].dataType, T.BinaryType)
    text, b64 = inspect_text(F.col(payload_col), is_binary)
    p = prefix
    staged = df.select("*", text.alias(p + "text"), b64.alias(p + "base64"))
    idx = first_match_index(F.col(p + "text"), rules)
    staged = staged.withColumn(p + "_idx", idx)
    ai_text = F.col(p + "text")
    if compat:
        ai_text = F.concat(F.lit("Payload content detected: "), ai_text)
    cls = classify_columns(ai_text)
    staged = staged.select("*", cls["is_threat"].alias(p + "_ai_threat"), cls["threat_type"].alias(p + "_ai_type"),
                           cls["confidence"].alias(p + "_ai_conf"))
    staged = with_mitre(staged, p + "_ai_type").withColumnRenamed("technique_id", p + "_ai_tech") \
        .drop("technique_name", "tactic", "mitre_severity")
    rule = F.element_at(_rule_array(rules), F.col(p + "_idx") + 1)
    hit = F.col(p + "_idx").isNotNull()
    ai = ~hit & (F.length(F.col(p + "text")) > 10) & F.col(p + "_ai_threat")
    suffix = F.when(F.col(p + "base64"), F.lit(" (Base64 Encoded)")).otherwise(F.lit(""))
    out = staged.select(
        *[F.col(c) for c in df.columns],
        (hit | ai).alias(p + "is_threat"),
        F.when(hit, F.concat(F.lit("DPI matched signature for "), rule["name"], suffix))
         .when(ai, F.concat(F.lit("GenAI identified malicious payload intent"), suffix)).alias(p + "reason"),
        F.when(hit | ai, F.substring(F.col(p + "text"), 1, 50)).alias(p + "snippet"),
        F.when(hit, rule["severity"]).when(ai, F.lit(C.DPI_AI_SEVERITY)).alias(p + "severity"),
        F.when(hit, rule["confidence"]).when(ai, F.col(p + "_ai_conf")).alias(p + "confidence"),
        F.when(hit | ai, F.col(p + "base64")).alias(p + "base64"),
        F.when(hit, rule["id"]).when(ai, F.lit(C.DPI_AI_RULE)).alias(p + "rule_id"),
        F.when(hit, rule["cwe"]).when(ai, F.lit(C.DPI_AI_CWE)).alias(p + "cwe"),
        F.when(hit, rule["mitre_technique"]).when(ai, F.coalesce(F.col(p + "_ai_tech"), F.lit("T1595"))).alias(p + "technique"),
        F.when(hit, rule["references"]).when(ai, F.array().cast("array<string>")).alias(p + "references"),
    )
    return out


def all_matches(df: DataFrame, payload_col: str = "payload", sigs: DataFrame | None = None) -> DataFrame:
    """Every matching rule id per row (array, in rule order).

    The inspected text is a column of its own, so that it is made once a row and not once a rule."""
    rules = compile_rules(sigs)
    is_binary = isinstance(df.schema[payload_col].dataType, T.BinaryType)
    text, _ = inspect_text(F.col(payload_col), is_binary)
    none = F.array().cast("array<string>")
    ids = [F.when(F.col("_text").rlike(r["pattern"]), F.array(F.lit(r["id"]))).otherwise(none) for r in rules]
    return df.withColumn("_text", text).withColumn("matched_rules", F.flatten(F.array(*ids))).drop("_text")


def all_hits(df: DataFrame, payload_col: str = "payload", sigs: DataFrame | None = None) -> DataFrame:
    """Rows per matching rule."""
    # not ``explode``: it puts a test of the array's size below itself, and the rules are matched again for that
    hits = all_matches(df, payload_col, sigs).select(F.explode_outer("matched_rules").alias("rule_id")).filter("rule_id IS NOT NULL")
    return hits.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))


def rule_hit_counts(scanned: DataFrame, prefix: str = "dpi_") -> DataFrame:
    """Hits per rule, severity and CWE over DPI verdicts."""
    return (scanned.filter(F.col(prefix + "is_threat"))
            .groupBy(F.col(prefix + "rule_id").alias("rule_id"), F.col(prefix + "severity").alias("severity"),
                     F.col(prefix + "cwe").alias("cwe"))
            .agg(F.count(F.lit(1)).alias("hits")))
