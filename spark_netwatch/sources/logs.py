"""Event-log and threat-store sources and sinks: S1-S5, S10, S14, S15.

Writers are plain DataFrame writers (partitioned, atomic per task commit);
the streaming variants reuse them through ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

_EXTRA = "_extra_tokens"


def log_schema(columns: list[str] | None = None, extra: bool = True) -> T.StructType:
    cols = list(columns or C.LOG_COLUMNS)
    fields = [T.StructField(c, T.StringType(), True) for c in cols]
    if extra:
        fields.append(T.StructField(_EXTRA, T.StringType(), True))
    return T.StructType(fields)


def read_event_log(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Header CSV of text columns, no inference.

    Short rows are padded with nulls (as pandas does); rows with more fields
    than the header are skipped: one spare trailing column catches them.
    """
    df = (spark.read.schema(log_schema(columns)).option("header", True).option("mode", "PERMISSIVE")
          .option("enforceSchema", True).option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.filter(F.col(_EXTRA).isNull()).drop(_EXTRA)


def stream_event_log(spark: SparkSession, path: str, columns: list[str] | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """The same reader as a file stream (new files are new rows)."""
    r = (spark.readStream.schema(log_schema(columns)).option("header", True).option("mode", "PERMISSIVE")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.csv(path).filter(F.col(_EXTRA).isNull()).drop(_EXTRA)


def write_event_log(df: DataFrame, path: str, max_records_per_file: int = 1_000_000,
                    ts_col: str = "Timestamp") -> None:
    """Append as CSV under ``date=`` folders; files roll over by row count."""
    dated = df.withColumn("date", F.coalesce(F.substring(F.col(ts_col), 1, 10), F.lit("unknown")))
    (dated.write.mode("append").partitionBy("date").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", max_records_per_file).csv(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    """S3: append as JSON Lines."""
    df.write.mode("append").json(path)


THREAT_COLUMNS = [
    ("event_id", "Event_ID", "string"), ("timestamp", "Timestamp", "string"),
    ("source_ip", "Source_IP", "string"), ("source_port", "Source_Port", "int"),
    ("destination_ip", "Destination_IP", "string"), ("destination_port", "Destination_Port", "int"),
    ("protocol", "Protocol", "string"), ("detection_method", "Detection_Method", "string"),
    ("confidence", "AI_Confidence", "double"), ("severity", "Threat_Score", "double"),
    ("threat_type", "Threat_Type", "string"), ("threat_intel", "Threat_Intelligence", "string"),
    ("firewall_action", "Firewall_Action", "string"), ("dpi_result", "DPI_Result", "string"),
    ("ai_label", "AI_Label", "string"), ("ml_prediction", "ML_Prediction", "int"),
    ("prediction_probability", "Prediction_Probability", "double"), ("packet_size", "Packet_Size", "int"),
    ("payload_entropy", "Payload_Entropy", "double"), ("is_port_scan", "Port_Scan_Flag", "int"),
    ("unique_ports", "Unique_Ports", "int"), ("duration", "Duration", "double"), ("rate", "Rate", "double"),
]


def threat_rows(log_rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """S4 projection: log rows with ``Label = 1`` as threat-table rows (typed, missing -> 0 / '')."""
    cols = [F.col(k) for k in (keep or [])]
    for out, src, typ in THREAT_COLUMNS:
        c = F.col(src) if src in log_rows.columns else F.lit(None).cast("string")
        if typ == "string":
            cols.append(F.coalesce(c.cast("string"), F.lit("TCP" if out == "protocol" else "")).alias(out))
        else:
            num = F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
            cols.append((num.cast("int") if typ == "int" else num).alias(out))
    return log_rows.filter(F.col("Label").cast("string") == "1").select(*cols)


def sink_threats(batch: DataFrame, existing: DataFrame | None = None, order_col: str | None = None) -> DataFrame:
    """S4 + U4: one row per event id (the first by ``order_col`` when given), minus ids already stored.

    Deduplication is a grouped ``min_by`` (partial aggregation before the
    shuffle); the stored ids are removed with a left anti join.
    """
    if order_col:
        rows = threat_rows(batch, keep=[order_col])
        names = [c for c in rows.columns if c not in ("event_id", order_col)]
        rows = (rows.groupBy("event_id").agg(F.min_by(F.struct(*names), F.col(order_col)).alias("_r"))
                .select("event_id", *[F.col(f"_r.{c}").alias(c) for c in names]))
    else:
        rows = threat_rows(batch).dropDuplicates(["event_id"])
    if existing is not None:
        rows = rows.join(existing.select("event_id"), "event_id", "left_anti")
    return rows


def store_threats(batch: DataFrame, path: str, order_col: str | None = None) -> DataFrame:
    """Append the batch's threats to the Parquet store at ``path``, without ids that it holds; the store is read back.

    Only the id column of the store is read for that. The append commits as a whole, so a batch that is tried again
    after a failure finds either none or all of its ids.
    """
    spark = batch.sparkSession
    rows = sink_threats(batch, order_col=order_col)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows = sink_threats(batch, spark.read.schema(rows.schema).parquet(path), order_col)
    rows.write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def export_threats(df: DataFrame, path: str | None = None, fmt: str = "csv", limit: int = C.EXPORT_LIMIT) -> DataFrame:
    """Newest ``limit`` threats (top-k, so one partition and one file), written as CSV or JSON when a path is given."""
    out = df.orderBy(F.desc("timestamp_epoch"), F.desc("event_id")).limit(limit)
    if path:
        w = out.write.mode("overwrite").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))
    return out


def honeypot_to_threats(captures: DataFrame) -> DataFrame:
    """Non-empty honeypot captures as threat rows (confidence 100, severity 10, T1190)."""
    text = F.regexp_replace(F.col("payload_text"), r"^\s+|\s+$", "")
    return captures.filter(F.coalesce(F.length("payload_text"), F.lit(0)) > 0).select(
        F.concat(F.lit("HP-"), F.unix_seconds(F.col("ts")).cast("string"), F.lit("-"), F.col("client_ip")).alias("event_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("client_ip").alias("source_ip"), F.col("client_port").alias("source_port"),
        F.lit("127.0.0.1").alias("destination_ip"), F.col("port").alias("destination_port"), F.lit("TCP").alias("protocol"),
        F.lit("Active Honeypot Trap").alias("detection_method"), F.lit(C.HONEYPOT_CONFIDENCE).alias("confidence"),
        F.lit(C.HONEYPOT_SEVERITY).alias("severity"), F.lit("Honeypot Interaction").alias("threat_type"),
        F.concat(F.lit(C.HONEYPOT_INTEL_PREFIX), F.substring(text, 1, 200)).alias("threat_intel"),
        F.lit(C.HONEYPOT_TECHNIQUE).alias("mitre_technique_id"), F.lit("Initial Access").alias("mitre_tactic"),
    )


def from_raw_json(df: DataFrame, schema: str, col: str = "raw_json") -> DataFrame:
    """The fields of ``schema`` parsed back from the JSON text column."""
    return df.select(F.from_json(col, schema).alias("_row")).select("_row.*")


def with_raw_json(df: DataFrame, col: str = "raw_json") -> DataFrame:
    """The whole row as a JSON text column."""
    return df.withColumn(col, F.to_json(F.struct(*[F.col(c) for c in df.columns])))
