"""Structured Streaming forms of the stateful operators.

Flows and minutes (X1, X7) are aggregated in append mode: the watermark closes
a session or minute, and its state goes. Cooldown, block TTL and correlation
(X2-X4) run the batch operator over each micro-batch, with a carry from the
epochs before: a last accepted time per source, or a last time per source and
tactic, while it can still matter. A source that fills a micro-batch is cut
into stretches as in batch. Stores (X5, X6) pass over what is already stored by
keyed state. Each stream has a batch twin that must give the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .. import constants as C
from ..operators.correlate import correlate
from ..operators.greedy import accepted_ids
from ..operators.threats import analysable
from ..session import ensure_checkpoint_dir

US = 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/netwatch-stream-{name}-{uuid.uuid4().hex}"


def stage_files(df: DataFrame, path: str, order_col: str, slices: int = 4, closing: int | None = None,
                files: int = 1) -> None:
    """Write ``df`` as ``slices`` parquet commits in ``order_col`` order, so a file
    stream sees time-ordered micro-batches (each commit is one new set of files).

    ``files``: files of a commit, written and read side by side. There are always so many, empty ones if need
    be, so that a stream that takes ``files`` files at a time takes one commit, whose rows have no order.

    ``closing``: a last row of nulls but for ``order_col``, so much later than the others. It moves
    the watermark past them, which closes their windows, and is never given out itself.
    """
    bounds = df.agg(F.min(order_col).alias("lo"), F.max(order_col).alias("hi")).first()
    lo, hi = bounds["lo"], bounds["hi"]
    if lo is None:
        df.limit(0).write.mode("append").parquet(path)
        return
    step = (hi - lo) // slices + 1
    for i in range(slices):
        part = df.filter((F.col(order_col) >= lo + i * step) & (F.col(order_col) < lo + (i + 1) * step))
        if files == 1:
            part.coalesce(1).write.mode("append").parquet(path)     # one file a commit, so file order is row order
            continue
        part.repartition(files, order_col).write.mode("append").parquet(path)     # a task without rows writes no file
        for _ in range((i + 1) * files - len(df.sparkSession.read.schema(df.schema).parquet(path).inputFiles())):
            df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    if closing:
        end = [(F.lit(hi + closing) if f.name == order_col else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema]
        df.sparkSession.range(1).coalesce(1).select(*end).write.mode("append").parquet(path)


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run_batches(stream: DataFrame, name: str, store, mode: str = "append", processing_time: str | None = None) -> None:
    """Run ``stream`` over everything available, each micro-batch through ``store(batch, epoch)``."""
    w = (stream.writeStream.queryName(f"netwatch_{name}_{uuid.uuid4().hex[:8]}").outputMode(mode).foreachBatch(store)
         .option("checkpointLocation", scratch(stream.sparkSession, f"ckpt-{name}")))
    if processing_time:
        q = w.trigger(processingTime=processing_time).start()
        q.processAllAvailable()
        q.stop()
    else:
        q = w.trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))


def run_to_table(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run ``stream`` in append mode into Parquet, one folder an epoch (a retried epoch replaces its own), and read it back."""
    path = scratch(spark, f"sink-{name}")
    run_batches(stream, name, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"))
    return stored(spark, path, stream.schema).select(*stream.columns)


def stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """The epochs written under ``path``, with ``epoch``; none yet: no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("long"))
    return spark.read.schema(StructType([*schema.fields, StructField("epoch", LongType())])).option("basePath", path).parquet(path)


# ------------------------------------------------------------------ X1, X7, X5
def session_flows(packets: DataFrame, idle_s: int = C.FLOW_IDLE_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """Flows as session windows (gap > idle_s closes a flow, as in W0)."""
    ev = packets.withColumn("event_time", F.timestamp_micros("ts_us")).withWatermark("event_time", watermark)
    gap = f"{idle_s} seconds 1 microsecond"
    return ev.groupBy(F.session_window("event_time", gap).alias("session"), "src_ip").agg(
        F.count(F.lit(1)).alias("packets"), F.size(F.collect_set("dst_port")).alias("unique_ports"),
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("last_us"))


def minute_metrics(events: DataFrame, ts: str = "ts_us", watermark: str = "2 minutes") -> DataFrame:
    """Tumbling 1-minute activity (the streaming form of A26).

    Counts per (minute, source) first, then per minute: a minute's sources are keys of their own, no set of
    them is kept in one row, and both states go when the watermark passes the minute.
    """
    ev = events.withColumn("event_time", F.timestamp_micros(ts)).withWatermark("event_time", watermark)
    threat = F.col("label") == 1
    by_source = ev.groupBy(F.window("event_time", "1 minute").alias("w"), "source_ip").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(threat).alias("threats"),
        F.count_if(threat & (F.col("severity") >= 7.0)).alias("blocking"))
    return by_source.groupBy(F.window("w", "1 minute").alias("w")).agg(
        F.sum("events").alias("events"), F.sum("threats").alias("threats"), F.count("source_ip").alias("active_flows"),
        F.count(F.when(F.col("blocking") > 0, F.col("source_ip"))).alias("blocked_ips"),
    ).select(F.date_format(F.col("w.start"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("minute"), "events", "threats",
             "active_flows", "blocked_ips")


# ------------------------------------------------------------------ X2, X3, X4
def run_carried(stream: DataFrame, name: str, rows_schema: str, carry_schema: str, step) -> DataFrame:
    """Each micro-batch with the carry of the epochs before it: ``step(batch, carry)`` gives its rows and the next carry.

    Both are written as folders of the epoch, the carry last, and a retried epoch replaces its own. An epoch reads one
    earlier carry; the one before that is deleted, since no retry can need it. The rows are read back.
    """
    spark = stream.sparkSession
    out, at = scratch(spark, f"sink-{name}"), scratch(spark, f"carry-{name}")

    def store(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        before = session.createDataFrame([], carry_schema) if epoch == 0 else session.read.schema(carry_schema).parquet(f"{at}/{epoch - 1}")
        batch.persist()                 # read by the step's several jobs
        rows, carry = step(batch, before)
        rows.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        carry.write.mode("overwrite").parquet(f"{at}/{epoch}")
        rows.unpersist()
        batch.unpersist()
        old = session._jvm.org.apache.hadoop.fs.Path(f"{at}/{epoch - 2}")
        old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    run_batches(stream, name, store)
    return stored(spark, out, spark.createDataFrame([], rows_schema).schema).drop("epoch")


def live(carry: DataFrame, batch: DataFrame, ts: str, seen: str, keep_us: int) -> DataFrame:
    """Carried rows whose time ``seen`` is at most ``keep_us`` before the latest one met (one value, read first)."""
    latest = [df.agg(F.max(c)).first()[0] for df, c in ((batch, ts), (carry, seen))]
    latest = max((t for t in latest if t is not None), default=0)
    return carry.filter(F.col(seen) >= latest - keep_us)


def greedy_stream(events: DataFrame, key: str, ts: str, eid: str, gap_s: int, name: str = "greedy") -> DataFrame:
    """Accepted events per key; the carry is the key's last accepted time.

    An event less than ``gap_s`` after it, or before it, is absorbed; the first of the others starts the chain of the
    micro-batch, which ``accepted_ids`` spreads over tasks. A key is forgotten after twice the gap, which leaves
    events that come up to one gap late absorbed as well.
    """
    gap = gap_s * US
    kind = dict(events.dtypes)

    def step(batch: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
        last = carry.select(F.col(key).alias("_key"), "last_us")
        fresh = batch.join(last, batch[key].eqNullSafe(F.col("_key")), "left").filter(
            F.col("last_us").isNull() | (F.col(ts) >= F.col("last_us") + gap)).select(key, eid, ts)
        ids = accepted_ids(fresh, key, ts, eid, gap).withColumnRenamed("id", eid)
        rows = fresh.join(ids, eid).select(key, eid, ts).persist()
        after = rows.select(key, F.col(ts).alias("last_us")).unionByName(carry).groupBy(key).agg(F.max("last_us").alias("last_us"))
        return rows, live(after, batch, ts, "last_us", 2 * gap)

    return run_carried(events, name, f"{key} {kind[key]}, {eid} {kind[eid]}, {ts} bigint", f"{key} {kind[key]}, last_us bigint", step)


def correlation_stream(events: DataFrame, window_s: int = C.CORRELATION_WINDOW_SECONDS, name: str = "correlation") -> DataFrame:
    """Tactics of the trailing window; the carry is the last time of each (source, tactic).

    The carried times join the micro-batch as rows without an event id, so ``correlate`` sees them in order,
    cuts hot sources into stretches as in batch, and the rows are dropped again. A time is carried for two windows,
    so an event that comes up to one window late still meets it.
    """
    width = window_s * US
    carry_schema = "source_ip string, mitre_tactic string, ts_us bigint"

    def step(batch: DataFrame, carry: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = analysable(batch, "source_ip", "severity").select(
            "source_ip", "event_id", "ts_us", "mitre_tactic", F.lit(1.0).alias("severity"), F.lit(0.0).alias("confidence"), F.lit(False).alias("_carried"))
        before = carry.select(
            "source_ip", F.lit(None).cast("string").alias("event_id"), "ts_us", "mitre_tactic", F.lit(1.0).alias("severity"),
            F.lit(0.0).alias("confidence"), F.lit(True).alias("_carried"))
        rows = correlate(met.unionByName(before), window_s=window_s).filter(~F.col("_carried"))
        tactics = met.filter("mitre_tactic IS NOT NULL AND mitre_tactic <> 'Unknown'").select("source_ip", "mitre_tactic", "ts_us")
        after = tactics.unionByName(carry).groupBy("source_ip", "mitre_tactic").agg(F.max("ts_us").alias("ts_us"))
        return rows.select("source_ip", "event_id", "tactics", "stages"), live(after, batch, "ts_us", "ts_us", 2 * width)

    return run_carried(events, name, "source_ip string, event_id string, tactics array<string>, stages int", carry_schema, step)


# ------------------------------------------------------------------ X5, X6
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def first_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A stream's rows that no earlier epoch, nor an earlier row of the same epoch by ``order``, equals in ``keys``.

    The state is one row per digest of the keys; an epoch looks up the digests it meets and rereads nothing that
    is stored. For ``update`` mode: a group is given out in the epoch that first meets it (``_at``, the epoch's own
    time, which a retry repeats). The log's own times play no part, so no row can be late.
    """
    digest = F.sha2(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), 256)
    now = F.current_timestamp()
    met = rows.select("*", digest.alias("_digest"), now.alias("_at")).groupBy("_digest").agg(
        F.min_by(F.struct(*rows.columns), F.struct("_at", order)).alias("_row"), F.min("_at").alias("_at"))
    return met.filter(F.col("_at") == now).select("_row.*")


def run_to_store(stream: DataFrame, name: str, processing_time: str | None = None) -> DataFrame:
    """Run a ``first_of`` stream into Parquet, one folder an epoch, its state in RocksDB; read back."""
    spark = stream.sparkSession
    path = scratch(spark, f"sink-{name}")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKS_DB)          # the query takes its settings when it starts
    try:
        run_batches(stream, name, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}"), "update", processing_time)
    finally:
        spark.conf.set(conf, before)
    return stored(spark, path, stream.schema).select(*stream.columns)


def incremental_clean(raw: DataFrame, as_of: str, name: str = "x6", unique_ids: bool = False) -> DataFrame:
    """Cleaning as a stream: per-row rules, exact duplicates dropped against all earlier rows, stored and read back.

    ``unique_ids``: the rows read back get the id suffixes of W9. A suffix passes over ids that stand anywhere in
    the log, later rows included, so it is given at reading and not stored; the result is that of D10.
    """
    from ..operators.clean import _suffix_ids, clean_cells
    cols = [c for c in raw.columns if c != "row_id"]
    rows = run_to_store(first_of(clean_cells(raw, as_of).select("row_id", *cols), cols, "row_id"), name)
    return (_suffix_ids(rows, "row_id") if unique_ids else rows).select("row_id", *cols)


def flush_threats(raw: DataFrame, name: str = "x5") -> DataFrame:
    """Threats of each micro-batch go to the store, one row an event id, ids stored before passed over; read back."""
    from ..sources.logs import threat_rows
    rows = first_of(threat_rows(raw, keep=["row_id"]), ["event_id"], "row_id")
    return run_to_store(rows, name, processing_time="1 second").drop("row_id")
