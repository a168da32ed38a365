"""Session helpers.

Production jobs receive the cluster's session; ``local_session`` exists for
tests and the bench. Nothing here starts a UI or any other server.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spark_netwatch") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call sites are looked up for each column expression: building wide plans takes half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("NETWATCH_DRIVER_MEMORY", "16g"))
        # whole-stage codegen for wide rule projections (cleaning, DPI) yields methods above the
        # JVM's default JIT size limit; let the JIT compile them (clusters: executor options too)
        .config("spark.driver.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .config("spark.executor.extraJavaOptions", "-XX:-DontCompileHugeMethods")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    A cluster sets ``spark.checkpoint.dir`` to a shared filesystem; we only
    pick a scratch folder when it is unset (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    target = conf_dir or tempfile.mkdtemp(prefix="netwatch-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint into the session's checkpoint folder (set from the cluster's
    ``spark.checkpoint.dir``, or a scratch folder only when none is configured)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back: lineage is cut and
    values are fixed. The files go when the application ends."""
    spark, schema = df.sparkSession, df.schema
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/netwatch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, a table as read, dealt out over the shuffle partitions if its files give fewer tasks (a file of one
    row group is one task), so that costly work on its rows runs on all cores."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, key)
