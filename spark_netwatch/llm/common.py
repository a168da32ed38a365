"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key holding more than 1/HEAVY_SHARE of all rows is heavy; there are fewer than HEAVY_SHARE such keys.
HEAVY_SHARE = 1000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet into the shared folder and read it back.

    A lost executor then costs a reread of a file, never a recomputation, and non-deterministic
    columns (row numbers, partition ids) are fixed. The files go when the application ends, or
    earlier through ``dropped``.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    del df
    gc.collect()
    spark._jvm.System.gc()      # shuffle files go when the driver's garbage does; the steps before are done with theirs
    return spark.read.schema(schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` that no later step reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/llm-" in folder:
                fs, at = _file_system(df.sparkSession, folder)
                fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def join_by_weight(left: DataFrame, right: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, unique in ``right``, where ``right[weight]`` counts left's rows of that key.

    Keys with more than ``total / HEAVY_SHARE`` rows are fewer than HEAVY_SHARE, so that part of
    ``right`` is broadcast whatever the input's size and no task receives a heavy key's rows; the
    other keys are joined by a shuffle.
    """
    limit = max(total // HEAVY_SHARE, 1)
    heavy = F.broadcast(right.filter(F.col(weight) > limit))
    light = right.filter(F.col(weight) <= limit)
    return left.join(heavy, key).unionByName(left.join(heavy.select(key), key, "left_anti").join(light, key))
