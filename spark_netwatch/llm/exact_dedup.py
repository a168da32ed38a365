"""Operator 10, exact dedup: a persistent digest index, bucketed and sorted by hash.

``DigestIndex`` is an external Parquet table in a shared folder, bucketed and sorted by the text
digest. ``ingest`` reduces a batch to one row per digest (map-side combine first), drops digests
that the index has already by a sort-merge anti-join against the buckets, and appends the rest,
one file per bucket and batch.

Defined results: a null text is the empty text; a null doc_id never wins against another one;
rows that repeat a doc_id and text are one document and share its decision; an empty table gives
no rows; further columns of the input are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_weight, shared_folder, written

BUCKETS = 64


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the unchanged text's UTF-8 bytes, as lowercase hex."""
    return docs.select("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("digest"))


class DigestIndex:
    """Index of the digests seen so far: digest, keep_id."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        """Open the index kept at ``path`` (same ``buckets`` as when it was made), or make a new one."""
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{shared_folder(spark)}/llm-digests-{uuid.uuid4().hex}"
        self.name = f"llm_digests_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def ingest(self, batch: DataFrame) -> None:
        """Add (doc_id, digest) rows; a digest that is present keeps its first ``keep_id``."""
        best = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        new = best.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name))
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, digest, keep_id, group_size, kept.

    The batch is taken in two parts, the upper half of the doc_id range first, so that of equal
    texts the largest doc_id enters the index and the anti-join turns away the others. Ids that
    an older index holds already win against the whole batch.
    """
    spark = docs.sparkSession
    index = index or DigestIndex(spark)
    rows = written(digests(docs), "digests")
    low, high, total = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    if total:
        upper = F.coalesce(F.col("doc_id") > ((low or 0) + (high or 0)) // 2, F.lit(False))
        index.ingest(rows.filter(upper))
        index.ingest(rows.filter(~upper))
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = written(sizes.join(index.rows().hint("merge"), "digest"), "groups")
    return join_by_weight(rows, groups, "digest", "group_size", total).select(
        "doc_id", "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))
