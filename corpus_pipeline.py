"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Every stage works on all rows that its predecessor kept. All but the last return the columns of
``documents``, with ``n_chars`` brought up to date; documents of which a stage leaves no text go,
as their text stays elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_netwatch.llm.common import shared_folder, table
from spark_netwatch.llm.fuzzy_lines import dedup_lines
from spark_netwatch.llm.jaccard import jaccard_components
from spark_netwatch.llm.packing import pack
from spark_netwatch.llm.quality import THRESHOLD, score, train
from spark_netwatch.llm.queries import tokenizer_file
from spark_netwatch.llm.suffixes import remove_repeats

#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def _with_text(rows: DataFrame, like: DataFrame, text: Column) -> DataFrame:
    """The columns of ``like`` with another text; rows that lose all of it go."""
    size = dict(like.dtypes).get("n_chars")
    own = {"text": text, **({"n_chars": F.length(text).cast(size)} if size else {})}
    return rows.filter((F.length(text) > 0) | (F.length(F.coalesce("text", F.lit(""))) == 0)).select(*[own[c].alias(c) if c in own else F.col(c) for c in like.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the line field scores below the threshold."""
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.filter(scored.quality_score >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated lines; a document whose every line stands in another one goes."""
    rows = dedup_lines(docs)
    return _with_text(rows.filter("n_lines > n_removed OR n_lines = 0"), docs, F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group of near duplicates."""
    groups = jaccard_components(docs, NEAR_WIDTH, NEAR_PERCENT)
    gone = groups.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that occur elsewhere but for their first occurrence; a character that a cut splits stays."""
    rows = remove_repeats(docs, as_text=True, keep_first=True)
    return _with_text(rows, docs, F.when(F.col("text").isNotNull(), F.col("kept")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: SQL cannot express the classifier or the fuzzy stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/llm-pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
