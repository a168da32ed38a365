"""Operator 8, document fingerprints: a Merkle tree over sections and paragraphs.

A section is the text between blank lines, a paragraph a line. A paragraph's node is the SHA-256 of
its text, a section's the SHA-256 of its paragraphs' nodes, and the root that of the sections'
nodes, so texts are equal exactly when their roots are, and unequal branches say where they differ
(``differing``). Paragraphs are cut further into leaves of ``LEAF`` code points; the share of equal
leaves is the likeness of two trees.

Defined results: a null text is the empty text; two empty texts have likeness 1, an empty and
another one 0. Rows that repeat a doc_id and text are one document; rows that share only the doc_id
are ordered by text hash; a null doc_id comes first. A single document is its own next one. An
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 16


def paragraph_nodes(text: Column) -> Column:
    """array<array<string>>: the nodes of each section's paragraphs."""
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.sha2(p, 256)))


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, lambda ps: F.sha2(F.array_join(ps, ""), 256))


def root(text: Column) -> Column:
    return F.sha2(F.array_join(section_nodes(paragraph_nodes(text)), ""), 256)


def leaves(text: Column) -> Column:
    """Distinct 64-bit hashes of the leaves: up to LEAF code points of one paragraph each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"[^\n]{{1,{LEAF}}}\n?|\n"), F.lit(0)), lambda x: F.xxhash64(x)))


def likeness(a: Column, b: Column) -> Column:
    """Equal leaves over those of the larger tree."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def differing(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>> (from 0): branches of two trees (``paragraph_nodes``) that differ.

    Sections of equal node are passed over without a look at their paragraphs.
    """
    def paragraphs(pair, i):
        left, right = pair["a"], pair["b"]
        nodes = F.arrays_zip(F.coalesce(left, F.array().cast("array<string>")).alias("l"), F.coalesce(right, F.array().cast("array<string>")).alias("r"))
        at = F.transform(nodes, lambda n, j: F.when(~n["l"].eqNullSafe(n["r"]), F.struct(i.alias("section"), j.alias("paragraph"))))
        return F.when(F.array_join(left, "").eqNullSafe(F.array_join(right, "")), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(F.array_compact(at))

    return F.flatten(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), paragraphs))


def previous(docs: DataFrame) -> DataFrame:
    """doc_id, hash, prev_id, prev_hash, prev_chars: who comes before in ascending (doc_id, hash); the first follows the last.

    Ids alone are range-partitioned; neighbours are found within a partition, and over its edge
    from a table of one row a partition.
    """
    ids = written(docs.select("doc_id", "hash", "n_chars").distinct()
                  .repartitionByRange("doc_id", "hash").withColumn("part", F.spark_partition_id()), "ids")
    row = F.struct("doc_id", "hash", "n_chars")
    tails = ids.groupBy("part").agg(F.max(row).alias("tail"))
    over = Window.orderBy("part")
    edge = tails.select("part", F.coalesce(F.lag("tail").over(over), F.last("tail").over(
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("edge"))
    inner = F.lag(row).over(Window.partitionBy("part").orderBy("doc_id", "hash"))
    found = ids.withColumn("prev", inner).join(F.broadcast(edge), "part").withColumn("prev", F.coalesce("prev", "edge"))
    return found.select("doc_id", "hash", F.col("prev.doc_id").alias("prev_id"), F.col("prev.hash").alias("prev_hash"),
                        F.col("prev.n_chars").alias("prev_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The texts are shuffled once, by key; each document then sends its predecessor its leaves and
    the few first characters that the edit takes.
    """
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("hash"), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
    if docs.count() != docs.select("doc_id", "hash").distinct().count():
        docs = docs.dropDuplicates(["doc_id", "hash"])
    p = previous(docs)
    docs = docs.drop("n_chars")         # both joins then read the same shuffled texts
    sent = docs.alias("d").join(p.alias("p").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.hash") == F.col("p.hash"))).select(
        F.col("prev_id").alias("doc_id"), F.col("prev_hash").alias("hash"),
        F.substring("text", F.lit(1), F.floor(F.col("prev_chars") / 4).cast("int")).alias("head"), leaves(F.col("text")).alias("next_leaves"))
    both = docs.alias("d").join(sent.alias("s").hint("merge"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.hash") == F.col("s.hash")))
    both = both.select("d.doc_id", "text", F.length("text").cast("long").alias("n_chars"), "head", "next_leaves")
    cut = F.floor(F.col("n_chars") / 4)
    both = both.select("doc_id", "text", "n_chars", "next_leaves", leaves(F.col("text")).alias("leaves"),
                       F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), "head").alias("edited"))
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), root(F.col("text")).alias("fingerprint"),
        root(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("leaves"), leaves(F.col("edited"))).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"))


def _root_sql(text: str) -> str:
    paragraphs = "list_transform(string_split(s, chr(10)), lambda p: sha256(p))"
    return f"sha256(array_to_string(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: sha256(array_to_string({paragraphs}, ''))), ''))"


def _near_sql(a: str, b: str) -> str:
    return f"CASE WHEN greatest(len({a}), len({b})) = 0 THEN 1 ELSE len(list_intersect({a}, {b})) / greatest(len({a}), len({b})) END"


FINGERPRINT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT doc_id, t, n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nt FROM d),
x AS (SELECT doc_id, t, n, nt, substring(t, 1, n - n // 4) || substring(nt, 1, n // 4) AS ed FROM e),
l AS (SELECT *, list_distinct(regexp_extract_all(t, '[^\\n]{{1,{LEAF}}}\\n?|\\n')) AS lt,
      list_distinct(regexp_extract_all(nt, '[^\\n]{{1,{LEAF}}}\\n?|\\n')) AS ln, list_distinct(regexp_extract_all(ed, '[^\\n]{{1,{LEAF}}}\\n?|\\n')) AS le FROM x)
SELECT doc_id, n AS n_chars, sha256(ed) AS edited_sha256, {_root_sql('t')} AS fingerprint, {_root_sql('ed')} AS edited_fingerprint,
       {_near_sql('lt', 'le')} AS near_edited, {_near_sql('lt', 'ln')} AS near_next FROM l
"""
