"""Operator 13, benchmark decontamination: a distributed positional inverted index.

``build_index`` stores one posting per word of every training text: (doc, pos, term), dealt by
document into bucketed segments, each in the order of the terms' hashes, so that a term's postings lie
together in a segment, by document and place. Texts are shuffled once, postings never: what is looked up later meets the segments where
they are.

``phrase_matches`` takes a phrase's terms from the rarest one (fewest postings) on. The postings of
the rarest term, moved back by its offset in the phrase, are the candidate starts; the list of the
next term, moved by its own offset, is intersected with them, then those of all other terms.
``proximity_matches`` does the same with ranges of positions: all words of a phrase, in any order,
within ``span`` consecutive words.

Defined results: a null text has no words; a document without words is one posting without term, so
that it is still counted; rows that repeat a document are documents of their own; a null item id is
the empty string, items of one id are one item; empty tables give no matches; further columns are not
read. Texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, _file_system, shared_folder, written
from .licenses import words

#: Words of a window; an item of fewer words is one window.
WIDTH = 10
#: A table of the test side with at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def build_index(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Store the postings of ``docs`` (doc_id, text): doc, doc_id, n_words, pos, term.

    ``doc`` numbers the rows. The table is bucketed by ``doc``; a term's postings lie together in each bucket.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"llm_postings_{uuid.uuid4().hex}", f"{shared_folder(spark)}/llm-postings-{uuid.uuid4().hex}"
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = numbered.repartition(buckets, "doc").select("doc", "doc_id", words(F.col("text")).alias("words"))
    rows = split.select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("words").alias("pos", "term"))
    # one whole number as the order is sorted by radix, stably; the observed count keeps the writer's own sort, by bucket, from replacing it
    ordered = rows.sortWithinPartitions(F.xxhash64("term")).observe("postings", F.count(F.lit(1)).alias("n"))
    ordered.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, "doc").saveAsTable(name)
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return spark.table(name)


def documents(index: DataFrame) -> DataFrame:
    """doc, doc_id, n_words: one row per indexed document."""
    return index.filter("pos IS NULL OR pos = 0").select("doc", "doc_id", "n_words")


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id (string), words: every window of every item."""
    split = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.coalesce("text", F.lit(""))).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (width - 1), F.lit(1)))
    return (split.filter(F.size("words") > 0).select("item_id", "words", F.explode(starts).alias("start"))
            .select("item_id", F.slice("words", F.col("start"), width).alias("words")))


def _ordered_terms(index: DataFrame, phrases: DataFrame, distinct: bool) -> DataFrame:
    """phrase, n_terms, terms: array of (postings, term, offset), rarest first; phrases with a term that the index lacks go."""
    terms = phrases.select("phrase", F.posexplode("words").alias("offset", "term"))
    if distinct:
        terms = terms.groupBy("phrase", "term").agg(F.min("offset").alias("offset"))
    vocabulary = written(terms.select("term").distinct(), "terms")
    postings = index.join(sized(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    wanted = terms.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_terms"))
    found = terms.join(postings, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("postings", "term", "offset"))).alias("terms"))
    return written(found.join(wanted, "phrase").filter(F.size("terms") == F.col("n_terms")), "phrase-terms")


def _of_candidates(index: DataFrame, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms' postings in documents that have candidates, taken from the buckets where they lie."""
    docs = candidates.select("doc").distinct()
    return (index.select("doc", "pos", "term").join(sized(written(terms.distinct(), "terms")), "term", "left_semi")
            .join(docs.hint("shuffle_hash"), "doc", "left_semi"))


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc, phrase, start, n_terms: every place where the words of a phrase stand consecutively.

    ``phrases`` has phrase (a unique id) and words (a non-empty array).
    """
    ordered = _ordered_terms(index, phrases, distinct=False)
    rarest = ordered.select("phrase", F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset"))
    starts = index.select("doc", "pos", "term").join(sized(rarest), "term")
    found = written(starts.select("doc", "phrase", (F.col("pos") - F.col("offset")).alias("start")).filter("start >= 0"), "starts")
    for first, count in ((2, 1), (3, None)):
        of = ordered.select("phrase", F.slice("terms", first, count if count else F.size("terms")).alias("next"))
        wanted = (found.join(of.filter(F.size("next") > 0), "phrase")
                  .select("doc", "phrase", "start", F.size("next").alias("n_next"), F.explode("next").alias("t"))
                  .select("doc", "phrase", "start", "n_next", F.col("t.term").alias("term"), (F.col("start") + F.col("t.offset")).alias("pos")))
        held = (wanted.join(_of_candidates(index, found, of.select(F.explode("next.term").alias("term"))), ["doc", "pos", "term"]).groupBy("doc", "phrase", "start", "n_next").count()
                .filter(F.col("count") == F.col("n_next")).select("doc", "phrase", "start"))
        short = found.join(of.filter(F.size("next") == 0), "phrase").select("doc", "phrase", "start")
        found = written(held.unionByName(short), "starts")
    return found.join(ordered.select("phrase", "n_terms"), "phrase").select("doc", "phrase", "start", "n_terms")


def proximity_matches(index: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """doc, phrase, first, last: stretches of at most ``span`` words that hold every word of a phrase, in any order.

    One row for each place of the phrase's rarest word that lies in such a stretch: the shortest
    one around it, the first of equal ones. A word that a phrase repeats is needed once.
    """
    ordered = _ordered_terms(index, phrases, distinct=True)
    rarest = ordered.select("phrase", F.col("terms")[0]["term"].alias("term"))
    found = written(index.select("doc", "pos", "term").join(sized(rarest), "term").select("doc", "phrase", F.col("pos").alias("at")), "places")
    cell = (F.col("pos") / span).cast("long")
    cells = F.sequence(F.floor((F.col("at") - (span - 1)) / span), F.floor((F.col("at") + (span - 1)) / span))
    near = F.abs(F.col("pos") - F.col("at")) < span
    for first, count in ((2, 1), (2, None)):
        of = ordered.select("phrase", "n_terms", F.slice("terms", first, count if count else F.size("terms")).alias("next"))
        wanted = (found.join(of, "phrase").select("doc", "phrase", "at", F.size("next").alias("n_next"), F.explode(F.transform("next", lambda t: t["term"])).alias("term"), cells.alias("cells"))
                  .select("doc", "phrase", "at", "n_next", "term", F.explode("cells").alias("cell")))
        held = (wanted.join(_of_candidates(index, found, of.select(F.explode("next.term").alias("term"))).withColumn("cell", cell), ["doc", "cell", "term"]).filter(near)
                .groupBy("doc", "phrase", "at", "n_next").agg(F.collect_set("term").alias("terms"), F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("places"))
                .filter(F.size("terms") == F.col("n_next")).select("doc", "phrase", "at", "places"))
        none = F.array().cast("array<struct<pos:int,term:string>>")
        single = found.join(ordered.filter("n_terms = 1"), "phrase").select("doc", "phrase", "at", none.alias("places"))
        found = written(held.unionByName(single), "places")
    # a place's list is bounded: at most 2 * span - 1 positions lie that near
    all_places = F.array_sort(F.concat("places", F.array(F.struct(F.col("at").cast("int").alias("pos"), F.lit("").alias("term")))))
    lists = found.join(ordered.select("phrase", "n_terms"), "phrase").select("doc", "phrase", "at", "n_terms", all_places.alias("places"))

    def stretch(s):
        inside = F.filter("places", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + span))
        terms = F.array_distinct(F.transform(inside, lambda x: x["term"]))
        ends = F.transform(terms, lambda t: F.array_min(F.transform(F.filter(inside, lambda x: x["term"] == t), lambda x: x["pos"])))
        return F.when((s["pos"] <= F.col("at")) & (F.size(terms) == F.col("n_terms")),
                      F.struct((F.array_max(ends) - s["pos"]).alias("length"), s["pos"].alias("first"), F.array_max(ends).alias("last")))

    best = lists.select("doc", "phrase", F.array_min(F.transform("places", stretch)).alias("best"))
    return best.filter("best IS NOT NULL").select("doc", "phrase", F.col("best.first").alias("first"), F.col("best.last").alias("last")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids) of every document.

    A document word is hit when it lies inside any occurrence of a window of ``width`` item words.
    """
    index = build_index(docs)
    windows = written(item_windows(items, width), "windows")
    phrases = written(windows.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    matches = written(phrase_matches(index, phrases), "matches")
    places = matches.select("doc", F.explode(F.sequence("start", F.col("start") + F.col("n_terms").cast("int") - 1)).alias("pos"))
    hits = places.distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    members = windows.join(phrases, "words").select("phrase", "item_id").distinct()
    held = matches.select("doc", "phrase").distinct().join(members, "phrase").select("doc", "item_id").distinct()
    found = hits.join(held.groupBy("doc").agg(F.array_sort(F.collect_list("item_id")).alias("items")), "doc")
    none = F.array().cast("array<string>")
    return documents(index).join(found, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce(F.size("items").cast("long"), F.lit(0)).alias("n_items"),
        F.coalesce("items", none).alias("items"))


def decontaminate_sql(width: int = WIDTH) -> str:
    """The digest of ``decontaminate`` from all word sequences of the lengths that windows have (DuckDB)."""
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{word}') AS ws"
    return f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {split} FROM benchmark),
s AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - {width} + 1, 1) + 1)) AS k FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, array_to_string(list_slice(ws, k, k + {width} - 1), ' ') AS win, least(len(ws), {width}) AS size FROM s),
d AS (SELECT row_number() OVER () AS doc, doc_id, {split} FROM documents),
p AS (SELECT doc, ws, unnest(range(1, len(ws) + 1)) AS k FROM d),
m AS (SELECT p.doc, p.k, z.size, array_to_string(list_slice(ws, p.k, p.k + z.size - 1), ' ') AS win
      FROM p, (SELECT DISTINCT size FROM w) z WHERE p.k + z.size - 1 <= len(ws)),
o AS (SELECT DISTINCT m.doc, m.k, m.size, w.item FROM m JOIN w USING (win, size)),
h AS (SELECT doc, count(*) AS n_hit FROM (SELECT DISTINCT doc, unnest(range(k, k + size)) AS pos FROM o) GROUP BY doc),
g AS (SELECT doc, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM o GROUP BY doc)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc) LEFT JOIN g USING (doc)
"""
