"""Operator 12, phrase collocation mining by external stream estimation.

Phrases are counted order by order, each count a sum over the whole corpus of counts that tasks have
merged beforehand. A phrase that reaches ``least`` has only parts that reach it, so a task leaves out
what is ruled out before: it holds a filter of fixed size (``FILTER_BITS`` slots) on the frequent words,
then one on word pairs, whose occurrences (of frequent words) were summed up by slot. A filter may let
rare phrases pass, which the exact count then drops; it never loses a frequent one, and when a very
large corpus fills it, it only spares less.

The frequent phrases of all orders form the count stream. It is kept twice, dealt by range and sorted:
in prefix order (words from the first on) and in suffix order (from the last on). Every cut of a
candidate is a row of (first part, rest). The rows are merged in lockstep with the stream in prefix
order for the left counts and with the one in suffix order for the right counts, by sort-merge joins.
The cut before the last word shows the phrase's count beside that of the phrase it extends on the
right, the cut after the first word the same on the left: equal counts mark the shorter phrase. A phrase
that lies in a longer candidate of the same count lies in one longer by one word, of the same count, too.

Scores are exact: products are decimals of 38 digits.

Defined results: a null text is empty; a null lang is ``und``; rows that repeat a document count each;
an empty table, or one without frequent phrases, gives no rows; further columns are not read. Texts of
any length are read whole; a task holds the distinct words of ``CHUNK`` words of text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST = 100
LONGEST = 5
TOP = 2000
#: Slots of the filters on words and pairs; a bitmap of them goes to the tasks.
FILTER_BITS = 1 << 25
#: Slots are dealt in blocks: a task sums up the slots of its blocks.
BLOCK = 1 << 13
#: Words that a task counts at once before it hands counts on.
CHUNK = 1_500_000

#: Bytes of a text: A-Z lower-cased, what ends a piece as a line feed, a tab as a space.
_BYTES = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, n long"


def _slots(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Filter slots of word hashes, or of pairs of them."""
    mixed = first if second is None else (first * _MIX) ^ (second + (first >> np.uint64(29)))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return (mixed >> np.uint64(20)) & np.uint64(FILTER_BITS - 1)


def _hashes(lang: str, words) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _held(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Counter:
    """Counts of the phrases of one language in some chunk of text."""

    def __init__(self, lang: str):
        self.lang, self.ids, self.tokens = lang, {}, []
        self.size = 0

    def add(self, text: str) -> None:
        ids = self.ids
        for piece in text.encode("utf-8", "surrogatepass").translate(_BYTES).split(b"\n"):
            words = piece.split()
            if words:
                for w in words:
                    if w not in ids:
                        ids[w] = len(ids)
                self.tokens.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                self.tokens.append(_END)
                self.size += len(words)

    def pair_slots(self, bitmap: np.ndarray) -> np.ndarray:
        """Slot of each pair of words that pass the filter."""
        ids, hashes = np.concatenate([*self.tokens, _END]), _hashes(self.lang, self.ids)
        frequent = np.append(_held(bitmap, _slots(hashes)), False)          # the last one is for the end of a piece
        at = np.flatnonzero(frequent[ids[:-1]] & frequent[ids[1:]])
        return _slots(hashes[ids[at]], hashes[ids[at + 1]])

    def rows(self, orders: tuple[int, ...], bitmap: np.ndarray | None):
        """Record batches of (lang, phrase, n)."""
        ids, vocabulary = np.concatenate([*self.tokens, _END]), list(self.ids)
        self.ids, self.tokens = {}, []
        if orders == (1,):
            count = np.bincount(ids[ids >= 0], minlength=len(vocabulary))
            yield from self._batches([pa.array(vocabulary, pa.binary())], count)
            return
        words = pa.array(vocabulary, pa.binary())
        hashes = _hashes(self.lang, vocabulary)
        pair = (ids[:-1] >= 0) & (ids[1:] >= 0)
        at = np.flatnonzero(pair)
        pair[at] = _held(bitmap, _slots(hashes[ids[at]], hashes[ids[at + 1]]))
        at = np.flatnonzero(pair)                                           # starts of chains of two words
        rank = np.full(len(ids), -1, np.int32)
        rank[at] = ids[at]
        for order in range(2, max(orders) + 1):
            if order > 2:
                at = at[pair[np.minimum(at + order - 2, len(pair) - 1)] & (at + order - 2 < len(pair))]
            if not len(at):
                return
            _, starts, rank_at, count = np.unique((rank[at].astype(np.int64) << 32) | ids[at + order - 1], return_index=True, return_inverse=True, return_counts=True)
            rank[at] = rank_at
            if order in orders:
                places = at[starts]
                yield from self._batches([words.take(pa.array(ids[places + k])) for k in range(order)], count)

    def _batches(self, columns: list[pa.Array], count: np.ndarray):
        for i in range(0, len(count), 100_000):
            parts = [c.slice(i, 100_000) for c in columns]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if len(parts) > 1 else parts[0]
            n = pa.array(count[i:i + 100_000].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([self.lang] * len(n), pa.string()), phrase.cast(pa.string()), n], ["lang", "phrase", "n"])


_END = np.array([-1], np.int32)


def _chunks(batches, chunk: int):
    """The counters of every chunk of text."""
    held: dict[str, _Counter] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            one = held.get(lang) or held.setdefault(lang, _Counter(lang))
            size -= one.size
            one.add(text)
            size += one.size
            if size >= chunk:
                yield from held.values()
                held, size = {}, 0
    yield from held.values()


def _count(docs: DataFrame, orders: tuple[int, ...], bitmap: np.ndarray | None, chunk: int) -> DataFrame:
    """lang, phrase, n of the phrases of some orders whose pairs pass the filter."""
    def tasks(batches):
        for counter in _chunks(batches, chunk):
            yield from counter.rows(orders, bitmap)

    return docs.mapInArrow(tasks, COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _word_filter(words: DataFrame) -> np.ndarray:
    """Bitmap of the words' slots."""
    def slots(batches):
        for batch in batches:
            for lang, group in batch.to_pandas().groupby("lang"):
                yield pa.RecordBatch.from_arrays([pa.array(_slots(_hashes(lang, [w.encode() for w in group["phrase"]])).astype(np.int64))], ["slot"])

    size = F.lit(8 * 4096)
    rows = (words.select("lang", "phrase").mapInArrow(slots, "slot long").groupBy(F.floor(F.col("slot") / size).alias("block"))
            .agg(F.bitmap_construct_agg(F.pmod("slot", size)).alias("bits")))
    return _bitmap(rows, 4096)


def _pair_filter(docs: DataFrame, bitmap: np.ndarray, least: int, chunk: int) -> np.ndarray:
    """Bitmap of the slots whose pairs of filtered words occur ``least`` times in all."""
    kind = np.min_scalar_type(least)

    def sums(batches):
        for counter in _chunks(batches, chunk):
            slots, count = np.unique(counter.pair_slots(bitmap), return_counts=True)
            if not len(slots):
                continue
            low, count = (slots % BLOCK).astype(np.uint16), np.minimum(count, least).astype(kind)      # a count that reaches ``least`` says enough
            blocks, first = np.unique(slots // BLOCK, return_index=True)
            ends = [*first[1:], len(slots)]
            yield pa.RecordBatch.from_arrays([
                pa.array(blocks.astype(np.int64)), pa.array([low[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()),
                pa.array([count[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], ["block", "slots", "counts"])

    def totals(batches):
        held: dict[int, np.ndarray] = {}        # as many as FILTER_BITS / BLOCK blocks over the number of tasks
        for batch in batches:
            for block, slots, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = held.setdefault(block, np.zeros(BLOCK, np.int64))
                total[np.frombuffer(slots, np.uint16)] += np.frombuffer(counts, kind)
        bits = [np.packbits(t >= least, bitorder="little").tobytes() for t in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(bits, pa.binary())], ["block", "bits"])

    parts = docs.mapInArrow(sums, "block long, slots binary, counts binary")
    return _bitmap(parts.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(totals, "block long, bits binary"), BLOCK // 8)


def _bitmap(rows: DataFrame, size: int) -> np.ndarray:
    """The filter from its blocks of ``size`` bytes; their number is fixed."""
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows.collect():
        bitmap[r["block"] * size:(r["block"] + 1) * size] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return bitmap


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, total words), (lang, phrase, n) of all phrases of up to ``longest`` words that occur ``least`` times."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.length("text") > 0)
    words = written(_count(texts, (1,), None, chunk), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = words.filter(F.col("n") >= least)
    if longest < 2:
        return totals, frequent
    pairs = _pair_filter(texts, _word_filter(frequent), least, chunk)
    phrases = _count(texts, tuple(range(2, longest + 1)), pairs, chunk).filter(F.col("n") >= least)
    return totals, frequent.unionByName(written(phrases, "phrases"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    totals, counts = phrase_counts(docs, least, longest, chunk)
    stream = counts.select("lang", F.split("phrase", " ").alias("words"), "n")
    prefix = written(stream.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"), "prefix-order")
    suffix = written(stream.select("lang", F.reverse("words").alias("words"), "n")
                     .repartitionByRange("lang", "words").sortWithinPartitions("lang", "words"), "suffix-order")
    size = F.size("words")
    cuts = prefix.filter(size > 1).select("lang", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cuts = cuts.select("lang", "words", "a", "cut", F.slice("words", F.lit(1), F.col("cut")).alias("first"), F.reverse(F.slice("words", F.col("cut") + 1, size)).alias("rest"))
    left = prefix.select("lang", F.col("words").alias("first"), F.col("n").alias("l"))
    right = suffix.select("lang", F.col("words").alias("rest"), F.col("n").alias("r"))
    merged = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    merged = written(merged, "cuts")
    ends = merged.filter("a = l AND cut = size(words) - 1 AND cut > 1").select("lang", F.col("first").alias("words"))
    begins = merged.filter("a = r AND cut = 1 AND size(words) > 2").select("lang", F.reverse("rest").alias("words"))
    inside = ends.unionByName(begins).distinct()
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(1000 * cast(a AS {wide}) AS decimal(38,0)) * cast(total AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))")
    scored = merged.join(F.broadcast(totals) if totals.limit(10_001).count() <= 10_000 else totals, "lang").withColumn("score", score)
    lowest = scored.groupBy("lang", "words").agg(F.min(F.struct("score", "cut", "a", "l", "r", "total")).alias("m"))
    kept = lowest.join(inside.hint("merge"), ["lang", "words"], "left_anti").select("lang", F.array_join("words", " ").alias("phrase"), "m.*")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within parts of a language, so that no task ranks a whole one
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))


def collocations_sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same result from all phrases of all pieces (DuckDB)."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({text}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS k FROM p),
z AS (SELECT lang, list_slice(ws, k, k + size - 1) AS ph FROM s, (SELECT unnest(range(1, {longest} + 1)) AS size) WHERE k + size - 1 <= len(ws)),
f AS (SELECT lang, ph, count(*) AS a FROM z GROUP BY ALL HAVING count(*) >= {least}),
t AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
c AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS cut FROM f WHERE len(ph) > 1),
q AS (SELECT c.lang, c.ph, c.a, cut, x.a AS l, y.a AS r, n, (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.ph = list_slice(c.ph, 1, cut) JOIN f y ON y.lang = c.lang AND y.ph = list_slice(c.ph, cut + 1, len(c.ph))
      JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, cut) = 1),
o AS (SELECT DISTINCT i.lang, list_slice(i.ph, k, k + size - 1) AS ph, i.a FROM
      (SELECT lang, ph, a, unnest(range(1, len(ph) + 1)) AS k FROM f WHERE len(ph) > 2) i, (SELECT unnest(range(2, {longest})) AS size)
      WHERE size < len(i.ph) AND k + size - 1 <= len(i.ph)),
w AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score FROM b
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.ph = b.ph AND o.a >= b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM w QUALIFY rank <= {top}
"""
