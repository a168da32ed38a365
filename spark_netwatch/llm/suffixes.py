"""Operator 9, suffix-array dedup by bucket-pointer refinement.

A suffix's bucket at depth 2k is named by its bucket at depth k and that of the suffix k bytes on,
so refined identifiers are reused at every depth (``_refined``). Sorting all suffixes of a corpus
is not needed to find repeats of ``length`` bytes: of each window of that length only the suffix
that starts at its least q-gram is kept (equal windows keep the same one). These suffixes are
bucketed by q-gram; buckets of one suffix go. The rest are refined by the identifiers of their
whole context (all windows they stand for), which settles every context that occurs again. Unequal
contexts of one bucket are refined by the half that any common window must share, and only where
such a half repeats, eighths and then single windows are compared. Identifiers are 64 bits and compared within
equal q-gram identifiers of 64 bits more.

All sorting and grouping is done by Spark on identifiers; texts are read by key for the windows of
the few unsettled contexts and for the final cut. Cells with many rows are counted before they are
shuffled and joined apart.

Defined results: a null text is the empty text; rows that repeat a doc_id and text are one document
(a repeat in another row of it does not count) and are cut alike; texts shorter than ``length``
keep all bytes; an empty table gives no rows; further columns pass through. Texts of any length
are taken in overlapping parts, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import dropped, join_by_weight, written
from .shingles import mix
from .tokens import slices

LENGTH = 200
GRAM = 32
#: Parts of a context's windows that are told apart by the bytes they share before single windows are.
EIGHTHS = 8
#: Bytes of text worked on at once; longer texts are taken in parts.
PART = 2 << 20

_RANDOM = np.random.default_rng(9)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64)
_LEFT, _RIGHT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a ^ (a >> np.uint64(32))) * _LEFT + (b ^ (b >> np.uint64(29))) * _RIGHT


def _refined(data: np.ndarray, depths: list[int]) -> dict[int, np.ndarray]:
    """Identifiers of the suffixes' first ``depth`` bytes, for each depth wanted (any, from doubled ones)."""
    depth, ids, found = 1, _BYTE[data], {}
    wanted = sorted(depths)
    while wanted:
        while wanted and wanted[0] <= 2 * depth:
            k = wanted.pop(0)                       # two buckets that overlap name any depth in between
            found[k] = ids if k == depth else _paired(ids[:len(ids) - (k - depth)], ids[k - depth:])
        if wanted:
            ids, depth = _paired(ids[:len(ids) - depth], ids[depth:]), 2 * depth
    return found


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.append(values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _halves(length: int, gram: int) -> tuple[int, int]:
    """Where windows are told apart by their suffix's place (first half, rest), and the bytes each half shares."""
    middle = (length - gram + 1) // 2
    return middle, min(length - middle + 1, middle + gram)


def kept_suffixes(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """The suffixes that stand for windows of the texts in ``data`` (each ends at ``ends``).

    first, last: the windows' starts; at: the suffix; bucket, context, halves: identifiers.
    """
    empty = {k: np.zeros(0, np.int64) for k in ("first", "last", "at", "bucket", "context", "halves")}
    begins = np.concatenate([[0], ends[:-1]])
    if not len(ends) or (ends - begins).max() < length:
        return empty
    middle, half = _halves(length, gram)
    ids = _refined(data, [gram, half, length])
    place_bits = np.uint64(int(len(data)).bit_length())
    order = (mix(ids[gram]) >> place_bits << place_bits) | np.arange(len(ids[gram]), dtype=np.uint64)
    least = _least(order, length - gram + 1) & ((np.uint64(1) << place_bits) - np.uint64(1))
    counts = np.maximum(ends - begins - length + 1, 0)
    total = np.cumsum(counts)
    starts = np.arange(total[-1]) + np.repeat(begins - (total - counts), counts)
    at = least[starts].astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    i = np.flatnonzero(new)
    first, last, at = starts[i], starts[np.append(i[1:], len(starts)) - 1], at[i]
    shape = ((at - first) * 1024 + (last - first)).astype(np.uint64)
    context = mix(_paired(_paired(ids[length][first], ids[length][last]), mix(shape + np.uint64(1))))
    top = np.uint64((1 << 32) - 1) << np.uint64(32)
    pad = np.append(ids[half], np.zeros(max(len(data), 1), np.uint64))
    ahead = np.where(at - last < middle, mix(pad[at]) & top, np.uint64(0))
    behind = np.where(at - first >= middle, mix(pad[np.maximum(at - middle, 0)]) >> np.uint64(32), np.uint64(0))
    return {"first": first, "last": last, "at": at, "bucket": mix(ids[gram][at]).view(np.int64), "context": context.view(np.int64), "halves": (ahead | behind).view(np.int64)}


def _parts(column: pa.Array, length: int):
    """(row numbers, offsets in their texts, joined bytes, ends) of about PART bytes each."""
    rows, offsets, pieces, held = [], [], [], 0

    def joined():
        return np.array(rows), np.array(offsets), np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])

    for i, value in enumerate(column):
        text = value.as_buffer()
        for start in range(0, max(len(text) - length + 1, 0), PART):
            piece = text[start:start + PART + length - 1]
            rows.append(i), offsets.append(start), pieces.append(piece)
            held += len(piece)
            if held >= PART:
                yield joined()
                rows, offsets, pieces, held = [], [], [], 0
    if rows:
        yield joined()


def _suffix_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row a context of a document: bucket, context, halves, shape, starts (of each occurrence)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "data", PART):
                for row, offset, data, ends in _parts(part.column("data"), length):
                    s = kept_suffixes(data, ends, length, gram)
                    if not len(s["at"]):
                        continue
                    piece = np.searchsorted(ends, s["first"], side="right")
                    low = s["first"] - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
                    shape = (s["at"] - s["first"]) * 1024 + (s["last"] - s["first"])
                    order = np.lexsort((low, s["context"], s["bucket"], row[piece]))
                    keys = [k[order] for k in (row[piece], s["bucket"], s["context"])]
                    new = np.ones(len(order), bool)
                    new[1:] = np.any([k[1:] != k[:-1] for k in keys], 0)
                    one = order[new]
                    starts = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32()), pa.array(low[order]))
                    owner = pa.array(row[piece][one])
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_doc").take(owner), part.column("_hash").take(owner), *[pa.array(s[k][one]) for k in ("bucket", "context", "halves")],
                         pa.array(shape[one]), starts], ["_doc", "_hash", "bucket", "context", "halves", "shape", "starts"])

    return docs.mapInArrow(run, f"_doc {dict(docs.dtypes)['_doc']}, _hash long, bucket long, context long, halves long, shape long, starts array<long>")


def _window_rows(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """bucket, core, _doc, _hash, start, open, windows: the windows of the wanted half contexts.

    A row has the windows (identifiers, from ``start`` on) whose suffix stands in one eighth of the
    places; ``core`` names the bytes that all of them share.
    """
    middle, _ = _halves(length, gram)
    step = max(1, (length - gram + 1) // EIGHTHS)
    core = length - step + 1
    lists = wanted.groupBy("_doc", "_hash").agg(F.collect_list(F.struct("bucket", "start", "shape", "ahead", "open")).alias("asked"))
    both = docs.alias("d").join(lists.alias("w"), F.col("d._doc").eqNullSafe(F.col("w._doc")) & (F.col("d._hash") == F.col("w._hash"))).select(
        "d._doc", "d._hash", "d.data", "w.asked")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "data", PART):
                asked = part.column("asked")
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(asked).to_numpy())
                flat = asked.flatten()
                start, shape = (flat.field(k).to_numpy() for k in ("start", "shape"))
                ahead, opened = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("ahead", "open"))
                reach, place = shape % 1024, shape // 1024
                low = np.where(ahead, np.maximum(place - middle + 1, 0), 0)         # windows first..last of this half
                high = np.where(ahead, reach, np.minimum(reach, place - middle))
                texts = [v.as_buffer() for v in part.column("data")]
                data = np.frombuffer(b"".join(texts[o][int(s + a):int(s + b) + length] for o, s, a, b in zip(owner, start, low, high)), np.uint8)
                count = high - low + 1
                size = count + length - 1
                begin = np.cumsum(size) - size
                total = np.cumsum(count)
                within = np.arange(total[-1]) - np.repeat(total - count, count)
                each = np.repeat(np.arange(len(count)), count)
                spot = begin[each] + within
                far = place[each] - low[each] - within              # from a window's start to its suffix
                part_no = far // step
                new = np.ones(len(each), bool)
                new[1:] = (each[1:] != each[:-1]) | (part_no[1:] != part_no[:-1])
                ids = _refined(data, [core, length])
                one = np.flatnonzero(new)
                cores = mix(ids[core][spot[one] + far[one] - part_no[one] * step] + part_no[one].astype(np.uint64))
                windows = pa.ListArray.from_arrays(pa.array(np.append(one, len(each)), pa.int32()), pa.array(mix(ids[length])[spot].view(np.int64)))
                head = each[one]
                back = pa.array(owner[head])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(flat.field("bucket").to_numpy()[head]), pa.array(cores.view(np.int64)), part.column("_doc").take(back), part.column("_hash").take(back),
                     pa.array(start[head] + low[head] + within[one]), pa.array(opened[head]), windows],
                    ["bucket", "core", "_doc", "_hash", "start", "open", "windows"])

    return both.mapInArrow(run, f"bucket long, core long, _doc {dict(docs.dtypes)['_doc']}, _hash long, start long, open boolean, windows array<long>")


def _after(spans: DataFrame, one: str, length: int) -> DataFrame:
    """Spans but for the first occurrence itself (``one``: _doc, _hash, start) and what lies in its window."""
    same = F.col("_doc").eqNullSafe(F.col(f"{one}._doc")) & (F.col("_hash") == F.col(f"{one}._hash"))
    spans = spans.filter(~(same & (F.col("first") == F.col(f"{one}.start"))))
    return spans.withColumn("first", F.when(same, F.greatest("first", F.col(f"{one}.start") + length)).otherwise(F.col("first"))).filter("first < last")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """_doc, _hash, first, last: spans of repeated bytes (they may overlap); ``docs``: _doc, _hash, data.

    With ``keep_first`` the least (_doc, _hash, start) of equal windows is no repeat, nor are the
    bytes of another one that lie in it; contexts that occur again are then compared by window too.
    """
    found = written(_suffix_rows(docs, length, gram), "suffixes")
    n = F.size("starts").cast("long")
    sizes = found.groupBy("bucket").agg(F.sum(n).alias("n")).filter("n > 1")
    shared = written(join_by_weight(found, sizes, "bucket", "n", found.count()).drop("n"), "shared")
    dropped(found)
    place = F.struct("_doc", "_hash", F.col("starts")[0].alias("start"), "shape", "halves")
    contexts = written(shared.groupBy("bucket", "context").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("rows"), F.min(place).alias("one")), "contexts")
    first = ["one"] if keep_first else []
    settled = join_by_weight(shared.select("bucket", "context", "_doc", "_hash", "starts", "shape"),
                             contexts.filter("n > 1").select("bucket", "context", "rows", *first), ["bucket", "context"], "rows", shared.count())
    spans = settled.select("_doc", "_hash", F.explode("starts").alias("first"), "shape", *first).select(
        "_doc", "_hash", "first", (F.col("first") + F.col("shape") % 1024 + length).alias("last"), *first)
    if keep_first:
        spans = _after(spans, "one", length)
    spans = written(spans.select("_doc", "_hash", "first", "last"), "spans")
    undecided = "n > 1" if keep_first else "n > 1 AND any_open"
    # unsettled contexts: halves that occur in two contexts of a bucket, one of them unsettled
    low = F.lit((1 << 32) - 1)
    half = F.explode(F.array(F.struct(F.lit(True).alias("ahead"), F.shiftrightunsigned("one.halves", 32).alias("half")),
                             F.struct(F.lit(False).alias("ahead"), F.col("one.halves").bitwiseAND(low).alias("half"))))
    halves = written(contexts.select("bucket", "one", (F.col("n") == 1).alias("open"), half.alias("h"))
                     .select("bucket", "one", "open", "h.*").filter("half != 0"), "halves")
    keys = ["bucket", "ahead", "half"]
    twice = halves.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open")).filter(undecided)
    wanted = join_by_weight(halves, twice, keys, "n", halves.count()).select("bucket", "one._doc", "one._hash", "one.start", "one.shape", "ahead", "open")
    parts = written(_window_rows(docs, written(wanted, "wanted"), length, gram), "window-parts")
    keys = ["bucket", "core"]
    twice = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open")).filter(undecided)
    windows = join_by_weight(parts, twice, keys, "n", parts.count()).select(
        "bucket", "_doc", "_hash", "open", "start", F.posexplode("windows").alias("place", "window"))
    windows = written(windows.select("bucket", "_doc", "_hash", "open", (F.col("start") + F.col("place")).alias("start"), "window"), "windows")
    dropped(shared, contexts, halves, parts)
    least = [F.min(F.struct("_doc", "_hash", "start")).alias("one")] if keep_first else []
    again = windows.groupBy("bucket", "window").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("any_open"), *least).filter(undecided)
    hits = join_by_weight(windows if keep_first else windows.filter("open"), again, ["bucket", "window"], "n", windows.count())
    late = hits.select("_doc", "_hash", F.col("start").alias("first"), (F.col("start") + length).alias("last"), *first)
    if keep_first:
        late = _after(late, "one", length)
    late = written(late.select("_doc", "_hash", "first", "last"), "late-spans")
    dropped(windows)
    return spans.unionByName(late)


def _one_row_a_key(keyed: DataFrame) -> DataFrame:
    """``keyed`` with one row of each _doc and _hash; only texts of repeated rows are shuffled."""
    twice = keyed.groupBy("_doc", "_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    twice = written(twice.select(F.col("_doc").alias("_twice_doc"), F.col("_hash").alias("_twice_hash")), "repeated-rows")
    same = keyed._doc.eqNullSafe(twice._twice_doc) & (keyed._hash == twice._twice_hash)
    return keyed.join(twice, same, "left_anti").unionByName(keyed.join(twice, same, "left_semi").dropDuplicates(["_doc", "_hash"]))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False, keep_first: bool = False) -> DataFrame:
    """``docs`` with ``kept``, ``n_bytes``, ``n_removed``, ``n_spans``; such columns are replaced.

    ``kept`` has the bytes that stay, or as text those characters of which all bytes stay. With
    ``keep_first`` the first occurrence of each window stays, by (doc_id, text hash, start), unless
    a window that overlaps it stands earlier still: so every byte that is cut has an equal one that
    stays. A character is then cut only when all its bytes are.
    """
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_hash"), F.encode(text, "utf-8").alias("data"))
    spans = repeated_spans(_one_row_a_key(keyed), length, gram, keep_first).groupBy("_doc", "_hash").agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    spans = spans.withColumnsRenamed({"_doc": "_span_doc", "_hash": "_span_hash"})
    rows = docs.withColumn("_hash", F.xxhash64(text))
    rows = rows.join(spans, rows.doc_id.eqNullSafe(spans._span_doc) & (rows._hash == spans._span_hash), "left").drop("_span_doc", "_span_hash", "_hash")
    names = docs.columns

    def run(batches):
        for batch in batches:
            kept, counts = [], []
            for value, spans in zip(pc.cast(batch.column("text"), pa.binary()), batch.column("_spans")):
                data = np.frombuffer(value.as_buffer(), np.uint8) if value.is_valid else np.zeros(0, np.uint8)
                if spans.is_valid:
                    first, last = (spans.values.field(k).to_numpy() for k in ("first", "last"))
                    depth = np.bincount(first, minlength=len(data) + 1) - np.bincount(last, minlength=len(data) + 1)
                    gone = np.cumsum(depth)[:-1] > 0
                    if keep_first:
                        lead = (data & 0xC0) != 0x80
                        gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
                    edges = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept.append(data[~gone].tobytes())
                    counts.append((len(data), int(gone.sum()), edges))
                else:
                    kept.append(data.tobytes())
                    counts.append((len(data), 0, 0))
            counts = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()), *[pa.array(counts[:, k]) for k in range(3)]],
                                             [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    schema = StructType([*docs.schema.fields, StructField("kept", StringType() if as_text else BinaryType()), *[StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])
    return rows.mapInArrow(run, schema)
