"""Operator 2, packing: concatenate and cut.

Pass one tokenises every document once, appends the end id and writes the ids with the document's
place in its partition. A prefix sum over the partitions' token totals (one row a partition) gives
each document its global offset. Pass two cuts the one long stream into fixed windows; a document
that reaches over a window's end leaves a boundary record (a piece) in each window. Nothing is
shuffled but the partition totals, and only the last sequence needs padding.

Defined results: a null text is the empty text, which packs as the end id alone; repeated rows are
packed each; an empty table gives no pieces; further columns are not read. A text may be longer
than any number of sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import Ids, slices

LENGTH = 2048
END_ID = 1
_READY: dict[str, Ids] = {}


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (little-endian uint16 bytes), doc_tokens, part, part_start (ids before it in the partition)."""

    def run(batches):
        if tokenizer not in _READY:
            _READY[tokenizer] = Ids(tokenizer)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                flat, n = _READY[tokenizer].encode(rows.column("text"))
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)
                ends = np.concatenate([[0], ends + np.arange(1, len(n) + 1)])
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(2 * ends), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), ids.cast(pa.binary()), pa.array(n + 1), pa.array(np.full(len(n), part)), pa.array(at + ends[:-1])],
                    ["doc_id", "ids", "doc_tokens", "part", "part_start"])
                at += int(ends[-1])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, doc_tokens long, part long, part_start long")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for."""
    rows = written(tokenised(docs, tokenizer, end_id), "tokens")
    # one row a partition of the scan: the broadcast side does not grow with the rows in them
    totals = rows.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = rows.join(F.broadcast(before), "part").select(
        "doc_id", "ids", "doc_tokens", (F.col("before") + F.col("part_start")).alias("at"))

    def cut(batches):
        for batch in batches:
            cols = {k: [] for k in ("row", "start", "length", "crc", "total", "seq", "offset", "ids")}
            for i, (ids, n, at) in enumerate(zip(batch.column("ids"), batch.column("doc_tokens").to_pylist(), batch.column("at").to_pylist())):
                flat = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < n:
                    seq, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    piece = flat[start:start + size]
                    for k, v in zip(cols, (i, start, size, zlib.crc32(piece), n, seq, offset, piece.view("<i4") if with_ids else None)):
                        cols[k].append(v)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            arrays = [batch.column("doc_id").take(pa.array(cols["row"], pa.int32()))] + [
                pa.array(cols[k], pa.int64()) for k in ("start", "length", "crc", "total", "seq", "offset")]
            if with_ids:
                names, arrays = [*names, "ids"], [*arrays, pa.array(cols["ids"], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = dict(docs.dtypes)["doc_id"]
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
                             + (", ids array<int>" if with_ids else ""))


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """The packed sequences: sequence_id, ids, n_tokens. A group holds at most ``length`` ids.

    A short sequence is padded to ``length`` unless its own length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    full = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(length))
    return whole.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad_id), full - n)).alias("ids"), n.alias("n_tokens"))
