"""Operator 6, quality classifier: a linear-chain conditional random field over a document's lines.

Every line is labelled good or bad from its own features and those of the lines before and after
it; forward-backward marginals, weighted by the lines' lengths, add up to the document's score.
The field is fitted on a bounded sample of labelled documents (``TRAIN_DOCS`` by hash order, the
first ``TRAIN_LINES`` lines of each; both only bound training), a document's label standing for
each of its lines. Scoring reads every line of every text.

Defined results: a null or empty text, or one of line breaks alone, scores 0; labels that are null
or have no document are not used; with labels of one class only, every other text scores that
label's value, and without labels 1. Repeated rows get the same score each. Only doc_id and text
are read from the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tokens import slices

TRAIN_DOCS = 4000
TRAIN_LINES = 100
THRESHOLD = 0.3
SLICE = 4 << 20

_UPPER, _DIGIT, _MARK, _BAR, _SPACE, _STOP = range(6)


def _counters() -> tuple[np.ndarray, np.ndarray]:
    """Two tables by byte; each entry counts three classes in 21-bit fields."""
    kinds = np.full(256, -1)
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _MARK
    kinds[list(b",.")] = _STOP
    kinds[ord("|")] = _BAR
    kinds[list(range(65, 91))] = _UPPER
    kinds[list(range(48, 58))] = _DIGIT
    kinds[[9, 11, 12, 13, 32]] = _SPACE
    tables = np.zeros((2, 256), np.int64)
    for b, k in enumerate(kinds):
        if k >= 0:
            tables[k // 3, b] = 1 << 21 * (k % 3)
    return tables[0], tables[1]


_COUNTERS = _counters()
_PAIR_HASH = np.random.default_rng(6).integers(-(1 << 62), 1 << 62, 1 << 16)
N_OWN = 12


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features by line (own, line before, line after), bytes by line, and lines by text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())).cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    ends = np.flatnonzero(data == 10)                                 # every text ends with one
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    per_doc = np.diff(np.searchsorted(ends, offsets))
    fields = np.stack([(np.add.reduceat(t[data], starts) >> 21 * k) & (2**21 - 1) for t in _COUNTERS for k in range(3)], 1)

    before = np.concatenate([[10], data[:-1]])
    blank = data <= 32
    begins = np.flatnonzero(~blank & (before <= 32))
    words_of = np.searchsorted(ends, begins)                          # the line of each word
    line_words = np.bincount(words_of, minlength=len(ends))
    pairs = np.where(blank, 0, _PAIR_HASH[np.where(before <= 32, 0, before).astype(np.int64) * 256 + data])
    word = np.add.reduceat(pairs, begins) if len(begins) else np.zeros(0, np.int64)
    same = (word[1:] == word[:-1]) & (words_of[1:] == words_of[:-1])
    repeats = np.bincount(words_of[1:][same], minlength=len(ends))
    key = np.sort((words_of << 40) | ((word * np.int64(0x9E3779B97F4A7C1 | 1)) >> 24 & ((1 << 40) - 1)))
    new = np.concatenate([[True], key[1:] != key[:-1]])[:len(key)]
    distinct = np.bincount(key[new] >> 40, minlength=len(ends))
    whole = np.zeros(len(ends), np.int64)
    np.add.at(whole, words_of, word * (begins - starts[words_of] + 1))
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    order = np.lexsort((whole, doc))
    again = np.zeros(len(ends), bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])

    n, w = np.maximum(size, 1), np.maximum(line_words, 1)
    visible = np.maximum(size - fields[:, _SPACE], 1)
    own = np.column_stack([
        fields[:, _UPPER] / visible, fields[:, _DIGIT] / visible, fields[:, _MARK] / visible, fields[:, _BAR] / visible,
        fields[:, _SPACE] / n, fields[:, _STOP] / w, distinct / w, repeats / w, visible / w / 10, np.log1p(line_words) / 5,
        again, (distinct < line_words / 2) & (line_words > 8)]).astype(np.float32)
    own[size == 0] = 0
    first = np.zeros(len(ends), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    last = np.roll(first, -1)
    prior, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    prior[first], after[last] = 0, 0
    return np.concatenate([own, prior, after, np.column_stack([first, last, size == 0])], 1), size, per_doc


def _walk(emit: np.ndarray, per_doc: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, P(state before, state) of each line but first ones, and the log normaliser.

    ``emit``: log weight of good against bad by line; ``move``: 2 x 2 log weights. Documents run
    side by side, longest first, so a step costs the documents that are that long.
    """
    order = np.argsort(-per_doc, kind="stable")
    sizes, begin = per_doc[order], (np.cumsum(per_doc) - per_doc)[order]
    score = np.stack([np.zeros(len(emit)), emit], 1)
    score -= (top := score.max(1, keepdims=True))
    score, step = np.exp(score), np.exp(move)
    forth, back = np.empty_like(score), np.ones_like(score)
    scale = np.ones(len(emit))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")     # documents with more than t lines
    for t in range(longest):
        at = begin[:alive[t]] + t
        now = score[at] * (forth[at - 1] @ step if t else 1)
        scale[at] = total = now.sum(1)
        forth[at] = now / total[:, None]
    for t in range(longest - 2, -1, -1):
        at = begin[:alive[t + 1]] + t
        now = (back[at + 1] * score[at + 1]) @ step.T
        back[at] = now / now.sum(1, keepdims=True)
    good = forth * back
    good /= good.sum(1, keepdims=True)
    inner = np.ones(len(emit), bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    both = forth[at - 1][:, :, None] * step * (score[at] * back[at])[:, None, :]
    both /= both.sum((1, 2), keepdims=True)
    return good[:, 1], both, float(np.log(scale).sum() + top.sum())


def fit(features: np.ndarray, per_doc: np.ndarray, labels: np.ndarray, steps: int = 250, rate: float = 0.1, ridge: float = 2.0) -> dict:
    """Maximum conditional likelihood by full-batch Adam; every line carries its document's label."""
    mean, spread = features.mean(0), features.std(0) + 1e-3
    x = np.concatenate([(features - mean) / spread, np.ones((len(features), 1))], 1)
    y = np.repeat(labels, per_doc).astype(float)
    # a document counts once, however many lines it has
    weight = np.repeat(1 / np.maximum(per_doc, 1), per_doc)
    first = np.zeros(len(y), bool)
    first[np.cumsum(per_doc) - per_doc] = True
    inner = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1].astype(int), y[inner].astype(int)), weight[inner])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, steps + 1):
        good, both, _ = _walk(x @ theta[:-4], per_doc, theta[-4:].reshape(2, 2))
        slope = np.concatenate([x.T @ (weight * (y - good)), (seen - (weight[inner][:, None, None] * both).sum(0)).ravel()])
        slope = (slope - ridge * theta) / len(per_doc)
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return {"mean": mean, "spread": spread, "weights": theta[:-4], "move": theta[-4:].reshape(2, 2)}


def line_marginals(model: dict, features: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    emit = ((features - model["mean"]) / model["spread"]) @ model["weights"][:-1] + model["weights"][-1]
    return _walk(emit, per_doc, model["move"])[0]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_lines: int = TRAIN_LINES) -> dict:
    """Fit on at most ``max_docs`` labelled documents outside the held-out fifth."""
    chosen = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))

    def features(batches):
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                x, _, n = line_features(rows.column("text"))
                ends = np.cumsum(n)
                cut = [x[e - k:e - k + min(k, max_lines)].astype(np.float32).tobytes() for e, k in zip(ends, n)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array(cut, pa.binary())], ["doc_id", "quality", "x"])

    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "text", F.col("quality").cast("int").alias("quality"))
            .mapInArrow(features, f"doc_id {dict(docs.dtypes)['doc_id']}, quality int, x binary")).collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    y = np.array([r["quality"] for r in rows])
    if len(set(y.tolist())) < 2:
        return {"constant": float(y[0]) if len(y) else 1.0}
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, 3 * N_OWN + 3) for r in rows]
    return fit(np.concatenate(x).astype(float), np.array([len(a) for a in x]), y)


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (all columns) with ``quality_score``; a column of that name is replaced."""
    docs = docs.drop("quality_score")
    text_at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for rows in slices(batch, "text", SLICE):
                x, size, n = line_features(rows.column(text_at))
                good = np.full(len(size), model["constant"]) if "constant" in model else line_marginals(model, x, n)
                doc = np.repeat(np.arange(len(n)), n)
                total = np.bincount(doc, size, len(n))
                value = np.where(total > 0, np.bincount(doc, good * size, len(n)) / np.maximum(total, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.clip(value, 0, 1))], [*rows.schema.names, "quality_score"])

    schema = StructType([*docs.schema.fields, StructField("quality_score", DoubleType())])
    return docs.mapInArrow(run, schema)
