"""Operator 3, language identification: Bayesian fusion of evidence about a web page.

The log posterior of a language adds
- the likelihood of the page's visible text under byte-trigram models, fitted on at most
  ``TRAIN_DOCS`` labelled documents (by hash order) and tempered to ``TEXT_WEIGHT`` trigrams, since
  neighbouring trigrams are not independent;
- the probability of the declared markup language given the language, from counts over all pages;
- the prior of the page's host, smoothed towards that of its domain, which is smoothed towards that
  of its address suffix, and that towards all pages. The counts are grouped aggregates over all
  pages (by the text's best language); a page's own count is taken out of its own prior.

Defined results: null html or url are empty; a page without visible text, declaration and host
gets the corpus's prior; without labelled documents ``lang`` is null and ``confidence`` 0; equal
posteriors go to the language that sorts first; repeated rows get the same result each; an empty
table gives no rows; further columns are not read. Pages are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_by_weight, written
from .tokens import slices

TRAIN_DOCS = 4000
TEXT_WEIGHT = 60.0
#: Pages that a level's prior counts for in the level below.
SMOOTHING = 5.0
CELL_BITS = 15
SLICE = 4 << 20

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def visible_text(html: Column) -> Column:
    """Text between the tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(bare, r"(?s)<[^>]*>|&[#\w]{1,10};|\s+", " "))


def declared_language(html: Column) -> Column:
    """Primary subtag of the html element's lang attribute, else empty."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _cells(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash cell and text number of each byte trigram."""
    data = pc.fill_null(texts, "").cast(pa.large_string()).cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    flat = _FOLD[np.frombuffer(data.buffers()[2], np.uint8)[ends[0]:ends[-1]]] if ends[-1] > ends[0] else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    if len(flat) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cell = (flat[:-2] * 7919 + flat[1:-1] * 104729 + flat[2:] * 1299709) >> 3 & ((1 << CELL_BITS) - 1)
    inside = row[:-2] == row[2:]
    return cell[inside], row[:-2][inside]


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, and the log probability of each trigram cell in each."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = labelled.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cell, row = _cells(part.column("text"))
                names = np.array(part.column("lang").to_pylist(), object)
                for name in set(names):
                    total[name] = total.get(name, 0) + np.bincount(cell[(names == name)[row]], minlength=1 << CELL_BITS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], ["lang", "cell", "n"])

    sample = labelled.join(F.broadcast(chosen), "doc_id").select("lang", "text")
    rows = sample.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows.column("lang").to_pylist()))
    counts = np.full((len(names), 1 << CELL_BITS), 0.5)
    if names:
        at = np.searchsorted(np.array(names), np.array(rows.column("lang").to_pylist()))
        counts[at, rows.column("cell").to_numpy()] += rows.column("n").to_numpy()
    return names, np.log(counts / counts.sum(1, keepdims=True)) if names else counts


def _text_scores(pages: DataFrame, table: np.ndarray) -> DataFrame:
    """page_id, host, declared, and ``text_score``: tempered log likelihood by language."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                cell, row = _cells(part.column("text"))
                n = np.bincount(row, minlength=part.num_rows)
                weight = np.minimum(1, TEXT_WEIGHT / np.maximum(n, 1))
                scores = np.stack([np.bincount(row, t[cell], part.num_rows) * weight for t in table], 1)
                scores -= scores.max(1, keepdims=True)
                ends = pa.array(np.arange(part.num_rows + 1) * len(table), pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("page_id", "host", "declared")],
                                                  pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], ["page_id", "host", "declared", "text_score"])

    return pages.mapInArrow(run, f"page_id {dict(pages.dtypes)['page_id']}, host string, declared string, text_score array<double>")


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host."""
    names, table = train(docs.select("doc_id", "lang", "text"))
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    read = pages.select("page_id", host(url).alias("host"), declared_language(html).alias("declared"), visible_text(html).alias("text"))
    if not names:
        none = F.lit(None).cast("string")
        return read.select("page_id", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"), "declared", "host")
    scored = _text_scores(read, table)
    best = F.array_position("text_score", F.array_max("text_score")).cast("int") - 1
    said = F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col("declared")),
                      F.when(F.col("declared") == "", len(names) + 1).otherwise(len(names)))
    labels = F.split("host", r"\.")
    rows = written(scored.withColumns({"best": best, "said": said, "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
                                       "suffix": F.element_at(labels, -1)}), "pages")

    # counts of the text's best language by declaration (a table of languages squared), suffix, domain and host
    k = len(names)
    said_counts = np.full((k, k + 2), 0.5)
    for r in rows.groupBy("best", "said").count().collect():
        said_counts[r["best"], r["said"]] += r["count"]
    said_log = np.log(said_counts / said_counts.sum(1, keepdims=True))
    overall = said_counts.sum(1) - 0.5 * (k + 2) + 1
    overall = overall / overall.sum()
    each = [F.sum((F.col("best") == i).cast("long")) for i in range(k)]

    def counted(key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.array(*each).alias(f"{key}_counts"), F.count(F.lit(1)).alias(f"{key}_n"))

    keys = rows.groupBy("host", "domain", "suffix").agg(F.array(*each).alias("host_counts"), F.count(F.lit(1)).alias("host_n"))
    hosts = written(keys.join(counted("domain"), "domain").join(counted("suffix"), "suffix").drop("domain", "suffix"), "hosts")
    placed = join_by_weight(rows, hosts, "host", "host_n", rows.count())

    prior = [F.lit(float(p)) for p in overall]
    for level in ("suffix", "domain", "host"):
        own = lambda i: F.col(f"{level}_counts")[i] - (F.col("best") == i).cast("int")  # noqa: B023, E731
        prior = [(own(i) + SMOOTHING * prior[i]) / (F.col(f"{level}_n") - 1 + SMOOTHING) for i in range(k)]
        placed = placed.withColumn(f"{level}_prior", F.array(*prior))
        prior = [F.col(f"{level}_prior")[i] for i in range(k)]
    heard = [F.array(*[F.lit(float(x)) for x in said_log[i]])[F.col("said")] for i in range(k)]
    total = F.array(*[F.col("text_score")[i] + heard[i] + F.log(prior[i]) for i in range(k)])
    fused = placed.withColumn("total", total).withColumn("most", F.array_max("total"))
    name = F.array(*map(F.lit, names))
    weight = F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
    return fused.select("page_id", F.get(name, F.array_position("total", F.col("most")).cast("int") - 1).alias("lang"), (1 / weight).alias("confidence"),
                        F.get(name, F.col("best")).alias("text_lang"), "declared", "host")
