"""Sampling, language, quality: exact distributions and held-out accuracy."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from helpers import SF
from pyspark.sql import functions as F

from spark_netwatch.llm import language, lattice, quality, queries

MODEL = queries.tokenizer_file("piece_bpe_32k.model")


def _segmentations(pieces, text):
    """Every path with its log probability, by recursion."""
    data, out = (" " + text).encode(), []
    known = {t: i for i, t in enumerate(pieces.text) if t and not (len(t) == 1 and pieces.byte_id[t[0]] == i)}

    def go(at, ids, weight):
        if at == len(data):
            out.append((tuple(ids), weight))
            return
        size = 1
        while at + size < len(data) and data[at + size] & 0xC0 == 0x80:
            size += 1
        for end in range(at + 1, len(data) + 1):
            if data[at:end] in known:
                go(end, [*ids, known[data[at:end]]], weight + pieces.weight[known[data[at:end]]])
        if data[at:at + size] not in known:
            go(at + size, [*ids, *(int(pieces.byte_id[b]) for b in data[at:at + size])], weight + pieces.byte_weight * size)

    go(0, [], 0.0)
    total = np.logaddexp.reduce([w for _, w in out])
    return {ids: w - total for ids, w in out}


def test_samples_are_distinct_and_have_the_exact_distribution():
    pieces, n = lattice.Pieces(MODEL, 1.0), 20000
    for text in ("of", "a b", "thé\nx"):
        chance = _segmentations(pieces, text)
        seen = [[] for _ in range(n)]
        for _, rows, ids, per, log_p, gumbel, inclusion, _ in lattice.sample(pieces, pa.array([text] * n), np.random.default_rng(1).integers(-2**62, 2**62, n), 3):
            ends = np.cumsum(per)
            for r, a, b, p, g, q in zip(rows, ends - per, ends, log_p, gumbel, inclusion):
                seen[r].append((tuple(ids[a:b].tolist()), g))
                assert abs(chance[seen[r][-1][0]] - p) < 1e-9 and q <= 0
        for s in seen:
            assert len({x for x, _ in s}) == len(s) == min(3, len(chance)) and sorted(s, key=lambda x: -x[1]) == s
        pairs = Counter((s[0][0], s[1][0]) for s in seen)
        for a, pa_ in chance.items():
            for b, pb in chance.items():
                if a != b:
                    want = math.exp(pa_) * math.exp(pb) / (1 - math.exp(pa_))
                    assert abs(pairs[a, b] / n - want) < 0.015


def test_short_texts_give_all_segmentations_at_the_production_temperature():
    pieces, k = lattice.Pieces(MODEL, lattice.TEMPERATURE), 200
    texts = ["a", "I", "of", "the", "a b"]
    seen = [{} for _ in texts]
    for _, rows, ids, per, log_p, *_ in lattice.sample(pieces, pa.array(texts), np.arange(len(texts)), k):
        ends = np.cumsum(per)
        for r, a, b, p in zip(rows, ends - per, ends, log_p):
            seen[r][tuple(ids[a:b].tolist())] = p
    for text, got in zip(texts, seen):
        chance = _segmentations(pieces, text)
        assert 1 < len(chance) < k and set(got) == set(chance)
        assert all(abs(got[s] - p) < 1e-6 for s, p in chance.items())


def test_encoding_round_trips_and_repeats_itself(spark):
    texts = [None, "", " two  spaces ", "línea uno\nline two\ttab", "中文 ﬁ €", "x" * 3000, "a\x00b"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    one = lattice.encode(docs, MODEL, k=3).orderBy("doc_id", "sample").collect()
    assert all(r.round_trip for r in one)
    other = lattice.encode(docs.repartition(5), MODEL, k=3).orderBy("doc_id", "sample").collect()
    assert one == other
    assert [(r.n_pieces, r.log_inclusion) for r in one if r.doc_id < 2] == [(0, 0.0), (0, 0.0)]
    back = lattice.decode(spark.createDataFrame(one), MODEL).collect()
    assert all(r.text == (texts[r.doc_id] or "") for r in back)
    assert lattice.encode(docs.filter("doc_id < 0"), MODEL).count() == 0


def test_language_agrees_with_the_path_and_evidence_counts(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(pages, docs).join(pages, "page_id").withColumn("path", F.regexp_extract("url", "//[^/]+/(..)/", 1))
    assert got.filter("path != ''").agg(F.avg((F.col("lang") == F.col("path")).cast("int"))).first()[0] > 0.97
    odd = spark.createDataFrame([(1, None, None, "z"), (2, "http://h.example.de/x", "<html lang='de'></html>", "z"), (3, "not a url", "<p>the and of with for that</p>", "z")],
                                "page_id long, url string, html string, lang string")
    found = {r.page_id: r for r in language.identify(odd, docs).collect()}
    assert found[2].lang == "de" and found[2].declared == "de" and found[2].host == "h.example.de" and 0 < found[1].confidence <= 1
    assert language.identify(odd.limit(0), docs).count() == 0
    assert language.identify(odd, docs.limit(0)).filter("lang IS NULL AND confidence = 0").count() == 3


def test_quality_on_held_out_documents(spark):
    rows = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.97


def test_quality_cases(spark):
    docs = spark.createDataFrame([(i, "plain words in a line\nand another line here", "a") for i in range(40)] + [(100 + i, "spam spam spam spam " * 9, "a") for i in range(40)]
                                 + [(900, None, "a"), (901, "", "a"), (902, "\n\n", "a"), (903, "z" * 100000, "a")], "doc_id long, text string, quality_score string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(5000, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert got[900] == got[901] == got[902] == 0 and min(got[i] for i in range(40)) > 0.5 > max(got[100 + i] for i in range(40))
    assert quality.train(docs, labels.filter("quality = 1")) == {"constant": 1.0}
    assert quality.score(docs.limit(0), model).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    emit, move = rng.normal(size=9), rng.normal(size=(2, 2))
    sizes = np.array([4, 1, 3, 1])
    good, both, log_z = quality._walk(emit, sizes, move)
    want, total, at = [], 0.0, 0
    for n in sizes:
        paths = [[p >> i & 1 for i in range(n)] for p in range(2**n)]
        weight = np.array([math.exp(sum(emit[at + i] * y for i, y in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        want += [sum(w for w, p in zip(weight, paths) if p[i]) / weight.sum() for i in range(n)]
        total += math.log(weight.sum())
        at += n
    assert np.allclose(good, want) and math.isclose(log_z, total)
