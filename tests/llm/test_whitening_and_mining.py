"""Operators 11 to 13 against brute force: whitening, collocations, decontamination."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from helpers import duck, same

from spark_netwatch.llm.collocations import collocations, collocations_sql
from spark_netwatch.llm.postings import build_index, decontaminate, decontaminate_sql, phrase_matches, proximity_matches
from spark_netwatch.llm.queries import op13_decontamination
from spark_netwatch.llm.whitening import eigenvectors, fit, whiten, whole_vectors

DOC = "doc_id long, text string, lang string, term string, pos long"


# ---- 11

@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 1e-3], [1 + 1e-9, 1, 1 - 1e-9, 0.5, 0.5, 0], [1e6, 1e6 - 1e-3, 3, 2, 1, 1e-8],
                                    [1 + 1e-13, 1, 1, 1], list(np.linspace(1, 2, 48)), [2], [0, 0]])
def test_refined_eigenvectors(values):
    q, _ = np.linalg.qr(np.random.default_rng(4).normal(size=(len(values),) * 2))
    a = (q * np.array(values, float)) @ q.T
    a = (a + a.T) / 2
    found, x = eigenvectors(a)
    size = max(np.max(np.abs(a)), 1e-300)
    assert np.max(np.abs(a.astype(np.longdouble) @ x - x * found)) / size < 1e-17
    assert np.max(np.abs(x.T @ x - np.eye(len(values)))) < 1e-16 and np.all(np.diff(found) <= 0)


def embeddings(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(5, 5)) + 3
    rows = [(i, [float(v) for v in rng.normal(size=5) @ mix + 40], "x", i) for i in range(60)]
    rows += [(100 + i, rows[0][1], "x", 0) for i in range(40)]                      # one vector holds many rows
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [1.0, float("nan"), 2.0, 3.0, 4.0]), (203, [1.0, float("inf"), 2.0, 3.0, 4.0])]
    short = [(300, [7.0, -0.0]), (301, []), (None, rows[3][1])]
    return rows + [(i, v, "x", 0) for i, v in bad + short], "vec_id long, embedding array<double>, x string, component int"


def test_whitening_equals_exact_covariance(spark):
    rows, schema = embeddings(spark)
    got = whiten(spark.createDataFrame(rows, schema).repartition(5)).toPandas()
    kept = [(i, [*(v or []), *[0.0] * (5 - len(v or []))]) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(256 * np.array([v for _, v in kept])).astype(int)
    distinct = np.array(sorted(set(map(tuple, x))))
    n, sums = len(distinct), distinct.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    want = (x - sums / n) @ vectors / np.sqrt(values)
    assert len(got) == 4 * len(kept) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    for c in range(4):
        part = got[got.component == c + 1]
        by_id = sorted(zip(part.vec_id.fillna(-1), part.whitened))
        ref = sorted(zip([-1 if i is None else i for i, _ in kept], want[:, c]))
        sign = np.sign(by_id[5][1] * ref[5][1])
        assert np.allclose([w for _, w in by_id], [sign * w for _, w in ref], atol=1e-9)
        assert np.allclose(part.explained, values[c] / np.trace(np.cov(distinct.T, bias=True)))
    exact = {i: sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, sums)) for (i, _), row in zip(kept, x) if i is not None}
    assert all(exact[int(r.vec_id)] == r.deviation for r in got[got.vec_id.notna()].itertuples())


def test_whitening_of_little_and_of_large_numbers(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whiten(frame([])).count() == 0 and whiten(frame([(1, None)])).count() == 0 and whiten(frame([(1, [])])).count() == 0
    one = whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    big = [(i, [1e13 + i * 1e12, float(i % 3)]) for i in range(9)]
    model = fit(whole_vectors(frame(big)))
    x = [(int(v[0]) * 256, int(v[1]) * 256) for _, v in big]
    mean = [Fraction(sum(c), 9) for c in zip(*x)]
    assert model.sums == [sum(c) for c in zip(*x)]
    assert model.values[0] == pytest.approx(float(sum((a - mean[0]) ** 2 for a, _ in x) / 9), rel=1e-9)
    assert max(r.deviation for r in whiten(frame(big)).collect()) == 2 ** 63 - 1


# ---- 12

def brute_collocations(docs, least, longest, top):
    total, count = Counter(), Counter()
    for text, lang in docs:
        lang, text = lang or "und", (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            count.update((lang, tuple(ws[i:i + k])) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    out = []
    frequent = {p: a for p, a in count.items() if a >= least}
    inside = {(lang, p[i:i + k]): max(a, 0) for (lang, p), a in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)}
    for (lang, p), a in frequent.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i:i + k]] = max(inside[lang, p[i:i + k]], a)
    for (lang, p), a in frequent.items():
        if len(p) > 1 and inside.get((lang, p), 0) < a:
            cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.append((lang, " ".join(p), a, count[lang, p[:k]], count[lang, p[k:]], total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        rows = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(rows)]
    return sorted(ranked)


@pytest.mark.parametrize("chunk", [40, 100_000])
def test_collocations_equal_brute_force(spark, chunk):
    rng = random.Random(6)
    words = ["the", "New", "york", "times", "a", "é\xa0b", "ﬁ", "x-y", "the"]
    sep = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", " ! "]
    docs = [("".join(rng.choice(words) + rng.choice(sep) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None])) for _ in range(120)]
    docs += [("new york times is here", "en")] * 30 + [(None, "en"), ("", "fr"), ("...", "fr"), ("a " * 3000, "de")]
    rows = [(i, t, lang, "clash", i) for i, (t, lang) in enumerate(docs)]
    got = collocations(spark.createDataFrame(rows, DOC).repartition(3), least=8, longest=5, top=25, chunk=chunk)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute_collocations(docs, 8, 5, 25)


def test_collocations_of_nothing_and_in_sql(spark):
    assert collocations(spark.createDataFrame([], DOC)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b", "en", "", 0)], DOC)).count() == 0
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert same(collocations(docs, least=10).toPandas(), duck(collocations_sql(least=10)))


# ---- 13

def split(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "a", "b", "c", "Dé", "e1"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([3, 12, 10, 0, 25, 11, 1, 14])]
    items += [(9, "zz zz zz zz zz zz zz zz zz zz zz zz"), (4, items[1][1]), (None, "q r"), (11, None), (12, "unknown words here")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(30)))
        at = items[rng.randrange(len(items))][1] or ""
        docs.append((i, rng.choice([text, f"{text}. {at}-{text}", at.upper()])))
    docs += [(70, None), (71, ""), (71, ""), (72, "ZZ " * 40), (72, "ZZ " * 40), (None, "q, R"), (73, "q")]
    got = decontaminate(spark.createDataFrame([(*d, "en", "clash", 1) for d in docs], DOC).repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    windows = {}
    for item, text in items:
        ws = split(text)
        for k in range(max(len(ws) - 9, 1) if ws else 0):
            windows.setdefault(tuple(ws[k:k + 10]), set()).add("" if item is None else str(item))
    want = []
    for i, text in docs:
        ws, hit, found = split(text), set(), set()
        for w, ids in windows.items():
            for k in range(len(ws) - len(w) + 1):
                if tuple(ws[k:k + len(w)]) == w:
                    hit |= set(range(k, k + len(w)))
                    found |= ids
        want.append((i, len(ws), len(hit), len(found), sorted(found)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())


def test_decontamination_of_nothing_and_in_sql(spark):
    docs, items = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, items).count() == 0
    some = decontaminate(spark.createDataFrame([(1, "a b", "en", "", 0)], DOC), items).collect()
    assert [tuple(r) for r in some] == [(1, 2, 0, 0, [])]
    assert same(op13_decontamination(spark, "/root/testdata/sf0.001").toPandas(), duck(decontaminate_sql()))


def test_phrases_and_proximity(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), "", "", 0) for i in range(12)]
    index = build_index(spark.createDataFrame(docs, DOC))
    phrases = [(0, ["a", "b"]), (1, ["c", "c", "d"]), (2, ["h"]), (3, ["a", "unknown"]), (4, ["e", "f", "g"])]
    table = spark.createDataFrame(phrases, "phrase long, words array<string>")
    ids = {r.doc: r.doc_id for r in index.select("doc", "doc_id").distinct().collect()}
    texts = {i: t.split() for i, t, *_ in docs}
    got = {(ids[r.doc], r.phrase, r.start) for r in phrase_matches(index, table).collect()}
    assert got == {(i, p, k) for i, ws in texts.items() for p, w in phrases for k in range(len(ws)) if ws[k:k + len(w)] == w}
    near = [(ids[r.doc], r.phrase, r.first, r.last) for r in proximity_matches(index, table, 5).collect()]
    assert near and len(set(near)) == len(near)
    for i, p, first, last in near:
        assert last - first < 5 and set(dict(phrases)[p]) <= set(texts[i][first:last + 1])
    # every stretch of five words that holds all words has its rarest word's place covered by a match
    count = Counter(w for ws in texts.values() for w in ws)
    for i, ws in texts.items():
        for p, w in phrases:
            rarest = min(set(w), key=lambda x: (count[x], x))
            places = {k for k, x in enumerate(ws) if x == rarest and any(set(w) <= set(ws[s:s + 5]) for s in range(max(k - 4, 0), k + 1))}
            matched = {k for j, q, a, b in near if (j, q) == (i, p) for k in range(a, b + 1)}
            assert places <= matched
