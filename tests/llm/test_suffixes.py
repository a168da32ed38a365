"""Repeat removal against a count of every window."""

import random
from collections import Counter

from spark_netwatch.llm.suffixes import remove_repeats

SCHEMA = "doc_id long, text string, kept string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(gone[i] and (not i or not gone[i - 1]) for i in range(len(d)))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def check(spark, texts, length, gram):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length, gram).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_borders_periods_and_small_parts(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [word(rng.randint(15, 60)) for _ in range(12)]
    texts = [None, "", "a", "ab" * 60, "ab" * 45 + "c" + "ab" * 20, "x" * 19, "x" * 20]
    for _ in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 5):] if rng.random() < 0.5 else word(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    want = check(spark, texts, 20, 6)
    assert sum(w[1] for w in want) > 500 and any(0 < w[1] < w[0] for w in want)


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(5000))
    import spark_netwatch.llm.suffixes as module
    monkeypatch.setattr(module, "PART", 700)
    check(spark, [long, "z" + long[650:760] + "y", long[2000:2500], "nothing"], 40, 8)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(6)
    own, other, shared = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, own, "x")] * 3 + [(None, other, "x")] * 2 + [(2, shared + other[:150], "x")] * 2 + [(3, "z" + shared, "x")]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = {1: own, None: other, 2: other[:150], 3: "z"}
    assert all(bytes(r.kept).decode() == want[r.doc_id] for r in got)


def brute_first(texts, length):
    data, first, out = [(t or "").encode() for t in texts], {}, []
    for d, text in enumerate(data):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            at, start = first.setdefault(text[i:i + length], (d, i))
            if (at, start) != (d, i):
                low = max(i, start + length) if at == d else i
                gone[low:i + length] = b"\1" * (i + length - low)
        kept, at = "", 0
        for c in text.decode():
            size = len(c.encode())
            kept += "" if all(gone[at:at + size]) else c
            at += size
        out.append(kept)
    return out


def test_first_occurrences_stay(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    shared = [word(rng.randint(15, 60)) for _ in range(12)]
    texts = [None, "", "a", "ab" * 60, "ab" * 45 + "c" + "ab" * 20, "x" * 19, "x" * 20, "éã" * 20, "èã" * 20]
    for _ in range(60):
        parts = [rng.choice(shared)[rng.randint(0, 5):] if rng.random() < 0.6 else word(rng.randint(5, 40)) for _ in range(rng.randint(1, 6))]
        texts.append("".join(parts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r.kept for r in remove_repeats(docs, 20, 6, as_text=True, keep_first=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute_first(texts, 20)
    assert got[3] == "ab" * 10 and any(0 < len(got[i]) < len(t or "") for i, t in enumerate(texts))
