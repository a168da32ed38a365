"""Set-similarity join and bucket linking against all pairs."""

import random
from itertools import combinations

import numpy as np
from helpers import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spark_netwatch.llm.components import components
from spark_netwatch.llm.jaccard import Trie, jaccard_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, width):
    import re
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = {i: shingle_set(t, width) for i, t in rows}
    group = {i: i for i in sets}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            group[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}


def test_components_against_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    long = [rng.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "one"), (3, "One"), (4, "one two"), (5, "a b c"), (6, "A\tb\x0bc"), (7, "é b c"), (8, "É b c"), (9, " \n ")]
    for i in range(10, 60):             # chains: each a few words from the one before
        long = list(long)
        for _ in range(rng.randint(0, 2)):
            long[rng.randrange(len(long))] = rng.choice(words)
        rows.append((i, " ".join(long)))
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 50").collect()]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string").repartition(3)
    for width, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, width, percent).collect()}
        assert got == brute(rows, width, percent)


def test_an_empty_table_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard_components(spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (2, "a b c d"), (4, "other")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(2, 2, 2), (4, 1, 4), (4, 2, 2), (4, 2, 2)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=12), st.sets(st.integers(0, 30), min_size=1), st.sampled_from([50, 80, 90, 100]))
def test_trie_finds_all_and_only_similar_sets(sets, probe, percent):
    order = lambda s: np.array(sorted(s), np.uint64)
    found = Trie([order(s) for s in sets]).search(order(probe), percent)
    assert sorted(found) == [i for i, s in enumerate(sets) if 100 * len(s & probe) >= percent * len(s | probe)]


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("id")).first()[0] == 0
