"""Operator 5: what the search pairs within a bucket."""

import numpy as np
from pyspark.sql import functions as F

from spark_netwatch.llm import jaccard


def test_texts_that_share_a_passage_only_are_not_paired(spark):
    passage = " ".join(f"common{i}" for i in range(40))
    near = " ".join(f"near{i}" for i in range(80))
    texts = [f"{passage} {' '.join(f'own{d}x{i}' for i in range(20))}" for d in range(60)] + [near, near.replace("near40 ", "other ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jaccard._prefix_rows(docs, np.zeros(1 << jaccard.WEIGHT_BITS, np.uint8), 3, 90)
    members = rows.select("*", F.posexplode("items").alias("at", "bucket")).drop("items")
    row = [F.struct(*[F.col(f"{side}.{c}").alias(c) for c in members.columns]) for side in "xy"]
    pairs = members.alias("x").join(members.alias("y"), F.expr("x.bucket = y.bucket AND x.doc_id < y.doc_id"))
    assert pairs.select("x.doc_id", "y.doc_id").distinct().count() > 100
    assert [tuple(r) for r in pairs.filter(jaccard._possible(90)(*row)).select("x.doc_id", "y.doc_id").distinct().collect()] == [(60, 61)]
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert found == {d: 60 if d == 61 else d for d in range(62)}


def test_parity_differs_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 5, 300, 4000)] + [np.zeros(0, np.uint64)]
    sets += [np.union1d(s[3:], rng.integers(0, 1 << 63, 2, np.uint64)) for s in sets]
    bits = np.array(jaccard._parity(np.concatenate(sets), np.array([len(s) for s in sets])))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert sum(int(x).bit_count() for x in (bits[:, i] ^ bits[:, j]).view(np.uint64)) <= len(np.setxor1d(a, b))
