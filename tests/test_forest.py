"""The random forest: splits against brute force, the same trees wherever nodes are split, scores in portions."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spark_netwatch.operators import forest, ml


def _rows(n: int, seed: int = 3):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, forest.BINS, (n, 5)).astype(np.uint8)
    y = ((x[:, 0] > 12) ^ (x[:, 1] > 20) ^ (rng.random(n) < 0.1)).astype(np.uint8)
    return x, y, rng.poisson(1, n).astype(np.uint8)


def _gini(counts):
    total = counts.sum()
    return 1 - ((counts / total) ** 2).sum() if total else 0.0


def test_a_split_is_the_best_of_all():
    x, y, count = _rows(60)
    weight = np.array([1.5, 0.75])
    options = forest._options(np.array([1]), 0, 5, 42)
    got = forest._best(forest._histograms(x, y, count, np.zeros(60, int), options, 2), options, weight)
    of = lambda rows: np.array([count[rows & (y == k)].sum() for k in (0, 1)])
    best, everything = {}, np.ones(60, bool)
    for f in options[0]:
        for b in range(forest.BINS):
            low, high = of(x[:, f] <= b), of(x[:, f] > b)
            if low.sum() >= 2 and high.sum() >= 2:
                total = (of(everything) * weight).sum()
                best[f, b] = total * _gini(of(everything) * weight) - sum((s * weight).sum() * _gini(s * weight) for s in (low, high))
    assert got[2][0] == pytest.approx(max(best.values())) == pytest.approx(best[got[0][0], got[1][0]])
    assert got[3][0].tolist() == of(everything).tolist()


def test_cuts_after_a_heavy_value():
    even = forest._strides(np.arange(320.0), np.ones(320))
    assert len(even) == 31 and np.allclose(np.diff(even), 10)
    heavy = forest._strides(np.arange(101.0), np.array([900.0] + [1.0] * 100))       # nine tenths are one value
    assert len(heavy) >= 28 and heavy[0] == 0.5


def test_a_tree_in_slices_is_the_same(monkeypatch):
    x, y, count = _rows(4000)
    grow = lambda: forest._grow(x[count > 0], y[count > 0], count[count > 0], 3, 1, np.ones(2), 20, 42)
    whole = grow()
    feature, cut, left, counts, _ = whole
    assert len(feature) > 500 and (counts[feature < 0].sum(1) >= 2).all()
    inner = np.flatnonzero(feature >= 0)
    assert (counts[inner] == counts[left[inner]] + counts[left[inner] + 1]).all()
    at = forest._route(x, feature, cut, left)
    assert (np.bincount(at * 2 + y, count, 2 * len(feature)).reshape(-1, 2)[feature < 0] == counts[feature < 0]).all()
    monkeypatch.setattr(forest, "HELD_NODES", 7)
    assert all((a == b).all() for a, b in zip(whole, grow()))


def test_large_nodes_give_the_same_forest_and_portions_the_same_scores(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    n = 1500
    frame = pd.DataFrame({c: rng.random(n).round(3) for c in ml.FEATURES})
    frame["Is_Night"] = (frame["Is_Night"] < 0.02).astype(float)        # rare value of a feature with two
    frame["Label"] = ((frame["Rate"] > 0.4) ^ (frame["Duration"] > 0.7) ^ (rng.random(n) < 0.05)).astype(int)
    df = spark.createDataFrame(frame).repartition(3).localCheckpoint()
    plain = ml.train_forest(df, num_trees=12, max_depth=9)
    assert 0.5 in plain.cuts[ml.FEATURES.index("Is_Night")]
    shown = lambda m: sorted(tuple(r) for r in m.trees.collect())
    monkeypatch.setattr(forest, "LOCAL_ROWS", 90)
    monkeypatch.setattr(forest, "PASS_NODES", 50)
    passes = ml.train_forest(df, num_trees=12, max_depth=9)
    assert shown(plain) == shown(passes) and len(shown(plain)) == 12
    ml.save_versioned(passes, str(tmp_path), "v1")
    kept = forest.ForestModel.load(spark, f"{tmp_path}/v1")
    scored = ml.predict(kept, df).select(*df.columns, "prediction", "threat_prob").toPandas()
    assert (scored["prediction"] == scored["Label"]).mean() > 0.9 and scored["threat_prob"].between(0, 100).all()
    monkeypatch.setattr(forest, "PORTION", 1)                           # a tree at a time
    again = ml.predict(kept, df).select(*df.columns, "threat_prob").toPandas()
    order = ml.FEATURES
    assert np.allclose(scored.sort_values(order)["threat_prob"], again.sort_values(order)["threat_prob"])
    ranked = ml.feature_importance(kept)
    assert {ranked[0][0], ranked[1][0]} == {"Rate", "Duration"} and sum(v for _, v in ranked) == pytest.approx(1.0)


def test_missing_features_and_null_labels(spark):
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("Label"), (F.col("id") % 2 * 5.0).alias("Rate"))
    model = ml.train_forest(rows.withColumn("Duration", F.lit(None).cast("double")), num_trees=5, max_depth=3)
    assert all(r.prediction == r.Label for r in ml.predict(model, rows).collect() if r.threat_prob != 50)
    with pytest.raises(ValueError):
        ml.train_forest(rows.withColumn("Label", F.lit(None).cast("int")))
    with pytest.raises(ValueError):
        ml.train_forest(rows.limit(0))
