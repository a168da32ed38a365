"""Isolation forest: exact offset and path lengths."""

from __future__ import annotations

import numpy as np
import pytest

from spark_netwatch.operators import isoforest


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3, 1.0])
def test_quantile_is_exact(spark, share):
    values = [float(v) for v in np.random.default_rng(1).integers(0, 400, 999) / 7]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    assert isoforest.quantile(df, "s", share, len(values)) == pytest.approx(float(np.quantile(values, share)), abs=1e-12)


def test_path_lengths_walk_each_tree():
    X = np.random.default_rng(2).normal(size=(300, len(isoforest.C.MODEL_FEATURES)))
    X[5, 0] = np.nan
    trees = [isoforest._grow(t, X[:64], 42, 6) for t in range(3)]
    width = max(len(t) for t in trees)
    full = {k: np.full((3, width), -1.0) for k in ("feature", "threshold", "left", "right", "size")}
    for t, nodes in enumerate(trees):
        for n in nodes:
            for k, value in zip(full, n[2:], strict=True):
                full[k][t, n[1]] = value
    ints = {k: a if k == "threshold" else a.astype(np.int64) for k, a in full.items()}
    model = isoforest.IsolationModel(ints["feature"], ints["threshold"], ints["left"], ints["right"], np.maximum(ints["size"], 0), 64)

    def length(nodes, x, at=0, depth=0):
        _, _, f, threshold, left, right, size = nodes[at]
        return depth + isoforest.c_factor([size])[0] if f < 0 else length(nodes, x, left if x[f] < threshold else right, depth + 1)
    want = [sum(length(t, x) for t in trees) / 3 for x in X]
    assert np.allclose(model.path_lengths(X), want, rtol=0, atol=1e-12)
