"""Isolation forest (M4 train, M5 score); Spark ML has none.

Training uses at most ``max_rows`` newest rows (the reference's 10k cap).
Each tree gets its own ``psi``-row sample chosen by a seeded hash rank, and
``groupBy("tree").applyInPandas`` grows one tree per group with numpy, so a
task never holds more than ``psi`` rows. The node table (at most
trees x (2*psi - 1) rows) is the model: it is read once and broadcast.
Scoring is an Arrow pandas UDF walking all trees level by level for a batch.

Decision = score_samples - offset, where score_samples = -2^(-E[h]/c(psi))
and offset = the ``contamination`` quantile of training scores (linear
interpolation), as in the usual formulation; anomaly when decision < 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..session import checkpoint, staged

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.LongType()), T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()),
    T.StructField("size", T.LongType()),
])


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search over n points."""
    n = np.asarray(n, dtype="float64")
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(tree_id: int, X: np.ndarray, seed: int, height_limit: int) -> list[tuple]:
    rng = np.random.default_rng([seed, int(tree_id)])
    nodes: list[list] = []

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([tree_id, me, -1, 0.0, -1, -1, int(len(idx))])
        if depth >= height_limit or len(idx) <= 1:
            return me
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        nodes[me][2], nodes[me][3] = f, thr
        nodes[me][4] = build(idx[go_left], depth + 1)
        nodes[me][5] = build(idx[~go_left], depth + 1)
        return me

    build(np.arange(len(X)), 0)
    return [tuple(n) for n in nodes]


@dataclass
class IsolationModel:
    feature: np.ndarray      # [trees, nodes]
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    psi: int
    offset: float = 0.0
    columns: tuple = tuple(C.MODEL_FEATURES)

    def path_lengths(self, X: np.ndarray) -> np.ndarray:
        n_trees, width = self.feature.shape
        flat = np.ascontiguousarray(X).ravel()
        at = np.arange(len(X)) * X.shape[1]
        own = np.arange(width)
        total = np.zeros(len(X))
        for t in range(n_trees):
            inner = self.feature[t] >= 0
            feature = np.where(inner, self.feature[t], 0)
            # a leaf is its own child, so rows that have come to one stay there while others go on
            child = np.where(inner, [self.left[t], self.right[t]], own).T.ravel()
            depth = np.zeros(width)
            for i in np.flatnonzero(inner):         # a child's number is above its parent's
                depth[[self.left[t, i], self.right[t, i]]] = depth[i] + 1
            length = depth + c_factor(self.size[t])
            node = np.zeros(len(X), dtype=np.int64)
            for _ in range(int(depth.max())):
                node = child[2 * node + ~(flat[at + feature[node]] < self.threshold[t, node])]
            total += length[node]
        return total / n_trees

    def score_samples(self, X: np.ndarray) -> np.ndarray:
        return -np.power(2.0, -self.path_lengths(X) / c_factor([self.psi])[0])


def _features(df: DataFrame, cols) -> list[Column]:
    """M6: model features, missing columns and nulls -> 0."""
    return [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c)
            for c in cols]


def train_isolation(df: DataFrame, order_col: str, n_trees: int = 100, psi: int = 256,
                    contamination: float = 0.05, seed: int = 42, max_rows: int | None = None,
                    cols=tuple(C.MODEL_FEATURES), id_col: str | None = None) -> IsolationModel:
    """M4: fit on all rows of ``df``, or (T7) on the newest ``max_rows``; each tree draws its ``psi`` rows over all of them.

    ``id_col`` tells rows apart; ``order_col`` if not given."""
    id_col = id_col or order_col
    recent = df if max_rows is None else df.orderBy(F.desc(order_col), F.desc(id_col)).limit(max_rows)
    recent = recent.select(F.col(id_col).alias("_rid"), *_features(df, cols))
    recent = checkpoint(recent)
    n = recent.count()
    sample = min(psi, n)
    height = int(np.ceil(np.log2(max(sample, 2))))
    # the rows of least hash, of those under a bound that lets about eight times as many through
    share = min(1.0, 8 * sample / max(n, 1))
    draw = F.pmod(F.xxhash64("_rid", "tree", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    per_tree = recent.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_trees - 1).cast("long"))).alias("tree")).filter(draw)
    w = Window.partitionBy("tree").orderBy(F.xxhash64("_rid", "tree", F.lit(seed)), "_rid")
    picked = per_tree.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= sample).drop("_r", "_rid")
    names = list(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        X = pdf[names].to_numpy(dtype="float64")
        rows = _grow(int(pdf["tree"].iloc[0]), X, seed, height)
        return pd.DataFrame(rows, columns=[f.name for f in NODE_SCHEMA.fields])

    nodes = picked.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).toPandas()   # bounded: trees x (2*psi-1)
    width = int(nodes["node"].max()) + 1
    shape = (n_trees, width)
    arrays = {k: np.full(shape, -1 if k != "threshold" else 0.0, dtype="float64" if k == "threshold" else np.int64)
              for k in ["feature", "threshold", "left", "right", "size"]}
    for k in arrays:
        arrays[k][nodes["tree"].to_numpy(), nodes["node"].to_numpy()] = nodes[k].to_numpy()
    model = IsolationModel(arrays["feature"], arrays["threshold"], arrays["left"], arrays["right"],
                           np.maximum(arrays["size"], 0), sample, 0.0, tuple(names))
    scored = staged(recent.select(_score_udf(df.sparkSession, model)(F.array(*[F.col(c) for c in names])).alias("s")), "scores")
    model.offset = quantile(scored, "s", contamination, n)
    return model


def quantile(df: DataFrame, col: str, share: float, n: int) -> float:
    """The exact ``share`` quantile (linear interpolation) of ``n`` values, from those next to an approximate one.

    ``percentile`` alone keeps every distinct value in one task."""
    at = share * (n - 1)
    low, high = (max(0, int(np.floor(at))), min(n - 1, int(np.ceil(at))))
    slack = 4 / 10_000
    bounds = df.agg(F.percentile_approx(col, [max(0.0, share - slack), min(1.0, share + slack)], F.lit(10_000)).alias("b")).first()["b"]
    near = df.filter(F.col(col).between(*bounds))
    before, met = df.agg(F.count_if(F.col(col) < bounds[0]), F.count_if(F.col(col).between(*bounds))).first()
    if not before <= low <= high < before + met:
        return float(df.agg(F.percentile(col, share)).first()[0])
    # few distinct values next to the quantile, each with its count
    values = near.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    run = values.withColumn("_upto", F.sum("_n").over(Window.orderBy(col)) + before)
    a, b = (run.filter(F.col("_upto") > i).agg(F.min(col)).first()[0] for i in (low, high))
    return float(a if low == high else (high - at) * a + (at - low) * b)


def _score_udf(spark, model: IsolationModel):
    bc = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(bc.value.columns)))
        return pd.Series(bc.value.score_samples(X.astype("float64")))
    return score


def score_isolation(model: IsolationModel, df: DataFrame) -> DataFrame:
    """M5: ``_iso_anom`` / ``_iso_conf`` (plus ``iso_decision``) for every row; features missing -> 0."""
    feats = _features(df, model.columns)
    s = _score_udf(df.sparkSession, model)(F.array(*feats))
    d = s - F.lit(model.offset)
    return (df.withColumn("iso_decision", d)
            .withColumn("_iso_anom", F.col("iso_decision") < 0)
            .withColumn("_iso_conf", F.when(F.col("_iso_anom"), F.round(F.least(F.lit(100.0), F.greatest(
                F.lit(0.0), F.abs(F.col("iso_decision")) * 200 + 50)), 1)).otherwise(F.lit(0.0))))
