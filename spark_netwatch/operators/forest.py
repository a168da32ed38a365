"""Random forest (M1-M3, M7): bootstrap, Gini gain, 32 bins a feature, a square root of the features a node.

The cost follows the rows, not the nodes times the tasks. Rows are binned once (a byte a feature) and
stored in blocks. A node of more than ``LOCAL_ROWS`` rows is split by histograms that are summed over
the blocks; the rows of each smaller node meet in one group, which grows the rest of that tree, so
that a group is bounded whatever the input's size. A tree's nodes are then put together in one row.

Draws (a row's Poisson count in a tree, the features of a node) are hashes of seed, tree and place, and
class counts are whole numbers, so where a node is split has no influence on the trees. Leaves that are
siblings and predict the same class are merged, as Spark ML does. Scoring broadcasts trees in portions
of at most ``PORTION`` bytes, one after the other.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint, staged

BINS = 32
#: A node of at most so many rows (repeats of the bootstrap counted) is grown in one group.
LOCAL_ROWS = 1_000_000
#: Rows that a task routes or deals out at once.
GROUP_ROWS = 500_000
#: Nodes whose histograms are in memory at once.
HELD_NODES = 4096
#: Nodes split by one pass over all rows.
PASS_NODES = 1024
#: Bytes of trees that are broadcast at once.
PORTION = 64 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PART = "tree int, node long, feature binary, bin binary, left binary, counts binary, gain binary"
_TREE = "tree int, feature binary, bin binary, left binary, value binary, importance array<double>"


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), by hash."""
    x = x * _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _seed(*parts: int) -> np.uint64:
    """One seed of several whole numbers."""
    return np.random.SeedSequence([int(p) for p in parts]).generate_state(1, np.uint64)[0]


def _draws(block: int, n: int, tree: int, seed: int) -> np.ndarray:
    """How often each row of a block stands in a tree's bootstrap: Poisson of mean 1."""
    return np.searchsorted(_POISSON, _uniform(np.arange(n, dtype=np.uint64) + _seed(seed, 1, block, tree))).astype(np.uint8)


def _groups(batches, features: int):
    """Blocks (number, rows), x and y of about GROUP_ROWS rows at a time."""
    held, n = [], 0

    def group():
        y = np.frombuffer(b"".join(h[2] for h in held), np.uint8)
        return [(block, len(ys)) for block, _, ys in held], np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(len(y), features), y

    for batch in batches:
        for block in zip(*(batch.column(c).to_pylist() for c in ("block", "x", "y"))):
            if held and n + len(block[2]) > GROUP_ROWS:
                yield group()
                held, n = [], 0
            held.append(block)
            n += len(block[2])
    if held:
        yield group()


def _group_draws(blocks: list[tuple[int, int]], tree: int, seed: int) -> np.ndarray:
    return np.concatenate([_draws(block, n, tree, seed) for block, n in blocks])


def _options(nodes: np.ndarray, tree: int, features: int, seed: int) -> np.ndarray:
    """The features each node may split by."""
    place = nodes.astype(np.uint64)[:, None] * np.uint64(features) + np.arange(features, dtype=np.uint64)
    return np.argsort(_uniform(place + _seed(seed, 2, tree)), 1)[:, :math.ceil(math.sqrt(features))]


def _histograms(x: np.ndarray, y: np.ndarray, count: np.ndarray, at: np.ndarray, options: np.ndarray, classes: int) -> np.ndarray:
    """[node, option, bin, class]: rows of each node (``at``: a row's node)."""
    nodes, own = options.shape
    out = np.empty((nodes, own, BINS, classes))
    flat, base = x.ravel(), np.arange(len(x)) * x.shape[1]
    place = at * (BINS * classes) + y
    for j in range(own):
        code = flat.take(base + options[:, j].take(at)).astype(np.int64)
        out[:, j] = np.bincount(code * classes + place, count, nodes * BINS * classes).reshape(nodes, BINS, classes)
    return out


def _sum(c: np.ndarray) -> np.ndarray:
    """Over the last axis, the classes: a few long additions in turn, as numpy is slow along a short axis."""
    total = c[..., 0].copy()
    for k in range(1, c.shape[-1]):
        total += c[..., k]
    return total


def _best(hist: np.ndarray, options: np.ndarray, weight: np.ndarray):
    """(feature or -1, bin, gain times weight) of each node, and its class counts."""
    left = np.cumsum(hist, 2)
    total = left[:, :1, -1:]
    right = total - left
    apart = (_sum(left) >= 2) & (_sum(right) >= 2)            # at least two rows on either side

    def purity(c):
        w = c * weight
        s = _sum(w)
        return np.divide(_sum(w * w), s, out=np.zeros_like(s), where=s > 0)

    all_weight = _sum(total * weight)
    gain = np.where(apart, purity(left) + purity(right) - purity(total), -1.0)
    flat = gain.reshape(len(gain), -1)
    pick = flat.argmax(1)
    node = np.arange(len(flat))
    gain = flat[node, pick]
    good = gain > 1e-9 * all_weight[:, 0, 0]
    return np.where(good, options[node, pick // BINS], -1), np.where(good, pick % BINS, 0), np.where(good, gain, 0.0), total[:, 0, 0]


def _kept(on: np.ndarray, *arrays: np.ndarray):
    return arrays if on.all() else tuple(a[on] for a in arrays)


def _grow(x: np.ndarray, y: np.ndarray, count: np.ndarray, tree: int, node: int, weight: np.ndarray, max_depth: int, seed: int):
    """Arrays of the tree below ``node``, level by level: feature (-1: leaf), bin, left child, class counts, gain."""
    classes, depth, count = len(weight), int(node).bit_length() - 1, count.astype(np.float64)
    place, at = np.array([node], np.int64), np.zeros(len(x), np.int64)
    parts, made = [], 1
    while len(place):
        total = np.bincount(at * classes + y, count, len(place) * classes).reshape(-1, classes)
        feature, cut, gain = np.full(len(place), -1), np.zeros(len(place), np.int64), np.zeros(len(place))
        # a node of one class gains nothing, and one of less than four rows has no two on either side
        apart = np.flatnonzero((total.sum(1) >= 4) & ((total > 0).sum(1) > 1)) if depth < max_depth else np.zeros(0, np.int64)
        if len(apart):
            number = np.full(len(place), -1)
            number[apart] = np.arange(len(apart))
            at = number[at]
            x, y, count, at = _kept(at >= 0, x, y, count, at)
            options, found = _options(place[apart], tree, x.shape[1], seed), []
            for a in range(0, len(apart), HELD_NODES):
                of, rows = options[a:a + HELD_NODES], slice(None) if len(apart) <= HELD_NODES else np.flatnonzero((at >= a) & (at < a + HELD_NODES))
                found.append(_best(_histograms(x[rows], y[rows], count[rows], at[rows] - a, of, classes), of, weight)[:3])
            feature[apart], cut[apart], gain[apart] = (np.concatenate(f) for f in zip(*found))
            at = apart[at]
        inner = feature >= 0
        child = np.cumsum(inner) - 1
        parts.append((feature, cut, np.where(inner, made + 2 * child, -1), total, gain))
        made += 2 * int(inner.sum())
        x, y, count, at = _kept(inner[at], x, y, count, at)
        at = 2 * child[at] + (x.ravel().take(np.arange(len(x)) * x.shape[1] + feature[at]) > cut[at])
        place, depth = (2 * place[inner][:, None] + np.arange(2)).ravel(), depth + 1
    return tuple(np.concatenate(p) for p in zip(*parts))


def _route(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    flat, base = x.ravel(), np.arange(len(x)) * x.shape[1]
    at, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(on):
        f = feature[at[on]]
        inner = f >= 0
        on, f = on[inner], f[inner]
        here = at[on]
        at[on] = left[here] + (flat[base[on] + f] > cut[here])
    return at


def _packed(feature, cut, left, counts, gain) -> list[bytes]:
    return [feature.astype(np.int8).tobytes(), cut.astype(np.uint8).tobytes(), left.astype(np.int32).tobytes(),
            counts.astype(np.int64).tobytes(), gain.astype(np.float64).tobytes()]


def _unpacked(row, classes: int):
    return [np.frombuffer(row.feature, np.int8), np.frombuffer(row.bin, np.uint8), np.frombuffer(row.left, np.int32),
            np.frombuffer(row.counts, np.int64).reshape(-1, classes), np.frombuffer(row.gain)]


def _whole(parts: pd.DataFrame, weight: np.ndarray, features: int):
    """One tree of its parts (node 0: what was split by passes; else the part below that node), merged and ready to score."""
    classes = len(weight)
    parts = parts.sort_values("node")
    feature, cut, left, counts, gain = (a.copy() for a in _unpacked(parts.iloc[0], classes))
    pieces, made = [[feature, cut, left, counts, gain]], len(feature)
    for row in parts.iloc[1:].itertuples():
        own = [a.copy() for a in _unpacked(row, classes)]
        at = 0
        for turn in bin(row.node)[3:]:
            at = left[at] + int(turn)
        own[2][own[0] >= 0] += made - 1
        for a, b in zip(pieces[0], own):
            a[at] = b[0]
        pieces.append([a[1:] for a in own])
        made += len(own[0]) - 1
    feature, cut, left, counts, gain = (np.concatenate(p) for p in zip(*pieces))
    says = (counts * weight).argmax(1)
    while True:         # a child's number is above its parent's; merged parents may be merged again
        inner = np.flatnonzero(feature >= 0)
        a, b = left[inner], left[inner] + 1
        same = inner[(feature[a] < 0) & (feature[b] < 0) & (says[a] == says[b])]
        if not len(same):
            break
        feature[same] = -1
    kept, level = [], np.zeros(1, np.int64)     # level by level, whatever parts the tree came in
    while len(level):
        kept.append(level)
        level = (left[level[feature[level] >= 0]][:, None] + np.arange(2)).ravel()
    kept = np.concatenate(kept)
    number = np.zeros(made, np.int32)
    number[kept] = np.arange(len(kept))
    feature, cut, left, counts, gain = feature[kept], cut[kept], left[kept], counts[kept], gain[kept]
    split = feature >= 0
    link = np.where(split, number[np.maximum(left, 0)], np.cumsum(~split) - 1)            # of a leaf: its value
    value = counts[~split] * weight
    value = value / np.maximum(value.sum(1, keepdims=True), 1e-300)
    importance = np.bincount(feature[split], gain[split], features)
    return (feature.tobytes(), cut.tobytes(), link.astype(np.int32).tobytes(), value.tobytes(),
            (importance / importance.sum() if importance.sum() > 0 else importance).tolist())


@dataclass
class ForestModel:
    """``trees`` is a table with one row a tree."""

    trees: DataFrame
    columns: list[str]
    cuts: list[list[float]]
    classes: int
    size: int

    def save(self, path: str) -> None:
        spark = self.trees.sparkSession
        self.trees.write.parquet(f"{path}/trees")
        spark.createDataFrame([(self.columns, self.cuts, self.classes, self.size)], "columns array<string>, cuts array<array<double>>, classes int, size int") \
            .coalesce(1).write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(spark.read.schema(_TREE).parquet(f"{path}/trees"), list(about["columns"]), [list(c) for c in about["cuts"]], about["classes"], about["size"])

    def importances(self) -> list[float]:
        """By feature: mean over trees of the gains' shares, sum 1."""
        one = self.trees.agg(*[F.sum(F.col("importance")[i]) for i in range(len(self.columns))]).first()
        total = sum(one)
        return [x / total if total else 0.0 for x in one]

    def with_votes(self, df: DataFrame, out: str) -> DataFrame:
        """``df`` (features in ``columns``) with each class's probability, the mean over the trees' leaves."""
        sizes = self.trees.select("tree", sum(F.octet_length(c) for c in ("feature", "bin", "left", "value")).alias("n")).orderBy("tree").collect()
        portions, held = [[]], 0
        for tree, n in sizes:                                       # a tree is never cut: 2^21 nodes at most
            if held and held + n > PORTION:
                portions.append([])
                held = 0
            portions[-1].append(tree)
            held += n
        for i, portion in enumerate(portions):
            votes = self._votes(portion)(*[F.col(f"`{c}`") for c in self.columns])
            df = df.withColumn(out, votes if not i else F.zip_with(out, votes, lambda a, b: a + b))
            if i + 1 < len(portions):
                df = checkpoint(df)                                 # one portion is in memory at a time
        return df.withColumn(out, F.transform(out, lambda v: v / F.aggregate(out, F.lit(0.0), lambda a, b: a + b)))

    def _votes(self, portion: list[int]):
        rows = self.trees.filter(F.col("tree").isin(portion)).orderBy("tree").collect()
        held = self.trees.sparkSession.sparkContext.broadcast([(r.feature, r.bin, r.left, r.value) for r in rows])
        cuts, classes = self.cuts, self.classes

        @F.pandas_udf("array<double>")
        def votes(*x: pd.Series) -> pd.Series:
            binned = _binned([c.to_numpy(np.float64) for c in x], cuts)
            total = np.zeros((len(binned), classes))
            for feature, cut, left, value in held.value:
                left = np.frombuffer(left, np.int32)
                leaf = _route(binned, np.frombuffer(feature, np.int8), np.frombuffer(cut, np.uint8), left)
                total += np.frombuffer(value).reshape(-1, classes)[left[leaf]]
            return pd.Series(list(total))
        return votes


def _binned(columns: list[np.ndarray], cuts: list[list[float]]) -> np.ndarray:
    if any(np.isnan(c).any() for c in columns):
        raise ValueError("a feature is not a number")
    return np.column_stack([np.searchsorted(np.array(cut), c) for c, cut in zip(columns, cuts)]).astype(np.uint8).reshape(len(columns[0]), len(columns))


def _cut_points(data: DataFrame, columns: list[str], weight: dict[float, float]) -> list[list[float]]:
    """At most 31 cuts a feature: between all values of a feature with at most 32, else by weight."""
    few = data.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in columns]).first()
    few = [c for c in columns if few[c] <= BINS + 8]
    values = data.agg(F.lit(0), *[F.collect_set(c).alias(c) for c in few]).first()           # about 40 values each
    grid = 1000
    shares = F.array(*[F.lit((i + 0.5) / grid) for i in range(grid)])
    classes = data.groupBy("Label").agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(c, shares, F.lit(10_000)).alias(c) for c in columns]).collect()
    cuts = []
    for c in columns:
        own = np.unique(values[c]) if c in few else np.zeros(0)
        if 0 < len(own) <= BINS:
            cuts.append(((own[1:] + own[:-1]) / 2).tolist())
            continue
        at = np.concatenate([r[c] for r in classes])
        mass = np.repeat([weight[r["Label"]] * r["_n"] for r in classes], grid)
        own, place = np.unique(at, return_inverse=True)
        cuts.append(_strides(own, np.bincount(place, mass)))
    return cuts


def _strides(values: np.ndarray, mass: np.ndarray) -> list[float]:
    """Cuts halfway between values, one a 32nd of the mass; what a heavy value takes up is made good after it."""
    cuts, stride, before = [], mass.sum() / BINS, mass[0]
    for low, high, own in zip(values, values[1:], mass[1:]):
        target = stride * (len(cuts) + 1)
        if abs(before - target) < abs(before + own - target) and len(cuts) < BINS - 1:
            cuts.append(float(low + high) / 2)
        before += own
    return cuts


def train(data: DataFrame, columns: list[str], weights: dict[float, float], num_trees: int = 200, max_depth: int = 20, seed: int = 42) -> ForestModel:
    """Fit on ``data`` (``columns`` without nulls, Label from 0 on); ``weights`` by label."""
    if not weights:
        raise ValueError("no rows to train on")
    spark, features = data.sparkSession, len(columns)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = staged(data.select("Label", *columns).repartition(parts), "forest-rows")
    cuts = _cut_points(data, columns, weights)
    classes = max(2, int(max(weights)) + 1)
    weight = np.array([weights.get(float(k), 0.0) for k in range(classes)])

    def blocks(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            x = _binned([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], cuts)
            y = batch.column("Label").to_numpy(zero_copy_only=False).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "x": [x.tobytes()], "y": [y.tobytes()]})
            number += 1

    rows = staged(data.mapInArrow(blocks, "block long, x binary, y binary"), "forest-blocks")
    total = rows.agg(F.sum(F.octet_length("y"))).first()[0]
    tops = _split_large(rows, num_trees, total, features, weight, max_depth, seed)
    open_trees = {t: (top[:3], top[5]) for t, top in tops.items()}
    held = spark.sparkContext.broadcast(open_trees)

    def deal(batches):
        for numbers, x, y in _groups(batches, features):
            for tree in range(num_trees):
                count = _group_draws(numbers, tree, seed)
                (feature, cut, left), place = held.value[tree]
                at = _route(x, feature, cut, left)
                mine = np.flatnonzero((count > 0) & (place[at] > 0))
                node = at[mine].astype(np.uint16 if len(place) <= 1 << 16 else np.int64)        # short numbers are sorted by radix
                order = np.argsort(node, kind="stable")
                mine, node = mine[order], node[order]
                ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(mine))
                of = [mine[a:b] for a, b in zip(np.append(0, ends), ends) if b > a]
                if of:
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree] * len(of), pa.int32()), "node": pa.array([int(place[at[p[0]]]) for p in of], pa.int64()),
                        "x": [x[p].tobytes() for p in of], "y": [y[p].tobytes() for p in of], "count": [count[p].tobytes() for p in of]})

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node = (int(k) for k in key)
        y, count = (np.frombuffer(b"".join(pdf[c]), np.uint8) for c in ("y", "count"))
        x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(len(y), features)
        return pd.DataFrame([[tree, node, *_packed(*_grow(x, y, count, tree, node, weight, max_depth, seed))]], columns=[f.split()[0] for f in _PART.split(", ")])

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[int(key[0]), *_whole(pdf, weight, features)]], columns=[f.split()[0] for f in _TREE.split(", ")])

    nodes = sum(int((place > 0).sum()) for _, place in open_trees.values())
    dealt = rows.mapInArrow(deal, "tree int, node long, x binary, y binary, count binary").repartition(max(parts, min(nodes, 4 * parts)), "tree", "node")
    grown = dealt.groupBy("tree", "node").applyInPandas(grow, _PART)
    top_rows = [(t, 0, *map(bytearray, _packed(*top[:5]))) for t, top in tops.items()]
    every = grown.unionByName(spark.createDataFrame(top_rows, _PART))
    trees = staged(every.groupBy("tree").applyInPandas(whole, _TREE), "forest-trees")
    return ForestModel(trees, list(columns), cuts, classes, num_trees)


def _split_large(rows: DataFrame, num_trees: int, total: int, features: int, weight: np.ndarray, max_depth: int, seed: int) -> dict:
    """By tree: feature, bin, left, counts, gain, and place (a node left to be grown in a group; 0: it is not) of the nodes split by passes."""
    classes, own = len(weight), math.ceil(math.sqrt(features))
    tops = {t: [[-1], [0], [-1], [np.zeros(classes)], [0.0], [1]] for t in range(num_trees)}
    queue = [(t, 0, 1) for t in range(num_trees)] if total > LOCAL_ROWS else []
    sc = rows.sparkSession.sparkContext
    while queue:
        now, queue = queue[:PASS_NODES], queue[PASS_NODES:]
        by_tree: dict[int, list[tuple[int, int, int]]] = {}
        for i, (t, at, place) in enumerate(now):
            by_tree.setdefault(t, []).append((i, at, place))
        shared = sc.broadcast([(t, [np.array(a) for a in tops[t][:3]], wanted) for t, wanted in by_tree.items()])

        def histograms(batches):
            sums = np.zeros((len(now), own, BINS, classes))
            for numbers, x, y in _groups(batches, features):
                for t, (feature, cut, left), wanted in shared.value:
                    count = _group_draws(numbers, t, seed)
                    number = np.full(len(feature), -1)
                    number[[w[1] for w in wanted]] = np.arange(len(wanted))
                    at = number[_route(x, feature, cut, left)]
                    mine = np.flatnonzero((at >= 0) & (count > 0))
                    options = _options(np.array([w[2] for w in wanted]), t, features, seed)
                    sums[[w[0] for w in wanted]] += _histograms(x[mine], y[mine], count[mine], at[mine], options, classes)
            slot = np.flatnonzero(sums.ravel())
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot), "n": pa.array(sums.ravel()[slot].astype(np.int64))})

        hist = np.zeros(len(now) * own * BINS * classes)
        for slot, n in rows.mapInArrow(histograms, "slot long, n long").groupBy("slot").agg(F.sum("n")).toLocalIterator():
            hist[slot] = n
        hist = hist.reshape(len(now), own, BINS, classes)
        for t, wanted in by_tree.items():
            top, mine = tops[t], [w[0] for w in wanted]
            options = _options(np.array([w[2] for w in wanted]), t, features, seed)
            feature, cut, gain, counts = _best(hist[mine], options, weight)
            for j, (i, at, place) in enumerate(wanted):
                top[3][at], top[5][at] = counts[j], 0
                if feature[j] < 0:
                    continue
                top[0][at], top[1][at], top[2][at], top[4][at] = int(feature[j]), int(cut[j]), len(top[0]), float(gain[j])
                option = int(np.flatnonzero(options[j] == feature[j])[0])
                low = hist[i, option, :int(cut[j]) + 1].sum(0)
                for side, n in ((0, low), (1, counts[j] - low)):
                    deep = int(2 * place).bit_length() - 1 >= max_depth
                    large = n.sum() > LOCAL_ROWS and not deep
                    for k, v in enumerate((-1, 0, -1, n, 0.0, 0 if large or deep else 2 * place + side)):
                        top[k].append(v)
                    if large:
                        queue.append((t, len(top[0]) - 1, 2 * place + side))
        shared.destroy()
    return {t: [np.array(a) for a in top] for t, top in tops.items()}
