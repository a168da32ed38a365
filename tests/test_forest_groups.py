"""A tree's nodes that cannot be split cost no histogram, and rows routed in groups of blocks keep their draws."""
import numpy as np
import pyarrow as pa

from spark_netwatch.operators import forest


def test_nodes_of_one_class_or_few_rows_cost_no_histogram(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.integers(0, forest.BINS, (3000, 5)).astype(np.uint8)
    y = ((x[:, 0] > 12) ^ (rng.random(3000) < 0.02)).astype(np.uint8)
    count = np.ones(3000, np.uint8)
    tried, kept = [], forest._histograms

    def histograms(x, y, count, at, options, classes):
        out = kept(x, y, count, at, options, classes)
        tried.append(out[:, 0].sum(1))
        return out

    monkeypatch.setattr(forest, "_histograms", histograms)
    feature, cut, left, counts, gain = forest._grow(x, y, count, 0, 1, np.ones(2), 20, 42)
    tried = np.concatenate(tried)
    assert (tried.sum(1) >= 4).all() and (tried > 0).all()
    assert len(tried) < len(feature) and (feature >= 0).sum() > 50
    assert (counts[feature >= 0].min(1) > 0).all() and (gain[feature >= 0] > 0).all()


def test_groups_of_blocks_keep_rows_and_draws(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [(i << 32, rng.integers(0, 9, (n, 3)).astype(np.uint8), rng.integers(0, 2, n).astype(np.uint8)) for i, n in enumerate((5, 70, 40, 1, 0, 90))]
    batches = [pa.RecordBatch.from_pydict({"block": [b for b, _, _ in part], "x": [x.tobytes() for _, x, _ in part], "y": [y.tobytes() for _, _, y in part]})
               for part in (blocks[:4], blocks[4:])]
    for limit, groups in ((1, 5), (100, 3), (10**6, 1)):
        monkeypatch.setattr(forest, "GROUP_ROWS", limit)
        got = list(forest._groups(batches, 3))
        assert len(got) == groups
        assert (np.concatenate([x for _, x, _ in got]) == np.concatenate([x for _, x, _ in blocks])).all()
        assert (np.concatenate([y for _, _, y in got]) == np.concatenate([y for _, _, y in blocks])).all()
        draws = np.concatenate([forest._group_draws(numbers, 7, 42) for numbers, _, _ in got])
        assert (draws == np.concatenate([forest._draws(b, len(y), 7, 42) for b, _, y in blocks])).all()
