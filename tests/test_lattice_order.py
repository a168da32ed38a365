"""Operator 1: orders of the lattice without a comparison sort."""

import numpy as np

from spark_netwatch.llm import lattice


def test_order_is_stable_for_numbers_of_any_size():
    rng = np.random.default_rng(2)
    for most in (1, 50, 70_000, 1 << 40):
        x = rng.integers(0, most, 5000)
        x = np.concatenate([x, x[:1000]])
        assert (lattice._order(x) == np.argsort(x, kind="stable")).all()
    assert len(lattice._order(np.zeros(0, np.int64))) == 0


def test_greatest_places_are_distinct_and_the_first_of_equal_ones():
    best = np.random.default_rng(3).integers(0, 4, (200, 7)).astype(float)
    best[best == 0] = -np.inf
    best[0], best[1, 1:] = -np.inf, -np.inf
    for keep in (1, 2, 4, 5):
        assert (lattice._greatest(best, keep) == np.argsort(-best, 1, kind="stable")[:, :keep]).all()
