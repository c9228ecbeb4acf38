"""Cheaper resampling: the same weights and sums."""

import numpy as np

from siftwright.functions import weights as W
from siftwright.operators import bootstrap as B
from siftwright.operators import regression as R


def test_most_draws_need_no_search(monkeypatch):
    """Weights by table equal the search in the distribution, which only draws near a step still need."""
    rng = np.random.default_rng(3)
    base, reps = rng.integers(0, 1 << 60, 3000), np.arange(50)
    with np.errstate(over="ignore"):
        z = base.astype(np.uint64)[:, None] + (reps.astype(np.uint64) + np.uint64(1))[None, :] * np.uint64(W.GOLDEN)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(W.MIX_1)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(W.MIX_2)
        z ^= z >> np.uint64(31)
    want = np.searchsorted(W.POISSON_CDF, (z >> np.uint64(11)).astype(float) * 2.0**-53, side="right")
    searched, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, side="left": searched.append(np.size(v)) or search(a, v, side=side))
    got = W.poisson_weights(base, reps)
    assert got.dtype == np.int32 and np.array_equal(got, want)
    assert sum(searched) < got.size / 50


def test_moments_of_few_columns_in_one_product(monkeypatch):
    rng = np.random.default_rng(4)
    z, w = rng.normal(size=(5000, 6)), rng.poisson(1.0, (5000, 7)).astype(float)
    got = R._moments(z, w)
    monkeypatch.setattr(R, "FEW", 0)
    np.testing.assert_allclose(got, R._moments(z, w), rtol=1e-10, atol=1e-9)


def test_pieces_of_rank_resampling_are_small():
    """A dozen arrays of rows x 200 replicates stay under 250 MB a task."""
    assert 12 * B.RANGE_ROWS * 200 * 8 < 250 << 20
