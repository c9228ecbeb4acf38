"""Sums that regressions are solved from."""

import numpy as np

from siftwright.operators.regression import _moments, _square


def test_moments_are_weighted_products_per_replicate():
    rng = np.random.default_rng(1)
    z, w = rng.normal(size=(50, 4)), rng.poisson(1.0, (50, 3)).astype(float)
    found = _moments(z, w)
    assert found.shape == (10, 3)
    for r in range(3):
        np.testing.assert_allclose(_square(found[:, r], 4), z.T @ np.diag(w[:, r]) @ z, rtol=1e-12)


def test_moments_of_no_rows_are_zero():
    assert not _moments(np.zeros((0, 3)), np.zeros((0, 2))).any()
