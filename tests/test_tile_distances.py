"""Distances from products: near and equal rows must not cancel, and odd values stay what differences give."""

import numpy as np

from cytolake.operators import tiles


def test_distances_from_products():
    rng = np.random.default_rng(2)
    a, b = rng.normal(3, 1, (60, 64)), rng.normal(3, 1, (50, 64))
    b[:20] = a[:20]
    b[5:20] += rng.normal(0, 1, (15, 64)) * 10.0 ** -np.arange(15)[:, None]
    b[30, 0] = np.inf
    b[31, 0] = np.nan
    want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    got = tiles.distances(a, b)
    assert np.allclose(got, want, rtol=1e-11, atol=0, equal_nan=True) and (np.diag(got)[:5] == 0).all()
    assert tiles.distances(a[:0], b).shape == (0, 50) and (tiles.NEAR < 1)
