"""Exact nearest neighbours against all pairs; pruning; match quality."""

import math

import numpy as np
import pytest

from cytolake.operators import clones, neighbours

VECTORS = "grp string, name string, v array<float>"


def made(seed, n, dim, groups, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 4
    return [(str(rng.choice(groups)), f"n{seed}-{i}", [float(x) for x in np.float32(centres[rng.integers(12)] + rng.normal(size=dim) * spread)]) for i in range(n)]


def brute(queries, targets, apart=False):
    out = {}
    for g, a, v in queries:
        found = [(float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), b) for h, b, w in targets if h == g and not (apart and a == b)]
        if found:
            out[g, a] = min(found)
    return out


def found(spark, queries, targets, apart=False):
    frames = [spark.createDataFrame(x, VECTORS).repartition(3) for x in (queries, targets)]
    return {(r.grp, r.query): r for r in neighbours.nearest(*frames, apart).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    assert all(got[k].d == pytest.approx(want[k][0], abs=1e-12) and got[k].target == want[k][1] for k in want)


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_nearest_of_each_group(spark, spread):
    a, b = made(1, 150, 6, ["x", "y", "rare"], spread), made(2, 300, 6, ["x", "y"], spread)
    b += [("x", "copy-b", b[5][2]), ("x", "copy-a", b[5][2]), ("only", "t", b[0][2])]
    a += [("x", "same", b[5][2]), ("nothing", "q", b[0][2])]
    same(found(spark, a, b), brute(a, b))


def test_nearest_other_one_and_alone(spark):
    a = made(3, 200, 5, ["x", "y"], 1.0) + [("alone", "q", [1.0] * 5)]
    same(found(spark, a, a, True), brute(a, a, True))


def test_large_cells_are_cut_into_tiles_and_most_targets_are_never_compared(spark):
    a, b = made(4, 60, 8, ["x"], 0.2), made(4, 4000, 8, ["x"], 0.2)
    got = found(spark, a, b)
    same(got, brute(a, b))
    assert sum(r.compared for r in got.values()) < 60 * 4000 / 4


def test_nothing_to_search(spark):
    a = made(5, 5, 4, ["x"], 1.0)
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame(a, VECTORS)
    assert neighbours.nearest(empty, some).count() == 0 and neighbours.nearest(some, empty).count() == 0


def test_match_quality(spark):
    rng = np.random.default_rng(6)
    rows = [("g", "matched", float(x)) for x in np.round(rng.normal(1, 0.4, 40), 1)] + [("g", "random", float(x)) for x in np.round(rng.normal(1.5, 0.4, 50), 1)]
    rows += [("g", "within", 1.0), ("h", "matched", 2.0), ("h", "random", 1.0), ("w", "within", 3.0)]
    got = {r.gene: r for r in clones.match_quality(spark.createDataFrame(rows, "gene string, kind string, d double")).collect()}
    m, r = (np.array([d for g, k, d in rows if (g, k) == ("g", kind)]) for kind in ("matched", "random"))
    ks = max(0, *[(m <= x).mean() - (r <= x).mean() for x in [*m, *r]])
    assert got["g"].ks == pytest.approx(ks) and got["g"].p == pytest.approx(math.exp(-2 * ks**2 * 40 * 50 / 90)) and got["g"].median_matched == pytest.approx(np.median(m))
    assert (got["g"].n_matched, got["g"].n_random, got["g"].n_within) == (40, 50, 1)
    assert got["h"].ks == 0 and got["h"].p == 1 and got["w"].ks is None


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_estimates_leave_open_what_may_be_nearest(shift):
    """The nearest pair stays open, ties and copies too, also where products cancel; few others do."""
    rng = np.random.default_rng(7)
    b = rng.normal(size=(400, 16)) + shift
    a = np.concatenate([rng.normal(size=(50, 16)) + shift, b[:5], [np.full(16, np.nan)]])
    b = np.concatenate([b, b[:3]])
    near = rng.random((len(a), len(b))) < 0.9
    d = np.where(near, ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), np.inf)
    open_ = neighbours._open(a, b, near)
    assert open_[:-1][d[:-1] == d[:-1].min(axis=1, keepdims=True)].all() and not (open_ & ~near).any() and (open_[-1] == near[-1]).all()
    assert shift or open_[:-1].sum() < 2 * len(a)
