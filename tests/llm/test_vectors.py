"""Embedding near-duplicates against all pairs in double precision; bounds and cells never lose a link."""

import numpy as np
import pytest

from cytolake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, weight long"


def brute(rows, threshold=0.95):
    fits = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    lab = np.arange(len(rows))
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None for (_, v), ok in zip(rows, fits)]
    near = np.array([[a is not None and b is not None and len(a) == len(b) and a @ b >= threshold for b in units] for a in units]) | np.eye(len(rows), dtype=bool)
    while True:
        new = np.where(near, lab[None, :], len(rows)).min(axis=1)
        if (new == lab).all():
            break
        lab = new
    ids = {}
    for (i, _), c in zip(rows, lab):
        if i is not None:
            ids[c] = min(ids.get(c, i), i)
    out = [(i, int(near[k].sum()) - 1, None if i is None else ids[lab[k]]) for k, (i, _) in enumerate(rows)]
    return sorted(((*o, o[0] is not None and o[0] == o[2]) for o in out), key=str)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vectors.near_duplicates(df, **more).collect()), key=str)


def groups(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    return [[float(x) for x in np.float32(centres[rng.integers(9)] + rng.normal(size=dim) * rng.choice(spread))] for _ in range(n)]


ODD = [
    (7000, None), (7001, [0.0] * 16), (7002, [float("nan")] + [1.0] * 15), (7003, [None] + [1.0] * 15), (7004, [float("inf")] * 16), (7005, [3e38] * 16), (7006, []),
    (7007, [1.0] * 8), (7008, [1.0] * 7 + [1.01]), (7009, [-0.0] * 15 + [1e-38]), (7010, [0.0] * 15 + [2.0]),
]


def test_groups_near_the_threshold_and_odd_vectors(spark):
    x = groups(1, 700, 16, [0, 0.05, 0.2, 0.3])
    rows = [*enumerate(x), *ODD, (None, x[3]), (5, x[9])]
    assert found(spark, rows) == brute(rows)


def test_one_large_group_over_several_tiles(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=12)
    x = [[float(v) for v in np.float32(centre + rng.normal(size=12) * 0.12)] for _ in range(2600)] + groups(3, 200, 12, [1.0])
    got = found(spark, list(enumerate(x)))
    units = np.array(x) / np.linalg.norm(np.array(x), axis=1)[:, None]
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    assert [r[1] for r in sorted(got)] == links.tolist()


def test_only_odd_vectors_and_none(spark):
    assert found(spark, ODD[:4]) == brute(ODD[:4])
    assert found(spark, []) == []


@pytest.mark.parametrize("dim", [3, 64, 1500])
def test_bounds_hold_and_few_pairs_need_full_precision(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(60, dim))
    x = vectors.unit_rows(np.r_[x, x + rng.normal(size=x.shape) * rng.uniform(0, 0.6, (60, 1))])
    q = vectors.Quantised(x)
    i, j = np.divmod(np.arange(120 * 120), 120)
    assert q.parts.dtype == np.int8
    assert (np.abs(q.products(q).ravel() - (x @ x.T).ravel()) <= q.bound(q, i, j)).all()
    a, b, again = vectors.linked(q, q, 0.95)
    assert {*zip(a.tolist(), b.tolist())} == {*zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.95)))}
    assert again < len(x) ** 2 / 10


def test_cells_keep_every_link_within_reach():
    x = vectors.unit_rows(np.array(groups(4, 3000, 10, [0.1, 0.3, 1.0])))
    splits = vectors.Splits(x[::3], 40)
    cell, near = splits.cell_of(x), splits.near(x, 0.1 + 1e-9)
    a, b = np.nonzero(x @ x.T >= 0.95)
    assert len(splits.bounds) == 40 and near[np.arange(len(x)), cell].all() and near[a, cell[b]].all()
    assert near.mean() < 0.5  # and most cells are out of reach
