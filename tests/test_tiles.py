"""Tiled pair functions against all pairs by hand, with tiles far smaller than the sets."""

import numpy as np
import pytest

from cytolake.operators import clones, expression as x, tiles

SCHEMA = "cell string, clone string, condition string, cluster int, embedding array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    return [(f"c{i}", f"k{rng.integers(4)}", "AB"[int(rng.integers(2))], int(rng.integers(3)), rng.normal(size=5).tolist()) for i in range(70)]


@pytest.fixture(scope="module")
def points(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(params=[7, 1024])
def tile(request, monkeypatch):
    for name in ("square", "cross"):
        plain = getattr(tiles, name)
        monkeypatch.setattr(tiles, name, lambda *a, plain=plain, **b: plain(*a, **b, tile=request.param))
    return request.param


def gap(a, b):
    return float(np.linalg.norm(np.array(a) - np.array(b)))


def test_energy_of_clones(points, rows, tile):
    by = {k: [r[4] for r in rows if r[1] == k] for k in {r[1] for r in rows}}
    mean = lambda a, b: np.mean([gap(p, q) for p in by[a] for q in by[b]])
    got = {(r.clone_1, r.clone_2): r.energy for r in clones.energy_matrix(points, 2).collect()}
    assert got.keys() == {(a, b) for a in by for b in by if a < b}
    assert all(v == pytest.approx(2 * mean(*k) - mean(k[0], k[0]) - mean(k[1], k[1])) for k, v in got.items())


def test_energy_against_random_sets(points, rows, tile):
    sets = [tuple(r) for r in clones._random_sets(points, points.groupBy("clone").count().withColumnRenamed("count", "size"), 6, 1).collect()]
    at = {r[0]: r[4] for r in rows}
    inside = lambda cells: np.mean([gap(at[a], at[b]) for i, a in enumerate(cells) for b in cells[:i]])
    for r in clones.energy_distance(points, 6, 1).collect():
        null = [inside([c for k, rep, c in sets if (k, rep) == (r.clone, i)]) for i in range(6)]
        assert r.within == pytest.approx(inside([v[0] for v in rows if v[1] == r.clone]))
        assert r.null_mean == pytest.approx(np.mean(null)) and r.null_sd == pytest.approx(np.std(null, ddof=1)) and r.z == pytest.approx((r.within - np.mean(null)) / np.std(null, ddof=1))


def test_spread_of_conditions_and_its_permutations(spark, points, rows, tile):
    n = 9
    hashes = {(r.cell, r.rep): r.h for r in points.selectExpr("cell", f"explode(sequence(0L, {n}L)) rep").selectExpr("cell", "rep", "xxhash64(cell, rep, 1) h").collect()}
    got = {r.cluster: r for r in clones.cluster_spread_test(points, n, 1).collect()}
    for cluster in range(3):
        own = [r for r in rows if r[3] == cluster]
        inside = lambda cells: np.mean([gap(a[4], b[4]) for i, a in enumerate(cells) for b in cells[:i]])
        diff = lambda side: inside([r for r in own if r[0] in side]) - inside([r for r in own if r[0] not in side])
        a = [r[0] for r in own if r[2] == "A"]
        observed = diff(set(a))
        null = [diff(set(sorted((r[0] for r in own), key=lambda c: (hashes[c, i], c))[: len(a)])) for i in range(1, n + 1)]
        assert got[cluster].observed == pytest.approx(observed)
        assert got[cluster].p == pytest.approx((sum(abs(d) >= abs(observed) - 1e-12 for d in null) + 1) / (n + 1))


def test_profiles_against_a_set_itself_and_random_sets(spark, points, rows, tile):
    one, two = points.where("cluster = 0"), points.where("cluster = 1")
    v = {r[0]: np.array(r[4]) for r in rows}
    a, b = ([r[0] for r in rows if r[3] == k] for k in (0, 1))
    r2 = lambda p, q: np.corrcoef(v[p], v[q])[0, 1] ** 2
    got = {r.cell: r.r2 for r in x.max_r2(one, two).collect()}
    assert got == pytest.approx({p: max(r2(p, q) for q in b) for p in a})
    got = {r.cell: r.r2 for r in x.max_r2(one, one, True).collect()}
    assert got == pytest.approx({p: max(r2(p, q) for q in a if q != p) for p in a})

    def js(p, q):
        p, q = np.abs(v[p]) / np.abs(v[p]).sum(), np.abs(v[q]) / np.abs(v[q]).sum()
        m = (p + q) / 2
        return (p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2

    assert {r.cell: r.js for r in x.min_js(one, two).collect()} == pytest.approx({p: min(js(p, q) for q in b) for p in a})
    hashes = [{r.cell: r.h for r in two.selectExpr("cell", f"xxhash64(cell, 5, {i}) h").collect()} for i in range(2)]
    sets = [sorted(b, key=lambda c: (h[c], c))[:6] for h in hashes]
    got = {r.cell: r.random_r2 for r in x.max_r2_null(one, two, 6, 2, 5).collect()}
    assert got == pytest.approx({p: np.mean([max(r2(p, q) for q in s) for s in sets]) for p in a})


def test_constant_profiles_count_for_nothing(spark):
    df = spark.createDataFrame([("a", [1.0, 1.0, 1.0]), ("b", [1.0, 2.0, 4.0]), ("c", [2.0, 4.0, 9.0])], "cell string, embedding array<double>")
    got = {r.cell: r.r2 for r in x.max_r2(df, df, True).collect()}
    assert got["a"] is None and got["b"] == got["c"] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1] ** 2)
