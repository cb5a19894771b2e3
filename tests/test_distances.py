"""Bootstrap and permutation of distances: the same draws put together by plain loops, and what the tests must find."""

import numpy as np
import pytest

from cytolake.operators import distances as d


def histogram(rows, names):
    values = sorted({v for g, v in rows if g in names and v is not None})
    return np.array(values, float), np.array([[sum(1 for g, w in rows if g == n and w == v) for n in names] for v in values], np.int64)


def plain(values, x, y):
    f = g = js = area = ks = 0.0
    for k, v in enumerate(values):
        p, q = x[k] / x.sum(), y[k] / y.sum()
        f, g = f + p, g + q
        ks = max(ks, abs(f - g))
        js += (p * np.log2(2 * p / (p + q)) if p else 0) / 2 + (q * np.log2(2 * q / (p + q)) if q else 0) / 2
        area += abs(f - g) * (values[k + 1] - v) if k + 1 < len(values) else 0
    return ks, max(js, 0) ** 0.5, area


def redrawn(counts, size, kind, a, b, reps, seed):
    """Both sides of every replicate, for all values, from the generators of the blocks."""
    blocks = [counts[k : k + size] for k in range(0, len(counts), size)]
    per = max(1, min(d.AT_ONCE, d.ENTRIES // size))
    other = b if kind == d.CLOSER else 0
    if kind != d.BOOTSTRAP:
        take = d.dealt(d.generator(seed, kind, a, b, -1, 0), np.array([k[:, a].sum() + k[:, other].sum() for k in blocks]), np.full(reps, counts[:, a].sum()))
    out = []
    for at in range(0, reps, per):
        n = min(per, reps - at)
        mine, rest = [], []
        for i, k in enumerate(blocks):
            rng = d.generator(seed, kind, a, b, i, at // per)
            if kind == d.BOOTSTRAP:
                mine.append(rng.poisson(k[:, [a]], (len(k), n)))
                rest.append(rng.poisson(k[:, [0]], (len(k), n)))
            else:
                mine.append(d.dealt(rng, k[:, a] + k[:, other], take[i, at : at + n]))
                rest.append((k[:, a] + k[:, other])[:, None] - mine[-1])
        out += [*zip(np.concatenate(mine).T, np.concatenate(rest).T)]
    return out


def made(seed, n):
    rng = np.random.default_rng(seed)
    rows = [("ref", int(v)) for v in rng.poisson(5, n)] + [("near", int(v)) for v in rng.poisson(5.2, n // 2)] + [("far", int(v)) for v in rng.poisson(9, n // 2)]
    return [*rows, ("near", None), (None, 3)]


@pytest.fixture(scope="module")
def rows():
    return made(1, 240)


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "m string, v int").repartition(3).cache()


@pytest.mark.parametrize("size", [5, 1024])
def test_every_replicate_by_plain_loops(df, rows, size):
    names = ["ref", "far", "near"]
    values, counts = histogram(rows, names)
    got = {(r.kind, r.first, r.second, r.side, r.rep): (r.ks, r.js, r.wasserstein) for r in d.replicates(df, "v", "m", names, 30, 40, 7, True, size).collect()}
    want = {(d.OBSERVED, m, 0, 0, 0): plain(values, counts[:, m], counts[:, 0]) for m in (1, 2)}
    for m in (1, 2):
        for kind, reps in ((d.BOOTSTRAP, 30), (d.PERMUTED, 40)):
            want |= {(kind, m, 0, 0, r): plain(values, x, y) for r, (x, y) in enumerate(redrawn(counts, size, kind, m, 0, reps, 7))}
    for r, sides in enumerate(redrawn(counts, size, d.CLOSER, 1, 2, 40, 7)):
        want |= {(d.CLOSER, 1, 2, s, r): plain(values, x, counts[:, 0]) for s, x in enumerate(sides)}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


@pytest.mark.parametrize("size", [5, 1024])
def test_draws_keep_their_margins(rows, size):
    _, counts = histogram(rows, ["ref", "far", "near"])
    for mine, rest in redrawn(counts, size, d.PERMUTED, 1, 0, 20, 3):
        assert mine.sum() == counts[:, 1].sum() and ((mine + rest) == counts[:, 0] + counts[:, 1]).all() and (mine >= 0).all()
    mean = np.mean([x for x, _ in redrawn(counts, size, d.BOOTSTRAP, 1, 0, 3000, 3)], axis=0)
    assert np.abs(mean - counts[:, 1]).max() < 0.5


def test_intervals_and_p_from_the_replicates(df, rows):
    values, counts = histogram(rows, ["ref", "far"])
    row = d.wasserstein_context(df, "v", "m", "far", "ref", 200, 300, 5).first()
    observed = plain(values, counts[:, 1], counts[:, 0])[2]
    boot = [plain(values, x, y)[2] for x, y in redrawn(counts, 1024, d.BOOTSTRAP, 1, 0, 200, 5)]
    perm = [plain(values, x, y)[2] for x, y in redrawn(counts, 1024, d.PERMUTED, 1, 0, 300, 5)]
    ref = np.repeat(values, counts[:, 0])
    want = (observed, observed / ref.std(ddof=1), *np.quantile(boot, [0.025, 0.975]), np.std(boot, ddof=1), np.mean([x >= observed - 1e-12 for x in perm]), ref.std(ddof=1), ref.mean())
    assert np.allclose(tuple(row), want)


def test_what_differs_is_found_and_what_does_not_is_not(df):
    got = {(r.method, r.metric): r for r in d.methods_tested(df, "v", "m", "ref", 200, 200).collect()}
    assert len(got) == 6
    for metric in d.METRICS:
        assert got["far", metric].p < 0.01 < 0.1 < got["near", metric].p
        assert got["far", metric].ci_lower > got["near", metric].distance
    closer = d.closer_methods(df, "v", "m", "ref", 200).collect()
    assert {(r.first, r.second, r.closer) for r in closer} == {("far", "near", "near")} and all(r.p < 0.01 and r.difference > 0 for r in closer)


def test_without_rows_or_methods(spark, df):
    assert d.methods_tested(df.where("m = 'ref'"), "v", "m", "ref").count() == 0
    assert d.closer_methods(df.where("m <> 'near'"), "v", "m", "ref").count() == 0
    none = d.wasserstein_context(df.where("m <> 'far'"), "v", "m", "far", "ref", 20, 20).first()
    assert none.wasserstein is None and none.p is None


def test_few_blocks_are_shared_by_many_tasks(df, monkeypatch):
    """A block's chunks of replicates go to several groups; the replicates stay those of one task a block."""
    monkeypatch.setattr(d, "AT_ONCE", 8)
    made = {}
    for tasks in (1, 64):
        monkeypatch.setattr(d, "TASKS", tasks)
        reps = d.replicates(df, "v", "m", ["ref", "far", "near"], 30, 40, 7, True, 9)
        made[tasks] = sorted(map(tuple, reps.collect()))
    assert np.allclose(np.array(made[1], float), np.array(made[64], float)) and len(made[1]) == 2 + 2 * 30 + 2 * 40 + 2 * 40


def test_few_things_are_dealt_one_by_one():
    """Small counts take no hypergeometric numbers; sums are exact, means and variances those of the hypergeometric distribution."""

    class Uniform:
        def __init__(self):
            self.rng = np.random.default_rng(5)

        def random(self, n):
            return self.rng.random(n)

    counts, take = np.array([1, 0, 3, 16, 2]), np.full(20_000, 8)
    got = d.dealt(Uniform(), counts, take)
    assert (got.sum(axis=0) == take).all() and (got >= 0).all() and (got <= counts[:, None]).all()
    share = 8 / 22
    assert got.mean(axis=1) == pytest.approx(counts * share, abs=0.05)
    assert got.var(axis=1) == pytest.approx(counts * share * (1 - share) * (22 - counts) / 21, abs=0.06)
    for least in (0, 22):
        assert (d.dealt(Uniform(), counts, np.full(3, least)).sum(axis=0) == least).all()


def test_wasserstein_alone_computes_no_other_divergence():
    x, y = np.array([[1.0, 2.0], [3.0, 0.0]]), np.array([[2.0, 1.0], [1.0, 1.0]])
    args = (np.array([1.0, 0.0]), x, y, np.zeros(2), np.zeros(2), x.sum(axis=0), y.sum(axis=0))
    gap, js, area = d.parts(*args, ["wasserstein"])
    whole = d.parts(*args)
    assert (gap == whole[0]).all() and np.isnan(js).all() and (area == whole[2]).all()
