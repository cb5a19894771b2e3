"""Seeded operators by plain loops over the same hashed numbers, taken from Spark a column at a time."""

import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import barcodes, clones, sampling as s


def numbers(df, column, *keys):
    return {tuple(r)[:-1]: r[-1] for r in df.select(*keys, column.alias("x")).collect()}


def test_reads_at_several_depths(spark):
    df = spark.createDataFrame([(f"q{i}",) for i in range(500)], "read_id string")
    h = numbers(df, F.xxhash64("read_id", F.lit(4)), "read_id")
    got = {(r.read_id, r.depth) for r in barcodes.downsample(df, [0.2, 0.5], 4).collect()}
    assert got == {(i, d) for (i,), x in h.items() for d in (0.2, 0.5) if x % 1_000_000 / 1_000_000 < d}
    assert {i for i, d in got if d == 0.2} < {i for i, d in got if d == 0.5} and 200 < sum(d == 0.5 for _, d in got) < 300


@pytest.fixture(scope="module")
def molecules(spark):
    rng = random.Random(2)
    rows = {(f"c{rng.randrange(6)}", f"g{rng.randrange(4)}", f"u{i}"): rng.choice([1, 2, 3, 8]) for i in range(150)}
    return spark.createDataFrame([(*k, n) for k, n in rows.items()], "cell string, gene string, umi string, reads long").cache()


def curve(drawn):
    """Medians, cells and saturation of drawn reads by (cell, gene, umi)."""
    by = {}
    for (cell, gene, umi), n in drawn.items():
        if n:
            by.setdefault(cell, []).append((gene, n))
    umis, reads = sum(map(len, by.values())), sum(n for x in by.values() for _, n in x)
    return statistics.median(len(x) for x in by.values()), statistics.median(len({g for g, _ in x}) for x in by.values()), len(by), 1 - umis / reads


def test_rarefaction_without_and_with_replacement(spark, molecules):
    rows, fractions = {(r.cell, r.gene, r.umi): r.reads for r in molecules.collect()}, [0.3, 0.9]
    each = molecules.select("cell", "gene", "umi", F.explode(F.sequence(F.lit(1), F.col("reads").cast("int"))).alias("i"), F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
    h = numbers(each, F.xxhash64("cell", "gene", "umi", "repeat", "i", F.lit(3)), "cell", "gene", "umi", "repeat", "i")
    got = {(r.fraction, r.repeat): tuple(r)[2:] for r in s.rarefaction(molecules, fractions, 2, 3, replace=False).collect()}
    for f in fractions:
        for rep in range(2):
            drawn = {k: sum((h[*k, rep, i] % s.MILLION + 0.5) / s.MILLION <= f for i in range(1, n + 1)) for k, n in rows.items()}
            assert got[f, rep] == pytest.approx(curve(drawn))
    runs = molecules.select("cell", "gene", "umi", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"), F.lit(0).alias("repeat"))
    u = numbers(runs, s.unit("cell", "gene", "umi", "fraction", "repeat", F.lit(3)), "cell", "gene", "umi", "fraction")

    def poisson(mean, x):
        k, p = 0, math.exp(-mean)
        total = p
        while x > total:
            k += 1
            p *= mean / k
            total += p
        return k

    got = {r.fraction: tuple(r)[2:] for r in s.rarefaction(molecules, fractions, 1, 3).collect()}
    for f in fractions:
        assert got[f] == pytest.approx(curve({k: poisson(n * f, u[*k, f]) for k, n in rows.items()}))


def test_rows_covered_with_replacement(spark, molecules):
    m = molecules.groupBy("cell", "umi").agg(F.sum("reads").alias("reads")).cache()
    rows = {(r.cell, r.umi): r.reads for r in m.collect()}
    for df, weight in ((m, rows), (m.drop("reads"), dict.fromkeys(rows, 1))):
        runs = df.select("cell", "umi", F.explode(F.array(F.lit(20), F.lit(70))).alias("percent"), F.lit(0).alias("repeat"))
        u = numbers(runs, s.unit("cell", "umi", "percent", "repeat", F.lit(6)), "cell", "umi", "percent")
        for r in s.sample_cells(df, ["cell", "umi"], [20, 70], 1, 6).collect():
            hit = {k for k, n in weight.items() if u[*k, r.percent] > math.exp(-n * r.percent / 100)}
            assert (r.cells, r.umis) == (len({c for c, _ in hit}), len(hit))


def test_curves_that_are_exact_are_found(spark):
    x = [5, 10, 20, 50, 80, 100]
    rows = [("mm", p, 400 * p / (30 + p)) for p in x] + [("log", p, 7 * math.log(p) + 3) for p in x] + [("power", p, 2 * p**0.6) for p in x]
    got = {(r.sample, r.curve): r for r in s.fit_curves(spark.createDataFrame(rows, "sample string, percent long, mean double")).collect()}
    for key, a, b in ((("mm", "michaelis-menten"), 400, 30), (("log", "logarithmic"), 7, 3), (("power", "power"), 2, 0.6)):
        assert (got[key].a, got[key].b, got[key].r2) == pytest.approx((a, b, 1))
    assert got["mm", "michaelis-menten"].required_percent == pytest.approx(0.9 * 30 / 0.1)
    assert all(got[k].r2 < 0.9999 for k in got if (k[0], k[1][0]) not in {("mm", "m"), ("log", "l"), ("power", "p")})


def test_knee_of_the_depth_curve(spark, molecules):
    rows = s.depth_curve(molecules, 5, 3).orderBy("fraction").collect()
    curve_of = {r.fraction: r.cells for r in s.rarefaction(molecules, [float(f) for f in np.logspace(-2, 0, 5)], 1, 3, replace=False).collect()}
    x, y = [math.log10(r.fraction) for r in rows], [r.cells for r in rows]
    assert {r.fraction: r.cells for r in rows} == curve_of
    above = [b - (min(y) + (a - min(x)) / (max(x) - min(x)) * (max(y) - min(y))) for a, b in zip(x, y)]
    assert [r.above for r in rows] == pytest.approx(above) and [r.knee for r in rows].index(True) == above.index(max(above)) and sum(r.knee for r in rows) == 1


def test_significance_of_correlations(spark):
    rng = random.Random(4)
    rows = [(f"g{i}", f"h{i}", rng.uniform(-1, 1), rng.uniform(-0.1, 0.1), rng.choice([0.2, 0.5, 0.0])) for i in range(60)]
    df = spark.createDataFrame(rows, "gene_1 string, gene_2 string, rho double, mean double, sd double")
    got = {r.gene_1: r for r in clones.significance(df.select("gene_1", "gene_2", "rho"), df.drop("rho")).collect()}
    z = {g: (rho - m) / sd if sd else 0.0 for g, _, rho, m, sd in rows}
    p = {g: math.erfc(abs(v) / math.sqrt(2)) for g, v in z.items()}
    order = sorted(p, key=p.get)
    adjusted, least = {}, 1.0
    for rank in range(len(order), 0, -1):
        ties = [g for g in order if p[g] == p[order[rank - 1]]]
        least = min(least, p[order[rank - 1]] * len(order) / (order.index(ties[-1]) + 1))
        adjusted[order[rank - 1]] = least
    for g in z:
        assert (got[g].z, got[g].p, got[g].p_adj) == pytest.approx((z[g], p[g], adjusted[g]))


def test_coherence_of_clones(spark):
    rng = random.Random(5)
    cells = [(f"c{i}", f"k{i % 5}") for i in range(24)]
    counts = {(c, g): rng.randint(1, 9) for c, _ in cells for g in ("a", "b") if rng.random() < (0.7 if g == "a" else 0.15)}
    df = spark.createDataFrame(cells, "cell string, clone string").cache()
    x = spark.createDataFrame([(*k, n) for k, n in counts.items()], "cell string, gene string, n long")
    size = Counter(k for _, k in cells)
    sets = {}
    for r in clones._random_sets(df, df.groupBy("clone").agg(F.count("*").alias("size")), 9, 1).collect():
        sets.setdefault((r.clone, r.rep), []).append(r.cell)
    assert all(len(set(v)) == size[k] for (k, _), v in sets.items())

    def deviation(gene, members):
        v = [counts.get((c, gene), 0) for c in members]
        return sum(abs(i - sum(v) / len(v)) for i in v) / len(v)

    got = {(r.gene, r.clone): r for r in clones.coherence(x, df, x.select("gene"), 9, 1).collect()}
    want = {(g, k) for g in "ab" for k in size if any((c, g) in counts for c, j in cells if j == k)}
    assert got.keys() == want
    for g, k in want:
        own = deviation(g, [c for c, j in cells if j == k])
        assert got[g, k].observed == pytest.approx(own)
        assert got[g, k].p == pytest.approx(sum(deviation(g, sets[k, i]) <= own + 1e-9 for i in range(9)) / 9)


def test_swapped_sides_of_matched_pairs(spark):
    rng = random.Random(6)
    rows = [("ab"[i % 2], f"c{i}", f"d{i}", rng.choice(["first", "second", "second", "both", "neither"])) for i in range(80)]
    df = spark.createDataFrame(rows, "gene string, cell_1 string, cell_2 string, category string")
    h = numbers(df.select("cell_1", "cell_2", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("rep")), F.pmod(F.xxhash64("cell_1", "cell_2", "rep", F.lit(1)), F.lit(2)), "cell_1", "cell_2", "rep")
    for r in clones.match_permutation(df, 20, 1).collect():
        odd = [(a, b, 1 if c == "first" else -1) for g, a, b, c in rows if g == r.gene and c in ("first", "second")]
        observed = sum(v for *_, v in odd)
        null = [sum(v * (1 if h[a, b, i] == 0 else -1) for a, b, v in odd) for i in range(20)]
        assert r.observed == observed and r.p == pytest.approx((sum(abs(d) >= abs(observed) for d in null) + 1) / 21)


def test_stability_over_pairings_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    cells = [(f"c{i:02}", f"k{i % 9}") for i in range(40)]
    counts = {(c, g): rng.randint(0, 6) for c, _ in cells for g in "xyz"}
    df = spark.createDataFrame(cells, "cell string, clone string")
    x = spark.createDataFrame([(*k, n) for k, n in counts.items() if n], "cell string, gene string, n long")
    null = {("x", "y"): (0.1, 0.3), ("x", "z"): (-0.1, 0.2), ("y", "z"): (0.0, 0.0)}
    h = numbers(df.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("seed")), F.xxhash64("cell", "seed"), "cell", "seed")
    z = {k: [] for k in null}
    for seed in range(5):
        pairs = [sorted((c for c, j in cells if j == k), key=lambda c: (h[c, seed], c))[:2] for k in sorted({k for _, k in cells})]
        ranks = {}
        for g in "xyz":
            d = [counts[a, g] - counts[b, g] for a, b in pairs]
            order = sorted(range(len(d)), key=lambda i: (d[i], i))
            ranks[g] = [order.index(i) for i in range(len(d))]
        for (a, b), (mean, sd) in null.items():
            z[a, b].append((np.corrcoef(ranks[a], ranks[b])[0, 1] - mean) / sd if sd else 0.0)
    known = spark.createDataFrame([(*k, *v) for k, v in null.items()], "gene_1 string, gene_2 string, mean double, sd double")
    for rows in (4, 100):
        plain = clones.pairing_correlations
        with monkeypatch.context() as m:
            m.setattr(clones, "pairing_correlations", lambda d, key, rows=rows: plain(d, key, rows))
            got = {(r.gene_1, r.gene_2): r for r in clones.stability(x, df, x.select("gene"), known, 5).collect()}
        for k, v in z.items():
            assert (got[k].significant, got[k].median_z, got[k].mean_z, got[k].sd_z) == pytest.approx((sum(abs(i) > 1.96 for i in v), statistics.median(v), statistics.mean(v), statistics.stdev(v)), abs=1e-9)
