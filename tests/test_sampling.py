"""Sampling operators against plain loops over the same hashed numbers, and against what the draws stand for."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cytolake.operators import sampling as s

FRACTIONS = [0.1, 0.3, 0.8, 1.0]


def numbers(df, *columns, seed):
    """The uniform number of each row, as the operators draw it."""
    return {tuple(r)[:-1]: r[-1] for r in df.select(*columns, s.unit(*columns, F.lit(seed)).alias("u")).collect()}


@pytest.fixture(scope="module")
def umis(spark):
    rng = random.Random(1)
    return spark.createDataFrame([(rng.choice("ab"), f"c{rng.randrange(40)}", f"u{i}", rng.choice([1, 1, 2, 9])) for i in range(400)], "target string, cb string, ub string, reads long").cache()


def test_cells_found_without_replacement(spark, umis):
    reads = {}
    for r in umis.collect():
        reads[r.target, r.cb] = reads.get((r.target, r.cb), 0) + r.reads
    keys = spark.createDataFrame([(*k, i) for k in reads for i in range(4)], "target string, cb string, repeat int")
    u = numbers(keys, "target", "cb", "repeat", seed=7)
    got = {(r.target, r.fraction): r for r in s.region_rarefaction(umis, FRACTIONS, 4, 7).collect()}
    for t in "ab":
        before = None
        for f in FRACTIONS:
            found = [sum(1 - (1 - u[t, c, i]) ** (1 / n) <= f for (x, c), n in reads.items() if x == t) for i in range(4)]
            row = got[t, f]
            assert row["mean"] == pytest.approx(statistics.mean(found)) and row.sd == pytest.approx(statistics.stdev(found))
            assert row.gain is None if before is None else row.gain == pytest.approx(row["mean"] - before)
            before = row["mean"]
        assert got[t, 1.0]["mean"] == sum(x == t for x, _ in reads)


def test_the_least_number_stands_for_all_reads_of_a_cell(spark):
    """A cell of n reads is found at fraction f with probability 1 - (1 - f)^n."""
    cells = spark.createDataFrame([("t", f"c{i}", "u", 1 + i % 3) for i in range(6000)], "target string, cb string, ub string, reads long")
    row = s.region_rarefaction(cells, [0.25], 2, 3).first()
    assert row["mean"] == pytest.approx(sum(2000 * (1 - 0.75**n) for n in (1, 2, 3)), rel=0.03)


def test_curves_of_cells_and_their_end(spark, umis):
    m = umis.select(F.col("cb").alias("cell"), F.col("ub").alias("umi"), F.col("target").alias("gene"), "reads")
    rows = m.collect()
    u = numbers(m, "cell", "umi", "gene", seed=5)
    total = {}
    for r in rows:
        total[r.cell] = total.get(r.cell, 0) + r.reads
    kept = sorted(c for c, n in total.items() if n >= 25)
    got = {r.fraction: r for r in s.cell_curves(m, [0.5, 0.8, 0.9, 1.0], 25, 5).collect()}
    means = {}
    for f in got:
        own = {c: [u[r.cell, r.umi, r.gene] > (1 - f) ** r.reads for r in rows if r.cell == c] for c in kept}
        share = [sum(x) / len(x) for x in own.values()]
        means[f] = statistics.mean(sum(x) for x in own.values())
        assert got[f]["mean"] == pytest.approx(statistics.mean(share)) and got[f]["median"] == pytest.approx(statistics.median(share))
        assert got[f].se == pytest.approx(statistics.stdev(share) / math.sqrt(len(kept)), abs=1e-12) and got[f].mean_umis == pytest.approx(means[f]) and got[f].cells == len(kept)
    end = s.curve_end(s.cell_curves(m, [0.5, 0.8, 0.9, 1.0], 25, 5)).first()
    assert end.ratio_90 == pytest.approx(means[0.9] / means[1.0]) and end.ratio_80 == pytest.approx(means[0.8] / means[1.0])
    last = [means[f] for f in (0.8, 0.9, 1.0)]
    assert end.slope == pytest.approx((max(last) - min(last)) / 0.2)


def test_poisson_dropout_with_an_even_and_an_odd_number_of_cells(spark):
    for cells in (6, 7):
        rows = [(f"c{i}", g, (i + 2) * k) for i in range(cells) for k, g in enumerate("xy", 1)] + [("c0", "z", 50)]
        got = {r.gene: r for r in s.dropout_poisson(spark.createDataFrame(rows, "cell string, gene string, n long"), ["x", "z"]).collect()}
        depth, total = {}, sum(r[2] for r in rows)
        for c, _, n in rows:
            depth[c] = depth.get(c, 0) + n
        for g in "xz":
            zero = [math.exp(-d * sum(n for _, h, n in rows if h == g) / total) for d in depth.values()]
            assert got[g]["mean"] == pytest.approx(statistics.mean(zero)) and got[g]["median"] == pytest.approx(statistics.median(zero))
            assert got[g].observed == pytest.approx(1 - sum(h == g for _, h, _ in rows) / cells)


def test_the_query_draws_at_all_depths_of_its_reference(spark, monkeypatch):
    """SAT-02: 11 fractions, three times each."""
    from cytolake.plans import registry, sampling_queries as q

    asked = []
    monkeypatch.setattr(q.s, "rarefaction", lambda m, fractions, repeats, seed: asked.append((fractions, repeats)) or m)
    registry.QUERIES["SAT-02"](spark, "/root/testdata/sf0.001")
    assert asked == [([0.05, *[k / 10 for k in range(1, 11)]], 3)]
