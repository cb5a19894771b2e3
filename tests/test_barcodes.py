"""Cell correction against plain loops."""

import itertools
import random
from collections import Counter

from cytolake.operators import barcodes as b


def corrected(reads, listed, p, k):
    prior = Counter(c for _, c, _ in reads if c in listed)
    out = {}
    for i, cell, qual in reads:
        if cell in listed:
            out[i] = (cell, 1.0)
            continue
        scores = {}
        for m in range(1, k + 1):
            for places in itertools.combinations(range(len(cell)), m):
                for bases in itertools.product("ACGT", repeat=m):
                    other = list(cell)
                    for at, base in zip(places, bases):
                        other[at] = base
                    other = "".join(other)
                    if all(other[at] != cell[at] for at in places) and other in listed:
                        score = prior[other] + 1.0
                        for at in places:
                            score *= 10 ** (-(ord(qual[at]) - 33) / 10)
                        scores[other] = score
        if scores:
            best = max(scores, key=lambda c: (scores[c], c))
            if scores[best] / sum(scores.values()) >= p:
                out[i] = (best, scores[best] / sum(scores.values()))
    return out


def changed(rng, cell, m):
    cell = list(cell)
    for at in rng.sample(range(len(cell)), m):
        cell[at] = rng.choice([x for x in "ACGT" if x != cell[at]])
    return "".join(cell)


def test_cells_within_two_substitutions(spark):
    rng = random.Random(1)
    listed = ["".join(rng.choice("ACGT") for _ in range(8)) for _ in range(25)]
    listed += [changed(rng, c, rng.choice([1, 2, 3])) for c in listed[:15]]
    reads = [(i, changed(rng, rng.choice(listed), rng.choice([0, 0, 0, 1, 2, 3])), "".join(rng.choice("#+5?I") for _ in range(8))) for i in range(900)]
    reads += [(1000 + i, "NNNNNNNN", "########") for i in range(50)] + [(2000, "ACG", "III"), (2001, "ACGTNCGT", "IIIIIIII")]
    df, known = spark.createDataFrame(reads, "read_id long, cell string, qual string"), spark.createDataFrame([(c,) for c in listed], "cell string")
    for p, k in ((0.975, 2), (0.975, 1), (0.6, 2)):
        got = {r.read_id: (r.corrected, r.posterior) for r in b.correct_cells(df, known, 8, p, k).collect()}
        want = corrected(reads, set(listed), p, k)
        assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
        assert len(want) < len(reads) - 100


def test_a_posterior_just_below_the_limit_is_refused(spark):
    """Two listed cells one substitution away with priors of 40 and 1: 40/41 passes, with 38 and 1 it doesn't."""
    known = spark.createDataFrame([("AAAAAA",), ("CAAAAA",)], "cell string")
    for exact, passes in ((39, True), (37, False)):
        reads = [(i, "AAAAAA", "IIIIII") for i in range(exact)] + [(999, "GAAAAA", "5IIIII")]
        got = b.correct_cells(spark.createDataFrame(reads, "read_id long, cell string, qual string"), known, 6).where("read_id = 999").collect()
        assert bool(got) == passes and (exact + 1) / (exact + 2) >= 0.975 - 0.001


def test_ties_are_refused(spark):
    known = spark.createDataFrame([("ACAA",), ("AGAA",)], "cell string")
    reads = spark.createDataFrame([(1, "ATAA", "IIII")], "read_id long, cell string, qual string")
    assert b.correct_cells(reads, known, 4).count() == 0 and b.correct_cells(reads, known, 4, 0.5).first().corrected == "AGAA"
