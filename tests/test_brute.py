"""Greedy and sampling operators, which SQL doesn't express, against plain loops."""

import random
from collections import Counter

from pyspark.sql import functions as F

from cytolake.operators import alignments as al, barcodes as b, reads as r, sampling as s


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, last = [i] + row[1:], row
        for j, d in enumerate(y, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return row[-1]


def test_barcode_spheres_in_greedy_order(spark):
    rng = random.Random(4)
    seeds = ["".join(rng.choice("ACGT") for _ in range(20)) for _ in range(6)]
    rows = []
    for _ in range(160):
        x = list(rng.choice(seeds))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = [rng.choice("ACGT")] * rng.randint(0, 1)
        rows.append(("".join(x), rng.randint(1, 5)))
    counts = Counter()
    for x, n in rows:
        counts[x] += n
    want = {}
    for x in sorted(counts, key=lambda x: (-counts[x], x)):
        if x not in want:
            want |= {y: x for y in counts if y not in want and edits(x, y) <= 3}
    got = {r.barcode: r.centre for r in b.cluster_barcodes(spark.createDataFrame(rows, "barcode string, reads long"), 3).collect()}
    assert got == want


def test_values_round_to_the_commonest_near_one(spark):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(60)) for _ in range(300)]
    want = {}
    for group in {g for g, _ in rows}:
        counts, kept = Counter(p for g, p in rows if g == group), []
        for p in sorted(counts, key=lambda p: (-counts[p], p)):
            near = [k for k in kept if abs(k - p) <= 2]
            want[group, p] = near[0] if near else p
            kept += [] if near else [p]
    got = {(r.sample, r.pos): r.rounded for r in al.round_to_common(spark.createDataFrame(rows, "sample string, pos long"), "sample").collect()}
    assert got == want


def test_reads_join_the_first_open_seed_of_their_signature(spark):
    rng = random.Random(6)
    ends = ["".join(rng.choice("ACGT") for _ in range(10)) for _ in range(3)]
    rows = [(f"r{i:03}", rng.randrange(120), rng.choice(ends) + "ACGT" * rng.randint(0, 2) + rng.choice(ends)) for i in range(250)]
    want, seeds = {}, {}
    for name, pos, seq in sorted(rows, key=lambda x: (x[1], x[0])):
        key = seq[:10] + seq[-10:]
        if key not in seeds or pos - seeds[key][0] > 5:
            seeds[key] = (pos, name)
        want[name] = seeds[key][1]
    got = {r.read_id: r.cluster for r in al.cluster_reads(spark.createDataFrame(rows, "read_id string, pos long, seq string")).collect()}
    assert got == want


def test_chains_of_seeds_in_one_signature(spark, monkeypatch):
    """A run of 4,000 places, of which every second or third is a seed: a dozen rounds, whatever the length."""
    rng, pos, rows = random.Random(9), 0, []
    for i in range(4000):
        pos += rng.choice([1, 2, 3, 5]) if i != 2000 else 40
        rows.append((f"r{i:04}", pos, "ACGTACGTAC" * 2))
    rows += [("short", 3, "ACGT"), ("nowhere", None, "ACGTACGTAC" * 2), ("nothing", 5, None)]
    want, seed = {"short": None, "nowhere": None, "nothing": None}, None
    for name, at, _ in rows[:4000]:
        seed = (at, name) if seed is None or at - seed[0] > 5 else seed
        want[name] = seed[1]
    written, staged = [], al.staged
    monkeypatch.setattr(al, "staged", lambda df: written.append(1) or staged(df))
    got = {r.read_id: r.cluster for r in al.cluster_reads(spark.createDataFrame(rows, "read_id string, pos long, seq string").repartition(3)).collect()}
    assert got == want and len(set(want.values())) > 1000 and len(written) < 30


def test_molecules_take_the_reads_at_their_median(spark):
    rows = [("c", "u", 10, "AC"), ("c", "u", 10, "AC"), ("c", "u", 10, "ACGT"), ("c", "u", 99, "GG"), ("c", "v", 4, "B"), ("c", "v", 5, "A"), ("c", "w", 1, "TT"), ("c", "w", 1, "AA"), ("", "w", 1, "A"), (None, "w", 1, "A")]
    got = {r.umi: tuple(r)[2:] for r in al.umi_consensus(spark.createDataFrame(rows, "cell string, umi string, pos long, seq string")).collect()}
    assert got == {"u": (10, 3, 2, "AC"), "v": (4, 1, 1, "B"), "w": (1, 2, 2, "AA")}


def test_best_tail_window(spark):
    rng = random.Random(7)
    rows = [(f"r{i}", i, "".join(rng.choice("AAAC" if rng.random() < 0.7 else "CGT") for _ in range(rng.randint(0, 40)))) for i in range(60)] + [("x", 60, None)]
    for row in r.polya_best_window(spark.createDataFrame(rows, "name string, file_offset long, seq string")).collect():
        seq, best = rows[row.file_offset][2] or "", (0, None, 0)
        for n in range(6, len(seq) + 1):
            for at in range(len(seq) - n + 1):
                k = seq[at : at + n].count("A")
                if 3 * k >= 2 * n and k > best[0]:
                    best = (k, at, n)
        assert (row.score, row.start, row.length) == best


def test_information_in_each_percentage(spark):
    rng = random.Random(8)
    rows = sorted({(f"c{rng.randrange(12)}", f"u{rng.randrange(60)}") for _ in range(400)})
    df = spark.createDataFrame(rows, "cell string, umi string").cache()
    drawn = df.select("cell", s.unit("cell", "umi", F.lit(3)).alias("u")).collect()
    got = {r.percent: r.share for r in s.info_content(df, [5, 50, 100], 10, 3).collect()}
    for percent in (5, 50, 100):
        seen, every = Counter(x.cell for x in drawn if x.u * 100 <= percent), Counter(x.cell for x in drawn)
        assert abs(got[percent] - sum(min(seen[c], 10) for c in every) / sum(min(n, 10) for n in every.values())) < 1e-12


def test_equal_samples_are_exact_and_the_same_in_any_partitioning(spark):
    a, b_ = spark.range(500).withColumn("name", F.lit("a")), spark.range(1000, 1120).withColumn("name", F.lit("b"))
    got = sorted(map(tuple, r.equalise(a.repartition(7), b_, "id", 5).collect()))
    assert Counter(x[2] for x in got) == {"a": 120, "b": 120} and len({x[0] for x in got}) == 240
    assert got == sorted(map(tuple, r.equalise(a, b_.repartition(3), "id", 5).collect()))
    hashed = {x.id: x.h for x in a.select("id", F.xxhash64("id", F.lit(5)).alias("h")).collect()}
    assert {x[0] for x in got if x[2] == "a"} == set(sorted(hashed, key=lambda i: (hashed[i], i))[:120])


def test_best_window_of_a_very_long_tail(spark):
    row = r.polya_best_window(spark.createDataFrame([("a", 1, "C" + "A" * 40_000)], "name string, file_offset long, seq string")).first()
    assert (row.start, row.length, row.score) == (1, 40_000, 40_000)


def test_terminal_makes_the_sequence_once(spark):
    """Hamming distances by letters, of references of few and many letters; the sequence is one expression of the plan."""
    rnd = random.Random(11)
    rows = [("".join(rnd.choice("ACGTN") for _ in range(rnd.randrange(16, 45))),) for _ in range(300)] + [(None,)]
    df = spark.createDataFrame(rows, "seq string")
    for letters in ("ACGT", "ACGTN"):
        reference = "".join(rnd.choice(letters) for _ in range(28))
        for row in df.select("seq", r.classify_terminal(F.col("seq"), reference, 20, 12).alias("t")).collect():
            near = row.seq and len(row.seq) >= 20 and min(sum(a != b for a, b in zip(row.seq[-20:], reference[i:])) for i in range(9)) <= 12
            assert row.t is None if row.seq is None else row.t == near
    made = df.select(r.classify_terminal(F.md5("seq"), "ACGTTGCAAGCTTACGGATCCATGCAAT").alias("t"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1
