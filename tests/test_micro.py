"""Edges of the classifiers on tables written by hand, tails against direct sums, and readers of files."""

import math

import pytest
from pyspark.sql import functions as F

from cytolake.functions import cigar as c, stats
from cytolake.operators import alignments as al, barcodes as b, molecules as m, reads as r
from cytolake.plans import registry
from cytolake.sources import readers as s, writers as w


def test_cigar_blocks_of_all_operations(spark):
    df = spark.createDataFrame([("5S10M2I3D4M100N6M7H", 50), ("10M", 0), ("*", 3), (None, 3)], "cigar string, pos int")
    rows = df.select(c.aligned_blocks(F.col("cigar"), F.col("pos")).alias("b"), c.gap_blocks(F.col("cigar"), F.col("pos")).alias("g")).collect()
    assert [(x.start, x.end) for x in rows[0].b] == [(50, 60), (63, 67), (167, 173)] and [(x.start, x.end) for x in rows[0].g] == [(67, 167)]
    assert [(x.start, x.end) for x in rows[1].b] == [(0, 10)] and rows[2].b == [] and rows[3].b is None


def test_junctions_need_a_match_before_the_gap(spark):
    rows = [("c", "u", "20M1000N5M", "x", 0, "A" * 20 + "CCCCC"), ("c", "u", "19M1000N5M", "x", 0, "A" * 24), ("c", "u", "20M2I1000N5M", "x", 0, "A" * 27), ("c", "u", "20M999N5M", "x", 0, "A" * 25), ("c", "u", "1000N5M", "x", 0, "A" * 5), ("c", "u", "3S20M1000N4S", "x", 7, "A" * 27)]
    got = r.splice_junctions(spark.createDataFrame(rows, "cb string, ub string, cigar string, ref string, pos int, seq string")).orderBy("donor").collect()
    assert [(x.donor, x.acceptor, x.seq_after) for x in got] == [(19, 1020, "CCCCC"), (26, None, "")]


def test_site_distances_and_ties(spark):
    sites = {"A": 100, "B": 106, "C": 200}
    df = spark.createDataFrame([(103,), (104,), (112,), (118,), (119,), (None,), (97,)], "p int")
    assert [x[0] for x in df.select(r.classify_site(F.col("p"), sites)).collect()] == ["A", "B", "mnc", "mnc", "nc", "nc", "A"]


def test_sites_are_compared_without_arrays(spark):
    sites = {"A": 100, "B": 106, "C": 106, "D": 40}
    df = spark.range(0, 150).select(F.col("id").cast("int").alias("p"))

    def label(p):
        d, k, name = min((abs(p - at), k, name) for k, (name, at) in enumerate(sites.items()))
        return name if d <= 3 else "mnc" if d <= 12 else "nc"

    named = df.select("p", r.classify_site(F.col("p"), sites).alias("site"), r.classify_site(F.col("p"), {"A": 100}).alias("one"))
    for p, site, one in named.collect():
        assert site == label(p) and one == ("A" if abs(p - 100) <= 3 else "mnc" if abs(p - 100) <= 12 else "nc")
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" not in plan and "named_struct" not in plan and "struct(" not in plan


@pytest.mark.parametrize("end, start, size, kept", [(1019, 900, 119, False), (1020, 900, 120, True), (1000, 900, 100, False)])
def test_region_overlap_of_19_and_20(spark, end, start, size, kept):
    df = spark.createDataFrame([("x", start, f"{size}M")], "ref string, pos int, cigar string")
    assert r.last_block_overlap(df, "x", 1000, 5000).count() == kept


def test_isoform_edges(spark):
    def kind(*blocks, tolerance=10):
        df = spark.createDataFrame([([{"start": a, "end": z} for a, z in blocks],)], "b array<struct<start:int,end:int>>")
        return df.select(r.classify_isoform(F.col("b"), tolerance)).first()[0]

    assert kind((4000, 4049)) == "any" and kind((4000, 4050)) == "US"
    assert kind((5000, 6000), (8300, 8400)) == "MS" and kind((8300, 8400)) == "any"
    assert kind((100, 400), (6200, 6300)) == "SS" and kind((6200, 6300)) == "any"


def test_fragment_pairs(spark):
    rows = [("c", "a", "x", 0, 1000, "+", 1000), ("c", "b", "x", 100, 500, "+", 400), ("c", "d", "x", 1200, 1500, "+", 300), ("c", "e", "x", 1201, 1299, "+", 98), ("c", "f", "y", 0, 10, "+", 10)]
    df = spark.createDataFrame(rows, "cell string, umi string, chrom string, start_pos int, end_pos int, strand string, aligned int")
    got = {(x.umi_1, x.umi_2): x.relationship for x in r.classify_pair(r.fragment_pairs(r.best_fragment(df))).collect()}
    assert got[("a", "b")] == "NESTED" and got[("a", "d")] == "COMPLEMENTARY" and got[("a", "e")] == "DISTANT" and got[("d", "e")] == "NESTED" and ("a", "f") not in got


def test_molecules_with_one_two_and_three_categories(spark):
    rows = [("c", "1", "US", 2), ("c", "2", "any-D4", 1), ("c", "2", "US", 3), ("c", "3", "US", 1), ("c", "3", "MS", 1), ("c", "4", "US", 1), ("c", "4", "SS", 1), ("c", "4", "MS", 1), ("c", "1", "US", 2), (None, "5", "US", 1)]
    df = spark.createDataFrame(rows, "cell string, umi string, category string, read_count long")
    got = {x.umi: (x.category, x.read_count) for x in m.resolve_multimap(m.pool_counts(df)).collect()}
    assert got == {"1": ("US", 2), "2": ("US", 4)}
    assert m.pool_counts(df, distinct_rows=False).where("umi = '1'").first().read_count == 4
    assert m.cell_matrix(df.where("FALSE")).columns == ["cell", *m.MODES["SALVE"], "total"]


def test_index_ties_stay_unassigned(spark):
    reads = spark.createDataFrame([("1", "AAAA"), ("2", "AAAT"), ("3", "AACC"), ("4", "GGGG")], "read_id string, index_part string")
    samples = spark.createDataFrame([("a", "AAAA"), ("b", "AATT"), ("d", "AACA")], "sample string, index_seq string")
    assert {x.read_id: x.sample for x in b.demux(reads, samples).collect()} == {"1": "a", "2": None, "3": "d", "4": None}


def test_umi_merge_goes_to_the_larger_neighbour(spark):
    df = spark.createDataFrame([("c", "AAAA", 10), ("c", "AAAT", 1), ("c", "AATT", 3), ("c", "GGGG", 1)], "cell string, umi string, n long")
    assert {x.umi: x.n for x in b.merge_umis(df).collect()} == {"AAAA": 11, "AATT": 3, "GGGG": 1}


def test_barcode_spheres(spark):
    rows = [("ACGTACGTACGT", 50), ("ACGTACGTACGA", 5), ("ACGTACGTTCGA", 2), ("TTTTGGGGCCCC", 9), ("TTTTGGGGCCC", 1)]
    got = {x.barcode: x.centre for x in b.cluster_barcodes(spark.createDataFrame(rows, "barcode string, reads long"), 1).collect()}
    assert got == {"ACGTACGTACGT": "ACGTACGTACGT", "ACGTACGTACGA": "ACGTACGTACGT", "ACGTACGTTCGA": "ACGTACGTTCGA", "TTTTGGGGCCCC": "TTTTGGGGCCCC", "TTTTGGGGCCC": "TTTTGGGGCCCC"}


def test_tails():
    assert abs(stats.normal_two_sided(1.959963985) - 0.05) < 1e-9
    assert abs(stats.chi_square_upper(3.841458821, 1) - 0.05) < 1e-9 and abs(stats.chi_square_upper(2.0, 2) - math.exp(-1)) < 1e-12
    exact = sum(math.comb(5, k) * math.comb(15, 8 - k) for k in range(3, 6)) / math.comb(20, 8)
    assert abs(stats.hypergeometric_upper(3, 5, 8, 20) - exact) < 1e-12
    assert abs(stats.binomial_upper(2, 4, 0.25) - (1 - 0.75**4 - 4 * 0.25 * 0.75**3)) < 1e-12
    assert abs(stats.fisher_two_sided(3, 1, 1, 3) - 34 / 70) < 1e-9


def test_adjusted_p(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double")
    got = {x.k: x.q and round(x.q, 6) for x in stats.adjust(df, "p", "q").collect()}
    assert got == {"a": 0.03, "b": 0.04, "c": 0.04, "d": None}


def test_sparse_matrix_folder(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket\n%x\n2 2 3\n1 1 5\n2 1 1\n2 2 7\n")
    (tmp_path / "barcodes.tsv").write_text("AA-1\nCC-1\n")
    (tmp_path / "features.tsv").write_text("g1\tname\ng2\tname\n")
    assert sorted(map(tuple, s.read_mex(spark, str(tmp_path)).collect())) == [("AA-1", "g1", 5), ("AA-1", "g2", 1), ("CC-1", "g2", 7)]


def test_csv_round_trip_and_many_files(spark, tmp_path):
    w.write_csv(spark.createDataFrame([("a", [1, 2], True)], "k string, v array<int>, ok boolean"), str(tmp_path / "x"))
    row = spark.read.csv(str(tmp_path / "x"), header=True).first()
    assert tuple(row) == ("a", "1;2", "TRUE")
    assert s.read_many(spark, str(tmp_path / "x")).count() == 1
    with pytest.raises(ValueError):
        s.regions_of(spark.createDataFrame([("t", 1, 2)], "Target string, Start int, End int"))


def brute_stretches(seq, least=6, mismatches=2):
    found = {}
    for i in range(len(seq)):
        for j in range(i + least - 1, len(seq)):
            miss = sum(x != "A" for x in seq[i : j + 1])
            if seq[i] == seq[j] == "A" and miss <= mismatches:
                found[i + 1] = (j - i + 1, miss)
    return found


def test_a_rich_regions_of_any_length(spark):
    seqs = ["A" * 130, "C" * 40 + "A" * 70 + "GG" + "A" * 5 + "T" + "A" * 9, "AAACAGAAATTTAAAAAAC", "CCCC", "", "AAAAA", "ACACAAAGAA" * 12, "TAAAAAANAAAA", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    got = {(x.seq_id, x.start): (x.length, x.mismatches) for x in al.a_rich_regions(df).collect()}
    assert got == {(i, start): v for i, seq in enumerate(seqs) for start, v in brute_stretches(seq or "").items()}
    assert got[0, 1] == (130, 0)


def test_clusters_of_whole_reads(spark, monkeypatch):
    rows = [(1, 10, "G" * 80 + "ACGTACGTAC"), (2, 11, "G" * 80 + "TTGTACGTAC"), (3, 12, "G" * 90 + "ACGTACGTAC")]
    reads = spark.createDataFrame(rows, "file_offset long, pos int, seq string")
    monkeypatch.setattr(registry.fixtures, "view", lambda *_: reads)
    assert {x.read_id: x.cluster for x in registry.QUERIES["SEQ-14"](spark, "").collect()} == {"1": "1", "2": "2", "3": "1"}


def test_umi_merge_goes_by_falling_count_and_the_taken_take_no_one(spark):
    import itertools
    import random

    rng = random.Random(7)
    rows = [("x", "AAAA", 10), ("x", "AAAC", 5), ("x", "AACC", 1), ("y", "AAAC", 2), ("y", "", 3), ("z", "G", 1), ("z", "GG", 4)]
    rows += [(f"r{k}", "".join(rng.choice("AC") for _ in range(5)), rng.randint(1, 4)) for k in range(4) for _ in range(14)]
    got = sorted(map(tuple, b.merge_umis(spark.createDataFrame(rows, "cell string, umi string, n long")).collect()))
    want = []
    for cell in {r[0] for r in rows}:
        counts = {}
        for _, u, n in (r for r in rows if r[0] == cell):
            counts[u] = counts.get(u, 0) + n
        order = sorted(counts, key=lambda u: (-counts[u], u))
        for i, j in itertools.combinations(range(len(order)), 2):
            x, y = order[i], order[j]
            if x in counts and y in counts and len(x) == len(y) and sum(p != q for p, q in zip(x, y)) == 1:
                counts[x] += counts.pop(y)
        want += [(cell, u, n) for u, n in counts.items()]
    assert got == sorted(want) and ("x", "AAAA", 15) in got and ("x", "AACC", 1) in got


def test_alignment_scored_against_itself_is_made_once(spark):
    """SEQ-09 by column shares: rows of an expensive view are not computed again for the profile."""
    from cytolake.operators import alignments

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def base(n):
        made.add(1)
        return "ACGT"[n % 3]

    aln = spark.range(12).select((F.col("id") % 3).alias("seq_id"), (F.col("id") % 4).cast("int").alias("pos"), base("id").alias("base"))
    got = {r.seq_id: r.score for r in alignments.alignment_score(aln, aln, True).collect()}
    assert got.keys() == {0, 1, 2} and all(0 < v <= 1 for v in got.values()) and made.value == 12
