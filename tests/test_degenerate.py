"""Inputs that leave a statistic undefined: constant counts, gene sets of all genes."""

import math

from cytolake.operators import alignments, barcodes, expression as x


def test_constant_counts_have_no_correlation(spark):
    a = spark.createDataFrame([(f"c{i}", 4) for i in range(5)], "cell string, n long")
    b = spark.createDataFrame([(f"c{i}", i + 1) for i in range(5)], "cell string, n long")
    row = x.assay_correlation(a, b, "full").first()
    assert row.n == 5 and all(math.isnan(row[c]) for c in ("pearson", "spearman", "log1p", "log2"))
    row = x.assay_correlation(b, b).first()
    assert all(abs(row[c] - 1) < 1e-12 for c in ("pearson", "spearman", "log1p", "log2"))
    assert x.assay_correlation(a.where("n < 0"), b).first().pearson is None
    named = [d.withColumnRenamed("cell", "barcode") for d in (a, b)]
    assert math.isnan(barcodes.abundance_r2(*named).first().r2)
    assert math.isnan(alignments.distance_trend(b.selectExpr("n AS bin", "2.0D AS log2_ratio")).first().r)
    assert math.isnan(x.metric_correlation(b.selectExpr("n AS m", "1 AS signal"), ["m"], "signal").first().rho)


def _sets(spark):
    scores = spark.createDataFrame([(f"g{i}", "p", float(12 - i)) for i in range(12)], "gene string, pattern string, v double")
    sets = spark.createDataFrame([("all", f"g{i}") for i in range(12)] + [("top", f"g{i}") for i in range(10)], "gene_set string, gene string")
    return scores, sets


def test_a_set_of_all_genes_has_no_enrichment_score(spark):
    got = {r.gene_set: r for r in x.enrichment_scores(*_sets(spark)).collect()}
    assert math.isnan(got["all"].es) and got["all"].size == 12 and abs(got["top"].es - 1) < 1e-12
    scores, sets = _sets(spark)
    assert all(math.isnan(r.es) for r in x.enrichment_scores(scores.withColumn("v", scores.v * 0), sets).collect())


def test_an_undefined_score_has_no_p(spark):
    got = {r.gene_set: r for r in x.gsea(*_sets(spark), 30).collect()}
    assert got["all"].p is None and got["all"].p_adj is None
    assert 0 < got["top"].p < 0.5 and got["top"].p_adj == got["top"].p


def test_a_matrix_keeps_an_undefined_score(spark):
    scores, sets = _sets(spark)
    row = {r.gene_set: r for r in x.score_matrix(x.enrichment_scores(scores, sets), ["p", "q"]).collect()}
    assert math.isnan(row["all"].p) and row["all"].q == 0 and abs(row["top"].p - 1) < 1e-12


def test_a_read_without_sequence_has_no_adapter(spark):
    adapter = "CTACACGACGCTCTTCCGATCT"
    tag = "ACGTACGTACGTACGTGGCCGGCCGGCC"
    rows = [("a", None), ("b", "GG" + adapter + tag + "TTTTTTTTTT" + "GCAG"), ("c", "GG" + adapter[:10] + "A" + adapter[11:] + tag + "TTTTTTTTTT" + "GCAG")]
    got = barcodes.extract_adapter(spark.createDataFrame(rows, "read_id string, seq string"), adapter).collect()
    assert {r.read_id: (r.strand, r.cell, r.umi) for r in got} == {k: ("+", tag[:16], tag[16:]) for k in "bc"}
