"""What scans and joins touch: pruned reads, observed counters, bins of regions; principal components against numpy."""

import random

import numpy as np
from pyspark.sql import DataFrameWriter, functions as F

from cytolake.operators import expression as x, reads as r
from cytolake.plans import fixtures
from cytolake.sources import readers as s, writers as w

SF = "/root/testdata/sf0.01"


def scanned(df):
    """The scan's description, and the rows that it gave when df ran."""
    plan = df._jdf.queryExecution().executedPlan()
    while "FileScan" not in plan.nodeName() and "Scan parquet" not in plan.nodeName():
        plan = plan.children().head()
    return plan.simpleString(10_000), plan.metrics().apply("numOutputRows").value()


def test_region_scans_open_one_reference_and_skip_row_groups(spark, tmp_path):
    reads = spark.createDataFrame([("chr1" if i % 2 else "chr2", i, f"{20 + i % 7}M") for i in range(40_000)], "ref string, pos int, cigar string")
    path = f"file://{tmp_path}/aligned"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "4096")
    try:
        w.write_aligned(reads, path)
        found = s.read_aligned(spark, path, "chr1", 20_000, 20_100)
        assert {v.pos for v in found.collect()} == {i for i in range(1, 40_000, 2) if i < 20_100 and i + 20 + i % 7 > 20_000}
        text, rows = scanned(found)
        assert "PartitionFilters: [isnotnull(ref" in text and "LessThan(pos,20100)" in text and "GreaterThan(pos,19974)" in text and rows < 4_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")
    assert s.read_aligned(spark, path, "chr9", 0, 10).count() == 0


def test_counters_come_with_the_write(spark, tmp_path):
    reads = fixtures.view(spark, SF, "reads").cache()
    counts = w.write_kept(reads, (17, 25), "chr1", 1000, 5000, f"file://{tmp_path}/kept")
    assert counts == {v.reason: v.reads for v in w.filter_report(reads, (17, 25), "chr1", 1000, 5000).collect()}
    kept = spark.read.parquet(f"file://{tmp_path}/kept")
    assert kept.count() == counts["kept"] > 0 and kept.columns == reads.columns
    reads.unpersist()


def test_regions_of_mixed_lengths_in_one_pass(spark):
    rng = random.Random(1)
    regions = [(f"s{i}", f"chr{i % 2}", p := rng.randrange(200_000), p + rng.choice([30, 50, 200, 900])) for i in range(400)]
    regions += [(f"l{i}", "chr0", i * 10_000, 200_000) for i in range(5)] + [("whole", "chr1", 0, 10**8)]
    blocks = [(f"chr{rng.randrange(3)}", p := rng.randrange(210_000), p + rng.choice([25, 100, 3000])) for _ in range(300)]
    want = sorted((b, t[0]) for b in blocks for t in regions if b[0] == t[1] and min(b[2], t[3]) - max(b[1], t[2]) >= 20)
    df, known = spark.createDataFrame(blocks, "ref string, s long, e long"), spark.createDataFrame(regions, "target string, chrom string, start_pos long, end_pos long")
    for most in (1000, 50, 3, 0):
        got = sorted(((v.ref, v.s, v.e), v.target) for v in r.join_regions(df, known, 20, most).collect())
        assert got == want


def test_a_chromosome_long_region_leaves_the_bins_of_short_ones_narrow(spark):
    regions = spark.range(100_000).selectExpr("cast(id as string) target", "'chr1' chrom", "id * 1000 start_pos", "id * 1000 + 50 + id % 150 end_pos")
    regions = regions.unionByName(spark.createDataFrame([("whole", "chr1", 0, 10**8)], "target string, chrom string, start_pos long, end_pos long"))
    assert r.region_bins(regions).groupBy("chrom", "level", "bin").count().agg({"count": "max"}).first()[0] <= 2
    blocks = spark.createDataFrame([("chr1", 5_000, 5_040), ("chr1", 7_500, 7_540)], "ref string, s long, e long")
    assert sorted(v.target for v in r.join_regions(blocks, regions, 20).collect()) == ["5", "whole", "whole"]


def test_components_of_sparse_triples(spark):
    counts = fixtures.view(spark, SF, "counts").where("n > 40")
    genes = [f"g{i}" for i in range(60)]
    got = {v.cell: v.pca for v in x.scale_pca(counts, genes, 4).collect()}
    rows = x.log_normalize(counts).collect()
    cells = sorted({v.cell for v in rows})
    data = np.zeros((len(cells), len(genes)))
    for v in rows:
        if v.gene in genes:
            data[cells.index(v.cell), genes.index(v.gene)] = v.v
    data -= data.mean(axis=0)
    data /= data.std(axis=0, ddof=1)
    _, _, axes = np.linalg.svd(data, full_matrices=False)
    want = data @ axes[:4].T
    found = np.array([got[c] for c in cells])
    assert np.allclose(np.abs(found), np.abs(want), atol=1e-6)


def test_components_of_many_genes(spark):
    counts = spark.range(60_000).selectExpr("concat('c', id % 300) cell", "concat('g', hash(id) % 2000) gene", "1 + id % 5 n").groupBy("cell", "gene").sum("n").toDF("cell", "gene", "n")
    got = x.scale_pca(counts, [f"g{i}" for i in range(-1999, 2000)][::2], 3).collect()
    assert len(got) == 300 and all(len(v.pca) == 3 for v in got)


def test_sparse_matrix_of_many_files(spark, tmp_path):
    """Lists and matrix are parts of several tasks, numbered over all of them; the header is in the first."""
    rows = [(f"c{i}", f"g{i * 7 % 30}", i) for i in range(1, 400)]
    path = str(tmp_path / "mex")
    w.write_mex(spark.createDataFrame(rows, "cell string, gene string, n long").repartition(5), path)
    parts = sorted((tmp_path / "mex" / "matrix.mtx").glob("part-*"))
    assert parts[0].read_text().splitlines() == ["%%MatrixMarket matrix coordinate integer general", "30 399 399"] and len(parts) > 1
    assert sorted(map(tuple, s.read_mex(spark, path).collect())) == sorted(rows)
    for name, order in (("barcodes", ["b0", "", "b2"]), ("features", ["f0", "f1", "f2"])):
        (tmp_path / "two" / f"{name}.tsv").mkdir(parents=True)
        for i, line in enumerate(order):
            (tmp_path / "two" / f"{name}.tsv" / f"part-{i}").write_text(line + "\n")
    (tmp_path / "two" / "matrix.mtx").write_text("%%MatrixMarket\n3 3 2\n2 1 5\n3 3 1\n")
    assert sorted(map(tuple, s.read_mex(spark, str(tmp_path / "two")).collect())) == [("b0", "f1", 5), ("b2", "f2", 1)]


def test_reads_by_class_are_sorted_in_small_tasks(spark, tmp_path, monkeypatch):
    reads = fixtures.view(spark, SF, "reads").withColumn("file_offset", F.expr("nullif(file_offset % 5, 0) * 0 + file_offset"))
    monkeypatch.setattr(w, "SORTED_ROWS", 1500, raising=False)
    w.split_by_isoform(reads, str(tmp_path / "many"))
    back = spark.read.parquet(str(tmp_path / "many")).withColumn("file", F.col("_metadata.file_path"))
    files = {}
    for x in back.select("file", "ref", "pos").withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect():
        files.setdefault(x.file, []).append((x.ref, x.pos))
    assert all(places == sorted(places) for places in files.values())
    assert len(files) > back.select("isoform").distinct().count()  # one input partition, several tasks
    same = [*reads.columns]
    assert back.select(same).exceptAll(reads).isEmpty() and reads.exceptAll(back.select(same)).isEmpty()
    assert reads.where("file_offset IS NULL").count() > 0


def test_aligned_reads_are_made_once_for_their_ranges(spark, tmp_path, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(seq):
        made.add(1)
        return seq

    monkeypatch.setattr(w, "SORTED_ROWS", 700, raising=False)
    plain = fixtures.view(spark, SF.replace("0.01", "0.001"), "reads").withColumn("ref", F.expr("CASE WHEN pos % 50 > 0 THEN ref END")).withColumn("pos", F.expr("nullif(pos, 4000)"))
    w.write_aligned(plain.withColumn("seq", noted("seq")), str(tmp_path / "aligned"))
    assert made.value == plain.count()  # a partitioner by ranges makes them again for its sample
    back = spark.read.parquet(str(tmp_path / "aligned" / "reads"))
    assert back.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(back.select(plain.columns)).isEmpty()
    files = {}
    for x in back.where("ref IS NOT NULL AND pos IS NOT NULL").select(F.col("_metadata.file_path").alias("file"), "ref", "pos", F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        files.setdefault((x.ref, x.file), []).append(x.pos)
    assert all(at == sorted(at) for at in files.values()) and max(map(len, files.values())) < 1400
    for ref in {k[0] for k in files}:
        spans = sorted((at[0], at[-1]) for (name, _), at in files.items() if name == ref)
        assert len(spans) > 2 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_aligned_reads_are_not_shuffled(spark, tmp_path, monkeypatch):
    """Each input partition writes its own sorted file of a range; ranges are the same for all of them."""
    plans, parquet = {}, DataFrameWriter.parquet

    def noted(self, path, *args, **options):
        plans[path.rpartition("/")[2]] = self._df._jdf.queryExecution().executedPlan().toString()
        parquet(self, path, *args, **options)

    plain = fixtures.view(spark, SF.replace("0.01", "0.001"), "reads").withColumn("ref", F.expr("nullif(ref, 'chr2')"))
    plain.repartition(3, "name").write.parquet(str(tmp_path / "given"))
    monkeypatch.setattr(w, "SORTED_ROWS", 700)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    given = spark.read.parquet(str(tmp_path / "given"))
    parts = given.rdd.getNumPartitions()
    w.write_aligned(given, str(tmp_path / "aligned"))
    assert "Exchange" not in plans["reads"]
    back = spark.read.parquet(str(tmp_path / "aligned" / "reads"))
    assert back.select(plain.columns).exceptAll(plain).isEmpty() and plain.exceptAll(back.select(plain.columns)).isEmpty()
    files = {}
    for x in back.where("ref = 'chr1'").select(F.col("_metadata.file_path").alias("file"), "pos", F.monotonically_increasing_id().alias("at")).orderBy("at").collect():
        files.setdefault(x.file, []).append(x.pos)
    assert all(at == sorted(at) for at in files.values()) and max(map(len, files.values())) < 1400
    spans = sorted({(at[0], at[-1]) for at in files.values()})
    meeting = [sum(a[0] <= b[1] and b[0] <= a[1] for b in spans) for a in spans]
    assert parts > 1 and len(files) > parts and max(meeting) <= parts
    found = s.read_aligned(spark, str(tmp_path / "aligned"), "chr1", 1000, 5000)
    assert found.count() == plain.where("ref = 'chr1'").withColumn("end", w.r.c.last_block(F.col("cigar"), F.col("pos"))["end"]).where("pos < 5000 AND end > 1000").count() > 0
