"""SRC and SNK queries; sources that read files are checked on files in tests, here on tables that Spark derives."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import molecules as m
from cytolake.plans.reads_queries import RB, isoform, ov
from cytolake.plans.registry import ORACLES, QUERIES, operator
from cytolake.plans.staging import shared_path
from cytolake.sources import readers as s, writers as w
from cytolake.streaming import incremental


@operator("SRC-01", "reads", sql=f"WITH {RB} SELECT file_offset FROM rb WHERE ref = 'chr1' AND pos < 5000 AND e1 > 1000")
def _(reads):
    """Reads laid out by reference and position, and a region of them."""
    path = shared_path(reads.sparkSession, "aligned")
    w.write_aligned(reads, path)
    return s.read_aligned(reads.sparkSession, path, "chr1", 1000, 5000).select("file_offset")


SAM = "SELECT concat_ws('\t', name, CAST(flag AS STRING), ref, CAST(pos + 1 AS STRING), CAST(mapq AS STRING), cigar, '*', '0', '0', seq, '*', concat('CB:Z:', coalesce(cb, '-')), concat('UR:Z:', ur)) AS value FROM reads"


@operator("SRC-02", "reads", sql="SELECT ref, count(*) AS reads, sum(pos) AS pos, sum(flag) AS flag, count(DISTINCT coalesce(cb, '-')) AS cells, count(DISTINCT ur) AS umis FROM reads GROUP BY ref")
def _(reads):
    """Reads written as SAM text and read back."""
    spark, path = reads.sparkSession, shared_path(reads.sparkSession, "sam")
    spark.sql(SAM.replace("FROM reads", "FROM {reads}"), reads=reads).write.text(path)
    sam = s.read_sam(spark, path)
    return sam.groupBy("ref").agg(F.count("*").alias("reads"), F.sum("pos").alias("pos"), F.sum("flag").alias("flag"), F.count_distinct(s.tag("tags", "CB")).alias("cells"), F.count_distinct(s.umi("tags")).alias("umis"))


@operator("SRC-03", "reads", sql="SELECT file_offset, cb AS cell, coalesce(ub, ur) AS umi FROM reads")
def _(reads):
    pairs = F.filter(F.array(F.struct(F.lit("CB"), F.col("cb").alias("v")), F.struct(F.lit("UB"), F.col("ub").alias("v")), F.struct(F.lit("UR"), F.col("ur").alias("v"))), lambda x: x["v"].isNotNull())
    return reads.withColumn("tags", F.map_from_entries(pairs)).select("file_offset", s.tag("tags", "CB").alias("cell"), s.umi("tags").alias("umi"))


def _fastq_file(fastq, tag):
    path = shared_path(fastq.sparkSession, tag)
    fastq.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id", F.lit(" 1:N:0:"), "index_part"), "seq", F.lit("+"), "qual").alias("value")).write.text(path)
    return path


@operator("SRC-04", "fastq", sql="SELECT a.read_id, a.seq AS seq_1, b.seq AS seq_2 FROM fastq a JOIN fastq b ON a.read_id = b.read_id WHERE b.read_id < 'q5'")
def _(fastq):
    pairs = s.read_fastq_pairs(fastq.sparkSession, _fastq_file(fastq, "fastq-1"), _fastq_file(fastq.where("read_id < 'q5'"), "fastq-2"))
    return pairs.select("read_id", "seq_1", "seq_2")


@operator("SRC-05", "fastq", sql="SELECT read_id, concat('1:N:0:', index_part) AS comment, seq, qual FROM fastq")
def _(fastq):
    return s.read_fastq(fastq.sparkSession, _fastq_file(fastq, "fastq"))


@operator("SRC-06", "alignment", sql="SELECT CAST(seq_id AS STRING) AS title, pos, base FROM alignment")
def _(aln):
    path = shared_path(aln.sparkSession, "fasta")
    seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    aln.groupBy("seq_id").agg(seq.alias("s")).select(F.concat(F.lit(">"), "seq_id", F.lit("\n"), F.substring("s", 1, 20), F.lit("\n"), F.substring("s", 21, 99)).alias("value")).write.text(path)
    return s.read_fasta(aln.sparkSession, path)


@operator("SRC-07", "counts", sql="SELECT cell, gene, n FROM counts")
def _(counts):
    path = shared_path(counts.sparkSession, "mex")
    w.write_mex(counts, path)
    return s.read_mex(counts.sparkSession, path)


@operator("SRC-08", "molecule_table", "cells", sql="SELECT * FROM molecule_table WHERE cell IN (SELECT replace(cell, 'c', 'b') FROM cells WHERE signal > 2)")
def _(molecules, cells):
    return s.read_molecules(molecules, cells.where("signal > 2").select(F.replace("cell", F.lit("c"), F.lit("b")).alias("cell")))


@operator("SRC-09", "cells", sql="SELECT DISTINCT concat(clone, '-2') AS cell FROM cells")
def _(cells):
    path = shared_path(cells.sparkSession, "cells")
    cells.select(F.concat("clone", F.lit("-1,"), "cluster").alias("value")).write.option("compression", "gzip").text(path)
    return s.read_cells(cells.sparkSession, path, "-2")


@operator("SRC-10", "cells", sql="SELECT cell FROM cells")
def _(cells):
    path = shared_path(cells.sparkSession, "whitelist")
    cells.select(F.concat(F.lit(" "), "cell", F.lit("\t"), "clone").alias("value")).write.text(path)
    return s.read_whitelist(cells.sparkSession, path)


EXONS = "SELECT DISTINCT concat(gene, '_', start_pos) AS target, chrom, CAST(start_pos AS BIGINT) AS start_pos, CAST(end_pos AS BIGINT) AS end_pos FROM events_psi"


@operator("SRC-11", "events_psi", sql=f"{EXONS} UNION ALL SELECT target, 'chr9' AS chrom, start_pos, end_pos FROM ({EXONS})")
def _(events):
    """The exons of events as a region file, read with its own references and with one that overrides them."""
    path = shared_path(events.sparkSession, "regions")
    table = events.select(F.concat("gene", F.lit("_"), "start_pos").alias("Target"), F.col("chrom").alias("Chr"), F.col("start_pos").alias("Start"), F.col("end_pos").alias("End")).distinct()
    w.write_csv(table, path)
    return s.read_regions(events.sparkSession, path).unionByName(s.read_regions(events.sparkSession, path, "chr9"))


@operator("SRC-12", "assay_a", "assay_b", sql="SELECT cell, umi FROM assay_a UNION ALL SELECT cell, umi FROM assay_b")
def _(a, b):
    path = shared_path(a.sparkSession, "assays")
    for name, part in (("a", a.withColumnRenamed("category", "x")), ("b", b)):
        w.write_csv(part, f"{path}/{name}.csv")
    return s.union_common([s.read_many(a.sparkSession, f"{path}/{name}.csv") for name in "ab"]).select("cell", "umi")


@operator("SRC-13", "events_psi", sql="""SELECT o_orderkey AS event_id, gene, CASE WHEN condition = 0 THEN 'RI' ELSE 'SE' END AS event_type, CASE
  WHEN condition = 0 THEN start_pos ELSE start_pos + 5 END AS first_start, CASE WHEN condition = 0 THEN 1 ELSE 2 END AS exons FROM events_psi""")
def _(events):
    e = events.withColumn("event_id", F.col("o_orderkey")).withColumns({"up_start": F.col("start_pos") + 5, "up_end": F.col("start_pos") + 9, "down_start": F.col("end_pos"), "down_end": F.col("end_pos") + 9, "ri_start": F.col("start_pos"), "ri_end": F.col("end_pos")})
    out = s.events_of({"SE": (e.where("condition = 1"), ["up", "down"]), "RI": (e.where("condition = 0"), ["ri"])})
    return out.select("event_id", "gene", "event_type", F.col("exons")[0]["start"].alias("first_start"), F.size("exons").alias("exons"))


@operator("SRC-14", "gene_sets", sql="SELECT gene_set, array_to_string(list_sort(list(DISTINCT gene)), ',') AS genes FROM gene_sets GROUP BY 1")
def _(sets):
    return s.gene_sets(sets).select("gene_set", F.array_join("genes", ",").alias("genes"))


@operator("SNK-01", "molecules", sql="""SELECT cell, count(*) AS n, sum(read_count) AS reads
  FROM (SELECT cell, umi, category, sum(read_count) AS read_count FROM (SELECT DISTINCT cell, umi, category, read_count FROM molecules)
  GROUP BY 1, 2, 3) GROUP BY cell""")
def _(mol):
    path = shared_path(mol.sparkSession, "csv")
    w.write_csv(m.pool_counts(mol), path)
    back = mol.sparkSession.read.schema("cell string, umi string, category string, read_count long").csv(path, header=True)
    return back.groupBy("cell").agg(F.count("*").alias("n"), F.sum("read_count").alias("reads"))


@operator("SNK-02", "reads", "valid_cells", sql="SELECT cb, count(*) AS reads FROM reads WHERE cb IN (SELECT cell FROM valid_cells) GROUP BY cb")
def _(reads, cells):
    path = shared_path(reads.sparkSession, "by-cell")
    w.split_by_cell(reads, cells.select(F.col("cell").alias("cb")), path)
    return reads.sparkSession.read.parquet(path).groupBy("cb").agg(F.count("*").alias("reads"))


@operator("SNK-03", "reads", sql=f"WITH {RB} SELECT {isoform(10)} AS isoform, count(*) AS reads, sum(pos) AS pos FROM rb GROUP BY 1")
def _(reads):
    path = shared_path(reads.sparkSession, "by-isoform")
    w.split_by_isoform(reads, path)
    return reads.sparkSession.read.parquet(path).groupBy("isoform").agg(F.count("*").alias("reads"), F.sum("pos").alias("pos"))


@operator("SNK-04", "reads", sql=f"""WITH {RB} SELECT CASE WHEN cb IS NULL THEN 'no cell' WHEN ub IS NULL THEN 'no molecule'
  WHEN xf NOT IN (17, 25) THEN 'flag' WHEN ref <> 'chr1' OR {ov('g1', 'e1', 1000, 5000)} < 20 THEN 'region'
  ELSE 'kept' END AS reason, count(*) AS reads FROM rb GROUP BY 1""")
def _(reads):
    counts = w.write_kept(reads, (17, 25), "chr1", 1000, 5000, shared_path(reads.sparkSession, "kept"))
    return reads.sparkSession.createDataFrame(list(counts.items()), "reason string, reads long")


@operator("SNK-05", "events_psi", sql="""SELECT event_id, k, concat_ws('\t', chrom, 'SE', CASE WHEN k = 0 THEN 'gene' WHEN k < 3 THEN 'mRNA'
  ELSE 'exon' END, CAST(CASE WHEN k IN (4) THEN start_pos + 21 WHEN k IN (5, 7) THEN start_pos + 61 ELSE start_pos + 1 END AS STRING),
  CAST(CASE WHEN k IN (3, 6) THEN start_pos + 10 WHEN k = 4 THEN start_pos + 30
  ELSE end_pos END AS STRING), '.', '+', '.', concat('ID=', event_id, CASE k WHEN 0 THEN '' WHEN 1 THEN concat('.A;Parent=', event_id)
  WHEN 2 THEN concat('.B;Parent=', event_id) WHEN 3 THEN concat('.A.up;Parent=', event_id, '.A')
  WHEN 4 THEN concat('.A.skipped;Parent=', event_id, '.A') WHEN 5 THEN concat('.A.down;Parent=', event_id, '.A')
  WHEN 6 THEN concat('.B.up;Parent=', event_id, '.B') ELSE concat('.B.down;Parent=', event_id, '.B') END)) AS line
FROM (SELECT *, concat('e', o_orderkey) AS event_id, CAST(unnest(range(0, 8)) AS INT) AS k FROM events_psi)""")  # fmt: skip
def _(events):
    e = events.select(F.concat(F.lit("e"), "o_orderkey").alias("event_id"), "chrom", F.lit("+").alias("strand"), F.col("start_pos").alias("up_start"), (F.col("start_pos") + 10).alias("up_end"), (F.col("start_pos") + 20).alias("skipped_start"), (F.col("start_pos") + 30).alias("skipped_end"), (F.col("start_pos") + 60).alias("down_start"), F.col("end_pos").alias("down_end"))
    return w.events_to_gff3(e)


def _stream(spark, sf_dir):
    counts = incremental.cell_counts(incremental.molecule_stream(spark, sf_dir), "6 hours")
    out = incremental.run_available(counts, shared_path(spark, "stream"), shared_path(spark, "stream-state"))
    return out.groupBy("start", "category").agg(F.sum("molecules").alias("molecules"), F.count_distinct("cell").alias("cells")).withColumn("start", F.unix_timestamp("start"))


QUERIES["STREAM-01"] = _stream
ORACLES["STREAM-01"] = "SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type AS category, count(*) AS molecules, count(DISTINCT user_id) AS cells FROM events GROUP BY 1, 2"
