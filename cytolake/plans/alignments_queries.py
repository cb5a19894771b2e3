"""SEQ, PSI and SP queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import alignments as a
from cytolake.plans.registry import operator

REFERENCE = "refpos AS (SELECT pos, row_number() OVER (ORDER BY pos) AS ref_pos FROM alignment WHERE seq_id = 5 AND base <> '-')"
PROFILE = """profile AS (SELECT pos, base, count(*) / sum(count(*)) OVER (PARTITION BY pos) AS share, CASE WHEN base <> '-' THEN count(*) / sum(CASE
  WHEN base <> '-' THEN count(*) END) OVER (PARTITION BY pos) END AS share_without_gaps FROM alignment GROUP BY 1, 2)"""
DIVERSITY = """diversity AS (SELECT pos, CASE WHEN m > 1 THEN (m * (m - 1) / 2 - same) / (m * (m - 1) / 2) ELSE 0 END AS diversity
  FROM (SELECT pos, sum(n) AS rows, sum(CASE WHEN base <> '-' THEN n ELSE 0 END) AS m, sum(CASE WHEN base <> '-' THEN n * (n - 1) / 2
  ELSE 0 END) AS same
FROM (SELECT pos, base, count(*) AS n FROM alignment WHERE seq_id <> 5 GROUP BY 1, 2) GROUP BY 1) WHERE rows - m <= 0.5 * rows)"""
CODON = f"""codons(codon, residue) AS (VALUES {', '.join(f"('{c}', '{r}')" for c, r in a.CODONS.items())}),
residues AS (SELECT seq_id, codon_pos, CASE WHEN contains(c, '-') THEN '-' ELSE coalesce(residue, 'X') END AS residue
  FROM (SELECT seq_id, (pos - 1) // 3 + 1 AS codon_pos, string_agg(base, '' ORDER BY pos) AS c FROM alignment GROUP BY 1, 2 HAVING count(*) = 3) LEFT
  JOIN codons ON codon = c)"""


@operator("SEQ-01", "alignment", sql="""SELECT pos, count(*) FILTER (base <> '-') AS bases,
  count(*) FILTER (base <> '-') >= 0.94 * (SELECT count(DISTINCT seq_id) FROM alignment) OR bool_or(seq_id = 5 AND base <> '-') AS occupied
  FROM alignment GROUP BY pos""")
def _(aln):
    return a.column_occupancy(aln, 0.94, 5)


@operator("SEQ-02", "alignment", sql=f"WITH {PROFILE} SELECT * FROM profile")
def _(aln):
    return a.column_profile(aln)


@operator("SEQ-03", "alignment", sql=f"WITH {CODON} SELECT codon_pos, residue, count(*) / sum(count(*)) OVER (PARTITION BY codon_pos) AS share FROM residues GROUP BY 1, 2")
def _(aln):
    return a.residue_profile(a.translate(aln))


@operator("SEQ-04", "alignment", sql=f"WITH {DIVERSITY} SELECT * FROM diversity")
def _(aln):
    return a.column_diversity(aln, reference=5)


@operator("SEQ-05", "alignment", sql=f"""WITH {DIVERSITY}, {REFERENCE}, p(protein, lo, hi) AS (VALUES ('gag', 1, 9), ('pol', 10, 21), ('env', 22, 26))
  SELECT protein, ref_pos - lo + 1 AS position, diversity, avg(diversity) OVER (PARTITION BY protein) AS mean FROM diversity JOIN refpos USING (pos)
  JOIN p ON ref_pos BETWEEN lo AND hi""")
def _(aln):
    return a.protein_diversity(a.column_diversity(aln, reference=5), aln, 5, [("gag", 9), ("pol", 12), ("env", 5)])


@operator("SEQ-06", "alignment", sql=f"WITH {DIVERSITY} SELECT * FROM diversity WHERE diversity >= 0.75")
def _(aln):
    return a.high_diversity(a.column_diversity(aln, reference=5), 0.75)


@operator("SEQ-07", "alignment", sql=f"""WITH {REFERENCE}, g(gene, part, lo, hi) AS (VALUES ('tat', 0, 2, 7), ('tat', 1, 12, 18), ('nef', 2, 9, 20)),
  c AS (SELECT gene, pos, row_number() OVER (PARTITION BY gene ORDER BY part, pos) AS new_pos, count(*) OVER (PARTITION BY gene) AS size FROM refpos
  JOIN g ON ref_pos BETWEEN lo AND hi)
SELECT gene, seq_id, new_pos, base FROM alignment JOIN c USING (pos) WHERE new_pos <= size - 3""")  # fmt: skip
def _(aln):
    return a.cut_regions(aln, 5, [("tat", 2, 7), ("tat", 12, 18), ("nef", 9, 20)])


@operator("SEQ-08", "alignment", sql=f"""WITH {PROFILE}, k AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY share DESC, base) AS k
  FROM profile) SELECT pos, CASE WHEN max(share) >= 0.3 THEN max(base) FILTER (k = 1)
  ELSE concat(max(base) FILTER (k = 1), max(base) FILTER (k = 2)) END AS dominant FROM k GROUP BY pos""")
def _(aln):
    return a.dominant(aln, 0.3)


@operator("SEQ-09", "alignment", sql=f"WITH {PROFILE} SELECT seq_id, avg(share) AS score FROM alignment JOIN profile USING (pos, base) GROUP BY 1")
def _(aln):
    return a.alignment_score(aln, aln, True)


@operator("SEQ-09a", "alignment", sql="SELECT x.seq_id, avg(CAST(x.base = y.base AS INT)) AS score FROM alignment x JOIN alignment y ON y.seq_id = x.seq_id AND y.pos = x.pos + 1 GROUP BY 1")
def _(aln):
    return a.alignment_score(aln, aln.withColumn("pos", F.col("pos") - 1))


@operator("SEQ-10", "alignment", sql="""WITH o AS (SELECT pos, avg(CAST(base <> '-' AS INT)) AS o FROM alignment
  GROUP BY 1), n AS (SELECT pos, o, greatest(coalesce(lag(o) OVER (ORDER BY pos), 0), coalesce(lead(o) OVER (ORDER BY pos), 0)) AS beside FROM o),
k AS (SELECT pos, row_number() OVER (ORDER BY pos) AS new_pos FROM n WHERE NOT (o < 0.93 AND beside > o)) SELECT seq_id, new_pos, base FROM alignment JOIN k USING (pos)""")  # fmt: skip
def _(aln):
    return a.drop_sparse_columns(aln, 0.93)


@operator("SEQ-11", "fastq", sql="""WITH p AS (SELECT read_id AS seq_id, seq, unnest(range(1, length(seq) + 1)) AS pos FROM fastq),
  a AS (SELECT seq_id, pos, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS k FROM p WHERE seq[pos] = 'A'),
  m AS (SELECT a.seq_id, a.pos AS start, b.pos - a.pos + 1 AS length, (b.pos - a.pos) - (b.k - a.k) AS mismatches FROM a JOIN a b ON a.seq_id = b.seq_id AND b.pos >= a.pos + 5)
SELECT seq_id, start, max(length) AS length, arg_max(mismatches, length) AS mismatches FROM m WHERE mismatches <= 2 GROUP BY 1, 2""")  # fmt: skip
def _(fastq):
    return a.a_rich_regions(fastq.select(F.col("read_id").alias("seq_id"), "seq"))


@operator("SEQ-12", "positions", sql="SELECT w AS window, count(pos) AS n FROM (SELECT unnest(range(0, 12001, 100)) AS w) LEFT JOIN positions ON pos // 100 * 100 = w GROUP BY w")
def _(positions):
    return a.window_counts(positions, 100, 12000)


@operator("SEQ-13", "positions", sql="""WITH d AS (SELECT sample, pos - (SELECT max(m) FROM (VALUES (431), (4658), (6043)) t(m) WHERE m <= pos) AS d FROM positions) SELECT sample, d // 100 * 100 AS bin, CASE WHEN d < 100 THEN 'near' WHEN d < 1000 THEN 'middle' ELSE 'far' END AS band, count(*) AS n FROM d WHERE d IS NOT NULL GROUP BY 1, 2, 3""")
def _(positions):
    return a.landmark_distance(positions, [431, 4658, 6043])


@operator("SEQ-14", "reads")
def _(reads):
    return a.cluster_reads(reads.select(F.col("file_offset").cast("string").alias("read_id"), "pos", "seq"))


CONSENSUS = """SELECT ub AS umi, count(*) AS reads, round_even(avg(pos), 0) AS mean, quantile_cont(pos, 0.5) AS median,
  max(pos) - min(pos) AS range, stddev_samp(pos) AS sd, count(DISTINCT cb) AS cells, arg_min(seq, (pos, CAST(file_offset AS VARCHAR))) AS sequence,
  CASE WHEN count(*) >= 10 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM reads WHERE ub IS NOT NULL GROUP BY 1"""


def _sites(reads):
    return a.cluster_consensus(reads.where("ub IS NOT NULL").select(F.col("ub").alias("umi"), F.col("cb").alias("cell"), "pos", "seq", F.col("file_offset").cast("string").alias("read_id")), "umi")


@operator("SEQ-15", "reads", sql=CONSENSUS)
def _(reads):
    return _sites(reads)


@operator("SEQ-15s", "reads", sql=f"""WITH s AS ({CONSENSUS}) SELECT sum(reads) AS positions, count(*) AS sites, 100 * (1 - count(*) / sum(reads)) AS reduction,
  count(*) FILTER (reads >= 3) AS confident, count(*) FILTER (cells > 1) AS several_cells, count(*) FILTER (reads >= 3 AND cells > 1) AS both, max(reads) AS largest FROM s""")
def _(reads):
    return a.consensus_summary(_sites(reads))


@operator("SEQ-16", "positions", sql="SELECT cell, umi, count(*) AS size, dense_rank() OVER (PARTITION BY cell ORDER BY umi) AS \"group\", max(pos) - min(pos) <= 10 AS consistent FROM positions GROUP BY 1, 2")
def _(positions):
    return a.umi_groups(positions)


@operator("SEQ-17", "reads", sql="""WITH m AS (SELECT cb AS cell, ub AS umi, pos // 30 * 30 AS pos, left(seq, CAST(20 + pos % 3 AS INT)) AS seq FROM reads WHERE ub IS NOT NULL),
  c AS (SELECT cell, umi, round_even(quantile_cont(pos, 0.5), 0) AS c FROM m GROUP BY 1, 2),
  t AS (SELECT cell, umi, pos, seq FROM m JOIN c USING (cell, umi) WHERE pos = c),
  s AS (SELECT cell, umi, arg_min(seq, (-n, seq)) AS sequence FROM (SELECT cell, umi, seq, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1, 2)
  SELECT cell, umi, min(pos) AS pos, count(*) AS reads, round_even(quantile_cont(length(seq), 0.5), 0) AS length, any_value(sequence) AS sequence
  FROM t JOIN s USING (cell, umi) GROUP BY 1, 2""")
def _(reads):
    pos = F.floor(F.col("pos") / 30) * 30
    return a.umi_consensus(reads.select(F.col("cb").alias("cell"), F.col("ub").alias("umi"), pos.alias("pos"), F.left("seq", (20 + F.col("pos") % 3).cast("int")).alias("seq")))


@operator("SEQ-18", "positions")
def _(positions):
    return a.round_to_common(positions, "cell")


BIAS = """bins AS (SELECT pos // 100 * 100 AS bin, count(*) FILTER (sample = 'A') AS a, count(*) FILTER (sample = 'N') AS b FROM positions
  GROUP BY 1), bias AS (SELECT *, log2((a + 1.0) / (b + 1.0)) AS log2_ratio FROM bins)"""


@operator("SEQ-19", "positions", sql=f"WITH {BIAS} SELECT *, CASE WHEN log2_ratio > 1 THEN 'a' WHEN log2_ratio < -1 THEN 'b' ELSE 'even' END AS bias FROM bias")
def _(positions):
    return a.bin_bias(positions, "A", "N")


@operator("SEQ-20", "positions", sql="""SELECT low, high, count(*) AS reads, count(DISTINCT umi) AS umis, count(DISTINCT cell) AS cells,
  count(DISTINCT concat(cell, umi)) AS pairs FROM positions JOIN (VALUES (0, 431), (431, 4658), (4658, 8252)) t(low, high) ON pos > low
  AND pos <= high GROUP BY 1, 2""")
def _(positions):
    return a.interval_counts(positions, [0, 431, 4658, 8252])


@operator("SEQ-21", "positions", sql=f"WITH {BIAS} SELECT corr(bin, log2_ratio) AS r FROM bias")
def _(positions):
    return a.distance_trend(a.bin_bias(positions, "A", "N"))


TARGETS = "SELECT DISTINCT gene, chrom, start_pos, end_pos FROM events_psi WHERE start_pos % 300 = 0"


@operator("PSI-01", "events_psi", sql=f"SELECT events_psi.* FROM events_psi JOIN ({TARGETS}) t USING (gene, chrom, start_pos, end_pos)")
def _(events):
    return a.find_exons(events, events.where("start_pos % 300 = 0").select("gene", "chrom", "start_pos", "end_pos").distinct())


MEAN = "list_avg([TRY_CAST(x AS DOUBLE) for x in string_split({c}, ',') if TRY_CAST(x AS DOUBLE) IS NOT NULL])"


@operator("PSI-02", "events_psi", sql=f"""SELECT o_orderkey, {MEAN.format(c='levels_1')} AS mean_1, {MEAN.format(c='levels_2')} AS mean_2,
  mean_1 - mean_2 AS delta, fdr < 0.05 AND abs(mean_1 - mean_2) > 0.1 AS significant FROM events_psi""")
def _(events):
    return a.psi_means(events).select("o_orderkey", "mean_1", "mean_2", "delta", "significant")


@operator("PSI-03", "events_psi", sql="""SELECT gene, coalesce(sum(inclusion), 0) AS inclusion, coalesce(sum(exclusion), 0) AS exclusion,
  count(DISTINCT cell) FILTER (inclusion + exclusion > 0) AS cells, sum(inclusion) / sum(inclusion + exclusion) AS psi
  FROM (SELECT concat('g', i) AS gene FROM range(0, 55) t(i)) LEFT JOIN events_psi USING (gene) GROUP BY gene""")
def _(events):
    return a.pseudobulk_psi(events, events.sparkSession.range(55).select(F.concat(F.lit("g"), F.col("id")).alias("gene")))


PSI4 = "SELECT gene, " + ", ".join(f"sum(CASE WHEN condition = {k} THEN {c} ELSE 0 END) AS {n}" for n, k, c in (("a", 0, "inclusion"), ("b", 0, "exclusion"), ("c", 1, "inclusion"), ("d", 1, "exclusion"))) + " FROM events_psi GROUP BY gene"


@operator("PSI-04", "events_psi", sql=f"""WITH t AS ({PSI4}) SELECT *, CASE WHEN b * c > 0 THEN a * d / (b * c) END AS odds_ratio, CASE
  WHEN a + b > 0 THEN a / (a + b) END - CASE WHEN c + d > 0 THEN c / (c + d) END AS delta FROM t""")
def _(events):
    return a.psi_table(events)


@operator("PSI-04p", "events_psi")
def _(events):
    return a.psi_test(events)


@operator("PSI-05", "events_psi", sql="""SELECT gene, cell, 'inclusion' AS isoform, sum(inclusion) AS n FROM events_psi GROUP BY 1, 2 UNION ALL
  SELECT gene, cell, 'exclusion', sum(exclusion) FROM events_psi GROUP BY 1, 2""")
def _(events):
    return a.psi_cells(events)


@operator("PSI-06", "events_psi", sql="SELECT cell, coalesce(sum(inclusion) FILTER (gene = 'g1'), 0) AS g1, coalesce(sum(inclusion) FILTER (gene = 'g2'), 0) AS g2 FROM events_psi GROUP BY cell")
def _(events):
    return a.psi_wide(events, ["g1", "g2"])


@operator("SP-01", "spots", sql="""WITH p AS (SELECT DISTINCT fov, y AS y1, x AS x1 FROM spots
  WHERE channel = 'ch0'), q AS (SELECT DISTINCT fov, y AS y2, x AS x2 FROM spots
  WHERE channel = 'ch1'), n AS (SELECT fov, y1, x1, y2, x2, (y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2) AS d2 FROM p JOIN q USING (fov)
  WHERE abs(y1 - y2) <= 4 AND abs(x1 - x2) <= 4)
SELECT fov, y1, x1, y2, x2, d2 FROM (SELECT *, row_number() OVER (PARTITION BY fov, y1, x1 ORDER BY d2, y2, x2) AS k1, row_number()
  OVER (PARTITION BY fov, y2, x2 ORDER BY d2, y1, x1) AS k2 FROM n WHERE d2 <= 16) WHERE k1 = 1 AND k2 = 1""")  # fmt: skip
def _(spots):
    return a.colocate(spots.where("channel = 'ch0'"), spots.where("channel = 'ch1'"), 4)


@operator("SP-02", "spots", sql="""WITH s AS (SELECT fov, y // 10 AS y, x // 10 AS x, max(CAST(channel = 'ch0' AS INT)) AS n,
  max(CAST(channel = 'ch1' AS INT)) AS e, max(CAST(channel = 'ch2' AS INT)) AS p FROM spots GROUP BY 1, 2, 3) SELECT fov, y, x, CASE
  WHEN e + p = 2 THEN 'US' WHEN e = 1 THEN 'SS' WHEN p = 0 THEN 'MS' END AS class FROM s WHERE n = 1""")
def _(spots):
    s = spots.select("fov", "channel", F.floor(F.col("y") / 10).alias("y"), F.floor(F.col("x") / 10).alias("x"))
    return a.spot_class(*[s.where(f"channel = 'ch{i}'") for i in range(3)])


LABELS = "SELECT DISTINCT fov, y, x, concat(fov, '_', CAST(floor(y / 100) AS INT)) AS cell_id FROM spots WHERE x < 250"


@operator("SP-03", "spots", sql=f"""WITH l AS ({LABELS}) SELECT fov, cell_id, area, ch0, ch1, total FROM (SELECT fov, cell_id, count(*) AS area FROM l
  GROUP BY 1, 2) LEFT JOIN (SELECT fov, cell_id, count(*) FILTER (channel = 'ch0') AS ch0, count(*) FILTER (channel = 'ch1') AS ch1, count(*) AS total
  FROM spots JOIN l USING (fov, y, x) GROUP BY 1, 2) USING (fov, cell_id)""")
def _(spots):
    labels = spots.sparkSession.sql(LABELS.replace("FROM spots", "FROM {spots}"), spots=spots)
    return a.spots_per_cell(spots, labels, ["ch0", "ch1"])


@operator("SP-04", "spots", sql="SELECT fov, sum(n) AS spots, count(*) AS channels, min(n) < 1600 AS skipped FROM (SELECT fov, channel, count(*) AS n FROM spots GROUP BY 1, 2) GROUP BY fov")
def _(spots):
    return a.field_totals(spots, 1600)
