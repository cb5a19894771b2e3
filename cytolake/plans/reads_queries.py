"""RD queries. The view's CIGAR strings are match, gap, match, so the twins take them apart by one pattern."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.functions import cigar as c
from cytolake.operators import reads as r
from cytolake.plans.registry import operator

RB = r"""rb AS (SELECT *, pos + a AS g0, pos + a + b AS g1, pos + a + b + m AS e1 FROM (SELECT *, CAST(regexp_extract(cigar, '^(\d+)M(\d+)N(\d+)M$', 1) AS INT) AS a,
  CAST(regexp_extract(cigar, '^(\d+)M(\d+)N(\d+)M$', 2) AS INT) AS b, CAST(regexp_extract(cigar, '^(\d+)M(\d+)N(\d+)M$', 3) AS INT) AS m FROM reads))"""


def ov(s: str, e: str, lo: object, hi: object) -> str:
    return f"greatest(0, least({e}, {hi}) - greatest({s}, {lo}))"


ROW = "SELECT name, file_offset FROM"
GROUP_REGIONS = "1000, 5000"


def _row(df):
    return df.select("name", "file_offset")


@operator("RD-01", "reads", sql=f"{ROW} reads WHERE xf IN (17, 25)")
def _(reads):
    return _row(r.where_xf(reads, (17, 25)))


@operator("RD-02", "reads", sql=f"{ROW} reads WHERE flag & 2308 = 0")
def _(reads):
    return _row(r.where_primary(reads))


@operator("RD-03", "reads", sql=f"WITH {RB} SELECT file_offset, pos AS start_1, g0 AS end_1, g1 AS start_2, e1 AS end_2, g0 AS gap_start, g1 AS gap_end FROM rb")
def _(reads):
    b, g = F.col("blocks"), F.col("gaps")
    return r.with_blocks(reads).select("file_offset", b[0]["start"].alias("start_1"), b[0]["end"].alias("end_1"), b[1]["start"].alias("start_2"), b[1]["end"].alias("end_2"), g[0]["start"].alias("gap_start"), g[0]["end"].alias("gap_end"))


@operator("RD-04", "reads", sql=f"WITH {RB} SELECT name, file_offset, pos AS start, e1 AS \"end\", '+' AS strand, a + m AS aligned FROM rb")
def _(reads):
    return r.read_span(reads)


@operator("RD-05", "reads", sql=f"WITH {RB} {ROW} rb WHERE ref = 'chr1' AND {ov('g1', 'e1', 1000, 5000)} >= 20")
def _(reads):
    return _row(r.last_block_overlap(reads, "chr1", 1000, 5000))


@operator("RD-06", "reads", sql=f"WITH {RB} {ROW} rb WHERE ref = 'chr1' AND {ov('g1', 'e1', 1000, 5000)} + {ov('pos', 'g0', 1000, 5000)} >= 20")
def _(reads):
    return _row(r.total_overlap(reads, "chr1", 1000, 5000))


@operator("RD-07", "reads", sql=f"{ROW} reads WHERE ref = 'chr1' AND pos < 5000 AND pos + 20 > 1000")
def _(reads):
    return _row(r.start_overlap(reads, "chr1", 1000, 5000))


@operator("RD-08", "reads", sql=f"WITH {RB} SELECT b >= 500 AS has_intron, count(*) AS n FROM rb GROUP BY 1")
def _(reads):
    return r.has_intron(reads, 500).groupBy("has_intron").agg(F.count("*").alias("n"))


@operator("RD-09", "reads", "regions", sql=f"WITH {RB} SELECT target, count(*) AS reads FROM rb JOIN regions ON ref = chrom AND {ov('g1', 'e1', 'start_pos', 'end_pos')} >= 20 GROUP BY target")
def _(reads, regions):
    return r.region_counts(reads, regions)


@operator("RD-10", "reads", sql=f"""WITH {RB} SELECT cb, ub, count(*) AS reads FROM rb WHERE xf = 25 AND cb IS NOT NULL AND ub IS NOT NULL
  AND ref = 'chr1' AND {ov('g1', 'e1', 1000, 5000)} >= 20 GROUP BY 1, 2""")
def _(reads):
    return r.umi_read_counts(reads, "chr1", 1000, 5000)


@operator("RD-11", "reads", sql="SELECT cb, count(*) AS reads FROM reads WHERE cb IS NOT NULL AND ref = 'chr1' AND pos < 5000 AND pos + 20 > 1000 GROUP BY 1")
def _(reads):
    return r.cell_read_counts(reads, "chr1", 1000, 5000)


@operator("RD-12", "reads", sql=f"""WITH {RB} SELECT CASE WHEN ref = 'chr1'
  AND ({ov('g1', 'e1', 1000, 5000)} > 0 OR {ov('pos', 'g0', 1000, 5000)} > 0) THEN 'inside'
  ELSE 'outside' END AS side, cb, ub AS umi, count(*) AS reads FROM rb WHERE cb IS NOT NULL AND ub IS NOT NULL GROUP BY 1, 2, 3""")
def _(reads):
    return r.split_inside_outside(reads, "chr1", 1000, 5000)


@operator("RD-13", "reads", sql="SELECT " + ", ".join(f"xf & {b} > 0 AS {n}" for n, b in r.XF_BITS.items()) + ", count(*) AS reads FROM reads WHERE xf IS NOT NULL GROUP BY ALL")
def _(reads):
    return r.flag_census(reads)


@operator("RD-14", "reads", "valid_cells", sql=f"{ROW} reads WHERE xf = 25 AND cb IN (SELECT cell FROM valid_cells)")
def _(reads, cells):
    return _row(r.filter_cells(reads, cells.select(F.col("cell").alias("cb"))))


@operator("RD-15", "reads", sql="SELECT DISTINCT cb FROM reads WHERE cb IS NOT NULL AND flag & 4 = 0")
def _(reads):
    return r.distinct_cells(reads)


REQUESTS = "SELECT DISTINCT cell, 2000 AS donor, 5000 AS acceptor FROM valid_cells UNION ALL SELECT 'none', 10, 20"


@operator("RD-16", "reads", "valid_cells", sql=f"""WITH {RB}, q AS ({REQUESTS}) SELECT cell, donor, acceptor, count(*) FILTER (pos >= donor - 1000
  AND pos <= acceptor + 1000) AS near, count(*) FILTER (pos < acceptor AND e1 > donor) AS over FROM q LEFT JOIN rb ON cell = cb GROUP BY 1, 2, 3""")
def _(reads, cells):
    return r.cell_region_counts(reads, reads.sparkSession.sql(REQUESTS.replace("valid_cells", "{cells}"), cells=cells))


@operator("RD-17", "reads", sql=f"WITH {RB} SELECT (a + b + m) // 50 * 50 AS bin, count(*) AS reads FROM rb GROUP BY 1")
def _(reads):
    return r.length_histogram(reads)


@operator("RD-18", "fastq", sql="""SELECT greatest(0, length(seq) - length(regexp_extract(left(seq, 100), '^(.*T{4,})',
  1)) - length(regexp_extract(right(seq, 100), '(A{4,}.*)$', 1))) AS length, count(*) AS reads FROM fastq
  WHERE contains(seq, 'ACGA') OR contains(seq, 'TCGT') GROUP BY 1""")
def _(fastq):
    return r.trimmed_length_histogram(fastq, min_run=4, motif="ACGA")


J = f"{RB}, j AS (SELECT cb, ub, cigar, ref, g0 - 1 AS donor, g1 AS acceptor, substr(seq, a + 1, m) AS seq_after, pos AS match_start, g0 AS match_end FROM rb WHERE b >= 1000 AND a >= 20)"


@operator("RD-19", "reads", sql=f"WITH {J} SELECT * FROM j")
def _(reads):
    return r.splice_junctions(reads)


@operator("RD-20", "reads", sql=f"WITH {RB} SELECT ref, g0 - 1 AS donor, g1 AS acceptor FROM rb WHERE b BETWEEN 50 AND 2000 AND a >= 20")
def _(reads):
    return r.splice_junctions(reads, 50, 20, 2000).select("ref", "donor", "acceptor")


@operator("RD-21", "reads", sql=f"WITH {RB} SELECT ref, g0 - 1 AS donor, g1 AS acceptor FROM rb WHERE b >= 50 AND a >= 20 AND ref = 'chr2'")
def _(reads):
    return r.splice_junctions(reads, 50, reference="chr2").select("ref", "donor", "acceptor")


@operator("RD-22", "reads", sql=f"""WITH {J} SELECT cb, ref, donor, acceptor, match_start, match_end, coalesce(string_agg(DISTINCT ub, ';'
  ORDER BY ub), '') AS umis, array_to_string(list_sort(list(DISTINCT cigar))[1:3], ';') AS cigars, count(*) AS reads FROM j GROUP BY ALL""")
def _(reads):
    return r.consolidate_junctions(r.splice_junctions(reads))


def site(column: str, sites: dict[str, int]) -> str:
    best = f"(SELECT min_by(l, (abs({column} - p), k)) FROM (VALUES {', '.join(f'({k}, {p!r}, {label!r})' for k, (label, p) in enumerate(sites.items()))}) s(k, p, l))"
    least = "least(" + ", ".join(f"abs({column} - {p})" for p in sites.values()) + ")"
    return f"CASE WHEN {column} IS NULL THEN 'nc' WHEN {least} <= 3 THEN {best} WHEN {least} <= 12 THEN 'mnc' ELSE 'nc' END"


S = f"{J}, s AS (SELECT DISTINCT cb, ub, {site('donor', r.DONORS)} AS donor_site, {site('acceptor', r.ACCEPTORS)} AS acceptor_site, 'target' AS target FROM j)"


@operator("RD-23", "reads", sql=f"WITH {J} SELECT donor, {site('donor', r.DONORS)} AS donor_site, {site('acceptor', r.ACCEPTORS)} AS acceptor_site FROM j")
def _(reads):
    return r.splice_junctions(reads).select("donor", r.classify_site(F.col("donor"), r.DONORS).alias("donor_site"), r.classify_site(F.col("acceptor"), r.ACCEPTORS).alias("acceptor_site"))


@operator("RD-24", "reads", sql=f"WITH {S} SELECT * FROM s WHERE donor_site = 'mnc'")
def _(reads):
    return r.site_table(r.splice_junctions(reads), "mnc").select("cb", "ub", "donor_site", "acceptor_site", "target")


@operator("RD-25", "reads", sql=f"""WITH {J}, t AS (SELECT donor, acceptor, count(*) AS n, string_agg(DISTINCT ref, ',' ORDER BY ref) AS files FROM j
  GROUP BY 1, 2) SELECT donor, acceptor, n, files FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS k FROM t) WHERE k <= 10""")
def _(reads):
    return r.junction_summary(r.splice_junctions(reads))


@operator("RD-26", "reads", sql=f"WITH {S} SELECT cb, count(*) AS events, count(*) FILTER (donor_site IN ('nc', 'mnc') OR acceptor_site IN ('nc', 'mnc')) AS noncanonical FROM s GROUP BY cb")
def _(reads):
    return r.events_per_cell(r.site_table(r.splice_junctions(reads), None))


@operator("RD-27", "reads", "valid_cells", sql=f"""WITH {J} SELECT cb, donor, acceptor, count(*) AS n FROM j WHERE cb IN (SELECT cell
  FROM valid_cells) AND {site('donor', r.DONORS)} = 'nc' AND {site('acceptor', r.ACCEPTORS)} = 'nc' GROUP BY 1, 2, 3""")
def _(reads, cells):
    return r.noncanonical(r.splice_junctions(reads), cells.select(F.col("cell").alias("cb")), "both")


def anyblock(lo: int, hi: int, least: int) -> str:
    return f"({ov('pos', 'g0', lo, hi)} >= {least} OR {ov('g1', 'e1', lo, hi)} >= {least})"


def isoform(t: int) -> str:
    ms_free, ss_free = f"NOT {anyblock(6043 + t, 8252 - t, 1)}", f"NOT {anyblock(431 + t, 4658 - t, 1)}"
    return f"""CASE WHEN {anyblock(431 - t, 4658 + t, 50)} THEN 'US' WHEN {ms_free} AND {anyblock(-t, 6043 + t, 1)} AND {anyblock(8252 - t, r.FAR, 1)} THEN 'MS'
  WHEN {ss_free} AND {anyblock(6043 + t, 8252 - t, 1)} AND {anyblock(-t, 431 + t, 1)} AND {anyblock(6043 - t, 8252 + t, 1)} THEN 'SS' ELSE 'any' END"""


@operator("RD-28", "reads", sql=f"WITH {RB} SELECT file_offset, {isoform(10)} AS isoform FROM rb")
def _(reads):
    return reads.select("file_offset", r.classify_isoform(c.aligned_blocks(F.col("cigar"), F.col("pos"))).alias("isoform"))


LR = f"""lr AS (SELECT cb, coalesce(ub, ur, '') AS umi, {isoform(10)} AS isoform FROM (SELECT *, row_number()
  OVER (PARTITION BY cb, coalesce(ub, ur, '') ORDER BY file_offset) AS k FROM rb WHERE flag & 2308 = 0 AND cb IS NOT NULL) WHERE k = 1)"""


@operator("RD-29", "reads", sql=f"WITH {RB}, {LR} SELECT * FROM lr")
def _(reads):
    return r.isoform_calls(reads)


def span_class(s: str, e: str, t: int = 5) -> str:
    meets = lambda lo, hi, n: f"{ov(s, e, lo - t, hi + t)} >= {n}"
    open_ = lambda lo, hi: f"NOT ({s} <= {lo + t} AND {e} >= {hi - t})"
    return f"""CASE WHEN {meets(985, 5212, 50)} THEN 'US' WHEN {meets(0, 6597, 1)} AND {open_(6597, 8806)} AND {meets(8806, r.FAR, 1)} THEN 'MS'
  WHEN {meets(0, 985, 1)} AND {open_(985, 5212)} AND {meets(6597, 8806, 1)} THEN 'SS' ELSE 'any' END"""


@operator("RD-30", "spans", sql=f"SELECT cell, umi, {span_class('start_pos', 'end_pos')} AS isoform FROM spans")
def _(spans):
    return spans.select("cell", "umi", r.classify_span(F.col("start_pos"), F.col("end_pos")).alias("isoform"))


BEST = """best AS (SELECT cell, umi, chrom, start_pos, end_pos, strand, aligned
  FROM (SELECT *, row_number() OVER (PARTITION BY cell, umi ORDER BY aligned DESC, start_pos, end_pos, chrom, strand) AS k FROM spans) WHERE k = 1)"""
PAIRS = f"""{BEST}, pairs AS (SELECT *, overlap_bp / least(end_1 - start_1, end_2 - start_2) AS overlap_share
  FROM (SELECT a.cell, a.umi AS umi_1, b.umi AS umi_2, a.start_pos AS start_1, a.end_pos AS end_1, b.start_pos AS start_2, b.end_pos AS end_2,
  {ov('a.start_pos', 'a.end_pos', 'b.start_pos', 'b.end_pos')} AS overlap_bp, greatest(0, greatest(a.start_pos, b.start_pos) - least(a.end_pos, b.end_pos)) AS gap_bp,
  greatest(a.end_pos, b.end_pos) - least(a.start_pos, b.start_pos) AS combined_span, greatest(a.end_pos, b.end_pos) - least(a.start_pos,
  b.start_pos) - greatest(a.end_pos - a.start_pos, b.end_pos - b.start_pos) AS span_gain
  FROM best a JOIN best b ON a.cell = b.cell AND a.chrom = b.chrom AND a.strand = b.strand AND a.umi < b.umi))"""
REL = f"""{PAIRS}, rel AS (SELECT *, CASE WHEN (start_1 <= start_2 AND end_1 >= end_2) OR (start_2 <= start_1 AND end_2 >= end_1) THEN 'NESTED' WHEN overlap_share > 0.5 THEN 'REDUNDANT'
  WHEN overlap_bp <= 50 AND gap_bp <= 200 AND span_gain >= 100 THEN 'COMPLEMENTARY' ELSE 'DISTANT' END AS relationship FROM pairs)"""


def _pairs(spans):
    return r.classify_pair(r.fragment_pairs(r.best_fragment(spans)))


def _stitched(spans):
    best = r.best_fragment(spans)
    return r.stitched_molecules(best, r.classify_pair(r.fragment_pairs(best, near=200)).where("relationship = 'COMPLEMENTARY'"))


@operator("RD-31", "spans", sql=f"WITH {BEST} SELECT * FROM best")
def _(spans):
    return r.best_fragment(spans)


@operator("RD-32", "spans", sql=f"WITH {PAIRS} SELECT * FROM pairs")
def _(spans):
    return r.fragment_pairs(r.best_fragment(spans))


@operator("RD-33", "spans", sql=f"WITH {REL} SELECT cell, umi_1, umi_2, relationship FROM rel")
def _(spans):
    return _pairs(spans).select("cell", "umi_1", "umi_2", "relationship")


@operator("RD-34", "spans", sql=f"WITH {REL} SELECT cell, " + ", ".join(f"count(*) FILTER (relationship = '{x}') AS {x.lower()}" for x in ("NESTED", "REDUNDANT", "COMPLEMENTARY", "DISTANT")) + " FROM rel GROUP BY cell")
def _(spans):
    return r.pair_summary(_pairs(spans))


# Components by walking the edges from every fragment: RECURSIVE holds for all views of the statement.
MOL = f"""{REL}, e AS (SELECT cell, umi_1 AS a, umi_2 AS b FROM rel WHERE relationship = 'COMPLEMENTARY' UNION SELECT cell, umi_2, umi_1 FROM rel WHERE relationship = 'COMPLEMENTARY'),
walk(cell, umi, seen) AS (SELECT cell, umi, umi FROM best UNION SELECT walk.cell, walk.umi, e.b FROM walk JOIN e ON e.cell = walk.cell AND e.a = walk.seen),
mol AS (SELECT best.*, molecule_id FROM best JOIN (SELECT cell, umi, min(seen) AS molecule_id FROM walk GROUP BY 1, 2) USING (cell, umi)),
merged AS (SELECT cell, molecule_id, count(*) AS fragments, min(start_pos) AS merged_start, max(end_pos) AS merged_end, sum(aligned) AS aligned FROM mol GROUP BY 1, 2)"""


@operator("RD-35", "spans", sql=f"WITH RECURSIVE {MOL} SELECT * FROM merged")
def _(spans):
    return r.merged_molecules(_stitched(spans))


@operator("RD-36", "spans", sql=f"""WITH RECURSIVE {MOL} SELECT cell, molecule_id, umi, row_number() OVER w AS position, lead(start_pos)
  OVER w - end_pos AS to_next FROM mol WINDOW w AS (PARTITION BY cell, molecule_id ORDER BY start_pos, end_pos, umi)""")
def _(spans):
    return r.molecule_chains(_stitched(spans))


@operator("RD-37", "spans", sql=f"""WITH RECURSIVE {MOL} SELECT {span_class('merged_start', 'merged_end')} AS isoform, fragments > 1 AS stitched,
  count(*) AS molecules, count(DISTINCT cell) AS cells, max(fragments) AS most_fragments FROM merged GROUP BY 1, 2""")
def _(spans):
    return r.stitch_stats(r.merged_molecules(_stitched(spans)))


REP = """(SELECT cb, ub, gx, name AS best FROM (SELECT *, row_number() OVER (PARTITION BY cb, ub, gx
  ORDER BY mapq DESC, as_score DESC, name DESC) AS k FROM reads WHERE cb IS NOT NULL AND ub IS NOT NULL AND gx IS NOT NULL {more}) WHERE k = 1)"""


@operator("RD-38", "reads", sql=f"SELECT cb, ub, gx, best AS name FROM {REP.format(more='')}")
def _(reads):
    return r.umi_representatives(reads)


@operator("RD-39", "reads", sql=f"""SELECT file_offset, name, (CASE WHEN flag & 4 = 0 THEN 1 ELSE 0 END) + (CASE WHEN gx IS NOT NULL THEN 16
  ELSE 0 END) + (CASE WHEN nh > 1 THEN 4 ELSE 0 END) + (CASE WHEN name = best THEN 8 ELSE 0 END) AS xf FROM reads LEFT
  JOIN {REP.format(more='AND mapq >= 200')} USING (cb, ub, gx)""")
def _(reads):
    return r.add_xf(reads, 200)


@operator("RD-40", "reads", sql="""WITH g AS (SELECT DISTINCT name, gx FROM reads WHERE gx IS NOT NULL AND flag & 256 = 0 AND flag & 2048 = 0)
  SELECT a.gx AS gene_1, b.gx AS gene_2, count(*) AS reads FROM g a JOIN g b ON a.name = b.name AND a.gx < b.gx GROUP BY 1, 2""")
def _(reads):
    return r.multimap_gene_pairs(reads)


@operator("RD-40s", "reads", sql="""WITH p AS (SELECT * FROM reads WHERE flag & 256 = 0 AND flag & 2048 = 0), m AS (SELECT count(*) AS multimapped FROM (SELECT name FROM p GROUP BY name HAVING count(DISTINCT gx) > 1))
  SELECT count(*) AS reads, any_value(multimapped) AS multimapped, 100.0 * any_value(multimapped) / count(*) AS percent FROM p, m""")
def _(reads):
    return r.multimap_share(reads)


@operator("RD-41", "reads", sql="""SELECT gx, ref, pos, count(*) AS reads FROM reads WHERE gx IS NOT NULL AND flag & 256 = 0 AND flag & 2048 = 0 AND name IN (SELECT name FROM reads
  WHERE flag & 256 = 0 AND flag & 2048 = 0 GROUP BY name HAVING count(DISTINCT gx) > 1) GROUP BY 1, 2, 3""")
def _(reads):
    return r.multimap_positions(reads)


@operator("RD-42", "reads")
def _(reads):
    return r.equalise(r.where_xf(reads, (25,)), r.where_xf(reads, (17,)), "file_offset", 7).select("side", "name", "file_offset")


CALLS = "SELECT cb AS cell, coalesce(ub, ur, '') AS umi, isoform FROM"
SR = """sr AS (SELECT cell, umi, CASE min(CASE WHEN category LIKE 'US%' THEN 1 WHEN category LIKE 'MS%' THEN 2 WHEN category LIKE 'SS%' THEN 3
  ELSE 4 END) WHEN 1 THEN 'US' WHEN 2 THEN 'MS' WHEN 3 THEN 'SS' ELSE 'any' END AS isoform FROM molecules GROUP BY 1, 2)"""
BOTH = f"{RB}, {LR}, {SR}, both_ AS (SELECT cell, sr.umi, lr.isoform AS lr, sr.isoform AS sr FROM lr JOIN sr ON lr.cb = sr.cell AND lr.umi = sr.umi)"


def _calls(reads, molecules):
    return r.isoform_calls(reads).withColumnRenamed("cb", "cell"), r.collapse_calls(molecules)


@operator("RD-43", "reads", "molecules", sql=f"WITH {BOTH} SELECT * FROM both_ WHERE lr <> sr AND sr = 'MS'")
def _(reads, molecules):
    return r.discordant(*_calls(reads, molecules), sr_class="MS")


@operator("RD-44", "molecules", sql=f"WITH {SR} SELECT * FROM sr")
def _(molecules):
    return r.collapse_calls(molecules)


@operator("RD-45", "reads", "corrections", sql="""SELECT cb, ub, name, file_offset FROM (SELECT *, row_number() OVER (PARTITION BY cb, ub
  ORDER BY file_offset) AS k FROM reads SEMI JOIN corrections ON cb = cell AND ub = umi) WHERE k = 1""")
def _(reads, keys):
    return r.reads_for_keys(reads, keys)


@operator("RD-46", "reads", "molecules", sql=f"WITH {BOTH} SELECT count(*) AS n, avg(CAST(lr = sr AS INT)) AS \"all\", avg(CASE WHEN lr <> 'any' THEN CAST(lr = sr AS INT) END) AS long_called, avg(CASE WHEN sr <> 'any' THEN CAST(lr = sr AS INT) END) AS short_called FROM both_")
def _(reads, molecules):
    return r.call_agreement(*_calls(reads, molecules))


BAR = "SELECT concat('r', o_orderkey) AS name, concat('c', o_custkey) AS cell, concat('u', o_orderkey % 99) AS umi FROM orders WHERE o_orderkey % 3 > 0"


@operator("RD-47", "reads", "orders", sql=f"SELECT file_offset, name, cell AS cb, umi AS ub FROM reads LEFT JOIN ({BAR}) USING (name)")
def _(reads, orders):
    bar = orders.sparkSession.sql(BAR.replace("FROM orders", "FROM {orders}"), orders=orders)
    return r.attach_barcodes(reads.select("file_offset", "name"), bar)


@operator("RD-48", "fastq", sql="SELECT read_id, substr(seq, 1, 16) AS cell, substr(seq, 17, 12) AS umi FROM fastq WHERE length(seq) >= 28")
def _(fastq):
    return r.extract_barcode_umi(fastq)


#: Reads as mates: odd lines first mates, with strands, proper pairs and unmapped ones.
MATES = """SELECT name, ref, pos, mapq, seq, file_offset, CAST(1 + CASE WHEN nh % 2 = 1 THEN 64 ELSE 128 END + CASE WHEN pos % 3 > 0 THEN 2 ELSE 0 END
  + CASE WHEN mapq % 2 = 0 THEN 16 ELSE 0 END + CASE WHEN mapq % 29 = 0 THEN 4 ELSE 0 END + CASE WHEN nh = 7 THEN 256 ELSE 0 END AS INT) AS flag FROM reads"""
MATE_PAIRS = f"""m AS (SELECT *, CASE WHEN flag & 64 > 0 THEN 1 ELSE 2 END AS mate FROM ({MATES}) WHERE flag & 4 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, mate ORDER BY file_offset DESC, ref DESC, pos DESC, mapq DESC, length(seq) DESC, flag DESC) AS k FROM m) WHERE k = 1),
pairs AS (SELECT a.name, a.ref AS ref_1, a.pos AS pos_1, a.mapq AS mapq_1, length(a.seq) AS length_1, a.flag & 16 > 0 AS reverse_1, b.ref AS ref_2, b.pos AS pos_2, b.mapq AS mapq_2,
  length(b.seq) AS length_2, b.flag & 16 > 0 AS reverse_2, a.flag & 2 > 0 AND b.flag & 2 > 0 AS proper, a.ref = b.ref AS same_ref, CASE WHEN a.ref = b.ref THEN abs(a.pos - b.pos) END AS distance
  FROM l a JOIN l b ON a.name = b.name AND a.mate = 1 AND b.mate = 2 WHERE a.flag & 256 = 0 AND b.flag & 256 = 0)"""


def _mate_pairs(reads):
    return r.pair_reads(reads.sparkSession.sql(MATES.replace("FROM reads", "FROM {reads}"), reads=reads))


@operator("RD-49", "reads", sql=f"WITH {MATE_PAIRS} SELECT * FROM pairs")
def _(reads):
    return _mate_pairs(reads)


@operator("RD-49s", "reads", sql=f"""WITH {MATE_PAIRS} SELECT count(*) AS pairs, count(*) FILTER (proper) AS proper, avg(CAST(proper AS INT)) AS proper_share, count(*) FILTER (same_ref) AS same_ref,
  avg(CAST(same_ref AS INT)) AS same_ref_share, count(*) FILTER (reverse_1 = reverse_2) AS same_strand, avg(CAST(reverse_1 = reverse_2 AS INT)) AS same_strand_share, avg(mapq_1) AS mapq_1, avg(mapq_2) AS mapq_2,
  avg(length_1) AS length_1, avg(length_2) AS length_2, count(DISTINCT ref_1) AS refs_1, count(DISTINCT ref_2) AS refs_2, avg(distance) AS mean_distance, quantile_cont(distance, 0.5) AS median_distance,
  min(distance) AS min_distance, max(distance) AS max_distance, count(*) FILTER (distance <= 1000) AS within_1000 FROM pairs""")
def _(reads):
    return r.mate_summary(_mate_pairs(reads))


TAIL = """t AS (SELECT *, left(seq, length(seq) - 28) AS body, right(seq, 16) AS cell, left(right(seq, 28), 12) AS umi FROM reads WHERE length(seq) >= 28),
n AS (SELECT *, coalesce(list_max([k FOR k IN range(6, length(body) + 1) IF 3 * (k - length(replace(right(body, k), 'A', ''))) >= 2 * k]), 0) AS tail_length FROM t)"""


@operator("RD-50", "reads", sql=f"""WITH {TAIL} SELECT name, cell, umi, tail_length, CASE
  WHEN tail_length > 0 THEN (tail_length - length(replace(right(body, tail_length), 'A', ''))) / tail_length END AS a_share, left(body,
  length(body) - tail_length) AS genomic FROM n""")
def _(reads):
    return r.polya_structure(reads)


REFERENCE = "ACGTTGCAAGCTTACGGATCCATGCAAT"
HAMMING = " OR ".join(f"len([i FOR i IN range(1, 21) IF substr(right(seq, 20), i, 1) <> substr('{REFERENCE[k:k + 20]}', i, 1)]) <= 11" for k in range(len(REFERENCE) - 19))


@operator("RD-51", "reads", sql=f"SELECT file_offset, {HAMMING} AS terminal FROM reads")
def _(reads):
    return reads.select("file_offset", r.classify_terminal(F.col("seq"), REFERENCE, distance=11).alias("terminal"))


@operator("RD-52", "reads", sql=f"""WITH {TAIL} SELECT count(*) AS reads, count(*) FILTER (tail_length > 0) AS tails, count(DISTINCT cell) AS cells,
  count(DISTINCT umi) AS umis, avg(nullif(tail_length, 0)) AS mean_length, quantile_cont(nullif(tail_length, 0), 0.5) AS median_length,
  max(nullif(tail_length, 0)) AS max_length FROM n""")
def _(reads):
    return r.polya_summary(r.polya_structure(reads))


@operator("RD-53", "reads")
def _(reads):
    return r.polya_best_window(reads)
