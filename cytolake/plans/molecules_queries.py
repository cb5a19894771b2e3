"""CAT queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import molecules as m
from cytolake.plans.registry import operator

RAW = ("US", "SS", "MS", "any-D4", "any-A7", "US-SS", "SS-MS4")
CLASSES = ("us", "ss", "ms")

POOLED = "pooled AS (SELECT cell, umi, category, sum(read_count) AS read_count FROM (SELECT DISTINCT cell, umi, category, read_count FROM molecules) GROUP BY cell, umi, category)"
PAIRS = "pairs(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in m.RESOLVED_PAIRS) + ")"


def resolved(source: str, keys: str = "cell, umi") -> str:
    """SQL: one category per molecule of source."""
    g = f"SELECT {keys}, min(category) AS lo, max(category) AS hi, count(DISTINCT category) AS k, sum(read_count) AS read_count FROM {source} GROUP BY {keys}"
    return f"""SELECT {keys}, CASE WHEN k = 1 THEN lo ELSE b END AS category, read_count FROM ({g}) g
  LEFT JOIN pairs ON k = 2 AND ((a = lo AND b = hi) OR (a = hi AND b = lo)) WHERE k = 1 OR b IS NOT NULL"""


def collapsed(source: str, keys: str = "cell, umi") -> str:
    return f"SELECT {keys}, CASE WHEN category LIKE 'any%' THEN 'any' WHEN category LIKE 'SS-MS%' THEN 'SS-MS' ELSE category END AS category, read_count FROM {source}"


FILES = """concat('/d/', l_returnflag, '_', CASE l_linenumber % 4 WHEN 0 THEN 'PL_pol' WHEN 1 THEN 'D1_env' WHEN 2 THEN 'SSenv'
  ELSE 'tat' END, '_bamsort_alignment_', CASE l_suppkey % 6 WHEN 0 THEN 'D1_A1' WHEN 1 THEN 'A1_D4' WHEN 2 THEN 'D4_A7' WHEN 3 THEN 'A7_LTR'
  WHEN 4 THEN 'LTR_D1' ELSE 'other' END, '.csv')"""


@operator("CAT-01", "lineitem", sql=f"""
WITH f AS (SELECT DISTINCT {FILES} AS path, l_linenumber % 4 AS t, l_suppkey % 6 AS r FROM lineitem)
SELECT path, CASE WHEN t = 0 THEN 'US' WHEN r = 4 THEN 'any-D1' WHEN r = 0 THEN 'US' WHEN r = 1 THEN CASE WHEN t = 1 THEN 'SS-MS4' ELSE 'any-D4' END
  WHEN r = 2 THEN CASE WHEN t = 1 THEN 'SS' ELSE 'US-SS' END WHEN r = 3 THEN CASE t WHEN 1 THEN 'SS-MS7' WHEN 2 THEN 'US-SS' ELSE 'MS' END END AS category FROM f""")  # fmt: skip
def _(lineitem):
    return lineitem.select(F.expr(FILES).alias("path")).distinct().withColumn("category", m.category_of_file(F.col("path")))


HOST = "concat('S', l_returnflag, '_GENE', l_partkey % 20, CASE WHEN l_linenumber = 1 THEN '.2' ELSE '' END, '_bamsort_alignment_GENE', (l_partkey + l_suppkey % 2) % 20, '.csv')"


@operator("CAT-02", "lineitem", sql=f"SELECT DISTINCT {HOST} AS path, CASE WHEN l_suppkey % 2 = 0 THEN concat('GENE', l_partkey % 20) END AS category FROM lineitem")
def _(lineitem):
    return lineitem.select(F.expr(HOST).alias("path")).distinct().withColumn("category", m.category_of_host_file(F.col("path")))


@operator("CAT-03", "molecules", sql=f"WITH {POOLED} SELECT * FROM pooled")
def _(mol):
    return m.pool_counts(mol)


@operator("CAT-04", "molecules", sql=f"WITH {POOLED} SELECT cell, " + ", ".join(f"""count(DISTINCT umi) FILTER (category = '{c}') AS "{c}_umis", coalesce(sum(read_count) FILTER (category = '{c}'), 0) AS "{c}_reads" """ for c in RAW) + " FROM pooled GROUP BY cell")
def _(mol):
    return m.wide_counts(m.pool_counts(mol), RAW)


@operator("CAT-05", "molecules", "valid_cells", sql=f"WITH {POOLED} SELECT * FROM pooled WHERE cell IN (SELECT cell FROM valid_cells)")
def _(mol, cells):
    return m.valid_cells(m.pool_counts(mol), cells)


FIXED = """fixed AS (SELECT cell, umi, CASE WHEN c.cell IS NULL THEN category ELSE 'MS' END AS category, read_count FROM pooled LEFT
  JOIN (SELECT cell, umi FROM corrections) c USING (cell, umi) WHERE c.umi IS NULL OR category IN ('US-SS', 'any-A7', 'SS', 'MS'))"""


@operator("CAT-06", "molecules", "corrections", sql=f"WITH {POOLED}, {FIXED} SELECT * FROM fixed".replace("c.cell IS NULL", "c.umi IS NULL"))
def _(mol, corrections):
    return m.apply_corrections(m.pool_counts(mol), corrections)


@operator("CAT-07", "molecules", sql=f"WITH {POOLED}, {PAIRS} {resolved('pooled')}")
def _(mol):
    return m.resolve_multimap(m.pool_counts(mol))


@operator("CAT-08", "molecules", sql=f"WITH {POOLED}, {PAIRS}, r AS ({resolved('pooled')}) {collapsed('r')}")
def _(mol):
    return m.collapse_categories(m.resolve_multimap(m.pool_counts(mol)))


@operator("CAT-09", "molecules", "valid_cells", "corrections", sql=f"""
WITH pooled AS (SELECT sample, cell, umi, category, sum(read_count) AS read_count FROM (SELECT DISTINCT sample, cell, umi, category, read_count
  FROM molecules) WHERE cell IN (SELECT cell FROM valid_cells) GROUP BY ALL),
fixed AS (SELECT sample, cell, umi, CASE WHEN c.n IS NULL THEN category ELSE 'MS' END AS category, read_count FROM pooled LEFT
  JOIN (SELECT cell, umi, 1 AS n FROM corrections) c USING (cell, umi) WHERE c.n IS NULL OR category IN ('US-SS', 'any-A7', 'SS', 'MS')),
{PAIRS}, r AS ({resolved('fixed', 'sample, cell, umi')}) {collapsed('r', 'sample, cell, umi')}""")  # fmt: skip
def _(mol, cells, corrections):
    return m.process_samples(mol, cells, corrections)


MATRIX = f"""WITH {POOLED}, {PAIRS}, r AS ({resolved('pooled')}), k AS ({collapsed('r')}),
w AS (SELECT cell, sum(read_count) AS reads, {', '.join(f"count(*) FILTER (category = '{c}') AS c{i}" for i, c in enumerate(m.MODES['SALVE']))} FROM k
  WHERE read_count >= 5 GROUP BY cell HAVING sum(read_count) >= 100),
z AS (SELECT cell, {', '.join(f"CASE WHEN (SELECT count(*) FROM w WHERE c{i} > 0) >= 3 THEN c{i} ELSE 0 END AS c{i}" for i in range(6))} FROM w)
SELECT cell, {', '.join(f'c{i} AS "{c}"' for i, c in enumerate(m.MODES['SALVE']))}, {' + '.join(f'c{i}' for i in range(6))} AS total FROM z
WHERE {' + '.join(f'CAST(c{i} > 0 AS INT)' for i in range(6))} >= 2 AND {' + '.join(f'c{i}' for i in range(6))} >= 3"""


@operator("CAT-10", "molecules", sql=MATRIX)
def _(mol):
    return m.cell_matrix(m.collapse_categories(m.resolve_multimap(m.pool_counts(mol))), min_reads=5, min_region_count=2, min_umi=3, min_cells=3, min_reads_cell=100)


@operator("CAT-11", "molecules", sql=f"""WITH {POOLED}, {PAIRS}, r AS ({resolved('pooled')}), k AS ({collapsed('r')}) SELECT cell, umi FROM k
  WHERE cell IN (SELECT cell FROM k GROUP BY cell HAVING count(*) >= 20)""")
def _(mol):
    k = m.collapse_categories(m.resolve_multimap(m.pool_counts(mol)))
    return m.valid_umis(k, m.cell_matrix(k, min_umi=20))


MERGED = """merged AS (SELECT cell, umi, CASE WHEN a.category IS NULL THEN b.category WHEN b.category IS NULL THEN a.category WHEN a.category = b.category THEN a.category
  WHEN a.category IN ('US', 'SS', 'MS') AND b.category NOT IN ('US', 'SS', 'MS') THEN a.category WHEN b.category IN ('US', 'SS', 'MS')
  AND a.category NOT IN ('US', 'SS', 'MS') THEN b.category ELSE 'any' END AS category
  FROM assay_a a FULL JOIN assay_b b USING (cell, umi))"""


@operator("CAT-12", "assay_a", "assay_b", sql=f"WITH {MERGED} SELECT * FROM merged")
def _(a, b):
    return m.resolve_assays(a, b)


@operator("CAT-13", "assay_a", "assay_b", sql=f"""WITH {MERGED} SELECT cell, count(*) FILTER (category = 'US') AS "US", count(*) FILTER (category = 'SS') AS "SS", count(*) FILTER (category = 'MS') AS "MS", ln(1 + count(*) FILTER (category IN ('US', 'SS', 'MS'))) AS total FROM merged GROUP BY cell""")
def _(a, b):
    return m.assay_matrix(m.resolve_assays(a, b), ("US", "SS", "MS"))


@operator("CAT-14", "valid_cells", "shaved", "assay_a", "assay_b", sql="""
WITH k AS (SELECT cell, min(barcode) AS barcode FROM shaved WHERE reads > 6 GROUP BY cell), a AS (SELECT cell, count(*) AS n FROM assay_a
  WHERE umi < 'u3' GROUP BY cell), b AS (SELECT cell, count(*) AS n FROM assay_b WHERE umi < 'u2' GROUP BY cell)
SELECT cell, coalesce(barcode, 'none') AS barcode, ln(1 + coalesce(a.n, 0)) AS total_a, ln(1 + coalesce(b.n, 0)) AS total_b FROM valid_cells LEFT
  JOIN k USING (cell) LEFT JOIN a USING (cell) LEFT JOIN b USING (cell)""")  # fmt: skip
def _(cells, shaved, a, b):
    clones = shaved.where("reads > 6").groupBy("cell").agg(F.min("barcode").alias("barcode"))
    return m.joint_table(cells, clones, a.where("umi < 'u3'").groupBy("cell").agg(F.count("*").alias("total_a")), b.where("umi < 'u2'").groupBy("cell").agg(F.count("*").alias("total_b")))


@operator("CAT-15", "cells", sql="SELECT cell, signal, other, signal > 3 AS first, other > 2 AS second FROM (SELECT cell, signal, other FROM cells) WHERE NOT (signal > 3 AND other > 2)")
def _(cells):
    wide = cells.select("cell", "signal", "other", F.expr("signal - 3").alias("CD4"), F.expr("other - 2").alias("CD8A"), F.expr("CAST(NULL AS BIGINT)").alias("CD8B"))
    return m.marker_gate(wide, ["CD4"], ["CD8A", "CD8B"]).select("cell", "signal", "other", "first", "second")


@operator("CAT-16", "cells", sql="""SELECT identity, count(*) AS n FROM (SELECT CASE WHEN signal > 0 AND other > 0 THEN 'both'
  WHEN signal > 0 THEN 'a' WHEN other > 0 THEN 'b' ELSE 'neither' END AS identity FROM cells) GROUP BY identity""")
def _(cells):
    return m.identity_class(cells, "signal", "other").groupBy("identity").agg(F.count("*").alias("n"))


@operator("CAT-17", "assay_a", "assay_b", sql="""
SELECT 'molecule' AS level, *, shared / a AS share_of_a, shared / b AS share_of_b FROM (SELECT (SELECT count(*) FROM assay_a) AS a, (SELECT count(*)
  FROM assay_b) AS b, (SELECT count(*) FROM assay_a JOIN assay_b USING (cell, umi)) AS shared)
UNION ALL SELECT 'cell', *, shared / a, shared / b FROM (SELECT (SELECT count(DISTINCT cell) FROM assay_a) AS a, (SELECT count(DISTINCT cell)
  FROM assay_b) AS b, (SELECT count(DISTINCT cell) FROM assay_a SEMI JOIN assay_b USING (cell)) AS shared)""")  # fmt: skip
def _(a, b):
    return m.recovery(a, b)


@operator("CAT-18", "assay_a", "assay_b", sql="""SELECT a.category AS "from", b.category AS "to", count(*) AS n, (a.category, b.category) IN (('MS', 'MS'), ('SS', 'US'), ('any-D4', 'US')) AS expected FROM assay_a a JOIN assay_b b USING (cell, umi) GROUP BY 1, 2""")
def _(a, b):
    return m.category_transitions(a, b, a.sparkSession.createDataFrame([("MS", "MS"), ("SS", "US"), ("any-D4", "US")], "from string, to string"))


@operator("CAT-19", "class_cells", sql="""SELECT dataset, cell, class, CASE WHEN us + ss + ms = 0 THEN 0.0 ELSE v / (us + ss + ms) END AS share
  FROM (SELECT *, unnest(['us', 'ss', 'ms']) AS class, unnest([us, ss, ms]) AS v FROM class_cells)""")
def _(wide):
    return m.proportions(wide, CLASSES, ["dataset", "cell"])


@operator("CAT-20", "class_cells", sql="""SELECT dataset, target, avg(v) AS mean, count(v) AS n
  FROM (SELECT dataset, unnest(['us', 'ss']) AS target, unnest([us, ss]) AS v FROM class_cells) GROUP BY 1, 2""")
def _(wide):
    return m.composition(wide, ["us", "ss"], "dataset")


@operator("CAT-21", "counts", "cells", sql="""WITH s AS (SELECT cell, sum(n) AS n FROM counts GROUP BY cell ORDER BY n DESC, cell LIMIT 500)
  SELECT cell, n, row_number() OVER (ORDER BY n DESC, cell) AS rank, cell IN (SELECT cell FROM cells WHERE signal = 0) AS listed, n >= 100 AS enough
  FROM s""")
def _(counts, cells):
    return m.barcode_rank(counts, cells.where("signal = 0"), top=500)


@operator("CAT-22", "counts", sql="SELECT cell, sum(n) AS n FROM counts GROUP BY cell HAVING sum(n) > 1000")
def _(counts):
    return m.cells_over(counts, 1000)


@operator("CAT-23", "counts", "cells", sql="SELECT DISTINCT gene, cell FROM counts WHERE n > 0 AND cell IN (SELECT cell FROM cells WHERE signal = 1)")
def _(counts, cells):
    return m.cells_per_gene(counts, cells.where("signal = 1").select(F.concat("cell", F.lit("-1")).alias("cell")))


@operator("CAT-24", "class_cells", sql="""SELECT dataset, class, sum(v) AS n, 100.0 * sum(v) / sum(sum(v)) OVER (PARTITION BY dataset) AS percent
  FROM (SELECT dataset, unnest(['us', 'ss', 'ms']) AS class, unnest([us, ss, ms]) AS v FROM class_cells) GROUP BY 1, 2""")
def _(wide):
    return m.class_composition(wide, CLASSES)


@operator("CAT-25", "class_cells", sql="""SELECT dataset, count(*) AS cells, avg(us / (us + ss + ms)) AS mean, quantile_cont(us / (us + ss + ms),
  0.5) AS median, stddev_samp(us / (us + ss + ms)) AS sd FROM class_cells WHERE us + ss + ms > 0 GROUP BY dataset""")
def _(wide):
    return m.cell_proportions(wide, "us", CLASSES)


@operator("CAT-26", "class_cells", sql="""SELECT dataset, CASE WHEN 2 * us > us + ss + ms THEN 'us' WHEN 2 * ss > us + ss + ms THEN 'ss'
  WHEN 2 * ms > us + ss + ms THEN 'ms' ELSE 'mixed' END AS class, count(*) AS cells FROM class_cells WHERE us + ss + ms > 0 GROUP BY 1, 2""")
def _(wide):
    return m.dominant_class(wide, CLASSES)


@operator("CAT-27", "assay_a", "assay_b", sql="SELECT * FROM assay_a ANTI JOIN assay_b USING (cell, umi)")
def _(a, b):
    return m.molecules_minus(a, b)


@operator("CAT-28", "molecules", sql="""
WITH p AS (SELECT cell, umi, bool_or(category = 'US') AS us, bool_or(category = 'SS') AS ss, bool_or(category = 'MS') AS ms FROM molecules GROUP BY 1, 2)
SELECT cell, count(*) FILTER (us) AS "US", count(*) FILTER (ss) AS "SS", count(*) FILTER (ms) AS "MS", count(*) FILTER (us OR ss) AS union_umis,
  count(*) FILTER ((us OR ss) AND NOT ms) AS union_minus FROM p GROUP BY cell""")  # fmt: skip
def _(mol):
    return m.target_sets(mol, ["US", "SS"], "MS", ["US", "SS", "MS"])


@operator("CAT-29", "class_cells", sql="SELECT cell, sum(us) AS us, sum(ss) AS ss, sum(ms) AS ms, sum(us + ss + ms) AS total, ln(1 + sum(us + ss + ms)) AS log_total FROM class_cells GROUP BY cell")
def _(wide):
    return m.sum_over_samples(wide, CLASSES)


STATS = """stats AS (SELECT concat('s', l_suppkey % 12) AS sample, concat('t', l_partkey % 6) AS target,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n, concat('p', l_suppkey % 3) AS pool, concat('t', l_suppkey % 6) AS own
FROM lineitem WHERE l_partkey % 12 <> l_suppkey % 5 GROUP BY l_suppkey % 12, l_partkey % 6, l_suppkey % 3, l_suppkey % 6)"""


def _stats(lineitem):
    return lineitem.sparkSession.sql(f"WITH {STATS.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM stats", lineitem=lineitem)


@operator("CAT-30", "lineitem", sql=f"""WITH {STATS}, o AS (SELECT target, sum(n) AS on_target, min(pool) AS owner_pool FROM stats WHERE target = own GROUP BY 1),
f AS (SELECT * FROM stats JOIN o USING (target) WHERE target <> own), g AS (SELECT target, avg(n) AS mean, stddev_samp(n) AS sd FROM f WHERE pool <> owner_pool GROUP BY 1)
SELECT sample, target, n, 100.0 * n / on_target AS percent, n / mean AS fold, (n - mean) / sd AS z, n > mean + 2 * sd AS flagged FROM f LEFT
  JOIN g USING (target) WHERE pool = owner_pool""")  # fmt: skip
def _(lineitem):
    return m.index_hopping(_stats(lineitem))


@operator("CAT-31", "lineitem", sql=f"""WITH {STATS}, b AS (SELECT target, max(n) AS background FROM stats WHERE target <> own GROUP BY 1)
  SELECT sample, target, n, coalesce(background, 0) AS background, n - coalesce(background, 0) AS signal FROM stats LEFT JOIN b USING (target)
  WHERE target = own""")
def _(lineitem):
    return m.signal_background(_stats(lineitem))


@operator("CAT-32", "cells", sql="SELECT cluster, 100.0 * sum(signal) / sum(other) AS ratio, 100.0 * count(*) FILTER (signal > 3) / count(*) AS percent_over FROM cells GROUP BY cluster")
def _(cells):
    return m.signal_ratio(cells, "signal", "other", "cluster", 3)


@operator("CAT-33", "cells", sql="""SELECT cluster, avg(CASE WHEN other = 0 THEN 0.0 ELSE signal / other END) AS ratio, count(*) FILTER (signal > 0
  AND other > 0) AS both, count(*) FILTER (signal > 0 AND other <= 0) AS only_a, count(*) FILTER (signal <= 0
  AND other > 0) AS only_b, count(*) FILTER (signal <= 0 AND other <= 0) AS neither FROM cells GROUP BY cluster""")
def _(cells):
    return m.normalised_overlap(cells, "signal", "other", "cluster")


@operator("CAT-34", "fastq", sql="""WITH p AS (SELECT index_part AS cell, substr(seq, 1, 4) AS umi, count(*) AS n,
  count(*) FILTER (NOT contains(index_part, 'N')) AS clean FROM fastq GROUP BY 1, 2)
  SELECT cell, sum(n) AS rows, count(*) FILTER (clean > 1) AS repeated, sum(clean) = 0 AS lost FROM p GROUP BY cell""")
def _(fastq):
    return m.ambiguity_screen(fastq.select(F.col("index_part").alias("cell"), F.substring("seq", 1, 4).alias("umi")))
