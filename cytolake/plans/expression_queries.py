"""EX queries."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from cytolake.operators import expression as x
from cytolake.plans.registry import operator

CELLS = "(SELECT count(*) FROM cells)"
LOGS = "logs AS (SELECT cell, gene, n, ln(1 + 10000.0 * n / sum(n) OVER (PARTITION BY cell)) AS v FROM counts)"
MOMENTS = f"moments AS (SELECT gene, sum(v) / {CELLS} AS mean, (sum(v * v) - sum(v) * sum(v) / {CELLS}) / ({CELLS} - 1) AS variance FROM {{source}} GROUP BY gene)"
GROUPS = "members AS (SELECT cell, cluster, CASE WHEN condition = 'A' THEN 1 ELSE 2 END AS grp FROM cells)"


def _members(cells):
    return cells.select("cell", "cluster", F.when(F.col("condition") == "A", 1).otherwise(2).alias("group"))


def _n(cells) -> int:
    return cells.count()


@operator("EX-01", "counts", sql="""SELECT cell, count(*) AS genes, sum(n) AS umis, 100.0 * coalesce(sum(n) FILTER (gene IN ('g7', 'g17', 'g27')),
  0) / sum(n) AS mito_percent FROM counts WHERE n > 0 GROUP BY cell HAVING count(*) > 20 AND count(*) < 60 AND sum(n) < 20000 AND mito_percent < 5""")
def _(counts):
    return x.qc_cells(counts, F.col("gene").isin("g7", "g17", "g27"), (20, 60))


@operator("EX-02", "counts", sql="""WITH k AS (SELECT * FROM counts WHERE gene IN (SELECT gene FROM counts WHERE n > 0 GROUP BY gene
  HAVING count(*) >= 200)) SELECT * FROM k WHERE cell IN (SELECT cell FROM k GROUP BY cell HAVING count(*) >= 30)""")
def _(counts):
    return x.min_filter(counts, 200, 30)


@operator("EX-03", "counts", sql="SELECT * FROM counts WHERE cell NOT IN (SELECT cell FROM counts WHERE gene = 'g4' INTERSECT SELECT cell FROM counts WHERE gene IN ('g8', 'g9'))")
def _(counts):
    return x.drop_doublets(counts, ["g4"], ["g8", "g9"])


@operator("EX-04", "counts", sql="SELECT * FROM counts WHERE gene NOT IN ('g1', 'g2')")
def _(counts):
    return x.drop_features(counts, ["g1", "g2"])


@operator("EX-05", "counts", sql=f"WITH {LOGS} SELECT * FROM logs")
def _(counts):
    return x.log_normalize(counts)


@operator("EX-06", "counts", "cells", sql=f"""WITH {LOGS}, {MOMENTS.format(source='logs')}, d AS (SELECT *, variance / mean AS dispersion, ntile(20)
  OVER (ORDER BY mean, gene) AS bin FROM moments WHERE mean > 0),
z AS (SELECT gene, mean, dispersion, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY bin)) / stddev_samp(dispersion)
  OVER (PARTITION BY bin), 0) AS z FROM d) SELECT * FROM z ORDER BY round(z, 9) DESC, gene LIMIT 40""")  # fmt: skip
def _(counts, cells):
    return x.variable_genes(counts, _n(cells), 40)


@operator("EX-07", "counts", "cells", sql=f"SELECT gene, count(*) / {CELLS} AS rate FROM counts WHERE n > 0 GROUP BY gene HAVING count(*) / {CELLS} >= 0.13")
def _(counts, cells):
    return x.detected_genes(counts, _n(cells), 0.13)


@operator("EX-08", "counts")
def _(counts):
    return x.scale_pca(counts, [f"g{i}" for i in range(200)], 5)


@operator("EX-09", "counts", sql="SELECT cell, " + ", ".join(f"coalesce(max(n) FILTER (gene = '{g}'), 0) AS {g}" for g in ("g1", "g2", "nogene")) + " FROM counts GROUP BY cell")
def _(counts):
    return x.target_expression(counts, ["g1", "g2", "nogene"])


@operator("EX-10", "counts", sql="SELECT gene, count(*) FILTER (n > 0) AS cells, max(n) AS most FROM counts GROUP BY gene HAVING count(*) FILTER (n > 0) >= 150 AND max(n) >= 60")
def _(counts):
    return x.gene_filter(counts, 150, 60)


def ranksum(keys: str = "", join: str = "") -> str:
    """SQL over dense rows: every cell of the members by every gene."""
    k = f"{keys}, " if keys else ""
    return f"""dense AS (SELECT m.cell, {k}grp, g.gene, coalesce(n, 0) AS n FROM members m CROSS JOIN (SELECT DISTINCT gene FROM counts) g LEFT
  JOIN counts c ON c.cell = m.cell AND c.gene = g.gene {join}),
ranked AS (SELECT *, rank() OVER (PARTITION BY {k}gene ORDER BY n) + (count(*) OVER (PARTITION BY {k}gene, n) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {k}gene, n) AS t FROM dense),
sums AS (SELECT {k}gene, sum(r) FILTER (grp = 1) AS r1, count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 2) AS n2,
  sum(CAST(t AS DOUBLE) * t - 1) AS ties, avg(n) FILTER (grp = 1) AS mean_1, avg(n) FILTER (grp = 2) AS mean_2,
  avg(CAST(n > 0 AS INT)) FILTER (grp = 1) AS pct_1, avg(CAST(n > 0 AS INT)) FILTER (grp = 2) AS pct_2 FROM ranked GROUP BY {k}gene),
tests AS (SELECT {k}gene, u, CASE WHEN var > 0 THEN (u - n1 * n2 / 2.0 - sign(u - n1 * n2 / 2.0) * 0.5) / sqrt(var)
  ELSE 0 END AS z, mean_1, mean_2, pct_1, pct_2, ln((mean_1 + 1) / (mean_2 + 1)) / ln(2) AS log2fc
  FROM (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / (CAST(n1 + n2 AS DOUBLE) * (n1 + n2 - 1))) AS var FROM sums))"""


DE = ("gene", "u", "z", "log2fc", "mean_1", "mean_2")


@operator("EX-11", "counts", "cells", sql=f"WITH {GROUPS}, {ranksum()} SELECT {', '.join(DE)} FROM tests WHERE pct_1 >= 0.1 OR pct_2 >= 0.1")
def _(counts, cells):
    return x.rank_sum_de(counts, _members(cells)).select(*DE)


#: Cells of many counts against the others. Every gene has a test, so a two-sided p times their number stays below alpha beyond this z.
DEPTH = "members AS (SELECT cell, CASE WHEN sum(n) > 1000 THEN 1 ELSE 2 END AS grp FROM counts GROUP BY cell)"
ALPHA, GENES = 0.01, 200
Z_CUT = -NormalDist().inv_cdf(ALPHA / GENES / 2)


@operator("EX-12", "counts", sql=f"""WITH {DEPTH}, {ranksum()} SELECT gene, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM tests
  WHERE (pct_1 >= 0.1 OR pct_2 >= 0.1) AND abs(log2fc) > 0.5 AND abs(z) > {Z_CUT}""")
def _(counts):
    members = counts.groupBy("cell").agg(F.when(F.sum("n") > 1000, 1).otherwise(2).alias("group"))
    return x.significant(x.rank_sum_de(counts, members, n_genes=GENES), 0.5, ALPHA).select("gene", "direction")


@operator("EX-13", "counts", "cells", sql=f"WITH {GROUPS}, {ranksum('cluster')} SELECT cluster, {', '.join(DE)} FROM tests WHERE pct_1 >= 0.1 OR pct_2 >= 0.1")
def _(counts, cells):
    return x.rank_sum_de(counts, x.shared_clusters(_members(cells), "cluster"), keys=["cluster"]).select("cluster", *DE)


@operator("EX-14", "counts", "cells", sql=f"""WITH {GROUPS}, {ranksum('cluster')} SELECT gene, string_agg(DISTINCT cluster, ','
  ORDER BY cluster) AS clusters, count(DISTINCT cluster) AS n FROM tests WHERE (pct_1 >= 0.1 OR pct_2 >= 0.1) AND abs(z) > 1.5 GROUP BY gene""")
def _(counts, cells):
    return x.gene_presence(x.rank_sum_de(counts, x.shared_clusters(_members(cells), "cluster"), keys=["cluster"]).where("abs(z) > 1.5"), "cluster")


@operator("EX-15", "counts", "cells", sql="SELECT clone, gene, sum(n) AS n FROM counts JOIN cells USING (cell) GROUP BY 1, 2")
def _(counts, cells):
    return x.pseudobulk(counts, cells, "clone")


@operator("EX-16", "counts")
def _(counts):
    return x.module_score(x.log_normalize(counts), [f"g{i}" for i in range(10)])


@operator("EX-17", "cells", sql="""WITH q AS (SELECT quantile_cont(signal, 0.8) AS a, quantile_cont(score, 0.5) AS b FROM cells) SELECT cell, CASE
  WHEN signal > a THEN 'high' WHEN score > b THEN 'rich' ELSE 'other' END AS label FROM cells, q""")
def _(cells):
    return x.gate_labels(cells, [("high", "signal", 0.8), ("rich", "score", 0.5)]).select("cell", "label")


@operator("EX-18", "counts")
def _(counts):
    return x.cycle_score(x.log_normalize(counts), [f"g{i}" for i in range(10)], [f"g{i}" for i in range(20, 30)])


@operator("EX-19", "counts", "cells", sql=f"""WITH d AS (SELECT g.gene, cells.cell, coalesce(n, 0) AS n FROM cells CROSS JOIN (SELECT DISTINCT gene
  FROM counts) g LEFT JOIN counts c ON c.cell = cells.cell AND c.gene = g.gene),
r AS (SELECT gene, n, row_number() OVER (PARTITION BY gene ORDER BY n) AS k FROM d)
  SELECT gene, 2.0 * sum(k * n) / ({CELLS} * sum(n)) - ({CELLS} + 1.0) / {CELLS} AS gini, avg(n) AS mean,
  100.0 * count(*) FILTER (n > 0) / {CELLS} AS percent FROM r GROUP BY gene""")  # fmt: skip
def _(counts, cells):
    return x.gini(counts, _n(cells))


@operator("EX-20", "cells", sql="""WITH p AS (SELECT clone, cluster, count(*) / sum(count(*)) OVER (PARTITION BY clone) AS p FROM cells GROUP BY 1, 2)
  SELECT clone, sum(-p * ln(p)) AS shannon, 1 - sum(p * p) AS simpson, count(*) AS types FROM p GROUP BY clone""")
def _(cells):
    return x.diversity(cells, "clone", "cluster")


@operator("EX-20b", "counts", "cells", sql=f"""WITH s AS (SELECT cell, gene, n AS v FROM counts), {MOMENTS.format(source='s')}
  SELECT avg(sqrt(variance) / mean) AS mean_cv, quantile_cont(sqrt(variance) / mean, 0.5) AS median_cv FROM moments""")
def _(counts, cells):
    return x.gene_variation(counts, _n(cells))


@operator("EX-21", "counts", "cells", sql="""WITH d AS (SELECT g.gene, c.cell, signal, coalesce(n, 0) AS n FROM cells c CROSS
  JOIN (SELECT DISTINCT gene FROM counts) g LEFT JOIN counts k ON k.cell = c.cell AND k.gene = g.gene WHERE signal > 0 OR n > 0),
r AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY n) + (count(*) OVER (PARTITION BY gene, n) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY gene
  ORDER BY signal) + (count(*) OVER (PARTITION BY gene, signal) - 1) / 2.0 AS ry FROM d)
SELECT gene, count(*) AS cells, corr(rx, ry) AS rho FROM r GROUP BY gene HAVING count(*) >= 10 AND count(DISTINCT n) > 1 AND count(DISTINCT signal) > 1""")  # fmt: skip
def _(counts, cells):
    return x.signal_correlation(counts, cells).select("gene", "cells", "rho")


@operator("EX-22", "cells", sql="""WITH d AS (SELECT signal, unnest(['score', 'x', 'other']) AS metric, unnest([score, x, CAST(other AS DOUBLE)]) AS value FROM cells),
r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rx, rank()
  OVER (PARTITION BY metric ORDER BY signal) + (count(*) OVER (PARTITION BY metric, signal) - 1) / 2.0 AS ry FROM d)
SELECT metric, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY metric""")  # fmt: skip
def _(cells):
    return x.metric_correlation(cells, ["score", "x", "other"], "signal")


@operator("EX-23", "assay_a", "assay_b", sql="""WITH a AS (SELECT cell, count(*) AS a FROM assay_a WHERE umi < 'u2'
  GROUP BY 1), b AS (SELECT cell, count(*) AS b FROM assay_b WHERE umi < 'u15'
  GROUP BY 1), j AS (SELECT cell, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM a FULL JOIN b USING (cell)),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j)
SELECT count(*) AS n, corr(a, b) AS pearson, corr(ra, rb) AS spearman, corr(ln(1 + a), ln(1 + b)) AS log1p, corr(log2(a), log2(b)) FILTER (a > 0 AND b > 0) AS log2 FROM r""")  # fmt: skip
def _(a, b):
    per = lambda d, top: d.where(f"umi < '{top}'").groupBy("cell").agg(F.count("*").alias("n"))
    return x.assay_correlation(per(a, "u2"), per(b, "u15"), "full")


ES = """s AS (SELECT gene_set, gene FROM gene_sets SEMI JOIN spectra USING (gene)), ok AS (SELECT gene_set, count(*) AS size FROM s GROUP BY 1 HAVING count(*) BETWEEN 10 AND 500),
k AS (SELECT pattern, gene, v, row_number() OVER (PARTITION BY pattern ORDER BY v DESC, gene) AS k FROM spectra),
steps AS (SELECT k.pattern, ok.gene_set, k.k, s.gene IS NOT NULL AS hit, CASE WHEN s.gene IS NULL THEN 0 ELSE abs(v) END AS w FROM k CROSS JOIN ok
  LEFT JOIN s ON s.gene_set = ok.gene_set AND s.gene = k.gene),
run AS (SELECT pattern, gene_set, hit, sum(w) OVER u / sum(w) OVER p - CAST(sum(CAST(NOT hit AS INT)) OVER u AS DOUBLE) / sum(CAST(NOT hit AS INT))
  OVER p AS y FROM steps WINDOW p AS (PARTITION BY pattern, gene_set), u AS (PARTITION BY pattern, gene_set ORDER BY k)),
es AS (SELECT pattern, gene_set, count(*) FILTER (hit) AS size, CASE WHEN max(y) >= -least(min(y), 0) THEN max(y) ELSE min(y) END AS es FROM run GROUP BY 1, 2 HAVING count(*) FILTER (hit) > 0)"""


@operator("EX-24", "spectra", "gene_sets", sql=f"WITH {ES} SELECT * FROM es")
def _(scores, sets):
    return x.enrichment_scores(scores, sets)


@operator("EX-24p", "spectra", "gene_sets")
def _(scores, sets):
    return x.gsea(scores, sets, 20)


@operator("EX-25", "spectra", "gene_sets", sql="""WITH bg AS (SELECT DISTINCT gene FROM spectra), q AS (SELECT DISTINCT gene FROM spectra
  WHERE v > 1600) SELECT gene_set, count(*) AS size, count(q.gene) AS overlap, coalesce(string_agg(q.gene, ',' ORDER BY q.gene), '') AS genes
FROM (SELECT DISTINCT gene_set, gene FROM gene_sets) s SEMI JOIN bg USING (gene) LEFT JOIN q ON q.gene = s.gene GROUP BY gene_set HAVING count(*) BETWEEN 10 AND 500""")  # fmt: skip
def _(scores, sets):
    return x.ora(scores.where("v > 1600"), sets, scores).select("gene_set", "size", "overlap", "genes")


@operator("EX-26", "spectra", sql="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY v DESC, gene) AS rank FROM spectra) WHERE rank <= 10")
def _(scores):
    return x.top_genes(scores, 10)


@operator("EX-27", "spectra", sql="""WITH s AS (SELECT gene, pattern, v / 1000 AS v FROM spectra), t AS (SELECT *, (SELECT max(o.v) FROM s o
  WHERE o.gene = s.gene AND o.pattern <> s.pattern) AS other FROM s)
SELECT gene, pattern, round(CASE WHEN stddev_samp(v) OVER g > 1e-9 THEN (v - avg(v) OVER g) / stddev_samp(v) OVER g
  ELSE 0 END * v, 9) AS weighted_z, exp(v) / sum(exp(v)) OVER g AS softmax, rank() OVER (PARTITION BY gene ORDER BY v DESC) * rank()
  OVER (PARTITION BY pattern ORDER BY v DESC) AS rank_product, v / other AS ratio FROM t WINDOW g AS (PARTITION BY gene)""")  # fmt: skip
def _(scores):
    return x.pattern_markers(scores.withColumn("v", F.col("v") / 1000)).withColumn("weighted_z", F.round("weighted_z", 9) + 0.0)


USAGE = "usage AS (SELECT cell, concat('p', CAST(substr(gene, 2) AS INT) % 4) AS pattern, CAST(sum(n) AS DOUBLE) AS v FROM counts GROUP BY 1, 2)"


def _usage(counts):
    return counts.groupBy("cell", F.concat(F.lit("p"), F.substring("gene", 2, 9).cast("int") % 4).alias("pattern")).agg(F.sum("n").cast("double").alias("v"))


@operator("EX-28", "counts", "cells", sql=f"""WITH {USAGE}, {GROUPS}, sizes AS (SELECT count(*) FILTER (grp = 1) AS n1, count(*) FILTER (grp = 2) AS n2 FROM members)
SELECT pattern, sum(v) FILTER (grp = 1) / any_value(n1) AS mean_1, sum(v) FILTER (grp = 2) / any_value(n2) AS mean_2, quantile_cont(v,
  0.5) FILTER (grp = 1) AS median_1, quantile_cont(v, 0.5) FILTER (grp = 2) AS median_2 FROM usage JOIN members USING (cell), sizes GROUP BY pattern""")  # fmt: skip
def _(counts, cells):
    return x.compare_usage(_usage(counts), _members(cells)).select("pattern", "mean_1", "mean_2", "median_1", "median_2")


@operator("EX-29", "counts", "cells", sql=f"""WITH {USAGE} SELECT cell, signal, max(v) FILTER (pattern = 'p0') AS p0,
  max(v) FILTER (pattern = 'p1') AS p1 FROM cells LEFT JOIN usage USING (cell) GROUP BY 1, 2""")
def _(counts, cells):
    return x.attach_usage(cells.select("cell", "signal"), _usage(counts), ["p0", "p1"])


@operator("EX-30", "counts", sql="SELECT DISTINCT cell FROM counts WHERE gene IN ('g3', 'g5') AND n > 0")
def _(counts):
    return x.expressed_any(counts, ["g3", "g5"])


DOT = "list_sum([p * q FOR p, q IN list_zip])"


@operator("EX-31", "points", sql="""WITH p AS (SELECT cell, [abs(CAST(e AS DOUBLE)) / list_sum([abs(CAST(y AS DOUBLE)) for y in embedding]) for e in embedding] AS s, cluster FROM points),
pair AS (SELECT a.cell, a.s AS x, b.s AS y FROM p a CROSS JOIN p b WHERE a.cluster = 0 AND b.cluster = 1)
SELECT cell, min(list_sum([(CASE WHEN x[i] > 0 THEN x[i] * log2(2 * x[i] / (x[i] + y[i])) ELSE 0 END + CASE
  WHEN y[i] > 0 THEN y[i] * log2(2 * y[i] / (x[i] + y[i])) ELSE 0 END) / 2 for i in range(1, len(x) + 1)])) AS js FROM pair GROUP BY cell""")  # fmt: skip
def _(points):
    return x.min_js(points.where("cluster = 0"), points.where("cluster = 1"))


@operator("EX-32", "points", sql="""WITH pair AS (SELECT a.cell, b.cell AS other, unnest(a.embedding) AS p, unnest(b.embedding) AS q FROM points a
  CROSS JOIN points b WHERE a.cluster = 0 AND b.cluster = 1)
SELECT cell, max(r * r) AS r2 FROM (SELECT cell, other, corr(CAST(p AS DOUBLE), CAST(q AS DOUBLE)) AS r FROM pair GROUP BY 1, 2) GROUP BY cell""")  # fmt: skip
def _(points):
    return x.max_r2(points.where("cluster = 0"), points.where("cluster = 1"))


@operator("EX-32i", "points", sql="""WITH pair AS (SELECT a.cell, b.cell AS other, unnest(a.embedding) AS p, unnest(b.embedding) AS q FROM points a
  JOIN points b ON a.cell <> b.cell WHERE a.cluster = 0 AND b.cluster = 0)
SELECT cell, max(r * r) AS r2 FROM (SELECT cell, other, corr(CAST(p AS DOUBLE), CAST(q AS DOUBLE)) AS r FROM pair GROUP BY 1, 2) GROUP BY cell""")  # fmt: skip
def _(points):
    own = points.where("cluster = 0")
    return x.max_r2(own, own, apart=True)


@operator("EX-32r", "points")
def _(points):
    own = points.where("cluster = 0")
    return x.max_r2_null(own, points.where("cluster > 1"), own.count())


SILHOUETTE = """
WITH e AS (
  SELECT a.cell, a.cluster AS own, b.cluster AS other, count(*) AS n,
    sum(list_sum([(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) ** 2 for i in range(1, len(a.embedding) + 1)])) AS s
  FROM points a JOIN points b ON a.cell <> b.cell GROUP BY 1, 2, 3
), m AS (SELECT cell, max(s / n) FILTER (own = other) AS a, min(s / n) FILTER (own <> other) AS b FROM e GROUP BY cell)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 9) AS silhouette FROM m"""


@operator("EX-33", "points", sql=SILHOUETTE)
def _(points):
    return x.silhouette(points, "cluster").select(F.round("silhouette", 9).alias("silhouette"))


@operator("EX-34", "cells", sql="SELECT cluster, condition, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY condition) AS share FROM cells GROUP BY 1, 2")
def _(cells):
    return x.crosstab(cells, "cluster", "condition")


@operator("EX-35", "cells", sql="""WITH r AS (SELECT condition, cluster, other, rank() OVER (PARTITION BY condition ORDER BY other) + (count(*)
  OVER (PARTITION BY condition, other) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY condition, other) AS t FROM cells),
s AS (SELECT condition, cluster, sum(r) AS r, count(*) AS k, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r
  GROUP BY 1, 2), n AS (SELECT condition, sum(k) AS n, count(*) AS groups, sum(r * r / k) AS q, sum(ties) AS ties FROM s GROUP BY 1)
SELECT condition, n, groups, (12.0 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM n""")  # fmt: skip
def _(cells):
    return x.kruskal(cells, "other", "cluster", "condition").select("condition", F.col("n").cast("bigint").alias("n"), "groups", "h")


COEF = "SELECT gene, CAST(sum(n) % 200 AS DOUBLE) / 100 - 1 AS value FROM counts WHERE {where} GROUP BY gene"
BAND = "CASE " + " ".join(f"WHEN {{v}} > {lo} AND {{v}} <= {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(x.BANDS, x.BANDS[1:]), 1)) + " END"


@operator("EX-36", "counts", sql=f"""WITH a AS ({COEF.format(where='n < 40')}), b AS ({COEF.format(where="n > 30 AND gene <> 'g9'")}) SELECT {BAND.format(v='a.value')} AS "from", {BAND.format(v='b.value')} AS "to", count(*) AS genes FROM a LEFT JOIN b USING (gene) GROUP BY 1, 2""")
def _(counts):
    coef = lambda where: counts.sparkSession.sql(COEF.format(where=where).replace("FROM counts", "FROM {counts}"), counts=counts)
    return x.band_transitions(coef("n < 40"), coef("n > 30 AND gene <> 'g9'"))


@operator("EX-37", "cells", sql="""SELECT cluster AS metric, avg(score) AS mean, quantile_cont(score, 0.5) AS median, count(*) AS samples,
  count(*) FILTER (x / 100 < 0.05) AS significant FROM cells GROUP BY 1""")
def _(cells):
    return x.metric_summary(cells.select(F.col("cluster").alias("metric"), F.col("score").alias("rho"), (F.col("x") / 100).alias("p")))


@operator("EX-38", "spectra", "gene_sets", sql=f"WITH {ES} SELECT gene_set, " + ", ".join(f"coalesce(max(es) FILTER (pattern = '{p}'), 0) AS {p}" for p in ("p0", "p1", "p9")) + " FROM es GROUP BY gene_set")
def _(scores, sets):
    return x.score_matrix(x.enrichment_scores(scores, sets), ["p0", "p1", "p9"])


@operator("EX-39", "cells", sql="SELECT cell, coalesce(signal > 2 OR other > 3, FALSE) AS inside FROM cells")
def _(cells):
    return x.split_cells(cells, (F.col("signal") > 2) | (F.col("other") > 3))


@operator("EX-40", "cells", sql="""WITH d AS (SELECT signal - other AS d, abs(signal - other) AS m FROM cells
  WHERE signal <> other), r AS (SELECT d, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r, count(*)
  OVER (PARTITION BY m) AS t FROM d),
s AS (SELECT count(*) AS n, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r)
  SELECT n, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s""")  # fmt: skip
def _(cells):
    return x.paired_rank_test(cells, "signal", "other").select("n", "w", "z")


@operator("EX-41", "cells", sql="SELECT cluster, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y FROM cells GROUP BY cluster")
def _(cells):
    return x.cluster_centres(cells)
