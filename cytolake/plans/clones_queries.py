"""CL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import clones as k, distances as d
from cytolake.plans.registry import operator

DIST = "sqrt(list_sum([(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) for i in range(1, len(a.embedding) + 1)]))"

#: Random sets of CL-06 and of CL-12 and permutations of CL-19, as many as their references take.
NULL_SETS, RANDOM_SETS, SWAPS = 100, 200, 1000


@operator("CL-01", "cells", sql="SELECT a.clone, a.cell AS cell_1, b.cell AS cell_2 FROM cells a JOIN cells b ON a.clone = b.clone AND a.cell < b.cell")
def _(cells):
    return k.all_pairs(cells)


@operator("CL-01t", "cells")
def _(cells):
    return k.twin_pairs(cells, 3)


#: The first and the last of each fifty customers, so pairs grow with the table.
TWINS = "twins AS (SELECT concat('c', min(c_custkey)) AS cell_1, concat('c', max(c_custkey)) AS cell_2 FROM customer GROUP BY floor(c_custkey / 50) HAVING count(*) > 1)"


def _twins(customer):
    ends = customer.groupBy(F.floor(F.col("c_custkey") / 50)).agg(F.min("c_custkey").alias("a"), F.max("c_custkey").alias("b")).where("a < b")
    return ends.select(F.concat(F.lit("c"), "a").alias("cell_1"), F.concat(F.lit("c"), "b").alias("cell_2"))


@operator("CL-02", "counts", "customer", sql=f"""
WITH {TWINS}, d AS (
  SELECT concat(cell_1, '|', cell_2) AS pair, g.gene, coalesce(x.n, 0) - coalesce(y.n, 0) AS d FROM twins CROSS JOIN (SELECT DISTINCT gene FROM counts) g
  LEFT JOIN counts x ON x.cell = cell_1 AND x.gene = g.gene LEFT JOIN counts y ON y.cell = cell_2 AND y.gene = g.gene
), r AS (SELECT pair, gene, row_number() OVER (PARTITION BY gene ORDER BY d, pair) AS r FROM d)
SELECT a.gene AS gene_1, b.gene AS gene_2, round(corr(a.r, b.r), 9) + 0.0 AS rho FROM r a JOIN r b ON a.pair = b.pair AND a.gene < b.gene GROUP BY 1, 2""")
def _(counts, customer):
    rho = k.delta_correlation(k.pair_differences(counts, _twins(customer), counts.select("gene").distinct()))
    return rho.select("gene_1", "gene_2", (F.round("rho", 9) + F.lit(0.0)).alias("rho"))


def _null(counts, cells):
    genes = [r[0] for r in counts.select("gene").distinct().collect()]
    return k.shuffle_null(counts, cells, genes, 25, 200, 1)


@operator("CL-03", "counts", "cells")
def _(counts, cells):
    return _null(counts, cells)


@operator("CL-04", "counts", "cells", "customer")
def _(counts, cells, customer):
    return k.significance(k.delta_correlation(k.pair_differences(counts, _twins(customer), counts.select("gene").distinct())), _null(counts, cells))


@operator("CL-05", "counts", "cells")
def _(counts, cells):
    return k.stability(counts, cells, counts.select("gene").distinct(), _null(counts, cells), 4)


@operator("CL-06", "points")
def _(points):
    return k.energy_distance(points, NULL_SETS)


@operator("CL-07", "points", sql=f"""WITH m AS (SELECT a.clone AS c1, b.clone AS c2, avg({DIST}) AS d FROM points a JOIN points b ON a.clone <= b.clone GROUP BY 1, 2)
SELECT m.c1 AS clone_1, m.c2 AS clone_2, round(2 * m.d - x.d - y.d, 9) AS energy FROM m JOIN m x ON x.c1 = m.c1 AND x.c2 = m.c1
  JOIN m y ON y.c1 = m.c2 AND y.c2 = m.c2 WHERE m.c1 < m.c2""")  # fmt: skip
def _(points):
    return k.energy_matrix(points).withColumn("energy", F.round("energy", 9))


@operator("CL-08", "points")
def _(points):
    return k.distance_groups(points.withColumn("clone", F.when(F.substring("cell", 2, 9).cast("int") % 5 == 0, F.col("cell")).otherwise(F.col("clone"))))


@operator("CL-09", "points")
def _(points):
    return k.cluster_spread_test(points, 5)


@operator("CL-10", "cells", sql="""SELECT clone, size, cluster AS dominant, n / size AS share, n >= 0.25 * size AS pure
  FROM (SELECT clone, cluster, count(*) AS n, sum(count(*)) OVER (PARTITION BY clone) AS size, row_number() OVER (PARTITION BY clone
  ORDER BY count(*) DESC, cluster) AS k FROM cells GROUP BY 1, 2) WHERE k = 1""")
def _(cells):
    return k.clone_purity(cells, 0.25)


def icc(keys: str = "") -> str:
    kk = f", {keys}" if keys else ""
    return f"""d AS (SELECT g.gene{kk}, c.clone, coalesce(x.n, 0) AS n FROM (SELECT *, count(*) OVER (PARTITION BY clone{kk}) AS size FROM cells) c
  CROSS JOIN (SELECT DISTINCT gene FROM counts) g LEFT JOIN counts x ON x.cell = c.cell AND x.gene = g.gene WHERE size > 1),
p AS (SELECT gene{kk}, clone, CAST(count(*) AS DOUBLE) AS n, CAST(sum(n) AS DOUBLE) AS s, CAST(sum(n * n) AS DOUBLE) AS q FROM d
  GROUP BY ALL), t AS (SELECT gene{kk}, sum(n) AS n, count(*) AS k, sum(s * s / n) AS b, sum(q) AS q, sum(s) AS s, sum(n * n) AS n2 FROM p
  GROUP BY ALL HAVING count(*) > 1 AND sum(n) > count(*)),
v AS (SELECT gene{kk}, (b - s * s / n) / (k - 1) AS msb, (q - b) / (n - k) AS msw, (n - n2 / n) / (k - 1) AS n0
  FROM t), icc AS (SELECT gene{kk}, greatest(0, coalesce((msb - msw) / nullif(msb + (n0 - 1) * msw, 0), 0)) AS icc FROM v)"""


@operator("CL-11", "counts", "cells", sql=f"WITH {icc()} SELECT * FROM icc")
def _(counts, cells):
    return k.icc(counts, cells)


@operator("CL-11c", "counts", "cells", sql=f"WITH {icc('cluster')} SELECT * FROM icc")
def _(counts, cells):
    return k.icc(counts, cells, ["cluster"])


@operator("CL-11p", "counts", "cells")
def _(counts, cells):
    return k.icc_test(counts, cells, 5)


def _coherent(counts, cells):
    return k.coherence(counts, cells, counts.select("gene"), RANDOM_SETS)


@operator("CL-12", "counts", "cells")
def _(counts, cells):
    return _coherent(counts, cells)


@operator("CL-13", "counts", "cells")
def _(counts, cells):
    return k.coherence_summary(_coherent(counts, cells), 0.2)


#: A test of each gene and clone, its p made of the counts.
TESTED = "tested AS (SELECT gene, clone, CAST(sum(n) % 41 AS DOUBLE) / 100 AS p FROM counts JOIN cells USING (cell) GROUP BY gene, clone)"


def _tested(counts, cells):
    return counts.join(cells, "cell").groupBy("gene", "clone").agg(((F.sum("n") % 41).cast("double") / 100).alias("p"))


@operator("CL-13g", "counts", "cells", sql=f"""WITH {TESTED} SELECT clone, count(*) AS tested, count(*) FILTER (p < 0.05) AS coherent, count(*) FILTER (p < 0.05) / count(*) AS share,
  array_to_string(list(gene ORDER BY p, gene)[1:5], ', ') AS top_genes FROM tested GROUP BY clone""")
def _(counts, cells):
    return k.coherent_genes(_tested(counts, cells))


@operator("CL-13r", "counts", "cells", sql=f"""WITH {TESTED} SELECT gene, count(*) AS tested, count(*) FILTER (p < 0.05) AS coherent, count(*) FILTER (p < 0.05) / count(*) AS share,
  quantile_cont(p, 0.5) AS median_p FROM tested GROUP BY gene HAVING count(*) >= 3""")
def _(counts, cells):
    return k.gene_recurrence(_tested(counts, cells))


CL14 = f"""
SELECT g.gene, g.icc AS global_icc, i.cluster, i.icc
FROM (WITH {icc()} SELECT * FROM icc) g LEFT JOIN (WITH {icc('cluster')} SELECT * FROM icc) i USING (gene)"""


@operator("CL-14", "counts", "cells", sql=CL14)
def _(counts, cells):
    return k.icc_compare(k.icc(counts, cells), k.icc(counts, cells, ["cluster"]))


DETECTED = "detected AS (SELECT cell, concat('g', CAST(substr(cell, 2) AS INT) % 4) AS gene FROM points WHERE CAST(substr(cell, 2) AS INT) % 3 > 0)"


def _detected(points):
    n = F.substring("cell", 2, 9).cast("int")
    return points.where(n % 3 > 0).select("cell", F.concat(F.lit("g"), n % 4).alias("gene"))


def _mixed(points):
    return points.withColumn("condition", F.when(F.substring("cell", 2, 9).cast("int") % 5 < 2, "A").otherwise("B"))


MATCH = f"""{DETECTED}, p AS (SELECT cell, gene, embedding, CASE WHEN CAST(substr(cell, 2) AS INT) % 5 < 2 THEN 'A' ELSE 'B' END AS condition FROM points JOIN detected USING (cell)),
n AS (SELECT a.gene, a.cell AS cell_1, b.cell AS cell_2, {DIST} AS d FROM p a JOIN p b ON a.gene = b.gene WHERE a.condition = 'A' AND b.condition = 'B'),
m AS (SELECT gene, cell_1, cell_2, d FROM (SELECT *, row_number() OVER (PARTITION BY gene, cell_1 ORDER BY d, cell_2) AS k FROM n)
  WHERE k = 1), matched AS (SELECT m.* FROM m JOIN (SELECT gene, quantile_cont(d, 0.95) AS cut FROM m GROUP BY 1) USING (gene) WHERE d <= cut)"""


@operator("CL-15", "points", sql=f"WITH {MATCH} SELECT * FROM matched")
def _(points):
    return k.match_cells(_mixed(points), _detected(points))


SEEN = "(SELECT cell FROM points WHERE cluster < 5)"
CATEGORY = f"""cat AS (SELECT gene, cell_1, cell_2, CASE WHEN cell_1 IN {SEEN} AND cell_2 IN {SEEN} THEN 'both' WHEN cell_1 IN {SEEN} THEN 'first'
  WHEN cell_2 IN {SEEN} THEN 'second' ELSE 'neither' END AS category FROM matched)"""


def _categories(points):
    return k.pair_categories(k.match_cells(_mixed(points), _detected(points)), points.where("cluster < 5"))


@operator("CL-16", "points", sql=f"WITH {MATCH}, {CATEGORY} SELECT * FROM cat")
def _(points):
    return _categories(points)


#: The upper tail of a chi-square of one degree is the mean of exp(-chi2 / 2 / sin^2) over a quarter turn.
TAIL = "list_avg([exp(-chi2 / 2 / pow(sin((i - 0.5) * pi() / 8000), 2)) for i in range(1, 4001)])"


@operator("CL-17", "points", sql=f"""WITH {MATCH}, {CATEGORY}, c AS (SELECT gene, count(*) FILTER (category = 'first') AS b,
  count(*) FILTER (category = 'second') AS c FROM cat GROUP BY 1), t AS (SELECT gene, b, c, CASE
  WHEN b + c > 0 THEN pow(greatest(abs(b - c) - 1, 0), 2) / (b + c) ELSE 0 END AS chi2 FROM c),
tails AS (SELECT *, CASE WHEN b + c = 0 THEN NULL WHEN chi2 = 0 THEN 1 ELSE {TAIL} END AS p FROM t),
ranked AS (SELECT *, p * count(p) OVER () / count(p) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS raw FROM tails WHERE p IS NOT NULL)
SELECT x.gene, x.b, x.c, x.chi2, round(x.p, 9) AS p, CASE WHEN x.p IS NOT NULL THEN round(least(1, (SELECT min(raw) FROM ranked y WHERE y.p >= x.p)), 9) END AS p_adj FROM tails x""")
def _(points):
    return k.mcnemar(_categories(points)).withColumns({x: F.round(x, 9) for x in ("p", "p_adj")})


KS = """u AS (SELECT signal AS v, count(*) FILTER (cluster = 'BUILDING') AS a, count(*) FILTER (cluster = 'MACHINERY') AS b FROM cells
  GROUP BY 1), f AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS g, lead(v)
  OVER (ORDER BY v) - v AS w FROM u)"""


@operator("CL-18", "cells", sql=f"WITH {KS} SELECT max(abs(g)) AS ks FROM f")
def _(cells):
    return k.ks_distance(cells, "signal", "cluster", "BUILDING", "MACHINERY")


SAMPLES = f"""{MATCH}, e AS (SELECT p.* FROM p JOIN (SELECT gene FROM p GROUP BY 1 HAVING count(*) FILTER (condition = 'A') >= 10 AND count(*) FILTER (condition = 'B') >= 10) USING (gene)),
  kinds AS (SELECT gene, 'matched' AS kind, d FROM matched UNION ALL SELECT a.gene, 'within', min({DIST}) FROM e a JOIN e b ON a.gene = b.gene AND a.cell <> b.cell WHERE a.condition = 'A' AND b.condition = 'A' GROUP BY a.gene, a.cell)"""


@operator("CL-18d", "points", sql=f"WITH {SAMPLES} SELECT * FROM kinds")
def _(points):
    mixed, detected = _mixed(points), _detected(points)
    return k.match_distances(mixed, detected, k.match_cells(mixed, detected)).where("kind <> 'random'")


@operator("CL-18q", "points")
def _(points):
    mixed, detected = _mixed(points), _detected(points)
    return k.match_quality(k.match_distances(mixed, detected, k.match_cells(mixed, detected)))


@operator("CL-19", "points")
def _(points):
    return k.match_permutation(_categories(points), SWAPS)


@operator("CL-20", "points")
def _(points):
    return k.split_half_control(_mixed(points), _detected(points), "B", least=5)


TABLE = f"""SELECT gene, count(*) FILTER (condition = 'A' AND n > 25) AS a, count(*) FILTER (condition = 'A'
  AND n <= 25) AS b, count(*) FILTER (condition <> 'A' AND n > 25) AS c, count(*) FILTER (condition <> 'A' AND n <= 25) AS d FROM counts
  JOIN cells USING (cell) GROUP BY gene"""


def _table(counts, cells):
    return k.detection_table(counts.join(cells, "cell").withColumn("detected", F.col("n") > 25), "condition", "A")


@operator("CL-21", "counts", "cells", sql=f"WITH t AS ({TABLE}) SELECT *, a / (a + b) AS share_1, c / (c + d) AS share_2 FROM t")
def _(counts, cells):
    return k.fisher(_table(counts, cells)).drop("p", "p_adj")


@operator("CL-22", "cells", sql="""WITH s AS (SELECT cluster, count(*) OVER (PARTITION BY clone) = 1 AS single
  FROM (SELECT cluster, concat(clone, x) AS clone FROM cells)), t AS (SELECT cluster, count(*) FILTER (single) AS a, count(*) FILTER (NOT single) AS c
  FROM s GROUP BY 1) SELECT cluster, a, sum(a) OVER () - a AS b, c, sum(c) OVER () - c AS d FROM t""")
def _(cells):
    return k.singleton_table(cells.withColumn("clone", F.concat("clone", "x")))


@operator("CL-22p", "cells")
def _(cells):
    return k.fisher(k.singleton_table(cells.withColumn("clone", F.concat("clone", "x"))))


@operator("CL-23", "cells", sql=f"""WITH {KS} SELECT sum(abs(g) * w) AS wasserstein, sum(abs(g) * w) / (SELECT stddev_samp(signal) FROM cells
  WHERE cluster = 'MACHINERY') AS scaled FROM f""")
def _(cells):
    return k.wasserstein(cells, "signal", "cluster", "BUILDING", "MACHINERY")


@operator("CL-24", "cells", sql="""WITH h AS (SELECT cluster, signal, count(*) AS n FROM cells
  GROUP BY 1, 2), g AS (SELECT m.cluster, v.signal, coalesce(n, 0) AS n FROM (SELECT DISTINCT cluster FROM h) m CROSS JOIN (SELECT DISTINCT signal
  FROM h) v LEFT JOIN h USING (cluster, signal)),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY cluster) AS p FROM g), j AS (SELECT a.cluster, a.signal, a.p, b.p AS q FROM p a JOIN p b USING (signal)
  WHERE a.cluster <> 'BUILDING' AND b.cluster = 'BUILDING'),
d AS (SELECT cluster, abs(sum(p - q) OVER w) AS gap, coalesce(lead(signal) OVER w - signal, 0) AS width, (CASE
  WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM j
  WINDOW w AS (PARTITION BY cluster ORDER BY signal))
SELECT cluster, max(gap) AS ks, sqrt(sum(js)) AS js, sum(gap * width) AS wasserstein FROM d GROUP BY 1""")  # fmt: skip
def _(cells):
    return k.compare_methods(cells, "signal", "cluster", "BUILDING")


@operator("CL-23b", "cells")
def _(cells):
    return d.wasserstein_context(cells, "score", "cluster", "BUILDING", "MACHINERY")


@operator("CL-24b", "cells")
def _(cells):
    return d.methods_tested(cells, "score", "cluster", "BUILDING")


@operator("CL-24c", "cells")
def _(cells):
    return d.closer_methods(cells, "signal", "cluster", "BUILDING")


@operator("CL-25", "cells", sql="SELECT clone, count(*) AS size, count(*) FILTER (signal > 3) AS infected, 100.0 * count(*) FILTER (signal > 3) / count(*) AS percent FROM cells GROUP BY clone")
def _(cells):
    return k.clone_infection(cells, F.col("signal") > 3)
