"""SAT queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import sampling as s
from cytolake.plans.reads_queries import RB, ov
from cytolake.plans.registry import operator

FRACTIONS = [0.1, 0.3, 0.5, 1.0]
#: Fractions and repeats of SAT-02, those of its reference.
DEPTHS, REPEATS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0], 3
M = "m AS (SELECT cell, umi, gene, sum(reads) AS reads FROM molecule_table GROUP BY 1, 2, 3)"
GENES = ["g1", "g2", "g3", "g50"]
IN = "gene IN ('g1', 'g2', 'g3', 'g50')"


@operator("SAT-01", "molecule_table", sql=f"""WITH {M} SELECT cell, sum(reads) AS reads, count(*) AS umis, count(DISTINCT gene) AS genes,
  1 - count(*) / sum(reads) AS saturation FROM m GROUP BY GROUPING SETS ((cell), ())""")
def _(m):
    return s.read_saturation(m)


@operator("SAT-02", "molecule_table")
def _(m):
    return s.rarefaction(m, DEPTHS, REPEATS, 1)


UMIS = f"""{RB}, u AS (SELECT target, cb, ub, count(*) AS reads FROM rb JOIN regions ON ref = chrom
  AND {ov('g1', 'e1', 'start_pos - 1', 'end_pos')} > 0 WHERE cb IS NOT NULL AND ub IS NOT NULL GROUP BY 1, 2, 3)"""


@operator("SAT-03", "reads", "regions", sql=f"WITH {UMIS} SELECT target, cb, ub, reads FROM (SELECT *, count(*) OVER (PARTITION BY target, cb) AS n FROM u WHERE reads >= 1) WHERE n >= 20")
def _(reads, regions):
    return s.region_umis(reads, regions, 1, 20)


@operator("SAT-04", "reads", "regions")
def _(reads, regions):
    return s.region_rarefaction(s.region_umis(reads, regions, 1, 1), FRACTIONS, 3, 1)


@operator("SAT-05", "reads", "regions", sql=f"""WITH {UMIS} SELECT count(*) FILTER (reads >= 2) AS above, count(*) FILTER (reads = 1) AS one_below,
  count(*) FILTER (reads < 1) AS below, sum(CASE WHEN reads >= 2 THEN reads ELSE 0 END) / sum(reads) AS share, quantile_cont(reads, 0.5) AS median
  FROM u""")
def _(reads, regions):
    return s.umi_saturation(s.region_umis(reads, regions, 1, 1), 2)


@operator("SAT-06", "counts", sql=f"""WITH d AS (SELECT cell, sum(n) AS depth FROM counts
  GROUP BY 1), t AS (SELECT sum(n) AS total, count(DISTINCT cell) AS cells FROM counts), g AS (SELECT gene, sum(n) AS s, count(*) AS seen FROM counts
  WHERE {IN} GROUP BY 1)
SELECT gene, avg(exp(-depth * s / total)) AS mean, quantile_cont(exp(-depth * s / total), 0.5) AS median, any_value(1 - seen / cells) AS observed,
  CASE WHEN any_value(1 - seen / cells) > avg(exp(-depth * s / total)) + 0.05 THEN 'more zeros than sampling' ELSE 'sampling' END AS verdict
  FROM d, t, g GROUP BY gene""")  # fmt: skip
def _(counts):
    return s.dropout_poisson(counts, GENES)


@operator("SAT-07", "counts", sql=f"""WITH t AS (SELECT count(DISTINCT cell) AS c
  FROM counts), g AS (SELECT gene, sum(n) / any_value(c) AS mean,
  sum(n * n) / any_value(c) - (sum(n) / any_value(c)) * (sum(n) / any_value(c)) AS variance FROM counts, t WHERE {IN} GROUP BY 1)
SELECT gene, mean, variance, pow((mean * mean / (variance - mean)) / (mean * mean / (variance - mean) + mean), mean * mean / (variance - mean)) AS p0 FROM g""")  # fmt: skip
def _(counts):
    return s.dropout_nb(counts, GENES)


@operator("SAT-08", "positions")
def _(positions):
    return s.sample_cells(positions, ["cell", "umi", "pos"], [10, 50, 90], 2, 1)


def _weighted(molecules):
    return s.sample_cells(molecules.groupBy("cell", "umi").agg(F.sum("read_count").alias("reads")), ["cell", "umi"], [1, 10, 50, 90], 3, 1)


@operator("SAT-09", "molecules")
def _(molecules):
    return _weighted(molecules)


@operator("SAT-10", "cells", sql="SELECT signal AS percent, avg(other) AS mean, stddev_samp(other) AS sd, count(*) AS repeats FROM cells GROUP BY 1")
def _(cells):
    return s.sampling_summary(cells.select(F.col("signal").alias("percent"), F.col("other").alias("cells")))


def _fits(molecules):
    return s.fit_curves(s.sampling_summary(_weighted(molecules)).withColumn("sample", F.lit("all")))


@operator("SAT-11", "molecules")
def _(molecules):
    return _fits(molecules)


CURVE = "SELECT cluster AS sample, 'michaelis-menten' AS curve, avg(x) AS a, avg(y) AS b, 0.9 AS r2, 9 * avg(y) AS required_percent FROM cells GROUP BY cluster"


def _curves(cells):
    return cells.groupBy(F.col("cluster").alias("sample")).agg(F.lit("michaelis-menten").alias("curve"), F.avg("x").alias("a"), F.avg("y").alias("b"), (9 * F.avg("y")).alias("required_percent"))


@operator("SAT-12", "cells", sql=f"""WITH c AS ({CURVE}) SELECT sample, 100.0 / (100.0 + b) AS share, required_percent / 100 AS scale, CASE
  WHEN 100.0 / (100.0 + b) >= 0.9 THEN 'stop' WHEN 100.0 / (100.0 + b) >= 0.5 THEN 'sequence more' ELSE 'new library' END AS decision FROM c""")
def _(cells):
    return s.sequencing_decision(_curves(cells))


@operator("SAT-13", "cells", sql=f"""WITH c AS ({CURVE}) SELECT sample, percent, 1000 * percent / 100 AS reads,
  a * percent / (b + percent) AS coverage, percent / (b + percent) AS saturation FROM c, (SELECT unnest([10, 50, 100]) AS percent)""")
def _(cells):
    fits = _curves(cells)
    return s.saturation_curve(fits, fits.select("sample", F.lit(1000).alias("reads")), [10, 50, 100])


@operator("SAT-14", "positions")
def _(positions):
    return s.info_content(positions.select("cell", "umi").distinct(), [1, 10, 50, 100], 40, 1)


@operator("SAT-15", "molecule_table")
def _(m):
    return s.depth_curve(m, 5)


@operator("SAT-16", "molecule_table")
def _(m):
    return s.cell_curves(m.groupBy("cell", "umi", "gene").agg(F.sum("reads").alias("reads")), FRACTIONS)


@operator("SAT-16s", "molecule_table")
def _(m):
    return s.curve_end(s.cell_curves(m.groupBy("cell", "umi", "gene").agg(F.sum("reads").alias("reads")), [0.8, 0.9, 1.0]))


@operator("SAT-17", "counts", sql="SELECT n AS value, count(*) AS n, sum(count(*)) OVER (ORDER BY n) / sum(count(*)) OVER () AS share FROM counts GROUP BY counts.n")
def _(counts):
    return s.ecdf(counts.select(F.col("n").alias("value")), "value")
