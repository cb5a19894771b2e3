"""Expression tables as long triples (cell, gene, n); a missing triple is a zero and is never made a row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.functions import stats
from cytolake.operators import tiles


def qc_cells(x: DataFrame, mito: Column, genes: tuple[int, int] = (200, 3500), umis: int = 20_000, mito_percent: float = 5) -> DataFrame:
    """EX-01: cells by number of genes (exclusive bounds), molecules and percent of mitochondrial ones."""
    per = x.where("n > 0").groupBy("cell").agg(F.count("*").alias("genes"), F.sum("n").alias("umis"), (100.0 * F.sum(F.when(mito, F.col("n")).otherwise(0)) / F.sum("n")).alias("mito_percent"))
    return per.where((F.col("genes") > genes[0]) & (F.col("genes") < genes[1]) & (F.col("umis") < umis) & (F.col("mito_percent") < mito_percent))


def min_filter(x: DataFrame, min_cells: int = 3, min_genes: int = 200) -> DataFrame:
    """EX-02: genes in at least min_cells cells, then cells with at least min_genes of the genes."""
    seen = x.where("n > 0")
    genes = seen.groupBy("gene").agg(F.count("*").alias("k")).where(F.col("k") >= min_cells).select("gene")
    kept = seen.join(genes, "gene", "left_semi")
    cells = kept.groupBy("cell").agg(F.count("*").alias("k")).where(F.col("k") >= min_genes).select("cell")
    return kept.join(cells, "cell", "left_semi")


def drop_doublets(x: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """EX-03: without cells that express a gene of each list."""
    has = lambda genes: F.max((F.col("gene").isin(*genes) & (F.col("n") > 0)).cast("int")) == 1
    both = x.groupBy("cell").agg((has(first) & has(second)).alias("both")).where("both").select("cell")
    return x.join(both, "cell", "left_anti")


def drop_features(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """EX-04: without the listed genes."""
    return x.where(~F.col("gene").isin(*genes))


def log_normalize(x: DataFrame, scale: float = 1e4) -> DataFrame:
    """EX-05: log1p of counts scaled to `scale` per cell, as column v."""
    return x.withColumn("v", F.log1p(F.lit(scale) * F.col("n") / F.sum("n").over(W.partitionBy("cell"))))


def gene_moments(x: DataFrame, value: str, cells: int) -> DataFrame:
    """Mean and sample variance of each gene over `cells` cells, zeros included."""
    sums = x.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count_if(F.col(value) > 0).alias("k"))
    return sums.select("gene", (F.col("s") / cells).alias("mean"), ((F.col("q") - F.col("s") * F.col("s") / cells) / (cells - 1)).alias("variance"), "k")


def variable_genes(x: DataFrame, cells: int, n: int = 2000, bins: int = 20) -> DataFrame:
    """EX-06: the n genes of largest dispersion (variance / mean), standardised in bins of equal numbers of genes by mean."""
    d = gene_moments(log_normalize(x), "v", cells).where("mean > 0").withColumn("dispersion", F.col("variance") / F.col("mean"))
    d = d.withColumn("bin", F.ntile(bins).over(W.orderBy("mean", "gene")))  # a row a gene
    w = W.partitionBy("bin")
    z = F.coalesce(F.try_divide(F.col("dispersion") - F.avg("dispersion").over(w), F.stddev_samp("dispersion").over(w)), F.lit(0.0))
    return d.select("gene", "mean", "dispersion", z.alias("z")).orderBy(F.desc(F.round("z", 9)), "gene").limit(n)


def detected_genes(x: DataFrame, cells: int, rate: float = 0.2) -> DataFrame:
    """EX-07: genes seen in at least the share of cells."""
    return x.where("n > 0").groupBy("gene").agg((F.count("*") / cells).alias("rate")).where(F.col("rate") >= rate)


#: Cells of a block of the products below.
PCA_ROWS = 512


def scale_pca(x: DataFrame, genes: Sequence[str], k: int = 30) -> DataFrame:
    """EX-08: k principal components of scaled expression of the listed genes, as an array per cell (signs: the largest weight is positive).

    Values stay triples. Each task multiplies blocks of its cells, a dense block at a time, and gives one row a gene: the
    sums of its products with all listed genes. Added up and corrected by the means they are the correlations,
    whose eigenvectors the driver finds: a table of genes by genes, the listed ones. A cell's scores are sums over its
    own genes, less what the means add.
    """
    spark, n = x.sparkSession, len(genes)
    at = spark.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene string, at int")
    value = log_normalize(x).join(F.broadcast(at), "gene").select("cell", "at", "v")
    cells = x.select("cell").distinct().count()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        block, rows, last = np.zeros((PCA_ROWS, n)), -1, None
        for b in batches:
            for cell, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if cell != last:
                    rows, last = rows + 1, cell
                    if rows == PCA_ROWS:
                        total += block.T @ block
                        block[:], rows = 0, 0
                block[rows, i] += v
        total += block.T @ block
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["at", "row"])

    by_cell = value.repartition("cell").sortWithinPartitions("cell")

    def added(rows: pa.Table) -> pa.Table:
        total = np.asarray(rows.column("row").combine_chunks().flatten()).reshape(-1, n).sum(axis=0)
        return pa.table({"at": rows.column("at").slice(0, 1), "row": pa.array([total], pa.list_(pa.float64()))})

    sums = by_cell.mapInArrow(products, "at int, row array<double>").groupBy("at").applyInArrow(added, "at int, row array<double>")
    moment = np.zeros((n, n))
    for r in sums.collect():  # listed genes squared
        moment[r["at"]] = r["row"]
    mean = np.zeros(n)
    for r in value.groupBy("at").agg((F.sum("v") / cells).alias("m")).collect():
        mean[r["at"]] = r["m"]
    cov = (moment - cells * np.outer(mean, mean)) / max(cells - 1, 1)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    scale = np.divide(1.0, sd, out=np.zeros(n), where=sd > 1e-12)
    _, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
    vectors = vectors[:, ::-1][:, :k]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    weights = vectors * scale[:, None]
    offset = mean @ weights
    table = spark.createDataFrame([(i, [float(w) for w in weights[i]]) for i in range(n)], "at int, w array<double>")
    parts = value.join(F.broadcast(table), "at").groupBy("cell").agg(*[F.sum(F.col("v") * F.col("w")[j]).alias(f"s{j}") for j in range(weights.shape[1])])
    scored = x.select("cell").distinct().join(parts, "cell", "left")
    return scored.select("cell", F.array(*[F.coalesce(f"s{j}", F.lit(0.0)) - float(offset[j]) for j in range(weights.shape[1])]).alias("pca"))


def target_expression(x: DataFrame, genes: Sequence[str], value: str = "n") -> DataFrame:
    """EX-09: a column for each requested gene, 0 where the cell or the whole table lacks it."""
    return x.groupBy("cell").agg(*[F.coalesce(F.max(F.when(F.col("gene") == g, F.col(value))), F.lit(0)).alias(g) for g in genes])


def gene_filter(x: DataFrame, min_cells: int = 100, least_max: int = 1) -> DataFrame:
    """EX-10: genes above 0 in min_cells cells whose maximum reaches least_max."""
    return x.groupBy("gene").agg(F.count_if(F.col("n") > 0).alias("cells"), F.max("n").alias("most")).where((F.col("cells") >= min_cells) & (F.col("most") >= least_max))


def rank_sum(x: DataFrame, members: DataFrame, value: str = "n", keys: Sequence[str] = ()) -> DataFrame:
    """Rank-sum statistics of each gene between the groups 1 and 2 of members (cell, keys, group), zeros ranked in closed form.

    Counts per value replace rows, so ties cost nothing; values must not be negative. Columns: U of group 1, z (with
    continuity and tie corrections), means and detection rates of both groups.
    """
    keys = list(keys)
    sizes = members.groupBy(*keys).agg(F.count_if(F.col("group") == 1).alias("n1"), F.count_if(F.col("group") == 2).alias("n2"))
    one = F.col("group") == 1
    v = F.col(value)
    counts = x.where(v > 0).join(members, "cell").groupBy(*keys, "gene", v.alias("value")).agg(F.count_if(one).alias("a"), F.count_if(~one).alias("b"))
    w = W.partitionBy(*keys, "gene")
    t = F.col("a") + F.col("b")
    placed = counts.withColumn("before", F.coalesce(F.sum(t).over(w.orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # Zeros come first: (n1 - sum a) + (n2 - sum b) of them shift every rank.
    sums = placed.groupBy(*keys, "gene").agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * (F.col("before") + (t + 1) / 2.0)).alias("r"), F.sum(t.cast("double") * t * t - t).alias("ties"),
        F.sum(F.col("a") * F.col("value")).alias("s1"), F.sum(F.col("b") * F.col("value")).alias("s2"),
    )
    s = sums.join(F.broadcast(sizes), keys) if keys else sums.crossJoin(F.broadcast(sizes))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    z0 = n - F.col("a") - F.col("b")
    ranks = F.col("r") + F.col("a") * z0 + (n1 - F.col("a")) * (z0 + 1) / 2.0
    u = ranks - n1 * (n1 + 1) / 2.0
    ties = F.col("ties") + z0.cast("double") * z0 * z0 - z0
    var = n1 * n2 / 12.0 * (n + 1 - F.try_divide(ties, n.cast("double") * (n - 1)))
    off = u - n1 * n2 / 2.0
    z = F.coalesce(F.try_divide(off - F.signum(off) * 0.5, F.sqrt(var)), F.lit(0.0))
    return s.select(*keys, "gene", u.alias("u"), z.alias("z"), F.try_divide("s1", n1).alias("mean_1"), F.try_divide("s2", n2).alias("mean_2"), F.try_divide("a", n1).alias("pct_1"), F.try_divide("b", n2).alias("pct_2"))


def rank_sum_de(x: DataFrame, members: DataFrame, min_pct: float = 0.1, keys: Sequence[str] = (), n_genes: int | None = None) -> DataFrame:
    """EX-11, EX-13: differential expression of two groups (per keys): log2 fold change with one added to means, two-sided p, Bonferroni over all genes."""
    total = n_genes or x.select("gene").distinct().count()
    d = rank_sum(x, members, keys=keys).where((F.col("pct_1") >= min_pct) | (F.col("pct_2") >= min_pct))
    d = d.withColumn("log2fc", F.log2((F.col("mean_1") + 1) / (F.col("mean_2") + 1))).withColumn("p", stats.tail(stats.normal_two_sided, F.col("z")))
    return d.withColumn("p_adj", F.least(F.lit(1.0), F.col("p") * total))


def significant(de: DataFrame, fold: float = 0.5, alpha: float = 0.01) -> DataFrame:
    """EX-12: genes beyond the fold change and below alpha, marked up or down."""
    return de.where((F.abs("log2fc") > fold) & (F.col("p_adj") < alpha)).withColumn("direction", F.when(F.col("log2fc") > 0, "up").otherwise("down"))


def shared_clusters(members: DataFrame, cluster: str, least: int = 3) -> DataFrame:
    """EX-13: members of the clusters with at least `least` cells of both groups."""
    enough = members.groupBy(cluster).agg(F.count_if(F.col("group") == 1).alias("k1"), F.count_if(F.col("group") == 2).alias("k2")).where((F.col("k1") >= least) & (F.col("k2") >= least))
    return members.join(enough.select(cluster), cluster, "left_semi")


def gene_presence(de: DataFrame, cluster: str) -> DataFrame:
    """EX-14: clusters in which each gene is significant."""
    return de.groupBy("gene").agg(F.array_join(F.sort_array(F.collect_set(cluster)), ",").alias("clusters"), F.count_distinct(cluster).alias("n"))


def pseudobulk(x: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """EX-15: counts by group and gene."""
    return x.join(groups.select("cell", group), "cell").groupBy(group, "gene").agg(F.sum("n").alias("n"))


def module_score(x: DataFrame, genes: Sequence[str], seed: int = 1, bins: int = 24, controls: int = 5, value: str = "v") -> DataFrame:
    """EX-16: mean of a gene set minus mean of controls, `controls` genes for each from its bin of mean expression, picked by seeded hash."""
    means = x.groupBy("gene").agg(F.sum(value).alias("s")).withColumn("bin", F.ntile(bins).over(W.orderBy("s", "gene")))  # a row a gene
    wanted = means.where(F.col("gene").isin(*genes))
    pool = means.where(~F.col("gene").isin(*genes)).withColumn("k", F.row_number().over(W.partitionBy("bin").orderBy(F.xxhash64("gene", F.lit(seed)), "gene")))
    need = wanted.groupBy("bin").agg((F.count("*") * controls).alias("need"))
    picked = pool.join(need, "bin").where("k <= need").select("gene", F.lit(0).alias("own"))
    chosen = F.broadcast(wanted.select("gene", F.lit(1).alias("own")).unionByName(picked))
    sizes = chosen.agg(F.count_if(F.col("own") == 1).alias("n1"), F.count_if(F.col("own") == 0).alias("n0"))
    sums = x.join(chosen, "gene", "left").groupBy("cell").agg(F.sum(F.when(F.col("own") == 1, F.col(value))).alias("a"), F.sum(F.when(F.col("own") == 0, F.col(value))).alias("b"))
    return sums.crossJoin(F.broadcast(sizes)).select("cell", (F.coalesce(F.try_divide("a", "n1"), F.lit(0.0)) - F.coalesce(F.try_divide("b", "n0"), F.lit(0.0))).alias("score"))


def gate_labels(df: DataFrame, gates: Sequence[tuple[str, str, float]], rest: str = "other") -> DataFrame:
    """EX-17: the label of the first gate (label, column, quantile) whose column is above its quantile over all rows."""
    cuts = df.agg(*[F.percentile(c, q).alias(f"cut_{i}") for i, (_, c, q) in enumerate(gates)])
    out = None
    for i, (label, c, _) in enumerate(gates):
        out = (F.when if out is None else out.when)(F.col(c) > F.col(f"cut_{i}"), label)
    return df.crossJoin(F.broadcast(cuts)).withColumn("label", out.otherwise(rest)).drop(*[f"cut_{i}" for i in range(len(gates))])


def cycle_score(x: DataFrame, s_genes: Sequence[str], m_genes: Sequence[str], seed: int = 1) -> DataFrame:
    """EX-18: module scores of two sets; the larger one that is above 0 names the phase, else G1."""
    a, b = module_score(x, s_genes, seed).withColumnRenamed("score", "s"), module_score(x, m_genes, seed).withColumnRenamed("score", "g2m")
    return a.join(b, "cell").withColumn("phase", F.when((F.col("s") <= 0) & (F.col("g2m") <= 0), "G1").when(F.col("s") > F.col("g2m"), "S").otherwise("G2M"))


def gini(x: DataFrame, cells: int) -> DataFrame:
    """EX-19: Gini coefficient of each gene over all cells, its mean and percent of cells that express it; zeros take the lowest ranks in closed form."""
    w = W.partitionBy("gene").orderBy("n", "cell")
    ranked = x.where("n > 0").withColumn("k", F.row_number().over(w))
    sums = ranked.groupBy("gene").agg(F.sum("n").alias("s"), F.count("*").alias("m"), F.sum(F.col("k") * F.col("n")).alias("kn"))
    zeros = cells - F.col("m")
    g = 2.0 * (F.col("kn") + zeros * F.col("s")) / (cells * F.col("s")) - (cells + 1.0) / cells
    return sums.select("gene", g.alias("gini"), (F.col("s") / cells).alias("mean"), (100.0 * F.col("m") / cells).alias("percent"))


def diversity(cells: DataFrame, group: str, kind: str) -> DataFrame:
    """EX-20: Shannon and Simpson diversity and number of types of each group."""
    shares = cells.groupBy(group, kind).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(group)))
    return shares.groupBy(group).agg(F.sum(-F.col("p") * F.log("p")).alias("shannon"), (1 - F.sum(F.col("p") * F.col("p"))).alias("simpson"), F.count("*").alias("types"))


def gene_variation(x: DataFrame, cells: int) -> DataFrame:
    """EX-20: mean and median over genes of the coefficient of variation."""
    cv = gene_moments(x, "n", cells).where("mean > 0").select((F.sqrt("variance") / F.col("mean")).alias("cv"))
    return cv.agg(F.avg("cv").alias("mean_cv"), F.percentile("cv", 0.5).alias("median_cv"))


def signal_correlation(x: DataFrame, signal: DataFrame, least: int = 10) -> DataFrame:
    """EX-21: Spearman correlation of each gene with a signal over the cells where either is above 0, p by the t approximation's normal tail, BH adjusted.

    Only counts above 0 are rows. Of N such cells of a gene, z lack the gene (rank of n: (z + 1) / 2) and c have no
    signal (rank of the signal: (c + 1) / 2). Every cell with a signal takes part for every gene, so its rank is c
    more than m, its midrank among all of them; sums over the z cells are sums over all less those over the others.
    """
    by_value = signal.where("signal > 0").groupBy("signal").agg(F.count("*").alias("k"))
    ranks = stats.running(by_value, "signal", "k").select("signal", "k", (F.col("run_k") - (F.col("k") - 1) / 2.0).alias("m"))
    whole = ranks.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("p"), F.coalesce(F.sum(F.col("k") * F.col("m") * F.col("m")), F.lit(0.0)).alias("m2"), F.count("*").alias("values"))
    rows = x.where("n > 0").select("gene", "cell", "n").join(signal.select("cell", "signal"), "cell").join(ranks.select("signal", "m"), "signal", "left")
    groups = rows.groupBy("gene", "n").agg(F.count("*").alias("k"), F.count("m").alias("kp"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("sm"))
    w = W.partitionBy("gene")
    groups = groups.withColumn("r", F.sum("k").over(w.orderBy("n").rowsBetween(W.unboundedPreceding, 0)) - (F.col("k") - 1) / 2.0).withColumn("c", F.sum(F.col("k") - F.col("kp")).over(w))
    # Sums over the rows above 0 of each gene: rank among them, rank of the signal, and products.
    ry = F.col("sm") + F.col("kp") * F.col("c") + (F.col("k") - F.col("kp")) * (F.col("c") + 1) / 2.0
    g = groups.groupBy("gene").agg(
        F.max("c").alias("c"), F.sum("k").alias("seen"), F.sum("kp").alias("kp"), F.sum("sm").alias("sm"), F.count("*").alias("kinds"), F.sum(F.col("k") * F.col("r")).alias("sr"),
        F.sum(F.col("k") * F.col("r") * F.col("r")).alias("sr2"), F.sum(ry).alias("sy"), F.sum(F.col("r") * ry).alias("sry"),
    )
    genes = x.select("gene").distinct().join(g, "gene", "left").na.fill(0).crossJoin(F.broadcast(whole))
    c, p, n = F.col("c").cast("double"), F.col("p").cast("double"), (F.col("p") + F.col("c")).cast("double")
    z = p - F.col("kp")
    low = (z + 1) / 2
    m1 = p * (p + 1) / 2
    sxy = F.col("sry") + z * F.col("sy") + low * (m1 - F.col("sm") + z * c)
    sx2 = F.col("sr2") + 2 * z * F.col("sr") + z * z * F.col("seen") + z * low * low
    sy2 = c * (c + 1) * (c + 1) / 4 + F.col("m2") + 2 * c * m1 + p * c * c
    mean = n * (n + 1) * (n + 1) / 4
    kx, ky = F.col("kinds") + (z > 0).cast("int"), F.col("values") + (c > 0).cast("int")
    rho = genes.where((n >= least) & (kx > 1) & (ky > 1)).select("gene", (F.col("p") + F.col("c")).alias("cells"), ((sxy - mean) / F.sqrt((sx2 - mean) * (sy2 - mean))).alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("cells") - 2, 1 - F.col("rho") * F.col("rho")))
    return stats.adjust(rho.select("gene", "cells", "rho", stats.tail(stats.normal_two_sided, t).alias("p")), "p", "p_adj")


def metric_correlation(df: DataFrame, metrics: Sequence[str], signal: str) -> DataFrame:
    """EX-22: Spearman correlation of each metric with a signal."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    long = df.select(F.col(signal).alias("signal"), F.inline(parts)).where("value IS NOT NULL AND signal IS NOT NULL")
    ranked = stats.midrank(stats.midrank(long, "value", "rx", "metric"), "signal", "ry", "metric")
    return ranked.groupBy("metric").agg(stats.correlation("rx", "ry").alias("rho"), F.count("*").alias("n"))


def assay_correlation(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """EX-23: Pearson and Spearman correlation of two counts, raw, log1p and log2 (cells with a zero left out of log2); NaN where a side is constant."""
    j = a.select("cell", F.col("n").alias("a")).join(b.select("cell", F.col("n").alias("b")), "cell", how).na.fill(0)
    ranked = stats.midrank(stats.midrank(j.withColumn("one", F.lit(1)), "a", "ra", "one"), "b", "rb", "one")
    log2 = lambda c: F.when((F.col("a") > 0) & (F.col("b") > 0), F.log2(c))
    return ranked.agg(F.count("*").alias("n"), stats.correlation("a", "b").alias("pearson"), stats.correlation("ra", "rb").alias("spearman"), stats.correlation(F.log1p("a"), F.log1p("b")).alias("log1p"), stats.correlation(log2("a"), log2("b")).alias("log2"))


def enrichment_scores(scores: DataFrame, sets: DataFrame, sizes: tuple[int, int] = (10, 500)) -> DataFrame:
    """EX-24: running-sum enrichment score of each gene set in each pattern's ranking of genes (falling v, then gene).

    It is NaN where it isn't defined: for a set of all genes, which leaves no misses, and for one of weight zero.
    """
    in_play = sets.join(scores.select("gene").distinct(), "gene", "left_semi").select("gene_set", "gene").distinct()
    ok = in_play.groupBy("gene_set").agg(F.count("*").alias("size")).where(F.col("size").between(*sizes))
    w = W.partitionBy("pattern").orderBy(F.desc("v"), "gene")
    ranked = scores.withColumn("k", F.row_number().over(w)).withColumn("total", F.count("*").over(W.partitionBy("pattern")))
    hits = ranked.join(in_play.join(F.broadcast(ok), "gene_set"), "gene").select("pattern", "gene_set", "k", "total", F.abs("v").alias("weight"))
    per = W.partitionBy("pattern", "gene_set")
    up = per.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    m, all_w = F.count("*").over(per), F.sum("weight").over(per)
    # Just after a hit and just before it: the running sum's turning points.
    share = lambda n, of: F.coalesce(F.try_divide(n, of), F.lit(float("nan")))
    misses = share(F.col("k") - F.count("*").over(up), F.col("total") - m)
    after = share(F.sum("weight").over(up), all_w) - misses
    points = hits.select("pattern", "gene_set", after.alias("after"), (after - share(F.col("weight"), all_w)).alias("before"))
    best = points.groupBy("pattern", "gene_set").agg(F.max("after").alias("high"), F.min("before").alias("low"), F.count("*").alias("size"))
    return best.select("pattern", "gene_set", "size", F.when(F.col("high") >= -F.col("low"), F.col("high")).otherwise(F.col("low")).alias("es"))


def gsea(scores: DataFrame, sets: DataFrame, permutations: int = 100, seed: int = 1, sizes: tuple[int, int] = (10, 500)) -> DataFrame:
    """EX-24: enrichment scores with p from gene permutations (rows of one job: gene labels dealt anew by seeded hash), BH by pattern. An undefined score has no p and doesn't count in BH."""
    observed = enrichment_scores(scores, sets, sizes)
    spark = scores.sparkSession
    reps = spark.range(permutations).withColumnRenamed("id", "rep")
    key = F.concat_ws("#", "pattern", F.col("rep").cast("string"))
    order = lambda c: F.row_number().over(W.partitionBy("pattern").orderBy(c, "gene"))
    many = scores.crossJoin(F.broadcast(reps)).select(key.alias("pattern"), "gene", "v", "rep")
    dealt = many.withColumn("k", order(F.xxhash64("gene", "rep", F.lit(seed)))).select("pattern", "k", "gene")
    values = many.withColumn("k", order(F.desc("v"))).select("pattern", "k", "v")
    null = enrichment_scores(dealt.join(values, ["pattern", "k"]).select("pattern", "gene", "v"), sets, sizes).select(F.split_part("pattern", F.lit("#"), F.lit(1)).alias("pattern"), "gene_set", F.col("es").alias("null_es"))
    p = observed.join(null, ["pattern", "gene_set"]).groupBy("pattern", "gene_set", "size", "es").agg(((F.count_if(F.abs("null_es") >= F.abs("es")) + 1) / (F.count("*") + 1)).alias("p"))
    p = p.withColumn("p", F.when(~F.isnan("es"), F.col("p")))
    return stats.adjust(p, "p", "p_adj", "pattern")


def ora(query: DataFrame, sets: DataFrame, background: DataFrame, sizes: tuple[int, int] = (10, 500)) -> DataFrame:
    """EX-25: over-representation of gene sets in a query: overlap, its genes, upper hypergeometric tail, BH."""
    bg = background.select("gene").distinct()
    q = query.select("gene").distinct().join(bg, "gene", "left_semi").withColumn("hit", F.lit(1))
    totals = bg.join(q, "gene", "left").agg(F.count("*").alias("total"), F.count("hit").alias("drawn"))
    per = sets.select("gene_set", "gene").distinct().join(bg, "gene", "left_semi").join(q, "gene", "left").groupBy("gene_set").agg(F.count("*").alias("size"), F.count("hit").alias("overlap"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("hit") == 1, F.col("gene")))), ",").alias("genes"))
    d = per.where(F.col("size").between(*sizes)).crossJoin(F.broadcast(totals))
    return stats.adjust(d.withColumn("p", stats.tail(stats.hypergeometric_upper, F.col("overlap"), F.col("size"), F.col("drawn"), F.col("total"))), "p", "p_adj")


def top_genes(scores: DataFrame, n: int = 50) -> DataFrame:
    """EX-26: the n genes of highest score in each pattern, ties by gene."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy("pattern").orderBy(F.desc("v"), "gene"))).where(F.col("rank") <= n)


def pattern_markers(scores: DataFrame) -> DataFrame:
    """EX-27: marker scores of each (gene, pattern): z over the gene's patterns times v, softmax share, product of the ranks in gene and pattern, ratio to the largest other."""
    g, p = W.partitionBy("gene"), W.partitionBy("pattern")
    top = F.slice(F.sort_array(F.collect_list("v").over(g), asc=False), 1, 2)
    d = scores.withColumn("top", top)
    others = F.when(F.col("v") == F.col("top")[0], F.try_element_at("top", F.lit(2))).otherwise(F.col("top")[0])
    sd = F.stddev_samp("v").over(g)
    z = F.when(sd > 1e-9, (F.col("v") - F.avg("v").over(g)) / sd).otherwise(0.0)  # equal values differ by rounding alone
    share = F.exp(F.col("v") - F.max("v").over(g))
    d = d.withColumn("e", share)
    return d.select(
        "gene", "pattern", (z * F.col("v")).alias("weighted_z"), (F.col("e") / F.sum("e").over(g)).alias("softmax"),
        (F.rank().over(g.orderBy(F.desc("v"))) * F.rank().over(p.orderBy(F.desc("v")))).cast("bigint").alias("rank_product"), F.try_divide(F.col("v"), others).alias("ratio"),
    )


def compare_usage(usage: DataFrame, members: DataFrame) -> DataFrame:
    """EX-28: pattern usage (cell, pattern, v >= 0) of two groups: means, medians, log2 fold change, rank-sum z and p, BH."""
    long = usage.withColumnRenamed("pattern", "gene")
    medians = usage.join(members, "cell").groupBy("pattern").agg(*[F.percentile(F.when(F.col("group") == k, F.col("v")), 0.5).alias(f"median_{k}") for k in (1, 2)])
    tests = rank_sum(long, members, "v").withColumnRenamed("gene", "pattern").drop("pct_1", "pct_2", "u").withColumn("log2fc", F.log2(F.try_divide("mean_1", "mean_2"))).withColumn("p", stats.tail(stats.normal_two_sided, F.col("z")))
    return stats.adjust(tests.join(medians, "pattern"), "p", "p_adj")


def attach_usage(cells: DataFrame, usage: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """EX-29: cells with a usage column for each pattern, null where the cell has none."""
    wide = usage.groupBy("cell").agg(*[F.max(F.when(F.col("pattern") == p, F.col("v"))).alias(p) for p in patterns])
    return cells.join(wide, "cell", "left")


def expressed_any(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """EX-30: cells with any of the genes above 0."""
    return x.where(F.col("gene").isin(*genes) & (F.col("n") > 0)).select("cell").distinct()


def _profiles(points: DataFrame) -> DataFrame:
    return points.select(F.col("cell").alias("name"), F.col("embedding").alias("v"))


def min_js(a: DataFrame, b: DataFrame) -> DataFrame:
    """EX-31: least Jensen-Shannon divergence (base 2) of each profile of a to those of b; profiles are absolute values scaled to sum 1."""

    def least(one: pa.Table, two: pa.Table) -> pa.Table:
        p, q = (np.abs(tiles.matrix(t)) for t in (one, two))
        p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
        entropy = lambda x: -(x * np.log2(np.where(x > 0, x, 1))).sum(axis=-1)
        js, step = np.full(len(p), np.inf), max(1, tiles.ENTRIES // max(1, q.size))
        for at in range(0, len(p), step):
            some = p[at : at + step]
            js[at : at + step] = (entropy((some[:, None, :] + q[None, :, :]) / 2) - (entropy(some)[:, None] + entropy(q)[None, :]) / 2).min(axis=1)
        return pa.table({"cell": one.column("name"), "js": np.maximum(js, 0)})

    return tiles.cross(_profiles(a), _profiles(b), least, "cell string, js double").groupBy("cell").agg(F.min("js").alias("js"))


def _standard(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.full_like(x, np.nan), where=size > 0)


def max_r2(a: DataFrame, b: DataFrame, apart: bool = False) -> DataFrame:
    """EX-32: largest squared correlation of each profile of a with those of b (constant profiles count for nothing). apart: a cell isn't held against itself."""

    def largest(one: pa.Table, two: pa.Table) -> pa.Table:
        r2 = (_standard(tiles.matrix(one)) @ _standard(tiles.matrix(two)).T) ** 2
        if apart:
            r2[np.array(one.column("name").to_pylist(), object)[:, None] == np.array(two.column("name").to_pylist(), object)[None, :]] = np.nan
        best = np.where(np.isnan(r2), -1, r2).max(axis=1)
        return pa.table({"cell": one.column("name"), "r2": pa.array(best, mask=best < 0)})

    return tiles.cross(_profiles(a), _profiles(b), largest, "cell string, r2 double").groupBy("cell").agg(F.max("r2").alias("r2"))


def max_r2_null(a: DataFrame, pool: DataFrame, size: int, iterations: int = 5, seed: int = 123) -> DataFrame:
    """EX-32: (cell, random_r2, iterations): mean over iterations of the largest squared correlation of each profile of a with a random set of `size` of the pool, drawn without replacement by seeded hash."""
    out = None
    for i in range(iterations):  # a few sets, each one job over its own tiles
        drawn = stats.numbered(pool, "_at", F.xxhash64("cell", F.lit(seed), F.lit(i)), "cell").where(F.col("_at") < size).drop("_at")
        part = max_r2(a, drawn)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("cell").agg(F.avg("r2").alias("random_r2"), F.count("r2").alias("iterations"))


def silhouette(points: DataFrame, label: str) -> DataFrame:
    """EX-33: mean silhouette width of a labelling (squared Euclidean distance)."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = points.select(array_to_vector("embedding").alias("features"), F.col(label).cast("double").alias("prediction"))
    return points.sparkSession.createDataFrame([(float(ClusteringEvaluator().evaluate(data)),)], "silhouette double")


def crosstab(cells: DataFrame, rows: str, columns: str) -> DataFrame:
    """EX-34: cells by two labels and their share of the column."""
    counts = cells.groupBy(rows, columns).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(columns)))


def kruskal(df: DataFrame, value: str, group: str, *keys: str) -> DataFrame:
    """EX-35: Kruskal-Wallis H with tie correction over the groups, by keys, and its chi-square tail."""
    keys_ = list(keys)
    base = df.where(F.col(value).isNotNull())
    ranked = stats.midrank(base, value, "r", *keys_)
    sums = ranked.groupBy(*keys_, group).agg(F.sum("r").alias("r"), F.count("*").alias("k"))
    h = sums.groupBy(*keys_).agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("q"), F.count("*").alias("groups"))
    ties = base.groupBy(*keys_, value).agg(F.count("*").alias("t")).groupBy(*keys_).agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    d = h.join(ties, keys_) if keys_ else h.crossJoin(ties)
    n = F.col("n").cast("double")
    stat = (12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return d.select(*keys_, "n", "groups", stat.alias("h"), stats.tail(stats.chi_square_upper, stat, (F.col("groups") - 1).cast("double")).alias("p"))


BANDS = (-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0)


def band(value: Column, edges: Sequence[float] = BANDS) -> Column:
    """EX-36: number of the right-closed band of a coefficient, from 1; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:]), 1):
        out = (F.when if out is None else out.when)((value > lo) & (value <= hi), i)
    return out


def band_transitions(a: DataFrame, b: DataFrame) -> DataFrame:
    """EX-36: genes by their bands in two samples (gene, value); null in the second where it lacks the gene."""
    j = a.select("gene", band(F.col("value")).alias("from")).join(b.select("gene", band(F.col("value")).alias("to")), "gene", "left")
    return j.groupBy("from", "to").agg(F.count("*").alias("genes"))


def metric_summary(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """EX-37: correlations (metric, rho, p) of many samples by metric: mean, median, samples, significant ones."""
    return df.groupBy("metric").agg(F.avg("rho").alias("mean"), F.percentile("rho", 0.5).alias("median"), F.count("*").alias("samples"), F.count_if(F.col("p") < alpha).alias("significant"))


def score_matrix(scores: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """EX-38: set by pattern scores, 0 where none."""
    return scores.groupBy("gene_set").agg(*[F.coalesce(F.max(F.when(F.col("pattern") == p, F.col("es"))), F.lit(0.0)).alias(p) for p in patterns])


def split_cells(cells: DataFrame, predicate: Column) -> DataFrame:
    """EX-39: cells in or out of a group by a predicate; null counts as out."""
    return cells.select("cell", F.coalesce(predicate, F.lit(False)).alias("inside"))


def paired_rank_test(df: DataFrame, a: str, b: str) -> DataFrame:
    """EX-40: signed-rank test of pairs (zero differences left out): sum of positive ranks, z, p."""
    d = df.select((F.col(a) - F.col(b)).alias("d"), F.lit(1).alias("one")).where("d <> 0").withColumn("m", F.abs("d"))
    ranked = stats.midrank(d, "m", "r", "one").withColumn("t", F.count("*").over(W.partitionBy("m")))
    s = ranked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w"), F.sum(F.col("t").cast("double") * F.col("t") - 1).alias("ties"))
    n = F.col("n").cast("double")
    z = F.try_divide(F.col("w") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
    return s.select("n", "w", z.alias("z"), stats.tail(stats.normal_two_sided, z).alias("p"))


def cluster_centres(cells: DataFrame, cluster: str = "cluster") -> DataFrame:
    """EX-41: median coordinates of each cluster."""
    return cells.groupBy(cluster).agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"))
