"""Saturation and sampling curves. Draws follow seeded hashes of keys, so they are equal under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.functions import stats
from cytolake.functions.cigar import last_block
from cytolake.operators.reads import join_regions

MILLION = 1_000_000
#: Groups of a cell's genes in SAT-02.
GENE_BUCKETS = 8


def unit(*key: Column | str) -> Column:
    """A number in (0, 1) from the hash of a key."""
    return (F.pmod(F.xxhash64(*key), F.lit(MILLION * MILLION)) + 0.5) / (MILLION * MILLION)


def read_saturation(molecules: DataFrame) -> DataFrame:
    """SAT-01: per cell reads, molecules, genes and saturation 1 - molecules / reads, with the total in cell null."""
    m = molecules.groupBy("cell", "umi", "gene").agg(F.sum("reads").alias("reads"))
    parts = [F.sum("reads").alias("reads"), F.count("*").alias("umis"), F.count_distinct("gene").alias("genes"), (1 - F.count("*") / F.sum("reads")).alias("saturation")]
    return m.groupBy("cell").agg(*parts).unionByName(m.agg(*parts).select(F.lit(None).cast("string").alias("cell"), "reads", "umis", "genes", "saturation"))


def _poisson(mean: Column, u: Column) -> Column:
    """Poisson draw by inversion of a uniform number, a whole batch at once."""

    @F.pandas_udf("int")
    def draw(means: pd.Series, units: pd.Series) -> pd.Series:
        m, x = means.to_numpy(float), units.to_numpy(float)
        out, k = np.zeros(len(m), np.int32), 0
        p = np.exp(-m)
        total = p.copy()
        live = x > total
        while live.any() and k < 10_000:
            k += 1
            out[live] = k
            p *= m / k
            total += p
            live = (x > total) & (p > 0)
        return pd.Series(out)

    return draw(mean, u)


def rarefaction(molecules: DataFrame, fractions: Sequence[float], repeats: int, seed: int, replace: bool = True) -> DataFrame:
    """SAT-02: at each fraction and repeat median molecules and genes per cell and the saturation of the drawn reads.

    With replacement each molecule's reads are a Poisson draw (no global sort); without it, every read is kept by its own
    hash. All draws of a molecule are columns of its one row, which is shuffled once: a cell's genes go to GENE_BUCKETS
    groups, counted there and added up a cell.
    """
    runs = [(float(f), k) for f in fractions for k in range(repeats)]

    def drawn(f: float, k: int) -> Column:
        fraction, repeat = F.lit(f), F.lit(k)
        if replace:
            return _poisson(F.col("reads") * fraction, unit("cell", "gene", "umi", fraction, repeat, F.lit(seed)))
        return F.size(F.filter(F.sequence(F.lit(1), F.col("reads").cast("int")), lambda i: (F.pmod(F.xxhash64(F.col("cell"), F.col("gene"), F.col("umi"), repeat, i, F.lit(seed)), F.lit(MILLION)) + 0.5) / MILLION <= fraction))

    bucket = F.pmod(F.xxhash64("gene"), F.lit(GENE_BUCKETS)).alias("bucket")
    m = molecules.select("cell", "gene", "umi", "reads", bucket).repartition("cell", "bucket")
    d = m.select("cell", "bucket", "gene", *[drawn(f, k).alias(f"d{i}") for i, (f, k) in enumerate(runs)])
    some = [F.when(F.col(f"d{i}") > 0, F.col(f"d{i}")) for i in range(len(runs))]
    genes = d.groupBy("cell", "bucket", "gene").agg(*[x for i, s in enumerate(some) for x in (F.count(s).alias(f"u{i}"), F.sum(s).alias(f"r{i}"))])
    parts = genes.groupBy("cell", "bucket").agg(*[x for i in range(len(runs)) for x in (F.sum(f"u{i}").alias(f"u{i}"), F.count_if((F.col(f"u{i}") > 0) & F.col("gene").isNotNull()).alias(f"g{i}"), F.sum(f"r{i}").alias(f"r{i}"))])
    sums = parts.groupBy("cell").agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(len(runs)) for c in "ugr"])
    rows = F.array(*[F.struct(F.lit(f).alias("fraction"), F.lit(k).alias("repeat"), F.col(f"u{i}").alias("umis"), F.col(f"g{i}").alias("genes"), F.col(f"r{i}").alias("reads")) for i, (f, k) in enumerate(runs)])
    cells = sums.select("cell", F.inline(rows)).where("umis > 0")
    return cells.groupBy("fraction", "repeat").agg(F.percentile("umis", 0.5).alias("median_umis"), F.percentile("genes", 0.5).alias("median_genes"), F.count("*").alias("cells"), (1 - F.sum("umis") / F.sum("reads")).alias("saturation"))


def region_umis(reads: DataFrame, regions: DataFrame, min_reads: int, min_umis: int, one_based: bool = True) -> DataFrame:
    """SAT-03: molecules of each region with min_reads reads, of cells with min_umis of them."""
    placed = reads.where("cb IS NOT NULL AND ub IS NOT NULL").select("cb", "ub", "ref", last_block(F.col("cigar"), F.col("pos")).alias("b"))
    blocks = placed.select("cb", "ub", "ref", F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    hit = join_regions(blocks, regions.withColumn("start_pos", F.col("start_pos") - (1 if one_based else 0)))
    umis = hit.groupBy("target", "cb", "ub").agg(F.count("*").alias("reads")).where(F.col("reads") >= min_reads)
    return umis.withColumn("n", F.count("*").over(W.partitionBy("target", "cb"))).where(F.col("n") >= min_umis).drop("n")


def region_rarefaction(umis: DataFrame, fractions: Sequence[float], repeats: int, seed: int) -> DataFrame:
    """SAT-04: cells found at each fraction of reads drawn without replacement: mean, deviation over repeats, gain over the fraction before.

    A cell is found at a fraction if the least of its reads' uniform numbers is. The least of n is distributed as
    1 - (1 - u)^(1/n), so one number a cell and repeat stands for all its reads.
    """
    cells = umis.groupBy("target", "cb").agg(F.sum("reads").alias("reads"))
    runs = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    least = 1 - F.pow(1 - unit("target", "cb", "repeat", F.lit(seed)), 1.0 / F.col("reads"))
    at = runs.select("target", "repeat", least.alias("u"), F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    found = at.groupBy("target", "fraction", "repeat").agg(F.count_if(F.col("u") <= F.col("fraction")).alias("cells"))
    curve = found.groupBy("target", "fraction").agg(F.avg("cells").alias("mean"), F.stddev_samp("cells").alias("sd"))
    return curve.withColumn("gain", F.col("mean") - F.lag("mean").over(W.partitionBy("target").orderBy("fraction")))


def umi_saturation(umis: DataFrame, min_reads: int) -> DataFrame:
    """SAT-05: molecules above, at one below, and further below the threshold, share of reads on those that pass, median reads."""
    r = F.col("reads")
    return umis.agg(F.count_if(r >= min_reads).alias("above"), F.count_if(r == min_reads - 1).alias("one_below"), F.count_if(r < min_reads - 1).alias("below"), (F.sum(F.when(r >= min_reads, r).otherwise(0)) / F.sum(r)).alias("share"), F.percentile("reads", 0.5).alias("median"))


def _depths(x: DataFrame, genes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    cells = x.groupBy("cell").agg(F.sum("n").alias("depth"))
    total = x.agg(F.sum("n").alias("total"), F.count_distinct("cell").alias("cells"))
    sums = x.where(F.col("gene").isin(*genes)).groupBy("gene").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"), F.count_if(F.col("n") > 0).alias("seen"))
    return cells, sums.crossJoin(F.broadcast(total))


def dropout_poisson(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """SAT-06: expected dropout exp(-depth * p) of each gene over cells (mean, median) against the observed share of zeros.

    Cells of equal depth count once, in one histogram of depths for all genes. The median of a monotone function lies at
    the middle depths, so it needs no row a gene and cell either: two numbers of the histogram are enough.
    """
    cells, sums = _depths(x, genes)
    depths = cells.groupBy("depth").agg(F.count("*").alias("k"))
    run = stats.running(depths, "depth", "k")
    below, upto, half = F.col("run_k") - F.col("k"), F.col("run_k"), (F.col("all_k") - 1) / 2
    here = lambda at: F.max(F.when((below <= at) & (at < upto), F.col("depth")))
    middle = run.agg(here(F.floor(half)).alias("low"), here(F.ceil(half)).alias("high"))  # one row
    p = F.col("s") / F.col("total")
    genes_at = sums.crossJoin(F.broadcast(middle)).withColumn("median", (F.exp(-F.col("low") * p) + F.exp(-F.col("high") * p)) / 2)
    mean = depths.join(F.broadcast(sums.select("gene", p.alias("p")))).groupBy("gene").agg((F.sum(F.col("k") * F.exp(-F.col("depth") * F.col("p"))) / F.sum("k")).alias("mean"))  # asked genes by distinct depths
    out = genes_at.join(mean, "gene").select("gene", "mean", "median", (1 - F.col("seen") / F.col("cells")).alias("observed"))
    return out.withColumn("verdict", F.when(F.col("observed") > F.col("mean") + 0.05, "more zeros than sampling").otherwise("sampling"))


def dropout_nb(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """SAT-07: negative-binomial share of zeros by moments (population variance, zeros included); Poisson where the variance doesn't exceed the mean."""
    _, sums = _depths(x, genes)
    mean = F.col("s") / F.col("cells")
    var = F.col("q") / F.col("cells") - mean * mean
    d = sums.select("gene", mean.alias("mean"), var.alias("variance"))
    k = F.col("mean") * F.col("mean") / (F.col("variance") - F.col("mean"))
    return d.withColumn("p0", F.when(F.col("variance") > F.col("mean"), F.pow(k / (k + F.col("mean")), k)).otherwise(F.exp(-F.col("mean"))))


def sample_cells(df: DataFrame, key: Sequence[str], percents: Sequence[int], repeats: int, seed: int) -> DataFrame:
    """SAT-08, SAT-09: cells and molecules covered by rows drawn with replacement (Poisson numbers of draws; weight column reads where there is one)."""
    runs = F.explode(F.array(*[F.struct(F.lit(p).alias("percent"), F.lit(k).alias("repeat")) for p in percents for k in range(repeats)]))
    weight = F.col("reads") if "reads" in df.columns else F.lit(1)
    d = df.select(*key, weight.alias("w"), runs.alias("run")).select(*key, "w", "run.*")
    hit = d.where(unit(*key, "percent", "repeat", F.lit(seed)) > F.exp(-F.col("w") * F.col("percent") / 100.0))
    return hit.groupBy("percent", "repeat").agg(F.count_distinct("cell").alias("cells"), F.count_distinct("cell", "umi").alias("umis"))


def sampling_summary(results: DataFrame) -> DataFrame:
    """SAT-10: mean and deviation of coverage at each percentage."""
    return results.groupBy("percent").agg(F.avg("cells").alias("mean"), F.stddev_samp("cells").alias("sd"), F.count("*").alias("repeats"))


def fit_curves(results: DataFrame, target: float = 0.9) -> DataFrame:
    """SAT-11: Michaelis-Menten, logarithmic and power curves of coverage by percentage, per sample: parameters, R squared, percentage that reaches the target of the maximum.

    At most some twenty points a sample reach a group.
    """

    def fit(points: pd.DataFrame) -> pd.DataFrame:
        x, y = points["percent"].to_numpy(float), points["mean"].to_numpy(float)
        rows = []
        line = lambda u, v: np.polyfit(u, v, 1) if len(set(u)) > 1 else (0.0, float(np.mean(v)))
        ok = (x > 0) & (y > 0)
        b, a = line(1 / x[ok], 1 / y[ok]) if ok.any() else (0.0, 1.0)
        top, half = (1 / a, b / a) if a > 0 else (float("nan"), float("nan"))
        c, d = line(np.log(x[ok]), y[ok]) if ok.any() else (0.0, 0.0)
        m, k = line(np.log(x[ok]), np.log(y[ok])) if ok.any() else (0.0, 0.0)
        need = target * half / (1 - target)
        for name, p1, p2, f, at in (("michaelis-menten", top, half, top * x / (half + x), need), ("logarithmic", c, d, c * np.log(np.maximum(x, 1e-9)) + d, float("nan")), ("power", np.exp(k), m, np.exp(k) * x**m, float("nan"))):
            ss = ((y - y.mean()) ** 2).sum()
            rows.append((points["sample"].iat[0], name, float(p1), float(p2), float(1 - ((y - f) ** 2).sum() / ss) if ss else 1.0, float(at)))
        return pd.DataFrame(rows, columns=["sample", "curve", "a", "b", "r2", "required_percent"])

    return results.groupBy("sample").applyInPandas(fit, "sample string, curve string, a double, b double, r2 double, required_percent double")


def sequencing_decision(fits: DataFrame, enough: float = 0.9) -> DataFrame:
    """SAT-12: coverage share at 100 percent by the Michaelis-Menten fit, the scale to reach the target, and what to do."""
    share = 100.0 / (100.0 + F.col("b"))
    return fits.where("curve = 'michaelis-menten'").select("sample", share.alias("share"), (F.col("required_percent") / 100).alias("scale"), F.when(share >= enough, "stop").when(share >= 0.5, "sequence more").otherwise("new library").alias("decision"))


def saturation_curve(fits: DataFrame, reads: DataFrame, percents: Sequence[int]) -> DataFrame:
    """SAT-13: reads, fitted coverage and its share of the maximum at each percentage."""
    m = fits.where("curve = 'michaelis-menten'").join(reads, "sample")
    return m.select("sample", "a", "b", "reads", F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")).select("sample", "percent", (F.col("reads") * F.col("percent") / 100).alias("reads"), (F.col("a") * F.col("percent") / (F.col("b") + F.col("percent"))).alias("coverage"), (F.col("percent") / (F.col("b") + F.col("percent"))).alias("saturation"))


def info_content(molecules: DataFrame, percents: Sequence[int], cap: int, seed: int) -> DataFrame:
    """SAT-14: share of the information (molecules of a cell, counted up to cap) in each percentage of molecules, by seeded rank."""
    at = molecules.select("cell", unit("cell", "umi", F.lit(seed)).alias("u"), F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent"))
    cells = at.groupBy("percent", "cell").agg(F.least(F.count_if(F.col("u") * 100 <= F.col("percent")), F.lit(cap)).alias("n"), F.least(F.count("*"), F.lit(cap)).alias("all"))
    return cells.groupBy("percent").agg((F.sum("n") / F.sum("all")).alias("share"))


def depth_curve(molecules: DataFrame, steps: int = 8, seed: int = 1) -> DataFrame:
    """SAT-15: cells and median molecules at log-spaced depths, with the knee: the point farthest above the chord."""
    fractions = [float(f) for f in np.logspace(-2, 0, steps)]
    curve = rarefaction(molecules, fractions, 1, seed, replace=False).drop("repeat")
    w = W.partitionBy(F.lit(1))  # one row a depth
    x, y = F.log10("fraction"), F.col("cells")
    chord = F.min(y).over(w) + (x - F.min(x).over(w)) / (F.max(x).over(w) - F.min(x).over(w)) * (F.max(y).over(w) - F.min(y).over(w))
    d = curve.withColumn("above", y - chord)
    return d.withColumn("knee", F.row_number().over(w.orderBy(F.desc("above"), "fraction")) == 1)


def cell_curves(molecules: DataFrame, fractions: Sequence[float], least: int = 50, seed: int = 1) -> DataFrame:
    """SAT-16: molecules found at each fraction over cells with enough reads: mean, median, standard error of their share, and the mean number.

    A molecule of r reads is found at fraction f with probability 1 - (1 - f)^r.
    """
    per = molecules.groupBy("cell").agg(F.sum("reads").alias("reads"), F.count("*").alias("umis")).where(F.col("reads") >= least)
    m = molecules.join(per.select("cell", F.col("umis").alias("all")), "cell").select("cell", "umi", "gene", "reads", "all", F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("fraction"))
    seen = unit("cell", "umi", "gene", F.lit(seed)) > F.pow(1 - F.col("fraction"), F.col("reads"))
    cells = m.groupBy("fraction", "cell", "all").agg(F.count_if(seen).alias("n"))
    share = F.col("n") / F.col("all")
    return cells.groupBy("fraction").agg(F.avg(share).alias("mean"), F.percentile(share, 0.5).alias("median"), (F.stddev_samp(share) / F.sqrt(F.count("*"))).alias("se"), F.avg("n").alias("mean_umis"), F.count("*").alias("cells"))


def curve_end(curves: DataFrame, value: str = "mean_umis") -> DataFrame:
    """SAT-16: the curve at 90 and at 80 percent of the reads against all of them, and its slope over that last fifth."""
    at = lambda f: F.max(F.when(F.abs(F.col("fraction") - f) < 1e-9, F.col(value)))
    last = F.col("fraction") >= 0.8 - 1e-9
    over = lambda fn, c: fn(F.when(last, F.col(c)))
    slope = F.try_divide(over(F.max, value) - over(F.min, value), over(F.max, "fraction") - over(F.min, "fraction"))
    return curves.agg((at(0.9) / at(1.0)).alias("ratio_90"), (at(0.8) / at(1.0)).alias("ratio_80"), slope.alias("slope"))


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """SAT-17: share of rows up to each distinct value."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    return stats.running(counts, value, "n").select(value, "n", (F.col("run_n") / F.col("all_n")).alias("share"))
