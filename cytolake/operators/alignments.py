"""Alignment columns and genome tracks as long tables, exon inclusion, and spot tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.functions import stats
from cytolake.functions.graph import greedy_clusters
from cytolake.plans.staging import staged

#: Fixed value: amino acids of the codons in T, C, A, G order of all three bases; * is a stop.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), CODE))


def column_occupancy(aln: DataFrame, share: float, reference: int | None = None) -> DataFrame:
    """SEQ-01: bases per column and whether their share reaches the threshold; columns of the reference count as occupied."""
    n = aln.select("seq_id").distinct().agg(F.count("*").alias("total"))
    forced = F.lit(False) if reference is None else F.max((F.col("seq_id") == reference) & (F.col("base") != "-"))
    per = aln.groupBy("pos").agg(F.count_if(F.col("base") != "-").alias("bases"), forced.alias("forced"))
    return per.crossJoin(F.broadcast(n)).select("pos", "bases", ((F.col("bases") >= share * F.col("total")) | F.col("forced")).alias("occupied"))


def column_profile(aln: DataFrame) -> DataFrame:
    """SEQ-02: share of each symbol in its column, with gaps and without them."""
    w = W.partitionBy("pos")
    base = F.when(F.col("base") != "-", F.col("n"))
    counts = aln.groupBy("pos", "base").agg(F.count("*").alias("n"))
    return counts.select("pos", "base", (F.col("n") / F.sum("n").over(w)).alias("share"), F.try_divide(base, F.sum(base).over(w)).alias("share_without_gaps"))


def translate(aln: DataFrame) -> DataFrame:
    """SEQ-03: amino acids by codon place; any gap gives a gap, an unknown codon X, incomplete codons none."""
    table = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    codon = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "")
    per = aln.groupBy("seq_id", (F.floor((F.col("pos") - 1) / 3) + 1).cast("bigint").alias("codon_pos")).agg(codon.alias("codon")).where(F.length("codon") == 3)
    return per.select("seq_id", "codon_pos", F.when(F.col("codon").contains("-"), "-").otherwise(F.coalesce(F.try_element_at(table, F.col("codon")), F.lit("X"))).alias("residue"))


def residue_profile(residues: DataFrame) -> DataFrame:
    """SEQ-03: share of each residue at its place."""
    counts = residues.groupBy("codon_pos", "residue").agg(F.count("*").alias("n"))
    return counts.select("codon_pos", "residue", (F.col("n") / F.sum("n").over(W.partitionBy("codon_pos"))).alias("share"))


def column_diversity(aln: DataFrame, gap_cut: float = 0.5, reference: int | None = None) -> DataFrame:
    """SEQ-04: differing pairs over comparable pairs of each column, from counts alone; gaps, X and the reference row are left out, and so are gappy columns."""
    rows = aln if reference is None else aln.where(F.col("seq_id") != reference)
    bases = F.col("base").isin("-", "X")
    counts = rows.groupBy("pos", "base").agg(F.count("*").alias("n"))
    per = counts.groupBy("pos").agg(F.sum("n").alias("rows"), F.sum(F.when(~bases, F.col("n")).otherwise(0)).alias("m"), F.sum(F.when(~bases, F.col("n") * (F.col("n") - 1) / 2).otherwise(0)).alias("same"))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    return per.where((F.col("rows") - F.col("m")) <= gap_cut * F.col("rows")).select("pos", F.coalesce(F.try_divide(pairs - F.col("same"), pairs), F.lit(0.0)).alias("diversity"))


def reference_positions(aln: DataFrame, reference: int) -> DataFrame:
    """Columns where the reference has a base, numbered."""
    return aln.where((F.col("seq_id") == reference) & (F.col("base") != "-")).select("pos", F.row_number().over(W.orderBy("pos")).cast("bigint").alias("ref_pos"))  # one row a column


def protein_diversity(diversity: DataFrame, aln: DataFrame, reference: int, proteins: Sequence[tuple[str, int]]) -> DataFrame:
    """SEQ-05: diversity by protein and place in it, by cumulative lengths along the reference, with each protein's mean."""
    bounds, at = [], 0
    for name, length in proteins:
        bounds.append((name, at + 1, at + length))
        at += length
    ranges = aln.sparkSession.createDataFrame(bounds, "protein string, first long, last long")
    placed = diversity.join(reference_positions(aln, reference), "pos").join(F.broadcast(ranges), F.col("ref_pos").between(F.col("first"), F.col("last")))
    return placed.select("protein", (F.col("ref_pos") - F.col("first") + 1).alias("position"), "diversity", F.avg("diversity").over(W.partitionBy("protein")).alias("mean"))


def high_diversity(diversity: DataFrame, least: float = 0.1) -> DataFrame:
    """SEQ-06: columns of at least the diversity."""
    return diversity.where(F.col("diversity") >= least)


def cut_regions(aln: DataFrame, reference: int, regions: Sequence[tuple[str, int, int]]) -> DataFrame:
    """SEQ-07: gene regions by reference places (several parts of one name join in order), renumbered, the last three columns (stop codon) dropped."""
    ranges = aln.sparkSession.createDataFrame([(g, i, a, b) for i, (g, a, b) in enumerate(regions)], "gene string, part int, first long, last long")
    columns = reference_positions(aln, reference).join(F.broadcast(ranges), F.col("ref_pos").between(F.col("first"), F.col("last")))
    w = W.partitionBy("gene")
    numbered = columns.select("gene", "pos", F.row_number().over(w.orderBy("part", "pos")).cast("bigint").alias("new_pos"), F.count("*").over(w).alias("size")).where(F.col("new_pos") <= F.col("size") - 3)
    return aln.join(F.broadcast(numbered.drop("size")), "pos").select("gene", "seq_id", "new_pos", "base")


def dominant(aln: DataFrame, cut: float = 0.9) -> DataFrame:
    """SEQ-08: the commonest symbol of each column, or the two commonest joined where the first is below the share."""
    shares = column_profile(aln)
    ranked = shares.withColumn("k", F.row_number().over(W.partitionBy("pos").orderBy(F.desc("share"), "base")))
    one, two = F.max(F.when(F.col("k") == 1, F.col("base"))), F.max(F.when(F.col("k") == 2, F.col("base")))
    return ranked.groupBy("pos").agg(F.when(F.max("share") >= cut, one).otherwise(F.concat(one, F.coalesce(two, F.lit("")))).alias("dominant"))


def alignment_score(a: DataFrame, b: DataFrame, by_share: bool = False) -> DataFrame:
    """SEQ-09: share of equal places of each sequence in two alignments, or the mean column share in b of a's symbols (b may be a itself, which is made once then)."""
    if by_share:
        a, b = (staged(a),) * 2 if a is b else (a, b)
        return a.join(column_profile(b).select("pos", "base", "share"), ["pos", "base"], "left").groupBy("seq_id").agg(F.avg(F.coalesce("share", F.lit(0.0))).alias("score"))
    j = a.select("seq_id", "pos", F.col("base").alias("x")).join(b.select("seq_id", "pos", F.col("base").alias("y")), ["seq_id", "pos"])
    return j.groupBy("seq_id").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("score"))


def drop_sparse_columns(aln: DataFrame, cut: float = 0.1) -> DataFrame:
    """SEQ-10: without columns whose occupancy is below the share and below a neighbour's; the rest are renumbered."""
    occ = aln.groupBy("pos").agg(F.avg((F.col("base") != "-").cast("double")).alias("o"))
    w = W.orderBy("pos")  # one row a column
    kept = occ.withColumn("next_to", F.greatest(F.coalesce(F.lag("o").over(w), F.lit(0.0)), F.coalesce(F.lead("o").over(w), F.lit(0.0)))).where(~((F.col("o") < cut) & (F.col("next_to") > F.col("o"))))
    numbered = kept.select("pos", F.row_number().over(w).cast("bigint").alias("new_pos"))
    return aln.join(F.broadcast(numbered), "pos").select("seq_id", "new_pos", "base")


def a_rich_regions(seqs: DataFrame, least: int = 6, mismatches: int = 2) -> DataFrame:
    """SEQ-11: from each A the longest stretch that ends in A with at most the mismatches, of at least `least` bases (fewest mismatches at equal length).

    All starts of a run of A share their end: the one before the last of the next mismatches that follows an A.
    """
    others = F.filter(F.transform(F.split("seq", ""), lambda c, i: F.when(c != "A", i + 1)), lambda p: p.isNotNull())
    # Places of other bases, between those before the first base and after the last.
    places = seqs.select("seq_id", F.concat(F.array(F.lit(0)), others, F.array(F.length("seq") + 1)).alias("b"))
    place = lambda k: F.get("b", k)

    def run(k: Column) -> Column:
        missed = F.coalesce(*[F.when(place(k + m + 1) - place(k + m) > 1, m) for m in range(mismatches, 0, -1)], F.lit(0))
        return F.struct((place(k) + 1).alias("low"), (place(k + 1) - 1).alias("high"), (place(k + 1 + missed) - 1).alias("end"), missed.alias("mismatches"))

    runs = F.filter(F.transform(F.sequence(F.lit(0), F.size("b") - 2), run), lambda r: r["end"] - r["low"] + 1 >= least)
    runs = places.select("seq_id", F.inline(F.filter(runs, lambda r: r["high"] >= r["low"])))
    starts = F.explode(F.sequence("low", F.least("high", F.col("end") - least + 1)))
    found = runs.select("seq_id", starts.alias("start"), "end", "mismatches")
    return found.select("seq_id", F.col("start").cast("bigint").alias("start"), (F.col("end") - F.col("start") + 1).cast("bigint").alias("length"), F.col("mismatches").cast("bigint").alias("mismatches"))


def window_counts(positions: DataFrame, size: int, last: int) -> DataFrame:
    """SEQ-12: positions in each window of `size` up to `last`, zeros kept."""
    windows = positions.sparkSession.range(0, last // size + 1).select((F.col("id") * size).alias("window"))
    counts = positions.where(F.col("pos") <= last).groupBy((F.floor(F.col("pos") / size) * size).alias("window")).agg(F.count("*").alias("n"))
    return windows.join(counts, "window", "left").na.fill(0, ["n"])


def landmark_distance(positions: DataFrame, marks: Sequence[int], bin: int = 100) -> DataFrame:
    """SEQ-13: positions by sample and bin of their distance to the nearest landmark at or before them, with the distance's band."""
    before = F.array_max(F.filter(F.array(*[F.lit(m) for m in sorted(marks)]), lambda m: m <= F.col("pos")))
    d = F.col("pos") - before
    band = F.when(d < 100, "near").when(d < 1000, "middle").otherwise("far")
    return positions.select("sample", (F.floor(d / bin) * bin).cast("bigint").alias("bin"), F.when(d.isNotNull(), band).alias("band")).where("bin IS NOT NULL").groupBy("sample", "bin", "band").agg(F.count("*").alias("n"))


#: Positions of a stretch in SEQ-14.
STRETCH = 1024


def cluster_reads(reads: DataFrame, within: int = 5, mer: int = 10) -> DataFrame:
    """SEQ-14: greedy clusters (read_id, pos, seq): reads by position join the first open seed within `within` bases that shares their first and last 10-mer or whole sequence.

    Reads of a signature at one place go together, so places are what is clustered. The seed after a seed is the first
    place beyond its reach, which is a function of the place; seeds are the places that it leads to from places
    with nothing in reach before them. They are found by pointer doubling: in round k every place knows the
    2^k-th seed after it, and the seeds found so far lead to as many more. A chain of n seeds takes about log2(n) rounds of
    joins by signature and place, of chained places only. What is in reach is seen in stretches of STRETCH positions of a
    signature, which share the places at their ends, so no group is larger than a stretch and few places are copied.
    Reads without position, or shorter than the 10-mers, have no cluster.
    """
    # As an array of one, so a sequence is made once a read.
    ends = F.transform(F.array("seq"), lambda s: F.when(F.length(s) >= mer, F.concat(F.substring(s, 1, mer), F.substring(s, -mer, mer))))[0]
    signed = staged(reads.select("read_id", "pos", F.when(F.col("pos").isNotNull(), ends).alias("signature")))
    places = signed.where("signature IS NOT NULL").groupBy("signature", F.col("pos").cast("long").alias("pos")).agg(F.min("read_id").alias("name"))
    width = max(STRETCH, 5 * within)

    def stretched(df: DataFrame) -> DataFrame:
        at = lambda d: F.floor((F.col("pos") + d) / width)
        return df.select("*", at(0).alias("own"), F.explode(F.sequence(at(-2 * within), at(2 * within))).alias("stretch")).withColumn("own", F.col("own") == F.col("stretch"))

    order = W.partitionBy("signature", "stretch").orderBy("pos")
    count = lambda low, high: F.count("*").over(order.rangeBetween(low, high)) > 0
    # Where a place lies within twice the reach, the first of them is next; farther ones have nothing in reach before them.
    seen = stretched(places).withColumns({"before": count(-within, -1), "after": count(1, within), "to": F.min("pos").over(order.rangeBetween(within + 1, 2 * within))})
    seen = staged(seen.where("own").drop("own", "stretch"))
    jump = seen.where("to IS NOT NULL").select("signature", "pos", "to")
    found = seen.where("NOT before AND to IS NOT NULL").select("signature", "pos")
    while not jump.isEmpty():
        found = staged(found.union(found.join(jump, ["signature", "pos"]).select("signature", "to")).distinct())
        jump = staged(jump.join(jump.select("signature", F.col("pos").alias("to"), F.col("to").alias("then")), ["signature", "to"]).select("signature", "pos", F.col("then").alias("to")))
    near = seen.where("before OR after").join(found.withColumn("found", F.lit(True)), ["signature", "pos"], "left")
    seed = F.when(~F.col("before") | F.coalesce("found", F.lit(False)), F.col("name"))
    joined = stretched(near.select("signature", "pos", seed.alias("seed"))).withColumn("cluster", F.max("seed").over(order.rangeBetween(-within, 0)))  # one at most
    clusters = joined.where("own").select("signature", "pos", "cluster").unionByName(seen.where("NOT before AND NOT after").select("signature", "pos", F.col("name").alias("cluster")))
    return signed.join(clusters, ["signature", "pos"], "left").select("read_id", "cluster")


def cluster_consensus(reads: DataFrame, cluster: str) -> DataFrame:
    """SEQ-15: positions of each cluster: mean (half-even), median, range, deviation, cells, sequence of its first read (pos, read_id), and its confidence by reads."""
    p = F.col("pos")
    return reads.groupBy(cluster).agg(
        F.count("*").alias("reads"), F.bround(F.avg(p), 0).alias("mean"), F.percentile(p, 0.5).alias("median"), (F.max(p) - F.min(p)).alias("range"), F.stddev_samp(p).alias("sd"),
        F.count_distinct("cell").alias("cells"), F.min_by("seq", F.struct("pos", "read_id")).alias("sequence"), F.when(F.count("*") >= 10, "high").when(F.count("*") >= 3, "medium").otherwise("low").alias("confidence"),
    )


def consensus_summary(consensus: DataFrame, least: int = 3) -> DataFrame:
    """SEQ-15: clusters, those of `least` reads, of several cells, of both, and how far clusters reduce positions, in percent."""
    sure, several = F.col("reads") >= least, F.col("cells") > 1
    return consensus.agg(
        F.sum("reads").alias("positions"), F.count("*").alias("sites"), (100.0 * (1 - F.count("*") / F.sum("reads"))).alias("reduction"), F.count_if(sure).alias("confident"),
        F.count_if(several).alias("several_cells"), F.count_if(sure & several).alias("both"), F.max("reads").alias("largest"),
    )


def umi_groups(positions: DataFrame, within: int = 10) -> DataFrame:
    """SEQ-16: molecules with reads, number in the cell, and whether their positions agree."""
    per = positions.groupBy("cell", "umi").agg(F.count("*").alias("size"), (F.max("pos") - F.min("pos")).alias("spread"))
    return per.select("cell", "umi", "size", F.dense_rank().over(W.partitionBy("cell").orderBy("umi")).cast("bigint").alias("group"), (F.col("spread") <= within).alias("consistent"))


def umi_consensus(reads: DataFrame) -> DataFrame:
    """SEQ-17: median position (half-even) of each molecule (cell, umi), the reads right there, and their median length and commonest sequence (ties: the first)."""
    named = reads.where("cell <> '' AND umi <> ''")
    centre = named.groupBy("cell", "umi").agg(F.bround(F.percentile("pos", 0.5), 0).alias("consensus"))
    there = named.join(centre, ["cell", "umi"]).where("pos = consensus")
    return there.groupBy("cell", "umi").agg(F.min("pos").alias("pos"), F.count("*").alias("reads"), F.bround(F.percentile(F.length("seq"), 0.5), 0).alias("length"), F.mode("seq", True).alias("sequence"))


def round_to_common(df: DataFrame, group: str, within: int = 2) -> DataFrame:
    """SEQ-18: each value of a group becomes the commonest value within `within` of it that is itself unmoved (falling count, then value)."""
    counts = staged(df.groupBy(group, "pos").agg(F.count("*").alias("n")).withColumn("id", F.struct(group, "pos")))
    a = counts.select(group, F.col("id").alias("a"), F.col("n").alias("na"), F.explode(F.array(*[F.col("pos") + d for d in range(-within, within + 1) if d])).alias("pos"))
    b = counts.select(group, "pos", F.col("id").alias("b"), F.col("n").alias("nb"))
    earlier = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    links = staged(a.join(b, [group, "pos"]).where(earlier).select("a", "na", "b"))
    return greedy_clusters(counts, links).select(F.col(f"id.{group}"), F.col("id.pos").alias("pos"), F.col("centre.pos").alias("rounded"))


def bin_bias(positions: DataFrame, a: str, b: str, bin: int = 100) -> DataFrame:
    """SEQ-19: log2 of (a + 1) / (b + 1) reads of two samples by bin, and its class."""
    per = positions.groupBy((F.floor(F.col("pos") / bin) * bin).alias("bin")).agg(F.count_if(F.col("sample") == a).alias("a"), F.count_if(F.col("sample") == b).alias("b"))
    ratio = F.log2((F.col("a") + 1.0) / (F.col("b") + 1.0))
    return per.withColumn("log2_ratio", ratio).withColumn("bias", F.when(F.col("log2_ratio") > 1, "a").when(F.col("log2_ratio") < -1, "b").otherwise("even"))


def interval_counts(positions: DataFrame, marks: Sequence[int]) -> DataFrame:
    """SEQ-20: reads, molecules, cells and their pairs between consecutive landmarks (open on the left)."""
    marks = sorted(marks)
    ranges = positions.sparkSession.createDataFrame(list(zip(marks, marks[1:])), "low long, high long")
    j = positions.join(F.broadcast(ranges), (F.col("pos") > F.col("low")) & (F.col("pos") <= F.col("high")))
    return j.groupBy("low", "high").agg(F.count("*").alias("reads"), F.count_distinct("umi").alias("umis"), F.count_distinct("cell").alias("cells"), F.count_distinct("cell", "umi").alias("pairs"))


def distance_trend(bins: DataFrame) -> DataFrame:
    """SEQ-21: correlation of bin and log2 ratio."""
    return bins.agg(stats.correlation("bin", "log2_ratio").alias("r"))


def find_exons(events: DataFrame, targets: DataFrame) -> DataFrame:
    """PSI-01: events of the target exons by gene, chromosome and exact ends."""
    return events.join(targets, ["gene", "chrom", "start_pos", "end_pos"])


def _mean_level(levels: Column) -> Column:
    values = F.filter(F.transform(F.split(levels, ","), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def psi_means(events: DataFrame, fdr: float = 0.05, delta: float = 0.1) -> DataFrame:
    """PSI-02: mean inclusion levels of both samples without NA, their difference, and its significance."""
    d = events.withColumn("mean_1", _mean_level(F.col("levels_1"))).withColumn("mean_2", _mean_level(F.col("levels_2"))).withColumn("delta", F.col("mean_1") - F.col("mean_2"))
    return d.withColumn("significant", (F.col("fdr") < fdr) & (F.abs("delta") > delta))


def pseudobulk_psi(x: DataFrame, targets: DataFrame) -> DataFrame:
    """PSI-03: pooled inclusion of each target, cells with reads; zeros and null where there is no event."""
    sums = x.groupBy("gene").agg(F.sum("inclusion").alias("i"), F.sum("exclusion").alias("e"), F.count_distinct(F.when(F.col("inclusion") + F.col("exclusion") > 0, F.col("cell"))).alias("k"))
    return targets.select("gene").distinct().join(sums, "gene", "left").select("gene", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("i", "inclusion"), ("e", "exclusion"), ("k", "cells"))], F.try_divide(F.col("i"), F.col("i") + F.col("e")).alias("psi"))


def psi_table(x: DataFrame) -> DataFrame:
    """PSI-04: inclusion and exclusion of each gene in two conditions: odds ratio and difference of inclusion."""
    total = lambda c, k: F.sum(F.when(F.col("condition") == k, F.col(c)).otherwise(0))
    t = x.groupBy("gene").agg(total("inclusion", 0).alias("a"), total("exclusion", 0).alias("b"), total("inclusion", 1).alias("c"), total("exclusion", 1).alias("d"))
    return t.withColumn("odds_ratio", F.try_divide(F.col("a") * F.col("d"), F.col("b") * F.col("c"))).withColumn("delta", F.try_divide("a", F.col("a") + F.col("b")) - F.try_divide("c", F.col("c") + F.col("d")))


def psi_test(x: DataFrame) -> DataFrame:
    """PSI-04: psi_table with the exact two-sided p."""
    from cytolake.functions import stats

    return psi_table(x).withColumn("p", stats.tail(stats.fisher_two_sided, *[F.col(c) for c in "abcd"]))


def psi_cells(x: DataFrame) -> DataFrame:
    """PSI-05: isoform counts per cell in long form."""
    return x.groupBy("gene", "cell").agg(F.sum("inclusion").alias("inclusion"), F.sum("exclusion").alias("exclusion")).select("gene", "cell", F.inline(F.array(F.struct(F.lit("inclusion").alias("isoform"), F.col("inclusion").alias("n")), F.struct(F.lit("exclusion").alias("isoform"), F.col("exclusion").alias("n")))))


def psi_wide(x: DataFrame, genes: Sequence[str]) -> DataFrame:
    """PSI-06: inclusion counts of cells by target, 0 filled."""
    return x.groupBy("cell").agg(*[F.coalesce(F.sum(F.when(F.col("gene") == g, F.col("inclusion"))), F.lit(0)).alias(g) for g in genes])


def colocate(a: DataFrame, b: DataFrame, radius: int, least: int = 3) -> DataFrame:
    """SP-01: spots of two channels that are each other's nearest within a radius, in fields with at least `least` spots of both; distance ties go to the smaller (y, x).

    Spots meet on cells of a grid as wide as the radius, so only neighbouring ones are compared.
    """
    enough = a.groupBy("fov").count().where(F.col("count") >= least).select("fov").intersect(b.groupBy("fov").count().where(F.col("count") >= least).select("fov"))
    cell = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / radius) - 1, F.floor(F.col(c) / radius) + 1))
    left = a.join(enough, "fov", "left_semi").select("fov", F.col("y").alias("y1"), F.col("x").alias("x1")).distinct()
    left = left.withColumn("gy", cell("y1")).withColumn("gx", cell("x1"))
    right = b.join(enough, "fov", "left_semi").select("fov", F.col("y").alias("y2"), F.col("x").alias("x2")).distinct().withColumn("gy", around("y2")).withColumn("gx", around("x2"))
    d2 = (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")) + (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2"))
    near = left.join(right, ["fov", "gy", "gx"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
    # All pairs of a left spot meet in its own cell, so its nearest one needs no further shuffle; both sides are reduced before any.
    best1 = near.groupBy("fov", "gy", "gx", "y1", "x1").agg(F.min(F.struct("d2", "y2", "x2")).alias("b")).select("fov", "y1", "x1", "b.*")
    best2 = near.groupBy("fov", "y2", "x2").agg(F.min(F.struct("d2", "y1", "x1")).alias("b")).select("fov", "y2", "x2", "b.y1", "b.x1")
    return best1.join(best2, ["fov", "y1", "x1", "y2", "x2"]).select("fov", "y1", "x1", "y2", "x2", "d2")


def spot_class(nef: DataFrame, env: DataFrame, pol: DataFrame) -> DataFrame:
    """SP-02: class of each nef spot (fov, y, x): US with env and pol beside it, SS with env alone, MS with neither; pol alone is null."""
    keys = ["fov", "y", "x"]
    mark = lambda d, name: d.select(*keys).distinct().withColumn(name, F.lit(True))
    e, p = F.coalesce("env", F.lit(False)), F.coalesce("pol", F.lit(False))
    return nef.select(*keys).distinct().join(mark(env, "env"), keys, "left").join(mark(pol, "pol"), keys, "left").select(*keys, F.when(e & p, "US").when(e, "SS").when(~p, "MS").alias("class"))


def spots_per_cell(spots: DataFrame, labels: DataFrame, channels: Sequence[str]) -> DataFrame:
    """SP-03: spots per segmented cell by channel with its area; cells without spots have zeros."""
    area = labels.groupBy("fov", "cell_id").agg(F.count("*").alias("area"))
    counts = spots.join(labels, ["fov", "y", "x"]).groupBy("fov", "cell_id").agg(*[F.count_if(F.col("channel") == c).alias(c) for c in channels], F.count("*").alias("total"))
    return area.join(counts, ["fov", "cell_id"], "left").na.fill(0)


def field_totals(spots: DataFrame, least: int = 3) -> DataFrame:
    """SP-04: spots and channels of each field, skipped where a channel has too few."""
    per = spots.groupBy("fov", "channel").agg(F.count("*").alias("n"))
    return per.groupBy("fov").agg(F.sum("n").alias("spots"), F.count("*").alias("channels"), (F.min("n") < least).alias("skipped"))
