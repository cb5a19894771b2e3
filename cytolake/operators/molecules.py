"""Molecules: (sample, cell, umi, category, read_count) facts resolved into cell by category tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Pairs of categories that one molecule may carry; the second is kept.
RESOLVED_PAIRS = (
    ("any-D1", "US"), ("any-D4", "US"), ("SS-MS4", "US"), ("any-D4", "US-SS"), ("any-A7", "US-SS"), ("MS", "US-SS"), ("SS-MS4", "SS"),
    ("SS-MS7", "SS"), ("any-D4", "SS-MS4"), ("any-A7", "SS-MS7"), ("US-SS", "SS"), ("SS-MS7", "MS"), ("any-A7", "MS"),
)
#: Columns of the cell by category matrix for each mode.
MODES = {"SALVE": ("US", "US-SS", "SS-MS", "SS", "MS", "any"), "GEX": ("US", "US-SS", "any"), "KLRB1": ("KLRB1",)}
#: Categories that a correction may overrule.
CORRECTABLE = ("US-SS", "any-A7", "SS", "MS")


def category_of_file(path: Column) -> Column:
    """CAT-01: category from a file name `<sample>_<targets>_bamsort_alignment_<region>.csv`; null where nothing fits."""
    name = F.element_at(F.split(path, "/"), -1)
    region = F.regexp_replace(F.split_part(name, F.lit("_bamsort_alignment_"), F.lit(2)), r"\.csv$", "")
    parts = F.split(F.split_part(name, F.lit("_bamsort_alignment_"), F.lit(1)), "_")
    targets = F.filter(F.slice(parts, 2, F.size(parts)), lambda t: ~t.isin("PL", "CI"))
    has = lambda t: F.array_contains(targets, t)
    # The category of each region and target.
    return (
        F.when(region.endswith("KLRB1"), "KLRB1")
        .when((F.size(targets) == 1) & has("pol"), "US")
        .when(region.endswith("LTR_D1"), "any-D1")
        .when(region.endswith("D1_A1"), "US")
        .when(region == "A1_D4", F.when(has("D1"), "SS-MS4").otherwise("any-D4"))
        .when(region == "D4_A7", F.when(has("D1"), "SS").otherwise("US-SS"))
        .when(region == "A7_LTR", F.when(has("D1"), "SS-MS7").when(has("SSenv"), "US-SS").when(has("tat") | has("D4"), "MS").otherwise("any-A7"))
    )


def category_of_host_file(path: Column) -> Column:
    """CAT-02: the target gene of a file whose target also names the region (a version suffix `.n` is ignored); else null."""
    name = F.element_at(F.split(path, "/"), -1)
    bare = lambda c: F.regexp_replace(c, r"\.\d+$", "")
    region = bare(F.regexp_replace(F.split_part(name, F.lit("_bamsort_alignment_"), F.lit(2)), r"\.csv$", ""))
    target = bare(F.element_at(F.split(F.split_part(name, F.lit("_bamsort_alignment_"), F.lit(1)), "_"), -1))
    return F.when(target == region, target)


def pool_counts(molecules: DataFrame, distinct_rows: bool = True) -> DataFrame:
    """CAT-03: sums reads by molecule and category over pooled files, rows with nulls dropped; equal rows count once unless distinct_rows is off."""
    rows = molecules.select("cell", "umi", "category", "read_count").dropna()
    rows = rows.distinct() if distinct_rows else rows
    return rows.groupBy("cell", "umi", "category").agg(F.sum("read_count").alias("read_count"))


def wide_counts(pooled: DataFrame, categories: Sequence[str]) -> DataFrame:
    """CAT-04: distinct molecules and reads of each category per cell, 0 where none."""
    sums = [x for c in categories for x in (F.count_distinct(F.when(F.col("category") == c, F.col("umi"))).alias(f"{c}_umis"), F.coalesce(F.sum(F.when(F.col("category") == c, F.col("read_count"))), F.lit(0)).alias(f"{c}_reads"))]
    return pooled.groupBy("cell").agg(*sums)


def valid_cells(df: DataFrame, cells: DataFrame) -> DataFrame:
    """CAT-05: rows of listed cells."""
    return df.join(cells.select("cell"), "cell", "left_semi")


def apply_corrections(pooled: DataFrame, corrections: DataFrame, target: str = "MS") -> DataFrame:
    """CAT-06: molecules of the list get the target category if theirs may be overruled, and go otherwise."""
    listed = corrections.select("cell", "umi").distinct().withColumn("listed", F.lit(True))
    joined = pooled.join(listed, ["cell", "umi"], "left")
    free, fixable = F.col("listed").isNull(), F.col("category").isin(*CORRECTABLE)
    return joined.where(free | fixable).withColumn("category", F.when(free, F.col("category")).otherwise(target)).drop("listed")


def resolve_multimap(pooled: DataFrame) -> DataFrame:
    """CAT-07: one category per molecule: a single one is kept, an allowed pair gives its second, all else is dropped; reads are summed."""
    grouped = pooled.groupBy("cell", "umi").agg(F.array_sort(F.collect_set("category")).alias("found"), F.sum("read_count").alias("read_count"))
    kept = F.when(F.size("found") == 1, F.col("found")[0])
    for pair in RESOLVED_PAIRS:
        kept = kept.when(F.col("found") == F.array(*[F.lit(c) for c in sorted(pair)]), F.lit(pair[1]))
    return grouped.select("cell", "umi", kept.alias("category"), "read_count").where("category IS NOT NULL")


def collapse_categories(df: DataFrame) -> DataFrame:
    """CAT-08: any* becomes any, SS-MS* becomes SS-MS."""
    c = F.col("category")
    return df.withColumn("category", F.when(c.startswith("any"), "any").when(c.startswith("SS-MS"), "SS-MS").otherwise(c))


def process_samples(molecules: DataFrame, cells: DataFrame, corrections: DataFrame) -> DataFrame:
    """CAT-09: pool, restrict, correct, resolve and collapse, all samples in one job (the cell key carries the sample)."""
    keyed = molecules.withColumn("cell", F.concat_ws("|", "sample", "cell"))
    samples = molecules.select("sample").distinct()
    listed = F.broadcast(samples).crossJoin(cells.select("cell")).select(F.concat_ws("|", "sample", "cell").alias("cell"))
    fixes = F.broadcast(samples).crossJoin(corrections.select("cell", "umi")).select(F.concat_ws("|", "sample", "cell").alias("cell"), "umi")
    out = collapse_categories(resolve_multimap(apply_corrections(valid_cells(pool_counts(keyed), listed), fixes)))
    return out.select(F.split_part("cell", F.lit("|"), F.lit(1)).alias("sample"), F.split_part("cell", F.lit("|"), F.lit(2)).alias("cell"), "umi", "category", "read_count")


def cell_matrix(df: DataFrame, mode: str = "SALVE", min_reads: int = 1, min_region_count: int = 1, min_umi: int = 1, min_cells: int = 0, min_reads_cell: int = 1) -> DataFrame:
    """CAT-10: cell by category counts after the minimum filters, in the order of the parameters' use; columns fixed by mode.

    A category seen in fewer than min_cells cells becomes 0 in all. That needs totals over the cells, one
    row of counts, which is joined back by broadcast.
    """
    categories = MODES[mode]
    rows = df.where(F.col("read_count") >= min_reads)
    counts = [F.count_if(F.col("category") == c).alias(c) for c in categories]
    wide = rows.groupBy("cell").agg(F.sum("read_count").alias("reads"), *counts).where(F.col("reads") >= min_reads_cell).drop("reads")
    if min_cells > 0:
        seen = wide.agg(*[F.count_if(F.col(f"`{c}`") > 0).alias(f"{c}_cells") for c in categories])
        wide = wide.crossJoin(F.broadcast(seen)).select("cell", *[F.when(F.col(f"`{c}_cells`") >= min_cells, F.col(f"`{c}`")).otherwise(0).alias(c) for c in categories])
    total = sum((F.col(f"`{c}`") for c in categories), F.lit(0).cast("bigint"))
    regions = sum(((F.col(f"`{c}`") > 0).cast("int") for c in categories), F.lit(0))
    return wide.withColumn("total", total).where((regions >= min_region_count) & (F.col("total") >= min_umi))


def valid_umis(df: DataFrame, matrix: DataFrame) -> DataFrame:
    """CAT-11: molecules of the cells that the matrix kept."""
    return df.join(matrix.select("cell"), "cell", "left_semi").select("cell", "umi")


def resolve_assays(a: DataFrame, b: DataFrame) -> DataFrame:
    """CAT-12: one category per molecule over two assays: the one found, the equal one, the one of US, SS, MS if the other is none of them, else any."""
    x, y = F.col("category_a"), F.col("category_b")
    joined = a.select("cell", "umi", F.col("category").alias("category_a")).join(b.select("cell", "umi", F.col("category").alias("category_b")), ["cell", "umi"], "full")
    exact = lambda c: c.isin("US", "SS", "MS")
    merged = F.when(x.isNull(), y).when(y.isNull(), x).when(x == y, x).when(exact(x) & ~exact(y), x).when(exact(y) & ~exact(x), y).otherwise("any")
    return joined.select("cell", "umi", merged.alias("category"))


def assay_matrix(merged: DataFrame, categories: Sequence[str]) -> DataFrame:
    """CAT-13: molecules per cell and category, and log1p of their sum."""
    wide = merged.groupBy("cell").agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])
    return wide.withColumn("total", F.log1p(sum((F.col(f"`{c}`") for c in categories), F.lit(0)).cast("double")))


def joint_table(cells: DataFrame, clones: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """CAT-14: base cells with clone (none where missing) and the totals of two assays on a log1p scale, 0 where missing."""
    out = cells.join(clones, "cell", "left").join(first, "cell", "left").join(second, "cell", "left")
    return out.select(*[c for c in cells.columns], F.coalesce("barcode", F.lit("none")).alias("barcode"), *[F.log1p(F.coalesce(c, F.lit(0)).cast("double")).alias(c) for d in (first, second) for c in d.columns if c != "cell"])


def marker_gate(wide: DataFrame, first: Sequence[str], second: Sequence[str]) -> DataFrame:
    """CAT-15: cells with a flag for any marker of each lineage, without those positive for both."""
    any_of = lambda names: F.greatest(*[F.coalesce(F.col(n), F.lit(0)) for n in names], F.lit(0)) > 0
    return wide.withColumn("first", any_of(first)).withColumn("second", any_of(second)).where(~(F.col("first") & F.col("second")))


def identity_class(df: DataFrame, a: str, b: str) -> DataFrame:
    """CAT-16: both, a, b or neither by which of two measures is above 0."""
    x, y = F.coalesce(F.col(a), F.lit(0)) > 0, F.coalesce(F.col(b), F.lit(0)) > 0
    return df.withColumn("identity", F.when(x & y, "both").when(x, "a").when(y, "b").otherwise("neither"))


def recovery(a: DataFrame, b: DataFrame) -> DataFrame:
    """CAT-17: molecules and cells of two assays: shared counts and shares both ways."""

    def both(keys: list[str], kind: str) -> DataFrame:
        x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
        sums = x.join(y, keys, "full").agg(F.count("in_a").alias("a"), F.count("in_b").alias("b"), F.count_if(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("shared"))
        return sums.select(F.lit(kind).alias("level"), "a", "b", "shared", F.try_divide("shared", "a").alias("share_of_a"), F.try_divide("shared", "b").alias("share_of_b"))

    return both(["cell", "umi"], "molecule").unionByName(both(["cell"], "cell"))


def category_transitions(a: DataFrame, b: DataFrame, mapping: DataFrame) -> DataFrame:
    """CAT-18: category pairs of molecules in two versions, counted, expected if the mapping (from, to) lists them."""
    pairs = a.select("cell", "umi", F.col("category").alias("from")).join(b.select("cell", "umi", F.col("category").alias("to")), ["cell", "umi"]).groupBy("from", "to").count()
    known = mapping.select("from", "to").distinct().withColumn("known", F.lit(True))
    return pairs.join(F.broadcast(known), ["from", "to"], "left").select("from", "to", F.col("count").alias("n"), F.coalesce("known", F.lit(False)).alias("expected"))


def proportions(wide: DataFrame, classes: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """CAT-19: share of each class in its row in long form; 0 where the row is empty."""
    total = sum((F.col(c) for c in classes), F.lit(0))
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.coalesce(F.try_divide(F.col(c), total), F.lit(0.0)).alias("share")) for c in classes])
    return wide.select(*keys, F.inline(parts))


def composition(wide: DataFrame, targets: Sequence[str], group: str) -> DataFrame:
    """CAT-20: mean signal of each target by group."""
    parts = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("value")) for t in targets])
    return wide.select(group, F.inline(parts)).groupBy(group, "target").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))


def barcode_rank(counts: DataFrame, cells: DataFrame, top: int = 20_000, least: int = 100) -> DataFrame:
    """CAT-21: cells by falling count (ties by cell): rank, membership in a list and the least-count flag, for the `top` first."""
    first = counts.groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(top)
    ranked = first.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "cell")))  # `top` rows at most
    listed = cells.select("cell").distinct().withColumn("listed", F.lit(True))
    return ranked.join(listed, "cell", "left").select("cell", "n", F.col("rank").cast("bigint").alias("rank"), F.coalesce("listed", F.lit(False)).alias("listed"), (F.col("n") >= least).alias("enough"))


def cells_over(counts: DataFrame, n: int = 100) -> DataFrame:
    """CAT-22: cells whose total is above n."""
    return counts.groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > n)


def cells_per_gene(counts: DataFrame, barcodes: DataFrame) -> DataFrame:
    """CAT-23: cells of each gene with a count above 0 that a barcode list holds, with or without the `-1` suffix."""
    bare = lambda c: F.regexp_replace(c, r"-\d+$", "")
    return counts.where("n > 0").withColumn("key", bare(F.col("cell"))).join(barcodes.select(bare(F.col("cell")).alias("key")).distinct(), "key", "left_semi").select("gene", "cell").distinct()


def class_composition(wide: DataFrame, classes: Sequence[str], group: str = "dataset") -> DataFrame:
    """CAT-24: class counts pooled by dataset and their percent of its total."""
    parts = F.array(*[F.struct(F.lit(c).alias("class"), F.col(c).alias("n")) for c in classes])
    sums = wide.select(group, F.inline(parts)).groupBy(group, "class").agg(F.sum("n").alias("n"))
    return sums.withColumn("percent", F.coalesce(F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(W.partitionBy(group))), F.lit(0.0)))


def cell_proportions(wide: DataFrame, of: str, classes: Sequence[str], group: str = "dataset") -> DataFrame:
    """CAT-25: mean, median and standard deviation by dataset of one class's share over cells with any count."""
    total = sum((F.col(c) for c in classes), F.lit(0))
    shares = wide.where(total > 0).select(group, (F.col(of) / total).alias("share"))
    return shares.groupBy(group).agg(F.count("*").alias("cells"), F.avg("share").alias("mean"), F.percentile("share", 0.5).alias("median"), F.stddev_samp("share").alias("sd"))


def dominant_class(wide: DataFrame, classes: Sequence[str], group: str = "dataset") -> DataFrame:
    """CAT-26: cells by their class with more than half of the counts, else mixed, by dataset."""
    total = sum((F.col(c) for c in classes), F.lit(0))
    kind = None
    for c in classes:
        kind = (F.when if kind is None else kind.when)(2 * F.col(c) > total, c)
    return wide.where(total > 0).withColumn("class", kind.otherwise("mixed")).groupBy(group, "class").agg(F.count("*").alias("cells"))


def molecules_minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """CAT-27: molecules of a that b lacks."""
    return a.join(b.select("cell", "umi"), ["cell", "umi"], "left_anti")


def target_sets(molecules: DataFrame, joined: Sequence[str], without: str, targets: Sequence[str]) -> DataFrame:
    """CAT-28: distinct molecules per cell of each target, of the union of `joined`, and of that union without the molecules of `without`."""
    per = molecules.groupBy("cell", "umi").agg(*[F.max((F.col("category") == t).cast("int")).alias(t) for t in dict.fromkeys([*targets, *joined, without])])
    union = F.greatest(*[F.col(f"`{t}`") for t in joined]) == 1
    return per.groupBy("cell").agg(*[F.sum(F.col(f"`{t}`")).alias(t) for t in targets], F.count_if(union).alias("union_umis"), F.count_if(union & (F.col(f"`{without}`") == 0)).alias("union_minus"))


def sum_over_samples(wide: DataFrame, classes: Sequence[str]) -> DataFrame:
    """CAT-29: class sums of a cell over samples, their total and its log1p."""
    sums = wide.groupBy("cell").agg(*[F.sum(c).alias(c) for c in classes])
    total = sum((F.col(c) for c in classes), F.lit(0))
    return sums.withColumn("total", total).withColumn("log_total", F.log1p(F.col("total").cast("double")))


def index_hopping(stats: DataFrame) -> DataFrame:
    """CAT-30: off-target counts (sample, target, n, pool, own target) of samples pooled with the target's owner, against the background of unpooled ones.

    percent is of the owner's count; flagged above the background's mean plus two standard deviations.
    """
    owner = stats.where("target = own").groupBy("target").agg(F.sum("n").alias("on_target"), F.min("pool").alias("owner_pool"))
    off = stats.where("target <> own").join(owner, "target")
    pooled = F.col("pool") == F.col("owner_pool")
    ground = off.where(~pooled).groupBy("target").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"))
    out = off.where(pooled).join(ground, "target", "left")
    return out.select(
        "sample", "target", "n", F.try_divide(100.0 * F.col("n"), F.col("on_target")).alias("percent"), F.try_divide(F.col("n"), F.col("mean")).alias("fold"),
        F.try_divide(F.col("n") - F.col("mean"), F.col("sd")).alias("z"), (F.col("n") > F.col("mean") + 2 * F.col("sd")).alias("flagged"),
    )


def signal_background(stats: DataFrame) -> DataFrame:
    """CAT-31: on-target count of each sample minus the largest off-target count of its region."""
    off = stats.where("target <> own").groupBy("target").agg(F.max("n").alias("background"))
    return stats.where("target = own").join(off, "target", "left").select("sample", "target", "n", F.coalesce("background", F.lit(0)).alias("background"), (F.col("n") - F.coalesce("background", F.lit(0))).alias("signal"))


def signal_ratio(wide: DataFrame, a: str, b: str, group: str, threshold: float) -> DataFrame:
    """CAT-32: 100 * sum(a) / sum(b) and percent of cells with a above a threshold, by group."""
    return wide.groupBy(group).agg(F.try_divide(100.0 * F.sum(a), F.sum(b)).alias("ratio"), (100.0 * F.count_if(F.col(a) > threshold) / F.count("*")).alias("percent_over"))


def normalised_overlap(wide: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """CAT-33: mean of a / b per cell (0 where it isn't finite) and how many cells show both, one or neither, by group."""
    ratio = F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    x, y = F.col(a) > 0, F.col(b) > 0
    return wide.groupBy(group).agg(F.avg(ratio).alias("ratio"), F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def ambiguity_screen(df: DataFrame, cell: str = "cell", umi: str = "umi") -> DataFrame:
    """CAT-34: cells with clean cell and molecule sequences: rows, molecules seen more than once, and whether the screen loses the cell."""
    clean = ~F.col(cell).contains("N") & ~F.col(umi).contains("N")
    per = df.groupBy(cell, umi).agg(F.count_if(clean).alias("clean"), F.count("*").alias("rows"))
    return per.groupBy(cell).agg(F.sum("rows").alias("rows"), F.count_if(F.col("clean") > 1).alias("repeated"), (F.sum("clean") == 0).alias("lost"))
