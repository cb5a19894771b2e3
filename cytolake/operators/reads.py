"""Reads: filters, shapes and counts of aligned reads.

Columns: name, flag, ref, pos (0-based), mapq, cigar, seq, cb, ub, ur, xf, gx, nh, as_score and
file_offset, the ingest order that first-wins rules follow. Nulls stand for absent tags.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.functions import cigar as c, stats
from cytolake.functions.graph import components

#: Regions of the isoform classes from blocks, and of those from spans.
BLOCK_REGIONS = {"us": (431, 4658), "ms_gap": (6043, 8252), "ss_gap": (431, 4658), "ss_after": (6043, 8252)}
SPAN_REGIONS = {"us": (985, 5212), "ms_gap": (6597, 8806), "ss_gap": (985, 5212), "ss_after": (6597, 8806)}
#: Splice sites by position.
DONORS = {"D1": 431, "D2": 4730, "D3": 5217, "D4": 6043}
ACCEPTORS = {"A1": 4658, "A2": 5141, "A3": 5746, "A4": 5818, "A5": 5959, "A7": 8249}
#: Bits of the quality flag.
XF_BITS = {"mapped": 1, "low_support": 2, "multi_gene": 4, "counted": 8, "feature": 16, "target": 32}
UNMAPPED_SECONDARY_SUPPLEMENTARY = 0x904
FAR = 2_000_000_000
#: Width of the bins in which near fragments meet.
BIN = 1000


def where_xf(reads: DataFrame, flags: Sequence[int] = (25,)) -> DataFrame:
    """RD-01: reads with one of the quality flags; null is rejected."""
    return reads.where(F.col("xf").isin(*flags))


def where_primary(reads: DataFrame) -> DataFrame:
    """RD-02: mapped reads that are neither secondary nor supplementary."""
    return reads.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED_SECONDARY_SUPPLEMENTARY)) == 0)


def with_blocks(reads: DataFrame) -> DataFrame:
    """RD-03: reads with their aligned blocks and gaps."""
    return reads.withColumn("blocks", c.aligned_blocks(F.col("cigar"), F.col("pos"))).withColumn("gaps", c.gap_blocks(F.col("cigar"), F.col("pos")))


def read_span(reads: DataFrame) -> DataFrame:
    """RD-04: start, end, strand and aligned length of each read; null where nothing is aligned."""
    size = F.aggregate("blocks", F.lit(0), lambda a, b: a + b["end"] - b["start"])
    out = with_blocks(reads).where(F.size("blocks") > 0)
    return out.select("name", "file_offset", F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"), F.when(F.col("flag").bitwiseAND(F.lit(16)) == 0, "+").otherwise("-").alias("strand"), size.alias("aligned"))


def last_block_overlap(reads: DataFrame, chrom: str, start: int, end: int, min_overlap: int = 20) -> DataFrame:
    """RD-05: reads whose last aligned block meets the region by min_overlap bases."""
    # As a predicate over an array of one, so the CIGAR is walked once a read.
    last = F.array(c.last_block(F.col("cigar"), F.col("pos")))
    return reads.where((F.col("ref") == chrom) & F.exists(last, lambda b: c.overlap(b["start"], b["end"], F.lit(start), F.lit(end)) >= min_overlap))


def total_overlap(reads: DataFrame, chrom: str, start: int, end: int, min_overlap: int = 20) -> DataFrame:
    """RD-06: reads whose aligned blocks meet the region by min_overlap bases together."""
    total = F.aggregate(c.aligned_blocks(F.col("cigar"), F.col("pos")), F.lit(0), lambda a, b: a + c.overlap(b["start"], b["end"], F.lit(start), F.lit(end)))
    return reads.where((F.col("ref") == chrom) & (total >= min_overlap))


def start_overlap(reads: DataFrame, chrom: str, start: int, end: int, reach: int = 20) -> DataFrame:
    """RD-07: reads that begin before the region's end and within `reach` bases of its start or after it."""
    return reads.where((F.col("ref") == chrom) & (F.col("pos") < end) & (F.col("pos") + reach > start))


def has_intron(reads: DataFrame, min_intron: int = 50) -> DataFrame:
    """RD-08: reads flagged by a gap of min_intron bases or more."""
    return with_blocks(reads).withColumn("has_intron", F.exists("gaps", lambda g: g["end"] - g["start"] >= min_intron))


#: Shortest bins of regions, as a power of two.
LEAST_LEVEL = 7


def region_bins(regions: DataFrame) -> DataFrame:
    """regions by the bins that they meet (chrom, level, bin): a region of up to 2^level bases lies in bins of that width, two at most."""
    size = F.greatest(F.col("end_pos") - F.col("start_pos"), F.lit(1))
    level = F.greatest(F.ceil(F.log2(size)).cast("int"), F.lit(LEAST_LEVEL))
    width = F.pow(F.lit(2.0), "level")
    return regions.withColumn("level", level).withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_pos") / width), F.floor(F.col("end_pos") / width))))


def join_regions(blocks: DataFrame, regions: DataFrame, min_overlap: int = 1, max_broadcast: int = 100_000) -> DataFrame:
    """Blocks (ref, s, e) with each region (target, chrom, start_pos, end_pos) that they meet by min_overlap bases.

    Up to max_broadcast regions are broadcast, the longest first, level by level. Shorter ones beyond these meet the blocks
    in bins of their own level's width, so a long region makes no wide bins for short ones, and blocks look up
    the levels that there are.
    """
    meets = (F.col("ref") == F.col("chrom")) & (c.overlap(F.col("s"), F.col("e"), F.col("start_pos"), F.col("end_pos")) >= min_overlap)
    if regions.limit(max_broadcast + 1).count() <= max_broadcast:
        return blocks.join(F.broadcast(regions), meets)
    binned = region_bins(regions)
    counts = sorted(((r["level"], r["count"]) for r in binned.select("level", *regions.columns).distinct().groupBy("level").count().collect()), reverse=True)  # a row a power of two
    sent, levels = 0, []
    for level, n in counts:
        if levels or sent + n > max_broadcast:
            levels.append(level)
        else:
            sent += n
    level = F.explode(F.array(*[F.lit(x) for x in levels]))
    width = F.pow(F.lit(2.0), "level")
    left = blocks.withColumn("level", level).withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))))
    right = binned.where(F.col("level").isin(levels)).withColumnRenamed("chrom", "ref").withColumn("chrom", F.col("ref"))
    near = left.join(right, ["ref", "level", "bin"]).where(meets & (F.col("bin") == F.floor(F.greatest("s", "start_pos") / width))).drop("level", "bin")
    if not sent:
        return near
    long = binned.where(~F.col("level").isin(levels)).select(*regions.columns).distinct()  # max_broadcast rows at most
    return near.unionByName(blocks.join(F.broadcast(long), meets))


def region_counts(reads: DataFrame, regions: DataFrame, min_overlap: int = 20, max_broadcast: int = 100_000) -> DataFrame:
    """RD-09: reads per region, all regions in one pass, by the last aligned block."""
    blocks = reads.select("ref", c.last_block(F.col("cigar"), F.col("pos")).alias("b")).select("ref", F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    return join_regions(blocks, regions, min_overlap, max_broadcast).groupBy("target").agg(F.count("*").alias("reads"))


def umi_read_counts(reads: DataFrame, chrom: str, start: int, end: int, flags: Sequence[int] = (25,)) -> DataFrame:
    """RD-10: reads per molecule that pass the flag and the region test."""
    kept = last_block_overlap(where_xf(reads, flags).where("cb IS NOT NULL AND ub IS NOT NULL"), chrom, start, end)
    return kept.groupBy("cb", "ub").agg(F.count("*").alias("reads"))


def cell_read_counts(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """RD-11: reads per cell in the region, by read start."""
    return start_overlap(reads.where("cb IS NOT NULL"), chrom, start, end).groupBy("cb").agg(F.count("*").alias("reads"))


def split_inside_outside(reads: DataFrame, chrom: str, start: int, end: int, umi_tag: str = "ub") -> DataFrame:
    """RD-12: reads per molecule inside and outside one region."""
    inside = (F.col("ref") == chrom) & (F.size(F.filter("blocks", lambda b: c.overlap(b["start"], b["end"], F.lit(start), F.lit(end)) > 0)) > 0)
    kept = with_blocks(reads.where(F.col("cb").isNotNull() & F.col(umi_tag).isNotNull()))
    return kept.withColumn("side", F.when(inside, "inside").otherwise("outside")).groupBy("side", "cb", F.col(umi_tag).alias("umi")).agg(F.count("*").alias("reads"))


def flag_census(reads: DataFrame) -> DataFrame:
    """RD-13: reads by combination of quality bits."""
    bits = [(F.col("xf").bitwiseAND(F.lit(b)) > 0).alias(name) for name, b in XF_BITS.items()]
    return reads.where("xf IS NOT NULL").select(*bits).groupBy(*XF_BITS).agg(F.count("*").alias("reads"))


def filter_cells(reads: DataFrame, cells: DataFrame, match: str = "exact") -> DataFrame:
    """RD-14: reads of listed cells: equal barcodes with flag 25, or the first 16 bases alone."""
    if match == "exact":
        return where_xf(reads).join(cells.select("cb").distinct(), "cb", "left_semi")
    key = cells.select(F.substring("cb", 1, 16).alias("prefix")).distinct()
    return reads.withColumn("prefix", F.substring("cb", 1, 16)).join(key, "prefix", "left_semi").drop("prefix")


def distinct_cells(reads: DataFrame, include_unmapped: bool = False) -> DataFrame:
    """RD-15: distinct cell barcodes, sorted."""
    kept = reads if include_unmapped else reads.where(F.col("flag").bitwiseAND(F.lit(4)) == 0)
    return kept.where("cb IS NOT NULL").select("cb").distinct().orderBy("cb")


def cell_region_counts(reads: DataFrame, requests: DataFrame, pad: int = 1000) -> DataFrame:
    """RD-16: for each request (cell, donor, acceptor) the cell's reads that begin near it and those that overlap it, zeros kept."""
    ends = with_blocks(reads.where(F.col("cb").isNotNull())).where(F.size("blocks") > 0)
    spans = ends.select(F.col("cb").alias("cell"), F.col("blocks")[0]["start"].alias("start"), F.element_at("blocks", -1)["end"].alias("end"))
    # Requests and reads of a cell meet in bins of places, and count in the first bin that both have.
    place = lambda c: F.floor(c / BIN)
    asked = requests.withColumn("request_bin", place(F.col("donor") - pad)).withColumn("bin", F.explode(F.sequence("request_bin", place(F.greatest("acceptor", "donor") + pad))))
    given = spans.withColumn("read_bin", place(F.col("start"))).withColumn("bin", F.explode(F.sequence("read_bin", place(F.greatest("end", "start")))))
    near = (F.col("start") >= F.col("donor") - pad) & (F.col("start") <= F.col("acceptor") + pad)
    over = (F.col("start") < F.col("acceptor")) & (F.col("end") > F.col("donor"))
    met = asked.join(given, ["cell", "bin"]).where(F.col("bin") == F.greatest("request_bin", "read_bin"))
    counts = met.groupBy("cell", "donor", "acceptor").agg(F.count_if(near).alias("near"), F.count_if(over).alias("over"))
    return requests.select("cell", "donor", "acceptor").distinct().join(counts, ["cell", "donor", "acceptor"], "left").na.fill(0, ["near", "over"])


def length_histogram(reads: DataFrame, bin: int = 50, kind: str = "aligned") -> DataFrame:
    """RD-17: reads by length bin: reference length (M, D, N) or query length."""
    if kind == "query":
        size = F.length("seq")
    else:
        size = F.aggregate(c.cigar_ops(F.col("cigar")), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N"), x["len"]).otherwise(0))
    return reads.select((F.floor(size / bin) * bin).cast("bigint").alias("bin")).groupBy("bin").agg(F.count("*").alias("reads"))


def trimmed_length_histogram(fastq: DataFrame, min_run: int = 8, window: int = 100, motif: str | None = None, bin: int = 1) -> DataFrame:
    """RD-18: reads by length after the last T run in the first `window` bases and before the first A run in the last ones; motif on either strand required if given."""
    seq = F.col("seq")
    head, tail = F.substring(seq, 1, window), F.right(seq, F.lit(window))
    cut_head = F.length(F.regexp_extract(head, f"^(.*T{{{min_run},}})", 1))
    cut_tail = F.length(F.regexp_extract(tail, f"(A{{{min_run},}}.*)$", 1))
    kept = fastq if motif is None else fastq.where(seq.contains(motif) | seq.contains(c.reverse_complement(F.lit(motif))))
    size = F.greatest(F.length(seq) - cut_head - cut_tail, F.lit(0))
    return kept.select((F.floor(size / bin) * bin).cast("bigint").alias("length")).groupBy("length").agg(F.count("*").alias("reads"))


def splice_junctions(reads: DataFrame, min_intron: int = 1000, min_match: int = 20, max_intron: int | None = None, reference: str | None = None) -> DataFrame:
    """RD-19..21: junctions: a gap of at least min_intron bases directly after a match of at least min_match.

    donor is the last base before the gap; acceptor the first after it, null unless a match follows.
    """
    kept = reads if reference is None else reads.where(F.col("ref") == reference)
    # Only reads whose CIGAR has a gap with enough digits are taken apart.
    kept = kept.where(F.col("cigar").rlike(f"[0-9]{{{len(str(min_intron))},}}N") & F.col("seq").isNotNull())
    # Op i is kinds[i] (an empty text stands first) with sizes[i - 1].
    sizes = F.split(F.rtrim(F.translate("cigar", "MIDNSHPX=", " " * 9)), " ").cast("array<int>")
    kept = kept.withColumn("kinds", F.split("cigar", "[0-9]+")).withColumn("sizes", sizes)
    kind, size = (lambda i: F.get("kinds", i)), (lambda i: F.get("sizes", i - 1))

    def step(seen: Column, n: Column) -> Column:
        """One op further: the bases so far on the reference and in the read, and each gap found with those before it."""
        i, op = seen["i"], kind(seen["i"])
        gap = (op == "N") & (n >= min_intron) & (F.lit(True) if max_intron is None else n <= max_intron) & (kind(i - 1) == "M") & (size(i - 1) >= min_match)
        out = F.when(F.coalesce(gap, F.lit(False)), F.array_append(seen["out"], F.struct(i.alias("i"), seen["at"].alias("at"), seen["q"].alias("q")))).otherwise(seen["out"])
        grown = lambda c, *ops: seen[c] + F.when(op.isin(*ops), n).otherwise(0)
        return F.struct((i + 1).alias("i"), grown("at", "M", "D", "N", "=", "X").alias("at"), grown("q", "M", "I", "S", "=", "X").alias("q"), out.alias("out"))

    zero = F.struct(F.lit(1).alias("i"), F.col("pos").cast("int").alias("at"), F.lit(0).alias("q"), F.array().cast("array<struct<i:int,at:int,q:int>>").alias("out"))
    found = kept.select("cb", "ub", "cigar", "ref", "seq", "kinds", "sizes", F.inline(F.aggregate("sizes", zero, step)["out"]))
    i, at = F.col("i"), F.col("at")
    matched = F.coalesce(kind(i + 1) == "M", F.lit(False))
    return found.select(
        "cb", "ub", "cigar", "ref", (at - 1).alias("donor"), F.when(matched, at + size(i)).alias("acceptor"), F.when(matched, F.substring("seq", F.col("q") + 1, size(i + 1))).otherwise("").alias("seq_after"),
        (at - size(i - 1)).alias("match_start"), at.alias("match_end"),
    )


def consolidate_junctions(junctions: DataFrame) -> DataFrame:
    """RD-22: equal junctions of a cell in one row: sorted molecules, up to three CIGARs (the smallest), reads."""
    grouped = junctions.groupBy("cb", "ref", "donor", "acceptor", "match_start", "match_end")
    return grouped.agg(F.array_join(F.sort_array(F.collect_set("ub")), ";").alias("umis"), F.array_join(F.slice(F.sort_array(F.collect_set("cigar")), 1, 3), ";").alias("cigars"), F.count("*").alias("reads"))


def classify_site(position: Column, sites: dict[str, int], near: int = 3, maybe: int = 12) -> Column:
    """RD-23: label of the nearest site within `near` bases, mnc within `maybe`, else nc; ties go to the site listed first."""
    # Comparisons of numbers alone, which generated code makes a read at a time; no array of sites is built.
    off = {label: F.abs(position - at) for label, at in sites.items()}
    least = F.least(*off.values()) if len(off) > 1 else next(iter(off.values()), F.lit(None))
    named = F.when(position.isNull(), "nc")
    for label, d in off.items():
        named = named.when((d <= near) & (d == least), label)
    return named.when(least <= maybe, "mnc").otherwise("nc")


def site_table(junctions: DataFrame, filter_donor: str | None = "D4", target: str = "target") -> DataFrame:
    """RD-24: sites of each molecule's junctions, one row for each (cell, donor, acceptor, molecule), one donor kept."""
    named = junctions.select("cb", "ub", classify_site(F.col("donor"), DONORS).alias("donor_site"), classify_site(F.col("acceptor"), ACCEPTORS).alias("acceptor_site"), F.lit(target).alias("target"))
    rows = named.dropDuplicates(["cb", "donor_site", "acceptor_site", "ub"])
    return rows if filter_donor is None else rows.where(F.col("donor_site") == filter_donor)


def junction_summary(junctions: DataFrame, top: int = 10) -> DataFrame:
    """RD-25: junction totals over files with their file lists, the `top` ranks with ties."""
    per_file = junctions.groupBy("ref", "donor", "acceptor").agg(F.count("*").alias("n"))
    sums = per_file.groupBy("donor", "acceptor").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("files"))
    cut = sums.orderBy(F.desc("n")).limit(top).agg(F.min("n").alias("least"))
    return sums.crossJoin(F.broadcast(cut)).where("n >= least").drop("least")


def events_per_cell(sites: DataFrame) -> DataFrame:
    """RD-26: splice events per cell and those that aren't canonical at either end."""
    odd = F.col("donor_site").isin("nc", "mnc") | F.col("acceptor_site").isin("nc", "mnc")
    return sites.groupBy("cb").agg(F.count("*").alias("events"), F.count_if(odd).alias("noncanonical"))


def noncanonical(junctions: DataFrame, cells: DataFrame, ends: str = "either") -> DataFrame:
    """RD-27: junctions of listed cells off the known sites at either end or both, with multiplicity."""
    d, a = classify_site(F.col("donor"), DONORS) == "nc", classify_site(F.col("acceptor"), ACCEPTORS) == "nc"
    kept = junctions.join(cells.select("cb").distinct(), "cb", "left_semi").where((d | a) if ends == "either" else (d & a))
    return kept.groupBy("cb", "donor", "acceptor").agg(F.count("*").alias("n"))


def _any_block(blocks: Column, start: int, end: int, least: int) -> Column:
    return F.exists(blocks, lambda b: c.overlap(b["start"], b["end"], F.lit(start), F.lit(end)) >= least)


def classify_isoform(blocks: Column, tolerance: int = 10, regions: dict[str, tuple[int, int]] = BLOCK_REGIONS, min_length: int = 50) -> Column:
    """RD-28: US, MS, SS or any by aligned blocks, in this order; regions grow by the tolerance where alignment is asked for and shrink where its absence is."""
    t, r = tolerance, regions
    free = lambda name: F.lit(True) if r[name][0] + t >= r[name][1] - t else ~_any_block(blocks, r[name][0] + t, r[name][1] - t, 1)
    ms = free("ms_gap") & _any_block(blocks, -t, r["ms_gap"][0] + t, 1) & _any_block(blocks, r["ms_gap"][1] - t, FAR, 1)
    ss = free("ss_gap") & ~free("ms_gap") & _any_block(blocks, -t, r["ss_gap"][0] + t, 1) & _any_block(blocks, r["ss_after"][0] - t, r["ss_after"][1] + t, 1)
    return F.when(F.coalesce(F.size(blocks), F.lit(0)) == 0, "any").when(_any_block(blocks, r["us"][0] - t, r["us"][1] + t, min_length), "US").when(ms, "MS").when(ss, "SS").otherwise("any")


def isoform_calls(reads: DataFrame, tolerance: int = 10, keep_missing_umi: bool = True) -> DataFrame:
    """RD-29: one class per (cell, molecule), of its first primary read in file order; a missing molecule is ""."""
    kept = where_primary(reads).where("cb IS NOT NULL")
    umi = F.coalesce("ub", "ur")
    kept = kept.withColumn("umi", F.coalesce(umi, F.lit(""))) if keep_missing_umi else kept.withColumn("umi", umi).where("umi IS NOT NULL")
    first = kept.groupBy("cb", "umi").agg(F.min_by(F.struct("cigar", "pos"), "file_offset").alias("r"))
    return first.select("cb", "umi", classify_isoform(c.aligned_blocks(F.col("r.cigar"), F.col("r.pos")), tolerance).alias("isoform"))


def classify_span(start: Column, end: Column, tolerance: int = 5, regions: dict[str, tuple[int, int]] = SPAN_REGIONS, min_length: int = 50) -> Column:
    """RD-30: class of a merged span; a gap is a region that the span doesn't cover whole."""
    t, r = tolerance, regions
    meets = lambda a, b, least: c.overlap(start, end, F.lit(a - t), F.lit(b + t)) >= least
    open_ = lambda name: ~((start <= r[name][0] + t) & (end >= r[name][1] - t))
    ms = meets(0, r["ms_gap"][0], 1) & open_("ms_gap") & meets(r["ms_gap"][1], FAR, 1)
    ss = meets(0, r["ss_gap"][0], 1) & open_("ss_gap") & meets(*r["ss_after"], 1)
    return F.when(start.isNull() | end.isNull(), "any").when(meets(*r["us"], min_length), "US").when(ms, "MS").when(ss, "SS").otherwise("any")


def best_fragment(spans: DataFrame) -> DataFrame:
    """RD-31: the longest aligned fragment of each molecule; ties go to the smallest (start, end, chrom, strand)."""
    ranked = F.min_by(F.struct("chrom", "start_pos", "end_pos", "strand", "aligned"), F.struct(-F.col("aligned"), F.col("start_pos"), F.col("end_pos"), F.col("chrom"), F.col("strand")))
    return spans.groupBy("cell", "umi").agg(ranked.alias("r")).select("cell", "umi", "r.*")


def fragment_pairs(best: DataFrame, same_strand: bool = True, near: int | None = None) -> DataFrame:
    """RD-32: pairs of a cell's fragments on one chromosome, with overlap, gap, combined span, gain and overlap share.

    All pairs of a cell, or with `near` those at most so many bases apart, found by bins of their places.
    """
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col("a.chrom") == F.col("b.chrom")) & (F.col("a.umi") < F.col("b.umi"))
    if near is not None:
        first, last = F.floor(F.col("start_pos") / BIN), F.floor((F.col("end_pos") + near) / BIN)
        best = best.withColumn("first_bin", first).withColumn("bin", F.explode(F.sequence(first, last)))
        # Only the first common bin of a pair counts.
        on = on & (F.col("a.bin") == F.col("b.bin")) & (F.col("a.bin") == F.greatest("a.first_bin", "b.first_bin"))
    a, b = best.alias("a"), best.alias("b")
    if same_strand:
        on = on & (F.col("a.strand") == F.col("b.strand"))
    s1, e1, s2, e2 = (F.col(x) for x in ("a.start_pos", "a.end_pos", "b.start_pos", "b.end_pos"))
    span = F.greatest(e1, e2) - F.least(s1, s2)
    shared = c.overlap(s1, e1, s2, e2)
    return a.join(b, on).select(
        F.col("a.cell").alias("cell"), F.col("a.umi").alias("umi_1"), F.col("b.umi").alias("umi_2"), s1.alias("start_1"), e1.alias("end_1"), s2.alias("start_2"), e2.alias("end_2"), shared.alias("overlap_bp"),
        F.greatest(F.lit(0), F.greatest(s1, s2) - F.least(e1, e2)).alias("gap_bp"), span.alias("combined_span"), (span - F.greatest(e1 - s1, e2 - s2)).alias("span_gain"), F.try_divide(shared, F.least(e1 - s1, e2 - s2)).alias("overlap_share"),
    )


def classify_pair(pairs: DataFrame, redundant: float = 0.5, max_overlap: int = 50, max_gap: int = 200, min_gain: int = 100) -> DataFrame:
    """RD-33: NESTED, REDUNDANT, COMPLEMENTARY or DISTANT, the first that holds."""
    inside = ((F.col("start_1") <= F.col("start_2")) & (F.col("end_1") >= F.col("end_2"))) | ((F.col("start_2") <= F.col("start_1")) & (F.col("end_2") >= F.col("end_1")))
    stitch = (F.col("overlap_bp") <= max_overlap) & (F.col("gap_bp") <= max_gap) & (F.col("span_gain") >= min_gain)
    return pairs.withColumn("relationship", F.when(inside, "NESTED").when(F.col("overlap_share") > redundant, "REDUNDANT").when(stitch, "COMPLEMENTARY").otherwise("DISTANT"))


def pair_summary(pairs: DataFrame) -> DataFrame:
    """RD-34: pairs per cell by relation."""
    return pairs.groupBy("cell").agg(*[F.count_if(F.col("relationship") == r).alias(r.lower()) for r in ("NESTED", "REDUNDANT", "COMPLEMENTARY", "DISTANT")])


def stitched_molecules(best: DataFrame, candidates: DataFrame) -> DataFrame:
    """RD-35: connected fragments of each cell: molecule_id is the smallest umi of its component."""
    id_of = lambda umi: F.struct("cell", F.col(umi).alias("umi"))
    linked = components(candidates.select(id_of("umi_1").alias("a"), id_of("umi_2").alias("b")))
    linked = linked.select("id.cell", "id.umi", F.col("component.umi").alias("molecule_id"))
    return best.join(linked, ["cell", "umi"], "left").withColumn("molecule_id", F.coalesce("molecule_id", "umi"))


def merged_molecules(stitched: DataFrame) -> DataFrame:
    """RD-35: one row a molecule: fragments, span and aligned bases."""
    return stitched.groupBy("cell", "molecule_id").agg(F.count("*").alias("fragments"), F.min("start_pos").alias("merged_start"), F.max("end_pos").alias("merged_end"), F.sum("aligned").alias("aligned"))


def molecule_chains(stitched: DataFrame) -> DataFrame:
    """RD-36: fragments of each molecule by start, with the gap (positive) or overlap (negative) to the next."""
    w = W.partitionBy("cell", "molecule_id").orderBy("start_pos", "end_pos", "umi")
    return stitched.select("cell", "molecule_id", "umi", F.row_number().over(w).cast("bigint").alias("position"), (F.lead("start_pos").over(w) - F.col("end_pos")).alias("to_next"))


def stitch_stats(merged: DataFrame) -> DataFrame:
    """RD-37: molecules and cells by isoform class and by whether they were stitched."""
    kinds = merged.withColumn("isoform", classify_span(F.col("merged_start"), F.col("merged_end"))).withColumn("stitched", F.col("fragments") > 1)
    return kinds.groupBy("isoform", "stitched").agg(F.count("*").alias("molecules"), F.count_distinct("cell").alias("cells"), F.max("fragments").alias("most_fragments"))


def umi_representatives(reads: DataFrame) -> DataFrame:
    """RD-38: the read of highest (mapq, alignment score) of each (cell, molecule, gene); ties go to the largest name."""
    kept = reads.where("cb IS NOT NULL AND ub IS NOT NULL AND gx IS NOT NULL")
    return kept.groupBy("cb", "ub", "gx").agg(F.max_by("name", F.struct("mapq", "as_score", "name")).alias("name"))


def add_xf(reads: DataFrame, min_mapq: int = 255) -> DataFrame:
    """RD-39: quality bits: 1 mapped, 16 on a feature, 4 several genes, 8 the molecule's representative."""
    best = umi_representatives(reads.where(F.col("mapq") >= min_mapq)).withColumnRenamed("name", "best")
    joined = reads.join(best, ["cb", "ub", "gx"], "left")
    bit = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), n).otherwise(0)
    xf = bit(F.col("flag").bitwiseAND(F.lit(4)) == 0, 1) + bit(F.col("gx").isNotNull(), 16) + bit(F.col("nh") > 1, 4) + bit(F.col("name") == F.col("best"), 8)
    return joined.select("file_offset", "name", xf.cast("bigint").alias("xf"))


def _gene_sets(reads: DataFrame) -> DataFrame:
    """The genes of each read name over its records that are neither secondary nor supplementary."""
    primary = reads.where((F.col("flag").bitwiseAND(F.lit(256 + 2048)) == 0) & F.col("gx").isNotNull())
    return primary.groupBy("name").agg(F.sort_array(F.collect_set("gx")).alias("genes"))


def multimap_gene_pairs(reads: DataFrame) -> DataFrame:
    """RD-40: gene pairs that the same read name maps to, counted by read names."""
    pairs = F.flatten(F.transform("genes", lambda a: F.transform(F.filter("genes", lambda b: b > a), lambda b: F.struct(a.alias("gene_1"), b.alias("gene_2")))))
    return _gene_sets(reads).where(F.size("genes") > 1).select(F.inline(pairs)).groupBy("gene_1", "gene_2").agg(F.count("*").alias("reads"))


def multimap_share(reads: DataFrame) -> DataFrame:
    """RD-40: records that are neither secondary nor supplementary, read names with several genes among them, and these in percent of the records."""
    total = reads.agg(F.count_if(F.col("flag").bitwiseAND(F.lit(256 + 2048)) == 0).alias("reads"))
    several = _gene_sets(reads).agg(F.count_if(F.size("genes") > 1).alias("multimapped"))
    return total.crossJoin(several).withColumn("percent", F.coalesce(F.try_divide(100.0 * F.col("multimapped"), F.col("reads")), F.lit(0.0)))  # one row each


def multimap_positions(reads: DataFrame) -> DataFrame:
    """RD-41: positions per gene of reads whose name maps to several genes."""
    primary = reads.where((F.col("flag").bitwiseAND(F.lit(256 + 2048)) == 0) & F.col("gx").isNotNull())
    names = primary.groupBy("name").agg((F.min("gx") < F.max("gx")).alias("several")).where("several").select("name")
    return primary.join(names, "name", "left_semi").groupBy("gx", "ref", "pos").agg(F.count("*").alias("reads"))


def equalise(a: DataFrame, b: DataFrame, key: str, seed: int) -> DataFrame:
    """RD-42: samples of equal, exact size (the smaller count) from two sets, without replacement, by seeded hash order."""
    n = min(a.count(), b.count())
    pick = lambda df, side: stats.numbered(df, "_at", F.xxhash64(key, F.lit(seed)), key).where(F.col("_at") < n).drop("_at").withColumn("side", F.lit(side))
    return pick(a, "a").unionByName(pick(b, "b"))


def discordant(lr: DataFrame, sr: DataFrame, lr_class: str | None = None, sr_class: str | None = None) -> DataFrame:
    """RD-43: molecules with different classes in long and short reads."""
    joined = lr.select("cell", "umi", F.col("isoform").alias("lr")).join(sr.select("cell", "umi", F.col("isoform").alias("sr")), ["cell", "umi"]).where("lr <> sr")
    joined = joined if lr_class is None else joined.where(F.col("lr") == lr_class)
    return joined if sr_class is None else joined.where(F.col("sr") == sr_class)


def collapse_calls(calls: DataFrame) -> DataFrame:
    """RD-44: best class of each molecule, US > MS > SS > any; the category's suffix after `-` is ignored."""
    kind = F.regexp_extract("category", "^(US|MS|SS|any)", 1)
    rank = F.when(kind == "US", 1).when(kind == "MS", 2).when(kind == "SS", 3).otherwise(4)
    return calls.groupBy("cell", "umi").agg(F.min(rank).alias("rank")).select("cell", "umi", F.element_at(F.array(*[F.lit(x) for x in ("US", "MS", "SS", "any")]), F.col("rank")).alias("isoform"))


def reads_for_keys(reads: DataFrame, keys: DataFrame) -> DataFrame:
    """RD-45: the first read, in file order, of each listed (cell, molecule)."""
    kept = reads.join(keys.select(F.col("cell").alias("cb"), F.col("umi").alias("ub")).distinct(), ["cb", "ub"], "left_semi")
    return kept.groupBy("cb", "ub").agg(F.min_by("name", "file_offset").alias("name"), F.min("file_offset").alias("file_offset"))


def call_agreement(lr: DataFrame, sr: DataFrame) -> DataFrame:
    """RD-46: share of shared molecules with equal calls: all, those called in long reads, those called in short reads."""
    joined = lr.select("cell", "umi", F.col("isoform").alias("lr")).join(sr.select("cell", "umi", F.col("isoform").alias("sr")), ["cell", "umi"])
    same = (F.col("lr") == F.col("sr")).cast("double")
    return joined.agg(F.count("*").alias("n"), F.avg(same).alias("all"), F.avg(F.when(F.col("lr") != "any", same)).alias("long_called"), F.avg(F.when(F.col("sr") != "any", same)).alias("short_called"))


def attach_barcodes(reads: DataFrame, barcodes: DataFrame) -> DataFrame:
    """RD-47: cell and molecule of each read by name; unmatched reads stay, untagged."""
    return reads.join(barcodes.select("name", F.col("cell").alias("cb"), F.col("umi").alias("ub")), "name", "left")


def extract_barcode_umi(fastq: DataFrame, cb: int = 16, umi: int = 12) -> DataFrame:
    """RD-48: cell and molecule sequences from the start of read 1; too short reads are dropped."""
    return fastq.where(F.length("seq") >= cb + umi).select("read_id", F.substring("seq", 1, cb).alias("cell"), F.substring("seq", cb + 1, umi).alias("umi"))


def pair_reads(reads: DataFrame) -> DataFrame:
    """RD-49: mapped paired reads by name: both mates' places and strands, same reference, distance between starts, proper pair.

    A mate's last record in the file counts (by file_offset; of records at one offset the largest ref, pos, mapq, length
    and flag); pairs of which it is secondary are left out.
    """
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    mates = reads.where(~bit(4) & bit(1)).withColumn("mate", F.when(bit(64), 1).when(bit(128), 2))
    record = F.struct("ref", "pos", "mapq", F.length("seq").alias("length"), bit(16).alias("reverse"), bit(2).alias("proper"), bit(256).alias("secondary"))
    last = lambda k: F.max_by(record, F.when(F.col("mate") == k, F.struct("file_offset", "ref", "pos", "mapq", F.length("seq"), "flag"))).alias(f"m{k}")
    pairs = mates.groupBy("name").agg(last(1), last(2), F.count_if(F.col("mate") == 1).alias("n1"), F.count_if(F.col("mate") == 2).alias("n2")).where("n1 > 0 AND n2 > 0 AND NOT m1.secondary AND NOT m2.secondary")
    sides = [F.col(f"m{k}.{c}").alias(f"{c}_{k}") for k in (1, 2) for c in ("ref", "pos", "mapq", "length", "reverse")]
    same = F.col("m1.ref") == F.col("m2.ref")
    return pairs.select("name", *sides, (F.col("m1.proper") & F.col("m2.proper")).alias("proper"), same.alias("same_ref"), F.when(same, F.abs(F.col("m1.pos") - F.col("m2.pos"))).alias("distance"))


def mate_summary(pairs: DataFrame) -> DataFrame:
    """RD-49: pairs, proper ones, those on one reference and on one strand, qualities, lengths and distances of both mates."""
    strand = F.col("reverse_1") == F.col("reverse_2")
    share = lambda c: F.avg(c.cast("double"))
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if("proper").alias("proper"), share(F.col("proper")).alias("proper_share"), F.count_if("same_ref").alias("same_ref"), share(F.col("same_ref")).alias("same_ref_share"),
        F.count_if(strand).alias("same_strand"), share(strand).alias("same_strand_share"), F.avg("mapq_1").alias("mapq_1"), F.avg("mapq_2").alias("mapq_2"), F.avg("length_1").alias("length_1"), F.avg("length_2").alias("length_2"),
        F.count_distinct("ref_1").alias("refs_1"), F.count_distinct("ref_2").alias("refs_2"), F.avg("distance").alias("mean_distance"), F.percentile("distance", 0.5).alias("median_distance"),
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"), F.count_if(F.col("distance") <= 1000).alias("within_1000"),
    )


def polya_structure(reads: DataFrame, min_length: int = 6, share: float = 2 / 3) -> DataFrame:
    """RD-50: read 1 as genomic sequence, A tail (the longest suffix with the share of A), molecule (12) and cell (16)."""
    @F.pandas_udf("length int, a int")
    def tail(seqs: pd.Series) -> pd.DataFrame:
        """The longest suffix before the last 28 bases with the share, from running counts of A over a batch at once; null for shorter sequences."""
        short = ~(seqs.str.len() >= 28)
        bodies = seqs.where(~short, "").str[:-28]
        width = max(int(bodies.str.len().max()), 1)
        # Reversed and filled up on the right, so a suffix becomes a prefix of each row.
        data = np.frombuffer("".join(bodies.str.upper().str[::-1].str.pad(width, "right", "-")).encode("ascii", "replace"), np.uint8).reshape(len(bodies), width)
        counts, sizes = np.cumsum(data == ord("A"), axis=1), np.arange(1, width + 1)
        ok = (counts >= share * sizes - 1e-9) & (sizes >= min_length) & (sizes <= bodies.str.len().to_numpy()[:, None])
        best = np.where(ok, sizes, 0).max(axis=1)
        a = np.where(best > 0, counts[np.arange(len(best)), np.maximum(best, 1) - 1], 0)
        return pd.DataFrame({"length": pd.Series(best).mask(short.to_numpy()).astype("Int32"), "a": a})

    tail = tail.asNondeterministic()  # or a filter of its result would run it again

    # Sequences too short have no body, and what is asked after the UDF isn't moved before it: so a sequence is made once a read.
    known = reads.select("name", "seq", tail("seq").alias("tail")).where("tail IS NOT NULL AND tail.length IS NOT NULL").withColumn("body", F.substring("seq", F.lit(1), F.length("seq") - 28))
    cell, umi = F.right("seq", F.lit(16)), F.left(F.right("seq", F.lit(28)), F.lit(12))
    return known.select("name", cell.alias("cell"), umi.alias("umi"), F.col("tail.length").alias("tail_length"), F.try_divide("tail.a", "tail.length").alias("a_share"), F.substring("body", F.lit(1), F.length("body") - F.col("tail.length")).alias("genomic"))


def classify_terminal(seq: Column, reference: str, size: int = 20, distance: int = 3) -> Column:
    """RD-51: whether the last `size` bases are within a Hamming distance of some stretch of the reference.

    A Pandas UDF compares a batch of ends with each stretch, so a sequence is made once a read.
    """
    stretches = [np.frombuffer(reference[i : i + size].encode("utf-32-le"), np.uint32) for i in range(len(reference) - size + 1)]
    if not stretches:
        return F.lit(False)

    @F.pandas_udf("boolean")
    def near(ends: pd.Series) -> pd.Series:
        long = ends.str.len() == size
        data = np.frombuffer("".join(ends[long]).encode("utf-32-le"), np.uint32).reshape(-1, size)
        out = pd.Series(np.where(ends.isna(), None, False), index=ends.index, dtype="boolean")
        out[long] = np.min([(data != s).sum(axis=1) for s in stretches], axis=0) <= distance
        return out

    return near(F.substring(seq, -size, size))


def polya_summary(tails: DataFrame) -> DataFrame:
    """RD-52: reads, tails, cells, molecules and tail lengths in one row."""
    has = F.col("tail_length") > 0
    size = F.when(has, F.col("tail_length"))
    return tails.agg(F.count("*").alias("reads"), F.count_if(has).alias("tails"), F.count_distinct("cell").alias("cells"), F.count_distinct("umi").alias("umis"), F.avg(size).alias("mean_length"), F.percentile(size, 0.5).alias("median_length"), F.max(size).alias("max_length"))


def polya_best_window(reads: DataFrame, min_length: int = 6, share: float = 2 / 3) -> DataFrame:
    """RD-53: the window of best length times A share anywhere in the sequence (the first of the shortest of equals)."""

    @F.pandas_udf("start int, length int, score double")
    def best(seqs: pd.Series) -> pd.DataFrame:
        """For each number of A the shortest stretch that holds so many, from the places of A of all reads of a batch at once."""
        seqs = seqs.fillna("").str.upper()
        sizes = seqs.str.len().to_numpy()
        width = max(int(sizes.max()), min_length)
        is_a = np.frombuffer("".join(seqs.str.pad(width, "right", "-")).encode("ascii", "replace"), np.uint8).reshape(len(seqs), width) == ord("A")
        row, at = np.nonzero(is_a)
        many = np.bincount(row, minlength=len(seqs))
        # A column a read, below each other its places of A; where there are no more, apart from all and each other.
        most = max(int(many.max()), 1)
        places = np.repeat(2 * width * np.arange(1, most + 1, dtype=np.int32 if width < 30_000 else np.int64)[:, None], len(seqs), axis=1)
        places[np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many), row] = at
        start, length, score = np.full(len(seqs), -1), np.zeros(len(seqs), np.int64), np.zeros(len(seqs))
        for n in range(1, int(many.max()) + 1):  # length times share is the number of A
            if n < share * min_length - 1e-9:
                continue
            least = np.maximum((places[n - 1 :] - places[: most - n + 1]).min(axis=0) + 1, min_length)
            better = (many >= n) & (n >= share * least - 1e-9) & (least <= sizes)
            length[better], score[better] = least[better], n
        # The first stretch of that length with that number of A.
        total = np.concatenate([np.zeros((len(seqs), 1), np.int32), np.cumsum(is_a, axis=1, dtype=np.int32)], axis=1)
        for n in np.unique(length[length > 0]):
            some = np.flatnonzero(length == n)
            start[some] = (total[some, n:] - total[some, :-n]).argmax(axis=1)
        return pd.DataFrame({"start": pd.Series(start).where(length > 0).astype("Int32"), "length": length, "score": score})

    return reads.select("name", "file_offset", best("seq").alias("r")).select("name", "file_offset", "r.*")
