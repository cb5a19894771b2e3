"""Sinks: tables, reads split by cell or class, rejection counters and events as GFF3."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from cytolake.functions.stats import numbered
from cytolake.operators import reads as r


#: Reads that a task sorts before it writes them, about: half a GB of short reads.
SORTED_ROWS = 1_000_000


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """SNK-01: CSV or TSV with a header; arrays joined by `;`, booleans in capitals."""

    def flat(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            return F.array_join(c, ";").alias(name)
        return (F.upper(c.cast("string")) if kind == "boolean" else c).alias(name)

    df.select(*[flat(n, k) for n, k in df.dtypes]).write.option("header", True).option("sep", sep).csv(path)


def write_aligned(reads: DataFrame, path: str) -> None:
    """SRC-01: reads laid out for region scans: end_pos added, a folder a reference, ranges of positions, sorted; and the longest span of each reference.

    Reads are not shuffled: each input partition is written by a task a range, of about SORTED_ROWS of its reads, which
    reads no further column of the others. So a range has a file an input partition at most, sorted, and a scan skips
    files, row groups and pages by position. Reads without a place go to the folder of null.
    """
    end = r.c.last_block(F.col("cigar"), F.col("pos"))["end"]
    cuts = range_cuts(reads, share_count(reads))

    def before(cut: tuple[str, int | None]) -> Column:
        """Whether a read lies before a cut; reads without a reference come last."""
        ref, pos = cut
        return F.coalesce(F.col("ref") < ref if pos is None else (F.col("ref") < ref) | ((F.col("ref") == ref) & (F.col("pos") < pos)), F.lit(False))

    ranges = [reads.where((~before(low) if low else F.lit(True)) & (before(high) if high else F.lit(True))) for low, high in zip([None, *cuts], [*cuts, None])]
    placed = reduce(DataFrame.unionByName, ranges).withColumn("end_pos", F.coalesce(end, F.col("pos")))
    placed.sortWithinPartitions("ref", "pos").write.option("compression", "zstd").partitionBy("ref").parquet(f"{path}/reads")
    written = reads.sparkSession.read.parquet(f"{path}/reads")
    written.groupBy("ref").agg(F.max(F.col("end_pos") - F.col("pos")).alias("span")).coalesce(1).write.parquet(f"{path}/spans")


def range_cuts(reads: DataFrame, ranges: int, grid: int = 1000) -> list[tuple[str, int | None]]:
    """Where about so many ranges of equal numbers of reads begin, the first one left out: (ref, first pos or None), ascending. A reference has at most `grid` ranges."""
    if ranges < 2:
        return []
    found = reads.where("ref IS NOT NULL").groupBy("ref").agg(F.count("*").alias("n"), F.percentile_approx("pos", [k / grid for k in range(1, grid)]).alias("q")).orderBy("ref").collect()
    most = max(1, sum(n for _, n, _ in found) / ranges)
    cuts, held = [], 0.0
    for ref, n, q in found:
        pieces = min(grid, math.ceil(n / most)) if q else 1
        starts = [None] + sorted({q[k * grid // pieces - 1] for k in range(1, pieces)})
        for pos in starts:
            if held and held + n / len(starts) > most * (1 + 1e-9):
                cuts.append((ref, pos))
                held = 0.0
            held += n / len(starts)
    return cuts


def reads_of_cells(reads: DataFrame, cells: DataFrame) -> DataFrame:
    """SNK-02: reads of the listed cells."""
    return reads.join(cells.select("cb").distinct(), "cb", "left_semi")


def split_by_cell(reads: DataFrame, cells: DataFrame, path: str) -> None:
    """SNK-02: one folder a listed cell."""
    reads_of_cells(reads, cells).repartition("cb").sortWithinPartitions("cb", "ref", "pos").write.partitionBy("cb").parquet(path)


def split_by_isoform(reads: DataFrame, path: str) -> None:
    """SNK-03: one folder an isoform class, sorted by position inside each file.

    Where an input partition has more than SORTED_ROWS reads, it is written by several tasks, each with a hashed share of
    its reads, so that they are sorted in memory and neither spilled nor shuffled. All is one write.
    """
    shares = in_shares(reads)
    kinds = r.with_blocks(shares).withColumn("isoform", r.classify_isoform(F.col("blocks"))).drop("blocks", "gaps")
    kinds.sortWithinPartitions("isoform", "ref", "pos").write.option("compression", "zstd").partitionBy("isoform").parquet(path)


def share_count(reads: DataFrame) -> int:
    """Tasks for an input partition that leave none with much more than SORTED_ROWS reads."""
    largest = reads.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return -(-largest // SORTED_ROWS)


def in_shares(reads: DataFrame) -> DataFrame:
    """All reads, each once, in as many partitions for one of the input as leave none with much more than SORTED_ROWS.

    The share of a read follows from its file_offset, so a scan drops the others before it makes or reads further columns.
    That is for scans; Spark puts the shares of an input of known partitioning (a shuffle's) together again.
    """
    n = share_count(reads)
    if n < 2:
        return reads
    share = F.pmod(F.xxhash64("file_offset"), F.lit(n))
    return reduce(DataFrame.unionByName, [reads.where(share == k) for k in range(n)])


REASONS = ("no cell", "no molecule", "flag", "region", "kept")


def write_kept(reads: DataFrame, flags: tuple[int, ...], chrom: str, start: int, end: int, path: str) -> dict[str, int]:
    """SNK-04: writes the reads that pass, and counts all by reason in the same scan, as observed metrics of the write."""
    seen = Observation()
    watched = rejected(reads, flags, chrom, start, end).observe(seen, *[F.count_if(F.col("reason") == x).alias(x) for x in REASONS])
    watched.where("reason = 'kept'").drop("reason").write.parquet(path)
    return {x: n for x, n in seen.get.items() if n}


def filter_report(reads: DataFrame, flags: tuple[int, ...], chrom: str, start: int, end: int) -> DataFrame:
    """SNK-04: reads by the first test that rejects them: no cell, no molecule, flag, region; else kept."""
    return rejected(reads, flags, chrom, start, end).groupBy("reason").agg(F.count("*").alias("reads"))


def rejected(reads: DataFrame, flags: tuple[int, ...], chrom: str, start: int, end: int) -> DataFrame:
    """reads with the reason: the first test that rejects it, else kept."""
    over = r.c.overlap(F.col("b.start"), F.col("b.end"), F.lit(start), F.lit(end)) >= 20
    d = reads.withColumn("b", r.c.last_block(F.col("cigar"), F.col("pos")))
    reason = F.when(F.col("cb").isNull(), "no cell").when(F.col("ub").isNull(), "no molecule").when(~F.coalesce(F.col("xf").isin(*flags), F.lit(False)), "flag").when((F.col("ref") != chrom) | ~F.coalesce(over, F.lit(False)), "region").otherwise("kept")
    return d.withColumn("reason", reason).drop("b")


def events_to_gff3(events: DataFrame) -> DataFrame:
    """SNK-05: eight rows of each exon-skipping event (gene, two transcripts, their five exons), 1-based ends included, as GFF3 lines.

    Columns: event_id, chrom, strand, and 0-based half-open exons up, skipped and down (start and end).
    """
    ends = {p: (F.col(f"{p}_start") + 1, F.col(f"{p}_end")) for p in ("up", "skipped", "down")}
    whole = (ends["up"][0], ends["down"][1])
    event = F.col("event_id")

    def row(k: int, kind: str, span: tuple[Column, Column], name: Column, parent: Column | None) -> Column:
        attributes = F.concat(F.lit("ID="), name, *([] if parent is None else [F.lit(";Parent="), parent]))
        return F.struct(F.lit(k).alias("k"), F.concat_ws("\t", "chrom", F.lit("SE"), F.lit(kind), span[0].cast("string"), span[1].cast("string"), F.lit("."), "strand", F.lit("."), attributes).alias("line"))

    a, b = F.concat(event, F.lit(".A")), F.concat(event, F.lit(".B"))
    rows = [row(0, "gene", whole, event, None), row(1, "mRNA", whole, a, event), row(2, "mRNA", whole, b, event)]
    rows += [row(3 + i, "exon", ends[p], F.concat(a, F.lit(f".{p}")), a) for i, p in enumerate(("up", "skipped", "down"))]
    rows += [row(6 + i, "exon", ends[p], F.concat(b, F.lit(f".{p}")), b) for i, p in enumerate(("up", "down"))]
    return events.select("event_id", F.inline(F.array(*rows)))


def write_mex(counts: DataFrame, path: str) -> None:
    """A sparse matrix folder of count triples (cell, gene, n): features, barcodes and matrix, genes and cells numbered in ascending order.

    Each is a folder of part files which, one after the other by name, are the whole file; the matrix's header is the first.
    """
    lists = {}
    for name, column in (("features", "gene"), ("barcodes", "cell")):
        lists[column] = numbered(counts.select(column).distinct(), "at", column)
        lists[column].repartitionByRange("at").sortWithinPartitions("at").select(F.col(column).alias("value")).write.text(f"{path}/{name}.tsv")
    sizes = counts.agg(F.count("*").alias("n")).crossJoin(lists["gene"].agg(F.count("*").alias("genes"))).crossJoin(lists["cell"].agg(F.count("*").alias("cells")))
    head = sizes.select(F.concat_ws("\n", F.lit("%%MatrixMarket matrix coordinate integer general"), F.concat_ws(" ", "genes", "cells", "n")).alias("value")).coalesce(1)
    rows = counts.join(lists["gene"].withColumnRenamed("at", "g"), "gene").join(lists["cell"].withColumnRenamed("at", "c"), "cell")
    # Partitions of a union follow each other, so the header's is the first file.
    head.unionByName(rows.select(F.concat_ws(" ", F.col("g") + 1, F.col("c") + 1, "n").alias("value"))).write.text(f"{path}/matrix.mtx")
