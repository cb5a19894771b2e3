"""Sources: aligned reads, raw reads, sequences, matrices, lists and regions from files that Spark reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cytolake.functions.stats import numbered

SAM = "name string, flag int, ref string, pos int, mapq int, cigar string, mate_ref string, mate_pos int, template_length int, seq string, qual string"


def read_region(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """SRC-01: reads whose span overlaps the 0-based half-open interval; the filter reaches the scan where the table has end_pos."""
    return reads.where((F.col("ref") == chrom) & (F.col("pos") < end) & (F.col("end_pos") > start))


def read_aligned(spark: SparkSession, path: str, chrom: str, start: int, end: int) -> DataFrame:
    """SRC-01: reads of a table that writers.write_aligned laid out whose span overlaps the 0-based half-open interval.

    One folder a reference, positions in ranges, and the longest span of each reference beside the reads: so the scan
    opens one folder and skips files, row groups and pages on either side by their least and largest position.
    """
    longest = spark.read.parquet(f"{path}/spans").where(F.col("ref") == chrom).agg(F.max("span")).first()[0]
    found = spark.read.parquet(f"{path}/reads").where(F.col("ref") == chrom)
    return read_region(found.where(F.col("pos") > start - (longest or 0)), chrom, start, end)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: every record of SAM text, unmapped ones too: 0-based pos, tags as a map, * as null."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    star = lambda c: F.when(c != "*", c)
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(12), F.size(f)), lambda t: F.struct(F.substring(t, 1, 2), F.substring(t, F.lit(6), F.length(t)))))
    return lines.select(
        f[0].alias("name"), f[1].cast("int").alias("flag"), star(f[2]).alias("ref"), (f[3].cast("int") - 1).alias("pos"), f[4].cast("int").alias("mapq"), star(f[5]).alias("cigar"), star(f[9]).alias("seq"), star(f[10]).alias("qual"), tags.alias("tags")
    )


def tag(tags: Column | str, name: str) -> Column:
    """SRC-03: an optional tag, null where absent."""
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(name))


def umi(tags: Column | str) -> Column:
    """SRC-03: corrected molecule tag, else the raw one."""
    return F.coalesce(tag(tags, "UB"), tag(tags, "UR"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: (read_id, comment, seq, qual) of FASTQ text, four lines a record, from any store that Spark reads.

    Lines that begin with @ part the rows, so a plain file of any size is split by byte ranges and a gzip file streams
    through one task; nothing holds a file. A quality line that begins with @ parts its record in two rows,
    which follow each other in the file: these halves alone are brought together, inside a block of the file, and
    over the ends of blocks (two rows a block at most). A last record that is cut short is left out. Names never
    begin with @ themselves. Line ends may be those of Windows, and blank lines may follow the last record.
    """
    lines = F.split(F.translate("value", "\r", ""), "\n")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]
    rows = spark.read.option("lineSep", "\n@").text(path).select(lines.alias("lines"), *place)
    headed = F.coalesce(F.get("lines", F.lit(2)).startswith("+"), F.lit(False))
    whole = rows.where(headed & (F.size("lines") > 3)).select("lines", F.get("lines", F.lit(3)).alias("qual"))
    halves = rows.where(~headed | (F.size("lines") <= 3)).withColumn("first", headed)
    block = W.partitionBy("file", "block").orderBy("at")
    halves = halves.withColumns({"next": F.lead("lines").over(block), "next_first": F.lead("first").over(block), "last_first": F.lag("first").over(block)})
    inside = halves.where("first AND NOT next_first").select("lines", "next")
    ends = halves.where("first AND next IS NULL OR NOT first AND last_first IS NULL")
    over = W.partitionBy("file").orderBy("block", "at")
    across = ends.withColumns({"next": F.lead("lines").over(over), "next_first": F.lead("first").over(over)}).where("first AND NOT next_first").select("lines", "next")
    joined = inside.unionByName(across).select("lines", F.concat(F.lit("@"), F.get("next", F.lit(0))).alias("qual"))
    head = F.regexp_replace(F.get("lines", F.lit(0)), "^@", "")
    return whole.unionByName(joined).select(F.split_part(head, F.lit(" "), F.lit(1)).alias("read_id"), F.split_part(head, F.lit(" "), F.lit(2)).alias("comment"), F.get("lines", F.lit(1)).alias("seq"), "qual")


def read_fastq_pairs(spark: SparkSession, first: str, second: str) -> DataFrame:
    """SRC-04: read pairs of equal ids; others are dropped."""
    a, b = (read_fastq(spark, p).select("read_id", F.col("seq").alias(f"seq_{i}"), F.col("qual").alias(f"qual_{i}")) for i, p in enumerate((first, second), 1))
    return a.join(b, "read_id")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SRC-06: alignment in long form: title, pos from 1 and base of each record."""
    records = spark.read.option("lineSep", ">").text(path).where("trim(value) <> ''")
    title = F.trim(F.split_part("value", F.lit("\n"), F.lit(1)))
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return records.select(title.alias("title"), F.posexplode(F.split(body, "")).alias("pos", "base")).where("base <> ''").select("title", (F.col("pos") + 1).alias("pos"), "base")


def read_mex(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-07: (cell, gene, n) of a sparse matrix folder (matrix.mtx, barcodes.tsv, features.tsv, gzip or not); never dense.

    Each is a file or a folder of part files, which follow each other by name. Lines of the two lists are numbered over
    range partitions of (file, block, line), so no task reads a list or the matrix whole.
    """

    def lines(pattern: str) -> DataFrame:
        text = spark.read.option("lineSep", "\n").text(pattern)
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
        return text.select(F.translate("value", "\r", "").alias("value"), place.alias("place"))

    def listed(name: str, column: str) -> DataFrame:
        whole = numbered(lines(f"{folder}/{name}.tsv*"), "k", "place")
        return whole.where("value <> ''").select((F.col("k") + 1).alias(f"{column}_idx"), F.split_part("value", F.lit("\t"), F.lit(1)).alias(column))

    rows = lines(f"{folder}/matrix.mtx*").where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # The size line is the first one after the comments.
    first = rows.agg(F.min("place").alias("first"))
    f = F.split(F.trim("value"), r"\s+")
    body = rows.join(F.broadcast(first), F.col("place") > F.col("first")).select(f[0].cast("long").alias("gene_idx"), f[1].cast("long").alias("cell_idx"), f[2].cast("long").alias("n"))
    return body.join(listed("features", "gene"), "gene_idx").join(listed("barcodes", "cell"), "cell_idx").select("cell", "gene", "n")


def read_molecules(molecules: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """SRC-08: molecules (cell, gene, umi, reads), restricted to listed cells before anything else is read or joined."""
    return molecules if cells is None else molecules.join(cells.select("cell").distinct(), "cell", "left_semi")


def clean_cells(cells: DataFrame, suffix: str | None = None) -> DataFrame:
    """SRC-09: distinct cells without their gem suffix, or with the one given."""
    bare = F.regexp_replace(F.trim("cell"), r"-\d+$", "")
    return cells.where("trim(cell) <> ''").select((bare if suffix is None else F.concat(bare, F.lit(suffix))).alias("cell")).distinct()


def read_cells(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """SRC-09: cell list from text or CSV, gzip or not: the first field of each line."""
    return clean_cells(spark.read.text(path).select(F.split_part("value", F.lit(","), F.lit(1)).alias("cell")), suffix)


def first_field(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC-10: the first field of each line, at white space."""
    return lines.select(F.split(F.trim(column), r"\s+")[0].alias("cell")).where("cell <> ''")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: whitelist text."""
    return first_field(spark.read.text(path))


def regions_of(table: DataFrame, reference: str | None = None) -> DataFrame:
    """SRC-11: regions (target, chrom, start_pos, end_pos); a given reference wins, and without it and a Chr column there is an error."""
    names = {c.lower(): c for c in table.columns}
    if reference is None and "chr" not in names:
        raise ValueError("regions need a Chr column or a reference")
    chrom = F.lit(reference) if reference is not None else F.col(names["chr"])
    return table.select(F.col(names["target"]).alias("target"), chrom.alias("chrom"), F.col(names["start"]).cast("long").alias("start_pos"), F.col(names["end"]).cast("long").alias("end_pos"))


def read_regions(spark: SparkSession, path: str, reference: str | None = None) -> DataFrame:
    """SRC-11: region table from CSV."""
    return regions_of(spark.read.csv(path, header=True), reference)


def union_common(parts: Sequence[DataFrame]) -> DataFrame:
    """SRC-12: union of tables by the columns that all of them have, in the first one's order."""
    common = [c for c in parts[0].columns if all(c in p.columns for p in parts)]
    out = parts[0].select(common)
    for p in parts[1:]:
        out = out.unionByName(p.select(common))
    return out


def read_many(spark: SparkSession, pattern: str, name: str = "file") -> DataFrame:
    """SRC-12: CSV files by a path pattern, tagged with their file name."""
    return spark.read.csv(pattern, header=True).withColumn(name, F.element_at(F.split(F.input_file_name(), "/"), -1))


def events_of(tables: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """SRC-13: splicing events of several types in one table: common columns and the type's coordinate pairs as an array of structs."""
    out = None
    for kind, (table, pairs) in sorted(tables.items()):
        exons = F.array(*[F.struct(F.col(f"{p}_start").cast("long").alias("start"), F.col(f"{p}_end").cast("long").alias("end")) for p in pairs])
        part = table.select("event_id", "gene", F.lit(kind).alias("event_type"), exons.alias("exons"))
        out = part if out is None else out.unionByName(part)
    return out


def gene_sets(long: DataFrame) -> DataFrame:
    """SRC-14: each set with its sorted distinct genes."""
    return long.groupBy("gene_set").agg(F.sort_array(F.collect_set("gene")).alias("genes"))
