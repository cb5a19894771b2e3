"""Barcodes: sample, cell, molecule and clone labels from raw reads, and their error correction."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.functions import stats
from cytolake.functions.cigar import reverse_complement
from cytolake.functions.graph import greedy_clusters
from cytolake.plans.staging import staged

BASES = "ACGT"


def hamming(a: Column, b: Column) -> Column:
    """Differing places of two strings of equal length."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)


def demux(fastq: DataFrame, samples: DataFrame, max_mismatch: int = 1) -> DataFrame:
    """BC-01: sample of each read by its index: the equal one, else the only nearest within max_mismatch; ties stay unassigned (null)."""
    d = hamming(F.col("index_part"), F.col("index_seq"))
    distinct = fastq.select("index_part").distinct()
    near = distinct.join(F.broadcast(samples), F.length("index_part") == F.length("index_seq")).withColumn("d", d).where(F.col("d") <= max_mismatch)
    best = near.groupBy("index_part").agg(F.min("d").alias("d"), F.sort_array(F.collect_list(F.struct("d", "sample"))).alias("all"))
    ties = F.size(F.filter("all", lambda x: x["d"] == F.col("d")))
    chosen = best.where(ties == 1).select("index_part", F.col("all")[0]["sample"].alias("sample"))
    return fastq.join(chosen, "index_part", "left").select("read_id", "index_part", "sample")


def primer_distance(seq: Column, primer: str, k: int) -> Column:
    """Least edit distance of the primer to a start of the read, over lengths within k of the primer's."""
    n = len(primer)
    return F.least(*[F.levenshtein(F.substring(seq, 1, m), F.lit(primer)) for m in range(max(n - k, 1), n + k + 1)]) if k else F.levenshtein(F.substring(seq, 1, n), F.lit(primer))


def where_primer(fastq: DataFrame, primer: str, k: int = 4, stagger: str = "") -> DataFrame:
    """BC-02: reads that begin with the exact stagger and the primer with at most k edits."""
    rest = F.substring("seq", F.lit(len(stagger) + 1), F.length("seq"))
    return fastq.where(F.col("seq").startswith(stagger) & (primer_distance(rest, primer, k) <= k))


def where_quality(fastq: DataFrame, q: int = 14, max_low: int = 5, region: tuple[int, int] = (1, 40)) -> DataFrame:
    """BC-03: reads with at most max_low bases of quality q or less in a region (1-based start, length); Phred+33."""
    low = "".join(chr(33 + i) for i in range(q + 1))
    part = F.substring("qual", *region)
    return fastq.where(F.length(part) - F.length(F.translate(part, low, "")) <= max_low)


def where_complex(fastq: DataFrame, column: str = "seq") -> DataFrame:
    """BC-04: reads without runs of four equal bases or two unknown ones."""
    return fastq.where(~F.col(column).rlike("AAAA|CCCC|GGGG|TTTT|NN"))


def shave(fastq: DataFrame, cell: tuple[int, int] = (1, 16), umi: tuple[int, int] = (17, 12), barcode: tuple[int, int] = (29, 70)) -> DataFrame:
    """BC-05, BC-06: distinct (cell, umi, barcode) with their reads; places are 1-based start and length."""
    parts = [F.substring("seq", *place).alias(name) for name, place in (("cell", cell), ("umi", umi), ("barcode", barcode))]
    return fastq.select(*parts).groupBy("cell", "umi", "barcode").agg(F.count("*").alias("reads"))


def shave_totals(fastq: DataFrame, shaved: DataFrame) -> DataFrame:
    """BC-05: reads, distinct screened sequences and distinct shaved triples."""
    return fastq.agg(F.count("*").alias("reads"), F.count_distinct("seq").alias("screened")).crossJoin(shaved.agg(F.count("*").alias("shaved")))


def extract_adapter(fastq: DataFrame, adapter: str, k: int = 3, cell: int = 16, umi: int = 12) -> DataFrame:
    """BC-07: adapter on either strand, then cell, molecule and a T tail of at least 6 of 8 bases; the tail is trimmed.

    One Pandas UDF gives the adapter's end on both strands, so a read is made once: exact places first, then the best
    fuzzy place with up to k edits where the read has an exact 8-mer of the adapter (fewest edits are tried first, which
    finds the same place). The tail is a run of T, or of another base directly followed by T; at least 8 bases go.
    """
    import regex

    patterns = [regex.compile(f"(?b)(?:{regex.escape(adapter)}){{e<={n}}}") for n in range(1, k + 1)]
    seeds = [adapter[i : i + 8] for i in range(0, len(adapter) - 7, 4)]
    complement = str.maketrans("ACGTacgt", "TGCAtgca")

    def end_of(seq: str) -> int:
        at = seq.find(adapter)
        if at >= 0:
            return at + len(adapter)
        if any(s in seq for s in seeds):
            for pattern in patterns:
                if m := pattern.search(seq):
                    return m.end()
        return 0

    @F.pandas_udf("plus int, minus int")
    def ends(seqs: pd.Series) -> pd.DataFrame:
        both = [(0, 0) if s is None else (end_of(s), end_of(s.translate(complement)[::-1])) for s in seqs]
        return pd.DataFrame(both, columns=["plus", "minus"]).astype("int32")

    side = lambda strand, s, end: F.struct(F.lit(strand).alias("strand"), s.alias("s"), F.col(f"ends.{end}").alias("end"))
    sides = F.array(side("+", F.col("seq"), "plus"), side("-", reverse_complement(F.col("seq")), "minus"))
    ends = ends.asNondeterministic()  # or the filter would run it again
    read = fastq.select("read_id", "seq", ends("seq").alias("ends")).where("ends.plus > 0 OR ends.minus > 0")
    found = read.select("read_id", F.inline(sides)).where("end > 0")
    after = F.substring(F.col("s"), F.col("end") + 1, F.length("s"))
    head = F.substring("after", cell + umi + 1, 8)
    tailed = found.withColumn("after", after).where((F.length("after") >= cell + umi + 8) & (F.length(head) - F.length(F.replace(head, F.lit("T"), F.lit(""))) >= 6))
    rest = F.substring("after", F.lit(cell + umi + 1), F.length("after"))
    run = F.greatest(F.length(F.regexp_extract(rest, "^((?:T|[^T](?=T))*)", 1)), F.lit(8))
    run = F.when(F.length(F.regexp_extract(rest, "^((?:T|[^T](?=T))*)", 1)) == F.length(rest), 8).otherwise(run)
    first = tailed.withColumn("cdna", F.substring(rest, F.lit(1) + run, F.length(rest))).withColumn("k", F.row_number().over(W.partitionBy("read_id").orderBy("strand")))
    return first.where("k = 1").select("read_id", "strand", F.substring("after", 1, cell).alias("cell"), F.substring("after", cell + 1, umi).alias("umi"), "cdna")


def extract_clone_barcode(cdna: DataFrame, primer: str, size: int = 70, k: int = 4, last: int = 150, first: int = 100) -> DataFrame:
    """BC-08: the `size` bases before the primer's reverse complement (its last exact place, else fuzzy in the last bases), else those after the primer (fuzzy in the first bases)."""
    import regex

    from_end = primer.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    backward, forward = regex.compile(f"(?b)(?:{from_end}){{e<={k}}}"), regex.compile(f"(?b)(?:{primer}){{e<={k}}}")

    def barcode(seq: str | None) -> str | None:
        seq = seq or ""
        at = seq.rfind(from_end)
        if at < 0 and (m := backward.search(seq, max(0, len(seq) - last))):
            at = m.start()
        if at >= 0:
            return seq[max(0, at - size) : at]
        m = forward.search(seq, 0, first)
        return seq[m.end() : m.end() + size] if m else None

    @F.pandas_udf("string")
    def found(seqs: pd.Series) -> pd.Series:
        return seqs.map(barcode)

    return cdna.withColumn("barcode", found("cdna"))


def _masked(seq: Column, length: int) -> Column:
    """The sequence with each place masked in turn: equal masks mean at most one substitution."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.concat(F.substring(seq, F.lit(1), i - 1), F.lit("."), F.substring(seq, i + 1, F.lit(length))))


def substituted(odd: DataFrame, listed: DataFrame, length: int, k: int) -> DataFrame:
    """(cell, known, n, places): pairs of odd (cell) and listed (known, n) barcodes that differ in 1 to k places (from 0).

    For each choice of m places, m up to k, both sides meet by the barcode with these places masked; a pair of m
    substitutions meets under its own m places alone, as all masked places have to differ.
    """
    out = None
    for m in range(1, k + 1):
        at = [f"at_{i}" for i in range(m)]
        choices = F.array(*[F.struct(*[F.lit(p).alias(a) for a, p in zip(at, c)]) for c in itertools.combinations(range(length), m)])

        def masked(df: DataFrame, text: str) -> DataFrame:
            mask = F.col(text)
            for a in at:
                mask = F.overlay(mask, F.lit("."), F.col(a) + 1)
            return df.select("*", F.inline(choices)).withColumn("mask", mask)

        near = masked(odd, "cell").join(masked(listed, "known"), [*at, "mask"]).where(" AND ".join(f"substring(cell, {a} + 1, 1) <> substring(known, {a} + 1, 1)" for a in at))
        near = near.select("cell", "known", "n", F.array(*at).alias("places"))
        out = near if out is None else out.unionByName(near)
    return out


def correct_cells(reads: DataFrame, whitelist: DataFrame, length: int, p: float = 0.975, k: int = 2) -> DataFrame:
    """BC-09: the listed cell of highest posterior, within k substitutions, if the posterior reaches p.

    Likelihood: the product of 10^(-q/10) with the quality of each substituted place; prior: exact matches + 1, counted
    beforehand over all reads. Reads whose cell is listed keep it. Columns of reads: read_id, cell, qual. Distinct
    unlisted cells are matched, however many reads have them.
    """
    listed = whitelist.select(F.col("cell").alias("known")).distinct()
    counts = reads.groupBy("cell").agg(F.count("*").alias("n"))
    weighted = listed.join(counts.select(F.col("cell").alias("known"), "n"), "known", "left").select("known", (F.coalesce("n", F.lit(0)) + 1).alias("n"))
    same = F.col("cell") == F.col("known")
    exact = reads.join(listed, same, "left_semi").select("read_id", F.col("cell").alias("corrected"), F.lit(1.0).alias("posterior"))
    odd = counts.where(F.length("cell") == length).join(listed, same, "left_anti").select("cell")
    near = substituted(odd, weighted.where(F.length("known") == length), length, k)
    error = F.aggregate("places", F.lit(1.0), lambda x, i: x * F.pow(F.lit(10.0), (33 - F.ascii(F.substring("qual", i + 1, F.lit(1)))) / 10.0))
    scored = reads.join(near, "cell").select("read_id", "known", (error * F.col("n")).alias("score"))
    best = scored.groupBy("read_id").agg(F.max(F.struct("score", "known")).alias("best"), F.sum("score").alias("total"))
    kept = best.withColumn("posterior", F.col("best.score") / F.col("total")).where(F.col("posterior") >= p)
    return exact.unionByName(kept.select("read_id", F.col("best.known").alias("corrected"), "posterior"))


def correct_cells_h1(df: DataFrame, whitelist: DataFrame, length: int) -> DataFrame:
    """BC-10: map of unlisted cells to the first listed one at Hamming distance 1, by place, then A, C, G, T."""
    listed = whitelist.select(F.col("cell").alias("corrected")).distinct()
    odd = df.select("cell").distinct().join(listed, F.col("cell") == F.col("corrected"), "left_anti")
    keys = listed.select("corrected", F.posexplode(_masked(F.col("corrected"), length)).alias("pos", "mask"))
    near = odd.select("cell", F.posexplode(_masked(F.col("cell"), length)).alias("pos", "mask")).join(keys, ["pos", "mask"])
    return near.groupBy("cell").agg(F.min_by("corrected", F.struct("pos", "corrected")).alias("corrected"))


def merge_umis(df: DataFrame) -> DataFrame:
    """BC-11: per cell, in the order of falling count (ties by sequence), each molecule left takes the later ones left at Hamming distance 1.

    A molecule that was taken takes no one. Columns: cell, umi, n. Neighbours share a sequence with one place left out.
    """
    key = F.concat_ws("|", "cell", "umi")
    totals = staged(df.groupBy("cell", "umi").agg(F.sum("n").alias("n")).withColumn("id", key))
    places = F.transform(F.sequence(F.lit(1), F.length("umi")), lambda i: F.concat(i.cast("string"), F.lit(":"), F.substring(F.col("umi"), F.lit(1), i - 1), F.lit("_"), F.substring(F.col("umi"), i + 1, F.length("umi"))))
    side = lambda id, n: totals.where("umi <> ''").select("cell", F.col("id").alias(id), F.col("n").alias(n), F.explode(places).alias("mask"))
    earlier = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    links = staged(side("a", "na").join(side("b", "nb"), ["cell", "mask"]).where(earlier).select("a", "na", "b").distinct())
    centres = greedy_clusters(totals, links)
    sums = totals.join(centres, "id").groupBy("centre").agg(F.sum("n").alias("n"))
    return sums.join(totals.select(F.col("id").alias("centre"), "cell", "umi"), "centre").select("cell", "umi", "n")


def clean_counts(df: DataFrame, whitelist: DataFrame) -> DataFrame:
    """BC-12: molecules and reads per cell, of those seen more than once in listed cells."""
    return df.where("n > 1").join(whitelist.select("cell").distinct(), "cell", "left_semi").groupBy("cell").agg(F.count("*").alias("umis"), F.sum("n").alias("reads"))


def barcode_table(shaved: DataFrame, cells: DataFrame, sizes: Sequence[int] = (50, 40, 30)) -> DataFrame:
    """BC-13: shaved rows of valid cells with prefixes of the barcode."""
    return shaved.join(cells.select("cell").distinct(), "cell", "left_semi").select("cell", "umi", "barcode", *[F.substring("barcode", 1, n).alias(f"barcode_{n}") for n in sizes])


def edit_distance_histogram(df: DataFrame, column: str, n: int = 5000, seed: int = 1) -> DataFrame:
    """BC-14: edit distances among all pairs of n distinct values (those of smallest seeded hash), with shares."""
    picked = df.select(column).distinct().orderBy(F.xxhash64(column, F.lit(seed)), column).limit(n)
    a, b = picked.select(F.col(column).alias("a")), F.broadcast(picked.select(F.col(column).alias("b")))  # n rows
    d = a.join(b, F.col("a") < F.col("b")).groupBy(F.levenshtein("a", "b").alias("distance")).agg(F.count("*").alias("pairs"))
    return d.withColumn("share", F.col("pairs") / F.sum("pairs").over(W.partitionBy(F.lit(1))))


def near_candidates(values: DataFrame, distance: int) -> DataFrame:
    """Distinct pairs (short, long), short no longer than long, of values (value) that may be within the edit distance.

    A text of length l is cut into distance + 1 segments of its own length class; of a longer text within the
    distance at least one of them stands unchanged, near its place. So texts are indexed by (length, segment,
    text), and each text looks up the segments of the lengths there are from its own down to distance less. A short
    text makes short segments for its own class alone. Texts of at most `distance` characters have empty
    segments: they meet all texts of the lengths within reach, as any two such texts are within it.
    """
    k = distance + 1
    texts = values.select("value", F.length("value").alias("size"))
    lengths = sorted(r[0] for r in texts.select("size").distinct().collect())  # lengths there are
    width = lambda l, i: F.floor(l / k).cast("int") + F.when(i >= k - l % k, 1).otherwise(0)
    start = lambda l, i: i * F.floor(l / k).cast("int") + F.greatest(F.lit(0), i - (k - l % k))
    segments = F.explode(F.sequence(F.lit(0), F.lit(distance))).alias("segment")
    left = texts.select(F.col("value").alias("short"), "size", segments)
    left = left.withColumn("text", F.substring("short", start(F.col("size"), F.col("segment")) + 1, width(F.col("size"), F.col("segment")))).where((F.col("segment") == 0) | (F.col("text") != ""))
    there = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    right = texts.select(F.col("value").alias("long"), F.col("size").alias("own"), F.explode(F.filter(there, lambda n: (n <= F.col("size")) & (n >= F.col("size") - distance))).alias("size"))
    more = F.col("own") - F.col("size")
    shifts = F.explode(F.sequence(-F.floor((distance - more) / 2).cast("int"), F.floor((distance + more) / 2).cast("int"))).alias("shift")
    right = right.select("long", "own", "size", segments).select("*", shifts)
    at, wide = start(F.col("size"), F.col("segment")) + F.col("shift"), width(F.col("size"), F.col("segment"))
    right = right.withColumns({"at": at, "wide": wide}).where("at >= 0 AND at + wide <= own AND (wide > 0 OR segment = 0 AND shift = 0)")
    right = right.select("long", "size", "segment", F.substring("long", F.col("at") + 1, F.col("wide")).alias("text")).distinct()
    return left.join(right, ["size", "segment", "text"]).where((F.col("size") < F.length("long")) | (F.col("short") < F.col("long"))).select("short", "long").distinct()


def cluster_barcodes(df: DataFrame, distance: int = 8) -> DataFrame:
    """BC-15: sphere clusters: by falling count (ties by sequence) each free barcode becomes a centre and takes free neighbours within the edit distance."""
    counts = staged(df.groupBy("barcode").agg(F.sum("reads").alias("n")))
    near = near_candidates(counts.select(F.col("barcode").alias("value")), distance).where(F.levenshtein("short", "long", distance) >= 0)
    side = lambda name, n: counts.select(F.col("barcode").alias(name), F.col("n").alias(n))
    pairs = near.join(side("short", "n1"), "short").join(side("long", "n2"), "long")
    first = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("short") < F.col("long")))
    links = pairs.select(F.when(first, F.col("short")).otherwise(F.col("long")).alias("a"), F.greatest("n1", "n2").alias("na"), F.when(first, F.col("long")).otherwise(F.col("short")).alias("b"))
    return greedy_clusters(counts.withColumnRenamed("barcode", "id"), staged(links)).withColumnRenamed("id", "barcode")


def apply_canonical(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """BC-16: each barcode by its cluster's centre, itself where it has none."""
    return df.join(clusters, "barcode", "left").withColumn("canonical", F.coalesce("centre", "barcode")).drop("centre")


def call_singlets(df: DataFrame, least: int = 2, dominant: float = 0.8) -> DataFrame:
    """BC-17: singlet kind of each cell from molecules per barcode: one barcode, a combination that recurs, a dominant barcode, else none."""
    per = df.groupBy("cell", "barcode").agg(F.count_distinct("umi").alias("n")).where(F.col("n") >= least)
    cells = per.groupBy("cell").agg(F.count("*").alias("k"), F.array_join(F.sort_array(F.collect_list("barcode")), "_").alias("combo"), F.max("n").alias("top"), F.sum("n").alias("all"))
    again = cells.groupBy("combo").agg(F.count("*").alias("cells"))
    kind = F.when(F.col("k") == 1, "single").when(F.col("cells") > 1, "combination").when(F.col("top") >= dominant * F.col("all"), "dominant").otherwise("multiplet")
    return cells.join(again, "combo").select("cell", kind.alias("kind"))


def assign_clones(df: DataFrame, threshold: int = 3) -> DataFrame:
    """BC-18: label of each cell: its only barcode above the threshold, or the ordered pair of two if more cells have it."""
    per = df.groupBy("cell", "barcode").agg(F.count("*").alias("n")).where(F.col("n") > threshold)
    cells = per.groupBy("cell").agg(F.sort_array(F.collect_list("barcode")).alias("all")).where(F.size("all") <= 2).select("cell", F.size("all").alias("k"), F.array_join("all", "_").alias("label"))
    shared = cells.where("k = 2").groupBy("label").agg(F.count("*").alias("cells")).where("cells > 1").select("label")
    return cells.where("k = 1").unionByName(cells.where("k = 2").join(shared, "label", "left_semi").select("cell", "k", "label")).select("cell", "label")


def drop_promiscuous(labels: DataFrame, max_partners: int = 3) -> DataFrame:
    """BC-19: labels without any barcode that is in more than max_partners distinct combinations."""
    parts = labels.select("label", F.explode(F.split("label", "_")).alias("part")).distinct()
    bad = parts.where(F.col("label").contains("_")).groupBy("part").agg(F.count("*").alias("k")).where(F.col("k") > max_partners).select("part")
    return labels.join(parts.join(bad, "part", "left_semi").select("label").distinct(), "label", "left_anti")


def rescue_sweep(df: DataFrame, thresholds: Sequence[int], known: DataFrame) -> DataFrame:
    """BC-20: at each threshold the cells with exactly two barcodes, by whether their combination is known."""
    per = df.groupBy("cell", "barcode").agg(F.count("*").alias("n"))
    at = per.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).where("n > threshold")
    combos = at.groupBy("threshold", "cell").agg(F.sort_array(F.collect_list("barcode")).alias("all")).where(F.size("all") == 2).select("threshold", F.array_join("all", "_").alias("label"))
    marked = combos.join(known.select("label").distinct().withColumn("hit", F.lit(1)), "label", "left")
    return marked.groupBy("threshold").agg(F.count("hit").alias("known"), F.count_if(F.col("hit").isNull()).alias("novel"))


def combo_rank(df: DataFrame) -> DataFrame:
    """BC-21: stronger and weaker barcode of cells with two."""
    per = df.groupBy("cell", "barcode").agg(F.count("*").alias("n"))
    w = W.partitionBy("cell")
    ranked = per.withColumn("k", F.count("*").over(w)).where("k = 2").withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "barcode")))
    return ranked.select("cell", "barcode", "n", F.when(F.col("place") == 1, "stronger").otherwise("weaker").alias("rank"))


def library_overlap(a: DataFrame, b: DataFrame, thresholds: Sequence[int] = range(6)) -> DataFrame:
    """BC-22: barcodes (barcode, n) of two libraries above each threshold: shared, only in one, Jaccard index."""
    j = a.select("barcode", F.col("n").alias("na")).join(b.select("barcode", F.col("n").alias("nb")), "barcode", "full").na.fill(0)
    at = j.select("na", "nb", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    x, y = F.col("na") > F.col("threshold"), F.col("nb") > F.col("threshold")
    return at.groupBy("threshold").agg(F.count_if(x & y).alias("shared"), F.count_if(x & ~y).alias("only_1"), F.count_if(~x & y).alias("only_2")).withColumn("jaccard", F.try_divide("shared", F.col("shared") + F.col("only_1") + F.col("only_2")))


def abundance_r2(a: DataFrame, b: DataFrame) -> DataFrame:
    """BC-23: squared correlation of abundances of shared barcodes."""
    r = stats.correlation("na", "nb")
    return a.select("barcode", F.col("n").alias("na")).join(b.select("barcode", F.col("n").alias("nb")), "barcode").agg(F.count("*").alias("n"), (r * r).alias("r2"))


def set_concordance(a: DataFrame, b: DataFrame) -> DataFrame:
    """BC-24: cells of both libraries by how their barcode sets agree: exact, partial or none."""
    sets = lambda d, name: d.groupBy("cell").agg(F.sort_array(F.collect_set("barcode")).alias(name))
    j = sets(a, "x").join(sets(b, "y"), "cell")
    return j.groupBy(F.when(F.col("x") == F.col("y"), "exact").when(F.arrays_overlap("x", "y"), "partial").otherwise("none").alias("agreement")).agg(F.count("*").alias("cells"))


def where_target(df: DataFrame, expected: str, k: int = 6, column: str = "seq") -> DataFrame:
    """BC-25: rows whose start is within k edits of an expected amplicon, with the distance."""
    return df.withColumn("distance", F.levenshtein(F.substring(column, 1, len(expected)), F.lit(expected))).where(F.col("distance") <= k)


def dual_read_filter(pairs: DataFrame, primer: str, utr: str, k: int = 4) -> DataFrame:
    """BC-26: read pairs (seq_1, seq_2, qual_2) whose second read passes primer, quality and complexity; branch by UTR or T run of read 1, which is cut after its last run of four T."""
    ok = where_quality(pairs.withColumnRenamed("qual_2", "qual"), region=(1, len(primer))).withColumnRenamed("qual", "qual_2")
    ok = where_complex(ok.where(primer_distance(F.col("seq_2"), primer, k) <= k), "seq_2")
    branch = F.when(F.col("seq_1").contains(utr), "utr").when(F.col("seq_1").rlike("T{4,}"), "poly-t").otherwise("none")
    return ok.select("read_id", branch.alias("branch"), F.regexp_replace("seq_1", "^.*T{4,}", "").alias("cut"))


def quality_motif_filter(fastq: DataFrame, motif: str, min_q: float = 10, k: int = 0) -> DataFrame:
    """BC-27: outcome of each read: low_quality (mean Phred below min_q), no_motif (nowhere within k edits) or pass."""
    codes = F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33)
    mean = F.aggregate(codes, F.lit(0), lambda a, x: a + x) / F.greatest(F.length("qual"), F.lit(1))
    n = len(motif)
    starts = F.sequence(F.lit(1), F.greatest(F.length("seq") - n + 1 + k, F.lit(1)))
    near = F.col("seq").contains(motif) if k == 0 else F.exists(starts, lambda i: F.least(*[F.levenshtein(F.substring(F.col("seq"), i, F.lit(m)), F.lit(motif)) for m in range(n - k, n + k + 1)]) <= k)
    return fastq.select("read_id", F.when(mean < min_q, "low_quality").when(~near, "no_motif").otherwise("pass").alias("outcome"))


def consensus(fastq: DataFrame, n: int) -> DataFrame:
    """BC-28: base shares and the commonest base (ties: first letter) at each of the first n places."""
    long = fastq.select(F.posexplode(F.split(F.substring("seq", 1, n), "")).alias("pos", "base")).where("base <> ''")
    counts = long.groupBy("pos", "base").agg(F.count("*").alias("k"))
    w = W.partitionBy("pos")
    return counts.select((F.col("pos") + 1).cast("bigint").alias("pos"), "base", (F.col("k") / F.sum("k").over(w)).alias("share"), (F.row_number().over(w.orderBy(F.desc("k"), "base")) == 1).alias("consensus"))


def prefix_targets(df: DataFrame, sizes: Sequence[int] = (18, 24, 30)) -> DataFrame:
    """BC-29: distinct prefixes of each length."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("size"), F.substring("seq", 1, n).alias("prefix")) for n in sizes]))).distinct()


def top_consensus(df: DataFrame) -> DataFrame:
    """BC-29: the commonest canonical sequence."""
    return df.groupBy("canonical").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "canonical").limit(1)


def downsample(fastq: DataFrame, shares: Sequence[float], seed: int) -> DataFrame:
    """BC-30: reads at several depths; a read's seeded hash decides, so mates stay together and depths are nested."""
    u = F.pmod(F.xxhash64("read_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return fastq.select("read_id", u.alias("u"), F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("depth")).where("u < depth").select("read_id", "depth")


def concat_runs(runs: Sequence[DataFrame], length: int) -> DataFrame:
    """BC-31: reads of several runs, cut to one length."""
    out = None
    for i, run in enumerate(runs):
        part = run.select("read_id", F.substring("seq", 1, length).alias("seq"), F.substring("qual", 1, length).alias("qual"), F.lit(i).alias("run"))
        out = part if out is None else out.unionByName(part)
    return out


def clone_status(cells: DataFrame, barcode: str = "barcode") -> DataFrame:
    """BC-32: size of each cell's clone and its status: none, singleton or clone."""
    size = F.when(F.col(barcode).isNotNull(), F.count(barcode).over(W.partitionBy(barcode))).otherwise(0)
    return cells.withColumn("clone_size", size).withColumn("status", F.when(F.col("clone_size") == 0, "none").when(F.col("clone_size") == 1, "singleton").otherwise("clone"))


def decode_umi(number: Column, length: int = 12) -> Column:
    """BC-33: bases of a 2-bit packed molecule, the first base in the highest bits."""
    return F.array_join(F.transform(F.sequence(F.lit(length - 1), F.lit(0)), lambda i: F.substring(F.lit(BASES), F.floor(number / F.pow(F.lit(4), i)).cast("bigint") % 4 + 1, F.lit(1))), "")
