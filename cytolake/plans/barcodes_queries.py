"""BC queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cytolake.operators import barcodes as b
from cytolake.plans.fixtures import dna
from cytolake.plans.registry import operator

HAM = "list_sum([CAST(substr({a}, i, 1) <> substr({b}, i, 1) AS INT) for i in range(1, {n} + 1)])"
PRIMER = "ACGTTGCA"
LEV = "least(" + ", ".join(f"levenshtein(substr({{s}}, 1, {n}), '{PRIMER}')" for n in range(4, 13)) + ")"


@operator("BC-01", "fastq", "samples", sql=f"""WITH d AS (SELECT index_part, sample, {HAM.format(a='index_part', b='index_seq', n=8)} AS d
  FROM (SELECT DISTINCT index_part FROM fastq) JOIN samples ON length(index_part) = length(index_seq)),
m AS (SELECT index_part, min(d) AS d FROM d WHERE d <= 1 GROUP BY 1), c AS (SELECT index_part, min(sample) AS sample FROM d
  JOIN m USING (index_part, d) GROUP BY 1 HAVING count(*) = 1) SELECT read_id, index_part, sample FROM fastq LEFT JOIN c USING (index_part)""")  # fmt: skip
def _(fastq, samples):
    return b.demux(fastq, samples)


@operator("BC-02", "fastq", sql=f"SELECT read_id FROM fastq WHERE starts_with(seq, 'A') AND {LEV.format(s='substr(seq, 2)')} <= 4")
def _(fastq):
    return b.where_primer(fastq, PRIMER, 4, "A").select("read_id")


@operator("BC-03", "fastq", sql="SELECT read_id FROM fastq WHERE length(regexp_replace(substr(qual, 1, 40), '[^!-/]', '', 'g')) <= 12")
def _(fastq):
    return b.where_quality(fastq, max_low=12).select("read_id")


@operator("BC-04", "fastq", sql="SELECT read_id FROM fastq WHERE NOT regexp_matches(seq, 'AAAA|TTTT|GGGG|CCCC|NN')")
def _(fastq):
    return b.where_complex(fastq).select("read_id")


@operator("BC-05", "fastq", sql="""WITH s AS (SELECT DISTINCT substr(seq, 1, 16), substr(seq, 17, 12), substr(seq, 29, 70) FROM fastq)
  SELECT count(*) AS reads, count(DISTINCT seq) AS screened, (SELECT count(*) FROM s) AS shaved FROM fastq""")
def _(fastq):
    return b.shave_totals(fastq, b.shave(fastq))


@operator("BC-06", "fastq", sql="SELECT substr(seq, 1, 16) AS cell, substr(seq, 18, 9) AS umi, substr(seq, 29, 70) AS barcode, count(*) AS reads FROM fastq GROUP BY 1, 2, 3")
def _(fastq):
    return b.shave(fastq, umi=(18, 9))


ADAPTER = "CTACACGACGCTCTTCCGATCT"
LONG = f"""SELECT read_id, concat(substr(seq, 1, 20), CASE WHEN length(read_id) % 2 = 0 THEN '{ADAPTER}'
  ELSE '{ADAPTER[:10]}' || 'A' || '{ADAPTER[11:]}' END, substr(seq, 30, 28), 'TTTTTTATTTTT', 'GG', substr(seq, 60, 60)) AS seq, substr(seq, 30,
  28) AS tag, concat('GG', substr(seq, 60, 60)) AS rest FROM fastq"""


def _long(fastq):
    return fastq.sparkSession.sql(LONG.replace("FROM fastq", "FROM {fastq}"), fastq=fastq)


@operator("BC-07", "fastq", sql=f"WITH l AS ({LONG}) SELECT read_id, substr(tag, 1, 16) AS cell, substr(tag, 17, 12) AS umi FROM l")
def _(fastq):
    return b.extract_adapter(_long(fastq).select("read_id", "seq"), ADAPTER).where("strand = '+'").select("read_id", "cell", "umi")


CDNA = "SELECT read_id, concat(substr(seq, 1, 90), 'GGATCCTTAGCA', substr(seq, 91, 20)) AS cdna FROM fastq"


@operator("BC-08", "fastq", sql=f"WITH c AS ({CDNA}) SELECT read_id, right(substr(cdna, 1, length(cdna) - instr(reverse(cdna), reverse('GGATCCTTAGCA')) - 11), 70) AS barcode FROM c")
def _(fastq):
    cdna = fastq.sparkSession.sql(CDNA.replace("FROM fastq", "FROM {fastq}"), fastq=fastq)
    return b.extract_clone_barcode(cdna, "TGCTAAGGATCC").select("read_id", "barcode")


MUTATED = f"""SELECT concat('q', o_orderkey) AS read_id, CASE WHEN o_orderkey % 4 = 0 THEN concat(substr({dna('o_custkey % 60')}, 1, 5), CASE
  WHEN substr({dna('o_custkey % 60')}, 6, 1) = 'A' THEN 'C' ELSE 'A' END, substr({dna('o_custkey % 60')}, 7, 10))
  ELSE substr({dna('o_custkey % 60')}, 1, 16) END AS cell, 'IIIII+IIIIIIIIII' AS qual, substr({dna('o_orderkey % 90')}, 1, 4) AS umi FROM orders"""
LISTED = f"SELECT DISTINCT substr({dna('o_custkey % 60')}, 1, 16) AS cell FROM orders"


def _mutated(orders):
    run = lambda s: orders.sparkSession.sql(s.replace("FROM orders", "FROM {orders}"), orders=orders)
    return run(MUTATED), run(LISTED)


PAIR = f"""m AS ({MUTATED}), w AS ({LISTED}), near AS (SELECT m.cell AS odd, w.cell AS known, {{h}} FROM (SELECT DISTINCT cell FROM m
  WHERE cell NOT IN (SELECT cell FROM w)) m CROSS JOIN w WHERE {HAM.format(a='m.cell', b='w.cell', n=16)} = 1)"""


#: Reads of listed cells with no, one or two substitutions, at places of different quality.
SUBSTITUTED = f"""SELECT concat('q', o_orderkey) AS read_id, CASE o_orderkey % 4 WHEN 0 THEN cell WHEN 1 THEN cell
  WHEN 2 THEN concat(substr(cell, 1, 5), translate(substr(cell, 6, 1), 'ACGT', 'CGTA'), substr(cell, 7, 10))
  ELSE concat(substr(cell, 1, 5), translate(substr(cell, 6, 1), 'ACGT', 'GTAC'), substr(cell, 7, 5), translate(substr(cell, 12, 1), 'ACGT', 'TACG'), substr(cell, 13, 4)) END AS cell,
  concat('IIIII', substr('+5?I', CAST(o_orderkey % 4 + 1 AS INT), 1), 'II', substr('$)4I', CAST((o_orderkey + o_custkey) % 4 + 1 AS INT), 1), 'II', substr('#-7A', CAST(o_custkey % 4 + 1 AS INT), 1), 'IIII') AS qual
FROM (SELECT o_orderkey, o_custkey, substr({dna('o_custkey % 400')}, 1, 16) AS cell FROM orders)"""
#: Listed cells, and for a third of them one that differs in a place of its own.
TWINNED = f"""SELECT DISTINCT cell FROM (SELECT substr({dna('o_custkey % 400')}, 1, 16) AS cell FROM orders UNION ALL SELECT concat(substr({dna('o_custkey % 400')}, 1, 8),
  translate(substr({dna('o_custkey % 400')}, 9, 1), 'ACGT', 'CGTA'), substr({dna('o_custkey % 400')}, 10, 7)) AS cell FROM orders WHERE o_custkey % 3 = 0)"""


@operator("BC-09", "orders", sql=f"""WITH m AS ({SUBSTITUTED}), w AS ({TWINNED}),
p AS (SELECT w.cell AS known, count(m.cell) + 1 AS n FROM w LEFT JOIN m ON m.cell = w.cell GROUP BY 1),
near AS (SELECT o.cell, known, n FROM (SELECT DISTINCT cell FROM m WHERE cell NOT IN (SELECT cell FROM w)) o CROSS JOIN p WHERE {HAM.format(a='o.cell', b='known', n=16)} BETWEEN 1 AND 2),
s AS (SELECT read_id, known, n * list_product(list_transform(range(1, 17), lambda i: CASE WHEN cell[i] = known[i] THEN 1.0 ELSE pow(10.0, (33 - ascii(qual[i])) / 10.0) END)) AS score FROM m JOIN near USING (cell)),
t AS (SELECT read_id, arg_max(known, score) AS corrected, max(score) / sum(score) AS posterior FROM s GROUP BY 1)
  SELECT read_id, cell AS corrected, 1.0 AS posterior FROM m WHERE cell IN (SELECT cell FROM w) UNION ALL SELECT * FROM t WHERE posterior >= 0.975""")  # fmt: skip
def _(orders):
    run = lambda s: orders.sparkSession.sql(s.replace("FROM orders", "FROM {orders}"), orders=orders)
    return b.correct_cells(run(SUBSTITUTED), run(TWINNED), 16)


@operator("BC-10", "orders", sql=f"WITH {PAIR.format(h='1 AS one')} SELECT odd AS cell, min(known) AS corrected FROM near GROUP BY odd")
def _(orders):
    reads, listed = _mutated(orders)
    return b.correct_cells_h1(reads, listed, 16)


@operator("BC-11", "orders")
def _(orders):
    return b.merge_umis(_mutated(orders)[0].groupBy("cell", "umi").agg(F.count("*").alias("n")))


@operator("BC-12", "orders", sql=f"""WITH m AS ({MUTATED}), w AS ({LISTED}), c AS (SELECT cell, umi, count(*) AS n FROM m GROUP BY 1, 2)
  SELECT cell, count(*) AS umis, sum(n) AS reads FROM c WHERE n > 1 AND cell IN (SELECT cell FROM w) GROUP BY 1""")
def _(orders):
    reads, listed = _mutated(orders)
    return b.clean_counts(reads.groupBy("cell", "umi").agg(F.count("*").alias("n")), listed)


@operator("BC-13", "shaved", "valid_cells", sql="""SELECT cell, umi, barcode, substr(barcode, 1, 50) AS barcode_50, substr(barcode, 1,
  40) AS barcode_40, substr(barcode, 1, 30) AS barcode_30 FROM shaved SEMI JOIN valid_cells USING (cell)""")
def _(shaved, cells):
    return b.barcode_table(shaved, cells)


@operator("BC-14", "shaved", sql="""WITH d AS (SELECT DISTINCT barcode FROM shaved)
  SELECT levenshtein(a.barcode, b.barcode) AS distance, count(*) AS pairs, count(*) / sum(count(*)) OVER () AS share FROM d a
  JOIN d b ON a.barcode < b.barcode GROUP BY 1""")
def _(shaved):
    return b.edit_distance_histogram(shaved, "barcode")


NOISY = f"""SELECT concat(substr({dna('o_custkey % 40')}, 1, o_orderkey % 5 * 6), CASE WHEN o_orderkey % 7 = 0 THEN 'A'
  ELSE '' END, substr({dna('o_custkey % 40')}, o_orderkey % 5 * 6 + 1, 28)) AS barcode, CAST(1 AS BIGINT) AS reads FROM orders"""


def _noisy(orders):
    return orders.sparkSession.sql(NOISY.replace("FROM orders", "FROM {orders}"), orders=orders).withColumn("barcode", F.substring("barcode", 1, 28))


@operator("BC-15", "orders")
def _(orders):
    return b.cluster_barcodes(_noisy(orders), 3)


@operator("BC-16", "shaved", sql="""WITH m AS (SELECT barcode, min(barcode) OVER (PARTITION BY substr(barcode, 33, 20)) AS centre
  FROM (SELECT DISTINCT barcode FROM shaved WHERE reads > 3)), u AS (SELECT DISTINCT * FROM m)
  SELECT cell, umi, coalesce(centre, barcode) AS canonical FROM shaved LEFT JOIN u USING (barcode)""")
def _(shaved):
    first = shaved.where("reads > 3").select("barcode").distinct()
    centre = first.groupBy(F.substring("barcode", 33, 20).alias("k")).agg(F.min("barcode").alias("centre"))
    clusters = first.withColumn("k", F.substring("barcode", 33, 20)).join(centre, "k").select("barcode", "centre")
    return b.apply_canonical(shaved, clusters).select("cell", "umi", "canonical")


PER = "per AS (SELECT cell, barcode, count(DISTINCT umi) AS n FROM shaved GROUP BY 1, 2 HAVING count(DISTINCT umi) >= 3)"


@operator("BC-17", "shaved", sql=f"""WITH {PER}, c AS (SELECT cell, count(*) AS k, string_agg(barcode, '_' ORDER BY barcode) AS combo, max(n) AS top, sum(n) AS total FROM per GROUP BY 1)
SELECT cell, CASE WHEN k = 1 THEN 'single' WHEN count(*) OVER (PARTITION BY combo) > 1 THEN 'combination' WHEN top >= 0.8 * total THEN 'dominant' ELSE 'multiplet' END AS kind FROM c""")  # fmt: skip
def _(shaved):
    return b.call_singlets(shaved, 3)


LABELS = """labels AS (SELECT cell, label FROM (SELECT *, count(*) OVER (PARTITION BY label) AS cells FROM (SELECT cell, string_agg(barcode, '_'
  ORDER BY barcode) AS label, count(*) AS k FROM (SELECT cell, barcode FROM shaved GROUP BY 1, 2 HAVING count(*) > 12) GROUP BY 1
  HAVING count(*) <= 2)) WHERE k = 1 OR cells > 1)"""


@operator("BC-18", "shaved", sql=f"WITH {LABELS} SELECT * FROM labels")
def _(shaved):
    return b.assign_clones(shaved, 12)


@operator("BC-19", "shaved", sql=f"""WITH {LABELS}, p AS (SELECT DISTINCT label, unnest(string_split(label, '_')) AS part
  FROM labels), bad AS (SELECT part FROM p WHERE contains(label, '_') GROUP BY 1 HAVING count(*) > 1)
SELECT * FROM labels WHERE label NOT IN (SELECT label FROM p WHERE part IN (SELECT part FROM bad))""")  # fmt: skip
def _(shaved):
    return b.drop_promiscuous(b.assign_clones(shaved, 12), 1)


@operator("BC-20", "shaved", sql=f"""WITH {LABELS}, t(threshold) AS (VALUES (4), (8), (12)), p AS (SELECT cell, barcode, count(*) AS n FROM shaved
  GROUP BY 1, 2), c AS (SELECT threshold, string_agg(barcode, '_' ORDER BY barcode) AS label FROM p JOIN t ON n > threshold GROUP BY threshold, cell
  HAVING count(*) = 2)
SELECT threshold, count(*) FILTER (label IN (SELECT label FROM labels)) AS known, count(*) FILTER (label NOT IN (SELECT label FROM labels)) AS novel FROM c GROUP BY 1""")  # fmt: skip
def _(shaved):
    return b.rescue_sweep(shaved, [4, 8, 12], b.assign_clones(shaved, 12))


@operator("BC-21", "shaved", sql="""WITH p AS (SELECT cell, barcode, count(*) AS n, count(*) OVER (PARTITION BY cell) AS k, row_number()
  OVER (PARTITION BY cell ORDER BY count(*) DESC, barcode) AS place FROM shaved WHERE reads > 3 GROUP BY 1, 2) SELECT cell, barcode, n, CASE
  WHEN place = 1 THEN 'stronger' ELSE 'weaker' END AS rank FROM p WHERE k = 2""")
def _(shaved):
    return b.combo_rank(shaved.where("reads > 3"))


LIBS = "la AS (SELECT barcode, count(*) AS n FROM shaved WHERE sample = 's0' GROUP BY 1), lb AS (SELECT barcode, count(*) AS n FROM shaved WHERE sample = 's1' AND reads > 4 GROUP BY 1)"


def _libs(shaved):
    per = lambda d: d.groupBy("barcode").agg(F.count("*").alias("n"))
    return per(shaved.where("sample = 's0'")), per(shaved.where("sample = 's1' AND reads > 4"))


@operator("BC-22", "shaved", sql=f"""WITH {LIBS}, j AS (SELECT coalesce(la.n, 0) AS a, coalesce(lb.n, 0) AS b FROM la FULL JOIN lb USING (barcode)), t AS (SELECT unnest([0, 20, 50, 100]) AS threshold)
SELECT threshold, count(*) FILTER (a > threshold AND b > threshold) AS shared, count(*) FILTER (a > threshold
  AND b <= threshold) AS only_1, count(*) FILTER (a <= threshold AND b > threshold) AS only_2,
  CASE WHEN count(*) FILTER (a > threshold OR b > threshold) > 0 THEN count(*) FILTER (a > threshold
  AND b > threshold) / count(*) FILTER (a > threshold OR b > threshold) END AS jaccard FROM j, t GROUP BY 1""")  # fmt: skip
def _(shaved):
    return b.library_overlap(*_libs(shaved), [0, 20, 50, 100])


@operator("BC-23", "shaved", sql=f"WITH {LIBS} SELECT count(*) AS n, corr(la.n, lb.n) * corr(la.n, lb.n) AS r2 FROM la JOIN lb USING (barcode)")
def _(shaved):
    return b.abundance_r2(*_libs(shaved))


@operator("BC-24", "shaved", sql="""WITH a AS (SELECT cell, list_sort(list(DISTINCT barcode)) AS x FROM shaved WHERE reads = 1
  GROUP BY 1), b AS (SELECT cell, list_sort(list(DISTINCT barcode)) AS y FROM shaved WHERE reads IN (2, 3) GROUP BY 1)
SELECT CASE WHEN x = y THEN 'exact' WHEN list_has_any(x, y) THEN 'partial' ELSE 'none' END AS agreement, count(*) AS cells FROM a JOIN b USING (cell) GROUP BY 1""")  # fmt: skip
def _(shaved):
    return b.set_concordance(shaved.where("reads = 1"), shaved.where("reads IN (2, 3)"))


@operator("BC-25", "fastq", sql="SELECT read_id, levenshtein(substr(seq, 1, 12), 'ACGTACGTACGT') AS distance FROM fastq WHERE levenshtein(substr(seq, 1, 12), 'ACGTACGTACGT') <= 7")
def _(fastq):
    return b.where_target(fastq, "ACGTACGTACGT", 7).select("read_id", F.col("distance").cast("bigint").alias("distance"))


@operator("BC-26", "fastq", sql=f"""SELECT read_id, CASE WHEN contains(seq, 'GATTA') THEN 'utr' WHEN regexp_matches(seq, 'T{{4,}}') THEN 'poly-t'
  ELSE 'none' END AS branch, regexp_replace(seq, '^.*T{{4,}}', '') AS cut FROM fastq
WHERE length(regexp_replace(substr(qual, 1, 8), '[^!-/]', '', 'g')) <= 5 AND {LEV.format(s='reverse(seq)')} <= 4 AND NOT regexp_matches(seq, 'AAAA|TTTT|GGGG|CCCC|NN')""")  # fmt: skip
def _(fastq):
    return b.dual_read_filter(fastq.select("read_id", F.col("seq").alias("seq_1"), F.reverse("seq").alias("seq_2"), F.col("qual").alias("qual_2")), PRIMER, "GATTA")


@operator("BC-27", "fastq", sql="""SELECT read_id, CASE WHEN list_avg([ascii(c) - 33 for c in string_split(qual, '')]) < 24 THEN 'low_quality'
  WHEN NOT contains(seq, 'ACG') THEN 'no_motif' ELSE 'pass' END AS outcome FROM fastq""")
def _(fastq):
    return b.quality_motif_filter(fastq, "ACG", 24)


@operator("BC-28", "fastq", sql="""WITH l AS (SELECT CAST(pos AS BIGINT) AS pos, substr(seq, pos, 1) AS base, count(*) AS k FROM (SELECT seq, unnest(range(1, 13)) AS pos FROM fastq) GROUP BY 1, 2)
SELECT pos, base, k / sum(k) OVER (PARTITION BY pos) AS share, row_number() OVER (PARTITION BY pos ORDER BY k DESC, base) = 1 AS consensus FROM l""")  # fmt: skip
def _(fastq):
    return b.consensus(fastq, 12)


@operator("BC-29", "fastq", sql="SELECT DISTINCT size, substr(seq, 1, size) AS prefix FROM (SELECT seq, unnest([18, 24, 30]) AS size FROM fastq)")
def _(fastq):
    return b.prefix_targets(fastq)


@operator("BC-29t", "shaved", sql="SELECT barcode AS canonical, count(*) AS n FROM shaved GROUP BY 1 ORDER BY n DESC, canonical LIMIT 1")
def _(shaved):
    return b.top_consensus(shaved.withColumnRenamed("barcode", "canonical"))


@operator("BC-30", "fastq")
def _(fastq):
    return b.downsample(fastq, [0.25, 0.5, 0.75], 11)


@operator("BC-31", "fastq", sql="SELECT read_id, substr(seq, 1, 60) AS seq, substr(qual, 1, 60) AS qual, CASE WHEN read_id < 'q3' THEN 0 ELSE 1 END AS run FROM fastq")
def _(fastq):
    return b.concat_runs([fastq.where("read_id < 'q3'"), fastq.where("read_id >= 'q3'")], 60)


@operator("BC-32", "cells", sql="""SELECT cell, barcode, CASE WHEN barcode IS NULL THEN 0 ELSE count(*)
  OVER (PARTITION BY barcode) END AS clone_size, CASE WHEN barcode IS NULL THEN 'none' WHEN count(*) OVER (PARTITION BY barcode) = 1 THEN 'singleton'
  ELSE 'clone' END AS status FROM (SELECT cell, CASE WHEN signal > 0 THEN concat(clone, x) END AS barcode FROM cells)""")
def _(cells):
    return b.clone_status(cells.select("cell", F.expr("CASE WHEN signal > 0 THEN concat(clone, x) END").alias("barcode")))


@operator("BC-33", "orders", sql="""SELECT o_orderkey, array_to_string([substr('ACGT',
  CAST(o_orderkey * 977 % 16777216 >> CAST(2 * i AS INT) & 3 AS INT) + 1, 1) for i in range(11, -1, -1)], '') AS umi FROM orders""")
def _(orders):
    return orders.select("o_orderkey", b.decode_umi(F.col("o_orderkey") * 977 % 16777216).alias("umi"))
