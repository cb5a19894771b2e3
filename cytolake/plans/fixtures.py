"""Views of the driver's tables as reads, molecules, cells and genes, in SQL for Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")


def dna(key: str) -> str:
    """32 bases made of a key."""
    return f"translate(md5(CAST({key} AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


#: Each view may use the driver's tables and the views above it.
VIEWS: dict[str, str] = {
    "molecules": """
SELECT l_returnflag AS sample, concat('c', l_partkey % 300) AS cell, concat('u', l_orderkey % 500) AS umi,
  CASE l_linenumber WHEN 1 THEN 'US' WHEN 2 THEN 'SS' WHEN 3 THEN 'MS' WHEN 4 THEN 'any-D4' WHEN 5 THEN 'any-A7' WHEN 6 THEN 'US-SS' ELSE 'SS-MS4' END AS category,
  CAST(l_quantity AS BIGINT) AS read_count, l_linestatus AS assay
FROM lineitem""",
    "valid_cells": "SELECT DISTINCT concat('c', p_partkey % 300) AS cell FROM part WHERE p_partkey % 300 < 220",
    "corrections": "SELECT DISTINCT concat('c', o_custkey % 300) AS cell, concat('u', o_orderkey % 500) AS umi FROM orders WHERE o_orderpriority LIKE '1%'",
    "assay_a": "SELECT cell, umi, min(category) AS category FROM molecules WHERE assay = 'F' GROUP BY cell, umi",
    "assay_b": "SELECT cell, umi, min(category) AS category FROM molecules WHERE assay = 'O' GROUP BY cell, umi",
    "class_cells": """
SELECT sample AS dataset, cell, CAST(sum(CASE WHEN category = 'US' THEN 1 ELSE 0 END) AS BIGINT) AS us,
  CAST(sum(CASE WHEN category = 'SS' THEN 1 ELSE 0 END) AS BIGINT) AS ss, CAST(sum(CASE WHEN category = 'MS' AND read_count > 25 THEN 1 ELSE 0 END) AS BIGINT) AS ms
FROM molecules WHERE read_count > 20 GROUP BY sample, cell""",
    "reads": f"""
SELECT concat('r', l_orderkey) AS name, CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END AS flag, concat('chr', l_suppkey % 3) AS ref,
  CAST((l_partkey * 37 + l_orderkey * 11) % 9000 AS INT) AS pos, CAST(l_partkey % 256 AS INT) AS mapq,
  concat(20 + l_linenumber * 10, 'M', (l_orderkey * 7 + l_suppkey) % 4000 + 1, 'N', 15 + l_partkey % 60, 'M') AS cigar,
  concat({dna("l_orderkey")}, {dna("l_partkey")}, {dna("l_suppkey")}, {dna("l_orderkey + l_partkey")}, {dna("l_orderkey * 3 + 1")}, {dna("l_partkey * 5 + 2")}) AS seq,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('c', l_partkey % 300) END AS cb, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat('u', l_orderkey % 500) END AS ub,
  concat('u', l_orderkey % 500) AS ur, CAST(CASE l_orderkey % 4 WHEN 0 THEN 25 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 0 END AS INT) AS xf,
  CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE concat('g', l_partkey % 200) END AS gx, CAST(l_linenumber AS INT) AS nh, CAST(l_quantity AS INT) AS as_score,
  (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey % 10000 * 100 + l_suppkey % 100 AS file_offset
FROM lineitem""",
    "regions": """SELECT * FROM (VALUES ('D1_A1', 'chr1', 985, 5212), ('A1_D4', 'chr1', 5213, 6596), ('D4_A7', 'chr1', 6597, 8806), ('A7_LTR', 'chr2',
  8807, 9700)) AS t(target, chrom, start_pos, end_pos)""",
    "spans": """
SELECT concat('c', CAST(floor(l_orderkey / 32) AS BIGINT)) AS cell, concat('u', l_partkey % 20) AS umi,
  concat('chr', l_suppkey % 3) AS chrom, CAST((l_partkey * 37 + l_orderkey * 11) % 9000 AS INT) AS start_pos,
  CAST((l_partkey * 37 + l_orderkey * 11) % 9000 + 100 + l_orderkey % 900 AS INT) AS end_pos, CASE WHEN l_linenumber % 2 = 0 THEN '+' ELSE '-' END AS strand,
  CAST(100 + l_orderkey % 900 AS INT) AS aligned
FROM lineitem""",
    "counts": """SELECT concat('c', o_custkey) AS cell, concat('g', l_partkey % 200) AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, l_partkey % 200""",
    "cells": """
SELECT concat('c', c_custkey) AS cell, c_mktsegment AS cluster, concat('k', c_nationkey) AS clone, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS condition,
  CAST(c_custkey % 7 AS BIGINT) AS signal, CAST(c_custkey % 5 AS BIGINT) AS other, c_acctbal AS score, CAST(c_custkey % 97 AS DOUBLE) AS x, CAST(c_custkey % 89 AS DOUBLE) AS y
FROM customer""",
    "gene_sets": "SELECT DISTINCT p_brand AS gene_set, concat('g', p_partkey % 200) AS gene FROM part WHERE p_partkey % 3 = 0",
    "spectra": "SELECT concat('g', p_partkey % 200) AS gene, concat('p', p_size % 5) AS pattern, avg(p_retailprice) AS v FROM part GROUP BY p_partkey % 200, p_size % 5",
    "molecule_table": "SELECT concat('b', l_suppkey) AS cell, concat('g', l_partkey % 200) AS gene, concat('u', l_orderkey) AS umi, CAST(l_quantity AS BIGINT) AS reads FROM lineitem",
    "fastq": f"""
SELECT concat('q', o_orderkey) AS read_id, concat({dna("o_orderkey")}, {dna("o_custkey")}, {dna("o_orderkey + 7")}, {dna("o_custkey * 3")}) AS seq,
  translate(concat(md5(CAST(o_custkey AS STRING)), md5(CAST(o_orderkey AS STRING)), md5(CAST(o_custkey + 1 AS STRING)),
  md5(CAST(o_orderkey + 1 AS STRING))), '0123456789abcdef', '!%)-15:>BFIIIIII') AS qual,
  CASE WHEN o_orderkey % 9 = 0 THEN concat(substr({dna("o_custkey % 8")}, 1, 4), 'N', substr({dna("o_custkey % 8")}, 6, 3)) ELSE substr({dna("o_custkey % 8")}, 1, 8) END AS index_part
FROM orders""",
    "samples": f"SELECT concat('s', o_custkey) AS sample, substr({dna('o_custkey')}, 1, 8) AS index_seq FROM (SELECT DISTINCT o_custkey % 8 AS o_custkey FROM orders)",
    "shaved": f"""
SELECT concat('s', o_custkey % 3) AS sample, concat('c', o_custkey % 300) AS cell, concat('u', o_orderkey % 700) AS umi,
  concat({dna("o_custkey % 40 + (CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 0 END)")}, {dna("o_custkey % 40")}) AS barcode, CAST(floor(o_totalprice) AS BIGINT) % 9 AS reads
FROM orders""",
    "alignment": """SELECT DISTINCT o_orderkey % 400 AS seq_id, CAST(pos AS INT) AS pos, base
  FROM (SELECT o_orderkey, pos, substr(translate(md5(CAST(o_orderkey % 400 AS STRING)), '0123456789abcdef', 'ACGTACGTACGTACG-'), CAST(pos AS INT),
  1) AS base FROM orders CROSS JOIN (SELECT n_nationkey + 1 AS pos FROM nation UNION ALL SELECT r_regionkey + 26 AS pos FROM region))""",
    "events_psi": """
SELECT concat('g', o_custkey % 50) AS gene, concat('chr', o_custkey % 5) AS chrom, CAST(o_custkey % 50 * 100 AS INT) AS start_pos, CAST(o_custkey % 50 * 100 + 80 AS INT) AS end_pos,
  o_orderkey, concat_ws(',', CAST(o_orderkey % 100 AS STRING), 'NA', CAST(o_custkey % 100 AS STRING)) AS levels_1, concat_ws(',',
  CAST(o_custkey % 37 AS STRING), CAST(o_orderkey % 53 AS STRING), 'NA') AS levels_2,
  CAST(o_orderkey % 20 AS DOUBLE) / 100 AS fdr, CAST(o_custkey % 2 AS INT) AS condition, CAST(o_orderkey % 30 AS BIGINT) AS inclusion,
  CAST(o_custkey % 17 AS BIGINT) AS exclusion, concat('c', o_custkey) AS cell
FROM orders""",
    "spots": "SELECT concat('f', l_suppkey % 10) AS fov, concat('ch', l_linenumber % 3) AS channel, CAST(l_partkey % 500 AS INT) AS y, CAST(l_orderkey % 500 AS INT) AS x FROM lineitem",
    "positions": """SELECT l_returnflag AS sample, concat('c', l_partkey % 300) AS cell, concat('u', l_orderkey % 500) AS umi,
  CAST((l_partkey * 37 + l_orderkey * 11) % 9000 AS BIGINT) AS pos FROM lineitem""",
    "points": "SELECT concat('c', vec_id) AS cell, concat('k', vec_id % 20) AS clone, CASE WHEN vec_id % 2 = 0 THEN 'A' ELSE 'B' END AS condition, label AS cluster, embedding FROM embeddings",
}


def needed(names: tuple[str, ...]) -> list[str]:
    """The views and the views below them, in the order of VIEWS."""
    out: set[str] = set()

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            out.add(name)
            for word in set(re.findall(r"\w+", VIEWS[name])):
                if word in VIEWS and word != name:
                    add(word)

    for name in names:
        add(name)
    return [v for v in VIEWS if v in out]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or one of the driver's tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    used = [w for w in dict.fromkeys(re.findall(r"\w+", text)) if (w in VIEWS or w in TABLES) and w != name and re.search(rf"(?:FROM|JOIN)\s+{w}\b", text)]
    for w in used:
        text = re.sub(rf"\b(FROM|JOIN)(\s+){w}\b", rf"\1\2{{{w}}}", text)
    return spark.sql(text, **{w: view(spark, sf_dir, w) for w in used}) if used else spark.sql(text)


def with_views(sql: str, *names: str) -> str:
    parts = [f"{v} AS ({VIEWS[v]})" for v in needed(names)]
    sql = sql.strip()
    if sql.startswith("WITH "):
        recursive = sql.startswith("WITH RECURSIVE ")
        parts.append(sql[15 if recursive else 5 :])
        return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + sql if parts else sql
