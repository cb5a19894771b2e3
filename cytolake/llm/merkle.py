"""Merkle manifest of a table of documents: a persistent tree over aligned blocks, one version a tampered leaf.

Digests are lower-case hex SHA-256. A leaf is the digest of a row's fields (null: `-`, else byte count, `:`,
value). Leaves of a source ascend by doc_id (null first; equal doc_ids by their leaves); every FAN neighbours
become the digest of their digests until one is left, the source's subroot. Subroots, ascending by source (null
first, bytewise), become the root in the same way.

The tree is built by blocks of FAN**high nodes: a block starts at a multiple of its size, so all runs lie
inside it and it is hashed in one task, whatever the size of its source. The tops of a source's blocks are the
nodes of its next level of blocks, one Spark job a level. Going down again, each block gets its path: for each tree
level above it the digests left and right of its ancestor, which is all that a version needs of the nodes that
it shares. A tampered leaf copies its ancestors inside its block and goes on along the block's path to a
root of its own; nothing else of the tree is copied.

Rows of null doc_id or source are leaves like any other; a null doc_id or null text is never tampered with. Repeated rows are leaves of
their own. Null and empty text differ (`-` and `0:`). A single row is leaf, subroot and root at once, its proof
the digest of nothing. An empty table has no leaves and no root, and gives no rows. Extra columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytolake.llm.common import materialise

FAN, BLOCK_LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before string, after string>>"
REPORT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(*fields: Column) -> Column:
    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf and tampered: the leaf after tampering, null where the row isn't tampered with."""
    own = [F.col(c) for c in FIELDS]
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    tampered = F.when(cut.isNotNull() & F.contains("text", F.lit("\n")), _leaf(*own[:-1], cut))
    return docs.select("doc_id", "source", _leaf(*own).alias("leaf"), tampered.alias("tampered"))


def placed(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """rows with idx, their place in their group by the given order, and n, the group's size.

    Range partitions number their rows alone; the count of each group in earlier partitions is its offset.
    """
    order = (F.asc_nulls_first(group), *order)
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(parts.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    spans = parts.groupBy("part", F.col(group).alias("g")).agg(F.count("*").alias("k"), F.min("at").alias("first"))
    whole = W.partitionBy("g")  # one row a partition that the group reaches
    spans = spans.select(F.col("part").alias("p"), "g", (F.sum("k").over(whole.orderBy("part")) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(whole).alias("n"))
    there = (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g"))
    return parts.join(spans, there).select(*rows.columns, (F.col("at") + F.col("shift")).alias("idx"), "n")


def levels_of(nodes: list[str], n: int, high: int) -> list[list[str]]:
    """The nodes of a block of FAN**high nodes, level by level up to its top, in a tree level of n nodes in all."""
    levels = [nodes]
    while len(levels) <= high if n > FAN**high else len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[k : k + FAN])) for k in range(0, len(last), FAN)])
    return levels


def path_of(levels: list[list[str]], place: int) -> list[tuple[str, str]]:
    """The digests before and after the ancestor of node `place` in its run, for each level of its block."""
    out = []
    for nodes in levels[:-1]:
        run = place - place % FAN
        out.append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + FAN])))
        place //= FAN
    return out


def folded(start: str, path: list[tuple[str, str]]) -> list[str]:
    """The ancestors that a version copies: those of a node `start` along its path."""
    out = []
    for before, after in path:
        start = digest(before + start + after)
        out.append(start)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows by block (tree, block), of which a task holds one at a time."""
    rows = (r for b in batches for r in b.to_pylist())
    for key, block in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield key, list(block)


def _block(high: int) -> Column:
    return F.expr(f"idx div {FAN**high}")


def _by_block(nodes: DataFrame, high: int) -> DataFrame:
    return nodes.withColumn("block", _block(high)).repartition("tree", "block").sortWithinPartitions("tree", "block", "idx")


def tops(nodes: DataFrame, high: int) -> DataFrame:
    """The block tops of nodes (tree, idx, n, digest) as nodes of the next level."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _blocks(batches):
            n = rows[0]["n"]
            top = levels_of([r["digest"] for r in rows], n, high)[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": tree, "idx": block, "n": -(-n // FAN**high), "digest": top}], schema=pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))

    return _by_block(nodes.select("tree", "idx", "n", "digest"), high).mapInArrow(hashed, "tree string, idx long, n long, digest string")


def child_paths(nodes: DataFrame, above: DataFrame, high: int) -> DataFrame:
    """(tree, idx, path) of nodes (tree, idx, n, digest), where `above` has the path of each of their blocks."""

    def placed_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, _), rows in _blocks(batches):
            levels = levels_of([r["digest"] for r in rows], rows[0]["n"], high)
            out = [{"tree": tree, "idx": r["idx"], "path": [dict(zip(("before", "after"), p)) for p in path_of(levels, r["idx"] % FAN**high)] + r["path"]} for r in rows]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("tree", pa.string()), ("idx", pa.int64()), ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))]))

    return _by_block(_with_path(nodes, above, high), high).mapInArrow(placed_paths, f"tree string, idx long, path {PATH}")


def _with_path(nodes: DataFrame, above: DataFrame, high: int) -> DataFrame:
    above = above.select(F.col("tree").alias("t"), F.col("idx").alias("b"), "path")
    return nodes.join(above, (F.col("tree") == F.col("t")) & (_block(high) == F.col("b"))).drop("t", "b")


@dataclass
class Tree:
    """levels[k]: nodes (tree, idx, n, digest) of the k-th level of blocks, the last one being the trees' tops; leaf rows stay apart."""

    levels: list[DataFrame]
    high: int

    @property
    def top(self) -> DataFrame:
        return self.levels[-1]


def grown(nodes: DataFrame, high: int, tag: str) -> Tree:
    """The trees over nodes (tree, idx, n, digest): one job a level of blocks until every tree is one node.

    A tree that is a single node already stays as it is.
    """
    levels = [nodes]
    while True:
        levels.append(materialise(tops(levels[-1], high), tag))
        if levels[-1].where("n > 1").isEmpty():
            return Tree(levels, high)


def paths_down(tree: Tree, of_tops: DataFrame) -> DataFrame:
    """(tree, idx, path) of the blocks of the lowest level, given the path of each tree's top (tree, idx, path)."""
    path = of_tops
    for nodes in reversed(tree.levels[1:-1]):
        path = materialise(child_paths(nodes, path, tree.high), "merkle-paths")
    return path


#: A tree's name: the source with a mark before it, so that null differs from every text and sorts first.
def _tree_name(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def manifest(docs: DataFrame, high: int = BLOCK_LEVELS) -> DataFrame:
    """REPORT of each row: leaf, subroot, root, proof digest, and the version that tampering with the row makes.

    copied: the digests of that version's own nodes from the leaf to its root, where the row is tampered with.
    """
    rows = placed(leaves(docs), "source", F.asc_nulls_first("doc_id"), F.asc("leaf"))
    rows = materialise(rows.withColumn("tree", _tree_name(F.col("source"))).drop("source"), "merkle-leaves")
    sources = grown(rows.select("tree", "idx", "n", F.col("leaf").alias("digest")), high, "merkle-level")
    # The upper tree: its leaves are the subroots, numbered over range partitions like the documents.
    subroots = sources.top.select(F.col("tree").alias("name"), "digest").withColumn("tree", F.lit(""))
    upper = materialise(placed(subroots, "tree", F.asc("name")), "merkle-subroots")
    whole = grown(upper.select("tree", "idx", "n", "digest"), high, "merkle-root")
    no_path = whole.top.select("tree", "idx", F.array().cast(PATH).alias("path"))
    blocks = paths_down(whole, no_path)
    of_subroots = child_paths(upper.select("tree", "idx", "n", "digest"), blocks, high).select(F.col("idx").alias("i"), "path")
    named = upper.join(of_subroots, F.col("idx") == F.col("i")).select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("digest").alias("subroot"))
    named = materialise(named.crossJoin(F.broadcast(whole.top.select(F.col("digest").alias("root")))), "merkle-subroot-paths")  # one root
    block_paths = paths_down(sources, named.select("tree", "idx", "path"))
    ends = named.select(F.col("tree").alias("s"), "subroot", "root")
    block_paths = materialise(block_paths.join(ends, F.col("tree") == F.col("s")).drop("s"), "merkle-block-paths")

    def versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_()), ("copied", pa.list_(pa.string()))])
        for _, block in _blocks(batches):
            levels = levels_of([r["leaf"] for r in block], block[0]["n"], high)
            shared = [(p["before"], p["after"]) for p in block[0]["path"] or ()]
            out = []
            for r in block:
                path = path_of(levels, r["idx"] % FAN**high) + shared
                start = r["tampered"] or r["leaf"]
                own = [start, *folded(start, path)]
                out.append({"doc_id": r["doc_id"], "leaf": r["leaf"], "subroot": block[0]["subroot"], "root": block[0]["root"], "proof_sha256": digest("".join(b + a for b, a in path)), "folded_root": own[-1], "verified": own[-1] == block[0]["root"], "copied": own if r["tampered"] else None})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    # A block's path is long: it goes to the block's first row alone.
    first = rows.where(F.col("idx") % FAN**high == 0)
    first = first.withColumn("b", _block(high)).join(block_paths.select(F.col("tree").alias("t"), F.col("idx").alias("i"), "path", "subroot", "root"), (F.col("tree") == F.col("t")) & (F.col("b") == F.col("i"))).drop("t", "i", "b")
    rest = rows.where(F.col("idx") % FAN**high != 0).select("*", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"))
    return _by_block(first.unionByName(rest), high).mapInArrow(versions, REPORT)


def _sql_part(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_FIELDS_SQL = " || ".join(_sql_part(f"CAST({c} AS VARCHAR)") for c in FIELDS[:-1])

#: DuckDB's version of op13: level after level for all sources, then a walk up from every leaf.
SQL = f"""
WITH RECURSIVE crc AS (
    SELECT doc_id, xor(list_reduce(list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT), lambda c, b: list_reduce(range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT), 4294967295) AS crc
    FROM (SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR) AS s FROM documents WHERE doc_id IS NOT NULL)
), leaves AS (
    SELECT doc_id, source, sha256({_FIELDS_SQL} || {_sql_part("text")}) AS leaf,
        CASE WHEN crc % 2 = 0 AND text IS NOT NULL THEN sha256({_FIELDS_SQL} || {_sql_part("replace(text, chr(10), '')")}) END AS tampered
    FROM documents LEFT JOIN crc USING (doc_id)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM leaves
), nodes AS (
    SELECT 0 AS lvl, source, idx, leaf AS d, n FROM placed
    UNION ALL
    SELECT any_value(lvl) + 1, source, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, idx // 3
), runs AS (
    SELECT lvl, source, idx // 3 AS run, list(d ORDER BY idx) AS ds FROM nodes WHERE n > 1 GROUP BY ALL
), subroots AS (
    SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
    SELECT 0 AS lvl, idx, subroot AS d, n FROM subroots
    UNION ALL
    SELECT any_value(lvl) + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (any_value(n) + 2) // 3 FROM upper_nodes WHERE n > 1 GROUP BY idx // 3
), upper_runs AS (
    SELECT lvl, idx // 3 AS run, list(d ORDER BY idx) AS ds FROM upper_nodes WHERE n > 1 GROUP BY ALL
), walk AS (
    SELECT doc_id, source, leaf, 0 AS lvl, idx, n, coalesce(tampered, leaf) AS cur, '' AS proof FROM placed
    UNION ALL
    SELECT doc_id, w.source, leaf, w.lvl + 1, idx // 3, (n + 2) // 3, sha256(array_to_string(ds[1:idx % 3], '') || cur || array_to_string(ds[idx % 3 + 2:], '')), proof || array_to_string(ds[1:idx % 3], '') || array_to_string(ds[idx % 3 + 2:], '')
    FROM walk w JOIN runs r ON w.lvl = r.lvl AND w.source IS NOT DISTINCT FROM r.source AND w.idx // 3 = r.run WHERE n > 1
), climb AS (
    SELECT doc_id, leaf, subroot, 0 AS lvl, s.idx, s.n, cur, proof FROM walk w JOIN subroots s ON w.source IS NOT DISTINCT FROM s.source WHERE w.n = 1
    UNION ALL
    SELECT doc_id, leaf, subroot, c.lvl + 1, idx // 3, (n + 2) // 3, sha256(array_to_string(ds[1:idx % 3], '') || cur || array_to_string(ds[idx % 3 + 2:], '')), proof || array_to_string(ds[1:idx % 3], '') || array_to_string(ds[idx % 3 + 2:], '')
    FROM climb c JOIN upper_runs r ON c.lvl = r.lvl AND c.idx // 3 = r.run WHERE n > 1
)
SELECT doc_id, leaf, subroot, (SELECT d FROM upper_nodes WHERE n = 1) AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = (SELECT d FROM upper_nodes WHERE n = 1) AS verified FROM climb WHERE n = 1
"""
