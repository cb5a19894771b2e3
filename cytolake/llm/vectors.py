"""Embedding near-duplicates: int8 tile products with error bounds, full precision where the bound can't decide.

1. Equal vectors collapse to one node with a weight (their rows). Vectors that are null, empty, zero or hold null
   or non-finite components link with nothing and stay alone.
2. Nodes are dealt to cells of a tree of median splits, fitted on at most SAMPLE nodes (an index: it only decides
   where a node is kept). Large cells are cut into tiles of about TILE nodes by a hash, so one cell may hold any
   share of the nodes. A node visits every tile that its distance to the tile's cell still allows for a
   cosine of the threshold; of two tiles one visits the other, chosen so that the work is even.
3. A tile holds its nodes as int8 components and a scale, with the norm of each vector's rounding error. Visitors
   come in blocks: products of int8 components (exact sums), then for each candidate the bound
   |u.v - q.p| <= r_u |p| + |q| r_v + r_u r_v. Pairs above the threshold by more than it are links, pairs that may
   be above are computed again in double precision, all others are none.
4. A block gives the number of links of each node (weights summed) and a forest of edges that connects what its
   links connect, never its pairs. Components are rounds of joins.

Vectors of different lengths never link. Each row is a vector of its own: rows that repeat a vec_id count as others,
and what they link with is that of their vectors. Rows of null vec_id link and count like any other, but name no
component; theirs is null and they aren't kept. Extra columns don't count. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.functions.graph import components
from cytolake.llm.common import materialise

THRESHOLD = 0.95
#: Nodes of a tile; sampled nodes and leaves of the splits at most, and sampled nodes of a leaf at least.
TILE, SAMPLE, CELLS, LEAST = 2048, 65_536, 4096, 8
#: Rows compared with a tile at once.
BLOCK = 512
#: Candidate pairs computed again at once.
AT_ONCE = 65_536
#: What sums in single precision and roots may add to a bound.
SLACK = 4e-6


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, by their largest component first (no overflow)."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantised:
    """Unit vectors as int8 components times a scale each, with the norms of the rounded vectors and of their errors."""

    def __init__(self, units: np.ndarray):
        self.units = units
        self.scale = np.abs(units).max(axis=1) / 127
        self.parts = np.rint(units / self.scale[:, None]).astype(np.int8)
        rounded = self.parts * self.scale[:, None]
        self.norm = np.sqrt((rounded * rounded).sum(axis=1)) * (1 + 1e-12)
        error = units - rounded
        self.error = np.sqrt((error * error).sum(axis=1)) * (1 + 1e-12)

    def products(self, other: Quantised) -> np.ndarray:
        """Dot products of all rounded vectors: sums of int8 products are exact in single precision up to 1,000 components at once."""
        out = np.zeros((len(self.parts), len(other.parts)), np.float32)
        for at in range(0, self.parts.shape[1], 1000):
            a, b = (x.parts[:, at : at + 1000].astype(np.float32) for x in (self, other))
            out += a @ b.T
        out *= self.scale[:, None].astype(np.float32)
        out *= other.scale[None, :].astype(np.float32)
        return out

    def bound(self, other: Quantised, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.error[i] * other.norm[j] + self.norm[i] * other.error[j] + self.error[i] * other.error[j] + SLACK


def linked(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers (in a, in b) of all pairs of cosine >= threshold, and how many pairs needed full precision."""
    rough = a.products(b)
    most = a.error.max() * b.norm.max() + a.norm.max() * b.error.max() + a.error.max() * b.error.max() + SLACK
    flat = np.flatnonzero(rough.ravel() >= np.float32(threshold - most - SLACK))
    i, j = np.divmod(flat, rough.shape[1])
    rough, bound = rough.ravel()[flat].astype(np.float64), a.bound(b, i, j)
    yes = rough - bound >= threshold
    open_ = np.flatnonzero(~yes & (rough + bound >= threshold))
    for at in range(0, len(open_), AT_ONCE):
        k = open_[at : at + AT_ONCE]
        yes[k] = np.einsum("ij,ij->i", a.units[i[k]], b.units[j[k]]) >= threshold
    return i[yes], j[yes], len(open_)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The root (smallest member) of each of n nodes after joining all a[i] and b[i]."""
    parent = np.arange(n)
    # One edge of each node first: it joins most of what there is.
    few = np.unique(np.r_[np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]])
    for x, y in ((a[few], b[few]), (a, b)):
        while len(x):
            low, high = np.minimum(parent[x], parent[y]), np.maximum(parent[x], parent[y])
            differ = low != high
            x, y = x[differ], y[differ]
            np.minimum.at(parent, high[differ], low[differ])
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return parent


class Splits:
    """Cells by median splits of the widest components; each knows the intervals that its splits leave it."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.rules: list[tuple[int, float, int, int]] = []  # component, threshold, next rule or -1 - cell on either side
        self.bounds: list[dict[int, tuple[float, float]]] = []  # of each cell: component -> interval
        self._grow(sample, cells, {})

    def _grow(self, sample: np.ndarray, cells: int, inside: dict[int, tuple[float, float]]) -> int:
        wide = int(np.argmax(sample.max(axis=0) - sample.min(axis=0))) if len(sample) else 0
        cut = float(np.median(sample[:, wide])) if len(sample) else 0.0
        left = sample[:, wide] < cut if len(sample) else np.zeros(0, bool)
        if cells < 2 or len(sample) < 2 * LEAST or not left.any():
            self.bounds.append(inside)
            return -len(self.bounds)
        at = len(self.rules)
        self.rules.append((wide, cut, 0, 0))
        low, high = inside.get(wide, (-np.inf, np.inf))
        small = self._grow(sample[left], cells // 2, inside | {wide: (low, cut)})
        large = self._grow(sample[~left], cells - cells // 2, inside | {wide: (cut, high)})
        self.rules[at] = (wide, cut, small, large)
        return at

    def cell_of(self, units: np.ndarray) -> np.ndarray:
        at = np.full(len(units), 0 if self.rules else -1)
        while (at >= 0).any():
            k = np.flatnonzero(at >= 0)
            wide, cut, small, large = (np.array(x) for x in zip(*self.rules))
            r = at[k]
            at[k] = np.where(units[k, wide[r]] < cut[r], small[r], large[r])
        return -1 - at

    def near(self, units: np.ndarray, most: float) -> np.ndarray:
        """Whether each vector's squared distance to each cell is `most` or less: (vectors, cells)."""
        out = np.empty((len(units), len(self.bounds)), bool)
        for c, inside in enumerate(self.bounds):
            far = np.zeros(len(units))
            for wide, (low, high) in inside.items():
                x = units[:, wide]
                far += np.maximum(0, np.maximum(low - x, x - high)) ** 2
            out[:, c] = far <= most
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _valid(vector: Column) -> Column:
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, fits) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _work(nodes: DataFrame, count: int, threshold: float) -> DataFrame:
    """(node, links, root): links found for a node in a block, and the node that the block connects it with (null if none)."""
    most_cells = min(CELLS, -(-count // TILE))
    sample = nodes.select("vector").orderBy(F.xxhash64("node"), "node").limit(SAMPLE // CELLS * most_cells).toPandas()["vector"]
    splits = Splits(unit_rows(np.array(sample.tolist())), most_cells)
    most = 2 - 2 * threshold + 1e-9  # squared distance of unit vectors
    element = nodes.schema["vector"].dataType.elementType

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(splits.cell_of(unit_rows(_matrix(b.column(0)))), pa.int64())], names=["cell"])

    sizes = {r["cell"]: r["count"] for r in nodes.select("vector").mapInArrow(cells, "cell long").groupBy("cell").count().collect()}
    per_cell = np.array([-(-sizes.get(c, 0) // TILE) for c in range(len(splits.bounds))])
    first = np.r_[0, np.cumsum(per_cell)]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for a node's own tile (visits false) and one for each tile that it visits."""
        for whole in batches:
            for at in range(0, whole.num_rows, TILE):
                b = whole.slice(at, TILE)
                node, units = b.column(0).to_numpy(), unit_rows(_matrix(b.column(2)))
                cell = splits.cell_of(units)
                salt = (node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = first[cell] + (salt % per_cell[cell].astype(np.uint64)).astype(np.int64)
                tile = np.arange(first[-1])
                goes = np.repeat(splits.near(units, most), per_cell, axis=1)
                goes &= ((own[:, None] < tile) == ((own[:, None] + tile) % 2 == 0)) & (own[:, None] != tile)
                row, to = np.nonzero(goes)
                row, to, guest = np.r_[np.arange(len(node)), row], np.r_[own, to], np.r_[np.zeros(len(node), bool), np.ones(len(row), bool)]
                for k in range(0, len(row), 8 * TILE):
                    part = slice(k, k + 8 * TILE)
                    moved = b.take(pa.array(row[part]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[part]), pa.array(guest[part]), *moved.columns], names=["tile", "guest", "node", "weight", "vector"])

    def found(own: tuple, guest: tuple | None) -> pa.RecordBatch:
        """Links and forest of a tile with itself, or with a block of visitors."""
        node, weight, at = own
        i, j, _ = linked(at, (guest or own)[2], threshold)
        if guest:
            node, weight = np.r_[node, guest[0]], np.r_[weight, guest[1]]
            j = j + len(own[0])
        else:
            i, j = i[i < j], j[i < j]
        links = np.bincount(i, weight[j], len(node)) + np.bincount(j, weight[i], len(node))
        root = forest(len(node), i, j)
        seen = np.flatnonzero(links > 0)
        to = node[root[seen]]
        return pa.RecordBatch.from_arrays([pa.array(node[seen]), pa.array(links[seen].astype(np.int64)), pa.array(to, mask=to == node[seen])], names=["node", "links", "root"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by tile, its own ones first."""
        own, tile = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                tiles, guests = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.r_[True, (tiles[1:] != tiles[:-1]) | (guests[1:] != guests[:-1])])
                for begin, end in zip(cuts, np.r_[cuts[1:], len(tiles)]):
                    rows = b.slice(begin, end - begin)
                    block = (rows.column(2).to_numpy(), rows.column(3).to_numpy(), Quantised(unit_rows(_matrix(rows.column(4)))))
                    if tiles[begin] != tile:
                        own, tile = None, tiles[begin]
                    if own:
                        yield found(own, block)
                    if not guests[begin]:
                        yield found(block, None)
                        own = (np.r_[own[0], block[0]], np.r_[own[1], block[1]], Quantised(np.r_[own[2].units, block[2].units])) if own else block

    schema = f"tile long, guest boolean, node long, weight long, vector array<{element.simpleString()}>"
    routed = nodes.select("node", "weight", "vector").mapInArrow(visits, schema)
    parts = int(max(1, min(first[-1], 100_000)))
    return routed.repartition(parts, "tile").sortWithinPartitions("tile", "guest").mapInArrow(search, "node long, links long, root long")


def near_duplicates(table: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of table."""
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), _valid(F.col(vector)).alias("valid"))
    # -0.0 and 0.0 are equal to the eye and to the cosine; grouping takes them as one as well.
    nodes = rows.where("valid").groupBy("vector").agg(F.count("*").alias("weight"), F.min("vec_id").alias("smallest"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors-nodes")
    work = None
    for r in nodes.groupBy(F.size("vector").alias("d")).count().collect():  # one row a length of vectors
        part = _work(nodes.where(F.size("vector") == r["d"]), r["count"], threshold)
        work = part if work is None else work.unionByName(part)
    if work is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    work = materialise(work, "vectors-work")
    links = work.groupBy("node").agg(F.sum("links").alias("links"))
    member = components(work.where("root IS NOT NULL").select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    known = nodes.join(links, "node", "left").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = known.groupBy("component").agg(F.min("smallest").alias("component_id"))
    known = known.join(named, "component").select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = ~F.col("valid")
    out = rows.join(known, F.col("valid") & (F.col("vector") == F.col("v")), "left")
    out = out.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: DuckDB's version of op12: all pairs, then everything within reach.
SQL = """
WITH RECURSIVE finite AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (
    SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS size FROM finite
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_inner_product(a.v, b.v) / (a.size * b.size) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), named AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN named USING (vec_id)
"""
