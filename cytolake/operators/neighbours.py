"""Exact nearest neighbours by group (a gene, say) through pivots and the triangle inequality.

Up to PIVOTS targets, those of smallest hash, are pivots: an index that decides where a target is kept, never what
is found. Every target lies in the cell of its nearest pivot, in tiles of about TILE targets. A query first searches the
cell of the nearest pivot that its group has, which bounds its distance from above; then only cells whose nearest and
farthest target from the pivot leave room for something as near, and in them only targets in the ring that
|d(query, pivot) - d(target, pivot)| <= bound allows. Tiles are searched in blocks, so a group or cell of any size is
spread over tasks, and a query gives a row a tile that it visits, never a row a pair. Products of blocks estimate the
distances; only those that the estimate's rounding error leaves open are computed, from differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cytolake.plans.staging import staged

PIVOTS, TILE, BLOCK = 64, 1024, 256
#: Pairs whose distance is computed at once, and visits (rows with a vector each) that leave a task at once.
AT_ONCE, VISITS = 1 << 13, 4096
#: Queries that a task sends to their tiles, about.
ROUTED = 1024
#: Relative rounding error of a squared distance from products, for each dimension.
ROUNDING = 8 * np.finfo(float).eps
FOUND = "grp string, query string, target string, d double, compared long"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)))


def _open(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of the near pairs may be their row's least distance: squared distances from products, with a bound of their rounding error, leave these open."""
    norms = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    slack = norms * (ROUNDING * (a.shape[1] + 8))
    with np.errstate(invalid="ignore", over="ignore"):
        about = norms - 2 * (a @ b.T)
        least = np.where(near, about + slack, np.inf).min(axis=1, initial=np.inf)
        return near & ~(about - slack > least[:, None])  # not a number is open, too


def _best(names: np.ndarray, vectors: np.ndarray, ring: np.ndarray, own: tuple, bound: np.ndarray, apart: bool) -> tuple:
    """Of a block of queries: the nearest target in the tile `own` (sorted by name), and the number of targets compared."""
    near = np.abs(ring[:, None] - own[2][None, :]) <= bound[:, None] * (1 + 1e-9) + 1e-9
    if apart:
        near &= names[:, None] != own[0][None, :]
    compared = near.sum(axis=1)
    i, j = np.nonzero(_open(vectors, own[1], near))
    d = np.empty(len(i))
    for at in range(0, len(i), AT_ONCE):
        part = slice(at, at + AT_ONCE)
        d[part] = np.sqrt(((vectors[i[part]] - own[1][j[part]]) ** 2).sum(axis=1))
    order = np.lexsort((j, d, i))
    first = order[np.flatnonzero(np.r_[True, np.diff(i[order]) != 0])] if len(order) else order
    return i[first], j[first], d[first], compared[i[first]]


def _search(visits: DataFrame, apart: bool) -> DataFrame:
    """FOUND rows of visits (tile, guest, grp, name, v, ring, bound): a tile's targets come first, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, waiting = None, None, []
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                keys, guest = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (guest[1:] != guest[:-1])])
                for begin, end in zip(cuts, np.r_[cuts[1:], len(keys)]):
                    rows = b.slice(begin, end - begin)
                    names, vectors, ring = np.array(rows.column(3).to_pylist(), object), _matrix(rows.column(4)), rows.column(5).to_numpy()
                    if keys[begin] != tile:
                        tile, own, waiting = keys[begin], None, []
                    if not guest[begin]:
                        waiting.append((names, vectors, ring))
                        continue
                    if waiting:
                        own = tuple(np.concatenate(x) for x in zip(*waiting))
                        order = np.argsort(own[0])
                        own, waiting = tuple(x[order] for x in own), []
                    if own is None:
                        continue
                    i, j, d, n = _best(names, vectors, ring, own, rows.column(6).to_numpy(), apart)
                    yield pa.RecordBatch.from_arrays([rows.column(2).take(pa.array(i)), pa.array(names[i], pa.string()), pa.array(own[0][j], pa.string()), pa.array(d), pa.array(n, pa.int64())], names=["grp", "query", "target", "d", "compared"])

    return visits.repartition("tile").sortWithinPartitions("tile", "guest").mapInArrow(run, FOUND)


def nearest(queries: DataFrame, targets: DataFrame, apart: bool = False) -> DataFrame:
    """(grp, query, target, d, compared) for queries and targets (grp, name, v): the nearest target of the same group (ties: the smaller name).

    compared counts the distances computed for the query. apart: a target of the query's own name doesn't count. Queries
    whose group has no (other) target are left out. Vectors are of one length, without nulls.
    """
    chosen = targets.groupBy("name").agg(F.first("v").alias("v")).orderBy(F.xxhash64("name"), "name").limit(PIVOTS).collect()
    if not chosen:
        return queries.sparkSession.createDataFrame([], FOUND)
    pivots = np.array([r["v"] for r in chosen], np.float64)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                d = _distances(_matrix(b.column(2)), pivots)
                p = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.int32()), pa.array(d[np.arange(len(d)), p])], names=["grp", "name", "v", "pivot", "ring"])

    v = F.col("v").cast("array<double>").alias("v")
    text = [F.col(c).cast("string").alias(c) for c in ("grp", "name")]
    kept = staged(targets.select(*text, v).mapInArrow(home, "grp string, name string, v array<double>, pivot int, ring double"))
    cells = staged(kept.groupBy("grp", "pivot").agg(F.count("*").alias("n"), F.min("ring").alias("low"), F.max("ring").alias("high")))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    tile = F.concat_ws(":", "pivot", "sub", "grp").alias("tile")
    salt = F.pmod(F.xxhash64("name"), tiles).cast("int")
    own = kept.join(cells.select("grp", "pivot", "n"), ["grp", "pivot"]).withColumn("sub", salt).select(tile, F.lit(False).alias("guest"), "grp", "name", "v", "ring", F.lit(0.0).alias("bound"))

    def routed(asking: DataFrame, first: bool) -> DataFrame:
        """Visits of queries (grp, name, v, bound): to the cell of the nearest pivot that the group has, or to all others within the bound."""

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(at, BLOCK)
                    d = _distances(_matrix(b.column(2)), pivots)
                    row, to, ring = [], [], []
                    names, bound = np.array(b.column(0).to_pylist(), object), b.column(3).to_numpy() * (1 + 1e-9) + 1e-9
                    for grp in dict.fromkeys(names):
                        mine = np.flatnonzero(names == grp)
                        there = sorted(b.column(4)[int(mine[0])].as_py(), key=lambda c: c["pivot"])  # the same for all rows of a group
                        pivot, n, low, high = (np.array([c[k] for c in there]) for k in ("pivot", "n", "low", "high"))
                        away, reach = d[mine][:, pivot], bound[mine][:, None]
                        nearest = np.arange(len(there))[None, :] == away.argmin(axis=1)[:, None]
                        k, c = np.nonzero(nearest if first else ~nearest & (low - reach <= away) & (away <= high + reach))
                        for sub in range(-(-int(n.max()) // TILE)):
                            cut = n[c] > sub * TILE
                            row += mine[k[cut]].tolist()
                            to += [f"{x}:{sub}" for x in pivot[c[cut]].tolist()]
                            ring += away[k[cut], c[cut]].tolist()
                    for at_once in range(0, len(row), VISITS):
                        part = slice(at_once, at_once + VISITS)
                        taken = pa.array(row[part], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(to[part], pa.string()), *(b.column(c).take(taken) for c in (0, 1, 2)), pa.array(ring[part], pa.float64()), b.column(3).take(taken)], names=["to", "grp", "name", "v", "ring", "bound"])

        there = cells.groupBy("grp").agg(F.collect_list(F.struct("pivot", "n", "low", "high")).alias("there"))  # at most PIVOTS
        # Rows are few bytes but much work, so their number makes the tasks, not their size.
        rows = asking.select("grp", "name", "v", "bound").join(there, "grp").repartition(tasks, "grp", "name").mapInArrow(go, "to string, grp string, name string, v array<double>, ring double, bound double")
        return rows.select(F.concat_ws(":", "to", "grp").alias("tile"), F.lit(True).alias("guest"), "grp", "name", "v", "ring", "bound")

    asked = queries.select(*text, v)
    tasks = max(1, -(-asked.count() // ROUTED))
    one = staged(_search(routed(asked.withColumn("bound", F.lit(float("inf"))), True).unionByName(own), apart))
    far = one.groupBy(F.col("grp").alias("g"), F.col("query").alias("q")).agg(F.min("d").alias("bound"))
    # Where the first cell gave nothing (only the query itself, say), there is no bound yet.
    again = asked.join(far, (F.col("grp") == F.col("g")) & (F.col("name") == F.col("q")), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    two = _search(routed(again, False).unionByName(own), apart)
    both = one.unionByName(two)
    best = both.groupBy("grp", "query").agg(F.min(F.struct("d", "target")).alias("best"), F.sum("compared").alias("compared"))
    return best.select("grp", "query", "best.target", "best.d", "compared")
