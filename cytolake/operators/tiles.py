"""Functions of all pairs of two sets of vectors, tile by tile, reduced where they are computed.

Rows are dealt to blocks of about TILE rows by a hash of their name; a pair of blocks is a group of its own, which
turns its products or distances into a row a member or a class. So no row a pair exists, in a plan or a shuffle, a
task holds two blocks at a time, and a set of n rows is shuffled n / TILE times.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TILE = 1024
#: Numbers of a temporary array at most.
ENTRIES = 1 << 22
#: Squared distances up to this share of both squared norms are taken from differences (products leave about 12 digits of those above).
NEAR = 1e-4


def matrix(table: pa.Table, column: str = "v") -> np.ndarray:
    return np.asarray(table.column(column).combine_chunks().flatten(), dtype=np.float64).reshape(table.num_rows, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows: from their products, and by differences, some pairs at once, where those would cancel."""
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :]
    least = out * NEAR
    with np.errstate(invalid="ignore"):
        out -= 2 * (a @ b.T)
        i, j = np.nonzero(~(out > least))  # not a number, too
    step = max(1, ENTRIES // max(1, a.shape[1]))
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        out[x, y] = ((a[x] - b[y]) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


def _blocks(df: DataFrame, tile: int) -> int:
    return max(1, -(-df.count() // tile))


def cross(a: DataFrame, b: DataFrame, reduce: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile: int = TILE) -> DataFrame:
    """reduce(rows of a, rows of b) of every pair of blocks; a and b have the same columns, name among them, and no `side`, `one` or `two`."""
    na, nb = _blocks(a, tile), _blocks(b, tile)
    dealt = lambda df, side, own, n, other, m: df.select("*", F.lit(side).alias("side"), F.pmod(F.xxhash64("name"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))
    both = dealt(a, 0, "one", na, "two", nb).unionByName(dealt(b, 1, "two", nb, "one", na))

    def pair(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        return reduce(rows.take(np.flatnonzero(side == 0)), rows.take(np.flatnonzero(side == 1)))

    return both.groupBy("one", "two").applyInArrow(pair, schema)


def square(df: DataFrame, reduce: Callable[[pa.Table, pa.Table, bool], pa.Table], schema: str, groups: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """reduce(rows, rows, same) of every unordered pair of blocks of df, inside each group: same where both are one block."""
    if groups:
        sized = df.join(df.groupBy(*groups).agg(F.ceil(F.count("*") / tile).alias("blocks")), list(groups))
    else:
        sized = df.withColumn("blocks", F.lit(_blocks(df, tile)))
    own = sized.withColumn("own", F.pmod(F.xxhash64("name"), F.col("blocks"))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    both = own.select(*df.columns, F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).alias("side"))

    def pair(rows: pa.Table) -> pa.Table:
        side = np.asarray(rows.column("side").combine_chunks().to_numpy(zero_copy_only=False))
        first = rows.take(np.flatnonzero(~side))
        same = rows.column("one")[0] == rows.column("two")[0]
        return reduce(first, first if same else rows.take(np.flatnonzero(side)), same)

    return both.groupBy(*groups, "one", "two").applyInArrow(pair, schema)
