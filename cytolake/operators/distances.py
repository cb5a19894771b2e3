"""Distances between distributions with bootstrap intervals and permutation tests, on histograms.

Distinct values are numbered over range partitions and cut into blocks of neighbours. A block draws all its
replicates itself, as matrices of values by replicates: Poisson weights for the bootstrap (a value seen n times
weighs Poisson(n)), hypergeometric counts for permuted labels. Labels are dealt to the blocks first (one draw a
block and replicate) and inside a block to its values, which is the same as dealing them to all values at once.
What a block needs of the others is the sum of each replicate before it; what it gives is a row a replicate: its
largest gap, and its parts of the two sums. A block's replicates are shared by several tasks where blocks are few. So neither a cell nor a value ever becomes a row for each replicate,
and every generator is seeded by its block, so results don't depend on partitions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from cytolake.functions import stats
from cytolake.plans.staging import staged

#: Blocks at most (their sums of all replicates meet at the driver), values of a block at least.
BLOCKS, LEAST = 128, 1024
#: Tasks that share the replicates of the blocks, about.
TASKS = 256
#: Replicates of a block drawn at once, and entries of their matrix at most.
AT_ONCE, ENTRIES = 256, 1 << 21
#: Things of a kind up to which labels are dealt thing by thing (a uniform number each, far cheaper than a hypergeometric one).
SINGLY = 16
OBSERVED, BOOTSTRAP, PERMUTED, CLOSER = range(4)
METRICS = ("ks", "js", "wasserstein")
ROWS = "kind int, first int, second int, side int, rep int, gap double, js double, area double"


def generator(seed: int, kind: int, first: int, second: int, block: int, chunk: int) -> np.random.Generator:
    return np.random.default_rng([seed, kind, first, second, block + 1, chunk])


def dealt(rng: np.random.Generator, counts: np.ndarray, take: np.ndarray) -> np.ndarray:
    """Multivariate hypergeometric draws: of counts[v] things of each kind v, take[r] are taken in replicate r: (v, r)."""
    out = np.zeros((len(counts), len(take)), np.int64)
    left, need = int(counts.sum()), take.copy()
    for v, n in enumerate(counts.tolist()):
        if n > SINGLY:
            out[v] = rng.hypergeometric(n, left - n, need)
            left -= n
            need -= out[v]
            continue
        for _ in range(n):
            hit = rng.random(len(take)) * left < need
            out[v] += hit
            need -= hit
            left -= 1
    return out


def parts(width: np.ndarray, x: np.ndarray, y: np.ndarray, before_x: np.ndarray, before_y: np.ndarray, all_x: np.ndarray, all_y: np.ndarray, metrics: Sequence[str] = METRICS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest gap of the two cumulative shares, Jensen-Shannon part (base 2; NaN unless in metrics) and area between them, of a block's values in each replicate."""
    gap = np.abs((before_x + np.cumsum(x, axis=0)) / all_x - (before_y + np.cumsum(y, axis=0)) / all_y)
    if "js" not in metrics:
        return gap.max(axis=0), np.full(gap.shape[1], np.nan), (gap * width[:, None]).sum(axis=0)
    p, q = x / all_x, y / all_y
    with np.errstate(divide="ignore", invalid="ignore"):
        mid = (p + q) / 2
        js = (np.where(p > 0, p * np.log2(p / mid), 0.0) + np.where(q > 0, q * np.log2(q / mid), 0.0)).sum(axis=0) / 2
    return gap.max(axis=0), js, (gap * width[:, None]).sum(axis=0)


def _draw(kind: int, counts: np.ndarray, first: int, second: int, reference: int, rng: np.random.Generator, take: np.ndarray | None, reps: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two sides of each distance in so many replicates."""
    ref = counts[:, [reference]]
    if kind == OBSERVED:
        return [(counts[:, [first]], ref)]
    if kind == BOOTSTRAP:
        return [tuple(rng.poisson(counts[:, [c]], (len(counts), reps)) for c in (first, reference))]
    other = reference if kind == PERMUTED else second
    mine = dealt(rng, counts[:, first] + counts[:, other], take)
    rest = counts[:, [first]] + counts[:, [other]] - mine
    fixed = np.repeat(ref, len(take), axis=1)
    return [(mine, rest)] if kind == PERMUTED else [(mine, fixed), (rest, fixed)]


def replicates(df: DataFrame, value: str, group: str, names: Sequence[str], boot: int, perm: int, seed: int, pairs: bool = False, size: int | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """(kind, first, second, side, rep, ks, js, wasserstein) for all methods names[1:] against the reference names[0]; js is null unless in metrics.

    Rows of null value don't count. A method or replicate without values has null distances.
    """
    spark, k = df.sparkSession, len(names)
    hist = df.where(F.col(value).isNotNull() & F.col(group).isin(*names)).groupBy(F.col(value).cast("double").alias("v")).agg(*[F.count_if(F.col(group) == n).alias(f"c{i}") for i, n in enumerate(names)])
    placed = staged(stats.numbered(hist, "idx", "v"))
    size = size or max(LEAST, -(-placed.count() // BLOCKS))
    at_once = max(1, min(AT_ONCE, ENTRIES // size))
    placed = placed.withColumn("block", F.expr(f"idx div {size}"))
    sums = placed.groupBy("block").agg(F.min("v").alias("low"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(k)]).orderBy("block").collect()  # BLOCKS rows at most
    low = np.array([r["low"] for r in sums] + [np.nan])
    totals = np.array([[r[f"c{i}"] for i in range(k)] for r in sums], np.int64).reshape(-1, k)
    runs = [(OBSERVED, m, 0, 1) for m in range(1, k)] + [(BOOTSTRAP, m, 0, boot) for m in range(1, k) if boot] + [(PERMUTED, m, 0, perm) for m in range(1, k) if perm]
    runs += [(CLOSER, a, b, perm) for a, b in itertools.combinations(range(1, k), 2) if pairs and perm]
    taken: dict[tuple[int, int, int], np.ndarray] = {}
    for kind, a, b, reps in runs:
        if kind in (PERMUTED, CLOSER):
            both = totals[:, a] + totals[:, b if kind == CLOSER else 0]
            taken[kind, a, b] = dealt(generator(seed, kind, a, b, -1, 0), both, np.full(reps, totals[:, a].sum()))

    jobs = [(kind, a, b, at, min(at_once, reps - at)) for kind, a, b, reps in runs for at in range(0, reps, at_once)]

    def dealt_out(jobs: list[tuple]) -> tuple[GroupedData, int]:
        """The blocks, each copied to the units that share the chunks in jobs (unit u draws every units-th), a task a block and unit."""
        units = max(1, min(len(jobs), -(-TASKS // max(1, len(sums)))))
        copies = placed.select("block", "v", *columns, F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
        return copies.repartition(max(1, units * len(sums)), "block", "unit").groupBy("block", "unit"), units

    def drawn(table: pa.Table, jobs: list[tuple], units: int) -> Iterator[tuple]:
        """Every chunk of replicates of a block and unit, with the two sides of its distances."""
        block, unit = table.column("block")[0].as_py(), table.column("unit")[0].as_py()
        counts = np.column_stack([table.column(f"c{i}").to_numpy() for i in range(k)])
        for kind, a, b, at, n in jobs[unit::units]:
            take = taken[kind, a, b][block, at : at + n] if (kind, a, b) in taken else None
            yield block, kind, a, b, at, _draw(kind, counts, a, b, 0, generator(seed, kind, a, b, block, at // at_once), take, n)

    columns = [f"c{i}" for i in range(k)]
    before: dict[tuple, np.ndarray] = {}
    if len(sums) > 1:  # each block's sums of all replicates, as its neighbours need them: those of dealt labels are known, weights are drawn
        drawn_jobs = [j for j in jobs if j[0] == BOOTSTRAP]
        for kind, a, b, at, n in jobs:
            mine = taken[kind, a, b][:, at : at + n] if (kind, a, b) in taken else totals[:, [a]]
            ref = np.repeat(totals[:, [0]], mine.shape[1], axis=1)
            if kind == OBSERVED:
                sides = [(mine, ref)]
            elif kind == PERMUTED:
                sides = [(mine, totals[:, [a]] + ref - mine)]
            elif kind == CLOSER:
                sides = [(mine, ref), (totals[:, [a]] + totals[:, [b]] - mine, ref)]
            else:
                sides = []
            before |= {(kind, a, b, side, at): np.concatenate([np.zeros((1, 2, mine.shape[1]), np.int64), np.stack(xy, axis=1)]) for side, xy in enumerate(sides)}

        if drawn_jobs:
            spread, units = dealt_out(drawn_jobs)

            def block_sums(table: pa.Table) -> pa.Table:
                rows = [(block, a, at, x.sum(axis=0).tolist(), y.sum(axis=0).tolist()) for block, _, a, _, at, [(x, y)] in drawn(table.sort_by("v"), drawn_jobs, units)]
                return pa.table({n: [r[i] for r in rows] for i, n in enumerate(("block", "first", "at", "x", "y"))})

            for r in spread.applyInArrow(block_sums, "block long, first long, at long, x array<long>, y array<long>").collect():  # numbers: blocks times replicates
                before.setdefault((BOOTSTRAP, r["first"], 0, 0, r["at"]), np.zeros((len(sums) + 1, 2, len(r["x"])), np.int64))[r["block"] + 1] = [r["x"], r["y"]]
        before = {key: np.cumsum(v, axis=0) for key, v in before.items()}

    spread_all, all_units = dealt_out(jobs)

    def distances(table: pa.Table) -> pa.Table:
        table = table.sort_by("v")
        v = table.column("v").to_numpy()
        block = table.column("block")[0].as_py()
        width = np.nan_to_num(np.diff(np.r_[v, low[block + 1]]))
        out: list[tuple] = []
        for block, kind, a, b, at, sides in drawn(table, jobs, all_units):
            for side, (x, y) in enumerate(sides):
                run = before.get((kind, a, b, side, at))
                if run is None:
                    run = np.stack([np.zeros((2, x.shape[1]), np.int64), np.stack([x.sum(axis=0), y.sum(axis=0)])])
                start, all_ = run[block], run[-1].astype(float)
                all_[all_ == 0] = np.nan
                for r, row in enumerate(zip(*parts(width, x, y, start[0], start[1], all_[0], all_[1], metrics))):
                    out.append((kind, a, b, side, at + r, *(None if np.isnan(z) else float(z) for z in row)))
        types = [pa.int32()] * 5 + [pa.float64()] * 3
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=[c.split()[0] for c in ROWS.split(", ")])

    rows = spread_all.applyInArrow(distances, ROWS)
    key = ["kind", "first", "second", "side", "rep"]
    return rows.groupBy(*key).agg(F.max("gap").alias("ks"), F.sqrt(F.greatest(F.sum("js"), F.lit(0.0))).alias("js"), F.sum("area").alias("wasserstein"))


def _names(df: DataFrame, group: str, reference: str) -> list[str]:
    """The reference and all other groups, of which there are few."""
    return [reference, *sorted(r[0] for r in df.where(F.col(group).isNotNull() & (F.col(group) != reference)).select(group).distinct().collect())]


def _at_least(x: Column, observed: Column) -> Column:
    """x >= observed, sums of the same numbers in another order taken as equal."""
    return x >= observed - F.abs(observed) * 1e-12 - 1e-15


def _labels(names: Sequence[str], column: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.col(column) + 1)


def wasserstein_context(df: DataFrame, value: str, group: str, a: str, b: str, boot: int = 1000, perm: int = 1000, seed: int = 123, size: int | None = None) -> DataFrame:
    """CL-23: 1-D Wasserstein distance of group a to the reference b, its bootstrap interval and error, and the share of permutations that reach it."""
    d = staged(replicates(df, value, group, [b, a], boot, perm, seed, size=size, metrics=["wasserstein"]).select("kind", "rep", "wasserstein"))
    own = d.where(F.col("kind") == OBSERVED).select(F.col("wasserstein").alias("observed"))
    ref = df.where(F.col(group) == b).agg(F.stddev_samp(value).alias("ref_sd"), F.mean(value).alias("ref_mean"))
    rep = lambda kind, x: F.when(F.col("kind") == kind, x)
    w = F.col("wasserstein")
    out = d.crossJoin(F.broadcast(own)).groupBy("observed").agg(  # one row
        F.percentile(rep(BOOTSTRAP, w), F.lit(0.025)).alias("ci_lower"), F.percentile(rep(BOOTSTRAP, w), F.lit(0.975)).alias("ci_upper"), F.stddev_samp(rep(BOOTSTRAP, w)).alias("se"),
        F.mean(rep(PERMUTED, _at_least(w, F.col("observed")).cast("double"))).alias("p"),
    )
    return out.crossJoin(ref).select(F.col("observed").alias("wasserstein"), F.try_divide("observed", "ref_sd").alias("scaled"), "ci_lower", "ci_upper", "se", "p", "ref_sd", "ref_mean")


def methods_tested(df: DataFrame, value: str, method: str, reference: str, boot: int = 2000, perm: int = 2000, seed: int = 123, size: int | None = None) -> DataFrame:
    """CL-24: (method, metric, distance, ci_lower, ci_upper, se, p) of each method's distances to the reference."""
    names = _names(df, method, reference)
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], "method string, metric string, distance double, ci_lower double, ci_upper double, se double, p double")
    d = staged(replicates(df, value, method, names, boot, perm, seed, size=size).unpivot(["kind", "first", "rep"], list(METRICS), "metric", "d"))
    own = d.where(F.col("kind") == OBSERVED).select("first", "metric", F.col("d").alias("distance"))
    rep = lambda kind, x: F.when(F.col("kind") == kind, x)
    far = F.count_if((F.col("kind") == PERMUTED) & _at_least(F.col("d"), F.col("distance")))
    out = d.join(F.broadcast(own), ["first", "metric"]).groupBy("first", "metric", "distance").agg(
        F.percentile(rep(BOOTSTRAP, F.col("d")), F.lit(0.025)).alias("ci_lower"), F.percentile(rep(BOOTSTRAP, F.col("d")), F.lit(0.975)).alias("ci_upper"), F.stddev_samp(rep(BOOTSTRAP, F.col("d"))).alias("se"),
        ((far + 1) / (F.count_if(F.col("kind") == PERMUTED) + 1)).alias("p"),
    )
    return out.select(_labels(names, "first").alias("method"), "metric", "distance", "ci_lower", "ci_upper", "se", "p")


def closer_methods(df: DataFrame, value: str, method: str, reference: str, perm: int = 2000, seed: int = 123, size: int | None = None) -> DataFrame:
    """CL-24: (first, second, metric, difference, p, closer): which of two methods is nearer to the reference.

    The difference of both distances is held against those after permuting the two methods' labels (two-sided, +1 rule);
    below zero the first method is closer, else the second.
    """
    names = _names(df, method, reference)
    if len(names) < 3:
        return df.sparkSession.createDataFrame([], "first string, second string, metric string, difference double, p double, closer string")
    d = staged(replicates(df, value, method, names, 0, perm, seed, True, size).unpivot(["kind", "first", "second", "side", "rep"], list(METRICS), "metric", "d"))
    own = d.where(F.col("kind") == OBSERVED).select("first", "metric", "d")
    a, b = own.toDF("first", "metric", "d1"), own.toDF("second", "metric", "d2")
    pair = a.join(F.broadcast(b), "metric").where("first < second").select("first", "second", "metric", (F.col("d1") - F.col("d2")).alias("difference"))  # a row a pair of methods
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("d")))
    null = d.where(F.col("kind") == CLOSER).groupBy("first", "second", "metric", "rep").agg((side(0) - side(1)).alias("null"))
    out = null.join(F.broadcast(pair), ["first", "second", "metric"]).groupBy("first", "second", "metric", "difference").agg(((F.count_if(_at_least(F.abs("null"), F.abs("difference"))) + 1) / (F.count("*") + 1)).alias("p"))
    first, second = _labels(names, "first"), _labels(names, "second")
    return out.select(first.alias("first"), second.alias("second"), "metric", "difference", "p", F.when(F.col("difference") < 0, first).otherwise(second).alias("closer"))
