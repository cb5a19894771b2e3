"""Statistics kernels: tail probabilities, multiple-test adjustment, ranks.

Tails are Pandas UDFs over math functions, as neither Spark nor the installed libraries have them; they
run on one row a test, after all aggregation.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _lchoose(n: float, k: float) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) if 0 <= k <= n else -math.inf


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi_square_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def hypergeometric_upper(k: int, marked: int, drawn: int, total: int) -> float:
    """P(at least k of the marked among the drawn)."""
    top = min(marked, drawn)
    logs = [_lchoose(marked, i) + _lchoose(total - marked, drawn - i) - _lchoose(total, drawn) for i in range(max(k, 0), top + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x > -math.inf))


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(at least k of n)."""
    return min(1.0, math.fsum(math.exp(_lchoose(n, i) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(max(k, 0), n + 1)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum over the tables of equal margins that are no likelier than the observed one."""
    row, col, total = a + b, a + c, a + b + c + d
    logs = [_lchoose(row, i) + _lchoose(total - row, col - i) - _lchoose(total, col) for i in range(max(0, col - (total - row)), min(row, col) + 1)]
    seen = _lchoose(row, a) + _lchoose(total - row, col - a) - _lchoose(total, col)
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= seen + 1e-7))


def tail(fn, *args: Column) -> Column:
    """A tail function of columns; null where any argument is null."""

    @F.pandas_udf("double")
    def values(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns)], dtype="float64")

    return values(*args)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson correlation as an aggregate over the rows that have both; NaN where either side is constant (F.corr divides by zero there), null without rows."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count_if(a.isNotNull() & b.isNotNull()) > 0, F.coalesce(r, F.lit(float("nan"))))


def adjust(df: DataFrame, p: str, into: str, *keys: str) -> DataFrame:
    """Benjamini-Hochberg adjusted p in each group of keys: the least p * n / rank over all larger p. Nulls stay null and don't count."""
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    rank, n = F.sum(F.when(F.col(p).isNotNull(), 1)).over(group.orderBy(F.col(p).asc_nulls_last()).rangeBetween(W.unboundedPreceding, 0)), F.count(p).over(group)
    raw = df.withColumn(into, F.when(F.col(p).isNotNull(), F.col(p) * n / rank))
    below = group.orderBy(F.col(p).desc_nulls_last()).rangeBetween(W.unboundedPreceding, 0)
    return raw.withColumn(into, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(into).over(below))))


def midrank(df: DataFrame, value: str, into: str, *keys: str) -> DataFrame:
    """Rank of value in each group of keys, ties sharing their mean rank.

    Distinct values are counted and their counts added up over range partitions of (keys, value), so a group of any
    size is spread over tasks.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_k")).withColumn("_order", F.struct(*keys, value))
    run = running(counts, "_order", "_k").select(*keys, value, "_k", "run__k")
    begins = run.groupBy(*keys).agg(F.min(F.col("run__k") - F.col("_k")).alias("_begin"))
    ranks = run.join(begins, list(keys)).select(*keys, value, (F.col("run__k") - F.col("_begin") - (F.col("_k") - 1) / 2.0).alias(into))
    return df.join(ranks, [*keys, value])


def numbered(df: DataFrame, into: str, *order: Column | str) -> DataFrame:
    """df with its rows numbered from 0 in the given order: range partitions count alone, one row each gives their offsets."""
    from cytolake.plans.staging import staged

    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = staged(sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first"))
    before = W.partitionBy(F.lit(1)).orderBy("_part")  # one row a partition
    offsets = sizes.select("_part", (F.sum("n").over(before) - F.col("n") - F.col("first")).alias("_shift"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(into, F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")


def running(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """df (one row a value) with run_<c>, the sum of column c over all rows up to each value, next_value and all_<c>.

    Rows are spread over range partitions of value. Sums of whole partitions, one row each, become their offsets, so
    no task sorts more than its range.
    """
    from cytolake.plans.staging import staged

    parts = staged(df.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.min(value).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in columns])
    order = W.partitionBy(F.lit(1)).orderBy("_part")  # one row a partition
    offsets = sums.select("_part", F.lead("_first").over(order).alias("_after"), *[x for c in columns for x in ((F.sum(f"_{c}").over(order) - F.col(f"_{c}")).alias(f"_before_{c}"), F.sum(f"_{c}").over(W.partitionBy(F.lit(1))).alias(f"all_{c}"))])
    inside = W.partitionBy("_part").orderBy(value)
    joined = parts.join(F.broadcast(offsets), "_part")
    run = [(F.sum(c).over(inside.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"_before_{c}")).alias(f"run_{c}") for c in columns]
    return joined.select(*df.columns, *run, F.coalesce(F.lead(value).over(inside), F.col("_after")).alias("next_value"), *[f"all_{c}" for c in columns])


def adjust_many(df: DataFrame, p: str, into: str) -> DataFrame:
    """adjust without keys for very many rows: ranks by `running` over distinct p, and the least value over larger p by range partitions."""
    from cytolake.plans.staging import staged

    ranked = running(df.where(F.col(p).isNotNull()).groupBy(p).agg(F.count("*").alias("k")), p, "k")
    raw = staged(ranked.select(p, (F.col(p) * F.col("all_k") / F.col("run_k")).alias("raw")).repartitionByRange(p).withColumn("_part", F.spark_partition_id()))
    later = W.partitionBy(F.lit(1)).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)  # one row a partition
    least = raw.groupBy("_part").agg(F.min("raw").alias("least")).select("_part", F.min("least").over(later).alias("later"))
    below = W.partitionBy("_part").orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    found = raw.join(F.broadcast(least), "_part").select(p, F.least(F.lit(1.0), F.min("raw").over(below), F.coalesce("later", F.lit(1.0))).alias(into))
    return df.join(found, p, "left")
