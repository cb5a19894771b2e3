"""Components and greedy clusters of graphs given as edge tables: rounds of joins, each cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytolake.plans.staging import shared_path, staged


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (a, b): the smallest id of its component, by large-star and small-star until nothing changes."""

    def canonical(e: DataFrame) -> DataFrame:
        return e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).where("a <> b").distinct()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        return both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("low"))
        joined = e.join(low, "a")
        return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))

    def marks(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = staged(canonical(edges))
    mark = marks(now)
    while mark[0]:
        now = staged(canonical(small_star(canonical(large_star(now)))))
        before, mark = mark, marks(now)
        if mark == before:
            break
    low = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return low.union(now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def greedy_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, centre) by the greedy order: by falling n (ties by id) each free node becomes a centre and takes its free neighbours.

    nodes has id and n; links (a, na, b) go from the earlier node to the later one, na being the earlier one's n. In
    each round the nodes without an earlier free neighbour are centres, and their free neighbours are taken. A round
    writes the nodes taken in it, each once, behind those of the rounds before. Links whose nodes are both left are
    found by anti-joins and written again only when at most half of them are left, so what is written grows with
    nodes and links, not with rounds. Who took a node is known at the end alone: the first of all centres beside it.
    """
    spark = nodes.sparkSession
    path = shared_path(spark, "taken")
    base = left = links.select("a", "b")
    size = count = base.count()
    taken = None
    while count:
        centres = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")), "id", "left_anti")
        found = left.join(centres.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        found.write.mode("append").parquet(path)
        taken = spark.read.schema(found.schema).parquet(path)
        left = base.join(taken.withColumnRenamed("id", "a"), "a", "left_anti").join(taken.withColumnRenamed("id", "b"), "b", "left_anti")
        count = left.count()
        if 2 * count <= size:
            base = left = staged(left)
            size = count
    if taken is None:
        return nodes.select("id", F.col("id").alias("centre"))
    beside = links.join(taken.withColumnRenamed("id", "a"), "a", "left_anti").groupBy(F.col("b").alias("id")).agg(F.min_by("a", F.struct(-F.col("na"), F.col("a"))).alias("centre"))
    return nodes.select("id").join(beside, "id", "left").select("id", F.coalesce("centre", "id").alias("centre"))
