"""Greedy clusters and near pairs: plain loops, what is written, and how many candidates there are."""

import os
import random

import pytest

from cytolake.functions import graph
from cytolake.operators import barcodes


def edits(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        row, old = [i], row
        for j, d in enumerate(y, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return row[-1]


def greedy(n, near):
    centre = {}
    for x in sorted(n, key=lambda v: (-n[v], v)):
        if x not in centre:
            centre[x] = x
            for y in near[x]:
                centre.setdefault(y, x)
    return centre


def frames(spark, n, near):
    nodes = spark.createDataFrame([(k, v) for k, v in n.items()], "id string, n long")
    links = [(a, n[a], b) for a in n for b in near[a] if (-n[a], a) < (-n[b], b)]
    return nodes, spark.createDataFrame(links, "a string, na long, b string")


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_order_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = {f"v{i:03}": rng.randint(1, 9) for i in range(120)}
    near = {v: set() for v in n}
    for _ in range(200):
        a, b = rng.sample(sorted(n), 2)
        near[a].add(b)
        near[b].add(a)
    assert dict(map(tuple, graph.greedy_clusters(*frames(spark, n, near)).collect())) == greedy(n, near)


def test_a_chain_writes_each_node_once(spark, tmp_path, monkeypatch):
    """A chain of falling counts takes a round for every second node; taken nodes are still written once, links about twice."""
    n = {f"v{i:03}": 1000 - i for i in range(41)}
    names = sorted(n)
    near = {v: {names[j] for j in (i - 1, i + 1) if 0 <= j < len(names)} for i, v in enumerate(names)}
    folders, rows = [], []
    monkeypatch.setattr(graph, "shared_path", lambda spark, tag: folders.append(str(tmp_path / tag)) or "file://" + folders[-1])
    staged = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: rows.append(df.count()) or staged(df))
    got = dict(map(tuple, graph.greedy_clusters(*frames(spark, n, near)).collect()))
    assert got == greedy(n, near)
    assert spark.read.parquet(folders[0]).count() == 20 and len(os.listdir(folders[0])) > 10 and sum(rows) <= 41


def test_no_links(spark):
    nodes, links = frames(spark, {"a": 1, "b": 2}, {"a": set(), "b": set()})
    assert {tuple(r) for r in graph.greedy_clusters(nodes, links).collect()} == {("a", "a"), ("b", "b")}


@pytest.mark.parametrize("distance", [1, 2, 4, 8])
def test_no_near_pair_is_missed(spark, distance):
    rng = random.Random(distance)
    texts = {"", "A"}
    for _ in range(25):
        base = "".join(rng.choice("ACGT") for _ in range(rng.choice([3, 8, 9, 10, 20, 30])))
        texts.add(base)
        for _ in range(4):
            t = list(base)
            for _ in range(rng.randint(1, distance + 1)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.choice([0, 1])] = rng.choice(["", "A", "C", "GT"])
            texts.add("".join(t))
    got = {tuple(r) for r in barcodes.near_candidates(spark.createDataFrame([(t,) for t in texts], "value string"), distance).collect()}
    want = {(a, b) for a in texts for b in texts if a != b and (len(a), a) < (len(b), b) and edits(a, b) <= distance}
    assert want <= got and all((len(a), a) < (len(b), b) for a, b in got)


def test_a_short_text_makes_no_candidates_for_long_ones(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGT") for _ in range(50)) for _ in range(400)]
    count = lambda t: barcodes.near_candidates(spark.createDataFrame([(x,) for x in t], "value string"), 8).count()
    assert count([*texts, "ACGTACGT"]) == count(texts) < 399 * 200 / 8
