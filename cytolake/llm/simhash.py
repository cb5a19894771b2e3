"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints (64 bits over XXH64 of word shingles) link at DISTANCE or fewer differing bits; components
are the connected documents. Work goes in steps, each a Spark job over all fingerprints:

1. Equal fingerprints collapse to one node, named by its smallest doc_id.
2. All nodes are sorted by Gray rank over range partitions, twice: as they are, and with their halves swapped. Of two
   linked fingerprints one half or the other differs in HALF bits at most, so it is enough that each order finds
   the pairs whose leading half does.
3. Neighbours in Gray order share bits. Each upper node keeps those that all fingerprints below it share (mask and
   pattern); leaves, partitions and the levels above both are such nodes, in one hierarchy. A fingerprint goes down from
   the top and adds up its differences in the bits that become known on the way. A whole node is dropped when
   the sum passes DISTANCE, or the leading half's sum passes HALF; nothing else decides where links are looked for.
4. The levels above the partitions (a node a partition) are searched where a fingerprint is read, which tells the later
   partitions that it visits; the levels inside a partition are searched there, by its own rows and by the
   visitors, some at once. Nodes below which all is already connected with the searching one are dropped as well.
5. A partition gives a forest of its links (one edge a row at most), never its pairs. Components by alternating
   large-star and small-star steps over the edges, cut by written tables.

Null text and text without words have fingerprint zero and link like any other. doc_id names a document:
rows that repeat a doc_id are linked through it. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.functions.graph import components
from cytolake.llm.common import free_name, materialise, text_udf

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Differing bits at most in one of two halves of linked fingerprints, and the bits of the leading half.
HALF, LEADING = DISTANCE // 2, np.uint64(0xFFFFFFFF00000000)
#: Fingerprints of a partition (its rows travel in blocks, so that is a matter of work alone), leaf width and fan-out of the index, and searches that go down at once.
ROWS, LEAF, FAN, AT_ONCE = 32_768, 8, 4, 1024


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(x) for x in zip(*(words[k:] for k in range(shingle)))]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(x, SEED) for x in shingles]), np.uint8).reshape(-1, 8)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits += np.unpackbits(hashes[at : at + 8192], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _signed(text: str | None) -> tuple[int]:
    x = fingerprint(text)
    return (x - (1 << 64) if x >> 63 else x,)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row."""
    return docs.select("doc_id", text_udf(_signed, "fp long")("text").alias("r")).select("doc_id", "r.fp")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each word in the reflected Gray order."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def _shared(bits: np.ndarray, mask: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask and pattern of each run of `width` nodes (bits, mask): what all of the run share."""
    starts = np.arange(0, len(bits), width)
    first = np.repeat(bits[starts], np.diff(np.r_[starts, len(bits)]))
    mask = np.bitwise_and.reduceat(mask & ~(bits ^ first), starts)
    return mask, bits[starts] & mask


class Hierarchy:
    """Levels of nodes (mask, pattern) in Gray order, the lowest first."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray):
        self.levels = [(mask, pattern)]
        while len(self.levels[-1][0]) > FAN:
            mask, pattern = self.levels[-1]
            self.levels.append(_shared(pattern, mask, FAN))
        #: Nodes visited so far, and those dropped by their sums and as settled.
        self.visited = self.by_sums = self.by_settled = 0

    @classmethod
    def of(cls, fps: np.ndarray) -> Hierarchy:
        """The index over fingerprints in Gray order; its lowest nodes have LEAF of them each."""
        return cls(*_shared(fps, np.full(len(fps), ~np.uint64(0)), LEAF))

    def settled(self, roots: np.ndarray) -> list[np.ndarray]:
        """Per level the root that all rows below a node have, or -1."""
        out, values, width = [], roots, LEAF
        for _ in self.levels:
            starts = np.arange(0, len(values), width)
            low, high = np.minimum.reduceat(values, starts), np.maximum.reduceat(values, starts)
            values, width = np.where(low == high, low, -1), FAN
            out.append(values)
        return out

    def descend(self, fps: np.ndarray, roots: np.ndarray | None = None, settled: list[np.ndarray] | None = None, nearest: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(search, lowest node) pairs that the sums of differences leave; with nearest only the child of least sum at each level."""
        known = np.uint64(0)
        q, up = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        total = lead = np.zeros(len(fps), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            mask, pattern = self.levels[level]
            width = FAN if level < len(self.levels) - 1 else len(mask)
            node = (up[:, None] * width + np.arange(width)).ravel()
            there = node < len(mask)
            q, node, total, lead = np.repeat(q, width)[there], node[there], np.repeat(total, width)[there], np.repeat(lead, width)[there]
            known = np.repeat(known, width)[there] if np.ndim(known) else known
            new = (fps[q] ^ pattern[node]) & mask[node] & ~known
            total, lead = total + np.bitwise_count(new), lead + np.bitwise_count(new & LEADING)
            near = (total <= DISTANCE) & (lead <= HALF)
            self.visited += len(q)
            self.by_sums += len(q) - int(near.sum())
            if settled:
                open_ = settled[level][node] != roots[q]
                self.by_settled += int((near & ~open_).sum())
                near &= open_
            q, up, total, lead = q[near], node[near], total[near], lead[near]
            if nearest and len(q):
                order = np.lexsort((total, q))
                order = order[np.r_[True, np.diff(q[order]) != 0]]
                q, up, total, lead = q[order], up[order], total[order], lead[order]
            known = mask[up]
        return q, up


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a[i] and b[i]; roots are the smallest members."""
    while len(a):
        parent = _roots(parent)
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
    return _roots(parent)


class Partition:
    """Fingerprints of a range of the Gray order under their index, and what is connected among them."""

    def __init__(self, ids: np.ndarray, fps: np.ndarray):
        order = np.argsort(gray_rank(fps))
        self.ids, self.fps = ids[order], fps[order]
        self.index, self.parent = Hierarchy.of(self.fps), np.arange(len(fps))

    def _links(self, fps: np.ndarray, roots: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
        """(search, row) of links in the leaves that the index leaves."""
        q, leaf = self.index.descend(fps, roots, self.index.settled(self.parent), **how)
        row = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
        there = row < len(self.fps)
        q, row = np.repeat(q, LEAF)[there], row[there]
        linked = np.bitwise_count(fps[q] ^ self.fps[row]) <= DISTANCE
        return q[linked], row[linked]

    def search_own(self) -> None:
        for at in range(0, len(self.fps), AT_ONCE):
            own = np.arange(at, min(at + AT_ONCE, len(self.fps)))
            q, row = self._links(self.fps[own], self.parent[own])
            self.parent = _union(self.parent, own[q], row)

    def visit(self, fps: np.ndarray) -> np.ndarray:
        """For each visitor the root of what it is connected with here, or -1; rows that share visitors get connected."""
        roots = np.full(len(fps), -2)  # of nothing here
        q, row = self._links(fps, roots, nearest=True)  # one leaf each, so that what is settled can be dropped below
        roots[q] = self.parent[row]
        found_q, found_row = self._links(fps, roots)
        q, row = np.r_[q, found_q], np.r_[row, found_row]
        n = len(self.fps)
        parent = _union(np.r_[self.parent, n + np.arange(len(fps))], n + q, row)
        self.parent = parent[:n]
        return np.where(parent[n:] < n, parent[n:], -1)

    def edges(self) -> pa.RecordBatch:
        return _edges(self.ids, self.ids[self.parent])


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    own = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], names=["a", "b"])


def _gray(fp: Column) -> Column:
    """The Gray rank as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def links(nodes: DataFrame, partitions: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes (id, fp), fp distinct, that connect what their links connect."""
    partitions = partitions or max(1, -(-nodes.count() // ROWS))
    swapped = F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32))
    return _ordered_links(nodes.select("id", "fp"), partitions).unionByName(_ordered_links(nodes.select("id", swapped.alias("fp")), partitions))


def _ordered_links(nodes: DataFrame, partitions: int) -> DataFrame:
    """The links whose leading halves differ in HALF bits at most."""
    ranked = nodes.withColumn("gray", _gray(F.col("fp"))).repartitionByRange(partitions, "gray")
    rows = materialise(ranked.select("id", "fp", F.spark_partition_id().alias("part"), "gray"), "simhash-ranked")
    ranges = rows.groupBy("part").agg(F.min("gray").alias("low"), F.bit_and("fp").alias("all"), F.bit_or("fp").alias("any")).orderBy("low").collect()  # a row a partition
    part = np.array([r["part"] for r in ranges], np.int64)
    all_, any_ = (np.array([r[c] for r in ranges], np.int64).view(np.uint64) for c in ("all", "any"))
    place = np.zeros(int(part.max()) + 1 if len(part) else 1, np.int64)
    place[part] = np.arange(len(part))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each batch a row for each partition that it has rows in, and one for each later partition that it visits: their ids and fingerprints."""
        upper = Hierarchy(~(all_ ^ any_), all_)
        for b in batches:
            ids, fps, own = (c.to_numpy() for c in b.columns)
            rows, to = [], []
            for at in range(0, len(ids), AT_ONCE):
                q, range_ = upper.descend(fps[at : at + AT_ONCE].view(np.uint64))
                later = range_ > place[own[at + q]]
                rows.append(at + q[later])
                to.append(part[range_[later]])
            for guest, row, target in ((False, np.arange(len(ids)), own), (True, *(np.concatenate(x) for x in (rows, to)))) if len(ids) else ():
                order = np.argsort(target, kind="stable")
                row, target = row[order], target[order]
                starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(row) else np.zeros(0, np.int64)
                ends = pa.array(np.r_[starts, len(row)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x[row])) for x in (ids, fps)]
                yield pa.RecordBatch.from_arrays([pa.array(target[starts], pa.int32()), pa.array(np.full(len(starts), guest)), *lists], names=["part", "guest", "ids", "fps"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by partition, its own ones first."""
        now, held, here = None, [], None

        def begin() -> Partition:
            here = Partition(*(np.concatenate(x) for x in zip(*held)))
            here.search_own()
            return here

        for b in batches:
            for k in range(b.num_rows):
                p, guest = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                ids, fps = (b.column(c)[k].values.to_numpy() for c in (2, 3))
                fps = fps.view(np.uint64)
                if p != now:
                    if held:
                        yield (here or begin()).edges()
                    now, held, here = p, [], None
                if not guest:
                    held.append((ids, fps))
                    continue
                here = here or begin()
                for at in range(0, len(ids), AT_ONCE):
                    roots = here.visit(fps[at : at + AT_ONCE])
                    yield _edges(ids[at : at + AT_ONCE][roots >= 0], here.ids[roots[roots >= 0]])
        if held:
            yield (here or begin()).edges()

    routed = rows.select("id", "fp", "part").mapInArrow(route, "part int, guest boolean, ids array<long>, fps array<long>")
    return routed.repartition(partitions, "part").sortWithinPartitions("part", "guest").mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row of docs (rows of null doc_id stay alone)."""
    own = materialise(fingerprints(docs), "simhash-fps")
    nodes = own.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"))
    # A doc_id with several fingerprints ties their nodes together.
    several = own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    nodes = materialise(nodes.withColumnRenamed("id", "smallest").select("fp", "smallest"), "simhash-nodes")
    named = nodes.select(F.col("smallest").alias("id"), "fp")
    tied = own.join(several, "doc_id", "left_semi").join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("smallest").alias("b"))
    found = components(links(named).unionByName(tied))
    node_component = nodes.join(found.withColumnRenamed("id", "smallest"), "smallest", "left").select("fp", F.coalesce("component", "smallest").alias("component_id"))
    return own.join(node_component, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("doc_id <> component_id").select("doc_id").distinct()
    key = free_name(docs, "_gone")
    gone = gone.withColumnRenamed("doc_id", key)
    return docs.join(gone, docs["doc_id"] == gone[key], "left_anti")
