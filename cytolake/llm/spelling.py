"""Spelling variants: words one edit apart, found by dynamic programming along a sorted vocabulary.

1. Each task counts the words of its texts before anything is shuffled. A run of letters of a document may lose a
   character first (the query's planted misspellings); the vocabulary keeps words of MIN_CHARS characters and
   MIN_COUNT occurrences.
2. The vocabulary is sorted twice over range partitions: as it is, and by reversed words. With h = half of a word's
   length, a near word has its first h characters or its last ones, so it stands in the stretch of that prefix in one of the two
   lists. A word is sent to the other ranges that this stretch reaches, unless the prefix that all words of a range
   share is already more than one edit away.
3. In a range, a word runs down its stretch with the edit matrix banded to one edit: a row holds three numbers from
   0 to 2, and the 27 rows are numbered, so a row and three comparisons give the next one (STEP). Rows of the
   prefix that a word shares with the one before it (their LCP) are used again. Where a row has no number below 2, all words with the same
   prefix are skipped through links to the next shorter LCP. All words of a block advance at once.
4. Each range gives a row a word: how many near words, and the most frequent one. Forms are followed to their
   roots by pointer doubling, in rounds of joins.

Null and empty texts have no words. A null doc_id takes no characters away. Runs of any length are words; repeated
rows count as often as they occur. Ties of n go to the smaller word in code-point order. No words give no rows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cytolake.llm.common import materialise

MIN_CHARS, MIN_COUNT, DELETE_EVERY, RATIO = 6, 5, 199, 5
#: Lower-cased texts in Latin-1, where every other character is a question mark: runs of letters that are long enough.
RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % MIN_CHARS)
#: Distinct words that a task counts before it hands them on, words of a range, and words that advance at once.
HELD, RANGE, AT_ONCE = 500_000, 200_000, 16_384
#: Edit-matrix cells of a block at most (words times the longest one's length).
CELLS = 8_000_000


def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """Occurrences of each word of a text, as Latin-1 bytes; every DELETE_EVERY-th run by hash loses a character."""
    found = Counter(RUN.findall((text or "").encode("latin-1", "replace").lower()))
    if doc_id is None:
        return found
    start, out = zlib.crc32(b"%d:" % doc_id), found
    for run in list(found):
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if h % DELETE_EVERY == 0:
            at, n = h % len(run), found[run]
            if out is found:
                out = Counter(found)
            out[run] -= n
            out[run[:at] + run[at + 1 :]] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of all words that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def row() -> pa.RecordBatch:
            kept = [(w, n) for w, n in held.items() if n and len(w) >= MIN_CHARS]
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                held.update(runs_of(doc_id, text.as_py()))
                if len(held) > HELD:
                    yield row()
                    held.clear()
        yield row()

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


#: Rows of the banded matrix: the entries left of, on and right of the diagonal, each 0, 1 or 2 for more than one edit.
ROWS = list(itertools.product(range(3), repeat=3))
EXACT = ROWS.index((1, 0, 1))
DEAD = ROWS.index((2, 2, 2))


def _next_row(row: tuple[int, int, int], same: tuple[bool, bool, bool]) -> tuple[int, int, int]:
    left = min(row[0] + (not same[0]), row[1] + 1, 2)
    mid = min(row[1] + (not same[1]), row[2] + 1, left + 1, 2)
    return left, mid, min(row[2] + (not same[2]), mid + 1, 2)


#: STEP[row, c]: the next row, where bit k of c says that the word's next character is that of the query at diagonal - 1 + k.
STEP = np.array([[ROWS.index(_next_row(row, tuple(bool(c >> k & 1) for k in range(3)))) for c in range(8)] for row in ROWS], np.uint8)
LAST = np.array(ROWS, np.int8)


def _flat(words: list[str], pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with `pad` zeros before each and after the last, the place of each word, and its length."""
    size = np.array([len(w) for w in words], np.int64)
    chars = np.frombuffer(("\0" * pad + ("\0" * pad).join(words) + "\0" * pad).encode("utf-32-le"), np.uint32)
    return chars, pad + np.r_[0, np.cumsum(size + pad)[:-1]], size


def shared_prefixes(words: list[str]) -> np.ndarray:
    """LCP of each word with the one before it, -1 at either end."""
    out = np.full(len(words) + 1, -1, np.int64)
    for k in range(1, len(words)):
        a, b = words[k - 1], words[k]
        most = min(len(a), len(b))
        i = 0
        while i < most and a[i] == b[i]:
            i += 1
        out[k] = i
    return out


def shorter_ahead(lcp: np.ndarray) -> np.ndarray:
    """For each place the next one of smaller LCP."""
    out, held = np.full(len(lcp), len(lcp) - 1, np.int64), []
    for k, x in enumerate(lcp.tolist()):
        while held and x < held[-1][1]:
            out[held.pop()[0]] = k
        held.append((k, x))
    return out


class SortedList:
    """A sorted list of distinct words that queries run down."""

    def __init__(self, words: list[str]):
        self.words = words
        self.chars, self.at, self.size = _flat(words, 1)
        self.lcp = shared_prefixes(words)
        self.ahead = shorter_ahead(self.lcp)

    def near(self, queries: list[str], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(query, word) numbers of all words one edit from a query that share its first known characters, and the rows computed."""
        low = np.array([bisect_left(self.words, q[:k]) for q, k in zip(queries, known)], np.int64)
        high = np.array([bisect_left(self.words, q[:k] + "\U0010ffff") for q, k in zip(queries, known)], np.int64)
        order = np.argsort([len(q) for q in queries], kind="stable")
        order = order[low[order] < high[order]]
        found, visited, begin = [], 0, 0
        while begin < len(order):
            end = begin + AT_ONCE
            while end > begin + 1 and (end - begin) * len(queries[order[min(end, len(order)) - 1]]) > CELLS:
                end = begin + (end - begin) // 2
            block = order[begin:end]
            q, w, n = self._run([queries[k] for k in block], known[block], low[block], high[block])
            found.append((block[q], w))
            visited += n
            begin = end
        return *(np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1)), visited

    def _run(self, queries: list[str], known: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        chars, at, size = _flat(queries, 3)  # a row may reach two characters past a query
        rows = np.zeros((len(queries), int(size.max()) + 3), np.uint8)
        q, word, depth = np.arange(len(queries)), low.copy(), known.astype(np.int64)
        rows[q, depth] = EXACT
        found_q, found_w, visited = [], [], 0
        while len(q):
            ended = depth == self.size[word]
            row = rows[q, depth]
            # At a word's end: the entry of the whole query tells whether it is one edit away.
            place = size[q] - depth + 1
            hit = ended & (place >= 0) & (place <= 2)
            hit[hit] = LAST[row[hit], place[hit]] == 1
            found_q.append(q[hit])
            found_w.append(word[hit])
            k = np.flatnonzero(~ended)
            c, p = self.chars[self.at[word[k]] + depth[k]], at[q[k]] + depth[k]
            new = STEP[row[k], (chars[p - 1] == c) + 2 * (chars[p] == c) + 4 * (chars[p + 1] == c)]
            visited += len(k)
            alive = (new != DEAD) & (depth[k] < size[q[k]] + 1)
            go = k[alive]
            depth[go] += 1
            rows[q[go], depth[go]] = new[alive]
            # Words that ended, and those whose prefix is too far: on to the next word that shares no more than the rows known.
            leave = ended
            leave[k[~alive]] = True
            j = np.flatnonzero(leave)
            to, most = word[j] + 1, depth[j]
            over = np.flatnonzero(self.lcp[to] > most)
            while len(over):
                to[over] = self.ahead[to[over]]
                over = over[self.lcp[to[over]] > most[over]]
            word[j], depth[j] = to, np.minimum(most, self.lcp[to])
            stay = word < high[q]
            if not stay.all():
                q, word, depth = q[stay], word[stay], depth[stay]
        return np.concatenate(found_q), np.concatenate(found_w), visited


def within_one(prefix: str, query: str) -> bool:
    """Whether some text that begins with prefix can be one edit from query at most, by the banded rows of the prefix."""
    row, chars = ROWS.index((2, 0, 1)), "\0\0" + query + "\0" * (len(prefix) + 3)
    for depth, c in enumerate(prefix):
        row = STEP[row, sum((chars[depth + 1 + k] == c) << k for k in range(3))]
        if row == DEAD:
            return False
    return True


def _pass(vocab: DataFrame, count: int, backwards: bool) -> DataFrame:
    """(word, n_near, best): near words of one of the two lists; of both only where the first list doesn't have them."""
    spark = vocab.sparkSession
    key = F.reverse("word") if backwards else F.col("word")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // RANGE))
    rows = vocab.select(key.alias("key"), "n").repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    rows = materialise(rows, "spelling-sorted")
    bounds = sorted((r["low"], r["high"], r["part"]) for r in rows.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())  # a row a range
    lows, highs = [b[0] for b in bounds], [b[1] for b in bounds]
    common = [a[: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))] for a, b, _ in bounds]

    def known(word: str) -> int:
        """Characters that a near word of this list shares: the first half, or all but the first half from the end."""
        return (len(word) + 1) // 2 if backwards else len(word) // 2

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to, own, keys, ns = [], [], [], []
            for word, n, part in zip(*(c.to_pylist() for c in b.columns)):
                prefix = word[: known(word)]
                k = bisect_left(highs, prefix)
                while k < len(bounds) and lows[k] < prefix + "\U0010ffff":
                    home = bounds[k][2] == part
                    if home or within_one(common[k], word):
                        to.append(bounds[k][2])
                        own.append(home)
                        keys.append(word)
                        ns.append(n)
                    k += 1
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(own, pa.bool_()), pa.array(keys, pa.string()), pa.array(ns, pa.int64())], names=["part", "own", "key", "n"])

    def search(group: pa.Table) -> pa.Table:
        """A range: its own words, sorted, and all words that are to be looked up in it."""
        group = group.sort_by("key")
        keys, own, ns = group.column("key").to_pylist(), np.array(group.column("own")), np.array(group.column("n"))
        words = [k for k, mine in zip(keys, own) if mine]
        n = ns[own]
        query, hit, _ = SortedList(words).near(keys, np.array([known(k) for k in keys], np.int64))
        if backwards:  # words that share the first half as well stand in the other list
            halves = [k[::-1][: len(k) // 2] for k in keys]
            keep = np.array([not words[w].endswith(halves[q][::-1]) for q, w in zip(query, hit)], bool)
            query, hit = query[keep], hit[keep]
        turn = (lambda w: w[::-1]) if backwards else (lambda w: w)
        best: dict[int, tuple[int, str]] = {}
        near = Counter(query.tolist())
        for q, w in zip(query.tolist(), hit.tolist()):
            mine = (-int(n[w]), turn(words[w]))
            if q not in best or mine < best[q]:
                best[q] = mine
        return pa.table({"word": pa.array([turn(keys[q]) for q in near], pa.string()), "n_near": pa.array(list(near.values()), pa.int64()), "form": pa.array([best[q][1] for q in near], pa.string()), "form_n": pa.array([-best[q][0] for q in near], pa.int64())})

    routed = rows.select("key", "n", "part").mapInArrow(route, "part int, own boolean, key string, n long")
    return routed.groupBy("part").applyInArrow(search, "word string, n_near long, form string, form_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): each word's form, that one's form, and so on to the last, by pointer doubling.

    n grows along the way, so it ends; a chain of k forms takes about log2(k) rounds.
    """
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("w"), F.col("root").alias("r")), F.col("root") == F.col("w"), "left")
        later = materialise(step.select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "spelling-roots")
        now = later.drop("moved")
        if later.where("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of each word of the vocabulary."""
    vocab = materialise(vocabulary(docs), "spelling-vocabulary")
    count = vocab.count()
    both = _pass(vocab, count, False).unionByName(_pass(vocab, count, True))
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    near = both.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    known = vocab.join(near, "word", "left").withColumn("form", F.when(F.col("best.form_n") >= RATIO * F.col("n"), F.col("best")))
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("form.form").alias("form"), F.col("form.form_n").alias("form_n")), "spelling-near")
    last = roots(known.where("form IS NOT NULL"))
    return known.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


#: DuckDB's version of op11: near words by equal strings with one character masked or left out.
SQL = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(range(8), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)
), runs AS (
    SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (
    SELECT doc_id, run, n, xor(list_reduce(list_transform(range(length(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM (SELECT *, hex(encode(doc_id || ':' || run)) AS h FROM runs WHERE length(run) >= 6), crc_table
), vocabulary AS (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5
), places AS (
    SELECT word, n, unnest(range(length(word))) AS k FROM vocabulary
), cut AS (
    SELECT word, n, word[1:k] || '*' || word[k + 2:] AS masked, word[1:k] || word[k + 2:] AS shorter FROM places
), links AS (
    SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
    UNION SELECT cut.word, v.word, v.n FROM cut JOIN vocabulary v ON cut.shorter = v.word
    UNION SELECT v.word, cut.word, cut.n FROM cut JOIN vocabulary v ON cut.shorter = v.word
), best AS (
    SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM links GROUP BY word
), known AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)
), chain AS (
    SELECT word, word AS root FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON c.root = k.word WHERE k.form IS NOT NULL
)
SELECT word, n, n_near, form, form_n, root FROM known JOIN (SELECT c.word, c.root FROM chain c JOIN known k ON c.root = k.word WHERE k.form IS NULL) USING (word)
"""
