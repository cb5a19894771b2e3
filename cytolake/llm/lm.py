"""Stupid-backoff language-model scores by relational operations.

Every distinct lower-cased word counts for itself and every bigram that the corpus holds outside the scored
document is used, also one seen once: a document never vouches for itself. Over all rows of the corpus,

    c(x)         how often word or bigram x occurs, less its occurrences in the scored row
    s(b | a)     c(a b) / c(a) if c(a b) > 0, else BACKOFF * s(b)
    s(b)         c(b) / words of the corpus; a word that no other row has counts as UNSEEN times

and the score of a row is the mean natural logarithm of s over its words, the first one by s(b). So a text that
other rows repeat scores near 0, and text of words that no other row has scores lowest.

One table holds the counts, partitioned by the hash of the word or bigram; a bigram's row also has the counts of
its words. Each row of the corpus is exploded into its distinct bigrams and words with their own frequencies,
joined to the table and summed. The sum begins with the value of each word alone where it is read, and the joined
rows add the difference that a bigram makes, so what the rest of the corpus doesn't have needs no joined row.

Broadcasts have a fixed size and change the cost only: the numbers of the `hot` most frequent words, the counts of
the `frequent` most frequent bigrams of such words (summed where they are read, so the hottest keys are never
shuffled), and a bitmap of the table's keys that keeps most bigrams seen once from the shuffle. Other words and
bigrams go by 63 bits of a hash: two of 100 million coincide with a chance of about 1 in 2,000.

Null text has no words and a null score. Each input row gives one result row, also when a doc_id repeats; ties at
the edge of the broadcasts change nothing; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cytolake.llm.common import discard, materialise

HOT, FREQUENT = 65_535, 1_000_000
BACKOFF, UNSEEN = 0.4, 0.5
#: Words that a task numbers, and words of the documents that it takes at once.
TASK_ENTRIES, BLOCK_WORDS = 500_000, 60_000
#: A bigram of hot words is both numbers in one long; other keys are negative.
WORD_BITS, SIGN = 32, -(1 << 63)
#: Bits of the bitmap of the table's keys.
BITMAP_BITS = 27


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class _Numbers(dict):
    """Places of words in `known`: hot words by their number from 1 on, others by a negative hash."""

    def __init__(self, hot: dict[int, int]):
        super().__init__()
        self.hot, self.known = hot, np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        number = (xxhash.xxh64_intdigest(word, 42) | 1 << 63) + 2 * SIGN
        self[word] = place = len(self)
        if place == len(self.known):
            self.known = np.concatenate([self.known, np.zeros(place, np.int64)])
        self.known[place] = self.hot.get(number, number)
        return place


def _keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Keys of bigrams by the numbers of their words."""
    x = first.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.view(np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xC2B2AE3D27D4EB4F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = ((x ^ (x >> np.uint64(32))) | np.uint64(1 << 63)).view(np.int64)
    return np.where((first > 0) & (second > 0), (first << WORD_BITS) | second, x)


class _Lookup:
    """Values of positive keys in arrays with open addressing; 0 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(2 * len(keys), 2).bit_length()
        self.shift, self.end = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        slot = self._slots(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.end

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        out, live, slot = np.zeros(len(keys), np.int64), np.arange(len(keys)), self._slots(keys)
        while len(live):
            there = self.keys[slot]
            hit = there == keys
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (there != 0)
            live, keys, slot = live[on], keys[on], (slot[on] + 1) & self.end
        return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(number, n) of each word over all rows, the number being its hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: Counter) -> pa.RecordBatch:
            numbers = [(xxhash.xxh64_intdigest(w, 42) | 1 << 63) + 2 * SIGN for w in held]
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(list(held.values()), pa.int64())], names=["number", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(_words(text))
                if len(held) > TASK_ENTRIES:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return docs.select("text").mapInArrow(count, "number long, n long").groupBy("number").agg(F.sum("n").alias("n"))


def bigram_counts(docs: DataFrame, hot) -> DataFrame:
    """(key, first, second, n) of each bigram over all rows; first and second are 0 if both words are hot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            places, n = np.unique(np.concatenate(held), return_counts=True)
            first, second = numbers.known[places >> WORD_BITS], numbers.known[places & ((1 << WORD_BITS) - 1)]
            keys, other = _keys(first, second), (first < 0) | (second < 0)
            columns = [keys, first * other, second * other, n]
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names=["key", "first", "second", "n"])

        numbers = _Numbers(hot.value)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text)
                ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                held.append((ids[:-1] << WORD_BITS) | ids[1:])
                size += len(ids)
                if size > 8 * TASK_ENTRIES or len(numbers) > TASK_ENTRIES:
                    yield from out()
                    numbers, held, size = _Numbers(hot.value), [], 0
        if held:
            yield from out()

    found = docs.select("text").mapInArrow(count, "key long, first long, second long, n long")
    # Tasks have counted already, so nothing is gained by counting again before the shuffle.
    return found.repartition("key").groupBy("key", "first", "second").agg(F.sum("n").alias("n"))


def _slot(key: Column) -> Column:
    """The bit of a key in the bitmap, from 1 on as the bitmap functions count."""
    return F.shiftleft(F.shiftrightunsigned(key, 32), 11).bitwiseXOR(key).bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)) + 1


def key_bitmap(table: DataFrame) -> np.ndarray:
    """The packed bitmap of the keys of table: 2**BITMAP_BITS bits, in rows of 4 KiB to the driver."""
    slots = table.select(_slot(F.col("key")).alias("slot"))
    rows = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((1 << BITMAP_BITS) // 8, np.uint8)
    for bucket, bits in rows.toLocalIterator():
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slots = ((keys.view(np.uint64) >> np.uint64(32)).view(np.int64) << 11 ^ keys) & ((1 << BITMAP_BITS) - 1)
    return (bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def _with_word(bigrams: DataFrame, word: str, top: DataFrame, others: DataFrame) -> DataFrame:
    """bigrams with the count n_`word` of one of their words: hot ones from a broadcast, others by a shuffle."""
    columns = lambda words: words.select(F.col("number").alias(word), F.col("n").alias(f"n_{word}"))
    return bigrams.where(F.col(word) > 0).join(F.broadcast(columns(top)), word).unionByName(bigrams.where(F.col(word) < 0).join(columns(others), word))


def score(docs: DataFrame, frequent: int = FREQUENT, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_bigrams and score (mean natural logarithm) of each row of docs."""
    spark = docs.sparkSession
    words = materialise(word_counts(docs), "lm-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    most = words.orderBy(F.desc("n"), "number").limit(hot).toArrow()
    hashes, counts = most.column("number").to_numpy(), np.r_[0, most.column("n").to_numpy()].astype(np.int64)
    numbers = spark.sparkContext.broadcast({int(h): k for k, h in enumerate(hashes, 1)})
    # hot + 1 rows of 16 bytes at most.
    top = spark.createDataFrame([(k, int(counts[k])) for k in range(1, len(counts))], "number long, n long")
    others = words.where(F.col("n") >= 2).join(F.broadcast(spark.createDataFrame([(int(h),) for h in hashes], "number long")), "number", "left_anti")

    # A bigram seen once is in one row alone and never counts there.
    counted = bigrams = materialise(bigram_counts(docs, numbers).where(F.col("n") >= 2), "lm-bigrams")
    of_hot = F.col("first") == 0
    common = bigrams.where(of_hot).select("key", "n").orderBy(F.desc("n"), "key").limit(frequent).toArrow().sort_by("key")
    least = int(common.column("n").to_numpy().min()) if frequent and common.num_rows == frequent else 0
    # What is surely in the broadcast needs no row.
    bigrams = bigrams.where(~of_hot | (F.col("n") <= least)) if common.num_rows else bigrams
    bigrams = bigrams.select("key", "n", F.when(of_hot, F.shiftright("key", WORD_BITS)).otherwise(F.col("first")).alias("first"), F.when(of_hot, F.col("key").bitwiseAND(F.lit((1 << WORD_BITS) - 1))).otherwise(F.col("second")).alias("second"))
    full = _with_word(_with_word(bigrams, "first", top, others), "second", top, others).select("key", "n", "n_first", "n_second")
    none = F.lit(None).cast("long")
    table = materialise(full.unionByName(others.select(F.col("number").alias("key"), "n", none.alias("n_first"), none.alias("n_second"))), "lm-table")
    discard(words)
    discard(counted)
    at_once = spark.sparkContext.broadcast((common.column("key").to_numpy().astype(np.int64), common.column("n").to_numpy().astype(np.int64), counts, key_bitmap(table)))
    log_total, log_backoff = float(np.log(max(total, 1))), float(np.log(BACKOFF))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, common_n, counts, bitmap = at_once.value
        lookup = _Lookup(common, common_n)
        names = ["row_id", "key", "own", "own_first", "own_second", "doc"]
        doc_type = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_bigrams", pa.int64()), ("log_sum", pa.float64())])
        places = _Numbers(numbers.value)

        def out(docs: list[tuple[int, int | None, list[bytes]]]) -> Iterator[pa.RecordBatch]:
            """Rows of some documents at once."""
            sizes = np.array([len(d[2]) for d in docs])
            ids = np.fromiter(map(places.__getitem__, itertools.chain.from_iterable(d[2] for d in docs)), np.int64, int(sizes.sum()))
            doc = np.repeat(np.arange(len(docs)), sizes)
            # Distinct words of each document.
            distinct, at, own = np.unique(doc * len(places) + ids, return_inverse=True, return_counts=True)
            owner, place = np.divmod(distinct, max(len(places), 1))
            number = places.known[place]
            alone = np.where(number > 0, np.log(np.maximum(counts[np.maximum(number, 0)] - own, UNSEEN)), np.log(UNSEEN))
            summed = lambda where, values: np.bincount(where, weights=values, minlength=len(docs))
            log_sums = summed(owner, alone * own) - sizes * log_total + np.maximum(sizes - 1, 0) * log_backoff
            # Distinct bigrams of each document.
            same = doc[1:] == doc[:-1]
            pairs, times = np.unique(at[:-1][same] * len(distinct) + at[1:][same], return_counts=True)
            a, b = np.divmod(pairs, max(len(distinct), 1))
            keys = _keys(number[a], number[b])
            n = lookup.get(keys)
            seen = n > times
            x, y, rest = a[seen], b[seen], n[seen] - times[seen]
            log_sums += summed(owner[x], times[seen] * (np.log(rest) - np.log(counts[number[x]] - own[x]) - log_backoff - alone[y] + log_total))
            others, few = np.flatnonzero(n == 0), np.flatnonzero(number < 0)
            keys, zeros = np.concatenate([keys[others], number[few]]), np.zeros(len(few), np.int64)
            there = _in_bitmap(bitmap, keys)
            a, b = a[others], b[others]
            rows = np.array([d[0] for d in docs], np.int64)
            columns = [rows[np.concatenate([owner[a], owner[few]])], keys, np.concatenate([times[others], own[few]]), np.concatenate([own[a], zeros]), np.concatenate([own[b], zeros])]
            part = [pa.array(c[there], t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.int32()] * 3)]
            yield pa.RecordBatch.from_arrays([*part, pa.nulls(len(part[0]), doc_type)], names=names)
            # A document's own row is dealt out by its number; what that meets in the table is not used.
            facts = [pa.array([d[1] for d in docs], pa.int64()), pa.array(sizes), pa.array(np.maximum(sizes - 1, 0)), pa.array(log_sums)]
            own_rows = pa.StructArray.from_arrays(facts, fields=list(doc_type))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(rows), *[pa.nulls(len(rows), pa.int32())] * 3, own_rows], names=names)

        held: list[tuple[int, int | None, list[bytes]]] = []
        size = 0
        for batch in batches:
            for row_id, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                held.append((row_id, doc_id, _words(text)))
                size += len(held[-1][2])
                if size > BLOCK_WORDS or len(held) >= 10_000:
                    yield from out(held)
                    held, size = [], 0
                    if len(places) > TASK_ENTRIES:
                        places = _Numbers(numbers.value)
        if held:
            yield from out(held)

    schema = "row_id long, key long, own int, own_first int, own_second int, doc struct<doc_id:long,n_words:long,n_bigrams:long,log_sum:double>"
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), "text").mapInArrow(explode, schema)
    left = lambda n, own: F.log(F.greatest(F.col(n) - F.col(own), F.lit(UNSEEN)))
    of_word = left("n", "own") - float(np.log(UNSEEN))
    of_bigram = left("n", "own") - left("n_first", "own_first") - log_backoff - left("n_second", "own_second") + log_total
    more = F.when(F.col("n") > F.col("own"), F.col("own") * F.when(F.col("n_first").isNull(), of_word).otherwise(of_bigram))
    joined = rows.join(table, "key", "left").select("row_id", "doc", F.coalesce("doc.log_sum", more).alias("part")).where("part IS NOT NULL")
    sums = joined.groupBy("row_id").agg(*[F.max(f"doc.{c}").alias(c) for c in ("doc_id", "n_words", "n_bigrams")], F.sum("part").alias("log_sum"))
    return sums.select("doc_id", "n_words", "n_bigrams", F.round(F.try_divide("log_sum", "n_words"), 6).alias("score"))
