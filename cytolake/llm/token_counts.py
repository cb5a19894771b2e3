"""Token counts without ids: pieces are counted once per distinct pre-token and summed by a join.

1. Every task counts its pre-tokens; the counts are added up per distinct pre-token over the corpus.
2. Each distinct pre-token is tokenised once, for its number of pieces.
3. Documents become pre-token frequencies. The FREQUENT most frequent pre-tokens (a fixed number of
   rows, so safe to broadcast) are summed at once; all others are joined to the table of step 2 by a
   shuffle. What is shuffled has no hot key, since hot pre-tokens are the frequent ones.

Special strings of the tokenizer inside a text are one token each, as its library has it by default.
Null text counts as empty. Each input row gives one result row, also when a doc_id repeats; an empty table gives
none. Texts are read whole; pre-tokens above FREQUENT_CHARS characters are never broadcast.
"""

from __future__ import annotations

import functools
import os
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from cytolake.llm.common import CHUNK, materialise

#: Pre-tokens that are broadcast at most, and the longest of them.
FREQUENT, FREQUENT_CHARS = 400_000, 64
#: Distinct pre-tokens that a task counts before it passes them on, and entries of the per-worker chunk cache.
TASK_ENTRIES, CACHE_ENTRIES, CACHE_CHARS = 500_000, 300_000, 40


class PreTokens:
    """Frequencies of the pre-tokens of a text by the split pattern, special strings taken out first."""

    def __init__(self, pattern: str, specials: tuple[str, ...]):
        self.split = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self.cache: dict[str, tuple[str, ...]] = {}

    def chunks(self, text: str) -> tuple[int, Counter]:
        """Number of special strings, and how often each independent chunk occurs."""
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            counts: Counter = Counter()
            for part in parts:
                counts.update(CHUNK.findall(part))
            return len(parts) - 1, counts
        return 0, Counter(CHUNK.findall(text))

    def of(self, chunk: str) -> tuple[str, ...]:
        # A run of letters with at most one blank before it is one pre-token, as for all patterns that CHUNK serves.
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return (chunk,)
        found = self.cache.get(chunk)
        if found is None:
            found = tuple(self.split.findall(chunk))
            if len(chunk) <= CACHE_CHARS:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[chunk] = found
        return found

    def counted(self, chunks: Counter) -> dict[str, int]:
        out: dict[str, int] = {}
        of, get = self.of, out.get
        for chunk, n in chunks.items():
            for x in of(chunk):
                out[x] = get(x, 0) + n
        return out


@functools.lru_cache(4)
def pre_tokens(pattern: str, specials: tuple[str, ...]) -> PreTokens:
    return PreTokens(pattern, specials)


@functools.lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def distinct_pre_tokens(docs: DataFrame, pattern: str, specials: tuple[str, ...]) -> DataFrame:
    """(pre_token, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = pre_tokens(pattern, specials)

        def out(chunks: Counter) -> Iterator[pa.RecordBatch]:
            counts = splitter.counted(chunks)
            keys, values = list(counts), list(counts.values())
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000], pa.string()), pa.array(values[at : at + 50_000], pa.int64())], names=["pre_token", "n"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(splitter.chunks(text or "")[1])
                if len(held) > TASK_ENTRIES:
                    yield from out(held)
                    held = Counter()
        yield from out(held)

    return docs.select("text").mapInArrow(count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("n"))


def pieces(distinct: DataFrame, path: str) -> DataFrame:
    """(pre_token, n, pieces): each distinct pre-token tokenised once."""

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from cytolake.llm.bpe import byte_characters

        model, table = tokenizer(path).model, str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        for tokens in batches:
            yield pd.Series([len(model.tokenize(x.encode().decode("latin-1").translate(table))) for x in tokens], dtype="int64")

    sizes.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return distinct.withColumn("pieces", F.pandas_udf(sizes, "long")("pre_token"))


def count_tokens(docs: DataFrame, path: str, pattern: str, specials: tuple[str, ...], limit: int, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row of docs."""
    spark = docs.sparkSession
    known = materialise(pieces(distinct_pre_tokens(docs, pattern, specials), path), "pre-tokens")
    top = known.where(F.length("pre_token") <= FREQUENT_CHARS).orderBy(F.desc("n"), "pre_token").limit(frequent).select("pre_token", "pieces").toArrow()
    at_once = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist())))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, common = pre_tokens(pattern, specials), at_once.value
        for batch in batches:
            ids, docs_, sizes, counts, rest, times = [], [], [], [], [], []
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                total, chunks = splitter.chunks(text)
                tail = []
                for token, n in splitter.counted(chunks).items():
                    size = common.get(token)
                    if size is None:
                        tail.append((token, n))
                    else:
                        total += n * size
                ids.append(row)
                docs_.append(doc_id)
                sizes.append(len(text.encode()))
                counts.append(total)
                rest.append([t for t, _ in tail])
                times.append([n for _, n in tail])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(docs_, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(rest, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))],
                names=["row_id", "doc_id", "n_bytes", "n", "rest", "times"],
            )

    schema = "row_id long, doc_id long, n_bytes long, n long, rest array<string>, times array<int>"
    split = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text").mapInArrow(frequencies, schema)
    split = materialise(split, "frequencies")
    rare = split.select("row_id", F.inline(F.arrays_zip(F.col("rest").alias("pre_token"), F.col("times").alias("times"))))
    summed = rare.join(known.select("pre_token", "pieces"), "pre_token").groupBy("row_id").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    out = split.select("row_id", "doc_id", "n_bytes", "n").join(summed, "row_id", "left")
    total = F.col("n") + F.coalesce("more", F.lit(0).cast("bigint"))
    return out.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
