"""Token ids in rANS files: a static range asymmetric numeral system over one shared frequency table.

File format (a folder): `table` holds the quantised frequencies of all ids (they sum to 2**PRECISION),
`blocks` one row a block in ascending order of its first document. A block holds whole documents, and
its payload is, little-endian: magic, ids, lanes, segment length in steps, words, crc32 of the ids as
unsigned 32-bit integers; then for each segment its word offset, crc32 and the lanes' 64-bit states (the
checkpoint where decoding can begin); then the 32-bit words. Id i belongs to lane i % lanes, step i // lanes.
Blocks and segments decode without one another, so readers split anywhere.

Null text counts as empty (the end id alone). Rows are ordered by doc_id (null first), then by their ids as
bytes; repeated rows stay. Texts of any length are one document of a block. No documents give no blocks.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cytolake.llm.bpe import byte_characters
from cytolake.llm.common import SPACE, materialise, new_path

PRECISION, LOW = 20, 1 << 31
LANES, SEGMENT_STEPS, BLOCK_IDS = 1024, 128, 262_144
MAGIC = b"rANS"
LEAST = -(1 << 63)
HEADER, SEGMENT = struct.Struct("<4sIIIII"), struct.Struct("<II")
#: Entries of the per-worker caches of chunks and words, and the longest entry.
CACHE_ENTRIES, CACHE_CHARS = 1_000_000, 40

IDS = "part long, seq long, start long, doc_ids array<long>, lengths array<long>, ids binary, counts binary"
BLOCKS = "part long, seq long, first long, doc_ids array<long>, lengths array<long>, payload binary"
REPORT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**PRECISION, at least 1 where the count isn't 0."""
    total, room = int(counts.sum()), 1 << PRECISION
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, np.maximum(counts * room // total, 1), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    at = 0
    while (spare := room - int(freq.sum())) != 0:
        k = order[at % len(order)]
        step = spare if spare > 0 else max(spare, 1 - int(freq[k])) if freq[k] > 1 else 0
        freq[k] += step if spare > 0 else max(step, -max(1, int(freq[k]) // 8))
        at += 1
    return freq


class Codec:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.low = np.r_[0, np.cumsum(freq)[:-1]].astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq).astype(np.uint32)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = min(LANES, max(1, n))
        steps = -(-n // lanes)
        x = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        count = 0
        freq, low = self.freq[ids], self.low[ids]
        limit = freq << np.uint64(63 - PRECISION)
        for step in range(steps - 1, -1, -1):
            a, b = step * lanes, min(n, (step + 1) * lanes)
            y, f = x[: b - a], freq[a:b]
            full = y >= limit[a:b]
            if full.any():
                out = y[full].astype(np.uint32)
                words.append(out)
                count += len(out)
                y = np.where(full, y >> np.uint64(32), y)
            q = y // f
            x[: b - a] = (q << np.uint64(PRECISION)) + (y - q * f) + low[a:b]
            if step % SEGMENT_STEPS == 0:
                marks.append((count, x.copy()))
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        head = [HEADER.pack(MAGIC, n, lanes, SEGMENT_STEPS, count, crc)]
        for k, (at, states) in enumerate(reversed(marks)):
            part = ids[k * SEGMENT_STEPS * lanes : (k + 1) * SEGMENT_STEPS * lanes]
            head.append(SEGMENT.pack(count - at, zlib.crc32(part.astype("<u4").tobytes())) + states.astype("<u8").tobytes())
        return b"".join([*head, *(w.astype("<u4").tobytes() for w in reversed(words))])

    def segments(self, payload: bytes) -> int:
        _, n, lanes, every, _, _ = HEADER.unpack_from(payload)
        return -(-n // (lanes * every))

    def decode_segment(self, payload: bytes, k: int) -> np.ndarray:
        """The ids of segment k alone, checked against its checksum."""
        magic, n, lanes, every, count, _ = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a rANS block")
        size = SEGMENT.size + 8 * lanes
        parts = -(-n // (lanes * every))
        at = HEADER.size + k * size
        offset, crc = SEGMENT.unpack_from(payload, at)
        x = np.frombuffer(payload, "<u8", lanes, at + SEGMENT.size).copy()
        words = np.frombuffer(payload, "<u4", count, HEADER.size + parts * size)
        first, last = k * every * lanes, min(n, (k + 1) * every * lanes)
        out = np.empty(last - first, np.uint32)
        bottom = np.uint64((1 << PRECISION) - 1)
        for a in range(0, last - first, lanes):
            b = min(a + lanes, last - first)
            y = x[: b - a]
            slot = y & bottom
            s = self.symbol[slot]
            out[a:b] = s
            y = self.freq[s] * (y >> np.uint64(PRECISION)) + slot - self.low[s]
            need = np.flatnonzero(y < LOW)
            if len(need):
                y[need] = (y[need] << np.uint64(32)) | words[offset : offset + len(need)]
                offset += len(need)
            x[: b - a] = y
        if zlib.crc32(out.astype("<u4").tobytes()) != crc:
            raise ValueError(f"segment {k} fails its checksum")
        return out

    def decode(self, payload: bytes) -> np.ndarray:
        parts = [self.decode_segment(payload, k) for k in range(self.segments(payload))]
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != HEADER.unpack_from(payload)[5]:
            raise ValueError("block fails its checksum")
        return ids


#: The start of special tokens, controls that Python takes for white space, and a letter whose lower case depends on its place.
ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "Σ")
_CHUNK = re.compile(f"[^{SPACE}]+")


class WordEncoder:
    """Ids by the tokenizers library, cached by chunk (between white space) and by word (the library's pre-tokens)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # The library's model without its own small cache; the caches here replace it.
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.model = BPE(model["vocab"], merges, cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        self.map = str.maketrans({chr(b): c for b, c in enumerate(byte_characters())})
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.assigned: set[str] = set()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _assigned(self, text: str) -> bool:
        """Whether Python's Unicode tables hold every character; of others the library may know more (case, letters)."""
        new = {*text} - self.assigned
        if any(unicodedata.category(c) == "Cn" for c in new):
            return False
        self.assigned |= new
        return True

    def _parts(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk; most are letters alone, or with one mark at the end, and need no pattern."""
        if chunk.isalpha():
            return [chunk]
        if chunk and chunk[-1] in ".,;:?" and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split.findall(chunk)

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of lower-cased chunks by their words."""
        words, tokenize, out = self.words, self.model.tokenize, {}
        for chunk in chunks:
            parts = []
            for w in self._parts(chunk):
                ids = words.get(w)
                if ids is None:
                    # What the library does with a pre-token: bytes to characters (0x21 to 0x7e stay), then its BPE model.
                    mapped = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.map)
                    ids = words[w] = array("I", [t.id for t in tokenize(mapped)]).tobytes()
                parts.append(ids)
            out[chunk] = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(words) > CACHE_ENTRIES:
            words.clear()
        return out

    def encode(self, text: str) -> bytes:
        """Ids as packed unsigned 32-bit integers. Chunks are independent: white space never joins the parts of a token."""
        lower = text.lower()
        # Lower-case keys are enough where the library's normaliser does nothing else and both know all characters.
        plain = not any(x in text for x in ODD) and (text.isascii() or self._assigned(text) and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower))
        if not plain:
            return b"".join(self._encoded(_CHUNK.findall(text)))
        chunks, cache = lower.split(), self.chunks
        found = list(map(cache.get, chunks))
        if None in found:
            if len(cache) > CACHE_ENTRIES:
                cache.clear()
            learned = self._learn(list({c for c, x in zip(chunks, found) if x is None}))
            cache.update((c, x) for c, x in learned.items() if len(c) <= CACHE_CHARS)
            found = [learned[c] if x is None else x for c, x in zip(chunks, found)]
        return b"".join(found)


@functools.lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _pack(ids: bytes) -> bytes:
    """The bytes of each significance apart, then zstd: only for the working copy."""
    import zstandard

    planes = np.frombuffer(ids, np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).reshape(-1).view("<u4")


def token_ids(docs: DataFrame, path: str, vocabulary: int, end_id: int, partitions: int) -> DataFrame:
    """IDS rows in ascending order of doc_id: `part` numbers the range partition, `start` counts the ids before the row in it.

    Texts are encoded where they are read, and only the ids are shuffled. The range bounds are quantiles of doc_id
    alone. The last row of a part holds the counts of its ids, so nobody has to decode them again to count.
    """
    wide = vocabulary > 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(path), struct.pack("<I", end_id)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                doc_ids, texts = batch.column(0)[at : at + 512], batch.column(1)[at : at + 512]
                # A null doc_id comes first.
                part = np.searchsorted(bounds, pc.fill_null(doc_ids, LEAST).to_numpy(zero_copy_only=False))
                ids = [x + end if wide else np.frombuffer(x + end, "<u4").astype("<u2").tobytes() for x in (encoder.encode(t or "") for t in texts.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), doc_ids, pa.array(ids, pa.binary())], names=["part", "doc_id", "ids"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = np.zeros(vocabulary, np.int64)
        seq = start = held = 0
        doc_ids: list[int] = []
        lengths: list[int] = []
        parts: list[bytes] = []
        waiting: list | None = None

        def row(values: list, counts: bytes | None) -> pa.RecordBatch:
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 2
            names = [x.split()[0] for x in IDS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*values, counts], types)], names=names)

        def block() -> list:
            ids = np.frombuffer(b"".join(parts), "<u4" if wide else "<u2")
            total[:] += np.bincount(ids, minlength=vocabulary)
            return [part, seq, start, doc_ids, lengths, _pack(ids.astype("<u4").tobytes())]

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc_ids.append(doc_id)
                lengths.append(len(ids) // (4 if wide else 2))
                parts.append(ids)
                held += lengths[-1]
                if held >= BLOCK_IDS:
                    if waiting:
                        yield row(waiting, None)
                    waiting = block()
                    seq, start, held = seq + 1, start + held, 0
                    doc_ids, lengths, parts = [], [], []
        if doc_ids:
            if waiting:
                yield row(waiting, None)
            waiting = block()
        if waiting:
            yield row(waiting, _pack(total.tobytes()))

    shares = [k / partitions for k in range(1, partitions)]
    found = docs.agg(F.percentile_approx("doc_id", F.lit(shares), 20 * partitions)).first()[0] if shares else None
    bounds = np.unique(np.array(found or [], np.int64))  # fewer than partitions
    encoded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "part int, doc_id long, ids binary")
    ordered = encoded.repartitionById(partitions, "part").sortWithinPartitions("doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(blocks, IDS)


def frequencies(ids: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows; the result is bounded by the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += _unpack(data.as_py()).view("<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for i, n in ids.where("counts IS NOT NULL").select("counts").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).toLocalIterator():
        counts[i] = n
    return counts


def write(docs: DataFrame, path: str, tokenizer: str, vocabulary: int, end_id: int, partitions: int) -> None:
    """Encodes all texts and writes the folder `path` in the file format of this module."""
    spark = docs.sparkSession
    ids = materialise(token_ids(docs, tokenizer, vocabulary, end_id, partitions), "rans-ids", compression="none")
    freq = quantise(frequencies(ids, vocabulary))
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    # Ids before each range partition; one row a partition.
    totals = ids.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before = dict(zip((r[0] for r in totals), np.r_[0, np.cumsum([r[1] for r in totals])[:-1]].tolist() if totals else []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(freq)
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        for batch in batches:
            for at in range(batch.num_rows):
                part, seq, start, doc_ids, lengths, data = (c[at : at + 1] for c in batch.columns)
                first = before[part[0].as_py()] + start[0].as_py()
                payload = codec.encode(_unpack(data[0].as_py()))
                yield pa.RecordBatch.from_arrays([part, seq, pa.array([first], pa.int64()), doc_ids, lengths, pa.array([payload], pa.binary())], names=names)

    ids.drop("counts").mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str, vocabulary: int) -> np.ndarray:
    freq = np.zeros(vocabulary, np.int64)
    for i, n in spark.read.parquet(f"{path}/table").collect():  # no more rows than ids
        freq[i] = n
    return freq


def read(spark: SparkSession, path: str, vocabulary: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the blocks alone."""
    freq = read_table(spark, path, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(freq)
        for batch in batches:
            for first, docs, lengths, payload in zip(*(c.to_pylist() for c in batch.columns)):
                ids = codec.decode(payload).astype("<u4")
                ends = np.cumsum(lengths)
                starts = ends - np.array(lengths)
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("first", "doc_ids", "lengths", "payload").mapInArrow(decode, REPORT)


def write_and_read(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int, partitions: int) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "rans")
    write(docs, path, tokenizer, vocabulary, end_id, partitions)
    return read(spark, path, vocabulary)
