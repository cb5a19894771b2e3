"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from the vocabulary.

The rank file becomes a sentencepiece BPE model without training: each token's bytes are mapped to
printable characters, its score is the negative rank, normalisation is the identity. Each pre-token
(match of the split pattern) is byte-mapped and encoded on its own; ids are decoded by the inverse map.

Null text counts as empty: no ids, hashes of the empty string. Repeated rows give repeated results, an empty
table none. Texts of any length are read whole; what is cached of them are short chunks alone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from cytolake.llm.common import CHUNK

#: Entries of the per-worker cache of encoded chunks, and the longest chunk it takes.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 48

RESULT = "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long"


def byte_characters() -> list[str]:
    """The printable character of each byte: itself in the printable Latin-1 ranges, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece with id r is the token of rank r; the last id is <unk>."""
    chars = byte_characters()
    order = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in order] != list(range(len(order))):
        raise ValueError("ranks must run from 0 without gaps")
    normal, unknown, bpe = 1, 2, 2
    pieces = [(("".join(chars[b] for b in token)).encode(), -float(rank), normal) for token, rank in order]
    pieces.append((b"<unk>", 0.0, unknown))
    body = b"".join(_bytes(1, _bytes(1, text) + b"\x15" + struct.pack("<f", score) + _number(3, kind)) for text, score, kind in pieces)
    trainer = _number(3, bpe) + _number(4, len(pieces)) + _number(40, len(order))
    normaliser = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return body + _bytes(2, trainer) + _bytes(3, normaliser)


class ByteBpe:
    """Encoder and decoder over one rank file; keeps a bounded cache of chunks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(ranks))
        chars = byte_characters()
        self.map = str.maketrans({chr(b): c for b, c in enumerate(chars)})
        # Ids go back through the model's own pieces and the inverse of the byte map.
        inverse = str.maketrans({c: chr(b) for b, c in enumerate(chars)})
        self.tokens = [piece.translate(inverse).encode("latin-1") for piece in self.model.id_to_piece(list(range(len(ranks))))]
        # A pre-token that is itself in the vocabulary is one token, even where merges don't lead to it.
        whole = self.model.encode([self.mapped(t) for t in self.tokens], num_threads=1)
        self.direct = {self.mapped(t): [r] for r, (t, ids) in enumerate(zip(self.tokens, whole)) if ids != [r]}
        self.names = list(map(str, range(len(self.tokens))))
        self.cache: dict[str, tuple[str, bytes]] = {}

    def mapped(self, token: bytes) -> str:
        return token.decode("latin-1").translate(self.map)

    def learn(self, chunks: list[str]) -> None:
        """Puts the decimal and the packed ids of each chunk into the cache."""
        parts = [self.split.findall(c) for c in chunks]
        mapped = [self.mapped(x.encode()) for p in parts for x in p]
        ids = self.model.encode(mapped, num_threads=1)
        if self.direct:
            ids = [self.direct.get(m, i) for m, i in zip(mapped, ids)]
        names, at = self.names, 0
        for chunk, part in zip(chunks, parts):
            end = at + len(part)
            got = ids[at] if end == at + 1 else [i for x in ids[at:end] for i in x]
            at = end
            self.cache[chunk] = (",".join([names[i] for i in got]), array("I", got).tobytes())

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """Decimal ids joined by commas, and the ids."""
        chunks = CHUNK.findall(text)
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        missing = list(set(chunks).difference(cache))
        if missing:
            self.learn(missing)
        found = [cache[c] for c in chunks]
        for c in missing:
            if len(c) > CACHE_CHARS:
                del cache[c]
        return ",".join([x for x, _ in found]), np.frombuffer(b"".join([x for _, x in found]), "<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(4)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(read_ranks(path), pattern)


def round_trip(bpe: ByteBpe, text: str | None) -> tuple[int, str, str, int]:
    joined, ids = bpe.encode(text or "")
    data = bpe.decode(ids.tolist())
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(data).hexdigest(), len(data)


def digest_udf(path: str, pattern: str):
    @pandas_udf(RESULT)
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = byte_bpe(path, pattern)
        for texts in batches:
            yield pd.DataFrame([round_trip(bpe, t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    return digests


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with the ids of each text as an array column `into` (replaced where it exists)."""

    @pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(path, pattern)
        for texts in batches:
            yield pd.Series([bpe.encode(t or "")[1].astype("int32") for t in texts])

    return docs.withColumn(into, ids(F.col(text)))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """docs with the bytes of each id array as a binary column `into`; null ids give null."""

    @pandas_udf("binary")
    def data(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = byte_bpe(path, pattern)
        for arrays in batches:
            yield pd.Series([None if a is None else bpe.decode(a) for a in arrays])

    return docs.withColumn(into, data(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_bytes of each document, in one narrow pass."""
    return docs.select("doc_id", digest_udf(path, pattern)("text").alias("r")).select("doc_id", "r.*")
