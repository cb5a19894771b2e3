"""Byte-level BPE, token counts and rANS files against the libraries themselves."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from cytolake.llm import bpe, rans, token_counts

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def oracle():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_encodes_as_tiktoken_and_decodes_back(text):
    own = bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}) if not hasattr(test_any_text_encodes_as_tiktoken_and_decodes_back, "e") else test_any_text_encodes_as_tiktoken_and_decodes_back.e
    test_any_text_encodes_as_tiktoken_and_decodes_back.e = other
    joined, ids = own.encode(text)
    assert ids.tolist() == other.encode_ordinary(text)
    assert joined == ",".join(map(str, ids.tolist()))
    assert own.decode(ids.tolist()) == text.encode()


def test_digests_of_odd_documents(docs, odd_texts, oracle):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    want = set()
    for i, t in enumerate(odd_texts):
        ids = oracle.encode_ordinary(t or "")
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_bpe_arrays_round_trip_and_keep_columns(docs, no_docs):
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    for row in coded.collect():
        assert bytes(row.decoded).decode() == (row.text or "")
    assert bpe.round_trip_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("frequent", [0, 5, 100_000])
def test_token_counts_match_the_library(docs, odd_texts, frequent):
    library = Tokenizer.from_file(BYTES)
    want = sorted((i, len((t or "").encode()), n, n > 50) for i, t in [*enumerate(odd_texts), (4, odd_texts[4])] for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    got = token_counts.count_tokens(docs, BYTES, public_tokenizers.PATTERN, ("<|endoftext|>",), 50, frequent)
    assert sorted(map(tuple, got.collect())) == want


def test_token_counts_of_nothing(no_docs):
    assert token_counts.count_tokens(no_docs, BYTES, public_tokenizers.PATTERN, ("<|endoftext|>",), 50).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=3000), st.integers(1, 50))
def test_rans_blocks_round_trip(ids, spread):
    ids = np.array(ids, np.uint32) // spread
    codec = rans.Codec(rans.quantise(np.bincount(ids, minlength=400)))
    assert (codec.decode(codec.encode(ids)) == ids).all()


def test_rans_segments_decode_alone_and_damage_is_seen():
    ids = np.random.default_rng(1).zipf(1.4, 400_000).clip(0, 999).astype(np.uint32)
    freq = rans.quantise(np.bincount(ids, minlength=1000))
    assert freq.sum() == 1 << rans.PRECISION and (freq[np.unique(ids)] > 0).all()
    codec = rans.Codec(freq)
    data = codec.encode(ids)
    size = rans.LANES * rans.SEGMENT_STEPS
    assert codec.segments(data) == -(-len(ids) // size)
    assert (codec.decode_segment(data, 2) == ids[2 * size : 3 * size]).all()
    with pytest.raises(ValueError):
        codec.decode(data[:-4] + b"\0\1\2\3")


def test_rans_files_give_the_library_ids(docs, odd_texts, no_docs):
    library = Tokenizer.from_file(WORDS)
    got = [tuple(r) for r in rans.write_and_read(docs, WORDS, 49_408, 2, 3).orderBy("start").collect()]
    want, start = [], 0
    for i, t in sorted([*enumerate(odd_texts), (4, odd_texts[4])], key=lambda x: x[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert rans.write_and_read(no_docs, WORDS, 49_408, 2, 3).count() == 0


def test_rans_files_with_null_and_repeated_doc_ids(spark):
    library = Tokenizer.from_file(WORDS)
    rows = [(7, "some words"), (None, "null one"), (7, "other"), (None, None), (2, "two"), (7, "other"), (-5, "minus")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in rans.write_and_read(docs, WORDS, 49_408, 2, 5).orderBy("start").collect()]
    coded = [(i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u2").tobytes()) for i, t in rows]
    want, start = [], 0
    for i, data in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.frombuffer(data, "<u2").astype("<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=30))
def test_word_ids_of_any_characters(text):
    encoder = rans.word_encoder(WORDS)
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_word_ids_of_controls_and_unassigned_characters(spark):
    texts = ["a\x7fb", "\x1b[31mred\x1b[0m", "\x00", "".join(map(chr, range(32))), "x\x00y \x08\x7f z", "a͸b \U0001cc00", "﷐"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    library = rans.word_encoder(WORDS).tokenizer
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    rows = rans.write_and_read(docs, WORDS, 49_408, 2, 3).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want
