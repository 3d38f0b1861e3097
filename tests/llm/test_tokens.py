"""BPE, Huffman codes and token files against the tokenizers library and round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rostrum.llm import bpe, huffman, token_files

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n_tokens long"
ODD = [None, "", " ", "<|endoftext|>a<|endoftext|>", "a" * 4000, "ab" * 2000, " " * 60 + "x", "\x1c\x1d\x85 　x\t\n y", "we'll I'D don't", "日本語 😀👍🏽 ١٢٣ ½", "\x00\x01", "é ́", "ΑΣ ΣΑΣ İ", "<|startoftext|> The  THE"]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["a", "aa", "the", "in", " ", "  ", "\n", "xx", "==", "00", "'s"]), max_size=100).map("".join)))
def test_bpe_equals_the_library(text):
    ours, theirs = bpe.load(BYTES), Tokenizer.from_file(BYTES) if not hasattr(test_bpe_equals_the_library, "t") else test_bpe_equals_the_library.t
    test_bpe_equals_the_library.t = theirs
    ids = ours.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert ours.decode(ids) == text


def test_decoding_replaces_broken_utf8_as_the_library_does(libraries):
    rng = random.Random(0)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert bpe.load(BYTES).decode(np.array(ids, "<u4").tobytes()) == libraries[0].decode(ids, skip_special_tokens=False)


def test_round_trip_rows(spark, libraries):
    rows = [(i, t, 0) for i, t in enumerate(ODD)] + [(3, ODD[3], 0), (None, "null id", 0)]
    got = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), BYTES).collect()
    want = []
    for d, t, _ in rows:
        e = libraries[0].encode(t or "", add_special_tokens=False).ids
        want.append((d, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA), BYTES).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
def test_huffman_round_trip_and_limit(n):
    x = np.random.default_rng(n).zipf(1.2, n) % 700
    lengths = huffman.code_lengths(np.bincount(x, minlength=701), 10)
    assert lengths.max(initial=0) <= 10 and (n < 2 or sum(0.5 ** float(k) for k in lengths if k) <= 1)
    code = huffman.Code(lengths)
    bits, offsets = code.encode(x)
    assert (code.decode(bits, offsets, n) == x).all()


def test_package_merge_is_optimal_without_a_tight_limit():
    import heapq

    counts = np.random.default_rng(3).integers(0, 1000, 300)
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
    cost = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], ()))
    assert int((huffman.code_lengths(counts).astype(int) * counts).sum()) == cost


def test_token_files(spark, libraries, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 500)
    rng = random.Random(1)
    texts = ODD + [" ".join(rng.choice(["The", "a", "talk's", "über", "x9", "##"]) + str(rng.randrange(30)) for _ in range(rng.randrange(200))) for _ in range(300)]
    rows = [(7 * i - 500, t, 1) for i, t in enumerate(texts)] + [(0, "twice", 1), (0, "twice", 1), (None, "null id", 1)]
    random.Random(2).shuffle(rows)
    token_files.write(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "f"), WORDS)
    got = sorted(map(tuple, token_files.summary(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    want, start = [], 0
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = libraries[1].encode(t or "", add_special_tokens=False).ids + [token_files.END]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    token_files.write(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"), WORDS)
    assert token_files.summary(spark, str(tmp_path / "e")).count() == 0


def test_distinct_chunks_are_looked_up_once_and_memory_is_bounded_in_bytes(libraries, monkeypatch):
    import pyarrow as pa

    texts = ["left out", *(t or "" for t in ODD), "The the, THE. the The", "É é É. ., . , a.b.. <|endoftext|>The <|ENDOFTEXT|>", " \t\x0b\x0c\r\n ", "Zz " * 500]
    for room in (token_files.KEPT_WORDS, 2000):
        monkeypatch.setattr(token_files, "KEPT_WORDS", room)
        monkeypatch.setattr(token_files, "KEPT_CHUNKS", room)
        chunks = token_files._Chunks(WORDS)
        asked = []
        monkeypatch.setattr(token_files, "_chunks", lambda _: chunks)  # noqa: B023
        monkeypatch.setattr(chunks, "all", lambda c, f=chunks.all: f(asked.extend(c) or c))  # noqa: B023
        batch = pa.array([t.encode() for t in texts], pa.binary()).slice(1)
        for _ in range(2):
            asked.clear()
            ids, at = token_files._ids(batch, WORDS, "<u2")
            want = [libraries[1].encode(t, add_special_tokens=False).ids + [token_files.END] for t in texts[1:]]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
            assert len(asked) == len(set(asked)) == len({c for t in texts[1:] for c in t.encode().split()} | {b""})
        assert max(chunks.words.used, chunks.others.used) <= room
    ids, at = token_files._ids(batch.slice(0, 0), WORDS, "<u2")
    assert (ids.tolist(), at.tolist()) == ([], [0])
