"""Removal of repeated passages against a plain dictionary of windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from rostrum.llm import packed
from rostrum.llm import substring_dedup as sd

DOCS = "doc_id long, text string"
BIG = 1 << 70


def plain(docs, width=13):
    """(id, n_words, n_removed, sha256 of kept words) of every row."""
    rows = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in rows:
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            least[key] = min(least.get(key, BIG), BIG if i is None else i)
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < (BIG if i is None else i):
                gone |= set(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed=2, n=160):
    r = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(r.choice([6, 7, 12, 13, 14, 25, 60]))] for k in range(12)]
    docs = [(None, None), (5, ""), (6, " \n "), (7, "one two"), (8, " ".join(map(str, range(13)))), (9, "x " + " ".join(map(str, range(13)))), (10, "é " * 40)]
    for k in range(n):
        words = []
        for _ in range(r.randrange(5)):
            words += [f"{k}_{r.randrange(10**6)}" for _ in range(r.randrange(30))] + r.choice(passages)[: r.choice([None, 12, 13])]
        docs.append((20 + k, r.choice([" ", "\n", "  \t"]).join(words)))
    docs += [(20 + r.randrange(n), docs[r.randrange(len(docs))][1]) for _ in range(20)]  # repeated ids, with other texts
    docs += [docs[40], docs[40], (None, docs[50][1]), (None, docs[50][1]), (3, docs[60][1]), (4000, "same " * 50), (4001, "same " * 30)]
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("parts", [1, 7])
def test_contract(spark, monkeypatch, parts):
    monkeypatch.setattr(sd, "BUCKET", 1 << 12)
    docs = corpus()
    got = sd.remove(spark.createDataFrame(docs, DOCS).repartition(parts)).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(docs)
    assert sum(x.n_removed > 0 for x in got) > 60


@pytest.mark.parametrize("width", [1, 2, 7, 20, 50])
def test_other_widths(spark, width):
    docs = corpus(seed=width, n=50)
    got = sd.remove(spark.createDataFrame(docs, DOCS).repartition(3), width=width).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(docs, width)


def test_levels():
    assert sd.lengths(13) == [7, 13]
    assert sd.lengths(50) == [7, 13, 25, 50]
    assert sd.lengths(3) == [3]
    for width in range(1, 200):
        x = sd.lengths(width)
        assert x[-1] == width and x[0] < 8 and all(b in (2 * a, 2 * a - 1) for a, b in zip(x, x[1:], strict=False))


def test_chunks_and_long_text(spark, monkeypatch):
    """Many small chunks, and a text longer than a chunk, whose middle another document has."""
    docs = corpus(seed=9)
    long = [f"w{i}" for i in range(60_000)]
    docs += [(100_000, " ".join(long)), (99_999, " ".join(long[20_000:40_000])), (100_001, " ".join(long[::-1]))]
    chunk = sd._Chunk([i for i, _ in docs if i is not None], [(t or "").encode() for i, t in docs if i is not None])
    chunk.split()
    assert sd._Chunk.unpack(chunk.pack()).texts[-1] == docs[-1][1].encode()
    got = sd.remove(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    assert sorted(repr(tuple(x)) for x in got) == plain(docs)


def test_packing():
    r = np.random.default_rng(1)
    a, b = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64)), r.integers(0, 9, 0).astype("<u4")
    x, y = packed.unpack(packed.pack(packed.steps(a), b), "<u8", "<u4")
    assert (np.cumsum(x, dtype=np.uint64) == a).all() and len(y) == 0


def test_empty_and_other_columns(spark):
    none = sd.remove(spark.createDataFrame([], DOCS))
    assert none.count() == 0
    text = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(1, text, 5, "a"), (2, text, 6, "b")], "doc_id long, text string, n_words int, CHUNK string")
    assert sorted((x.doc_id, x.n_words, x.n_removed) for x in sd.remove(df).collect()) == [(1, 20, 0), (2, 20, 20)]
    assert sd.remove(df).columns == none.columns
