"""Periodic runs against a plain search of all periods."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from rostrum.llm import runs

DOCS = "doc_id long, text string"


def plain(w) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of all runs, by start, then period."""
    n, seen = len(w), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j - i >= p:
                seen.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e, p) for (s, e), p in seen.items() if e - s >= max(12, 2 * p))


def sequences():
    r = random.Random(5)
    for k in range(400):
        n = r.choice([0, 1, 11, 12, 13, 24, 25, 40, 90, 200, 400])
        yield [r.randrange(1 + k % 4) for _ in range(n)]
    for k in range(150):  # repeats of blocks that are periodic themselves, with a fault here and there
        root = [r.randrange(3) for _ in range(r.randrange(1, 7))]
        block = (root * 60)[: r.randrange(1, 90)] + [r.randrange(3) for _ in range(r.randrange(4))]
        w = (block * 40)[: r.randrange(30, 420)]
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = r.randrange(5)
        yield w
    for k in (5, 20, 61, 130):
        yield [0, 1] * k + [0] + [0, 1] * k + [0]
        yield [0] * k + [1] + [0] * k + [2] + [0] * k + [1] + [0] * k
        yield ([0, 1, 2] * k)[:-1] + [0, 1, 2] * k
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    yield b
    t = [0]
    for _ in range(9):
        t = t + [1 - x for x in t]
    yield t


def test_all_runs():
    every = list(sequences())
    want = [plain(w) for w in every]
    assert sum(map(len, want)) > 2500
    assert max(p for x in want for _, _, p in x) > 100
    for w, x in zip(every, want, strict=True):
        assert list(zip(*(c.tolist() for c in runs.find(np.array(w, np.int64), np.array([len(w)]))), strict=True)) == x
    # all at once: none reaches from one text to the next
    sizes = np.array(list(map(len, every)))
    begin = np.cumsum(sizes) - sizes
    got = list(zip(*(c.tolist() for c in runs.find(np.concatenate([np.array(w, np.int64) for w in every]), sizes)), strict=True))
    assert got == [(s + b, e + b, p) for b, x in zip(begin.tolist(), want, strict=True) for s, e, p in x]


def row(doc_id, text, planted=True):
    """What the query's contract says, word by word."""
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if planted and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = [(s, e - s, p) for s, e, p in plain(w)]
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    s, m, p = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    return (
        doc_id,
        len(found),
        s,
        m,
        p,
        1000 * m // p if found else None,
        hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest(),
    )


def texts():
    r = random.Random(3)
    out = [None, "", " \n\t", "x", "a " * 12, "ha " * 11, "  café x " * 6, "tick tock " * 40, ("once upon a time " * 3 + "the end ") * 9]
    return out + [" ".join(r.choice("abcdefgh") for _ in range(r.randrange(400))) for _ in range(120)]


def test_contract(spark):
    docs = [(i, t) for i, t in enumerate(texts())] + [(None, "la " * 30), (None, None), (3, "x"), (3, "x")]
    got = runs.runs(spark.createDataFrame(docs, DOCS).repartition(3), planted=True).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(row(*d)) for d in docs)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in enumerate(texts())) > 5


def test_long_text(spark):
    """A text beyond a block, beside others; the run in it reaches over most of it."""
    r = random.Random(1)
    lead = [str(r.randrange(10**6)) for _ in range(1000)]
    text = " ".join(lead + [f"w{i % 70000}" for i in range(runs.BLOCK + 5000)])
    got = {x.doc_id: x for x in runs.runs(spark.createDataFrame([(1, "a b"), (2, text), (4, "c " * 20)], DOCS).coalesce(1)).collect()}
    assert (got[2].n_runs, got[2].start, got[2].period, got[2].length) == (1, 1000, 70000, runs.BLOCK + 5000)
    assert (got[1].n_runs, got[4].n_runs, got[4].period) == (0, 1, 1)


def test_empty_and_other_columns(spark):
    none = runs.runs(spark.createDataFrame([], DOCS))
    assert none.count() == 0
    df = spark.createDataFrame([(1, "a " * 20, "x", 7)], "doc_id long, text string, n_runs string, TEXT_ int")
    assert [tuple(x)[:5] for x in runs.runs(df).collect()] == [(1, 1, 0, 20, 1)]
    assert runs.runs(df).columns == none.columns


@pytest.mark.parametrize("ids", ["string", "int"])
def test_other_ids(spark, ids):
    df = spark.createDataFrame([("7", "a " * 20)], "doc_id string, text string").selectExpr(f"cast(doc_id as {ids}) AS doc_id", "text")
    assert runs.runs(df).first().n_runs == 1
