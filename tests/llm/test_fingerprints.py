"""Sketches against whole shingle sets, and the edited texts against a plain loop."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from rostrum.llm import fingerprints as fp
from rostrum.llm.shingles import shingle_set

SCHEMA = "doc_id long, text string, fingerprint string"


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def test_estimates_are_near_the_truth():
    rng = random.Random(0)
    errors, contained, counts = [], [], []
    for i in range(200):
        w = words(rng, 800).split()
        cut = rng.randrange(800)
        a, b = " ".join(w).encode(), " ".join(w[:cut] + words(rng, 800 - cut).split()).encode()
        x, y = shingle_set(a), shingle_set(b)
        shared = len(np.intersect1d(x, y))
        s, t = fp.sketch(a), fp.sketch(b)
        errors.append(abs(fp.resemblance(s, t) - shared / (len(x) + len(y) - shared)))
        contained.append(abs(fp.containment(s, t) - shared / len(x)))
        counts.append(abs(fp.distinct(s) / len(x) - 1))
    assert np.mean(errors) < 0.04 and np.mean(contained) < 0.08 and np.mean(counts) < 0.15


def test_sketches_merge_and_survive_text_form():
    rng = random.Random(1)
    for n in (0, 1, 4, 5, 50, 3000):
        a, b = words(rng, n).encode(), words(rng, n).encode()
        s, t = fp.sketch(a), fp.sketch(b)
        whole = np.unique(np.concatenate([shingle_set(a), shingle_set(b)]) >> np.uint64(16))[: fp.K]
        assert (fp.merge(s, t) == whole).all()
        assert (fp.from_text(fp.to_text(s)) == s).all()
    same = fp.sketch(b"a b " * 5000)
    assert len(same) == 2 and fp.resemblance(same, same) == 1.0


def test_edited_rows_equal_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 10)
    rng = random.Random(2)
    texts = [None, "", "é", "日本語 😀", "one two"] + [words(rng, rng.randrange(0, 90)) for _ in range(120)] + ["x" * 30_000]
    rows = [(13 * i - 200, t, "clash") for i, t in enumerate(texts)] + [(None, "null id", "")]
    random.Random(3).shuffle(rows)
    got = {r.doc_id: r for r in fp.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0], reverse=True)
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        new = t[: len(t) - half] + after[:half]
        s, e, a = (fp.sketch(x.encode()) for x in (t, new, after))
        assert tuple(got[d]) == (d, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.to_text(s), fp.to_text(e), fp.resemblance(s, e), fp.resemblance(s, a))


def test_repeated_rows_and_small_tables(spark):
    rows = [(1, "a b c d e f", "")] * 3 + [(2, "g", "")]
    got = sorted(map(tuple, fp.edited_likeness(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert [r[0] for r in got] == [1, 1, 1, 2]
    assert fp.edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = fp.edited_likeness(spark.createDataFrame([(5, "abcd", "")], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1.0
    assert fp.fingerprint(spark.createDataFrame([(5, None, "")], SCHEMA)).collect()[0].fingerprint == ""


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 1)
    rows = [(i * i, f"t{i} a b c d", "") for i in range(700)]
    got = {r.doc_id: r for r in fp.edited_likeness(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i, (d, t, _) in enumerate(rows):
        after = rows[i - 1][1]
        half = len(t) // 2
        assert got[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
