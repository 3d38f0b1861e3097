"""Exact dedup, mixing and sharding against plain loops, on odd rows too."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from rostrum.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, source string, size string"
ODD = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", "a b", "A b", "é", "x" * 40_000, "a b"]


def documents(seed=0, n=150):
    rng = random.Random(seed)
    rows = [(i, t, "odd", "clash") for i, t in enumerate(ODD)]
    for i in range(n):
        t = "same text again" + " " * rng.randrange(3) if rng.random() < 0.35 else " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(0, 60)))
        rows.append((100 + i, t, rng.choice(["a", "a", "a", "b", "c", None]), "clash"))
    rng.shuffle(rows)
    return rows


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("support", [1 / 2048, 0.05])
def test_exact_dedup(spark, support):
    rows = documents() + [(3, "a b", "odd", ""), (None, "null id", None, ""), (None, "nullid", None, "")]
    got = exact_dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(5), support=support).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), d is None, d or 0))
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        key = next(k for k in groups if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(groups[key])
        assert r.group_size == len(groups[key]) and r.keep_id == (None if best[1] else best[2])
        kept[key] += r.kept
    assert all(n == 1 for n in kept.values()) and len(kept) == len(groups)


def test_drop_copies_keeps_one_row_of_each_text(spark):
    rows = documents(1) + [(3, "a b", "odd", ""), (3, "a b", "odd", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns
    assert Counter(strip(r.text) for r in out.collect()) == Counter({strip(t) for _, t, *_ in rows})
    assert exact_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0


def fill(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark):
    rows = documents(2, 400)
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df.repartition(4)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += count(t)
    want = fill(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    # below the target by less than a typical document (30 words)
    assert all(want[s] - 30 <= taken[s] <= want[s] + 1e-6 for s in sizes), [(s, want[s], taken[s]) for s in sizes]
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(df.repartition(2)).collect()), key=repr)
    assert sum(count(r.text) for r in mixing.take(df).collect()) == sum(taken.values())
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.taken for r in mixing.mix(spark.createDataFrame([(1, None, None, "")], SCHEMA)).collect()] == [0]


def test_sharding(spark):
    rows = documents(3)
    limit = 300
    df = spark.createDataFrame(rows, SCHEMA)
    got = sharding.assign(df.repartition(3), limit_bytes=limit).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
        assert r.shard == "" or f"{int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16):060b}".startswith(r.shard)
    for name, m in shards.items():
        assert sum(r.bytes for r in m) == m[0].shard_bytes and (m[0].shard_bytes <= limit or len(m) == 1)
        assert not any(o != name and o.startswith(name) for o in shards)
        if name:  # its parent had to be split
            assert sum(r.bytes for o, x in shards.items() if o.startswith(name[:-1]) for r in x) > limit


def test_sharding_of_repeated_rows(spark):
    df = spark.createDataFrame([(7, "x" * 50, None, "")] * 40 + [(None, "y" * 50, None, "")] * 3, SCHEMA)
    got = sharding.assign(df, limit_bytes=200).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.bytes
    assert len(got) == 43 and max(size.values()) <= 200
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0
