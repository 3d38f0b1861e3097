"""Change points against a plain loop and planted shifts; points in spans against all pairs; token lookup of titles."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import changes as ch
from rostrum.operators import chunking
from rostrum.operators import delivery as d
from rostrum.operators.intervals import inside

FRAMES = "session_id long, frame_idx int, t double, energy double, pitch double, speech_rate_per_sec double"


def plain(rows, penalty, reach):
    """Frames (energy, pitch, pace) of one session in order: [(i, gain)], by the definition of the cost."""
    x = np.nan_to_num(np.array([[np.nan if v is None else v for v in r] for r in rows], float))
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    n, w = len(z), np.array(ch.directions(3))
    phi = np.concatenate([np.cos(z @ w.T), np.sin(z @ w.T)], 1) / np.sqrt(len(w))

    def cost(a, b):
        return ((phi[a:b] - phi[a:b].mean(0)) ** 2).sum()

    def gain(a, i, b):
        return round(cost(a, b) - cost(a, i) - cost(i, b), 6)

    g = {i: gain(max(0, i - reach), i, min(n, i + reach)) for i in range(ch.LEAST, n - ch.LEAST + 1)}
    peaks = [i for i in g if g[i] > penalty / 2 and all(g.get(i - k, -1) < g[i] for k in range(1, reach + 1)) and all(g.get(i + k, -1) <= g[i] for k in range(1, reach + 1))]
    return [(i, g[i]) for k, i in enumerate(peaks) if gain(peaks[k - 1] if k else 0, i, peaks[k + 1] if k + 1 < len(peaks) else n) > penalty]


def sessions():
    r = np.random.default_rng(3)
    out = []
    for k in range(25):
        n = int(r.choice([1, 3, 4, 20, 33, 90, 260]))
        x = r.normal(size=(n, 3))
        if k % 3 == 0:
            x = np.round(x)  # ties
        for _ in range(int(r.integers(0, 4))):
            x[int(r.integers(0, n)) :, int(r.integers(0, 3))] += r.normal() * 5
        x = x.tolist()
        if k % 4 == 0:
            x[0][1], x[-1][2] = None, float("nan")
        out.append(x)
    return out + [[[1.0, 2.0, 3.0]] * 40]


def table(spark, every):
    rows = [(s, i, float(i), *map(lambda v: None if v is None else float(v), x)) for s, xs in enumerate(every) for i, x in enumerate(xs)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, FRAMES)


@pytest.mark.parametrize(("penalty", "reach"), [(3.0, 20), (1.0, 5)])
def test_scan_is_the_plain_one(spark, penalty, reach):
    every = sessions()
    got = sorted((x.session_id, x.frame_idx, x.gain) for x in ch.find_changes(table(spark, every), penalty=penalty, reach=reach).collect())
    want = [(s, i, g) for s, xs in enumerate(every) for i, g in plain(xs, penalty, reach)]
    assert [x[:2] for x in got] == [x[:2] for x in want] and len(want) >= 3
    assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=2e-6)


def test_planted_shifts_are_found(spark):
    """Shifts of mean, spread or pitch every 40 to 80 frames: 95 % found within 3 frames, few others; typed and merged."""
    r = np.random.default_rng(5)
    every, planted = [], []
    for s in range(40):
        at, level, spread, xs = 0, np.zeros(3), 1.0, []
        for _ in range(6):
            n = int(r.integers(40, 81))
            xs += (level + spread * r.normal(size=(n, 3)) * 0.5).tolist()
            at += n
            planted.append((s, at))
            which = int(r.integers(0, 3))
            level = level.copy()
            level[which] += (3 if level[which] <= 0 else -3) * r.choice([1, 1.5])
        planted.pop()
        every.append(xs)
    frames = table(spark, every)
    found = ch.find_changes(frames)
    at = [(x.session_id, x.frame_idx) for x in found.collect()]
    hit = sum(any(s == u and abs(i - v) <= 3 for u, v in at) for s, i in planted)
    assert hit >= 0.95 * len(planted)
    assert sum(not any(s == u and abs(i - v) <= 3 for s, i in planted) for u, v in at) <= 0.05 * len(planted)
    typed = d.type_changes(frames, found)
    kinds = {x.type for x in typed.collect()}
    assert kinds <= {"energy_drop", "energy_rise", "pitch_shift", "speed_drop", "speed_rise"} and len(kinds) == 5
    assert d.merge_changes(typed, 2.0).count() >= 0.9 * len(planted)


def test_short_and_empty_sessions(spark):
    assert ch.find_changes(table(spark, [])).count() == 0
    assert ch.find_changes(table(spark, [[[1.0, 1.0, 1.0]], [[0.0] * 3, [9.0] * 3, [0.0] * 3]]), penalty=0.0).count() == 0


@pytest.mark.parametrize("closed", [True, False])
def test_inside_is_all_pairs(spark, closed):
    r = random.Random(2)
    spans = [(s, k, lo, lo + r.choice([0.0, 1.0, 2.0, 7.0, -1.0])) for s in range(12) for k in range(r.randrange(7)) for lo in [float(r.randrange(12))]]
    spans += [(20, 1, None, 3.0), (20, 2, 1.0, None), (21, 1, 0.0, 5.0)]
    points = [(s, i, r.choice([None, r.randrange(-1, 16) / 1.0, r.random() * 14])) for s in [*range(13), 20] for i in range(25)]
    got = inside(spark.createDataFrame(points, "session_id int, i int, t double").repartition(3), spark.createDataFrame(spans, "session_id int, slide_id int, lo double, hi double"), closed=closed)
    assert got.columns == ["session_id", "slide_id", "lo", "hi", "i", "t"]
    ends = (lambda t, lo, hi: lo <= t <= hi) if closed else (lambda t, lo, hi: lo <= t < hi)
    want = [(s, k, lo, hi, i, t) for s, k, lo, hi in spans for u, i, t in points if s == u and None not in (t, lo, hi) and ends(t, lo, hi)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(want) > 80


def test_no_join_on_a_range(spark):
    spans = spark.createDataFrame([(1, 1, 0.0, 2.0)], "session_id long, slide_id int, lo double, hi double")
    frames = table(spark, [[[1.0, 1.0, 1.0]] * 3]).withColumn("silence", F.lit(False))
    plan = d.segment_features(frames, spans)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_cues_are_the_first_stretch(spark):
    r = random.Random(7)
    words = [(s, i + 3, i * 100, r.choice("abcdefgh").upper()) for s in range(30) for i in range(r.randrange(60))]
    titles = [(s, k, [r.choice("abcdefghxyz") for _ in range(r.randrange(5))]) for s in range(30) for k in range(3)]
    for within, least in ((6, 2), (3, 3), (1, 1)):
        got = chunking.cues(spark.createDataFrame(words, "session_id int, word_idx int, start_ms int, word string"), spark.createDataFrame(titles, "session_id int, slide_id int, tokens array<string>"), within, least).collect()
        want = []
        for s, k, tokens in titles:
            w = [(i, ms, x.lower()) for u, i, ms, x in words if u == s]
            starts = [w[p][1] for p in range(len(w)) if len({x for _, _, x in w[p : p + within]} & set(tokens)) >= least]
            want += [(s, k, min(starts))] if starts else []
        assert sorted((x.session_id, x.slide_id, x.start_ms) for x in got) == sorted(want) and want
