"""Operators that had no test of their own: plain loops and known rows."""

from __future__ import annotations

import math
import random
import struct
import time
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.operators import deck, evaluate, prepare, probe, report
from rostrum.operators import delivery as d
from rostrum.sources import files


def test_tolerance_matches_are_the_plain_ones(spark):
    r = random.Random(2)
    rows = [(k, [round(r.random() * 20, 1) for _ in range(r.choice([0, 1, 5, 70]))], [round(r.random() * 20, 1) for _ in range(r.choice([0, 1, 5, 90]))]) for k in range(60)]
    df = spark.createDataFrame(rows, "session_id int, gold array<double>, pred array<double>")
    for tolerance in (0.0, 0.5, 3.0):
        want = {}
        for k, gold, pred in rows:
            used = set()
            for p in pred:
                i = next((i for i, g in enumerate(gold) if i not in used and abs(g - p) <= tolerance), None)
                used |= {i} - {None}
            want[k] = len(used)
        assert {x.session_id: x.tp for x in evaluate.tolerance_matches(df, tolerance).collect()} == want


def test_attitude_metrics_row(spark):
    flags = spark.createDataFrame([(1, 1, 1, 1), (1, 1, 0, 1), (1, 1, 1, 0), (1, 2, 1, 1), (2, 1, 0, 0)], "session_id int, slide_id int, gold int, pred int")
    rates = spark.createDataFrame([(2.0, 2.5), (3.0, 2.0), (1.0, 1.0)], "gold double, pred double")
    energies = spark.createDataFrame([(1, 1, float(x), y) for x, y in ((1, 2.0), (2, 4.0), (3, 6.0))] + [(1, 2, float(x), y) for x, y in ((1, 3.0), (2, 2.0), (3, 1.0))] + [(2, 1, 1.0, 1.0), (2, 1, 2.0, 3.0), (2, 1, 3.0, 2.0)], "session_id int, slide_id int, x double, y double")
    changes = spark.createDataFrame([(1, [1.0, 10.0], [2.0, 13.5]), (2, [5.0], [])], "session_id int, gold array<double>, pred array<double>")
    got = evaluate.attitude_metrics(flags, rates, energies, changes).collect()
    assert len(got) == 1
    want = {"f1_tol_1s": (0.5 + 0) / 2, "f1_tol_3s": (0.5 + 0) / 2, "f1_tol_5s": (1 + 0) / 2, "speech_rate_mae": 0.5, "silence_f1": (0.5 + 1 + 0) / 3, "energy_perception_corr": (1 - 1 + 0.5) / 3}
    assert got[0].asDict() == pytest.approx(want)
    empty = evaluate.attitude_metrics(flags.limit(0), rates.limit(0), energies.limit(0), changes.limit(0)).collect()
    assert [set(x.asDict().values()) for x in empty] == [{0.0}]


def test_pitch_slides(spark):
    changes = [(1, k, "pitch_shift", m) for k, m in ((1, 0.5), (2, -2.0), (2, 1.0), (3, 3.0), (4, 0.1))] + [(1, 5, "energy_drop", 9.0), (2, 1, "pitch_shift", 1.0), (2, 2, "pitch_shift", 1.0), (3, 1, "pitch_shift", 0.0)]
    df = spark.createDataFrame(changes, "session_id int, slide_id int, type string, magnitude double")
    counts = spark.createDataFrame([(1, 6), (2, 3), (3, 2)], "session_id int, n_slides int")
    assert sorted(map(tuple, report.pitch_slides(df, counts).collect())) == [(1, 2, 3.0), (1, 3, 3.0), (2, 1, 1.0)]
    assert sorted(map(tuple, report.pitch_slides(df, counts, 1.0, 0.4).collect())) == [(1, 1, 0.5), (1, 2, 3.0), (1, 3, 3.0), (2, 1, 1.0), (2, 2, 1.0)]


def test_stability_by_silence_probe_and_anomalies(spark):
    df = spark.createDataFrame([(1, 0.10, 0.8, 3.0), (1, 0.40, 0.6, 3.0), (2, None, None, 0.0), (3, 0.9, None, 6.0)], "session_id int, silence_ratio double, overall_delivery double, n_flags double")
    got = {x.session_id: x for x in d.stability(df).collect()}
    assert got[1].silence == pytest.approx((1.0 + 0.5) / 2) and got[1].probe == pytest.approx(0.7)
    assert got[1].delivery_stability == pytest.approx((0.75 * 0.35 + 0.7 * 0.15) / 0.5 * 100)
    assert got[2].delivery_stability == pytest.approx(100.0)  # no component: what the anomalies leave
    assert got[3].delivery_stability == pytest.approx(0.0)
    flags = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 9.0)], "session_id int, n_flags double")
    assert {x.session_id: round(x.delivery_stability, 4) for x in d.stability(flags).collect()} == {1: 50.0, 2: 0.0}


def test_roles_by_captions(spark):
    slides = spark.createDataFrame([(1, k, f"title {k}", "line one\nline two that is rather long for a section slide, indeed", ["b"]) for k in range(1, 7)], "deck int, slide int, title string, text string, bullets array<string>")
    captions = spark.createDataFrame([(1, 1, "title"), (1, 2, "title"), (1, 3, "section_header"), (1, 4, "thanks"), (1, 5, "chart")], "deck int, slide int, slide_type string")
    got = {x.slide: (x.role, x.source, x.coverage_weight) for x in deck.roles(slides, captions).collect()}
    assert got == {1: ("cover", "caption", 0.0), 2: ("section", "caption", 0.0), 3: ("section", "caption", 0.0), 4: ("thanks", "caption", 0.0), 5: ("content", "caption", 1.0), 6: ("content", "heuristic", 1.0)}


def test_lines_by_place(spark):
    lines = spark.createDataFrame([(1, 1, 0, "right", 10.0, 50.0), (1, 1, 1, "left", 10.0, 5.0), (1, 1, 2, "top", 1.0, 90.0), (1, 1, 3, "- end", 99.0, 0.0)], "deck int, slide int, line_idx int, line string, y0 double, x0 double")
    got = deck.assemble(deck.by_place(lines)).first()
    assert got.text == "top\nleft\nright\nend" and got.bullets == ["end"]


def test_textrank_of_a_slide_of_20000_lines(spark):
    r = random.Random(6)
    lines = [(1, 1, i, " ".join(["common", *(f"w{r.randrange(9000)}" for _ in range(6))])) for i in range(20_000)]
    lines[777] = (1, 1, 777, " ".join(f"w{k}" for k in range(60)) + " common")
    df = spark.createDataFrame(lines, "deck int, slide int, line_idx int, line string")
    began = time.time()
    got = deck.textrank(deck.tfidf(df)).collect()
    assert time.time() - began < 60 and len(got) == 3 and sorted(x["rank"] for x in got) == [1, 2, 3]
    assert all(math.isfinite(x.score) for x in got)


def wav(path, seconds, rate=8000, channels=1, width=2, extra=b""):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(bytes(int(seconds * rate) * channels * width))
    if extra:  # a chunk before the samples
        raw = path.read_bytes()
        path.write_bytes(raw[:36] + b"LIST" + struct.pack("<I", len(extra)) + extra + bytes(len(extra) % 2) + raw[36:])


def test_a_folder_of_clips_is_scored_by_segment(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    wav(tmp_path / "a/one.wav", 5.0)
    wav(tmp_path / "a/b/two.wav", 2.5, 16000, 2, 4, b"odd")
    wav(tmp_path / "a/cut.wav", 3.0)
    (tmp_path / "a/cut.wav").write_bytes((tmp_path / "a/cut.wav").read_bytes()[: 44 + 8000])
    (tmp_path / "a/bad.wav").write_bytes(b"no audio at all")
    (tmp_path / "a/none.wav").write_bytes(b"x")
    (tmp_path / "a/head.wav").write_bytes((tmp_path / "a/one.wav").read_bytes()[:36])
    good, bad = files.read_wav_lengths(spark, str(tmp_path / "a"))
    name = F.element_at(F.split("audio_path", "/"), -1)
    clips = good.withColumn("audio_path", name)
    assert {x.audio_path: (x.rate, x.channels, x.width, x.duration_sec) for x in clips.collect()} == {"one.wav": (8000, 1, 16, 5.0), "two.wav": (16000, 2, 32, 2.5), "cut.wav": (8000, 1, 16, 0.5)}
    assert {(x.n, x.reason) for x in bad.select(name.alias("n"), "reason").collect()} == {("bad.wav", "not_wav"), ("none.wav", "not_wav"), ("head.wav", "no_samples")}
    segments = prepare.clip_segments(clips, [0.0, 1.0, 4.0])
    chunks = spark.createDataFrame([("one.wav", k * 0.5, k * 0.5 + 0.5, [float(k), 1.0]) for k in range(10)] + [("two.wav", 0.0, 1.5, [8.0, 0.0])], "audio_path string, lo double, hi double, v array<double>")
    model = probe.Probe(np.array([[1.0, 0], [0, 0.5], [1, -3], [-1, 0], [0, 0.25]]), np.zeros(5))
    got = {(x.audio_path, x.slide_id): x for x in probe.score_clips(segments, chunks, model).collect()}
    assert sorted(got) == [("cut.wav", 1), ("one.wav", 1), ("one.wav", 2), ("two.wav", 1), ("two.wav", 2)]
    assert got["one.wav", 1].speech_rate == pytest.approx(0.5) and got["one.wav", 2].speech_rate == pytest.approx(4.5) and got["one.wav", 2].end_sec == 4.0
    assert got["two.wav", 1].speech_rate == pytest.approx(8.0) and got["two.wav", 2].speech_rate is None and got["cut.wav", 1].speech_rate is None
    assert got["one.wav", 1].silence_ratio == pytest.approx(0.5) and got["one.wav", 2].energy_drop == 1
