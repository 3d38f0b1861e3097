"""Rules on small rows with known results, Hangul ones too, and folds against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.functions import score as s
from rostrum.functions import text as t
from rostrum.operators import anchors, chunking, coherence, deck, evaluate, prepare, report
from rostrum.operators import delivery as d


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def words(spark, rows):
    """(session, word, seconds) to timed words of 0.3 s."""
    return spark.createDataFrame([(x, i, w, int(at * 1000), int(at * 1000) + 300) for i, (x, w, at) in enumerate(rows)], "session_id long, word_idx long, word string, start_ms long, end_ms long")


def test_text_rules_on_hangul(spark):
    rows = [(w,) for w in ("어", "어어", "음", " 그러니까 ", "음악", "그림")]
    assert [x for (x,) in values(spark, rows, "w string", t.is_filler(F.col("w")))] == [True, True, True, True, False, False]
    got = values(spark, [("프로젝트 소개 및 AI 모델 v2.1 50%",)], "w string", t.nouns(F.col("w")), t.syllables(F.col("w")))
    assert got == [(["프로젝트", "소개", "ai", "모델", "v2.1", "50%"], 9)]
    rows = [("• 시장 규모",), ("1. 목표",), ("시 장 규 모",), (" 성과",), ("",), ("보통 줄이다",)]
    assert [x for (x,) in values(spark, rows, "w string", t.content_line(F.col("w")))] == ["시장 규모", "목표", "시장규모", "성과", "", "보통 줄이다"]
    assert [x for (x,) in values(spark, [("12%",), ("3년차",), ("1,000건",), ("시장 분석 결과",), ("2.5+",)], "w string", t.is_metric(F.col("w")))] == [True, True, True, False, True]
    assert [x for (x,) in values(spark, [("팀 소개",), ("시장 규모와 성장 전략",), ("가 나 다",)], "w string", t.short_title(F.col("w")))] == [True, False, True]
    rows = [("팀 소개",), ("목차",), ("Roadmap",), ("고객이 원하는 새로운 서비스 설계",), ("",)]
    assert [x for (x,) in values(spark, rows, "w string", report.actionable_title(F.col("w")))] == [False, False, True, True, False]
    rows = [("VISUAL: image x2",), ("VISUAL: 매출 그래프",), ("table",)]
    assert [x for (x,) in values(spark, rows, "w string", report.generic_visual(F.col("w")))] == [True, False, True]


def test_scores(spark):
    rows = [(x,) for x in (-0.5, 0.4, 0.6, 1.5)]
    assert [round(x, 6) for (x,) in values(spark, rows, "x double", s.score_map(F.col("x")))] == [0, 73.5, 88.5, 100]
    assert values(spark, [(0.3,)], "x double", s.score_map(F.col("x"), []), s.score_map(F.col("x"), [(1.0, 100.0), (0.0, 0.0)])) == [(65.0, 30.0)]
    rows = [(0.057, []), (0.043, []), (0.021, ["low_alignment_confidence"]), (0.03, []), (0.05, []), (None, None)]
    assert [x for (x,) in values(spark, rows, "c double, w array<string>", s.reliability(F.col("c"), F.col("w")))] == ["high", "medium", "low", "medium", "high", "low"]
    assert round(values(spark, [(2.2, 0.1, 0, 1)], "a double, b double, c int, e int", s.overall_delivery(*map(F.col, "abce")))[0][0], 3) == 0.808
    rows = [(1, 1, 0.82, 1.0), (1, 2, 0.62, 1.0), (1, 3, 0.55, 1.0), (2, 1, 0.4, 0.0), (2, 2, 0.9, 0.0)]
    got = coherence.coverage_score(spark.createDataFrame(rows, "session_id long, slide_id int, coverage double, coverage_weight double"))
    got = {r.session_id: r for r in got.collect()}
    assert round(got[1].content_coverage, 2) == 66.33 and round(got[2].content_coverage, 2) == 65 and got[2].content_scored_slide_count == 0


def test_fillers_and_segments(spark):
    w = words(spark, [(1, "안녕", 0), (1, "음", 1), (1, "발표", 2), (1, "어어", 12), (1, "끝", 30)])
    b = spark.createDataFrame([(1, 1, 0, 10_000), (1, 2, 10_000, 20_000), (1, 3, 20_000, 25_000)], "session_id long, slide_id int, start_ms long, end_ms long")
    got = {r.slide_id: (r.word_count, r.filler_count, r.filler_rate) for r in d.fillers_by_time(w, b).collect()}
    assert got == {1: (3, 1, 0.3333), 2: (1, 1, 1.0), 3: (0, 0, 0.0)}  # the word at 30 s is on no slide
    w = words(spark, [(1, "첫", 0.1), (1, "슬라이드", 0.4), (1, "셋째", 10.2)])
    b = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 5000, 10_000), (1, 3, 10_000, 15_000)], "session_id long, slide_id int, start_ms long, end_ms long")
    got = {r.slide_id: (r.text, r.flags) for r in d.segment_words(b, w).collect()}
    assert {k: x[0] for k, x in got.items()} == {1: "첫 슬라이드", 2: "", 3: "셋째"} and got[2][1] and not got[1][1]
    w = words(spark, [(1, "a", 6.0)])
    b = spark.createDataFrame([(1, 1, 0, 5000), (1, 2, 5000, 5000), (1, 3, 5000, 10_000)], "session_id long, slide_id int, start_ms long, end_ms long")
    got = {r.slide_id: r.text for r in d.segment_words(b, w).collect()}
    assert got == {1: "", 2: "", 3: "a"}
    b = spark.createDataFrame([(1, 1, 0, 2000), (1, 2, 2000, 6000), (1, 3, 6000, 14_000)], "session_id long, slide_id int, start_ms long, end_ms long")
    n = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 2)], "session_id long, slide_id int, word_count long")
    r = sorted(d.dwell(b, n).collect(), key=lambda r: r.slide_id)
    assert sum(x.dwell_ratio for x in r) == pytest.approx(1) and r[0].dwell_z < 0 < r[2].dwell_z and [x.word_count for x in r] == [1, 1, 2]


def test_trend_prefers_energy_then_pace(spark):
    f = [(1, i, float(i), 3.0 - i, 100.0, 2.0, False) for i in range(4)] + [(2, i, float(i), 1.0, 100.0, 3.0 - i, False) for i in range(4)]
    frames = spark.createDataFrame(f, "session_id long, frame_idx long, t double, energy double, pitch double, speech_rate_per_sec double, silence boolean")
    seg = spark.createDataFrame([(1, 1, 0.0, 3.0), (2, 1, 0.0, 3.0)], "session_id long, slide_id int, lo double, hi double")
    x = d.segment_features(frames, seg).select("session_id", d.trend(F.col("energy_slope"), F.col("rate_slope")).alias("t"), "speech_rate_per_sec_mean")
    assert {r.session_id: (r.t, r[2]) for r in x.collect()} == {1: ("declining_energy", 2.0), 2: ("decreasing_speed", 1.5)}


def test_uncovered_slides_and_coherence(spark):
    sims = [(1, 1, 0, 1.0, "title", 0, 0.9), (1, 1, 1, 0.5, "bullet", 0, 0.2), (1, 1, 1, 0.5, "bullet", 1, 0.5)]
    b = coherence.best_chunks(spark.createDataFrame([(a, c, k, src, w, ch, x) for a, c, k, w, src, ch, x in sims], "session_id long, slide_id int, kp_idx int, source string, importance double, chunk_idx int, sim double"))
    slides = spark.createDataFrame([(1, 1, 0.8, 200.0), (1, 2, 0.0, 0.0), (1, 3, 0.9, 50.0)], "session_id long, slide_id int, semantic double, n_chars double")
    kps = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0), (1, 2, 1)], "session_id long, slide_id int, kp_idx int")
    got = {r.slide_id: r for r in coherence.coverage(b, slides, kps).collect()}
    assert got[1].keypoint_coverage == pytest.approx(2 / 3) and got[1].missed == [1] and got[1].coverage > got[1].keypoint_coverage
    assert (got[2].coverage, got[2].missed, got[2].presence) == (0.0, [0, 1], 0.0)
    assert (got[3].coverage, got[3].missed, got[3].semantic_coverage) == (0.0, [], 0.0)  # no key points


def test_change_types(spark):
    f = []
    for k, series in enumerate(((5.0, 0.0, 0.0), (0.0, 5.0, 0.0), (0.0, 0.0, 5.0), (0.0, 0.0, -5.0))):
        for i in range(10):
            after = i >= 5
            f.append((k, i, float(i), series[0] * after, series[1] * after, series[2] * after))
    frames = spark.createDataFrame(f, "session_id long, frame_idx long, t double, energy double, pitch double, speech_rate_per_sec double")
    got = {r.session_id: r.type for r in d.type_changes(frames, frames.where("frame_idx = 5")).collect()}
    assert got == {0: "energy_rise", 1: "pitch_shift", 2: "speed_rise", 3: "speed_drop"}


def test_tolerance_matches_equal_times_apart(spark):
    rng = random.Random(1)
    rows = [(1, [3.0, 3.0], [3.1, 2.9]), (2, [], [1.0]), (3, [1.0], []), (4, [5.0, 4.0], [4.5, 5.5])]
    rows += [(10 + i, [rng.randrange(12) / 2 for _ in range(rng.randrange(8))], [rng.randrange(12) / 2 for _ in range(rng.randrange(8))]) for i in range(40)]
    got = {r.session_id: r.tp for r in evaluate.tolerance_matches(spark.createDataFrame(rows, "session_id long, gold array<double>, pred array<double>"), 1.0).collect()}
    for k, gold, pred in rows:
        used = set()
        for x in pred:
            i = next((i for i, g in enumerate(gold) if i not in used and abs(g - x) <= 1.0), None)
            used |= {i} - {None}
        assert got[k] == len(used)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(10, 2, 3000), 1)
    r = evaluate.bootstrap(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 400).first()
    half = 1.96 * x.std() / len(x) ** 0.5
    assert abs(r["mean"] - x.mean()) < half / 3 and abs(r.low - (x.mean() - half)) < half / 2 and abs(r.high - (x.mean() + half)) < half / 2
    one = evaluate.bootstrap(spark.createDataFrame([(4.0,)] * 5000, "x double"), "x", 50).first()
    assert (one["mean"], one.low, one.high) == (4.0, 4.0, 4.0)


def test_sentence_chunks_equal_a_loop(spark):
    rng = random.Random(2)
    rows, at = [], 0.0
    for _ in range(400):
        at += rng.choice([0.3, 0.4, 0.5, 1.4])
        rows.append((1, rng.choice(["word", "끝.", "뭐?", "ok!\"", "more"]), at))
    got = [(r.start_ms, r.end_ms, r.n_words) for r in sorted(chunking.chunks(words(spark, rows), by_sentence=True).collect(), key=lambda r: r.unit_id)]
    c, closed = [], True
    for _, w, x in rows:
        a = int(x * 1000)
        if closed or a - c[-1][1] >= 900 or c[-1][1] - c[-1][0] >= 8000 or c[-1][2] >= 36:
            c.append([a, a + 300, 1])
        else:
            c[-1] = [c[-1][0], a + 300, c[-1][2] + 1]
        closed = w.rstrip('"')[-1] in ".?!"
    out = []
    for x in c:
        if out and (x[1] - x[0] < 2000 or x[2] < 3) and out[-1][1] - out[-1][0] < 12_000:
            out[-1] = [out[-1][0], x[1], out[-1][2] + x[2]]
        else:
            out.append(x)
    if len(out) > 1 and out[0][1] - out[0][0] < 2000:
        out[:2] = [[out[0][0], out[1][1], out[0][2] + out[1][2]]]
    if len(out) > 1 and out[-1][1] - out[-1][0] < 2000:
        out[-2:] = [[out[-2][0], out[-1][1], out[-2][2] + out[-1][2]]]
    assert got == [tuple(x) for x in out] and len(got) > 10


def test_refined_boundaries_equal_a_loop(spark):
    rng = random.Random(3)
    for trial in range(3):
        n, units = 4, 14
        on = sorted(rng.randrange(1, n + 1) for _ in range(units))
        starts = [6.0 * i for i in range(units)]
        titles = {k: [f"t{k}", f"u{k}"] for k in range(1, n + 1)}
        named = {k: "소개" if k == 3 else "제목" for k in titles}
        said = [(u, 8 * u + i, rng.choice(["x", *titles[rng.randrange(1, n + 1)]]), starts[u] + 0.7 * i) for u in range(units) for i in range(8)]
        b = [0.0] + [next((starts[i] for i in range(units) if on[i] >= k), 90.0) for k in range(2, n + 1)] + [90.0]
        want = list(b)
        for k in range(2, n):
            u0 = next((i for i in range(units) if on[i] >= k), None)
            if u0 is None:
                continue
            end = u0
            while end < units and on[end] == on[u0]:
                end += 1
            cue = alone = None
            for u in range(u0, min(end, u0 + 4)):
                w = [x for x in said if x[0] == u]
                for i, x in enumerate(w):
                    if x[2] == titles[k][0]:
                        alone = x[3] if alone is None else alone
                        if cue is None and titles[k][1] in [y[2] for y in w[i : i + 6]]:
                            cue = x[3]
            if cue is None and named[k] == "소개":
                cue = alone
            if cue is not None and cue - starts[u0] >= 1.0:
                want[k - 1] = min(max(cue, want[k - 2]), want[k])
        for i in range(1, len(want)):
            want[i] = max(want[i], want[i - 1])
        got = chunking.refine(
            spark.createDataFrame([(trial, b)], "session_id long, b array<double>"),
            spark.createDataFrame([(trial, i, on[i], starts[i]) for i in range(units)], "session_id long, unit_id long, slide_id int, start_sec double"),
            spark.createDataFrame([(trial, *x) for x in said], "session_id long, unit_id long, word_idx long, token string, start_sec double"),
            spark.createDataFrame([(trial, k, named[k], titles[k]) for k in titles], "session_id long, slide_id int, title string, tokens array<string>"),
        ).first()
        assert got.b == pytest.approx(want)


def test_thanks_and_cover_anchors(spark):
    def run(units, last, title=()):
        u = spark.createDataFrame([(1, i, a, b, x, x.split()) for i, (a, b, x) in enumerate(units)], "session_id long, unit_id long, start_sec double, end_sec double, text string, tokens array<string>")
        sl = spark.createDataFrame([(1, 1, [], "표지"), (1, 2, list(title), "내용"), (1, 3, [], last)], "session_id long, slide_id int, title_tokens array<string>, text string")
        a = anchors.edge_anchors(u, sl)
        r = a.first()
        on = spark.createDataFrame([(1, i, 2 if i else 1) for i in range(len(units))], "session_id long, unit_id long, slide_id int")
        held = anchors.apply_anchors(on, u, a, spark.createDataFrame([(1, 3)], "session_id long, n_slides int"))
        return r.cover_end_sec, r.thanks_start_sec, [x.slide_id for x in sorted(held.collect(), key=lambda x: x.unit_id)]

    talk = [(0.0, 4.0, "안녕하세요"), (4.0, 60.0, "본론"), (60.0, 101.0, "결론"), (101.0, 104.0, "감사 합니다")]
    assert run(talk, "감사합니다") == (4.0, 101.0, [1, 2, 2, 3])
    early = [(0.0, 2.0, "감사합니다"), (2.0, 9.0, "시장 규모"), (9.0, 95.0, "끝")]
    assert run(early, "Thank you") == (9.0, 95.0, [1, 1, 2])  # anchored at the end: nothing is on the last slide
    assert run(early, "요약", ("시장",)) == (2.0, None, [1, 2, 2])


def test_snapshot_counts(spark):
    issue_rows = spark.createDataFrame([(1, 1, "title_missing"), (1, 1, "content_gap"), (1, 2, "visual_not_explained"), (1, 2, "filler_many")], "session_id long, slide_id int, issue string")
    sev = spark.createDataFrame([(1, 1, 6, "title_missing,content_gap"), (1, 2, 3, "visual_not_explained,filler_many"), (1, 3, 9, "filler_many")], "session_id long, slide_id int, severity int, issues string")
    texts = spark.createDataFrame([(1, "high", "자동 매칭 신뢰도가 낮습니다"), (1, "low", "x")], "session_id long, severity string, text string")
    slides = spark.createDataFrame([(1, 1, "cover", 0.0, 0.9), (1, 2, "content", 1.0, 0.31234567), (1, 3, "content", 1.0, None)], "session_id long, slide_id int, role string, coverage_weight double, coverage double")
    al = spark.createDataFrame([(1, 0.0432196, 2, 4)], "session_id long, confidence double, n_warnings int, n_boundaries int")
    got = {(r.section, r.key): r.value for r in report.calibration_snapshot(issue_rows, sev, texts, slides, al).collect()}
    assert got[("ce_issue", "total")] == 3 and got[("ce_issue", "high_sections")] == 1 and got[("issue", "total")] == 4
    assert got[("role", "content")] == 2 and got[("slides", "content")] == 1 and got[("score", "coverage_min")] == 0.3123
    assert got[("feedback", "low_confidence")] == 1 and got[("score", "confidence")] == 0.0432
    base = spark.createDataFrame([("ce_issue", "total", 5.0), ("issue", "title_missing", 2.0), ("score", "coverage_max", 0.5)], "section string, key string, value double")
    now = report.calibration_snapshot(issue_rows, sev, texts, slides, al).drop("session_id")
    got = {(r.section, r.key): r.delta for r in report.delta(now, base).collect()}
    assert got[("ce_issue", "total")] == -2 and got[("issue", "title_missing")] == -1 and got[("score", "coverage_max")] == pytest.approx(0.4)


def test_captions_textrank_and_merge(spark):
    c = spark.createDataFrame([(1, 1, "chart", "bar", None, "매출이 늘었다", "", ["AI", "ai"], ["매출"])], "deck long, slide int, slide_type string, visual_kind string, role_in_flow string, main_claim string, visual_summary string, entities array<string>, keywords array<string>")
    k = spark.createDataFrame([(1, 1, "title", "매출", 1.0), (1, 1, "vlm_claim", "매출이 늘었다", 0.1)], "deck long, slide int, source string, text string, importance double")
    terms = spark.createDataFrame([(1, ["고객"])], "deck long, terms array<string>")
    got = {(r.source, r.text.lower()): r.importance for r in deck.caption_keypoints(k, c, terms).collect()}
    assert got == {("title", "매출"): 1.0, ("vlm_claim", "매출이 늘었다"): 0.95, ("vlm_slide_type", "chart"): 0.25, ("vlm_visual_kind", "bar"): 0.2, ("vlm_entity", "ai"): 0.45, ("vlm_keyword", "매출"): 0.45, ("vlm_core_term", "고객"): 0.35}
    p = spark.createDataFrame([(1, 0.0, "a", 1.0), (1, 1.5, "b", 3.0), (1, 3.4, "c", 2.0), (1, 3.6, "d", 1.0), (2, 5.0, "e", 1.0)], "session_id long, t double, type string, magnitude double")
    assert sorted((r.session_id, r.type) for r in d.merge_changes(p).collect()) == [(1, "b"), (1, "d"), (2, "e")]
    ch = spark.createDataFrame([(1, 1, 0.0, 70.0), (1, 2, 0.0, 52.0)], "session_id long, slide_id int, lo double, hi double")
    assert [(r.c_lo, r.c_hi) for r in sorted(prepare.chunks(ch.where("slide_id = 1")).collect(), key=lambda r: r.c_lo)] == [(0, 25), (25, 50), (50, 70)]
    assert [(r.c_lo, r.c_hi) for r in sorted(prepare.chunks(ch.where("slide_id = 2"), 25.0, 5.0).collect(), key=lambda r: r.c_lo)] == [(0, 25), (25, 52)]
    lines = spark.createDataFrame([(1, 1, "첫째 줄. 둘째 줄! " + "가" * 130 + "\n끝",)], "session_id long, slide_id int, text string")
    assert [r.text for r in sorted(chunking.pack_sentences(lines).collect(), key=lambda r: r.chunk_idx)] == ["첫째 줄. 둘째 줄!", "가" * 130, "끝"]


def test_textrank_against_plain_loops(spark):
    pages = {(1, 1): ["red green blue", "green blue grey", "blue", "", "red red black", "lone words here"], (1, 2): ["one two", "three four"], (2, 1): ["매출 성장", "매출 감소 성장", "고객 성장", "고객"]}
    df = spark.createDataFrame([(deck_no, s, i, x) for (deck_no, s), lines in pages.items() for i, x in enumerate(lines)], "deck long, slide int, line_idx int, line string")
    want = {}
    for key, lines in pages.items():
        words = [[w for w in x.split() if len(w) > 1] for x in lines]
        some = sum(1 for x in lines if x.strip())
        df_of = {w: sum(w in x for x in words) for x in words for w in x}
        vec = []
        for x in words:
            v = {w: x.count(w) * (math.log((1 + some) / (1 + df_of[w])) + 1) for w in x}
            norm = math.sqrt(sum(y * y for y in v.values())) or 1.0
            vec.append({w: y / norm for w, y in v.items()})
        at = [i for i, v in enumerate(vec) if v]
        sim = {(i, j): sum(y * vec[j].get(w, 0.0) for w, y in vec[i].items()) for i in at for j in at if i != j}
        out = {i: sum(sim[i, j] for j in at if j != i) for i in at}
        score = dict.fromkeys(at, 1.0)
        for _ in range(50):
            score = {j: 0.15 + 0.85 * sum(score[i] * sim[i, j] / out[i] for i in at if i != j and sim[i, j] > 0) for j in at}
        for rank, i in enumerate(sorted(at, key=lambda i: (-round(score[i], 9), i))[:3]):
            want[(*key, i)] = (rank + 1, score[i])
    got = {(r.deck, r.slide, r.line_idx): (r["rank"], r.score) for r in deck.textrank(deck.tfidf(df)).collect()}
    assert got.keys() == want.keys()
    for k, (rank, score) in want.items():
        assert got[k][0] == rank and got[k][1] == pytest.approx(score)
