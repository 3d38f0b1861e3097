"""Queries on delivery, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import delivery as d
from rostrum.operators.intervals import inside
from rostrum.sources import adapters as a

#: Latin stand-ins for filler words and syllables, as the talks at hand have no Hangul.
LATIN, VOWELS = ("the", "that", "que", "der"), "[aeiouy]+"


def word_source(spark, sf):
    return a.words(spark, sf)


def filler_stats(spark, sf):
    return d.filler_stats(a.words(spark, sf), LATIN)


def dwell_stats(spark, sf):
    w = a.words(spark, sf)
    n = w.groupBy("session_id", "slide_id").agg(F.count("*").alias("word_count"))
    s = d.dwell(a.segments(w), n)
    return s.select("session_id", "slide_id", "word_count", *[edge(F.col(c)).alias(c) for c in ("dwell_sec", "dwell_ratio", "dwell_z", "words_per_sec")])


def word_segments(spark, sf):
    w = a.words(spark, sf)
    return d.segment_words(a.segments(w), w)


def _slides(spark, sf):
    w = a.words(spark, sf)
    f = d.filler_stats(w, LATIN).select("session_id", "slide_id", "word_count", "filler_count")
    return d.dwell(a.segments(w), f.drop("filler_count")).join(f.drop("word_count"), ["session_id", "slide_id"], "left")


def delivery_score(spark, sf):
    s = d.stability(_slides(spark, sf))
    return s.select("session_id", "n_slides", *[edge(F.col(c)).alias(c) for c in ("speech_rate", "filler", "dwell", "delivery_stability")])


def pacing(spark, sf):
    s = d.pacing(_slides(spark, sf).withColumnRenamed("words_per_sec", "rate"))
    return s.withColumn("pacing_score", edge(F.col("pacing_score")))


def _features(spark, sf):
    f = a.frames(spark, sf)
    return f, d.segment_features(f, a.frame_segments(f))


def segment_features(spark, sf):
    return _features(spark, sf)[1].select("session_id", "slide_id", "n_frames", *[edge(F.col(c)).alias(c) for c in ("energy_mean", "pitch_mean", "speech_rate_per_sec_mean", "silence_ratio")])


def trend_labels(spark, sf):
    return _features(spark, sf)[1].select("session_id", "slide_id", d.trend(F.col("energy_slope"), F.col("rate_slope"), 0.01).alias("trend"), edge(F.col("rate_slope"), 5).alias("rate_slope"), edge(F.col("energy_slope"), 5).alias("slope"))


def anomaly_flags(spark, sf):
    s = d.anomalies(*_features(spark, sf), threshold=0.5)
    return s.withColumn("energy_z", edge(F.col("energy_z")))


def speech_rate_frames(spark, sf):
    w = a.words(spark, sf)
    times = w.where("word_idx % 5 = 0").select("session_id", (F.col("word_idx") / 5).cast("long").alias("frame_idx"), (F.col("start_ms") / 1000.0).alias("t"))
    return d.speech_rate(times, w, 2.0, VOWELS)


def change_point_types(spark, sf):
    f = a.frames(spark, sf)
    s = d.type_changes(f, f.where(F.col("silence")))
    return s.select("session_id", "frame_idx", "type", edge(F.col("magnitude"), 5).alias("magnitude"))


def change_points_merged(spark, sf):
    f = a.frames(spark, sf)
    return d.merge_changes(f.where(F.col("silence")).select("session_id", "t", F.lit("energy_drop").alias("type"), F.col("energy").alias("magnitude")), 6.0).groupBy("session_id").agg(F.count("*").alias("n"), edge(F.min("t")).alias("first"))


def pitch_selected(spark, sf):
    """Slides (every fifth frame is one's) whose pitch moves most among the changes."""
    from rostrum.operators.report import pitch_slides

    c = change_point_types(spark, sf).withColumn("slide_id", (F.col("frame_idx") % 5 + 1).cast("int"))
    s = pitch_slides(c, c.select("session_id").distinct().withColumn("n_slides", F.lit(5)))
    return s.withColumn("pitch_score", edge(F.col("pitch_score"), 5))


def segment_events(spark, sf):
    """Silent frames (closed ends) and other frames (half-open) of each span, counted apart so that nothing multiplies."""
    f = a.frames(spark, sf)
    s = a.frame_segments(f)
    closed = inside(f.where(F.col("silence")), s).groupBy("session_id", "slide_id").agg(F.count("*").alias("n_silent"))
    half = inside(f.where(~F.col("silence")), s, closed=False).groupBy("session_id", "slide_id").agg(F.count("*").alias("n_other"))
    out = s.join(closed, ["session_id", "slide_id"], "left").join(half, ["session_id", "slide_id"], "left")
    return out.select("session_id", "slide_id", F.coalesce("n_silent", F.lit(0)).alias("n_silent"), F.coalesce("n_other", F.lit(0)).alias("n_other"))


QUERIES = {f.__name__: f for f in (word_source, filler_stats, dwell_stats, word_segments, delivery_score, pacing, segment_features, trend_labels, anomaly_flags, speech_rate_frames, change_point_types, change_points_merged, pitch_selected, segment_events)}

_FILLER = "regexp_full_match(lower(trim(word)), '(the|that|que|der)')"
_SLIDES = f"""
fil AS (SELECT session_id, slide_id, count(*) AS word_count, count_if({_FILLER}) AS filler_count FROM words GROUP BY ALL),
dw0 AS (SELECT s.session_id, s.slide_id, greatest(0.0::DOUBLE, (end_ms - start_ms) / 1000.0::DOUBLE) AS dwell_sec, coalesce(word_count, 0) AS word_count, filler_count FROM segments s LEFT JOIN fil USING (session_id, slide_id)),
dw AS (SELECT *, coalesce(dwell_sec / nullif(sum(dwell_sec) OVER w, 0), 0) AS dwell_ratio,
  CASE WHEN stddev_pop(dwell_sec) OVER w > 1e-8 THEN (dwell_sec - avg(dwell_sec) OVER w) / stddev_pop(dwell_sec) OVER w ELSE 0 END AS dwell_z,
  word_count / greatest(dwell_sec, 0.1::DOUBLE) AS words_per_sec FROM dw0 WINDOW w AS (PARTITION BY session_id))"""
_FEATURES = """
feat AS (SELECT session_id, slide_id, count(*) AS n_frames, avg(energy) AS energy_mean, avg(pitch) AS pitch_mean, avg(speech_rate_per_sec) AS rate_mean, avg(silence::INT::DOUBLE) AS silence_ratio,
  CASE WHEN stddev_pop(t) > 0 THEN regr_slope(energy, t) END AS energy_slope, CASE WHEN stddev_pop(t) > 0 THEN regr_slope(speech_rate_per_sec, t) END AS rate_slope
  FROM frame_segments JOIN frames USING (session_id) WHERE t BETWEEN lo AND hi GROUP BY ALL)"""
_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"

ORACLE = {
    "word_source": f"WITH {a.WORDS} SELECT * FROM words",
    "filler_stats": f"""WITH {a.WORDS}, f AS (SELECT session_id, slide_id, count(*) AS word_count, count_if({_FILLER}) AS filler_count FROM words GROUP BY ALL)
SELECT *, round_even(filler_count / word_count, 4) AS filler_rate, (sum(filler_count) OVER w)::BIGINT AS total_fillers, round_even(sum(filler_count) OVER w / sum(word_count) OVER w, 4) AS session_rate FROM f WINDOW w AS (PARTITION BY session_id)""",
    "dwell_stats": f"""WITH {a.WORDS}, {_SLIDES} SELECT session_id, slide_id, word_count, round_even(dwell_sec, 6) AS dwell_sec, round_even(dwell_ratio, 6) AS dwell_ratio, round_even(dwell_z, 6) AS dwell_z, round_even(words_per_sec, 6) AS words_per_sec FROM dw""",
    "word_segments": f"""WITH {a.WORDS} SELECT s.session_id, s.slide_id, s.start_ms, s.end_ms, coalesce(string_agg(word, ' ' ORDER BY word_idx), '') AS text, count(word)::INT AS word_count,
  CASE WHEN count(word) = 0 THEN 'empty_segment' ELSE '' END AS flags FROM segments s LEFT JOIN words w ON w.session_id = s.session_id AND w.start_ms >= s.start_ms AND w.start_ms < s.end_ms GROUP BY ALL""",
    "delivery_score": f"""WITH {a.WORDS}, {_SLIDES}, c AS (SELECT session_id, count(*) AS n_slides,
  avg(CASE WHEN words_per_sec BETWEEN 2 AND 5 THEN 1 WHEN words_per_sec < 2 THEN {_CLAMP.format("(words_per_sec - 0.5) / 1.5")} ELSE {_CLAMP.format("(7 - words_per_sec) / 2")} END) AS speech_rate,
  avg(CASE WHEN word_count <= 0 THEN 1 WHEN filler_count / word_count <= 0.02 THEN 1 ELSE {_CLAMP.format("(0.05 - filler_count / word_count) / 0.03")} END) AS filler,
  avg(CASE WHEN abs(dwell_z) <= 1.5 THEN 1 ELSE {_CLAMP.format("(3 - abs(dwell_z)) / 1.5")} END) AS dwell FROM dw GROUP BY session_id)
SELECT session_id, n_slides, round_even(speech_rate, 6) AS speech_rate, round_even(filler, 6) AS filler, round_even(dwell, 6) AS dwell,
  round_even(greatest(0, least(100, (speech_rate * .25::DOUBLE + filler * .15::DOUBLE + dwell * .1::DOUBLE) / .5::DOUBLE * 100)), 6) AS delivery_stability FROM c""",
    "pacing": f"""WITH {a.WORDS}, {_SLIDES} SELECT session_id, count(*) AS n_slides, round_even(CASE WHEN count(*) < 2 THEN 70 WHEN avg(words_per_sec) <= 1e-6 THEN 50
  ELSE greatest(0, 100 * (1 - least(stddev_pop(words_per_sec) / (avg(words_per_sec) + 1e-8), 1))) END::DOUBLE, 6) AS pacing_score FROM dw GROUP BY session_id""",
    "segment_features": f"WITH {a.FRAMES}, {_FEATURES} SELECT session_id, slide_id, n_frames, round_even(energy_mean, 6) AS energy_mean, round_even(pitch_mean, 6) AS pitch_mean, round_even(rate_mean, 6) AS speech_rate_per_sec_mean, round_even(silence_ratio, 6) AS silence_ratio FROM feat",
    "trend_labels": f"""WITH {a.FRAMES}, {_FEATURES} SELECT session_id, slide_id, CASE WHEN energy_slope < -.01 THEN 'declining_energy' WHEN energy_slope > .01 THEN 'rising_energy' WHEN rate_slope > .01 THEN 'increasing_speed' WHEN rate_slope < -.01 THEN 'decreasing_speed' ELSE 'stable' END AS trend, round_even(rate_slope, 5) AS rate_slope, round_even(energy_slope, 5) AS slope FROM feat""",
    "anomaly_flags": f"""WITH {a.FRAMES}, {_FEATURES}, g AS (SELECT session_id, avg(energy) AS em, stddev_pop(energy) AS es, avg(pitch) AS pm, stddev_pop(pitch) AS ps, avg(speech_rate_per_sec) AS rm, stddev_pop(speech_rate_per_sec) AS rs FROM frames GROUP BY ALL),
z AS (SELECT session_id, slide_id, (energy_mean - em) / (es + 2e-8) AS ez, (pitch_mean - pm) / (ps + 2e-8) AS pz, (rate_mean - rm) / (rs + 2e-8) AS rz FROM feat JOIN g USING (session_id))
SELECT session_id, slide_id, concat_ws(',', CASE WHEN abs(ez) > 0.5 THEN 'energy_z>0.5' END, CASE WHEN abs(pz) > 0.5 THEN 'pitch_z>0.5' END, CASE WHEN abs(rz) > 0.5 THEN 'speech_rate_per_sec_z>0.5' END) AS flags, ((abs(ez) > 0.5)::INT + (abs(pz) > 0.5)::INT + (abs(rz) > 0.5)::INT) AS n_flags, round_even(ez, 6) AS energy_z FROM z""",
    "speech_rate_frames": f"""WITH {a.WORDS}, f AS (SELECT session_id, word_idx // 5 AS frame_idx, start_ms AS ms FROM words WHERE word_idx % 5 = 0)
SELECT f.session_id, f.frame_idx, f.ms / 1000.0::DOUBLE AS t, coalesce(sum(len(regexp_extract_all(word, '[aeiouy]+'))), 0) / 2.0::DOUBLE AS rate
FROM f LEFT JOIN words w ON w.session_id = f.session_id AND (w.start_ms + w.end_ms) / 2 BETWEEN ms - 1000 AND ms + 1000 GROUP BY ALL""",
    # fixed rule: the series that moves most names the change; pitch has no direction, pace is called speed
    "change_point_types": f"""WITH {a.FRAMES}, z AS (SELECT *, (energy - avg(energy) OVER s) / (stddev_pop(energy) OVER s + 1e-8) AS ez, (pitch - avg(pitch) OVER s) / (stddev_pop(pitch) OVER s + 1e-8) AS pz,
  (speech_rate_per_sec - avg(speech_rate_per_sec) OVER s) / (stddev_pop(speech_rate_per_sec) OVER s + 1e-8) AS rz FROM frames WINDOW s AS (PARTITION BY session_id)),
m AS (SELECT session_id, frame_idx, silence, avg(ez) OVER n - avg(ez) OVER p AS em, avg(pz) OVER n - avg(pz) OVER p AS pm, avg(rz) OVER n - avg(rz) OVER p AS rm FROM z
  WINDOW n AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), p AS (PARTITION BY session_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, greatest(abs(em), abs(pm), abs(rm)) AS top FROM m WHERE silence AND em IS NOT NULL)
SELECT session_id, frame_idx, CASE WHEN abs(em) = top THEN CASE WHEN em < 0 THEN 'energy_drop' ELSE 'energy_rise' END WHEN abs(pm) = top THEN 'pitch_shift' WHEN rm < 0 THEN 'speed_drop' ELSE 'speed_rise' END AS type, round_even(top, 5) AS magnitude FROM g""",
    "segment_events": f"""WITH {a.FRAMES} SELECT s.session_id, s.slide_id, count_if(silence AND t BETWEEN lo AND hi) AS n_silent, count_if(NOT silence AND t >= lo AND t < hi) AS n_other FROM frame_segments s JOIN frames USING (session_id) GROUP BY ALL""",
}
ORACLE["pitch_selected"] = f"""WITH c AS ({ORACLE["change_point_types"]}), g AS (SELECT session_id, (frame_idx % 5 + 1)::INT AS slide_id, sum(abs(magnitude)) AS s FROM c WHERE type LIKE 'pitch%' GROUP BY ALL HAVING sum(abs(magnitude)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round_even(s, 9) DESC, slide_id) AS r FROM g) SELECT session_id, slide_id, round_even(s, 5) AS pitch_score FROM r WHERE r <= 2"""
