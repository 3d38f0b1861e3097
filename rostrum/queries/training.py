"""Queries on evaluation and training rows, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import evaluate as ev
from rostrum.operators import prepare as p
from rostrum.sources import adapters as a


def gold_join(spark, sf):
    g = a.gold_pred(spark, sf)
    j = ev.join_gold(g.select("session_id", "slide_id", "gold"), g.where("slide_id % 3 > 0").select("session_id", "slide_id", "pred"))
    return j.withColumn("pred", edge(F.col("pred")))


def coverage_metrics(spark, sf):
    m = ev.coverage_metrics(a.gold_pred(spark, sf))
    return m.select("n", *[edge(F.col(c)).alias(c) for c in ("accuracy", "mae", "correlation")])


def pr_curve(spark, sf):
    m = ev.pr_curve(a.gold_pred(spark, sf))
    return m.select("threshold", *[edge(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def keypoint_pr(spark, sf):
    """Words of the first and second half of each turn as missed keypoints."""
    c = a.table(spark, sf, "conversations")
    w = F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")
    c = c.withColumn("w", w).withColumn("k", F.floor(F.size("w") / 2).cast("int"))
    rows = c.select(F.slice("w", F.lit(1), F.col("k")).alias("gold_missed"), F.filter("w", lambda x, i: i >= F.col("k")).alias("pred_missed"))
    m = ev.missed_metrics(rows)
    return m.select("tp", *[edge(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _times(spark, sf):
    f = a.frames(spark, sf).withColumn("us", F.round(F.col("t") * 1000).cast("long").cast("double"))
    e = a.table(spark, sf, "events").select("event_type", F.col("user_id"), F.col("event_id"))
    g = f.groupBy("session_id").agg(F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("silence"), F.col("us"))))).alias("gold"), F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("energy") > 40, F.col("us"))))).alias("pred"))
    return g


def tolerance_f1(spark, sf):
    """Times of loud frames against times of silent ones, within five thousand units."""
    m = ev.tolerance_matches(_times(spark, sf), 5000.0)
    return m.select("session_id", "tp", edge(F.col("f1")).alias("f1"))


def _probe(spark, sf):
    m = p.targets(a.manifest(spark, sf))
    return m.withColumns({"pred_speech_rate": F.col("speech_rate") * 0.9, "pred_silence_ratio": F.col("silence_ratio") + 0.01, "pred_overall_delivery": F.lit(0.5), "logit_energy_drop": F.col("silence_ratio") * 10 - 0.5, "logit_pitch_shift": F.lit(0.2)})


def probe_loss(spark, sf):
    m = ev.probe_loss(_probe(spark, sf))
    return m.select("n", *[edge(F.col(c)).alias(c) for c in ("regression", "classification", "loss")])


def quality_gate(spark, sf):
    base = _probe(spark, sf).withColumns({f"pred_{k}": F.lit(0.0) for k in ("speech_rate", "silence_ratio", "overall_delivery")} | {"logit_energy_drop": F.lit(0.0), "logit_pitch_shift": F.lit(0.0)})
    i = ev.improvement(ev.probe_loss(_probe(spark, sf)), ev.probe_loss(base))
    return ev.quality_gate(i, 5.0).select(edge(F.col("improvement_pct"), 4).alias("improvement_pct"), "status")


def ablation(spark, sf):
    m = ev.ablation(a.gold_pred(spark, sf), [("base", 1.0, 0.0), ("scaled", 0.5, 0.1), ("flat", 0.0, 0.5)])
    return m.select("experiment", *[edge(F.col(c)).alias(c) for c in ("mae", "correlation")])


def bootstrap_ci(spark, sf):
    return ev.bootstrap(a.gold_pred(spark, sf), "pred")


def pseudo_targets(spark, sf):
    m = p.targets(a.manifest(spark, sf))
    return m.select("audio_path", edge(F.col("speech_rate")).alias("speech_rate"), "silence_ratio", "energy_drop", "pitch_shift", edge(F.col("overall_delivery"), 5).alias("overall_delivery"))


def label_fallback(spark, sf):
    """Pace from word counts and durations, silence guessed, audio names from labels."""
    li = a.table(spark, sf, "lineitem")
    rate = p.speech_rate(F.col("l_quantity"), F.col("l_extendedprice"))
    path = F.when(F.col("l_linenumber") > 1, F.concat(F.lit("a/b/"), F.col("l_orderkey").cast("string"), F.lit(".wav")))
    file = F.concat(F.lit("x/clip_d_"), F.col("l_orderkey").cast("string"), F.lit(".json"))
    return li.select("l_orderkey", "l_linenumber", edge(rate).alias("speech_rate"), edge(p.fallback_silence(rate)).alias("silence_ratio"), p.audio_name(path, file).alias("audio"))


def audio_targets(spark, sf):
    return p.audio_targets(a.frames(spark, sf), ["session_id"]).withColumn("silence_ratio", edge(F.col("silence_ratio")))


def manifest_rows(spark, sf):
    """Binary fields from words and numbers."""
    li = a.table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", p.binary(F.when(F.col("l_returnflag") == "R", "Yes").when(F.col("l_returnflag") == "A", "0").otherwise("maybe")).alias("energy_drop"), p.binary((F.col("l_discount") * 10).cast("decimal(9,2)")).alias("pitch_shift"))


def _labels(spark, sf):
    o = a.table(spark, sf, "orders")
    labels = o.select(F.col("o_orderkey").cast("string").alias("audio_name"), (F.col("o_totalprice") - 20000).alias("duration_ms"))
    li = a.table(spark, sf, "lineitem").where("l_linenumber >= 2")
    return p.match_audio(labels, li.select(F.col("l_orderkey").cast("string").alias("audio_name"), F.concat_ws("/", F.lit("w"), "l_orderkey", "l_linenumber").alias("path")))


def rejects_by_reason(spark, sf):
    return p.rejects(_labels(spark, sf))


def audio_matches(spark, sf):
    return _labels(spark, sf).select("audio_name", "path", "reason")


def split_rows(spark, sf):
    return p.split(a.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", 0.8, 0.1)


def resume_antijoin(spark, sf):
    m = a.manifest(spark, sf)
    return p.resume(m, m.where("energy_drop = 1")).select("audio_path", "pitch_shift")


def upsert_latest(spark, sf):
    x = p.latest(a.requests(spark, sf), "analysis_id")
    return x.select("analysis_id", "status", "score", F.col("seq.key").alias("key"))


def status_current(spark, sf):
    """Where each request is now, with the message of failed ones; every second message is longer than a status keeps."""
    x = p.latest(a.requests(spark, sf), "analysis_id")
    s = F.element_at(F.create_map(*[F.lit(v) for kv in {"O": "running", "F": "done", "P": "failed"}.items() for v in kv]), F.col("status"))
    return x.select("analysis_id", s.alias("state"), F.when(s == "failed", p.error_text(F.repeat(F.concat(F.lit("order "), F.col("seq.key").cast("string"), F.lit(" failed")), (F.col("seq.key") % 2 * 60 + 1).cast("int")))).alias("error"))


def clip_chunks(spark, sf):
    s = a.frame_segments(a.frames(spark, sf))
    c = p.chunks(s, 25.0, 5.0)
    return c.select("session_id", "slide_id", F.col("i").cast("long").alias("i"), edge(F.col("c_lo"), 3).alias("lo"), edge(F.col("c_hi"), 3).alias("hi"))


def boundary_segments(spark, sf):
    w = a.segments(a.words(spark, sf))
    b = w.groupBy("session_id").agg(F.array_sort(F.concat(F.collect_set("start_ms"), F.array(F.max("end_ms")))).alias("b"))
    return p.pairs(b)


def manual_boundaries(spark, sf):
    w = a.segments(a.words(spark, sf))
    g = w.groupBy("session_id").agg(F.array_sort(F.collect_set("start_ms")).alias("b"), F.min("start_ms").alias("first"), F.max("end_ms").alias("last"), F.count("*").alias("n"))
    g = g.withColumn("n_slides", (F.col("n") - F.col("session_id") % 4 + 1).cast("int")).where("n_slides >= 1")
    m = p.manual_boundaries(g)
    return m.select("session_id", F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("b"), "note")


def label_json(spark, sf):
    """Nested values of JSON labels; malformed ones count."""
    e = a.table(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 50 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("json"))
    k = F.try_variant_get(F.try_parse_json("json"), "$.k", "int")
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.try_parse_json("json").isNull()).alias("n_bad"), F.sum(k).alias("total"))


def text_to_words(spark, sf):
    """Words of text-only turns spread evenly over ten seconds a turn."""
    c = a.table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "").alias("w"))
    e = c.select("conv_id", "turn", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    t = lambda k: F.bround((F.col("turn") * 10 + k * 10.0 / F.col("n")), 3)
    return e.select("conv_id", "turn", F.col("i").cast("long").alias("i"), "word", t(F.col("i")).alias("start_sec"), t(F.col("i") + 1).alias("end_sec"))


QUERIES = {f.__name__: f for f in (gold_join, coverage_metrics, pr_curve, keypoint_pr, tolerance_f1, probe_loss, quality_gate, ablation, bootstrap_ci, pseudo_targets, label_fallback, audio_targets, manifest_rows, rejects_by_reason, audio_matches, split_rows, resume_antijoin, upsert_latest, status_current, clip_chunks, boundary_segments, manual_boundaries, label_json, text_to_words)}

_TARGET = """
tg AS (SELECT *, greatest(0, least(1, .45::DOUBLE * exp(-abs(speech_rate - 2.2::DOUBLE) / 1.8::DOUBLE) + .3::DOUBLE * greatest(0, 1 - silence_ratio / .45::DOUBLE) + .25::DOUBLE * greatest(0, 1 - .5::DOUBLE * (energy_drop + pitch_shift)))) AS overall_delivery FROM manifest)"""
_BCE = "(greatest({0}, 0) - ({0}) * {1} + ln(1 + exp(-abs({0}))))"
_LOSS = f"""
ls AS (SELECT count(*) AS n, avg(((speech_rate * .9::DOUBLE - speech_rate) ** 2 + .0001::DOUBLE + (.5::DOUBLE - overall_delivery) ** 2) / 3) AS r, avg(({_BCE.format('(silence_ratio * 10 - .5::DOUBLE)', 'energy_drop')} + {_BCE.format('.2::DOUBLE', 'pitch_shift')}) / 2) AS c,
  avg((speech_rate ** 2 + silence_ratio ** 2 + overall_delivery ** 2) / 3) + ln(2.0::DOUBLE) AS b FROM tg)"""
_PRF = "round_even(coalesce(tp / nullif(np, 0), 0), 6) AS precision, round_even(coalesce(tp / nullif(ng, 0), 0), 6) AS recall, round_even(coalesce(2 * tp / nullif(np + ng, 0), 0), 6) AS f1"
_LATEST = "lt AS (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY analysis_id ORDER BY placed DESC, key DESC) = 1)"
_MATCH = """lb AS (SELECT o_orderkey::VARCHAR AS audio_name, o_totalprice - 20000 AS d FROM orders), au AS (SELECT l_orderkey::VARCHAR AS audio_name, min('w/' || l_orderkey || '/' || l_linenumber) AS path FROM lineitem WHERE l_linenumber >= 2 GROUP BY 1),
mt AS (SELECT audio_name, path, CASE WHEN d <= 0 THEN 'bad_duration' WHEN path IS NULL THEN 'filtered_missing_audio' END AS reason FROM lb LEFT JOIN au USING (audio_name))"""
ORACLE = {
    "gold_join": f"WITH {a.GOLD} SELECT session_id, slide_id, gold, CASE WHEN slide_id % 3 > 0 THEN round_even(pred, 6) ELSE 0 END::DOUBLE AS pred FROM gold_pred",
    "coverage_metrics": f"WITH {a.GOLD} SELECT count(*) AS n, round_even(avg(((gold >= .7) = (pred >= .7))::INT), 6) AS accuracy, round_even(avg(abs(gold - pred)), 6) AS mae, round_even(corr(gold, pred), 6) AS correlation FROM gold_pred",
    "pr_curve": f"WITH {a.GOLD}, t AS (SELECT k / 20.0::DOUBLE AS t, count_if(gold >= k / 20.0::DOUBLE AND pred >= k / 20.0::DOUBLE) AS tp, count_if(pred >= k / 20.0::DOUBLE) AS np, count_if(gold >= k / 20.0::DOUBLE) AS ng FROM gold_pred, range(0, 21) r(k) GROUP BY k) SELECT t AS threshold, {_PRF} FROM t",
    "keypoint_pr": f"""WITH c AS (SELECT list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda y: y <> '') AS w FROM conversations), h AS (SELECT list_distinct(w[1:len(w) // 2]) AS g, list_distinct(w[len(w) // 2 + 1:]) AS p FROM c),
s AS (SELECT sum(len(list_intersect(g, p)))::BIGINT AS tp, sum(len(p)) AS np, sum(len(g)) AS ng FROM h) SELECT tp, {_PRF} FROM s""",
    "probe_loss": f"WITH {a.MANIFEST}, {_TARGET}, {_LOSS} SELECT n, round_even(r, 6) AS regression, round_even(c, 6) AS classification, round_even(r + c, 6) AS loss FROM ls",
    "quality_gate": f"WITH {a.MANIFEST}, {_TARGET}, {_LOSS} SELECT round_even((b - r - c) * 100 / b, 4) AS improvement_pct, 'PendingApproval' AS status FROM ls WHERE (b - r - c) * 100 / b >= 5",
    "ablation": f"WITH {a.GOLD}, e AS (SELECT * FROM (VALUES ('base', 1.0::DOUBLE, 0.0::DOUBLE), ('scaled', .5, .1), ('flat', 0, .5)) v(experiment, x, y)), j AS (SELECT experiment, gold, pred * x + y AS pred FROM gold_pred, e) SELECT experiment, round_even(avg(abs(gold - pred)), 6) AS mae, CASE WHEN stddev_pop(pred) > 0 THEN round_even(corr(gold, pred), 6) ELSE 0 END AS correlation FROM j GROUP BY 1",
    "pseudo_targets": f"WITH {a.MANIFEST}, {_TARGET} SELECT audio_path, round_even(speech_rate, 6) AS speech_rate, silence_ratio, energy_drop, pitch_shift, round_even(overall_delivery, 5) AS overall_delivery FROM tg",
    "label_fallback": """WITH r AS (SELECT *, l_quantity / greatest(1e-6, l_extendedprice / 1000) AS sr FROM lineitem) SELECT l_orderkey, l_linenumber, round_even(sr, 6) AS speech_rate, round_even(greatest(.05::DOUBLE, least(.6::DOUBLE, .45::DOUBLE - .08::DOUBLE * sr)), 6) AS silence_ratio,
  CASE WHEN l_linenumber > 1 THEN l_orderkey || '.wav' ELSE 'clip_a_' || l_orderkey || '.wav' END AS audio FROM r""",
    "audio_targets": f"""WITH {a.FRAMES}, f AS (SELECT *, (energy < max(energy) OVER (PARTITION BY session_id) - 40)::INT AS q FROM frames) SELECT session_id, round_even(avg(q), 6) AS silence_ratio, (coalesce(regr_slope(energy, t), 0) < -.02)::INT AS energy_drop,
  (coalesce(stddev_pop(pitch) FILTER (pitch > 0), 0) > 80 AND count(pitch) FILTER (pitch > 0) > 10)::INT AS pitch_shift FROM f GROUP BY session_id""",
    "manifest_rows": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 END AS energy_drop, ((l_discount * 10)::DECIMAL(9, 2) >= .5)::INT AS pitch_shift FROM lineitem",
    "audio_matches": f"WITH {_MATCH} SELECT * FROM mt",
    "rejects_by_reason": f"WITH {_MATCH} SELECT reason, count(*) AS n, array_to_string(list_sort(list(audio_name))[1:5], ',') AS samples FROM mt WHERE reason IS NOT NULL GROUP BY 1",
    "split_rows": """WITH h AS (SELECT o_orderkey::VARCHAR AS key, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey::VARCHAR || '|42'), 1, 15))::BIGINT) AS r, count(*) OVER () AS n FROM orders)
SELECT key, CASE WHEN r <= floor(n * .8::DOUBLE) THEN 'train' WHEN r <= floor(n * .8::DOUBLE) + floor(n * .1::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM h""",
    "resume_antijoin": f"WITH {a.MANIFEST} SELECT audio_path, pitch_shift FROM manifest WHERE audio_path NOT IN (SELECT audio_path FROM manifest WHERE energy_drop = 1)",
    "upsert_latest": f"WITH {a.REQUESTS}, {_LATEST} SELECT analysis_id, status, score, key FROM lt",
    "status_current": f"WITH {a.REQUESTS}, {_LATEST} SELECT analysis_id, CASE status WHEN 'O' THEN 'running' WHEN 'F' THEN 'done' ELSE 'failed' END AS state, CASE WHEN status = 'P' THEN left(repeat('order ' || key || ' failed', key % 2 * 60 + 1), 500) END AS error FROM lt",
    "clip_chunks": f"""WITH {a.FRAMES}, s AS (SELECT *, hi - lo AS d FROM frame_segments WHERE hi > lo), n AS (SELECT *, greatest(1, floor(d / 25) + CASE WHEN d - floor(d / 25) * 25 >= 5 THEN 1 ELSE 0 END)::INT AS n FROM s),
e AS (SELECT *, unnest(range(0, n)) AS i FROM n) SELECT session_id, slide_id, i, round_even(lo + i * 25, 3) AS lo, round_even(CASE WHEN i = n - 1 THEN hi ELSE lo + i * 25 + 25 END, 3) AS hi FROM e""",
    "boundary_segments": f"""WITH {a.WORDS}, b AS (SELECT session_id, list_sort(list_append(list_distinct(list(start_ms)), max(end_ms))) AS b FROM segments GROUP BY ALL)
SELECT session_id, unnest(range(1, len(b)))::INT AS slide_id, unnest(b[1:len(b) - 1]) AS lo, unnest(b[2:]) AS hi FROM b""",
    "manual_boundaries": f"""WITH {a.WORDS}, g AS (SELECT session_id, list_sort(list_distinct(list(start_ms))) AS b, min(start_ms) AS f, max(end_ms) AS l, (count(*) - session_id % 4 + 1) AS n FROM segments GROUP BY session_id)
SELECT session_id, array_to_string(CASE WHEN len(b) = n + 1 THEN b WHEN len(b) > n + 1 THEN b[1:n + 1] WHEN len(b) = n AND b[1] > f THEN list_prepend(f, b) WHEN len(b) = n THEN list_append(b, l) END, ',') AS b,
  CASE WHEN len(b) = n + 1 THEN '' WHEN len(b) > n + 1 THEN 'truncated_extra_boundaries' WHEN len(b) = n AND b[1] > f THEN 'prepended_transcript_start' WHEN len(b) = n THEN 'appended_transcript_end' ELSE 'error_boundary_count' END AS note FROM g WHERE n >= 1""",
    "label_json": "SELECT user_id, count(*) AS n, count_if(event_id % 50 = 0) AS n_bad, sum(CASE WHEN event_id % 50 <> 0 THEN (props::JSON ->> '$.k')::INT END)::BIGINT AS total FROM events GROUP BY 1",
    "text_to_words": f"""WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda y: y <> '') AS w FROM conversations), e AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM c)
SELECT conv_id, turn, i, word, round_even(turn * 10 + i * 10.0::DOUBLE / n, 3) AS start_sec, round_even(turn * 10 + (i + 1) * 10.0::DOUBLE / n, 3) AS end_sec FROM e""",
}
