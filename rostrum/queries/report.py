"""Queries on reports, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import score as sc
from rostrum.functions.score import edge
from rostrum.operators import delivery as dl
from rostrum.operators import report as r
from rostrum.sources import adapters as a

TERMS = [("the ", "a "), ("and", "&")]


def score_curve(spark, sf):
    g = a.gold_pred(spark, sf)
    return g.select("session_id", "slide_id", edge(sc.score_map(F.col("pred"))).alias("score"))


def reliability(spark, sf):
    """Reliability of each order's discount-like confidence and status warnings."""
    m = a.table(spark, sf, "orders")
    conf = (F.col("o_orderkey") % 100) / 1000.0
    warn = F.array_compact(F.array(F.when(F.col("o_orderstatus") == "P", "low_alignment_confidence"), F.when(F.col("o_orderstatus") == "F", "robust_fallback_applied")))
    return m.select("o_orderkey", sc.reliability(F.when(F.col("o_orderkey") % 7 > 0, conf), warn).alias("level"), F.coalesce(F.when(F.col("o_orderkey") % 7 > 0, conf) < r.LOW_CONFIDENCE, F.lit(False)).alias("low"))


def _slides(spark, sf):
    """Slides with content from documents and labels, and delivery from the talk of the same number."""
    g = a.gold_pred(spark, sf).withColumn("n", F.col("session_id") * 10 + F.col("slide_id"))
    miss = lambda k, v: F.when(F.col("n") % k == 0, F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    ce = g.select("session_id", "slide_id", F.col("pred").alias("coverage"), F.col("pred").alias("semantic_coverage"), (F.col("pred") * F.col("gold")).alias("keypoint_coverage"), miss(3, "Title: goals").alias("title_missed"), miss(5, "bullet").alias("bullet_missed"), F.array_union(miss(2, "text point"), miss(7, "VISUAL: sales by year")).alias("missed"), (F.col("n") % 4 == 0).alias("low_confidence"), (F.col("slide_id") == 1).alias("suppress_title"), (F.col("slide_id") == 1).alias("suppress_content"))
    w = a.words(spark, sf)
    n = w.groupBy("session_id", "slide_id").agg(F.count("*").alias("word_count"))
    ae = dl.dwell(a.segments(w), n).select("session_id", "slide_id", "dwell_z", (F.col("word_count") % 10 / 20.0).alias("silence_ratio"), F.when(F.col("word_count") % 3 == 0, "decreasing_speed").when(F.col("word_count") % 5 == 0, "increasing_speed").otherwise("stable").alias("trend"), (F.col("word_count") % 6).alias("filler_count"), (F.col("word_count") % 11 == 0).alias("pitch"))
    return r.join_sides(ce, ae)


def _issues(spark, sf):
    return r.issues(_slides(spark, sf), dwell_short=-1.0, dwell_long=1.2)


def ce_ae_join(spark, sf):
    return _slides(spark, sf).select("session_id", "slide_id", "has_ce", "has_ae", edge(F.col("coverage")).alias("coverage"), edge(F.col("dwell_z")).alias("dwell_z"))


def issues(spark, sf):
    return _issues(spark, sf).select("session_id", "slide_id", "ord", "issue", "low_confidence")


def severity(spark, sf):
    return r.severity(_issues(spark, sf))


def highlights(spark, sf):
    return r.highlights(r.severity(_issues(spark, sf)))


def _templates(spark, sf):
    """Templates named after issues: one per supplier nation's number, so the table is read, not made up."""
    names = ["content_gap_high", "content_gap_mid", "content_gap_low", "title_missing", "title_missing_low_confidence", "bullet_missing", "silence_excess", "speed_drop", "filler_many", "visual_not_explained_low_confidence"]
    n = a.table(spark, sf, "nation").where(F.col("n_nationkey") < len(names))
    return n.select(F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") + 1).cast("int")).alias("id"), F.when(F.col("n_regionkey") < 2, "high").otherwise("medium").alias("severity"), F.concat(F.col("n_name"), F.lit(": {issue} on slide {slide_id}")).alias("text"))


def feedback_text(spark, sf):
    return r.feedback(_issues(spark, sf), _templates(spark, sf))


def _overall(spark, sf):
    g = a.gold_pred(spark, sf).groupBy("session_id").agg((F.avg("pred") * 100).alias("content_coverage"))
    w = a.words(spark, sf)
    n = w.groupBy("session_id", "slide_id").agg(F.count("*").alias("word_count"))
    s = dl.dwell(a.segments(w), n)
    return r.overall(g, dl.stability(s), dl.pacing(s.withColumnRenamed("words_per_sec", "rate")))


def overall_scores(spark, sf):
    return _overall(spark, sf)


def service_result(spark, sf):
    return r.service_result(_overall(spark, sf), r.severity(_issues(spark, sf)))


def strengths(spark, sf):
    o = _overall(spark, sf)
    return r.strengths(o).join(o.select("session_id", r.connection_label(F.col("content_coverage_user")).alias("connection")), "session_id")


def term_replacement(spark, sf):
    c = a.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.md5(r.replace_terms(F.col("text"), TERMS).cast("binary")).alias("text_md5"))


def issue_scope(spark, sf):
    c = a.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("slide_id"), F.col("text").alias("comment"))
    return r.scoped_comments(c, _issues(spark, sf), "(?i)the|que").select("session_id", "slide_id", F.md5(F.col("comment").cast("binary")).alias("comment_md5"))


def compact_report(spark, sf):
    c = a.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("slide_id"), F.col("text"))
    s = c.join(r.severity(_issues(spark, sf)).select("session_id", "slide_id", "severity"), ["session_id", "slide_id"])
    return r.compact_report(s, 3, 40).select("session_id", "slide_id", "rank", "severity", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _cases(spark, sf):
    i = _issues(spark, sf)
    return i.select((F.col("session_id") % 2).alias("case"), "issue", F.when(F.col("slide_id") == 1, "cover").otherwise("content").alias("role"))


def report_snapshot(spark, sf):
    return r.snapshot(_cases(spark, sf))


def snapshot_delta(spark, sf):
    s = r.snapshot(_cases(spark, sf))
    return r.delta(s.where("case = 1"), s.where("case = 0"))


def report_json(spark, sf):
    """Reports as JSON and back."""
    o = _overall(spark, sf)
    j = o.select("session_id", F.to_json(F.struct("content_coverage", "summary")).alias("json"))
    return j.select("session_id", F.from_json("json", "content_coverage double, summary string").alias("x")).select("session_id", "x.content_coverage", "x.summary")


QUERIES = {f.__name__: f for f in (score_curve, reliability, ce_ae_join, issues, severity, highlights, feedback_text, overall_scores, service_result, strengths, term_replacement, issue_scope, compact_report, report_snapshot, snapshot_delta, report_json)}

_DWELL = f"""{a.WORDS},
dn AS (SELECT session_id, slide_id, count(*) AS word_count FROM words GROUP BY ALL),
d0 AS (SELECT s.session_id, s.slide_id, greatest(0.0::DOUBLE, (end_ms - start_ms) / 1000.0::DOUBLE) AS dwell_sec, coalesce(word_count, 0) AS word_count FROM segments s LEFT JOIN dn USING (session_id, slide_id)),
ae AS (SELECT *, CASE WHEN stddev_pop(dwell_sec) OVER w > 1e-8 THEN (dwell_sec - avg(dwell_sec) OVER w) / stddev_pop(dwell_sec) OVER w ELSE 0 END AS dwell_z, word_count / greatest(dwell_sec, .1::DOUBLE) AS rate FROM d0 WINDOW w AS (PARTITION BY session_id))"""
_SLIDES = f"""{_DWELL}, {a.GOLD},
ce AS (SELECT *, session_id * 10 + slide_id AS n, true AS has_ce FROM gold_pred),
sl AS (SELECT coalesce(ce.session_id, ae.session_id) AS session_id, coalesce(ce.slide_id, ae.slide_id) AS slide_id, coalesce(has_ce, false) AS has_ce, ae.session_id IS NOT NULL AS has_ae, pred AS coverage, pred * gold AS kc, n, word_count AS wc, dwell_z,
  coalesce(has_ce AND pred < .5 AND pred * gold <= .5, false) AS ok, coalesce(ce.slide_id, 0) = 1 AS hush, coalesce(n % 4 = 0, false) AS low FROM ce FULL JOIN ae ON ce.session_id = ae.session_id AND ce.slide_id = ae.slide_id),
iss AS (SELECT session_id, slide_id, coverage, low, unnest(list_filter([
  CASE WHEN ok AND n % 3 = 0 AND NOT hush THEN {{'ord': 0, 'issue': 'title_missing'}} END,
  CASE WHEN ok AND n % 5 = 0 AND NOT hush THEN {{'ord': 1, 'issue': 'bullet_missing'}} END,
  CASE WHEN ok AND n % 5 <> 0 AND n % 2 = 0 AND n % 3 <> 0 AND NOT hush THEN {{'ord': 2, 'issue': 'content_gap'}} END,
  CASE WHEN has_ce AND n % 7 = 0 AND NOT hush THEN {{'ord': 3, 'issue': 'visual_not_explained'}} END,
  CASE WHEN wc % 10 / 20.0::DOUBLE > .3 THEN {{'ord': 4, 'issue': 'silence_excess'}} END,
  CASE WHEN wc % 3 = 0 THEN {{'ord': 5, 'issue': 'speed_drop'}} END,
  CASE WHEN wc % 3 <> 0 AND wc % 5 = 0 THEN {{'ord': 6, 'issue': 'speed_rise'}} END,
  CASE WHEN wc % 6 >= 3 THEN {{'ord': 7, 'issue': 'filler_many'}} END,
  CASE WHEN wc % 11 = 0 THEN {{'ord': 8, 'issue': 'pitch_shift'}} END,
  CASE WHEN dwell_z < -1.0 THEN {{'ord': 9, 'issue': 'dwell_short'}} END,
  CASE WHEN dwell_z > 1.2 THEN {{'ord': 10, 'issue': 'dwell_long'}} END], lambda x: x IS NOT NULL)) AS i FROM sl),
isr AS (SELECT session_id, slide_id, coverage, i.ord AS ord, i.issue AS issue, low AND i.ord <= 3 AS low_confidence FROM iss),
sev AS (SELECT session_id, slide_id, sum(CASE WHEN low_confidence THEN greatest(1, w - 2) ELSE w END)::BIGINT AS severity, string_agg(issue, ',' ORDER BY ord) AS issues
  FROM (SELECT *, CASE issue WHEN 'content_gap' THEN 3 WHEN 'title_missing' THEN 3 WHEN 'bullet_missing' THEN 2 WHEN 'speed_drop' THEN 2 WHEN 'visual_not_explained' THEN 2 ELSE 1 END AS w FROM isr) GROUP BY ALL)"""


def _curve(x: str) -> str:
    parts = [f"WHEN {x} <= 0 THEN 0"]
    parts += [f"WHEN {x} <= {x1}::DOUBLE THEN {y0} + ({y1} - {y0}) * ({x} - {x0}::DOUBLE) / ({x1}::DOUBLE - {x0}::DOUBLE)" for (x0, y0), (x1, y1) in zip(sc.CURVE, sc.CURVE[1:], strict=False)]
    return f"CASE {' '.join(parts)} ELSE 100 END::DOUBLE"


_OVERALL = f"""{_DWELL}, {a.GOLD},
oc AS (SELECT session_id, avg(pred) * 100 AS cc FROM gold_pred GROUP BY ALL),
od AS (SELECT session_id, greatest(0, least(100, (avg(CASE WHEN rate BETWEEN 2 AND 5 THEN 1 WHEN rate < 2 THEN greatest(0, least(1, (rate - .5) / 1.5)) ELSE greatest(0, least(1, (7 - rate) / 2)) END) * .25::DOUBLE
  + avg(CASE WHEN abs(dwell_z) <= 1.5 THEN 1 ELSE greatest(0, least(1, (3 - abs(dwell_z)) / 1.5)) END) * .1::DOUBLE) / .35::DOUBLE * 100)) AS ds,
  CASE WHEN count(*) < 2 THEN 70 WHEN avg(rate) <= 1e-6 THEN 50 ELSE greatest(0, 100 * (1 - least(stddev_pop(rate) / (avg(rate) + 1e-8), 1))) END::DOUBLE AS ps FROM ae GROUP BY ALL),
ov AS (SELECT session_id, round_even(coalesce(cc, 0), 2) AS content_coverage, round_even({_curve("(coalesce(cc, 0) / 100)")}, 2) AS content_coverage_user, round_even(coalesce(ds, 50), 2) AS delivery_stability, round_even(coalesce(ps, 70), 2) AS pacing_score FROM oc FULL JOIN od USING (session_id)),
ovs AS (SELECT *, CASE WHEN content_coverage > 80 AND delivery_stability > 70 THEN 'summary_high' WHEN content_coverage < 60 OR delivery_stability < 50 THEN 'summary_low' ELSE 'summary_mid' END AS summary FROM ov)"""
_SNAP = """snap AS (SELECT session_id % 2 AS c, 'total' AS section, 'all' AS key, count(*)::DOUBLE AS value FROM isr GROUP BY ALL
  UNION ALL SELECT session_id % 2, 'issue', issue, count(*)::DOUBLE FROM isr GROUP BY ALL UNION ALL SELECT session_id % 2, 'role', CASE WHEN slide_id = 1 THEN 'cover' ELSE 'content' END, count(*)::DOUBLE FROM isr GROUP BY ALL)"""
ORACLE = {
    "score_curve": f"WITH {a.GOLD} SELECT session_id, slide_id, round_even({_curve('pred')}, 6) AS score FROM gold_pred",
    "reliability": """WITH c AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey % 100 / 1000.0::DOUBLE END AS c FROM orders), l AS (SELECT *, CASE WHEN coalesce(c, 0) >= .05 THEN 2 WHEN coalesce(c, 0) >= .03 THEN 1 ELSE 0 END AS l FROM c)
SELECT o_orderkey, ['low', 'medium', 'high'][CASE WHEN s = 'P' THEN 0 WHEN s = 'F' THEN greatest(l - 1, 0) ELSE l END + 1] AS level, coalesce(c < .06, false) AS low FROM l""",
    "ce_ae_join": f"WITH {_SLIDES} SELECT session_id, slide_id, has_ce, has_ae, round_even(coverage, 6) AS coverage, round_even(dwell_z, 6) AS dwell_z FROM sl",
    "issues": f"WITH {_SLIDES} SELECT session_id, slide_id, ord, issue, low_confidence FROM isr",
    "severity": f"WITH {_SLIDES} SELECT *, CASE WHEN severity >= 5 THEN 'high' WHEN severity >= 2 THEN 'medium' ELSE 'low' END AS bucket FROM sev",
    "highlights": f"WITH {_SLIDES} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY severity DESC, slide_id) AS rank, slide_id, severity, issues FROM sev",
    "feedback_text": f"""WITH {_SLIDES}, tp AS (SELECT ['content_gap_high', 'content_gap_mid', 'content_gap_low', 'title_missing', 'title_missing_low_confidence', 'bullet_missing', 'silence_excess', 'speed_drop', 'filler_many', 'visual_not_explained_low_confidence'][n_nationkey + 1] AS id,
  CASE WHEN n_regionkey < 2 THEN 'high' ELSE 'medium' END AS sv, n_name || ': {{issue}} on slide {{slide_id}}' AS tx FROM nation WHERE n_nationkey < 10),
q AS (SELECT *, CASE WHEN issue = 'content_gap' THEN CASE WHEN coalesce(coverage, 1) < .4 THEN 'content_gap_high' WHEN coalesce(coverage, 1) < .6 THEN 'content_gap_mid' ELSE 'content_gap_low' END ELSE issue END AS tid FROM isr)
SELECT session_id, slide_id, ord, issue AS template_id, coalesce(l.sv, t.sv, 'low') AS severity, replace(replace(coalesce(l.tx, t.tx, 'slide {{slide_id}} can improve'), '{{slide_id}}', slide_id::VARCHAR), '{{issue}}', issue) AS text
FROM q LEFT JOIN tp t ON t.id = tid LEFT JOIN tp l ON low_confidence AND l.id = tid || '_low_confidence'""",
    "overall_scores": f"WITH {_OVERALL} SELECT * FROM ovs",
    "service_result": f"""WITH {_OVERALL}, {_SLIDES.removeprefix(_DWELL + ', ' + a.GOLD + ',')}, b AS (SELECT session_id, count_if(severity >= 5) AS h, count_if(severity BETWEEN 2 AND 4) AS m, count_if(severity < 2) AS l FROM sev GROUP BY ALL)
SELECT session_id, round_even(content_coverage, 0)::INT AS content_coverage, round_even(delivery_stability, 0)::INT AS delivery_stability, round_even(pacing_score, 0)::INT AS pacing_score, round_even((content_coverage + delivery_stability + pacing_score) / 3, 0)::INT AS overall_score, coalesce(h, 0) AS n_high, coalesce(m, 0) AS n_medium, coalesce(l, 0) AS n_low FROM ovs LEFT JOIN b USING (session_id)""",
    "strengths": f"""WITH {_OVERALL} SELECT session_id, concat_ws(',', CASE WHEN delivery_stability >= 80 THEN 'steady_delivery' END, CASE WHEN pacing_score >= 80 THEN 'even_pace' END) AS strengths,
  CASE WHEN content_coverage_user >= 85 THEN 'strong' WHEN content_coverage_user >= 70 THEN 'good' WHEN content_coverage_user >= 50 THEN 'partial' ELSE 'weak' END AS connection FROM ovs""",
    "term_replacement": "SELECT conv_id, turn, md5(replace(replace(text, 'the ', 'a '), 'and', '&')) AS text_md5 FROM conversations",
    "issue_scope": f"""WITH {_SLIDES}, h AS (SELECT DISTINCT session_id, slide_id FROM isr WHERE ord <= 3) SELECT conv_id AS session_id, (turn + 1)::INT AS slide_id, md5(text) AS comment_md5 FROM conversations c LEFT JOIN h ON h.session_id = conv_id AND h.slide_id = turn + 1
WHERE h.session_id IS NOT NULL OR NOT regexp_matches(text, '(?i)the|que')""",
    "compact_report": f"""WITH {_SLIDES} SELECT s.session_id, s.slide_id, row_number() OVER (PARTITION BY s.session_id ORDER BY severity DESC, s.slide_id) AS rank, severity, md5(CASE WHEN length(text) > 40 THEN rtrim(text[1:39]) || '…' ELSE text END) AS text_md5
FROM sev s JOIN conversations ON conv_id = s.session_id AND turn + 1 = s.slide_id QUALIFY rank <= 3""",
    "report_snapshot": f'WITH {_SLIDES}, {_SNAP} SELECT c AS "case", section, key, value FROM snap',
    "snapshot_delta": f"""WITH {_SLIDES}, {_SNAP}, x AS (SELECT * FROM snap WHERE c = 1), y AS (SELECT * FROM snap WHERE c = 0)
SELECT coalesce(x.section, y.section) AS section, coalesce(x.key, y.key) AS key, coalesce(x.value, 0) AS current, coalesce(y.value, 0) AS base, coalesce(x.value, 0) - coalesce(y.value, 0) AS delta FROM x FULL JOIN y ON x.section = y.section AND x.key = y.key""",
    "report_json": f"WITH {_OVERALL} SELECT session_id, content_coverage, summary FROM ovs",
}
