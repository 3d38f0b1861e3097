"""Queries on coherence and alignment of units to slides, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import coherence as c
from rostrum.sources import adapters as a


def _assigned(u):
    """Each unit on its label's slide."""
    return u.select("session_id", "unit_id", F.col("label").alias("slide_id")).distinct()


def _times(u):
    """Two seconds a unit."""
    return u.select("session_id", "unit_id").distinct().select("session_id", "unit_id", (F.col("unit_id") % 50 * 2.0).alias("start_sec"), (F.col("unit_id") % 50 * 2.0 + 1.5).alias("end_sec"))


def slide_similarity(spark, sf):
    return a.unit_sim(spark, sf).select("session_id", "unit_id", "slide_id", edge(F.col("sim")).alias("sim"))


def _sims(spark, sf):
    """Units as keypoints (importance by number) against their session's slides' units as chunks, scaled to 0-1."""
    u = a.unit_sim(spark, sf)
    return u.select("session_id", "slide_id", (F.col("unit_id") % 7).alias("kp_idx"), F.when(F.col("unit_id") % 7 < 3, "title").otherwise("body").alias("source"), F.when(F.col("unit_id") % 7 < 3, 1.0).otherwise(0.4).alias("importance"), F.col("unit_id").alias("chunk_idx"), F.bround((F.col("sim") + 1) / 2, 6).alias("sim"))


def coherence_scores(spark, sf):
    s = _sims(spark, sf)
    slides = s.groupBy("session_id", "slide_id").agg(F.avg("sim").alias("semantic"), (F.count("*") * 2.0).alias("n_chars"))
    # two more slides of each talk on which nothing is said; one has key points
    quiet = s.select("session_id").distinct()
    silent = quiet.select("session_id", F.explode(F.array(F.lit(98), F.lit(99))).alias("slide_id"), F.lit(0.0).alias("semantic"), F.lit(0.0).alias("n_chars"))
    points = quiet.select("session_id", F.lit(99).alias("slide_id"), F.explode(F.sequence(F.lit(0), F.col("session_id") % 3)).alias("kp_idx"))
    r = c.coverage(c.best_chunks(s), slides.unionByName(silent), points)
    return r.select("session_id", "slide_id", *[edge(F.col(x), 4).alias(x) for x in ("keypoint_coverage", "soft_coverage", "semantic_coverage", "presence", "coverage")], F.array_join(F.transform("missed", lambda x: x.cast("string")), ",").alias("missed"))


def source_coverage(spark, sf):
    r = c.by_source(c.best_chunks(_sims(spark, sf)))
    return r.select("session_id", "slide_id", "source", edge(F.col("coverage")).alias("coverage"), F.array_join(F.transform("missed", lambda x: x.cast("string")), ",").alias("missed"))


def evidence_spans(spark, sf):
    return c.evidence(c.best_chunks(_sims(spark, sf)))


def alignment_confidence(spark, sf):
    u = a.unit_sim(spark, sf)
    return c.confidence(c.margins(u.select("session_id", "unit_id", "slide_id", F.bround("sim", 9).alias("sim")), _assigned(u))).withColumn("confidence", edge(F.col("confidence")))


def unit_margins(spark, sf):
    u = a.unit_sim(spark, sf)
    m = c.margins(u, _assigned(u))
    return m.select("session_id", "unit_id", "slide_id", *[edge(F.col(x)).alias(x) for x in ("sim", "rival", "margin")])


def unit_runs(spark, sf):
    return c.runs(_assigned(a.unit_sim(spark, sf)))


def monotone_slides(spark, sf):
    return c.monotone(_assigned(a.unit_sim(spark, sf)))


def _counts(u):
    return u.groupBy("session_id").agg((F.max("slide_id") + 1).alias("n_slides"))


def boundaries(spark, sf):
    u = a.unit_sim(spark, sf)
    m = c.monotone(_assigned(u)).withColumn("slide_id", F.col("slide_id") + 1)
    return c.boundaries(m, _times(u), _counts(u)).select("session_id", F.array_join(F.transform("b", lambda x: (x * 2).cast("int").cast("string")), ",").alias("b"))


def alignment_warnings(spark, sf):
    u = a.unit_sim(spark, sf)
    m = c.monotone(_assigned(u)).withColumn("slide_id", F.col("slide_id") + 1)
    conf = c.confidence(c.margins(u.withColumn("slide_id", F.col("slide_id") + 1), m))
    return c.warnings(m, _counts(u), c.boundaries(m, _times(u), _counts(u)), conf)


def emission_scores(spark, sf):
    e = c.emissions(a.unit_sim(spark, sf))
    return e.select("session_id", "unit_id", "slide_id", edge(F.col("emission")).alias("emission"))


QUERIES = {f.__name__: f for f in (slide_similarity, coherence_scores, source_coverage, evidence_spans, alignment_confidence, unit_margins, unit_runs, monotone_slides, boundaries, alignment_warnings, emission_scores)}

_BEST = f"""{a.UNITS},
sims AS (SELECT session_id, slide_id, unit_id % 7 AS kp_idx, CASE WHEN unit_id % 7 < 3 THEN 'title' ELSE 'body' END AS source, CASE WHEN unit_id % 7 < 3 THEN 1.0 ELSE 0.4 END::DOUBLE AS importance, unit_id AS chunk_idx, round_even((sim + 1) / 2, 6) AS sim FROM unit_sim),
best AS (SELECT session_id, slide_id, kp_idx, source, importance, max(sim) AS sim, arg_max(chunk_idx, (sim, -chunk_idx)) AS chunk_idx FROM sims GROUP BY ALL)"""
_ASSIGNED = "asg AS (SELECT DISTINCT session_id, unit_id, label AS slide_id FROM unit_sim)"
_MARGIN = """
mg AS (SELECT session_id, unit_id, label AS slide_id, max(s) FILTER (u.slide_id = label) AS sim, max(s) FILTER (u.slide_id <> label) AS rival FROM (SELECT *, {} AS s FROM unit_sim) u GROUP BY ALL),
mm AS (SELECT *, CASE WHEN rival IS NULL THEN 1 ELSE sim - rival END AS margin FROM mg)"""
_MONO = """
mono AS (SELECT session_id, unit_id, max(slide_id) OVER (PARTITION BY session_id ORDER BY unit_id) AS slide_id FROM asg),
cnt AS (SELECT session_id, max(slide_id) + 1 AS n_slides FROM unit_sim GROUP BY ALL),
bnd AS (SELECT session_id, list_concat([0], list_transform(range(2, n_slides + 1), lambda k: coalesce(list_min(list_transform(list_filter(u, lambda x: x.s >= k), lambda x: x.t)), t1)), [t1]) AS b FROM (
  SELECT session_id, n_slides, list({'t': unit_id % 50 * 2.0::DOUBLE, 's': slide_id + 1}) AS u, max(unit_id % 50 * 2.0::DOUBLE + 1.5::DOUBLE) AS t1 FROM mono JOIN cnt USING (session_id) GROUP BY ALL))"""
_C = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
ORACLE = {
    "slide_similarity": f"WITH {a.UNITS} SELECT session_id, unit_id, slide_id, round_even(sim, 6) AS sim FROM unit_sim",
    "coherence_scores": f"""WITH {_BEST}, g AS (SELECT session_id, slide_id, sum(CASE WHEN sim >= .55 THEN importance ELSE 0 END) / sum(importance) AS k, sum(importance * {_C.format("(sim - .35::DOUBLE) / .4::DOUBLE")}) / sum(importance) AS so,
  coalesce(string_agg(kp_idx, ',' ORDER BY kp_idx) FILTER (sim < .55), '') AS missed FROM best GROUP BY ALL),
h AS (SELECT session_id, slide_id, {_C.format("(avg(sim) - .4::DOUBLE) / .4::DOUBLE")} AS se, {_C.format("count(*) * 2 / 100.0::DOUBLE")} AS p FROM sims GROUP BY ALL),
j AS (SELECT *, .45::DOUBLE * se + .45::DOUBLE * so + .1::DOUBLE * p AS bl FROM g JOIN h USING (session_id, slide_id))
SELECT session_id, slide_id, round_even(k, 4) AS keypoint_coverage, round_even(so, 4) AS soft_coverage, round_even(se, 4) AS semantic_coverage, round_even(p, 4) AS presence, round_even({_C.format("CASE WHEN least(se, so) < .55 THEN least(bl, .72::DOUBLE) ELSE bl END")}, 4) AS coverage, missed FROM j
UNION ALL SELECT session_id, slide_id, 0, 0, 0, 0, 0, CASE WHEN slide_id = 98 THEN '' ELSE array_to_string(range(0, session_id % 3 + 1), ',') END FROM (SELECT DISTINCT session_id, unnest([98, 99]) AS slide_id FROM sims)""",
    "source_coverage": f"WITH {_BEST} SELECT session_id, slide_id, source, round_even(sum(CASE WHEN sim >= .55 THEN importance ELSE 0 END) / sum(importance), 6) AS coverage, coalesce(string_agg(kp_idx, ',' ORDER BY kp_idx) FILTER (sim < .55), '') AS missed FROM best GROUP BY ALL",
    "evidence_spans": f"WITH {_BEST} SELECT session_id, slide_id, kp_idx, chunk_idx, sim FROM best WHERE sim >= .55",
    "alignment_confidence": f"WITH {a.UNITS}, {_MARGIN.format('round_even(sim, 9)')} SELECT session_id, round_even(avg({_C.format('margin')}), 6) AS confidence, count_if(sim < .35 OR margin < .1) AS n_low, count_if(sim < .35) AS n_low_sim, count_if(margin < .1) AS n_low_margin FROM mm GROUP BY session_id",
    "unit_margins": f"WITH {a.UNITS}, {_MARGIN.format('sim')} SELECT session_id, unit_id, slide_id, round_even(sim, 6) AS sim, round_even(rival, 6) AS rival, round_even(margin, 6) AS margin FROM mm",
    "unit_runs": f"""WITH {a.UNITS}, {_ASSIGNED}, r AS (SELECT *, (lag(slide_id) OVER w IS DISTINCT FROM slide_id)::INT AS n FROM asg WINDOW w AS (PARTITION BY session_id ORDER BY unit_id)),
q AS (SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY unit_id) AS run FROM r) SELECT session_id, run::BIGINT AS run, slide_id, min(unit_id) AS first_unit, max(unit_id) AS last_unit, count(*) AS n_units FROM q GROUP BY session_id, run, slide_id""",
    "monotone_slides": f"WITH {a.UNITS}, {_ASSIGNED} SELECT session_id, unit_id, max(slide_id) OVER (PARTITION BY session_id ORDER BY unit_id) AS slide_id FROM asg",
    "boundaries": f"WITH {a.UNITS}, {_ASSIGNED}, {_MONO} SELECT session_id, array_to_string(list_transform(b, lambda x: (x * 2)::INT), ',') AS b FROM bnd",
    "alignment_warnings": f"""WITH {a.UNITS}, {_ASSIGNED}, {_MONO}, us AS (SELECT session_id, count(DISTINCT slide_id) AS used FROM mono GROUP BY ALL),
mx AS (SELECT u.session_id, u.unit_id, max(sim) FILTER (u.slide_id = m.slide_id) AS a, max(sim) FILTER (u.slide_id <> m.slide_id) AS b FROM unit_sim u JOIN mono m USING (session_id, unit_id) GROUP BY ALL),
cf AS (SELECT session_id, avg({_C.format("CASE WHEN b IS NULL THEN 1 ELSE a - b END")}) AS confidence FROM mx GROUP BY ALL)
SELECT session_id, concat_ws(',', CASE WHEN used < n_slides THEN 'not_all_slides_assigned' END, CASE WHEN len(list_distinct(b)) < len(b) THEN 'duplicate_boundaries_detected' END, CASE WHEN confidence < .03 THEN 'low_alignment_confidence' END) AS warnings FROM cnt JOIN us USING (session_id) JOIN bnd USING (session_id) JOIN cf USING (session_id)""",
    "emission_scores": f"""WITH {a.UNITS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY unit_id) - 1 AS u, dense_rank() OVER (PARTITION BY session_id ORDER BY slide_id) - 1 AS k FROM unit_sim),
q AS (SELECT *, coalesce(u / nullif(max(u) OVER w, 0), 0) AS a, coalesce(k / nullif(max(k) OVER w, 0), 0) AS p FROM r WINDOW w AS (PARTITION BY session_id))
SELECT session_id, unit_id, slide_id, round_even(sim - .35::DOUBLE * abs(p - a) * CASE WHEN p < a THEN 1.6::DOUBLE ELSE 1 END, 6) AS emission FROM q""",
}
