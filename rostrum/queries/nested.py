"""Queries on nested reports and on captions made once, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import captions as cp
from rostrum.operators import nested as n
from rostrum.operators.report import replace_terms
from rostrum.sources import adapters as a

TERMS = [("the ", "a "), ("and", "&")]
MODEL = (110, "small", "v2")


def _reports(spark, sf):
    """A report a talk as JSON: its turns are slides; every fifth is of an older version without segments, every seventh has a field of its own, every eleventh text is cut off."""
    c = a.table(spark, sf, "conversations").withColumn("n", F.char_length("text"))
    slide = F.struct((F.col("turn") + 1).cast("int").alias("slide_id"), (F.col("n") % 100 / 100.0).alias("coverage"), F.col("role").alias("trend"), F.filter(F.array(F.when(F.col("n") % 2 == 0, F.lit("the end and more"))), lambda x: x.isNotNull()).alias("anomalies"))
    segment = F.struct((F.col("turn") + 1).cast("int").alias("slide_id"), F.col("text").alias("text"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(slide)).alias("per_slide_detail"), F.array_sort(F.collect_list(segment)).alias("segments"), F.sum("n").alias("total"))
    r = g.select("conv_id", F.lit("1.1").alias("version"), F.create_map(F.lit("content_coverage"), F.col("total") % 101 * 1.0, F.lit("pacing_score"), F.lit(70.0)).alias("overall_scores"), "per_slide_detail", F.when(F.col("conv_id") % 5 != 0, F.col("segments")).alias("transcript_segments"), F.when(F.col("conv_id") % 7 == 0, F.struct(F.lit("the room and hall").alias("venue"))).alias("context"))
    text = F.to_json(F.struct("version", "overall_scores", "per_slide_detail", "transcript_segments", "context"))
    return r.select("conv_id", F.when(F.col("conv_id") % 11 == 0, F.substring(text, 1, 20)).otherwise(text).alias("value"))


def report_round_trip(spark, sf):
    """Reports read by schema and written again: texts without loss, cut ones told apart."""
    r = n.read_json(_reports(spark, sf))
    again = n.read_json(r.where("malformed IS NULL").select("conv_id", n.write_json(r).alias("value")))
    texts = lambda x: F.md5(F.coalesce(F.array_join(F.transform("transcript_segments", lambda s: s["text"]), "|"), F.lit("none")).cast("binary"))
    x = again.select("conv_id", "version", F.size("per_slide_detail").cast("long").alias("n_slides"), edge(F.aggregate("per_slide_detail", F.lit(0.0), lambda s, y: s + y["coverage"]), 4).alias("coverage"), F.try_variant_get(F.try_element_at("extra", F.lit("context")), "$.venue", "string").alias("venue"), texts(again).alias("text_md5"))
    bad = r.where("malformed IS NOT NULL").select("conv_id", *[F.lit(None).cast(k).alias(c) for c, k in (("version", "string"), ("n_slides", "long"), ("coverage", "double"), ("venue", "string"), ("text_md5", "string"))])
    return x.unionByName(bad)


def report_terms(spark, sf):
    """Terms replaced in every text of a report, two levels down in arrays of structs and of lists."""
    r = n.rewrite(n.read_json(_reports(spark, sf)).where("malformed IS NULL").drop("extra", "malformed"), lambda x: replace_terms(x, TERMS))
    return r.select("conv_id", F.md5(F.coalesce(F.array_join(F.transform("transcript_segments", lambda s: s["text"]), "|"), F.lit("none")).cast("binary")).alias("text_md5"), F.array_join(F.flatten(F.transform("per_slide_detail", lambda s: s["anomalies"])), "|").alias("anomalies"), F.array_join(F.transform("per_slide_detail", lambda s: s["trend"]), "|").alias("trends"))


def report_compact(spark, sf):
    """What a comment writer gets: the first three slides and segments, shortened, with labels."""
    r = n.read_json(_reports(spark, sf)).where("malformed IS NULL")
    x = r.select("conv_id", n.compact(r, 3, 40).alias("c"))
    return x.select("conv_id", F.col("c.overall_scores.content_connection_label").alias("label"), F.array_join(F.transform("c.per_slide_detail", lambda s: s["slide_id"].cast("string")), ",").alias("slides"), F.md5(F.array_join(F.transform("c.transcript_segments", lambda s: s["text"]), "|").cast("binary")).alias("text_md5"))


def template_slots(spark, sf):
    """Templates with slots for numbers, texts and lists, filled from a payload."""
    c = a.table(spark, sf, "conversations")
    w = F.slice(F.split("text", " "), 1, 2)
    payload = F.create_map(F.lit("slide_id"), (F.col("turn") + 1).cast("string"), F.lit("missed"), n.listed(w), F.lit("role"), F.concat(F.lit("{slide_id} of "), F.col("role")))
    return c.select("conv_id", "turn", n.render(F.lit("Slide {slide_id} ({role}): say {missed}, {{not}} {other}."), payload).alias("text"))


def captions_pending(spark, sf):
    """Pages of which a third has been captioned before; pages of the same content share it."""
    p = a.table(spark, sf, "pages").select("page_id", cp.cache_key(F.col("html"), *MODEL).alias("key"))
    return cp.unknown(p, p.where("page_id % 3 = 0").select("key")).select("page_id", "key")


QUERIES = {f.__name__: f for f in (report_round_trip, report_terms, report_compact, template_slots, captions_pending)}

_T = """
t AS (SELECT conv_id, turn, role, text, length(text) AS n FROM conversations),
g AS (SELECT conv_id, sum(n) AS total, count(*) AS k, sum(n % 100 / 100.0::DOUBLE) AS coverage, string_agg(text, '|' ORDER BY turn) AS texts, string_agg(replace(replace(text, 'the ', 'a '), 'and', '&'), '|' ORDER BY turn) AS said,
  coalesce(string_agg('a end & more', '|') FILTER (n % 2 = 0), '') AS anomalies, string_agg(replace(replace(role, 'the ', 'a '), 'and', '&'), '|' ORDER BY turn) AS trends FROM t GROUP BY conv_id)"""
_CURVE = "CASE WHEN s IS NULL THEN NULL WHEN s >= 85 THEN 'strong' WHEN s >= 70 THEN 'good' WHEN s >= 50 THEN 'partial' ELSE 'check' END"


def _oracle() -> dict[str, str]:
    from rostrum.queries.report import _curve

    return {
        "report_round_trip": f"""WITH {_T} SELECT conv_id, CASE WHEN ok THEN '1.1' END AS version, CASE WHEN ok THEN k END AS n_slides, CASE WHEN ok THEN round_even(coverage, 4) END AS coverage, CASE WHEN ok AND conv_id % 7 = 0 THEN 'the room and hall' END AS venue,
  CASE WHEN ok THEN md5(CASE WHEN conv_id % 5 <> 0 THEN texts ELSE 'none' END) END AS text_md5 FROM (SELECT *, conv_id % 11 <> 0 AS ok FROM g)""",
        "report_terms": f"WITH {_T} SELECT conv_id, md5(CASE WHEN conv_id % 5 <> 0 THEN said ELSE 'none' END) AS text_md5, anomalies, trends FROM g WHERE conv_id % 11 <> 0",
        "report_compact": f"""WITH {_T}, x AS (SELECT conv_id, coalesce(string_agg(CASE WHEN n > 40 THEN rtrim(text[1:39]) || '…' ELSE text END, '|' ORDER BY turn) FILTER (turn < 3 AND conv_id % 5 <> 0), '') AS cut, string_agg(turn + 1, ',' ORDER BY turn) FILTER (turn < 3) AS slides FROM t GROUP BY conv_id)
SELECT conv_id, {_CURVE} AS label, slides, md5(cut) AS text_md5 FROM (SELECT *, round_even({_curve('(total % 101 / 100.0::DOUBLE)')}, 2) AS s FROM g) JOIN x USING (conv_id) WHERE conv_id % 11 <> 0""",
        "template_slots": """WITH w AS (SELECT *, string_split(text, ' ')[1:2] AS w FROM conversations),
q AS (SELECT *, list_transform(w, lambda e: CASE WHEN contains(e, '''') AND NOT contains(e, '"') THEN '"' || e || '"' ELSE '''' || replace(replace(e, '\\', '\\\\'), '''', '\\''') || '''' END) AS l FROM w)
SELECT conv_id, turn, 'Slide ' || (turn + 1) || ' ({slide_id} of ' || role || '): say [' || array_to_string(l, ', ') || '], {not} {other}.' AS text FROM q""",
        "captions_pending": f"""WITH p AS (SELECT page_id, sha256(concat_ws(chr(10), sha256(html), '{MODEL[0]}', '{MODEL[1]}', '{MODEL[2]}')) AS key FROM pages) SELECT page_id, key FROM p WHERE key NOT IN (SELECT key FROM p WHERE page_id % 3 = 0)""",
    }


ORACLE = _oracle()
