"""Queries on slide decks, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions import text as t
from rostrum.functions.score import edge
from rostrum.operators import deck as d
from rostrum.sources import adapters as a


def _lines(spark, sf):
    return a.slide_lines(spark, sf)


def _slides(spark, sf):
    x = _lines(spark, sf)
    return d.assemble(x).join(d.titles(x).drop("score"), ["deck", "slide"], "left").withColumn("title", F.coalesce("title", F.lit("")))


def slide_lines_clean(spark, sf):
    """Line rules: normalised text, figure and bullet marks, scores."""
    x = F.col("line")
    return _lines(spark, sf).select("deck", "slide", "line_idx", F.md5(t.content_line(x).cast("binary")).alias("clean"), t.is_metric(x).alias("metric"), t.is_bullet(x).alias("bullet"), t.title_score(x).alias("score"), t.layout_score(x, F.col("font_size"), F.col("y0")).alias("layout"))


def slide_titles(spark, sf):
    return d.titles(_lines(spark, sf))


def slide_titles_layout(spark, sf):
    s = d.titles(_lines(spark, sf), layout=True)
    return s.withColumn("score", edge(F.col("score")))


def slide_assembly(spark, sf):
    return d.assemble(_lines(spark, sf)).select("deck", "slide", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("bullets").alias("n_bullets"))


def slide_roles(spark, sf):
    return d.roles(_slides(spark, sf))


def keywords_topn(spark, sf):
    return d.keywords(_lines(spark, sf))


def tfidf(spark, sf):
    return d.tfidf(_lines(spark, sf)).withColumn("weight", edge(F.col("weight")))


def textrank(spark, sf):
    """The leading lines of each slide that a word links."""
    return d.textrank(d.tfidf(_lines(spark, sf))).withColumn("score", edge(F.col("score"), 4))


def keypoints_dedup(spark, sf):
    x = _lines(spark, sf)
    title = d.titles(x).select("deck", "slide", F.lit("title").alias("source"), F.lit(0).alias("pos"), F.col("title").alias("text"))
    body = x.select("deck", "slide", F.when(F.col("line_idx") % 2 == 0, "bullet").otherwise("body").alias("source"), F.col("line_idx").alias("pos"), F.col("line").alias("text"))
    k = d.keypoints(title.unionByName(body))
    return k.select("deck", "slide", "kp_idx", F.md5(F.col("text").cast("binary")).alias("text_md5"), "source", "importance")


def visual_captions(spark, sf):
    """Lines as visual items: figures by their line's length."""
    x = _lines(spark, sf).select("deck", "slide", F.col("line_idx").alias("item"), F.element_at(F.array(F.lit("image"), F.lit("table"), F.lit("chart")), (F.col("line_idx") % 3 + 1).cast("int")).alias("type"), F.col("line").alias("raw_text"), F.when(F.col("line_idx") % 3 == 0, 0.9).otherwise(0.1).alias("confidence"), F.when(F.col("line_idx") % 3 == 2, F.lit("bar_chart")).alias("chart_type"))
    return d.visual_captions(x).select("deck", "slide", "item", F.md5(F.col("caption").cast("binary")).alias("caption_md5"))


def caption_rules(spark, sf):
    """Captions of pages after validation."""
    p = a.table(spark, sf, "pages")
    c = p.select(F.expr("page_id div 10").alias("deck"), (F.col("page_id") % 10 + 1).cast("int").alias("slide"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("slide_type"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("main_claim"), F.split(F.regexp_extract("html", "<title>([^<]*)", 1), " ").alias("entities"))
    v = d.validate_captions(c, ("en", "de"), "other", 30, 3)
    return v.select("deck", "slide", "slide_type", "main_claim", F.array_join("entities", "|").alias("entities"))


def deck_validation(spark, sf):
    s = _lines(spark, sf).select("deck", "slide").distinct()
    return d.deck_report(s, s.where("slide <= 9").groupBy("deck").agg(F.collect_list("slide").alias("slides")).unionByName(s.where("slide > 9 AND deck % 3 > 0").groupBy("deck").agg(F.collect_list("slide").alias("slides"))))


def caption_cache(spark, sf):
    """Content keys: one row per distinct page content, with how many pages share it."""
    p = a.table(spark, sf, "pages")
    return p.groupBy(F.sha2(F.col("html").cast("binary"), 256).alias("content_key")).agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


QUERIES = {f.__name__: f for f in (slide_lines_clean, slide_titles, slide_titles_layout, slide_assembly, slide_roles, keywords_topn, tfidf, textrank, keypoints_dedup, visual_captions, caption_rules, deck_validation, caption_cache)}

_B = "'^(?:[-•·*●▪◦‣]|[0-9]+[.)]|[A-Za-z][.)])\\s*'"
_RULES = f"""
l1 AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS one, trim(line, ' ') AS tr, replace(trim(line, ' '), ' ', '') AS cp FROM slide_lines),
l2 AS (SELECT *, list_filter(string_split(one, ' '), lambda w: w <> '') AS tk FROM l1),
l3 AS (SELECT *, CASE WHEN len(tk) >= 4 AND len(list_filter(tk, lambda w: length(w) <= 2)) >= 0.75 * len(tk) THEN array_to_string(tk, '') ELSE array_to_string(tk, ' ') END AS pdf,
  (list_has_any([contains(cp, x) for x in ['%', 'H', '년차', '건', '초', '명', '억+', 'AI']], [true]) AND length(cp) <= 6) OR regexp_full_match(regexp_replace(cp, '[.+]', '', 'g'), '[0-9]+') AS metric,
  regexp_matches(tr, {_B}) AS bullet FROM l2),
l4 AS (SELECT *, trim(regexp_replace(trim(pdf), {_B}, '')) AS clean,
  CASE WHEN tr = '' THEN -1 ELSE length(tr) - 20 * metric::INT - 25 * bullet::INT + 2 * regexp_matches(tr, '\\pL')::INT + 2 * regexp_matches(tr, '[가-힣]')::INT + (tr = upper(tr) AND tr <> lower(tr))::INT END::DOUBLE AS score FROM l3),
l5 AS (SELECT *, score + least(font_size, 40) * 2.2::DOUBLE + greatest(0, 180 - least(y0, 180)) * 0.12::DOUBLE - 12 * (length(tr) > 60)::INT - 6 * (length(tr) < 3)::INT
  + CASE WHEN font_size >= 24 AND y0 <= 110 THEN 18 WHEN font_size >= 18 AND y0 <= 140 THEN 8 ELSE 0 END AS layout FROM l4)"""
_ASSEMBLE = """
asm AS (SELECT deck, slide, coalesce(string_agg(clean, chr(10) ORDER BY line_idx) FILTER (clean <> ''), '') AS text, count_if(bullet AND clean <> '') AS n_bullets FROM l5 GROUP BY ALL),
tit AS (SELECT deck, slide, tr AS title, score FROM l5 WHERE line_idx < 8 AND tr <> '' QUALIFY row_number() OVER (PARTITION BY deck, slide ORDER BY score DESC, line_idx) = 1)"""
_TFIDF = """
al2 AS (SELECT * FROM slide_lines WHERE trim(line) <> ''),
tw AS (SELECT deck, slide, line_idx, unnest(regexp_extract_all(lower(line), '[\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}]{2,}')) AS term FROM al2),
tn AS (SELECT deck, slide, count(*) AS n_lines FROM al2 GROUP BY ALL),
tf AS (SELECT deck, slide, line_idx, term, count(*) AS tf FROM tw GROUP BY ALL),
tx AS (SELECT *, tf * (ln((1 + n_lines) / (1 + count(*) OVER (PARTITION BY deck, slide, term))) + 1) AS w FROM tf JOIN tn USING (deck, slide))"""
_CAPTIONS = """
cp AS (SELECT page_id // 10 AS deck, (page_id % 10 + 1)::INT AS slide, regexp_extract(url, '/([a-z]{2})/', 1) AS kind, regexp_extract(html, '<title>([^<]*)', 1) AS title FROM pages),
ce AS (SELECT *, list_filter(list_transform(string_split(title, ' '), lambda x: left(trim(regexp_replace(x, '\\s+', ' ', 'g')), 30)), lambda x: x <> '') AS es FROM cp),
cl AS (SELECT *, list_transform(es, lambda x: lower(x)) AS low FROM ce)
SELECT deck, slide, CASE WHEN kind IN ('en', 'de') THEN kind ELSE 'other' END AS slide_type, left(trim(regexp_replace(title, '\\s+', ' ', 'g')), 30) AS main_claim,
  array_to_string(list_filter(es, lambda x, i: list_position(low, lower(x)) = i)[1:3], '|') AS entities FROM cl"""
ORACLE = {
    "caption_rules": f"WITH {_CAPTIONS}",
    "slide_lines_clean": f"WITH {a.LINES}, {_RULES} SELECT deck, slide, line_idx, md5(clean) AS clean, metric, bullet, score, layout FROM l5",
    "slide_titles": f"WITH {a.LINES}, {_RULES}, {_ASSEMBLE} SELECT * FROM tit",
    "slide_titles_layout": f"WITH {a.LINES}, {_RULES} SELECT deck, slide, tr AS title, round_even(CASE WHEN layout >= 60 THEN layout ELSE score END, 6) AS score FROM l5 WHERE line_idx < 8 AND tr <> '' QUALIFY row_number() OVER (PARTITION BY deck, slide ORDER BY layout >= 60 DESC, CASE WHEN layout >= 60 THEN layout ELSE score END DESC, line_idx) = 1",
    "slide_assembly": f"WITH {a.LINES}, {_RULES}, {_ASSEMBLE} SELECT deck, slide, md5(text) AS text_md5, n_bullets FROM asm",
    "slide_roles": f"""WITH {a.LINES}, {_RULES}, {_ASSEMBLE}, s AS (SELECT asm.*, coalesce(title, '') AS title, min(slide) OVER d = slide AS f, max(slide) OVER d = slide AS l FROM asm LEFT JOIN tit USING (deck, slide) WINDOW d AS (PARTITION BY deck)),
r AS (SELECT *, CASE WHEN f THEN 'cover' WHEN l AND regexp_matches(title || ' ' || text, '(?i)(감사|thank|q\\s*&?\\s*a|질문)') THEN 'thanks'
  WHEN n_bullets = 0 AND length(title) <= 35 AND len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 45)) = 0 THEN 'section' ELSE 'content' END AS role FROM s)
SELECT deck, slide, role, 'heuristic' AS source, CASE WHEN role = 'content' THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage_weight FROM r""",
    "keywords_topn": f"""WITH {a.LINES}, w AS (SELECT deck, slide, line_idx, unnest(x) AS term, generate_subscripts(x, 1) AS pos FROM (SELECT *, list_transform(regexp_extract_all(line, '{t.NOUN}'), lambda y: lower(y)) AS x FROM slide_lines)),
c AS (SELECT deck, slide, term, count(*) AS n, min((line_idx, pos)) AS seen FROM w GROUP BY ALL)
SELECT deck, slide, row_number() OVER (PARTITION BY deck, slide ORDER BY n DESC, seen) AS rank, term, n FROM c QUALIFY rank <= 10""",
    "tfidf": f"WITH {a.LINES}, {_TFIDF} SELECT deck, slide, line_idx, term, tf, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY deck, slide, line_idx)), 6) AS weight FROM tx",
    "keypoints_dedup": f"""WITH {a.LINES}, {_RULES}, {_ASSEMBLE}, p AS (SELECT deck, slide, 0 AS o, 'title' AS source, 0 AS pos, title AS text, 1.0 AS importance FROM tit UNION ALL
SELECT deck, slide, CASE WHEN line_idx % 2 = 0 THEN 1 ELSE 3 END, CASE WHEN line_idx % 2 = 0 THEN 'bullet' ELSE 'body' END, line_idx, line, CASE WHEN line_idx % 2 = 0 THEN .8 ELSE .4 END FROM slide_lines),
q AS (SELECT * FROM p WHERE trim(text) <> '' QUALIFY row_number() OVER (PARTITION BY deck, slide, lower(trim(text)) ORDER BY o, pos) = 1)
SELECT deck, slide, row_number() OVER (PARTITION BY deck, slide ORDER BY o, pos) - 1 AS kp_idx, md5(trim(text)) AS text_md5, source, importance::DOUBLE AS importance FROM q""",
    "visual_captions": f"""WITH {a.LINES}, i AS (SELECT deck, slide, line_idx AS item, ['image', 'table', 'chart'][line_idx % 3 + 1] AS type, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS raw, line_idx % 3 = 0 AND trim(line) <> '' AS sure, CASE WHEN line_idx % 3 = 2 THEN 'bar_chart' END AS chart FROM slide_lines),
c AS (SELECT deck, slide, item, CASE WHEN sure THEN CASE WHEN length(raw) > 80 THEN rtrim(raw[1:80]) || '...' ELSE raw END ELSE chart END AS caption FROM i WHERE sure OR chart IS NOT NULL
  UNION ALL SELECT deck, slide, min(item) + 1000000, type || ' x' || count(*) FROM i WHERE NOT sure AND chart IS NULL GROUP BY deck, slide, type)
SELECT deck, slide, item, md5(caption) AS caption_md5 FROM c QUALIFY row_number() OVER (PARTITION BY deck, slide, lower(caption) ORDER BY item) = 1""",
    "deck_validation": f"""WITH {a.LINES}, s AS (SELECT DISTINCT deck, slide FROM slide_lines), g AS (SELECT deck, count(*) AS n, list(slide ORDER BY slide) AS found, list(slide ORDER BY slide) FILTER (slide <= 9 OR deck % 3 > 0) AS held FROM s GROUP BY deck)
SELECT deck, n, found = range(1, n + 1) AS numbered, coalesce(held = range(1, n + 1), false) AS sectioned FROM g""",
    "caption_cache": "SELECT sha256(html) AS content_key, count(*) AS n_pages, min(page_id) AS first_page FROM pages GROUP BY 1",
}
