"""Queries on joins, anchors, channels, sections and snapshots, with the same results in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.functions.score import edge
from rostrum.operators import anchors as an
from rostrum.operators import chunking, coherence, deck
from rostrum.operators import delivery as d
from rostrum.operators import evaluate as ev
from rostrum.operators import prepare as p
from rostrum.operators import report as r
from rostrum.operators import vectors as v
from rostrum.queries import report as rq
from rostrum.sources import adapters as a

FILLERS = ("the", "that", "que", "der")
#: Letters of any script, in both engines.
NOUN = r"\p{L}{2,}"


def fillers_by_time(spark, sf):
    """Slides begin 0.8 s late, so some words lie between slides."""
    w = a.words(spark, sf)
    return d.fillers_by_time(w, a.segments(w).withColumn("start_ms", F.col("start_ms") + 800), FILLERS)


def _segments(w):
    text = w.groupBy("session_id", "slide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word"))), lambda x: x["word"]), " ").alias("text"))
    s = a.segments(w).join(text, ["session_id", "slide_id"])
    return s.select("session_id", "slide_id", (F.col("start_ms") / 1000.0).alias("start_sec"), (F.col("end_ms") / 1000.0).alias("end_sec"), "text", F.lit("").alias("flags"))


def missing_segments(spark, sf):
    """Each talk has two more slides than turns."""
    s = _segments(a.words(spark, sf))
    slides = s.groupBy("session_id").agg(F.max("slide_id").alias("n")).select("session_id", F.explode(F.sequence(F.lit(1), F.col("n") + 2)).alias("slide_id"))
    return d.with_missing(slides, s).withColumn("text", F.md5(F.col("text").cast("binary")))


def segment_structs(spark, sf):
    w = a.words(spark, sf)
    x = d.segment_structs(_segments(w), w).select("session_id", "segment.*")
    return x.select("session_id", "slide_id", "start_sec", "end_sec", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.size("words").alias("n_words"), F.element_at("words", 1)["word"].alias("first_word"), F.element_at("words", -1)["end"].alias("last_end"), F.size("warning_flags").alias("n_flags"))


def _points(spark, sf):
    """Key points of slides with captions made from a document's fields."""
    doc = a.table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("deck"), (F.col("doc_id") % 10 + 1).cast("int").alias("slide"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    points = doc.select("deck", "slide", F.lit("body").alias("source"), "text", F.lit(0.4).alias("importance"))
    captions = doc.select("deck", "slide", F.concat(F.lit("type "), "lang").alias("slide_type"), F.when(F.col("n_chars") % 3 == 0, "none").otherwise(F.col("source")).alias("visual_kind"), F.when(F.col("n_chars") % 2 == 0, "opening").alias("role_in_flow"), F.md5(F.col("text").cast("binary")).alias("main_claim"), F.lit("").alias("visual_summary"), F.array("lang", F.upper("lang"), "source").alias("entities"), F.array("source").alias("keywords"))
    terms = doc.groupBy("deck").agg(F.array_sort(F.collect_set("source")).alias("terms"))
    return deck.caption_keypoints(points, captions, terms)


def caption_points(spark, sf):
    return _points(spark, sf).withColumn("text", F.md5(F.lower("text").cast("binary")))


def slide_channels(spark, sf):
    one = a.table(spark, sf, "documents").select(F.expr("doc_id div 10").alias("deck"), (F.col("doc_id") % 10 + 1).cast("int").alias("slide"), F.lit(0).alias("kp_idx"), F.lit("title").alias("source"), F.concat_ws(" ", "lang", "source", F.when(F.col("n_chars") % 2 == 0, F.lit("of the talk"))).alias("text"), F.lit(1.0).alias("importance"))
    both = one.unionByName(_points(spark, sf).withColumn("kp_idx", F.lit(1)))
    c = deck.slide_channels(both, NOUN)
    return c.select("deck", "slide", "title", F.array_join("title_tokens", " ").alias("title_tokens"), F.md5(F.array_join("tokens", " ").cast("binary")).alias("tokens_md5"), "slide_type", "visual_kind", "has_vlm", "visual_heavy", "title_weight")


def _vectors(spark, sf):
    return a.table(spark, sf, "embeddings").select(F.expr("vec_id div 50").alias("session_id"), F.col("label").cast("int").alias("slide_id"), (F.col("vec_id") % 50 * 2.0).alias("t"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 4 * 1.0).alias("dur"))


def pooled_chunks(spark, sf):
    x = v.pooled(_vectors(spark, sf).select("session_id", "slide_id", "v", F.col("t").alias("lo"), (F.col("t") + F.col("dur")).alias("hi")), ["session_id", "slide_id"])
    return x.select("session_id", "slide_id", edge(v.dot("pooled", "pooled"), 5).alias("square"), edge(F.aggregate("pooled", F.lit(0.0), lambda s, y: s + y), 5).alias("total"))


def embedding_norms(spark, sf):
    x = _vectors(spark, sf)
    spans = x.select("session_id").distinct().select("session_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    spans = spans.select("session_id", (F.col("k") + 1).alias("slide_id"), (F.col("k") * 20.0).alias("lo"), (F.col("k") * 20.0 + 20).alias("hi"))
    n = v.norms(x, spans)
    return n.select("session_id", "slide_id", edge(F.col("norm_mean"), 5).alias("norm_mean"), edge(F.col("norm_std"), 5).alias("norm_std"))


def _flags(spark, sf):
    f = a.frames(spark, sf)
    return f.select("session_id", (F.col("frame_idx") % 5 + 1).cast("int").alias("slide_id"), F.col("silence").cast("int").alias("gold"), (F.col("energy") < 20).cast("int").alias("pred"), "energy", "pitch", "t", "speech_rate_per_sec")


def silence_f1(spark, sf):
    return ev.silence_f1(_flags(spark, sf)).withColumn("f1", edge(F.col("f1")))


def attitude_metrics(spark, sf):
    f = _flags(spark, sf)
    changes = f.groupBy("session_id").agg(F.array_sort(F.collect_list(F.when(F.col("gold") == 1, F.col("t")))).alias("gold"), F.array_sort(F.collect_list(F.when(F.col("pred") == 1, F.col("t")))).alias("pred"))
    rates = f.groupBy("session_id").agg(F.avg("speech_rate_per_sec").alias("gold"), F.avg("pitch").alias("pred"))
    return ev.attitude_metrics(f, rates, f.select("session_id", "slide_id", F.col("energy").alias("x"), F.col("pitch").alias("y")), changes)


def label_targets(spark, sf):
    """Customers as labels; those with events have audio."""
    c = a.table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("audio_name"), (F.col("c_custkey") % 40 + 1).alias("n_words"), (F.col("c_acctbal").cast("double") * 10).alias("duration_ms"))
    audio = p.audio_targets(a.frames(spark, sf), ["session_id"]).select(F.col("session_id").cast("long").alias("audio_name"), "silence_ratio", "energy_drop", "pitch_shift")
    x = p.label_rows(c, audio)
    return x.select("audio_name", "from_audio", "energy_drop", "pitch_shift", *[edge(F.col(k), 4).alias(k) for k in ("speech_rate", "silence_ratio")])


def clip_segments(spark, sf):
    li = a.table(spark, sf, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("audio_path"), F.col("l_quantity").cast("double").alias("duration_sec"))
    return p.clip_segments(li, [0.0, 12.5, 30.0, 45.0])


def manifest_rejects(spark, sf):
    li = a.table(spark, sf, "lineitem")
    rows = li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("audio_path"), F.when(F.col("l_linenumber") < 6, F.col("l_quantity").cast("double").cast("string")).alias("speech_rate"), F.when(F.col("l_returnflag") == "A", "bad").otherwise(F.col("l_discount").cast("double").cast("string")).alias("silence_ratio"), F.when(F.col("l_linestatus") == "F", "yes").otherwise("maybe").alias("energy_drop"))
    x = p.normalise(rows, ["speech_rate", "silence_ratio"], ["energy_drop"], prefix="clips/")
    return x


def two_way_split(spark, sf):
    return p.split_two(a.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", 0.85)


def subset_rows(spark, sf):
    return p.subset(a.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key")), "key", 500, 0.9, 0.1)


def _dwell(spark, sf):
    w = a.words(spark, sf)
    return d.dwell(a.segments(w), w.groupBy("session_id", "slide_id").agg(F.count("*").alias("word_count")))


def probe_rows(spark, sf):
    """Delivery rows with the public results of a probe on the slides that gold labels cover."""
    g = a.gold_pred(spark, sf).select("session_id", "slide_id", F.col("pred").alias("ae_probe_speech_rate"), F.col("gold").alias("ae_probe_silence_ratio"), (F.col("gold") * F.col("pred")).alias("ae_probe_overall_delivery"), F.lit(0.5).alias("ae_probe_energy_drop_prob"))
    x = r.with_probe(_dwell(spark, sf).select("session_id", "slide_id", "word_count"), g)
    return x.select("session_id", "slide_id", "word_count", *[edge(F.col(c)).alias(c) for c in r.PUBLIC_PROBE])


def _roles(spark, sf):
    g = a.gold_pred(spark, sf).where("slide_id <= 3")
    role = F.when(F.col("slide_id") == 1, "cover").when(F.col("slide_id") == 2, "agenda").otherwise("content")
    return g.select("session_id", "slide_id", role.alias("role"), F.lit("rule").alias("source"), F.concat(F.lit("slide_"), F.col("slide_id").cast("string")).alias("reason"), F.when(F.col("slide_id") == 1, 0.0).when(F.col("slide_id") == 2, 0.5).otherwise(1.0).alias("coverage_weight"))


def slide_detail(spark, sf):
    s = rq._slides(spark, sf)
    stable = _dwell(spark, sf).select("session_id", "slide_id", (F.least(F.col("words_per_sec"), F.lit(2.0)) * 50).alias("delivery_stability"))
    x = r.slide_detail(s, _roles(spark, sf), stable)
    return x.select("session_id", "slide_id", "slide_role", "slide_role_source", "slide_role_reason", "coverage_weight", *[edge(F.col(c)).alias(c) for c in ("coverage", "semantic_coverage", "keypoint_coverage", "silence_ratio", "dwell_z")], "trend", F.array_join("missed", "|").alias("missed"), F.array_join("visual_missed", "|").alias("visual_missed"), "delivery_stability")


def _coverage(spark, sf):
    g = a.gold_pred(spark, sf).select("session_id", "slide_id", F.col("pred").alias("coverage"))
    return g.join(_roles(spark, sf).select("session_id", "slide_id", "coverage_weight"), ["session_id", "slide_id"], "left").withColumn("coverage_weight", F.coalesce("coverage_weight", F.lit(1.0)))


def _overall_all(spark, sf):
    s = _dwell(spark, sf)
    return r.overall_all(coherence.coverage_score(_coverage(spark, sf)), d.stability(s), d.pacing(s.withColumnRenamed("words_per_sec", "rate")))


def overall_all(spark, sf):
    return _overall_all(spark, sf)


def global_summary(spark, sf):
    g = _coverage(spark, sf).select("session_id", "slide_id")
    s = g.join(_dwell(spark, sf).select("session_id", "slide_id", F.col("words_per_sec").alias("speech_rate"), (F.col("word_count") % 10 / 20.0).alias("silence_ratio"), (F.col("word_count") % 4).alias("change_points")), ["session_id", "slide_id"], "left")
    x = r.global_summary(s, _overall_all(spark, sf).select("session_id", "content_coverage", "summary"))
    return x.select("session_id", "total_slides", edge(F.col("mean_speech_rate"), 5).alias("mean_speech_rate"), edge(F.col("mean_silence_ratio"), 5).alias("mean_silence_ratio"), "total_change_points", "content_coverage", "summary")


def report_sections(spark, sf):
    w = a.words(spark, sf)
    comments = a.table(spark, sf, "conversations").where("turn % 2 = 0").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("slide_id"), F.md5(F.col("text").cast("binary")).alias("comment"))
    return r.sections(_coverage(spark, sf), _segments(w), comments)


def calibration_snapshot(spark, sf):
    i = rq._issues(spark, sf)
    slides = _coverage(spark, sf).join(_roles(spark, sf).select("session_id", "slide_id", "role"), ["session_id", "slide_id"], "left").withColumn("role", F.coalesce("role", F.lit("content")))
    al = _coverage(spark, sf).groupBy("session_id").agg((F.count("*") / 100.0).alias("confidence"), F.count("*").alias("n_boundaries")).withColumn("n_warnings", F.col("session_id") % 3)
    return r.calibration_snapshot(i, r.severity(i), r.feedback(i, rq._templates(spark, sf)), slides, al)


def _units(spark, sf):
    """Eight words are a unit; its slide is that of its last word."""
    w = a.words(spark, sf).withColumn("unit_id", F.expr("word_idx div 8"))
    g = w.groupBy("session_id", "unit_id").agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"), F.max("slide_id").alias("slide_id"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("w"))
    return g.select("session_id", "unit_id", (F.col("a") / 1000.0).alias("start_sec"), (F.col("b") / 1000.0).alias("end_sec"), "slide_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("text"), F.transform("w", lambda x: F.lower(x["word"])).alias("tokens"))


def _deck(spark, sf):
    """A slide's title is its first two words; the last slide of every other talk says thanks."""
    w = a.words(spark, sf)
    g = w.groupBy("session_id", "slide_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("word_idx", F.lower("word").alias("w")))), 1, 2), lambda x: x["w"]).alias("title_tokens"))
    return g.withColumn("text", F.when(F.col("session_id") % 2 == 0, "Thank you").otherwise("Summary"))


CUES = ("the", "que")


def edge_anchors(spark, sf):
    return an.edge_anchors(_units(spark, sf), _deck(spark, sf), CUES)


def anchored_units(spark, sf):
    u, s = _units(spark, sf), _deck(spark, sf)
    return an.apply_anchors(u.select("session_id", "unit_id", "slide_id"), u, an.edge_anchors(u, s, CUES), s.groupBy("session_id").agg(F.max("slide_id").alias("n_slides")))


def alignment_choice(spark, sf):
    """Orders as talks: the clerk's boundaries are broken, given or absent."""
    o = a.table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    some = F.array(F.lit(0.0), F.col("o_totalprice").cast("double"))
    rows = o.select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_custkey") % 4 == 0, "hybrid").when(F.col("o_custkey") % 4 == 1, " Auto").when(F.col("o_custkey") % 7 == 2, "magic").alias("mode"), F.when(k.isin(1, 2), some).alias("manual"), F.when(k == 3, "too_few").alias("manual_error"), F.when(k == 1, F.array(F.lit("start_added"))).alias("manual_warnings"), F.array(F.lit(0.0), F.lit(9.0)).alias("auto"), F.when(F.col("o_orderstatus") == "F", "auto").otherwise("robust").alias("auto_strategy"), F.array(F.lit("low")).alias("auto_warnings"))
    x = an.choose(rows)
    return x.select("session_id", "mode", "strategy", F.element_at("boundaries", -1).alias("until"), F.size(F.coalesce("proposed", F.array().cast("array<double>"))).alias("n_proposed"), "warnings", "error")


def refined_boundaries(spark, sf):
    """Boundaries of units moved to where titles are said; tested against a plain loop."""
    u = _units(spark, sf)
    n = u.groupBy("session_id").agg(F.max("slide_id").alias("n_slides"))
    b = coherence.boundaries(u.select("session_id", "unit_id", "slide_id"), u.select("session_id", "unit_id", "start_sec", "end_sec"), n)
    words = a.words(spark, sf).select("session_id", F.expr("word_idx div 8").alias("unit_id"), "word_idx", F.lower("word").alias("token"), (F.col("start_ms") / 1000.0).alias("start_sec"))
    t = _deck(spark, sf).select("session_id", "slide_id", F.array_join("title_tokens", " ").alias("title"), F.col("title_tokens").alias("tokens"))
    return chunking.refine(b, u.select("session_id", "unit_id", "slide_id", "start_sec"), words, t).select("session_id", F.array_join(F.transform("b", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("b"))


def sentence_buckets(spark, sf):
    b = chunking.sentence_buckets(a.words(spark, sf))
    return b.groupBy("session_id", F.col("bucket").cast("long").alias("bucket")).agg(F.min("word_idx").alias("first_word"), F.count("*").alias("n_words"))


def sentence_chunks(spark, sf):
    """Chunks that end with sentences, short ones joined; tested against a plain loop."""
    return chunking.chunks(a.words(spark, sf), by_sentence=True)


QUERIES = {f.__name__: f for f in (fillers_by_time, missing_segments, segment_structs, caption_points, slide_channels, pooled_chunks, embedding_norms, silence_f1, attitude_metrics, label_targets, clip_segments, manifest_rejects, two_way_split, subset_rows, probe_rows, slide_detail, overall_all, global_summary, report_sections, calibration_snapshot, edge_anchors, anchored_units, alignment_choice, refined_boundaries, sentence_buckets, sentence_chunks)}

_SEG = """sg AS (SELECT s.session_id, s.slide_id, s.start_ms / 1000.0::DOUBLE AS start_sec, s.end_ms / 1000.0::DOUBLE AS end_sec, string_agg(word, ' ' ORDER BY word_idx) AS text, count(*) AS n_words,
  arg_min(word, word_idx) AS first_word, max(w.end_ms) / 1000.0::DOUBLE AS last_end FROM segments s JOIN words w USING (session_id, slide_id) GROUP BY ALL)"""
_DOC = "doc AS (SELECT doc_id // 10 AS deck, (doc_id % 10 + 1)::INT AS slide, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, n_chars FROM documents)"
_POINTS = f"""{_DOC},
kp AS (SELECT deck, slide, 'body' AS source, text, .4::DOUBLE AS importance FROM doc
  UNION ALL SELECT deck, slide, 'vlm_slide_type', 'type ' || lang, .25 FROM doc
  UNION ALL SELECT deck, slide, 'vlm_visual_kind', CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE source END, .2 FROM doc
  UNION ALL SELECT deck, slide, 'vlm_role', 'opening', .75 FROM doc WHERE n_chars % 2 = 0
  UNION ALL SELECT deck, slide, 'vlm_claim', md5(text), .95 FROM doc
  UNION ALL SELECT deck, slide, 'vlm_entity', unnest([lang, upper(lang), source]), .45 FROM doc
  UNION ALL SELECT deck, slide, 'vlm_keyword', source, .45 FROM doc
  UNION ALL SELECT deck, slide, 'vlm_core_term', term, .35 FROM doc JOIN (SELECT DISTINCT deck, source AS term FROM doc) USING (deck)),
pts AS (SELECT deck, slide, source, max(text) AS text, max(importance) AS importance FROM kp GROUP BY deck, slide, source, lower(text))"""
_ROLES = "roles AS (SELECT session_id, slide_id, CASE slide_id WHEN 1 THEN 'cover' WHEN 2 THEN 'agenda' ELSE 'content' END AS role, CASE slide_id WHEN 1 THEN 0 WHEN 2 THEN .5 ELSE 1 END::DOUBLE AS cw FROM gold_pred WHERE slide_id <= 3)"
_CV = """cv AS (SELECT g.session_id, g.slide_id, pred AS coverage, coalesce(cw, 1) AS w, coalesce(role, 'content') AS role FROM gold_pred g LEFT JOIN roles USING (session_id, slide_id))"""
_ALL = f"""{rq._OVERALL.split('oc AS')[0]}{_ROLES}, {_CV},
cs AS (SELECT session_id, avg(coverage) * 100 AS al, CASE WHEN sum(w) > 0 THEN sum(w * coverage) / sum(w) * 100 ELSE avg(coverage) * 100 END AS cc, count_if(w > 0) AS k FROM cv GROUP BY ALL),
od AS{rq._OVERALL.split('od AS')[1].split('ov AS')[0]}
oa AS (SELECT session_id, round_even(coalesce(cc, 0), 2) AS content_coverage, round_even({rq._curve('(coalesce(cc, 0) / 100)')}, 2) AS content_coverage_user, round_even(coalesce(ds, 50), 2) AS delivery_stability, round_even(coalesce(ps, 70), 2) AS pacing_score,
  coalesce(round_even(al, 2), 0) AS content_coverage_all, CASE WHEN al IS NULL THEN 0 ELSE round_even({rq._curve('(coalesce(al, 0) / 100)')}, 2) END::DOUBLE AS content_coverage_user_all, coalesce(k, 0) AS content_scored_slide_count FROM cs FULL JOIN od USING (session_id)),
oas AS (SELECT *, CASE WHEN content_coverage > 80 AND delivery_stability > 70 THEN 'summary_high' WHEN content_coverage < 60 OR delivery_stability < 50 THEN 'summary_low' ELSE 'summary_mid' END AS summary FROM oa)"""
_UNITS = """
un AS (SELECT session_id, word_idx // 8 AS unit_id, min(start_ms) / 1000.0::DOUBLE AS start_sec, max(end_ms) / 1000.0::DOUBLE AS end_sec, max(slide_id) AS slide_id, string_agg(word, '' ORDER BY word_idx) AS tight, list(lower(word)) AS tokens FROM words GROUP BY session_id, word_idx // 8),
dk AS (SELECT session_id, max(slide_id) AS n FROM words GROUP BY ALL),
t2 AS (SELECT session_id, list(lower(word) ORDER BY word_idx)[1:2] AS next FROM words WHERE slide_id = 2 GROUP BY ALL),
ue AS (SELECT un.*, n, coalesce(next, []) AS next, max(end_sec) OVER w AS audio_end, greatest(8, least(20, max(end_sec) OVER w * .15::DOUBLE)) AS win, row_number() OVER (PARTITION BY session_id ORDER BY unit_id) AS nth, lag(end_sec) OVER (PARTITION BY session_id ORDER BY unit_id) AS prev
  FROM un JOIN dk USING (session_id) LEFT JOIN t2 USING (session_id) WINDOW w AS (PARTITION BY session_id)),
an0 AS (SELECT session_id, any_value(audio_end) AS audio_end, any_value(win) AS win, max(end_sec) FILTER (end_sec <= win + 2 + 1e-6) AS inside, arg_min(prev, nth) FILTER (nth > 1 AND end_sec <= win + 2 + 1e-6 AND list_has_any(tokens, next)) AS titled,
  min(end_sec) FILTER (nth = 1 AND end_sec <= win + 2 + 1e-6 AND end_sec - start_sec >= 3) AS fe, arg_max(start_sec, nth) FILTER (contains(tight, 'the') OR contains(tight, 'que')) AS cue FROM ue GROUP BY session_id),
anc AS (SELECT session_id, CASE WHEN inside IS NULL THEN win ELSE coalesce(titled, fe, inside) END AS cover_end_sec, CASE WHEN session_id % 2 = 0 THEN CASE WHEN cue >= audio_end * .85::DOUBLE THEN cue ELSE audio_end END END AS thanks_start_sec, audio_end FROM an0)"""
_VEC = "e0 AS (SELECT vec_id // 50 AS session_id, label::INT AS slide_id, vec_id % 50 * 2.0::DOUBLE AS t, embedding::DOUBLE[] AS v, vec_id % 4 AS w FROM embeddings)"


def _ranked(n: str) -> str:
    return f"SELECT o_orderkey::VARCHAR AS key, row_number() OVER (ORDER BY ('0x' || substr(md5(o_orderkey || '|42'), 1, 15))::BIGINT) AS r, {n} AS n FROM orders"


ORACLE = {
    "fillers_by_time": f"""WITH {a.WORDS}, b AS (SELECT session_id, slide_id, start_ms + 800 AS lo, end_ms AS hi FROM segments)
SELECT b.session_id, b.slide_id, count(word) AS word_count, count_if(regexp_full_match(lower(trim(word)), '(the|that|que|der)')) AS filler_count, coalesce(round_even(count_if(regexp_full_match(lower(trim(word)), '(the|that|que|der)')) / nullif(count(word), 0), 4), 0) AS filler_rate
FROM b LEFT JOIN words w ON w.session_id = b.session_id AND w.start_ms >= lo AND w.start_ms < hi GROUP BY ALL""",
    "missing_segments": f"""WITH {a.WORDS}, {_SEG}, sl AS (SELECT session_id, unnest(range(1, max(slide_id) + 3))::INT AS slide_id FROM sg GROUP BY session_id)
SELECT session_id, slide_id, coalesce(start_sec, 0) AS start_sec, coalesce(end_sec, 0) AS end_sec, md5(coalesce(text, '')) AS text, CASE WHEN text IS NULL THEN 'missing_segment' ELSE '' END AS flags FROM sl LEFT JOIN sg USING (session_id, slide_id)""",
    "segment_structs": f"WITH {a.WORDS}, {_SEG} SELECT session_id, slide_id, start_sec, end_sec, md5(text) AS text_md5, n_words, first_word, last_end, 0 AS n_flags FROM sg",
    "caption_points": f"WITH {_POINTS} SELECT deck, slide, source, md5(lower(text)) AS text, importance FROM pts",
    "slide_channels": f"""WITH {_POINTS}, tt AS (SELECT deck, slide, CASE WHEN n_chars % 2 = 0 THEN concat_ws(' ', d.lang, d.source, 'of the talk') ELSE concat_ws(' ', d.lang, d.source) END AS title FROM (SELECT doc_id // 10 AS deck, (doc_id % 10 + 1)::INT AS slide, lang, source, n_chars FROM documents) d),
tk AS (SELECT deck, slide, unnest(list_transform(regexp_extract_all(title, '{NOUN}'), lambda x: lower(x))) AS t FROM tt UNION ALL SELECT deck, slide, lower(text) FROM pts WHERE source IN ('body', 'vlm_entity', 'vlm_keyword', 'vlm_core_term') AND trim(text) <> ''),
al AS (SELECT deck, slide, md5(string_agg(DISTINCT t, ' ' ORDER BY t)) AS tokens_md5 FROM tk GROUP BY ALL),
k AS (SELECT deck, slide, max(trim(text)) FILTER (source = 'vlm_slide_type' AND trim(text) <> '') AS slide_type, max(trim(text)) FILTER (source = 'vlm_visual_kind' AND trim(text) <> '') AS visual_kind FROM pts GROUP BY ALL)
SELECT deck, slide, title, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(title, '{NOUN}'), lambda x: lower(x)))), ' ') AS title_tokens, tokens_md5, slide_type, visual_kind, true AS has_vlm, coalesce(visual_kind <> 'none', false) AS visual_heavy,
  CASE WHEN len(list_filter(string_split(title, ' '), lambda x: x <> '')) <= 2 OR length(replace(title, ' ', '')) <= 6 THEN .55::DOUBLE ELSE .35::DOUBLE END AS title_weight FROM tt JOIN al USING (deck, slide) JOIN k USING (deck, slide)""",
    "pooled_chunks": f"""WITH {_VEC}, m AS (SELECT session_id, slide_id, i, sum(x * w) / sum(w) AS x FROM (SELECT session_id, slide_id, w, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e0) GROUP BY ALL HAVING sum(w) > 0)
SELECT session_id, slide_id, round_even(sum(x * x), 5) AS square, round_even(sum(x), 5) AS total FROM m GROUP BY ALL""",
    "embedding_norms": f"""WITH {_VEC}, n AS (SELECT session_id, t, sqrt(list_dot_product(v, v)) AS n FROM e0), s AS (SELECT session_id, k + 1 AS slide_id, k * 20 AS lo, k * 20 + 20 AS hi FROM (SELECT DISTINCT session_id, unnest(range(0, 5))::INT AS k FROM n))
SELECT session_id, slide_id, round_even(avg(n), 5) AS norm_mean, round_even(stddev_pop(n), 5) AS norm_std FROM s JOIN n USING (session_id) WHERE t BETWEEN lo AND hi GROUP BY ALL""",
    "silence_f1": f"""WITH {a.FRAMES}, f AS (SELECT session_id, (frame_idx % 5 + 1)::INT AS slide_id, count_if(silence AND energy < 20) AS tp, count_if(energy < 20) AS np, count_if(silence) AS ng FROM frames GROUP BY ALL)
SELECT session_id, slide_id, coalesce(round_even(2 * tp / nullif(np + ng, 0), 6), 0) AS f1 FROM f""",
    "label_targets": f"""WITH {a.FRAMES}, q AS (SELECT *, (energy < max(energy) OVER (PARTITION BY session_id) - 40)::INT AS quiet FROM frames),
au AS (SELECT session_id, avg(quiet) AS sr, CASE WHEN stddev_pop(t) > 0 THEN regr_slope(energy, t) END AS sl, stddev_pop(pitch) FILTER (pitch > 0) AS sd, count(*) FILTER (pitch > 0) AS n FROM q GROUP BY ALL),
c AS (SELECT c_custkey, (c_custkey % 40 + 1) / greatest(1e-6, c_acctbal::DOUBLE * 10 / 1000) AS rate FROM customer WHERE c_acctbal > 0)
SELECT c_custkey AS audio_name, session_id IS NOT NULL AS from_audio, CASE WHEN session_id IS NULL THEN 0 ELSE (coalesce(sl, 0) < -.02)::INT END AS energy_drop, CASE WHEN session_id IS NULL THEN 0 ELSE (coalesce(sd, 0) > 80 AND n > 10)::INT END AS pitch_shift, round_even(rate, 4) AS speech_rate,
  round_even(CASE WHEN session_id IS NULL THEN greatest(.05::DOUBLE, least(.6::DOUBLE, .45::DOUBLE - .08::DOUBLE * rate)) ELSE sr END, 4) AS silence_ratio FROM c LEFT JOIN au ON session_id = c_custkey""",
    "clip_segments": """SELECT l_orderkey || '/' || l_linenumber AS audio_path, s AS slide_id, lo AS start_sec, least(hi, l_quantity)::DOUBLE AS end_sec FROM lineitem, (VALUES (1, 0::DOUBLE, 12.5::DOUBLE), (2, 12.5, 30), (3, 30, 45)) v(s, lo, hi) WHERE least(hi, l_quantity) > lo""",
    "manifest_rejects": """SELECT 'clips/' || l_orderkey || '/' || l_linenumber AS audio_path, CASE WHEN l_linenumber < 6 THEN l_quantity::DOUBLE END AS speech_rate, CASE WHEN l_returnflag <> 'A' THEN l_discount::DOUBLE END AS silence_ratio, CASE WHEN l_linestatus = 'F' THEN 1 END AS energy_drop,
  CASE WHEN l_linenumber >= 6 THEN 'missing_speech_rate' WHEN l_returnflag = 'A' THEN 'invalid_silence_ratio' WHEN l_linestatus <> 'F' THEN 'invalid_energy_drop' END AS reason FROM lineitem""",
    "two_way_split": f"WITH x AS ({_ranked('count(*) OVER ()')}) SELECT key, CASE WHEN r <= least(greatest(1, floor(n * .85::DOUBLE)), n - 1) THEN 'train' ELSE 'valid' END AS split FROM x",
    "subset_rows": f"WITH x AS ({_ranked('least(500, count(*) OVER ())')}) SELECT key, CASE WHEN r <= greatest(1, floor(n * .9::DOUBLE)) THEN 'train' WHEN r <= n - 1 THEN 'valid' ELSE 'test' END AS split FROM x WHERE r <= n",
    "probe_rows": f"""WITH {rq._DWELL}, {a.GOLD} SELECT session_id, slide_id, word_count, round_even(pred, 6) AS ae_probe_speech_rate, round_even(gold, 6) AS ae_probe_silence_ratio, round_even(gold * pred, 6) AS ae_probe_overall_delivery FROM ae LEFT JOIN gold_pred USING (session_id, slide_id)""",
    "slide_detail": f"""WITH {rq._SLIDES}, {_ROLES}, y AS (SELECT session_id, slide_id, rate FROM ae)
SELECT s.session_id, s.slide_id, coalesce(role, 'content') AS slide_role, CASE WHEN role IS NULL THEN 'default' ELSE 'rule' END AS slide_role_source, CASE WHEN role IS NULL THEN 'no_role_metadata' ELSE 'slide_' || s.slide_id END AS slide_role_reason, coalesce(cw, 1) AS coverage_weight,
  round_even(coverage, 6) AS coverage, round_even(coverage, 6) AS semantic_coverage, round_even(kc, 6) AS keypoint_coverage, round_even(wc % 10 / 20.0::DOUBLE, 6) AS silence_ratio, round_even(dwell_z, 6) AS dwell_z,
  CASE WHEN has_ae THEN CASE WHEN wc % 3 = 0 THEN 'decreasing_speed' WHEN wc % 5 = 0 THEN 'increasing_speed' ELSE 'stable' END END AS trend, CASE WHEN n % 2 = 0 THEN 'text point' ELSE '' END AS missed, CASE WHEN n % 7 = 0 THEN 'VISUAL: sales by year' ELSE '' END AS visual_missed, CASE WHEN rate IS NOT NULL THEN round_even(least(rate, 2) * 50, 2) END AS delivery_stability
FROM sl s LEFT JOIN roles USING (session_id, slide_id) LEFT JOIN y USING (session_id, slide_id)""",
    "overall_all": f"WITH {_ALL} SELECT * FROM oas",
    "global_summary": f"""WITH {_ALL}, g AS (SELECT cv.session_id, count(*) AS total_slides, avg(rate) AS r, avg(word_count % 10 / 20.0::DOUBLE) AS s, sum(coalesce(word_count % 4, 0))::BIGINT AS c FROM cv LEFT JOIN ae USING (session_id, slide_id) GROUP BY ALL)
SELECT session_id, total_slides, round_even(r, 5) AS mean_speech_rate, round_even(s, 5) AS mean_silence_ratio, c AS total_change_points, content_coverage, summary FROM g LEFT JOIN oas USING (session_id)""",
    "report_sections": f"""WITH {a.WORDS}, {_SEG}, {a.GOLD}, co AS (SELECT conv_id AS session_id, (turn + 1)::INT AS slide_id, md5(text) AS comment FROM conversations WHERE turn % 2 = 0)
SELECT g.session_id, g.slide_id AS section_index, '슬라이드 ' || g.slide_id AS title, coalesce(trunc(start_sec), 0)::INT AS start_time_sec, coalesce(trunc(end_sec), 0)::INT AS end_time_sec, round_even(pred * 100, 0)::INT AS score, coalesce(comment, '') AS feedback
FROM gold_pred g LEFT JOIN sg USING (session_id, slide_id) LEFT JOIN co USING (session_id, slide_id)""",
    "calibration_snapshot": f"""WITH {rq._SLIDES}, {_ROLES}, {_CV}, ti AS (SELECT *, issue IN ('content_gap', 'title_missing', 'bullet_missing', 'visual_not_explained') AS ce FROM isr),
fb AS (WITH tp AS{rq.ORACLE['feedback_text'].split(' tp AS', 1)[1]})
SELECT session_id, 'issue' AS section, 'total' AS key, count(*)::DOUBLE AS value FROM ti GROUP BY ALL
UNION ALL SELECT session_id, 'ce_issue', 'total', count_if(ce) FROM ti GROUP BY ALL
UNION ALL SELECT session_id, 'issue', issue, count(*) FROM ti GROUP BY ALL
UNION ALL SELECT session_id, 'ce_issue', issue, count(*) FROM ti WHERE ce GROUP BY ALL
UNION ALL SELECT session_id, 'ce_issue', 'high_sections', count(*) FROM sev WHERE severity >= 6 AND EXISTS (SELECT 1 FROM ti WHERE ti.session_id = sev.session_id AND ti.slide_id = sev.slide_id AND ce) GROUP BY ALL
UNION ALL SELECT session_id, 'feedback', severity, count(*) FROM fb GROUP BY ALL
UNION ALL SELECT session_id, 'feedback', 'low_confidence', count_if(regexp_matches(text, '자동 매칭|신뢰도')) FROM fb GROUP BY ALL
UNION ALL SELECT session_id, 'role', role, count(*) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'slides', 'total', count(*) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'slides', 'content', count_if(w > 0 AND coverage IS NOT NULL) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'score', 'coverage_min', round_even(min(coverage), 4) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'score', 'coverage_max', round_even(max(coverage), 4) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'score', 'confidence', round_even(count(*) / 100, 4) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'alignment', 'boundaries', count(*) FROM cv GROUP BY ALL
UNION ALL SELECT session_id, 'alignment', 'warnings', session_id % 3 FROM cv GROUP BY ALL""",
    "edge_anchors": f"WITH {a.WORDS}, {_UNITS} SELECT * FROM anc",
    "anchored_units": f"""WITH {a.WORDS}, {_UNITS}, j AS (SELECT u.*, cover_end_sec AS ce, thanks_start_sec AS ts, CASE WHEN end_sec <= cover_end_sec + 1e-6 THEN 1 WHEN slide_id = 1 THEN 2 ELSE slide_id END AS k FROM ue u JOIN anc USING (session_id))
SELECT session_id, unit_id, CASE WHEN n = 1 THEN slide_id WHEN ts < audio_end AND start_sec >= ts THEN n WHEN ts IS NOT NULL THEN least(k, n - 1) ELSE k END::INT AS slide_id FROM j""",
    "alignment_choice": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS m, o_totalprice::DOUBLE AS p, CASE WHEN o_custkey % 4 = 0 THEN 'hybrid' WHEN o_custkey % 4 = 1 THEN 'auto' WHEN o_custkey % 7 = 2 THEN 'magic' WHEN o_orderkey % 5 IN (1, 2, 3) THEN 'manual' ELSE 'auto' END AS mode, CASE WHEN o_orderstatus = 'F' THEN 'auto' ELSE 'robust' END AS s FROM orders),
e AS (SELECT *, CASE WHEN mode = 'magic' THEN 'unsupported_mode' WHEN mode = 'manual' AND m = 3 THEN 'too_few' END AS error, CASE WHEN m = 1 THEN 'start_added' END AS ow FROM o)
SELECT k AS session_id, mode, CASE WHEN error IS NULL THEN CASE WHEN mode = 'manual' THEN 'manual' WHEN mode = 'auto' THEN s WHEN m = 3 THEN 'auto_after_invalid_manual' WHEN m IN (1, 2) THEN 'manual_with_auto_proposal' WHEN s = 'auto' THEN 'auto_without_manual_override' ELSE s END END AS strategy,
  CASE WHEN error IS NULL THEN CASE WHEN mode = 'manual' OR mode = 'hybrid' AND m IN (1, 2) THEN p ELSE 9 END END AS until, CASE WHEN mode = 'hybrid' AND m IN (1, 2) THEN 2 ELSE 0 END AS n_proposed,
  CASE WHEN error IS NULL THEN CASE WHEN mode = 'manual' THEN coalesce(ow, '') WHEN mode = 'hybrid' AND m = 3 THEN 'too_few,low' WHEN mode = 'hybrid' AND m NOT IN (1, 2) THEN 'low' ELSE concat_ws(',', ow, 'low') END END AS warnings, error FROM e""",
    "sentence_buckets": f"""WITH {a.WORDS}, b AS (SELECT *, coalesce(sum(regexp_matches(word, '[.!?…。]["''”’)\\]]*$')::INT) OVER (PARTITION BY session_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bucket FROM words)
SELECT session_id, bucket, min(word_idx) AS first_word, count(*) AS n_words FROM b GROUP BY ALL""",
}
