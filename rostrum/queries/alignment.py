"""Queries on chunking and alignment of units; decoders are tested against exhaustive search instead of SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.operators import align, chunking
from rostrum.sources import adapters as a


def _units(spark, sf):
    u = a.unit_sim(spark, sf)
    t = u.select("session_id", "unit_id").distinct().select("session_id", "unit_id", (F.col("unit_id") % 50 * 2.0).alias("start_sec"), (F.col("unit_id") % 50 * 2.0 + 1.5).alias("end_sec"))
    return u.select("session_id", "unit_id", "slide_id", "sim"), t


def align_units(spark, sf):
    return align.align_units(*_units(spark, sf))


def align_free(spark, sf):
    return align.decode_free_sql(_units(spark, sf)[0])


def word_chunks(spark, sf):
    """Words of a talk in chunks by pause, duration and length, short ones merged."""
    return chunking.chunks(a.words(spark, sf))


def pause_chunks(spark, sf):
    """Chunks by pauses alone."""
    return chunking.by_pause(a.words(spark, sf))


def sentence_packs(spark, sf):
    """Sentences of each turn packed into pieces of bounded length."""
    c = a.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("slide_id"), "text")
    return chunking.pack_sentences(c)


def cue_matches(spark, sf):
    """Where a slide's first words are first said together."""
    w = a.words(spark, sf)
    titles = w.where("slide_id > 1").groupBy("session_id", "slide_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("word_idx", F.lower("word").alias("w")))), 1, 4), lambda r: r["w"]).alias("tokens"))
    return chunking.cues(w, titles)


QUERIES = {f.__name__: f for f in (align_units, align_free, word_chunks, pause_chunks, sentence_packs, cue_matches)}
ORACLE = {
    "pause_chunks": f"""WITH {a.WORDS}, g AS (SELECT *, (start_ms - lag(end_ms) OVER w >= 900)::INT AS n FROM words WINDOW w AS (PARTITION BY session_id ORDER BY word_idx)),
c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY session_id ORDER BY word_idx), 0) AS chunk FROM g)
SELECT session_id, chunk::BIGINT AS chunk, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_words FROM c GROUP BY session_id, chunk""",
    "cue_matches": f"""WITH {a.WORDS}, t AS (SELECT session_id, slide_id, list_distinct(list(lower(word) ORDER BY word_idx)[1:4]) AS tokens FROM words WHERE slide_id > 1 GROUP BY ALL),
w AS (SELECT session_id, word_idx, start_ms, list(lower(word)) OVER (PARTITION BY session_id ORDER BY word_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS near FROM words)
SELECT t.session_id, t.slide_id, min(start_ms) AS start_ms FROM t JOIN w ON w.session_id = t.session_id AND len(list_intersect(tokens, near)) >= 2 GROUP BY ALL""",
}
