"""The engine's tables, derived from generic conversation, event, document, embedding and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped words: a conversation is a talk, a turn a slide; 0.4 s a word and a pause between turns."""
    c = table(spark, sf_dir, "conversations")
    w = c.select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).cast("int").alias("slide_id"), F.posexplode(F.filter(F.split("text", r"[ \n\t\r]+"), lambda x: x != "")).alias("p", "word"))
    w = w.withColumn("word_idx", F.row_number().over(Window.partitionBy("session_id").orderBy("slide_id", "p")) - 1)
    start = (F.col("word_idx") * 400 + (F.col("slide_id") - 1) * 1200).cast("long")
    return w.select("session_id", "slide_id", "word_idx", "word", start.alias("start_ms"), (start + 300).alias("end_ms"))


def segments(words_df: DataFrame) -> DataFrame:
    """Slides as [start, start of the next), the last to the last word's end; milliseconds."""
    s = words_df.groupBy("session_id", "slide_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("last"))
    w = Window.partitionBy("session_id").orderBy("slide_id")
    return s.select("session_id", "slide_id", "start_ms", F.coalesce(F.lead("start_ms").over(w), "last").alias("end_ms"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio frames: a user's events in order; t in hours since the first, energy the value, pitch from the properties, pace from the hour of day, errors are silence."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = e.withColumn("us", us)
    t = (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 3.6e9
    return e.select(F.col("user_id").alias("session_id"), (F.row_number().over(w) - 1).alias("frame_idx"), t.alias("t"), F.col("value").cast("double").alias("energy"), F.get_json_object("props", "$.k").cast("double").alias("pitch"), (F.floor(F.col("us") / 3_600_000_000) % 24 / 4.0).alias("speech_rate_per_sec"), (F.col("event_type") == "error").alias("silence"))


def frame_segments(frames_df: DataFrame, parts: int = 5) -> DataFrame:
    """Equal spans of each session's time."""
    s = frames_df.groupBy("session_id").agg(F.max("t").alias("top")).withColumn("slide_id", F.explode(F.sequence(F.lit(1), F.lit(parts))))
    return s.select("session_id", "slide_id", (F.col("top") * (F.col("slide_id") - 1) / parts).alias("lo"), (F.col("top") * F.col("slide_id") / parts).alias("hi"))


def slide_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deck lines: ten documents are a deck, a document a slide, a line a line."""
    d = table(spark, sf_dir, "documents")
    lines = d.select(F.expr("doc_id div 10").alias("deck"), (F.col("doc_id") % 10 + 1).cast("int").alias("slide"), F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    return lines.withColumn("y0", F.col("line_idx") * 20.0).withColumn("font_size", F.when(F.col("line_idx") == 0, 28.0).otherwise(14.0))


def gold_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold quality and a length-based prediction."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.expr("doc_id div 10").alias("session_id"), (F.col("doc_id") % 10 + 1).cast("int").alias("slide_id"), F.col("quality").cast("double").alias("gold"), F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("pred"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows: an order line is a clip."""
    li = table(spark, sf_dir, "lineitem")
    rate = F.col("l_quantity").cast("double") / (F.col("l_extendedprice").cast("double") / 1000.0)
    return li.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("audio_path"), rate.alias("speech_rate"), F.col("l_discount").cast("double").alias("silence_ratio"), (F.col("l_returnflag") == "R").cast("int").alias("energy_drop"), (F.col("l_linestatus") == "F").cast("int").alias("pitch_shift"))


def unit_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, slides and their similarity: fifty vectors are a talk, the label is the slide; dot product with the slide's normalised mean."""
    from rostrum.operators.vectors import dot, mean_vectors

    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("session_id"), F.col("vec_id").alias("unit_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    means = mean_vectors(e.select("session_id", F.col("label").alias("slide_id"), "v", F.lit(1.0).alias("weight")), ["session_id", "slide_id"])
    return e.join(means, "session_id").select("session_id", "unit_id", "label", "slide_id", dot("v", "mean").alias("sim"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status events: a customer's orders in time."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("analysis_id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("key")).alias("seq"), F.col("o_totalprice").cast("double").alias("score"))


# The same tables in DuckDB.
WORDS = """
w0 AS (SELECT conv_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda y: y <> '') AS ws FROM conversations)),
w1 AS (SELECT conv_id AS session_id, (turn + 1)::INT AS slide_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1 AS word_idx FROM w0),
words AS (SELECT *, word_idx * 400 + (slide_id - 1) * 1200 AS start_ms, word_idx * 400 + (slide_id - 1) * 1200 + 300 AS end_ms FROM w1),
segments AS (SELECT session_id, slide_id, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY session_id ORDER BY slide_id), last) AS end_ms
  FROM (SELECT session_id, slide_id, min(start_ms) AS start_ms, max(end_ms) AS last FROM words GROUP BY ALL))"""
FRAMES = """
frames AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3.6e9::DOUBLE AS t, value::DOUBLE AS energy,
  (props::JSON ->> '$.k')::DOUBLE AS pitch, epoch_us(ts) // 3600000000 % 24 / 4.0::DOUBLE AS speech_rate_per_sec, event_type = 'error' AS silence FROM events),
frame_segments AS (SELECT session_id, slide_id, top * (slide_id - 1) / 5 AS lo, top * slide_id / 5 AS hi
  FROM (SELECT session_id, max(t) AS top, unnest(range(1, 6))::INT AS slide_id FROM frames GROUP BY session_id))"""
LINES = """
slide_lines AS (SELECT deck, slide, line, line_idx, 20.0::DOUBLE * line_idx AS y0, CASE WHEN line_idx = 0 THEN 28.0::DOUBLE ELSE 14.0::DOUBLE END AS font_size
  FROM (SELECT doc_id // 10 AS deck, (doc_id % 10 + 1)::INT AS slide, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents))"""
GOLD = """
gold_pred AS (SELECT doc_id // 10 AS session_id, (doc_id % 10 + 1)::INT AS slide_id, quality::DOUBLE AS gold, least(1.0::DOUBLE, n_chars / 3000.0::DOUBLE) AS pred FROM documents JOIN labels USING (doc_id))"""
MANIFEST = """
manifest AS (SELECT l_orderkey || '/' || l_linenumber AS audio_path, l_quantity::DOUBLE / (l_extendedprice::DOUBLE / 1000.0::DOUBLE) AS speech_rate, l_discount::DOUBLE AS silence_ratio,
  (l_returnflag = 'R')::INT AS energy_drop, (l_linestatus = 'F')::INT AS pitch_shift FROM lineitem)"""
UNITS = """
e0 AS (SELECT vec_id // 50 AS session_id, vec_id AS unit_id, label::INT AS label, embedding::DOUBLE[] AS v FROM embeddings),
e1 AS (SELECT session_id, label AS slide_id, i, avg(x) AS x FROM (SELECT session_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e0) GROUP BY ALL),
e2 AS (SELECT session_id, slide_id, list(x ORDER BY i) AS m FROM e1 GROUP BY ALL),
e3 AS (SELECT session_id, slide_id, CASE WHEN list_dot_product(m, m) > 0 THEN list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) ELSE m END AS m FROM e2),
unit_sim AS (SELECT e0.session_id, unit_id, label, slide_id, list_dot_product(v, m) AS sim FROM e0 JOIN e3 USING (session_id))"""
REQUESTS = """
requests AS (SELECT o_custkey AS analysis_id, o_orderstatus AS status, o_orderdate AS placed, o_orderkey AS key, o_totalprice::DOUBLE AS score FROM orders)"""
