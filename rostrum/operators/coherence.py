"""How much of a slide's key points the talk covered, and how sure the alignment of units to slides is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rostrum.functions.score import clamp, rescale

# Blend of the coverage score.
SEMANTIC, SOFT, WEIGHTS = (0.40, 0.80), (0.35, 0.75), (0.45, 0.45, 0.10)
THRESHOLD, CHARS, CAP_BELOW, CAP = 0.55, 100.0, 0.55, 0.72
KEYS = ["session_id", "slide_id"]


def _session() -> WindowSpec:
    return Window.partitionBy("session_id")


def best_chunks(sims: DataFrame) -> DataFrame:
    """From (session, slide, kp_idx, importance, chunk_idx, sim): each keypoint's best chunk, the first among equals."""
    best = F.max(F.struct("sim", (-F.col("chunk_idx")).alias("first")))
    g = sims.groupBy(*KEYS, "kp_idx", "source", "importance").agg(best.alias("b"))
    return g.select(*KEYS, "kp_idx", "source", "importance", F.col("b.sim").alias("sim"), (-F.col("b.first")).alias("chunk_idx"))


def coverage(best: DataFrame, slides: DataFrame, keypoints: DataFrame | None = None) -> DataFrame:
    """Per slide: hard coverage (importance of keypoints at the threshold), soft coverage, and their blend.

    slides has (session, slide, semantic, n_chars): cosine of the weighted means, and length of the talk on it.
    A slide without keypoints or without chunks has 0 in everything; all its keypoints (session, slide, kp_idx) are missed.
    """
    w = F.sum("importance")
    g = best.groupBy(*KEYS).agg(
        F.coalesce(F.try_divide(F.sum(F.when(F.col("sim") >= THRESHOLD, F.col("importance")).otherwise(0.0)), w), F.lit(0.0)).alias("keypoint_coverage"),
        F.coalesce(F.try_divide(F.sum(F.col("importance") * rescale(F.col("sim"), *SOFT)), w), F.lit(0.0)).alias("soft_coverage"),
        F.array_sort(F.collect_list(F.when(F.col("sim") < THRESHOLD, F.col("kp_idx")))).alias("missed"),
    )
    s = slides.join(g.withColumn("scored", F.lit(True)), KEYS, "left")
    none = F.array().cast(g.schema["missed"].dataType)
    if keypoints is not None:
        s = s.join(keypoints.groupBy(*KEYS).agg(F.array_sort(F.collect_list("kp_idx")).alias("all_of_it")), KEYS, "left").withColumn("missed", F.coalesce("missed", "all_of_it")).drop("all_of_it")
    zero = lambda c: F.when(F.col("scored"), c).otherwise(0.0)
    s = s.withColumns({"missed": F.coalesce("missed", none), "keypoint_coverage": zero(F.col("keypoint_coverage")), "soft_coverage": zero(F.col("soft_coverage")), "semantic_coverage": zero(rescale(F.col("semantic"), *SEMANTIC)), "presence": zero(clamp(F.col("n_chars") / CHARS))}).drop("scored")
    blend = WEIGHTS[0] * F.col("semantic_coverage") + WEIGHTS[1] * F.col("soft_coverage") + WEIGHTS[2] * F.col("presence")
    apart = F.least("semantic_coverage", "soft_coverage") < CAP_BELOW
    return s.withColumn("coverage", clamp(F.when(apart, F.least(blend, F.lit(CAP))).otherwise(blend)))


def by_source(best: DataFrame) -> DataFrame:
    """Coverage and missed keypoints of each source of keypoints."""
    hit = F.col("sim") >= THRESHOLD
    return best.groupBy(*KEYS, "source").agg(F.try_divide(F.sum(F.when(hit, F.col("importance")).otherwise(0.0)), F.sum("importance")).alias("coverage"), F.array_sort(F.collect_list(F.when(~hit, F.col("kp_idx")))).alias("missed"))


def evidence(best: DataFrame) -> DataFrame:
    """The chunk that covers each keypoint that is covered."""
    return best.where(F.col("sim") >= THRESHOLD).select(*KEYS, "kp_idx", "chunk_idx", "sim")


def coverage_score(slides: DataFrame) -> DataFrame:
    """Per session: mean coverage of all slides, weighted by role (all, if no role weighs), and how many count."""
    w = F.sum("coverage_weight")
    g = slides.groupBy("session_id").agg(F.avg("coverage").alias("a"), w.alias("w"), F.sum(F.col("coverage_weight") * F.col("coverage")).alias("s"), F.count_if(F.col("coverage_weight") > 0).alias("content_scored_slide_count"))
    return g.select("session_id", (F.col("a") * 100).alias("content_coverage_all"), F.when(F.col("w") > 0, F.try_divide("s", "w") * 100).otherwise(F.col("a") * 100).alias("content_coverage"), "content_scored_slide_count")


def margins(sims: DataFrame, assigned: DataFrame) -> DataFrame:
    """Each unit's similarity to its slide, to the best other, and the margin (1 if there is no other)."""
    j = sims.join(assigned.withColumnRenamed("slide_id", "mine"), ["session_id", "unit_id"])
    g = j.groupBy("session_id", "unit_id", "mine").agg(F.max(F.when(F.col("slide_id") == F.col("mine"), F.col("sim"))).alias("sim"), F.max(F.when(F.col("slide_id") != F.col("mine"), F.col("sim"))).alias("rival"))
    return g.select("session_id", "unit_id", F.col("mine").alias("slide_id"), "sim", "rival", F.when(F.col("rival").isNull(), 1.0).otherwise(F.col("sim") - F.col("rival")).alias("margin"))


def confidence(margin_rows: DataFrame, low_sim: float = 0.35, low_margin: float = 0.10) -> DataFrame:
    """Per session: mean margin (cut to 0..1) and units that are unsure, with why."""
    low = (F.col("sim") < low_sim) | (F.col("margin") < low_margin)
    return margin_rows.groupBy("session_id").agg(F.avg(clamp(F.col("margin"))).alias("confidence"), F.count_if(low).alias("n_low"), F.count_if(F.col("sim") < low_sim).alias("n_low_sim"), F.count_if(F.col("margin") < low_margin).alias("n_low_margin"))


def warnings(assigned: DataFrame, slide_counts: DataFrame, boundaries: DataFrame, conf: DataFrame, low: float = 0.03) -> DataFrame:
    """What is odd in an alignment: slides without units, equal boundaries, low confidence (not if there is none)."""
    used = assigned.groupBy("session_id").agg(F.count_distinct("slide_id").alias("used"))
    j = slide_counts.join(used, "session_id", "left").join(boundaries, "session_id", "left").join(conf.select("session_id", "confidence"), "session_id", "left")
    return j.select("session_id", F.array_join(F.array_compact(F.array(F.when(F.coalesce("used", F.lit(0)) < F.col("n_slides"), "not_all_slides_assigned"), F.when(F.size(F.array_distinct("b")) < F.size("b"), "duplicate_boundaries_detected"), F.when(F.col("confidence") < low, "low_alignment_confidence"))), ",").alias("warnings"))


def runs(assigned: DataFrame) -> DataFrame:
    """Stretches of units on one slide: start, end and length."""
    w = _session().orderBy("unit_id")
    a = assigned.withColumn("new", (F.lag("slide_id").over(w).isNull() | (F.lag("slide_id").over(w) != F.col("slide_id"))).cast("int"))
    a = a.withColumn("run", F.sum("new").over(w))
    return a.groupBy("session_id", "run", "slide_id").agg(F.min("unit_id").alias("first_unit"), F.max("unit_id").alias("last_unit"), F.count("*").alias("n_units"))


def monotone(assigned: DataFrame) -> DataFrame:
    """Slides that never go back: the running maximum."""
    return assigned.withColumn("slide_id", F.max("slide_id").over(_session().orderBy("unit_id").rowsBetween(Window.unboundedPreceding, 0)))


def boundaries(assigned: DataFrame, times: DataFrame, slide_counts: DataFrame) -> DataFrame:
    """Start of the first unit on each slide or a later one, else the end; from 0 to the last unit's end, never falling."""
    j = assigned.join(times, ["session_id", "unit_id"]).join(slide_counts, "session_id")
    g = j.groupBy("session_id", "n_slides").agg(F.array_sort(F.collect_list(F.struct("start_sec", "slide_id"))).alias("u"), F.max("end_sec").alias("t1"))
    ks = F.when(F.col("n_slides") > 1, F.sequence(F.lit(2), F.col("n_slides").cast("int"))).otherwise(F.array().cast("array<int>"))
    first = F.transform(ks, lambda k: F.coalesce(F.array_min(F.transform(F.filter("u", lambda x: x["slide_id"] >= k), lambda x: x["start_sec"])), F.col("t1")))
    return g.select("session_id", F.concat(F.array(F.lit(0.0)), first, F.array("t1")).alias("b"))


def emissions(sims: DataFrame, progress_penalty: float = 0.35, lag: float = 1.6) -> DataFrame:
    """Similarity less a penalty for how far a slide's place in the deck is from the unit's place in the talk, more when it lags."""
    u = F.dense_rank().over(_session().orderBy("unit_id")) - 1
    k = F.dense_rank().over(_session().orderBy("slide_id")) - 1
    s = sims.withColumn("u", u).withColumn("k", k).withColumn("nu", F.max("u").over(_session())).withColumn("nk", F.max("k").over(_session()))
    at = F.coalesce(F.try_divide("u", "nu"), F.lit(0.0))
    place = F.coalesce(F.try_divide("k", "nk"), F.lit(0.0))
    return s.select("session_id", "unit_id", "slide_id", "u", "k", "sim", (F.col("sim") - progress_penalty * F.abs(place - at) * F.when(place < at, lag).otherwise(1.0)).alias("emission"))
