"""Delivery: fillers, dwell, frames per segment, trends, anomalies, pace and stability scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from rostrum.functions.score import clamp, density, plateau
from rostrum.functions.text import FILLERS, is_filler, syllables
from rostrum.operators.intervals import inside

# Component weights and ranges of the delivery score.
WEIGHTS = {"silence": 0.35, "speech_rate": 0.25, "filler": 0.15, "dwell": 0.10, "probe": 0.15}
SILENCE, RATE = (0.0, 0.05, 0.25, 0.55), (0.5, 2.0, 5.0, 7.0)
FILLER, DWELL = (0.02, 0.05), (1.5, 3.0)
# The series of frames that anomalies and change points look at, in this order.
SERIES = ("energy", "pitch", "speech_rate_per_sec")


def _session() -> WindowSpec:
    return Window.partitionBy("session_id")


def filler_stats(words: DataFrame, patterns=FILLERS) -> DataFrame:
    """Per slide: words, fillers and their rate (4 digits), with the session's totals."""
    s = words.groupBy("session_id", "slide_id").agg(F.count("*").alias("word_count"), F.count_if(is_filler(F.col("word"), patterns)).alias("filler_count"))
    rate = lambda a, b: F.bround(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    total, n = F.sum("filler_count").over(_session()), F.sum("word_count").over(_session())
    return s.select("session_id", "slide_id", "word_count", "filler_count", rate(F.col("filler_count"), F.col("word_count")).alias("filler_rate"), total.alias("total_fillers"), rate(total, n).alias("session_rate"))


def segment_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Words into slides by time: before the first to the first, from the last's start on to the last; empty slides stay.

    The slide is found by an ordered merge of starts and words in each session, not by a join on a range.
    """
    bounds = segments.select("session_id", F.col("start_ms").alias("at"), "slide_id", F.lit(0).alias("kind"), F.lit(None).cast("int").alias("word_idx"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("long").alias("end"))
    spoken = words.select("session_id", F.col("start_ms").alias("at"), F.lit(None).cast("int").alias("slide_id"), F.lit(1).alias("kind"), F.col("word_idx").cast("int"), "word", F.col("end_ms").alias("end"))
    w = _session().orderBy("at", "kind", "slide_id", "word_idx").rowsBetween(Window.unboundedPreceding, 0)
    merged = bounds.unionByName(spoken).withColumn("to", F.coalesce(F.last("slide_id", True).over(w), F.min("slide_id").over(_session()))).where("kind = 1")
    by = merged.groupBy("session_id", F.col("to").alias("slide_id")).agg(F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("ws"), F.min("at").alias("first"), F.max("end").alias("last"))
    out = segments.join(by, ["session_id", "slide_id"], "left")
    flags = F.array_compact(F.array(F.when(F.col("ws").isNull(), "empty_segment"), F.when(F.col("first") > F.col("end_ms"), "late_segment_start"), F.when(F.col("last") < F.col("start_ms"), "early_segment_end")))
    text = F.coalesce(F.array_join(F.transform("ws", lambda x: x["word"]), " "), F.lit(""))
    return out.select("session_id", "slide_id", "start_ms", "end_ms", text.alias("text"), F.coalesce(F.size("ws"), F.lit(0)).alias("word_count"), F.array_join(flags, ",").alias("flags"))


def dwell(segments: DataFrame, counts: DataFrame) -> DataFrame:
    """Seconds on each slide, its share, z-score among the session's, and words per second.

    A session's slides are one ordered array, and deviations are summed up in its order (Welford), not as rows
    arrive: of two slides the shorter lies at -1 give or take the last bit, which limits on the z-score see.
    """
    s = segments.join(counts, ["session_id", "slide_id"], "left").withColumn("dwell_sec", F.greatest(F.lit(0.0), (F.col("end_ms") - F.col("start_ms")) / 1000.0))
    g = s.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("slide_id", "dwell_sec", F.coalesce("word_count", F.lit(0)).alias("n")))).alias("slides"))

    def step(a, x):
        n, x = a["n"] + 1, x["dwell_sec"]
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), (a["total"] + x).alias("total"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    sums = F.aggregate("slides", F.struct(F.lit(0).alias("n"), *[F.lit(0.0).alias(c) for c in ("total", "mean", "m2")]), step)
    s = g.select("session_id", "slides", sums.alias("of")).select("session_id", "of", F.explode("slides").alias("x")).select("session_id", "of", "x.*")
    mean, std, total = F.col("of.total") / F.col("of.n"), F.sqrt(F.col("of.m2") / F.col("of.n")), F.col("of.total")
    return s.select(
        "session_id",
        "slide_id",
        "dwell_sec",
        F.when(total > 0, F.try_divide(F.col("dwell_sec"), total)).otherwise(0.0).alias("dwell_ratio"),
        F.when(std > 1e-8, F.try_divide(F.col("dwell_sec") - mean, std)).otherwise(0.0).alias("dwell_z"),
        F.col("n").alias("word_count"),
        (F.col("n") / F.greatest("dwell_sec", F.lit(0.1))).alias("words_per_sec"),
    )


def _components(s: DataFrame) -> list[tuple[str, Column]]:
    """A slide's component scores for the measures that s has."""
    out = []
    if "silence_ratio" in s.columns:
        out.append(("silence", plateau(F.col("silence_ratio"), *SILENCE)))
    if "words_per_sec" in s.columns:
        out.append(("speech_rate", plateau(F.col("words_per_sec"), *RATE)))
    if "filler_count" in s.columns:
        d = F.coalesce(F.try_divide(F.col("filler_count"), F.col("word_count")), F.lit(0.0))
        out.append(("filler", F.when(F.col("word_count") <= 0, 1.0).otherwise(density(d, *FILLER))))
    if "dwell_z" in s.columns:
        out.append(("dwell", density(F.abs("dwell_z"), *DWELL)))
    if "overall_delivery" in s.columns:
        out.append(("probe", F.col("overall_delivery")))
    return out


def stability(slides: DataFrame, keys=("session_id",), weights=WEIGHTS) -> DataFrame:
    """Delivery score 0-100: weighted mean of the components that are present; anomalies, then 50, where none is."""
    parts = _components(slides)
    flags = [F.avg(1.0 - F.least(F.lit(1.0), F.col("n_flags") / 3.0)).alias("anomaly_fallback")] if "n_flags" in slides.columns else []
    s = slides.groupBy(*keys).agg(*[F.avg(c).alias(k) for k, c in parts], *flags, F.count("*").alias("n_slides"))
    have = [(F.col(k), weights[k]) for k, _ in parts if weights[k] > 0]
    weight = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in have), F.lit(0.0))
    total = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in have), F.lit(0.0))
    rest = F.coalesce(F.col("anomaly_fallback") * 100.0, F.lit(50.0)) if flags else F.lit(50.0)
    return s.withColumn("delivery_stability", clamp(F.when(weight > 0, F.try_divide(total, weight) * 100.0).otherwise(rest), 0.0, 100.0))


def segment_features(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Means per segment (NaN left out), share of silence, and the slopes of energy and pace; segments without frames go. A frame on a boundary counts in both."""
    j = inside(frames, segments)
    mean = lambda c: F.coalesce(F.avg(F.when(~F.isnan(c), F.col(c))), F.lit(0.0))
    s = j.groupBy("session_id", "slide_id").agg(F.count("*").alias("n_frames"), mean("energy").alias("energy_mean"), mean("pitch").alias("pitch_mean"), mean("speech_rate_per_sec").alias("speech_rate_per_sec_mean"), F.avg(F.col("silence").cast("double")).alias("silence_ratio"), slope("energy", "t").alias("energy_slope"), slope("speech_rate_per_sec", "t").alias("rate_slope"))
    return s


def slope(y: str, x: str) -> Column:
    """Least-squares slope; null for fewer than two places."""
    return F.when(F.stddev_pop(x) > 0, F.regr_slope(y, x))


def trend(energy_slope: Column, rate_slope: Column | None = None, eps: float = 1e-3) -> Column:
    out = F.when(energy_slope < -eps, "declining_energy").when(energy_slope > eps, "rising_energy")
    if rate_slope is not None:
        out = out.when(rate_slope > eps, "increasing_speed").when(rate_slope < -eps, "decreasing_speed")
    return F.coalesce(out.otherwise("stable"), F.lit("stable"))


def anomalies(frames: DataFrame, features: DataFrame, threshold: float = 1.5, keys=SERIES) -> DataFrame:
    """Measures whose segment mean is further than threshold from the session's mean over frames."""
    stats = frames.groupBy("session_id").agg(*[x for k in keys for x in (F.avg(k).alias(f"{k}_mu"), F.stddev_pop(k).alias(f"{k}_sd"))])
    z = lambda k: (F.col(f"{k}_mean") - F.col(f"{k}_mu")) / (F.col(f"{k}_sd") + 1e-8 + 1e-8)
    flags = F.array_compact(F.array(*[F.when(F.abs(z(k)) > threshold, f"{k}_z>{threshold}") for k in keys]))
    return features.join(stats, "session_id").select("session_id", "slide_id", F.array_join(flags, ",").alias("flags"), F.size(flags).alias("n_flags"), z(keys[0]).alias(f"{keys[0]}_z"))


def speech_rate(times: DataFrame, words: DataFrame, width: float = 1.0, pattern: str = "[가-힣]") -> DataFrame:
    """Syllables per second within half a width around each frame time, by one ordered window over frames and words."""
    a = times.select("session_id", "frame_idx", F.col("t").alias("t"), F.lit(0).alias("syl"))
    b = words.select("session_id", F.lit(None).cast("long").alias("frame_idx"), ((F.col("start_ms") + F.col("end_ms")) / 2000.0).alias("t"), syllables(F.col("word"), pattern).alias("syl"))
    near = F.expr(f"sum(syl) OVER (PARTITION BY session_id ORDER BY t RANGE BETWEEN {width / 2}D PRECEDING AND {width / 2}D FOLLOWING)")
    both = a.withColumn("frame_idx", F.col("frame_idx").cast("long")).unionByName(b).withColumn("rate", near / width)
    return both.where("frame_idx IS NOT NULL").select("session_id", "frame_idx", "t", "rate")


def pacing(rates: DataFrame) -> DataFrame:
    """100 less the variation of pace among slides; 70 for a single slide, 50 without speech."""
    s = rates.groupBy("session_id").agg(F.count("*").alias("n"), F.avg("rate").alias("m"), F.stddev_pop("rate").alias("sd"))
    score = F.when(F.col("n") < 2, 70.0).when(F.col("m") <= 1e-6, 50.0).otherwise(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.least(F.col("sd") / (F.col("m") + 1e-8), F.lit(1.0)))))
    return s.select("session_id", F.col("n").alias("n_slides"), score.alias("pacing_score"))


def zscores(frames: DataFrame, keys=SERIES) -> DataFrame:
    """Each series less the session's mean over its deviation."""
    return frames.select("*", *[((F.col(k) - F.avg(k).over(_session())) / (F.stddev_pop(k).over(_session()) + 1e-8)).alias(f"{k}_z") for k in keys])


def type_changes(frames: DataFrame, points: DataFrame, keys=SERIES, reach: int = 3) -> DataFrame:
    """Name change points by the measure that moves most between the frames before and from the point on, the first among equals.

    Energy and pace fall or rise; pitch only shifts.
    """
    order = _session().orderBy("frame_idx")
    z = zscores(frames, keys)
    move = [(F.avg(f"{k}_z").over(order.rowsBetween(0, reach - 1)) - F.avg(f"{k}_z").over(order.rowsBetween(-reach, -1))).alias(f"{k}_move") for k in keys]
    z = z.select("session_id", "frame_idx", "t", *move).where(F.col(f"{keys[0]}_move").isNotNull())
    best = F.array_max(F.array(*[F.struct(F.abs(f"{k}_move").alias("size"), F.lit(-i).alias("first"), F.lit(k).alias("key"), F.col(f"{k}_move").alias("move")) for i, k in enumerate(keys)]))
    way = F.when(F.col("b.move") < 0, "_drop").otherwise("_rise")
    kind = F.when(F.col("b.key") == "pitch", "pitch_shift").when(F.col("b.key") == "speech_rate_per_sec", F.concat(F.lit("speed"), way)).otherwise(F.concat("b.key", way))
    named = z.join(points.select("session_id", "frame_idx"), ["session_id", "frame_idx"]).withColumn("b", best)
    return named.select("session_id", "frame_idx", "t", kind.alias("type"), F.col("b.size").alias("magnitude"))


def merge_changes(points: DataFrame, gap: float = 2.0) -> DataFrame:
    """Points within the gap of the last kept one join it; the larger of them stays. Sequential, so one ordered array a session."""
    p = points.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("t", "type", "magnitude"))).alias("p"))

    def step(kept, x):
        last = F.element_at(kept, -1)
        return F.when((F.size(kept) == 0) | (x["t"] - F.try_element_at(kept, F.lit(-1))["t"] > gap), F.concat(kept, F.array(x))).when(x["magnitude"] > last["magnitude"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x))).otherwise(kept)

    kept = F.aggregate("p", F.slice("p", 1, 0), step)
    return p.select("session_id", F.explode(kept).alias("x")).select("session_id", "x.*")


def fillers_by_time(words: DataFrame, bounds: DataFrame, patterns=FILLERS) -> DataFrame:
    """Words, fillers and their rate (4 digits) on each slide [start, next start), the last [start, end): words outside all slides count nowhere.

    bounds: (session, slide, start_ms, end_ms). Found by one ordered merge of starts and words a session.
    """
    b = bounds.select("session_id", F.col("start_ms").alias("at"), F.lit(0).alias("kind"), F.struct("slide_id", "end_ms").alias("own"), F.lit(0).alias("filler"))
    w = words.select("session_id", F.col("start_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(b.schema["own"].dataType).alias("own"), is_filler(F.col("word"), patterns).cast("int").alias("filler"))
    m = b.unionByName(w).withColumn("slide", F.last("own", True).over(_session().orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    m = m.where((F.col("kind") == 1) & (F.col("at") < F.col("slide.end_ms"))).groupBy("session_id", F.col("slide.slide_id").alias("slide_id")).agg(F.count("*").alias("word_count"), F.sum("filler").alias("filler_count"))
    n = F.coalesce("word_count", F.lit(0)), F.coalesce("filler_count", F.lit(0))
    return bounds.select("session_id", "slide_id").join(m, ["session_id", "slide_id"], "left").select("session_id", "slide_id", n[0].alias("word_count"), n[1].alias("filler_count"), F.bround(F.coalesce(F.try_divide(n[1], n[0]), F.lit(0.0)), 4).alias("filler_rate"))


def with_missing(slides: DataFrame, segments: DataFrame) -> DataFrame:
    """Every slide with its segment (start_sec, end_sec, text, flags); one without gets an empty segment flagged missing_segment."""
    j = slides.select("session_id", "slide_id").join(segments.withColumn("found", F.lit(True)), ["session_id", "slide_id"], "left")
    return j.select("session_id", "slide_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("start_sec", "end_sec")], F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("found"), F.col("flags")).otherwise("missing_segment").alias("flags"))


def segment_structs(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Segments as they are passed on: seconds, text, flags and the words in order as an array of structs (word, start, end); words carry their slide."""
    w = words.groupBy("session_id", "slide_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "word", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end")))), lambda x: F.struct(x["word"].alias("word"), x["start"].alias("start"), x["end"].alias("end"))).alias("words"))
    return segments.join(w, ["session_id", "slide_id"], "left").select("session_id", F.struct("slide_id", "start_sec", "end_sec", "text", F.coalesce("words", F.array().cast(w.schema["words"].dataType)).alias("words"), F.filter(F.split("flags", ","), lambda x: x != "").alias("warning_flags")).alias("segment"))
