"""Cover and closing anchors of an alignment, and the choice between given and found boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The cover's window (least, most, share of the talk), how far speech may run over it, how long a first unit must be to end it.
WINDOW, OVERRUN, FIRST_UNIT = (8.0, 20.0, 0.15), 2.0, 3.0
# Where thanks are looked for, what a closing slide says, what a speaker says.
THANKS_FROM = 0.85
CLOSING_SLIDE = ("감사", "thank")
CLOSING_CUES = ("감사합니다", "들어주셔", "이상입니", "마치겠습니다", "감사드립니")
_EPS = 1e-6


def _any_of(text: Column, cues: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for c in cues:
        out = out | F.contains(text, F.lit(c.replace(" ", "")))
    return out


def edge_anchors(units: DataFrame, slides: DataFrame, cues: tuple[str, ...] = CLOSING_CUES) -> DataFrame:
    """Per session: end of the cover and start of the thanks (null where the last slide has none).

    units: (session, unit_id, start_sec, end_sec, text, tokens); slides: (session, slide_id, title_tokens, text).
    The cover ends with the last unit inside its window, but before a unit, not the first, that
    says a word of the next title, or else with the first unit if that is long enough; with the window itself if no unit is inside. Thanks start
    with the last unit that has a cue, if that begins late enough, else at the end.
    """
    n = slides.groupBy("session_id").agg(F.max("slide_id").alias("last"), F.max(F.when(F.col("slide_id") == 2, F.col("title_tokens"))).alias("next_title"), F.max_by("text", "slide_id").alias("last_text"))
    order = Window.partitionBy("session_id").orderBy("unit_id")
    u = units.withColumn("audio_end", F.last("end_sec").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    window = F.greatest(F.lit(WINDOW[0]), F.least(F.lit(WINDOW[1]), F.col("audio_end") * WINDOW[2]))
    u = u.join(n, "session_id").withColumn("window", window).withColumn("nth", F.row_number().over(order))
    # inside: before the first unit that runs over the limit
    over = F.max((F.col("end_sec") > F.col("window") + OVERRUN + _EPS).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    fits = F.col("end_sec") <= F.col("window") + OVERRUN + _EPS
    u = u.withColumn("inside", over == 0).withColumn("fits", fits).withColumn("before", F.lag(F.when(F.col("fits"), F.col("end_sec")), 1).over(order))
    titled = F.arrays_overlap("tokens", F.coalesce("next_title", F.array().cast("array<string>")))
    said = _any_of(F.replace("text", F.lit(" ")), cues)
    g = u.groupBy("session_id").agg(
        F.max(F.when(F.col("inside"), F.struct("nth", "end_sec")))["end_sec"].alias("inside_end"),
        F.min(F.when(F.col("fits") & (F.col("nth") > 1) & titled, F.struct("nth", "before")))["before"].alias("titled_end"),
        F.min(F.when((F.col("nth") == 1) & F.col("fits") & (F.col("end_sec") - F.col("start_sec") >= FIRST_UNIT), F.col("end_sec"))).alias("first_end"),
        F.max(F.when(said, F.struct("nth", "start_sec")))["start_sec"].alias("cue"),
        F.first("audio_end").alias("audio_end"),
        F.first("window").alias("window"),
        F.first("last_text").alias("last_text"),
    )
    closing = F.coalesce(_any_of(F.lower("last_text"), CLOSING_SLIDE), F.lit(False))
    cover = F.when(F.col("audio_end") <= 0, None).when(F.col("inside_end").isNull(), F.col("window")).otherwise(F.coalesce("titled_end", "first_end", "inside_end"))
    thanks = F.when(closing, F.when(F.col("cue") >= F.col("audio_end") * THANKS_FROM, F.col("cue")).otherwise(F.col("audio_end")))
    return g.select("session_id", cover.alias("cover_end_sec"), thanks.alias("thanks_start_sec"), "audio_end")


def apply_anchors(assigned: DataFrame, units: DataFrame, anchors: DataFrame, slide_counts: DataFrame) -> DataFrame:
    """Assigned slides held by the anchors: units up to the cover's end are on slide 1 and no later one is; the last slide begins with the thanks, or has no unit.

    A talk with one slide stays as it is; so does the end of a talk whose last slide says no thanks.
    """
    j = assigned.join(units.select("session_id", "unit_id", "start_sec", "end_sec"), ["session_id", "unit_id"]).join(anchors, "session_id").join(slide_counts, "session_id")
    k = F.when(F.col("end_sec") <= F.col("cover_end_sec") + _EPS, 1).when(F.col("cover_end_sec").isNotNull() & (F.col("slide_id") == 1), 2).otherwise(F.col("slide_id"))
    late = F.col("thanks_start_sec").isNotNull()
    open_ = F.col("thanks_start_sec") < F.col("audio_end")
    k = F.when(late & open_ & (F.col("start_sec") >= F.col("thanks_start_sec")), F.col("n_slides")).when(late, F.least(k, F.col("n_slides") - 1)).otherwise(k)
    return j.select("session_id", "unit_id", F.when(F.col("n_slides") > 1, k).otherwise(F.col("slide_id")).cast("int").alias("slide_id"))


def choose(rows: DataFrame) -> DataFrame:
    """Which boundaries a talk ends up with, and by which strategy.

    rows: (session, mode, manual, manual_error, manual_warnings, auto, auto_strategy, auto_warnings), arrays
    of boundaries and of warnings. No mode is manual with given boundaries, else auto. A
    manual talk without usable boundaries, or an unknown mode, is an error row.
    """
    none = F.array().cast("array<string>")
    given = F.coalesce(F.size("manual"), F.lit(0)) > 0
    asked = F.lower(F.trim(F.coalesce("mode", F.lit(""))))
    mode = F.when(asked != "", asked).when(given | F.col("manual_error").isNotNull(), "manual").otherwise("auto")
    broken = F.col("manual_error").isNotNull()
    own, found = F.coalesce("manual_warnings", none), F.coalesce("auto_warnings", none)
    r = rows.withColumns({"mode": mode, "given": given, "broken": broken})
    is_ = lambda m: F.col("mode") == m
    error = F.when(~F.col("mode").isin("manual", "auto", "hybrid"), "unsupported_mode").when(is_("manual") & F.col("broken"), F.col("manual_error")).when(is_("manual") & ~F.col("given"), "no_boundaries")
    hold = is_("manual") | is_("hybrid") & F.col("given") & ~F.col("broken")
    strategy = F.when(is_("manual"), "manual").when(is_("auto"), F.col("auto_strategy")).when(F.col("broken"), "auto_after_invalid_manual").when(F.col("given"), "manual_with_auto_proposal").when(F.col("auto_strategy") == "auto", "auto_without_manual_override").otherwise(F.col("auto_strategy"))
    warn = F.when(is_("manual"), own).when(is_("auto"), F.concat(own, found)).when(F.col("broken"), F.concat(F.array("manual_error"), found)).when(F.col("given"), F.concat(own, found)).otherwise(found)
    r = r.withColumn("error", error)
    ok = F.col("error").isNull()
    return r.select("session_id", "mode", F.when(ok, strategy).alias("strategy"), F.when(ok, F.when(hold, F.col("manual")).otherwise(F.col("auto"))).alias("boundaries"), F.when(ok & is_("hybrid") & hold, F.col("auto")).alias("proposed"), F.when(ok, F.array_join(warn, ",")).alias("warnings"), "error")
