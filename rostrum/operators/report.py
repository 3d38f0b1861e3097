"""Issues, severity, feedback and overall scores of talks; snapshots and their differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import score as s

KEYS = ["session_id", "slide_id"]
# Weights of issues, and which of them are about content.
ISSUE_WEIGHTS = {"content_gap": 3, "title_missing": 3, "bullet_missing": 2, "speed_drop": 2, "silence_excess": 1, "visual_not_explained": 2, "dwell_short": 1, "dwell_long": 1}
CONTENT_ISSUES = ("content_gap", "title_missing", "bullet_missing", "visual_not_explained")
# What a visual keypoint or a title must be more than.
GENERIC_VISUAL = r"(?i)^(chart_candidate|image|table|diagram|screenshot|bar_chart|line_chart|flowchart|none)(\s*x?\d+)?$"
GENERIC_TITLES = ("개요", "목차", "소개", "팀소개", "팀 소개", "프로젝트소개", "프로젝트 소개", "진행현황", "진행 현황", "실험결과", "실험 결과", "결론", "향후계획", "향후 계획", "기대효과", "기대 효과", "감사합니다")
LOW_CONFIDENCE = 0.06
VISUAL = "VISUAL: "


def generic_visual(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "^VISUAL: ", "")).rlike(GENERIC_VISUAL)


def actionable_title(x: Column) -> Column:
    """A title that says something: a colon or ASCII letters and digits, or no stock phrase and at least 12 characters."""
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    tight = F.regexp_replace(one, " ", "")
    stock = tight.isin(*{g.replace(" ", "") for g in GENERIC_TITLES})
    has = F.exists(F.array(*map(F.lit, sorted({g.replace(" ", "") for g in GENERIC_TITLES}))), lambda g: F.contains(tight, g)) & (F.char_length(tight) <= 12)
    return F.when(tight == "", False).when(one.rlike("[:A-Za-z0-9]"), True).when(stock | has, False).otherwise(F.char_length(tight) >= 12)


def pitch_slides(changes: DataFrame, slide_counts: DataFrame, fraction: float = 0.30, least: float = 0.0) -> DataFrame:
    """Slides whose pitch moves most: at most this fraction of a session's slides, at least one. Sums within 1e-9, which differ by the order of adding up, are equal: the lower slide comes first."""
    g = changes.where(F.col("type").startswith("pitch")).groupBy(*KEYS).agg(F.sum(F.abs("magnitude")).alias("pitch_score")).where("pitch_score > 0")
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.bround("pitch_score", 9)), "slide_id"))
    g = g.join(slide_counts, "session_id").withColumn("r", r)
    return g.where((F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n_slides") * fraction))) & (F.col("pitch_score") > least)).select(*KEYS, "pitch_score")


def join_sides(ce: DataFrame, ae: DataFrame) -> DataFrame:
    """Content and delivery of each slide; either may be absent."""
    return ce.withColumn("has_ce", F.lit(True)).join(ae.withColumn("has_ae", F.lit(True)), KEYS, "full_outer").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_ce", "has_ae")})


def issues(slides: DataFrame, semantic: float = 0.5, keypoint: float = 0.5, dwell_short: float = -1.5, dwell_long: float = 2.0) -> DataFrame:
    """One row per issue in a fixed order.

    slides: join_sides() with semantic_coverage, keypoint_coverage, title_missed,
    bullet_missed, missed (arrays), silence_ratio, trend, filler_count, pitch
    (boolean), dwell_z, low_confidence, and flags that a role suppresses issues.
    """
    none = F.array().cast("array<string>")
    arr = lambda c: F.coalesce(c, none)
    title = F.filter(arr("title_missed"), actionable_title)
    idle = F.array_except(arr("title_missed"), title)
    text = F.filter(F.filter(arr("missed"), lambda x: ~F.startswith(x, F.lit(VISUAL))), lambda x: ~F.array_contains(idle, x))
    visual = F.filter(F.filter(arr("missed"), lambda x: F.startswith(x, F.lit(VISUAL))), lambda x: ~generic_visual(x))
    allowed = F.col("has_ce") & (F.col("semantic_coverage") < semantic) & (F.col("keypoint_coverage") <= keypoint)
    quiet_title, quiet = F.coalesce("suppress_title", F.lit(False)), F.coalesce("suppress_content", F.lit(False))
    bullets = allowed & (F.size(arr("bullet_missed")) > 0) & ~quiet
    found = [
        ("title_missing", allowed & (F.size(title) > 0) & ~quiet_title),
        ("bullet_missing", bullets),
        ("content_gap", ~bullets & allowed & (F.size(text) > 0) & (F.size(arr("title_missed")) == 0) & ~quiet),
        ("visual_not_explained", F.col("has_ce") & (F.size(visual) > 0) & ~quiet),
        ("silence_excess", F.col("silence_ratio") > 0.3),
        ("speed_drop", F.col("trend").isin("decreasing_speed", "speed_drop")),
        ("speed_rise", F.col("trend").isin("increasing_speed", "speed_rise")),
        ("filler_many", F.col("filler_count") >= 3),
        ("pitch_shift", F.col("pitch")),
        ("dwell_short", F.col("dwell_z") < dwell_short),
        ("dwell_long", F.col("dwell_z") > dwell_long),
    ]
    many = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(i).alias("ord"), F.lit(k).alias("issue"))) for i, (k, c) in enumerate(found)]))
    x = slides.select(*KEYS, "coverage", F.coalesce("low_confidence", F.lit(False)).alias("low"), F.explode(many).alias("i"))
    return x.select(*KEYS, F.col("i.ord").alias("ord"), F.col("i.issue").alias("issue"), "coverage", (F.col("low") & F.col("i.issue").isin(*CONTENT_ISSUES)).alias("low_confidence"))


def severity(issue_rows: DataFrame) -> DataFrame:
    """Sum of issue weights per slide; unsure content issues weigh two less, at least one."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in ISSUE_WEIGHTS.items() for x in kv])[F.col("issue")], F.lit(1))
    w = F.when(F.col("low_confidence"), F.greatest(F.lit(1), w - 2)).otherwise(w)
    g = issue_rows.groupBy(*KEYS).agg(F.sum(w).alias("severity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "issue"))), lambda r: r["issue"]), ",").alias("issues"))
    return g.withColumn("bucket", F.when(F.col("severity") >= 5, "high").when(F.col("severity") >= 2, "medium").otherwise("low"))


def highlights(severities: DataFrame) -> DataFrame:
    """Slides with issues, the worst first."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("severity"), "slide_id"))
    return severities.where("severity > 0").select("session_id", r.alias("rank"), "slide_id", "severity", "issues")


def template_id(issue: Column, coverage: Column) -> Column:
    c = F.coalesce(coverage, F.lit(1.0))
    gap = F.when(c < 0.4, "content_gap_high").when(c < 0.6, "content_gap_mid").otherwise("content_gap_low")
    return F.when(issue == "content_gap", gap).when(issue.isin("title_missing", "bullet_missing", "speed_drop", "speed_rise", "silence_excess", "filler_many", "pitch_shift", "visual_not_explained", "dwell_short", "dwell_long"), issue).otherwise("pacing_inconsistent")


def feedback(issue_rows: DataFrame, templates: DataFrame, default: str = "slide {slide_id} can improve") -> DataFrame:
    """Text of each issue: the low-confidence template where there is one, else the plain one, else the default.

    templates (id, severity, text) is a small dimension; Spark broadcasts it by its size.
    """
    base = template_id(F.col("issue"), F.col("coverage"))
    x = issue_rows.withColumn("tid", base).withColumn("low_tid", F.when(F.col("low_confidence"), F.concat("tid", F.lit("_low_confidence"))))
    t = templates.select(F.col("id").alias("tid"), F.col("severity").alias("sev"), F.col("text").alias("txt"))
    u = templates.select(F.col("id").alias("low_tid"), F.col("severity").alias("low_sev"), F.col("text").alias("low_txt"))
    x = x.join(t, "tid", "left").join(u, "low_tid", "left")
    text = F.replace(F.replace(F.coalesce("low_txt", "txt", F.lit(default)), F.lit("{slide_id}"), F.col("slide_id").cast("string")), F.lit("{issue}"), F.col("issue"))
    return x.select(*KEYS, "ord", F.col("issue").alias("template_id"), F.coalesce("low_sev", "sev", F.lit("low")).alias("severity"), text.alias("text"))


def overall(content: DataFrame, delivery: DataFrame, pace: DataFrame) -> DataFrame:
    """The session's scores and which summary fits them."""
    j = content.join(delivery.select("session_id", "delivery_stability"), "session_id", "full_outer").join(pace.select("session_id", "pacing_score"), "session_id", "full_outer")
    c, d = F.bround(F.coalesce("content_coverage", F.lit(0.0)), 2), F.bround(F.coalesce("delivery_stability", F.lit(50.0)), 2)
    j = j.select("session_id", c.alias("content_coverage"), F.bround(s.score_map(F.coalesce("content_coverage", F.lit(0.0)) / 100.0), 2).alias("content_coverage_user"), d.alias("delivery_stability"), F.bround(F.coalesce("pacing_score", F.lit(70.0)), 2).alias("pacing_score"))
    return j.withColumn("summary", F.when((F.col("content_coverage") > 80) & (F.col("delivery_stability") > 70), "summary_high").when((F.col("content_coverage") < 60) | (F.col("delivery_stability") < 50), "summary_low").otherwise("summary_mid"))


def service_result(overall_rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """What a back end stores: whole percents, their mean, and how many slides are in each severity bucket."""
    b = buckets.groupBy("session_id").agg(*[F.count_if(F.col("bucket") == k).alias(f"n_{k}") for k in ("high", "medium", "low")])
    j = overall_rows.join(b, "session_id", "left")
    total = F.bround((F.col("content_coverage") + F.col("delivery_stability") + F.col("pacing_score")) / 3.0, 0).cast("int")
    return j.select("session_id", *[F.bround(c, 0).cast("int").alias(c) for c in ("content_coverage", "delivery_stability", "pacing_score")], total.alias("overall_score"), *[F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in ("high", "medium", "low")])


def connection_label(score: Column) -> Column:
    return F.when(score >= 85, "strong").when(score >= 70, "good").when(score >= 50, "partial").otherwise("weak")


def strengths(overall_rows: DataFrame) -> DataFrame:
    """Strengths said when nobody named any."""
    return overall_rows.select("session_id", F.array_join(F.array_compact(F.array(F.when(F.col("delivery_stability") >= 80, "steady_delivery"), F.when(F.col("pacing_score") >= 80, "even_pace"))), ",").alias("strengths"))


def replace_terms(x: Column, terms: list[tuple[str, str]]) -> Column:
    """Terms replaced one after another, in this order."""
    for old, new in terms:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def scoped_comments(comments: DataFrame, issue_rows: DataFrame, claims: str) -> DataFrame:
    """Comments without those that claim a content problem on a slide that has no content issue."""
    content = issue_rows.where(F.col("issue").isin(*CONTENT_ISSUES)).select(*KEYS).distinct().withColumn("has", F.lit(True))
    j = comments.join(content, KEYS, "left")
    return j.where(F.col("has").isNotNull() | ~F.col("comment").rlike(claims)).drop("has")


def compact_report(slides: DataFrame, most: int = 12, longest: int = 80) -> DataFrame:
    """The worst slides of each session with shortened texts, as one struct per slide."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("severity"), "slide_id"))
    text = F.when(F.char_length("text") > longest, F.concat(F.rtrim(F.substring("text", 1, longest - 1)), F.lit("…"))).otherwise(F.col("text"))
    return slides.withColumn("r", r).where(F.col("r") <= most).select(*KEYS, F.col("r").alias("rank"), "severity", text.alias("text"))


def snapshot(rows: DataFrame) -> DataFrame:
    """Counts of a case in long form: per issue, per role and in all."""
    g = rows.groupingSets([["case"], ["case", "issue"], ["case", "role"]], "case", "issue", "role").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    section = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "issue").otherwise("role")
    return g.select("case", section.alias("section"), F.coalesce(F.when(F.col("g") == 3, F.lit("all")), F.when(F.col("g") == 1, F.col("issue")).otherwise(F.col("role")), F.lit("none")).alias("key"), F.col("n").cast("double").alias("value"))


def delta(current: DataFrame, base: DataFrame) -> DataFrame:
    """Current less base by section and key; a missing count is 0, a missing score stays null."""
    on = ["section", "key"]
    j = current.select(*on, F.col("value").alias("current")).join(base.select(*on, F.col("value").alias("base")), on, "full_outer")
    zero = lambda c: F.when(F.col("section") == "score", F.col(c)).otherwise(F.coalesce(c, F.lit(0.0)))
    return j.select(*on, zero("current").alias("current"), zero("base").alias("base"), (zero("current") - zero("base")).alias("delta"))


# What of a probe's results is shown, and from which severity on a section with content issues is high.
PUBLIC_PROBE = ("ae_probe_speech_rate", "ae_probe_silence_ratio", "ae_probe_overall_delivery")
HIGH_SECTION = 6
#: What feedback says when an alignment is unsure.
UNSURE = "자동 매칭|신뢰도"


def with_probe(slides: DataFrame, probe: DataFrame, public: bool = True) -> DataFrame:
    """Slides with the probe's results of the same slide, nulls where there are none; only the public ones unless asked."""
    cols = [c for c in probe.columns if c not in KEYS and (not public or c in PUBLIC_PROBE)]
    return slides.join(probe.select(*KEYS, *cols), KEYS, "left")


def slide_detail(slides: DataFrame, roles: DataFrame, stability: DataFrame) -> DataFrame:
    """One row per slide of a report: its role (content, weight 1, if it has none), coverage, missed texts and visuals apart, and delivery.

    slides: join_sides(); roles: (session, slide, role, source, reason, coverage_weight); stability: (session, slide, delivery_stability).
    """
    none = F.array().cast("array<string>")
    is_visual = lambda x: F.startswith(x, F.lit(VISUAL))
    j = slides.join(roles, KEYS, "left").join(stability, KEYS, "left")
    have = [c for c in ("coverage", "semantic_coverage", "soft_coverage", "keypoint_coverage", "silence_ratio", "dwell_sec", "dwell_ratio", "dwell_z", "word_count", "words_per_sec", "trend", *PUBLIC_PROBE) if c in slides.columns]
    missed = F.coalesce("missed", none)
    return j.select(*KEYS, F.coalesce("role", F.lit("content")).alias("slide_role"), F.coalesce("source", F.lit("default")).alias("slide_role_source"), F.coalesce("reason", F.lit("no_role_metadata")).alias("slide_role_reason"), F.coalesce("coverage_weight", F.lit(1.0)).alias("coverage_weight"), *have, F.filter(missed, lambda x: ~is_visual(x)).alias("missed"), F.filter(missed, is_visual).alias("visual_missed"), F.bround("delivery_stability", 2).alias("delivery_stability"))


def overall_all(coverage: DataFrame, delivery: DataFrame, pace: DataFrame) -> DataFrame:
    """overall() with the coverage of all slides beside that of scored ones, both as shown to users, and how many are scored.

    coverage: coverage_score() of the session's slides.
    """
    o = overall(coverage.select("session_id", "content_coverage"), delivery, pace)
    every = F.coalesce("content_coverage_all", F.lit(0.0))
    c = coverage.select("session_id", F.bround(every, 2).alias("content_coverage_all"), F.bround(s.score_map(every / 100.0), 2).alias("content_coverage_user_all"), "content_scored_slide_count")
    return o.join(c, "session_id", "left").fillna(0.0, ["content_coverage_all", "content_coverage_user_all"]).fillna(0, ["content_scored_slide_count"])


def global_summary(slides: DataFrame, overall_rows: DataFrame) -> DataFrame:
    """Per session: slides, mean pace and silence of those with delivery, change points in all, and the overall scores.

    slides: (session, slide, speech_rate, silence_ratio, change_points), nulls where there is no delivery.
    """
    g = slides.groupBy("session_id").agg(F.count("*").alias("total_slides"), F.avg("speech_rate").alias("mean_speech_rate"), F.avg("silence_ratio").alias("mean_silence_ratio"), F.sum(F.coalesce("change_points", F.lit(0))).alias("total_change_points"))
    return g.join(overall_rows, "session_id", "left")


def sections(detail: DataFrame, segments: DataFrame, comments: DataFrame, title: str = "슬라이드 {}") -> DataFrame:
    """What a back end lists of a report: each slide with its whole seconds, percent of coverage (null if there is none) and comment."""
    j = detail.select(*KEYS, "coverage").join(segments.select(*KEYS, "start_sec", "end_sec"), KEYS, "left").join(comments.select(*KEYS, "comment"), KEYS, "left")
    return j.select("session_id", F.col("slide_id").alias("section_index"), F.replace(F.lit(title), F.lit("{}"), F.col("slide_id").cast("string")).alias("title"), *[F.coalesce(F.col(f"{x}_sec").cast("int"), F.lit(0)).alias(f"{x}_time_sec") for x in ("start", "end")], F.bround(F.col("coverage") * 100, 0).cast("int").alias("score"), F.coalesce("comment", F.lit("")).alias("feedback"))


def calibration_snapshot(issue_rows: DataFrame, severities: DataFrame, texts: DataFrame, slides: DataFrame, alignment: DataFrame) -> DataFrame:
    """Counters of a report in long form (session, section, key, value), for comparison with delta().

    Issues: in all, by issue, and those about content; sections of severity HIGH_SECTION
    on that have one; feedback by severity and how much of it is unsure. Slides: in
    all, by role, least and greatest coverage (4 digits), scored ones. Alignment: confidence (4 digits),
    warnings and boundaries. texts: feedback(); slides: (session, slide, role,
    coverage_weight, coverage); alignment: (session, confidence, n_warnings, n_boundaries).
    """
    row = lambda section, key, value: F.struct(F.lit(section).alias("section"), key.alias("key"), value.cast("double").alias("value"))
    total = F.lit("total")
    about_content = F.col("issue").isin(*CONTENT_ISSUES)
    by = issue_rows.groupBy("session_id", "issue").agg(F.count("*").alias("n"))
    parts = [
        by.groupBy("session_id").agg(F.array(row("issue", total, F.sum("n")), row("ce_issue", total, F.sum(F.when(about_content, F.col("n")).otherwise(0)))).alias("x")).select("session_id", F.explode("x").alias("x")),
        by.select("session_id", row("issue", F.col("issue"), F.col("n")).alias("x")),
        by.where(about_content).select("session_id", row("ce_issue", F.col("issue"), F.col("n")).alias("x")),
        severities.where((F.col("severity") >= HIGH_SECTION) & F.arrays_overlap(F.split("issues", ","), F.array(*map(F.lit, CONTENT_ISSUES)))).groupBy("session_id").agg(row("ce_issue", F.lit("high_sections"), F.count("*")).alias("x")),
        texts.groupBy("session_id", "severity").agg(row("feedback", F.col("severity"), F.count("*")).alias("x")).select("session_id", "x"),
        texts.groupBy("session_id").agg(row("feedback", F.lit("low_confidence"), F.count_if(F.col("text").rlike(UNSURE))).alias("x")),
        slides.groupBy("session_id", "role").agg(row("role", F.col("role"), F.count("*")).alias("x")).select("session_id", "x"),
        slides.groupBy("session_id").agg(F.array(row("slides", total, F.count("*")), row("slides", F.lit("content"), F.count_if((F.col("coverage_weight") > 0) & F.col("coverage").isNotNull())), row("score", F.lit("coverage_min"), F.bround(F.min("coverage"), 4)), row("score", F.lit("coverage_max"), F.bround(F.max("coverage"), 4))).alias("x")).select("session_id", F.explode("x").alias("x")),
        alignment.select("session_id", F.explode(F.array(row("score", F.lit("confidence"), F.bround("confidence", 4)), row("alignment", F.lit("warnings"), F.col("n_warnings")), row("alignment", F.lit("boundaries"), F.col("n_boundaries")))).alias("x")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("session_id", "x.*")
