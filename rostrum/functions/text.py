"""Text rules for slides and transcripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words, matched whole on the trimmed lower-case token.
FILLERS = ("어+", "음+", "아+", "그+", "저+", "뭐+", "에+", "이+", "그래서", "그러니까", "사실", "뭐랄까", "있잖아", "있잖아요")
# Words that mark a line as a figure rather than a title.
METRIC_WORDS = ("%", "H", "년차", "건", "초", "명", "억+", "AI")
# What counts as a noun without an analyser, and what starts a bullet.
NOUN = r"[A-Za-z][A-Za-z0-9_.+-]*|[가-힣]{2,}|[0-9]+(?:\.[0-9]+)?%?"
BULLET = r"^(?:[-•·*●▪◦‣]|[0-9]+[.)]|[A-Za-z][.)])\s*"
THANKS = r"(?i)(감사|thank|q\s*&?\s*a|질문)"


def one_space(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def pdf_text(x: Column) -> Column:
    """One space between words; a line of letters set apart (4 tokens or more, 3/4 of them short) is joined."""
    t = F.filter(F.split(one_space(x), " "), lambda w: w != "")
    short = F.size(F.filter(t, lambda w: F.char_length(w) <= 2))
    return F.when((F.size(t) >= 4) & (short >= 0.75 * F.size(t)), F.array_join(t, "")).otherwise(F.array_join(t, " "))


def is_icon(x: Column) -> Column:
    """Private-use characters only."""
    return F.coalesce(F.trim(x).rlike(r"^[\x{F000}-\x{F8FF}]+$"), F.lit(False))


def is_metric(x: Column) -> Column:
    t = F.regexp_replace(F.trim(x), " ", "")
    words = F.exists(F.array(*map(F.lit, METRIC_WORDS)), lambda w: F.contains(t, w))
    return (words & (F.char_length(t) <= 6)) | F.regexp_replace(t, "[.+]", "").rlike("^[0-9]+$")


def is_bullet(x: Column) -> Column:
    t = F.trim(x)
    return t.rlike(BULLET) | t.rlike(r"^[\x{F000}-\x{F8FF}].")


def strip_bullet(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike(r"^[\x{F000}-\x{F8FF}]"), F.trim(F.substring(t, 2, 1 << 30))).otherwise(F.trim(F.regexp_replace(t, BULLET, "")))


def content_line(x: Column) -> Column:
    """Normalised line without bullet; empty for icons."""
    t = pdf_text(x)
    return F.when(is_icon(t), "").otherwise(strip_bullet(t))


def title_score(x: Column) -> Column:
    """Length, less for figures and bullets, more for letters, Hangul and capitals; -1 for nothing."""
    t = F.trim(x)
    s = F.char_length(t) - F.when(is_metric(t), 20).otherwise(0) - F.when(is_bullet(x), 25).otherwise(0)
    s = s + F.when(t.rlike(r"\p{L}"), 2).otherwise(0) + F.when(t.rlike("[가-힣]"), 2).otherwise(0)
    s = s + F.when((t == F.upper(t)) & (t != F.lower(t)), 1).otherwise(0)
    return F.when((t == "") | is_icon(t), -1.0).otherwise(s.cast("double"))


def layout_score(x: Column, font: Column, y0: Column) -> Column:
    """Title score with font size and height on the page."""
    n = F.char_length(F.trim(x))
    s = title_score(x) + F.least(font, F.lit(40.0)) * 2.2 + F.greatest(F.lit(0.0), 180.0 - F.least(y0, F.lit(180.0))) * 0.12
    s = s - F.when(n > 60, 12).otherwise(0) - F.when(n < 3, 6).otherwise(0)
    return s + F.when((font >= 24) & (y0 <= 110), 18).when((font >= 18) & (y0 <= 140), 8).otherwise(0)


def syllables(x: Column, pattern: str = "[가-힣]") -> Column:
    return F.regexp_count(x, F.lit(pattern))


def is_filler(x: Column, patterns=FILLERS) -> Column:
    return F.lower(F.trim(x)).rlike("^(?:" + "|".join(patterns) + r")\z")


def nouns(x: Column, pattern: str = NOUN) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(f"({pattern})"), 1), F.lower)


def compact(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"\s+", ""))


def short_title(x: Column) -> Column:
    """At most two words, or six characters without spaces."""
    return (F.size(F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")) <= 2) | (F.char_length(compact(x)) <= 6)


def cut(x: Column, n: int) -> Column:
    """At most n characters, the last of them an ellipsis where something was cut."""
    return F.when(F.char_length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n - 1)), F.lit("…"))).otherwise(x)
