"""Scoring formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default curve from raw coverage (0-1) to the score shown (0-100), and reliability limits.
CURVE = ((0.0, 0.0), (0.15, 40.0), (0.30, 65.0), (0.50, 82.0), (0.70, 95.0), (1.0, 100.0))
MEDIUM, HIGH = 0.03, 0.05
FORCE_LOW, DEMOTE = ("low_alignment_confidence",), ("robust_fallback_applied",)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def plateau(x: Column, zero_min: float, full_min: float, full_max: float, zero_max: float) -> Column:
    """0 up to zero_min, rising to 1 at full_min, 1 to full_max, falling to 0 at zero_max."""
    up = clamp((x - zero_min) / (full_min - zero_min)) if full_min > zero_min else F.lit(0.0)
    down = clamp((zero_max - x) / (zero_max - full_max)) if zero_max > full_max else F.lit(0.0)
    return F.when(x.between(full_min, full_max), 1.0).when(x < full_min, up).otherwise(down)


def density(x: Column, full_max: float, zero_at: float) -> Column:
    """1 up to full_max, falling to 0 at zero_at."""
    down = clamp((zero_at - x) / (zero_at - full_max)) if zero_at > full_max else F.lit(0.0)
    return F.when(x <= full_max, 1.0).otherwise(down)


def rescale(x: Column, lo: float, hi: float) -> Column:
    return clamp((x - lo) / (hi - lo)) if hi > lo else x


def score_map(raw: Column, points=CURVE) -> Column:
    """Piecewise-linear map over control points (sorted here; repeated places keep the last); ends are held."""
    pts = sorted(dict(points or CURVE).items())
    if len(pts) < 2:
        pts = sorted(dict(CURVE).items())
    out = F.lit(float(pts[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(pts, pts[1:], strict=False))):
        out = F.when(raw <= x1, y0 + (y1 - y0) * (raw - x0) / (x1 - x0)).otherwise(out)
    return F.when(raw <= pts[0][0], float(pts[0][1])).otherwise(out)


def reliability(confidence: Column, warnings: Column, medium: float = MEDIUM, high: float = HIGH) -> Column:
    """low / medium / high; null confidence is 0, some warnings force low, others lower by a level."""
    c = F.coalesce(confidence, F.lit(0.0))
    w = F.coalesce(warnings, F.array().cast("array<string>"))
    level = F.when(c >= high, 2).when(c >= medium, 1).otherwise(0)
    level = F.when(F.arrays_overlap(w, F.array(*map(F.lit, FORCE_LOW))), 0).when(F.arrays_overlap(w, F.array(*map(F.lit, DEMOTE))), F.greatest(level - 1, F.lit(0))).otherwise(level)
    return F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), level + 1)


def overall_delivery(rate: Column, silence: Column, energy_drop: Column, pitch_shift: Column) -> Column:
    """Training target: .45 pace + .30 silence + .25 steadiness."""
    pace = F.exp(-F.abs(rate - 2.2) / 1.8)
    quiet = F.greatest(F.lit(0.0), 1.0 - silence / 0.45)
    steady = F.greatest(F.lit(0.0), 1.0 - 0.5 * (energy_drop + pitch_shift))
    return clamp(0.45 * pace + 0.30 * quiet + 0.25 * steady)


def bce(logit: Column, label: Column) -> Column:
    """Logistic loss in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


def edge(x: Column, digits: int = 6) -> Column:
    """Round half to even, once, at the edge of a report."""
    return F.bround(x, digits)
