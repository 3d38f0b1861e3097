"""Where a talk's delivery changes: a kernel two-sample scan over its frames."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.delivery import SERIES, zscores

# Fixed value: what a change must save of the kernel cost.
PENALTY = 3.0
#: Frames on each side of a place that are held against each other, the fewest, and random cosine features.
REACH, LEAST, FEATURES = 20, 2, 12
SEED = 11


def directions(n_series: int, features: int = FEATURES, seed: int = SEED) -> list[list[float]]:
    """Random directions whose cosines and sines stand for the Gaussian kernel exp(-|x - y|^2 / (2 n)), n the number of series."""
    r = random.Random(seed)
    return [[round(r.gauss(0.0, n_series**-0.5), 6) for _ in range(n_series)] for _ in range(features)]


def _gain(left: Column, n_left: Column, right: Column, n_right: Column, features: int) -> Column:
    """Kernel cost saved by a cut between two stretches, from their sums of features."""
    square = F.aggregate(F.zip_with(left, right, lambda x, y: F.pow(y / n_right - x / n_left, 2)), F.lit(0.0), lambda s, x: s + x)
    return F.bround(n_left * n_right / (n_left + n_right) * square / features, 6)


def find_changes(frames: DataFrame, keys=SERIES, penalty: float = PENALTY, reach: int = REACH, features: int = FEATURES) -> DataFrame:
    """(session_id, frame_idx, t, gain): the first frames after a change, and what cutting there saves of the cost.

    The cost of a stretch is the sum of squared distances of its frames from their mean
    in the kernel's feature space; a Gaussian kernel on z-scored series sees any
    change of distribution, not of the mean alone. Random cosines stand for the
    kernel, so all that is needed are running sums of 2 * features columns in one ordered window.
    A place is proposed where `reach` frames on each side, cut there, save more than half the
    penalty and more than at any place within reach (the first of equals). It is
    kept if the whole stretches between its neighbours, cut there, save more than the penalty.
    A missing measure is taken as 0, as a pause in speech has no pitch. Sessions of fewer than 2 * LEAST frames
    have no change.
    """
    session = Window.partitionBy("session_id")
    order = session.orderBy("frame_idx")
    known = frames.select("session_id", "frame_idx", "t", *[F.coalesce(F.nanvl(F.col(k), F.lit(0.0)), F.lit(0.0)).alias(k) for k in keys])
    z = zscores(known, keys)
    turns = [sum((F.col(f"{k}_z") * w for k, w in zip(keys, ws, strict=True)), F.lit(0.0)) for ws in directions(len(keys), features)]
    running = [F.sum(f(x)).over(order.rowsBetween(Window.unboundedPreceding, 0)) for x in turns for f in (F.cos, F.sin)]
    zeros = F.array(*[F.lit(0.0)] * len(running))
    x = z.select("session_id", "frame_idx", "t", (F.row_number().over(order) - 1).alias("i"), F.count("*").over(session).alias("n"), F.array(*running).alias("upto"))
    total = F.last("upto").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumns({"here": F.coalesce(F.lag("upto").over(order), zeros), "back": F.coalesce(F.lag("upto", reach + 1).over(order), zeros), "total": total})
    x = x.withColumn("ahead", F.coalesce(F.lead("upto", reach - 1).over(order), "total"))
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    n_left, n_right = F.least("i", F.lit(reach)), F.least(F.col("n") - F.col("i"), F.lit(reach))
    gain = F.when((F.col("i") >= LEAST) & (F.col("n") - F.col("i") >= LEAST), _gain(minus("here", "back"), n_left, minus("ahead", "here"), n_right, features))
    x = x.select("session_id", "frame_idx", "t", "i", "n", "here", "total", gain.alias("gain"))
    before, after = F.max("gain").over(order.rowsBetween(-reach, -1)), F.max("gain").over(order.rowsBetween(1, reach))
    peaks = x.withColumns({"before": before, "after": after}).where((F.col("gain") > penalty / 2) & (F.col("gain") > F.coalesce("before", F.lit(-1.0))) & (F.col("gain") >= F.coalesce("after", F.lit(-1.0))))
    first, last = F.coalesce(F.lag("i").over(order), F.lit(0)), F.coalesce(F.lead("i").over(order), "n")
    p = peaks.withColumns({"from_sum": F.coalesce(F.lag("here").over(order), zeros), "to_sum": F.coalesce(F.lead("here").over(order), "total"), "from_i": first, "to_i": last})
    whole = _gain(minus("here", "from_sum"), F.col("i") - F.col("from_i"), minus("to_sum", "here"), F.col("to_i") - F.col("i"), features)
    return p.where(whole > penalty).select("session_id", "frame_idx", "t", "gain")
