"""Predictions against gold labels, probe losses, bootstrap and ablation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions.score import bce

KEYS = ["session_id", "slide_id"]


def join_gold(gold: DataFrame, pred: DataFrame, missing: float = 0.0) -> DataFrame:
    """Every gold row with its prediction, or the default."""
    return gold.join(pred, KEYS, "left").withColumn("pred", F.coalesce("pred", F.lit(missing)))


def correlation(x: str, y: str) -> Column:
    """Pearson; 0 where either side is constant."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), F.lit(0.0))


def coverage_metrics(rows: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Accuracy at the threshold, mean absolute error and correlation."""
    return rows.agg(F.count("*").alias("n"), F.avg(((F.col("gold") >= threshold) == (F.col("pred") >= threshold)).cast("double")).alias("accuracy"), F.avg(F.abs(F.col("gold") - F.col("pred"))).alias("mae"), correlation("gold", "pred").alias("correlation"))


def precision_recall(tp: Column, predicted: Column, gold: Column) -> list[Column]:
    """Precision, recall and F1; nothing against nothing is 0."""
    p, r = F.coalesce(F.try_divide(tp, predicted), F.lit(0.0)), F.coalesce(F.try_divide(tp, gold), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def missed_metrics(rows: DataFrame) -> DataFrame:
    """Micro precision and recall of missed keypoints, from arrays gold_missed and pred_missed."""
    s = rows.agg(F.sum(F.size(F.array_intersect("gold_missed", "pred_missed"))).alias("tp"), F.sum(F.size(F.array_distinct("pred_missed"))).alias("np"), F.sum(F.size(F.array_distinct("gold_missed"))).alias("ng"))
    return s.select(F.col("tp"), *precision_recall(F.col("tp"), F.col("np"), F.col("ng")))


def pr_curve(rows: DataFrame, steps: int = 20) -> DataFrame:
    """Precision and recall at thresholds 0, 1/steps, ..., 1; gold and prediction are both cut at the threshold.

    Rows are counted by how many thresholds each side reaches, at most (steps + 2)^2
    cells before the shuffle; the curve is made from the cells.
    """
    at = F.array(*[F.lit(k) / F.lit(steps) for k in range(steps + 1)])
    reach = lambda c: F.size(F.filter(at, lambda t: F.col(c) >= t))
    cells = rows.groupBy(reach("gold").alias("g"), reach("pred").alias("p")).agg(F.count("*").alias("n"))
    t = cells.select("g", "p", "n", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    sum_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    s = t.groupBy("k").agg(sum_if((F.col("g") > F.col("k")) & (F.col("p") > F.col("k"))).alias("tp"), sum_if(F.col("p") > F.col("k")).alias("np"), sum_if(F.col("g") > F.col("k")).alias("ng"))
    return s.select((F.col("k") / steps).alias("threshold"), *precision_recall(F.col("tp"), F.col("np"), F.col("ng")))


def tolerance_matches(pairs: DataFrame, tolerance: float) -> DataFrame:
    """From arrays gold and pred: predictions matched one to one, each to the first gold time, in the array's order, that is free and within the tolerance.

    Equal gold times are different ones. Greedy in the order of predictions: one
    fold over each row's arrays. Gold times in reach are a stretch of the sorted ones, found by
    bisection; its state is a bit for each gold time.
    """
    n = F.size("gold")
    times = F.array_sort(F.transform("gold", lambda x, i: F.struct(x.alias("t"), i.alias("i"))))
    p = pairs.withColumn("_g", times)

    def below(value):
        """How many sorted times are below the value."""
        halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.element_at("_g", s["lo"] + F.expr("1") + F.shiftright(s["hi"] - s["lo"], 1))["t"] < value, F.struct((s["lo"] + F.shiftright(s["hi"] - s["lo"], 1) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (s["lo"] + F.shiftright(s["hi"] - s["lo"], 1)).alias("hi")))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]

    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))
    word = lambda i: (i / 64).cast("int")
    slack = tolerance * 1e-9 + 1e-9

    def step(state, x):
        lo = below(x - tolerance - slack)
        near = F.slice("_g", lo + 1, F.greatest(below(x + tolerance + slack) - lo, F.lit(0)))
        free = F.filter(near, lambda g: (F.abs(g["t"] - x) <= tolerance) & (F.element_at(state["used"], word(g["i"]) + 1).bitwiseAND(bit(g["i"])) == 0))
        first = F.array_min(F.transform(free, lambda g: g["i"]))
        used = F.transform(state["used"], lambda u, k: F.when(k == word(first), u.bitwiseOR(bit(first))).otherwise(u))
        return F.when(first.isNull(), state).otherwise(F.struct(used.alias("used"), (state["tp"] + 1).alias("tp")))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), word(n) + 1).alias("used"), F.lit(0).alias("tp"))
    m = p.withColumn("tp", F.when(n > 0, F.aggregate("pred", start, step)["tp"]).otherwise(0))
    return m.select("session_id", "tp", *precision_recall(F.col("tp"), F.size("pred"), n))


def probe_loss(rows: DataFrame) -> DataFrame:
    """Mean squared error of three measures and logistic loss of two flags; the loss is the mean over rows."""
    mse = sum(((F.col(f"pred_{k}") - F.col(k)) * (F.col(f"pred_{k}") - F.col(k)) for k in ("speech_rate", "silence_ratio", "overall_delivery")), F.lit(0.0)) / 3
    flags = (bce(F.col("logit_energy_drop"), F.col("energy_drop")) + bce(F.col("logit_pitch_shift"), F.col("pitch_shift"))) / 2
    return rows.agg(F.count("*").alias("n"), F.avg(mse).alias("regression"), F.avg(flags).alias("classification"), F.avg(mse + flags).alias("loss"))


def improvement(loss: DataFrame, baseline: DataFrame) -> DataFrame:
    """The loss's row with the baseline and the percent by which the loss is below it."""
    j = loss.crossJoin(baseline.select(F.col("loss").alias("baseline")))  # one row each
    return j.withColumn("improvement_pct", F.coalesce(F.try_divide((F.col("baseline") - F.col("loss")) * 100, F.col("baseline")), F.lit(0.0)))


def quality_gate(runs: DataFrame, least: float = 50.0) -> DataFrame:
    """Runs that pass, as rows for a model registry."""
    return runs.where(F.col("improvement_pct") >= least).select("*", F.lit("PendingApproval").alias("status"))


def bootstrap(rows: DataFrame, value: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and 95 % interval by Poisson resampling.

    Equal values are counted first, so what is multiplied by the rounds is a table
    (value, count). In a round, n equal rows get one Poisson(n) weight: a hashed
    uniform against the cumulative probabilities where n is small, the normal limit
    where it is not. Reruns agree.
    """
    cells = rows.groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n")).where("x IS NOT NULL")
    r = cells.select("x", "n", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    u = lambda k: F.xxhash64("x", "round", F.lit(seed), F.lit(k)) / F.lit(2.0**64) + 0.5
    r = r.withColumn("u", u(0))
    # Poisson(n) for small n by a uniform against the cumulative probabilities, else its normal limit
    small = F.aggregate(
        F.sequence(F.lit(0), F.lit(39)),
        F.struct(F.exp(-F.col("n")).alias("p"), F.exp(-F.col("n")).alias("upto"), F.lit(0.0).alias("w")),
        lambda s, k: F.struct((s["p"] * F.col("n") / (k + 1)).alias("p"), (s["upto"] + s["p"] * F.col("n") / (k + 1)).alias("upto"), (s["w"] + F.when(F.col("u") > s["upto"], 1.0).otherwise(0.0)).alias("w")),
        lambda s: s["w"],
    )
    gauss = F.sqrt(-2 * F.log(F.greatest(u(1), F.lit(1e-300)))) * F.cos(2 * math.pi * u(2))
    w = F.when(F.col("n") <= 8, small).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * gauss)))
    m = r.select("round", "x", w.alias("w")).groupBy("round").agg(F.try_divide(F.sum(F.col("x") * F.col("w")), F.sum("w")).alias("m"))
    return m.agg(F.avg("m").alias("mean"), F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def ablation(rows: DataFrame, experiments: list[tuple[str, float, float]]) -> DataFrame:
    """Metrics of predictions scaled and shifted by each of a few named experiments."""
    e = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in experiments])
    x = rows.withColumn("e", F.explode(e)).withColumn("pred", F.col("pred") * F.col("e.a") + F.col("e.b"))
    return x.groupBy(F.col("e.name").alias("experiment")).agg(F.avg(F.abs(F.col("gold") - F.col("pred"))).alias("mae"), correlation("gold", "pred").alias("correlation"))


def silence_f1(frames: DataFrame) -> DataFrame:
    """From aligned flags (session, slide, gold, pred): F1 of each item."""
    one = lambda a, b: F.count_if((F.col("gold") == a) & (F.col("pred") == b))
    g = frames.groupBy(*KEYS).agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"))
    return g.select(*KEYS, precision_recall(F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn"))[2])


def attitude_metrics(frames: DataFrame, rates: DataFrame, energies: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: mean F1 of change points within 1, 3 and 5 s, mean error of pace, mean F1 of silence, mean correlation of energy.

    frames: aligned flags; rates: (gold, pred); energies: (session, slide, x, y); changes: (session, gold, pred) arrays.
    """
    parts = [tolerance_matches(changes, float(s)).agg(F.avg("f1").alias(f"f1_tol_{s}s")) for s in (1, 3, 5)]
    parts.append(rates.agg(F.avg(F.abs(F.col("gold") - F.col("pred"))).alias("speech_rate_mae")))
    parts.append(silence_f1(frames).agg(F.avg("f1").alias("silence_f1")))
    parts.append(energies.groupBy(*KEYS).agg(correlation("x", "y").alias("r")).agg(F.avg("r").alias("energy_perception_corr")))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns])
