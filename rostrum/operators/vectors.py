"""Vector arithmetic on arrays, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.operators.intervals import inside


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def scaled(v: str, length: str) -> Column:
    """The vector column over its length, a column beside it; a zero vector stays."""
    return F.when(F.col(length) > 0, F.transform(v, lambda x: x / F.col(length))).otherwise(F.col(v))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "v", weight: str = "weight") -> DataFrame:
    """Weighted mean vector per key, normalised; sums per dimension are combined before the shuffle."""
    d = rows.select(*keys, F.col(weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    s = d.groupBy(*keys, "_i").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_x"))
    m = s.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda p: p["_x"]).alias("_m"), F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_n"))
    return m.select(*keys, scaled("_m", "_n").alias("mean"))


def pooled(rows: DataFrame, keys: list[str], vector: str = "v", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Mean of chunks' vectors weighted by their duration, per key; keys whose chunks have none go."""
    d = rows.select(*keys, F.greatest(F.lit(0.0), F.col(hi) - F.col(lo)).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    s = d.groupBy(*keys, "_i").agg(F.sum(F.col("_x") * F.col("_w")).alias("_s"), F.sum("_w").alias("_w")).where("_w > 0")
    return s.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", (F.col("_s") / F.col("_w")).alias("x")))), lambda p: p["x"]).alias("pooled"))


def norms(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean and deviation of the lengths of the embedding frames (session, t, v) in each segment (session, slide, lo, hi), both ends closed."""
    n = frames.select("session_id", "t", F.sqrt(dot("v", "v")).alias("norm"))
    return inside(n, segments).groupBy("session_id", "slide_id").agg(F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"))
