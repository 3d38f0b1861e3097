"""Points in spans by an ordered sweep, without a join on a range."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inside(points: DataFrame, spans: DataFrame, at: str = "t", lo: str = "lo", hi: str = "hi", key: str = "session_id", closed: bool = True) -> DataFrame:
    """Points with each span that holds them: all columns of both, the key once.

    Spans may touch, overlap or be points; [lo, hi], or [lo, hi) unless closed. Starts and points are
    merged in order within a key, and a point looks at the spans that are open since the
    last start. What is open at each start is a fold over a key's spans (its
    slides), so the points are dealt by key once and never meet spans that are over.
    A span with a null end or its ends the wrong way round, and a point without a place, meet nothing.
    """
    span = F.struct(*[F.col(c) for c in spans.columns if c != key])
    rows = spans.where((F.col(lo) <= F.col(hi)) if closed else (F.col(lo) < F.col(hi)))
    still = (lambda s, x: s[hi] >= x) if closed else (lambda s, x: s[hi] > x)
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(lo).alias("_at"), span.alias("_s")))).alias("_a"))
    none = F.transform(F.slice("_a", 1, 0), lambda x: x["_s"])
    start = F.struct(none.alias("open"), F.transform(F.slice("_a", 1, 0), lambda x: F.struct(x["_at"].alias("_at"), none.alias("_open"))).alias("seen"))

    def step(state, x):
        now = F.concat(F.filter(state["open"], lambda s: still(s, x["_at"])), F.array(x["_s"]))
        return F.struct(now.alias("open"), F.concat(state["seen"], F.array(F.struct(x["_at"].alias("_at"), now.alias("_open")))).alias("seen"))

    starts = listed.select(key, F.posexplode(F.aggregate("_a", start, step)["seen"]).alias("_nth", "_x")).select(key, F.col("_x._at").alias("_at"), "_nth", F.col("_x._open").alias("_open"))
    kind = starts.schema["_open"].dataType
    point = F.struct(*[F.col(c) for c in points.columns if c != key])
    placed = points.where(F.col(at).isNotNull()).select(key, F.col(at).alias("_at"), F.lit(None).cast("int").alias("_nth"), F.lit(None).cast(kind).alias("_open"), point.alias("_p"))
    # a start comes before the points at its place; of starts at one place the last knows all
    order = Window.partitionBy(key).orderBy("_at", F.col("_nth").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    merged = starts.withColumn("_p", F.lit(None).cast(placed.schema["_p"].dataType)).unionByName(placed).withColumn("_open", F.last("_open", True).over(order))
    met = merged.where("_p IS NOT NULL").select(key, "_p", F.explode(F.filter("_open", lambda s: still(s, F.col("_at")))).alias("_s"))
    return met.select(key, "_s.*", "_p.*")
