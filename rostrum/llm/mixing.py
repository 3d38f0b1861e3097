"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source takes each of its
documents a whole number of times, and those below a hash threshold once more.
The threshold comes from histograms: tokens are summed by source and hash bucket,
a running sum over the (at most 1024) buckets of a source finds the bucket in
which the budget ends, and only that bucket's rows are summed again by finer
buckets. No document is sorted; the final selection is a filter on the hash.
What the first threshold leaves of a budget goes to further, smaller documents by
the same rule (ROUNDS nested thresholds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm.rows import free
from rostrum.plans import scratch

WEIGHTS = (5, 2, 1)
#: Words of the mix per 100 words of the input, and how often a document may be taken at most.
PERCENT, MOST = 150, 2
ROUNDS = 3
BITS, STEP = 60, 10


def id_hash(col: Column) -> Column:
    """60 bits of the id's MD5, the same in any engine; null is as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0.

    Words are as many as their last characters: those followed by white space or the end.
    """
    t = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(t, " "), lambda x: x != "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """From (source, source_size): each source's target.

    Sources in code point order, null last, get the weights in turn. With caps
    most*size, sharing the excess by weight until nobody is above ends at
    min(cap, level*weight); the level is found by one pass over the sources in
    the order in which they reach their caps. The table has one row a source.
    """
    w_all = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(w_all, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    capped, used = F.coalesce(F.sum("source_size").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(everyone) * percent / 100.0 - capped * most) / (F.sum("weight").over(everyone) - used)
    w = w.withColumn("at", level).withColumn("cap", F.col("source_size") * float(most))
    w = w.withColumn("level", F.min(F.when(F.col("at") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("at").alias("at")))).over(everyone)["at"])
    return w.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def _with(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the columns of right, which has one row a source; null is a source.

    Spark broadcasts right while its size is under its threshold, and shuffles beyond.
    """
    return left.join(right.withColumnRenamed("source", "_s"), F.expr("source <=> _s"), how).drop("_s")


def _cuts(rows: DataFrame, weights, percent: int, most: int, rounds: int) -> DataFrame:
    """From (source, size, h): per source its size, target, whole copies, and each round's budget b and threshold t.

    One table of a row a source is carried from level to level: with its cuts so
    far, and while its boundary bucket is sought, that bucket's prefix and the words before it.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).cast("long")
    state = targets(sizes, weights, percent, most).withColumn("whole", whole).withColumn("b0", F.col("target") - F.col("whole") * F.col("source_size"))
    state = scratch.keep(state, "cuts")
    for k in range(rounds):
        state = _search(rows, state, k)
        if k + 1 < rounds:
            state = state.withColumn(f"b{k + 1}", F.col(f"b{k}") - F.col("took"))
        state = state.drop("took")
    return state


def _search(rows: DataFrame, state: DataFrame, k: int) -> DataFrame:
    """state with t (the hash below which what is left of a source fits its budget b; 2^BITS: all of it) and took (the words below it)."""
    b, t = F.col(f"b{k}"), f"t{k}"
    left = F.lit(True)  # not taken by an earlier cut
    for i in range(k):
        left = left & ~((F.col("size") <= F.col(f"b{i}")) & (F.col("h") < F.col(f"t{i}")))
    fits = (F.col("size") > 0) & (F.col("size") <= b) & left
    state = state.withColumn("prefix", F.lit(0).cast("long")).withColumn("base", F.lit(0).cast("long")).withColumn(t, F.lit(None).cast("long")).withColumn("took", F.lit(0).cast("long"))
    cols = state.columns
    for low in range(0, BITS, STEP):
        open_ = state.where(F.col(t).isNull())
        inside = _with(rows, open_).where(fits & (F.shiftright("h", BITS - low) == F.col("prefix")))
        cells = inside.groupBy("source", b.alias("budget"), "base", F.shiftright("h", BITS - low - STEP).alias("cell")).agg(F.sum("size").alias("words"), F.min("h").alias("first"), F.max("h").alias("last"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("cell")) + F.col("base")
        cells = cells.withColumn("upto", upto)
        edge = F.min(F.when(F.col("upto") > F.col("budget"), F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "first", "last")))
        found = cells.groupBy("source").agg(edge.alias("edge"), F.sum("words").alias("all_words"))
        met = _with(state, found, "left")
        new = F.col(t).isNull()
        single = (F.col("edge.first") == F.col("edge.last")) | F.lit(low + STEP >= BITS)
        fresh = {
            t: F.when(new & F.col("edge").isNull(), F.lit(1 << BITS)).when(new & single, F.col("edge.first")).otherwise(F.col(t)),
            "took": F.when(new & F.col("edge").isNull(), F.coalesce("all_words", F.lit(0))).when(new & single, F.col("edge.before")).otherwise(F.col("took")),
            "prefix": F.when(new, F.col("edge.cell")).otherwise(F.col("prefix")),
            "base": F.when(new, F.col("edge.before")).otherwise(F.col("base")),
        }
        state = scratch.keep(met.select(*[fresh.get(c, F.col(c)).alias(c) for c in cols]), "cuts")
        if not state.where(F.col(t).isNull()).limit(1).count():
            break
    return state.drop("prefix", "base")


def _copies(size: Column, h: Column, rounds: int, cut: str = "") -> Column:
    """How often a document is taken, by its source's cuts beside it."""
    once_more = F.lit(False)
    for k in range(rounds):
        once_more = once_more | ((size > 0) & (size <= F.col(f"{cut}b{k}")) & (h < F.col(f"{cut}t{k}")))
    return F.col(f"{cut}whole") + once_more.cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken, copies.

    A document is taken 0 to `most` times whole; taken = copies*size. Null text
    has size 0, null is a source of its own, and documents without words are taken
    as often as their source is repeated whole. Rows that repeat an id share its
    hash; of the same size and source, they are taken alike. An empty table gives an
    empty result.
    """

    def made() -> DataFrame:
        rows = scratch.keep(_sized(docs, id_col, text_col, source_col), "sizes")
        out = _with(rows, scratch.keep(_cuts(rows, weights, percent, most, rounds), "cuts")).withColumn("copies", _copies(F.col("size"), F.col("h"), rounds))
        return out.select(id_col, "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

    return scratch.settle(docs.sparkSession, made, "mix")


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """The mix itself: every row of docs as many times as mix() takes it, with all its columns.

    How often follows from a row's own id, source and size, and its source's cuts,
    so rows are filtered and repeated where they lie.
    """

    def made() -> DataFrame:
        rows = scratch.keep(_sized(docs, id_col, text_col, source_col), "sizes")
        return _cuts(rows, weights, percent, most, rounds)

    cuts = scratch.settle(docs.sparkSession, made, "cuts")
    cut, n = free(docs, "cut"), free(docs, "copy_number")
    one = cuts.select(F.col("source").alias(free(docs, "cut_source")), F.struct(*[c for c in cuts.columns if c != "source"]).alias(cut))
    met = docs.join(one, docs[source_col].eqNullSafe(one[one.columns[0]]))
    copies = _copies(n_words(F.col(text_col)), id_hash(F.col(id_col)), rounds, f"{cut}.")
    met = met.withColumn(n, copies.cast("int")).where(F.col(n) > 0)
    return met.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
        ((SELECT sum(source_size) FROM w)::DOUBLE * 150 / 100.0::DOUBLE
         - coalesce(sum(source_size) OVER o, 0)::DOUBLE * 2) / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER o, 0))::DOUBLE AS at_level
      FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(at_level, cap / weight) AS lev FROM f WHERE at_level * weight <= cap),
t AS (SELECT source, source_size, least(cap, lev * weight) AS target FROM f, l),
p AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 2)::BIGINT END AS whole FROM t),
r0 AS (SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget, false AS more
       FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
r AS (
  SELECT 0 AS k, * FROM r0
  UNION ALL
  SELECT k + 1, doc_id, source, size, h, source_size, target, whole,
         budget - coalesce(sum(CASE WHEN new THEN size END) OVER (PARTITION BY source), 0) AS budget, more OR new
  FROM (SELECT *, fits AND coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source ORDER BY h) <= budget, false) AS new
        FROM (SELECT *, NOT more AND size > 0 AND size <= budget AS fits FROM r WHERE k < 3)))
SELECT doc_id, source, size, source_size, target, (whole + more::BIGINT) * size AS taken, whole + more::BIGINT AS copies FROM r WHERE k = 3
"""
