"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are the same after deleting every ASCII white space
character. A Misra-Gries pass (Spark's ``freqItems``) names the digests that may
be frequent; an exact count verifies them and finds the winner of each. These few
winners (at most 1/support of them, whatever the input) are broadcast, so rows of
a large group are decided where they lie. All other digests go through an
ordinary shuffle, in which no key has more than that share of the rows; a window
over one spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.llm import rows as row_keys
from rostrum.plans import scratch

#: A digest is frequent from this share of the rows on; its inverse bounds what is broadcast.
SUPPORT = 1 / 2048
BLANKS = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text without ASCII white space; null is as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def _order(id_col: str) -> Column:
    """What the row that stays has the least of: most code points, then smallest id (null last), then first row."""
    return F.struct((-F.col("n_cp")).alias("a"), F.col(id_col).isNull().alias("b"), F.col(id_col).alias("c"), F.col("row").alias("d"))


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: id, n_cp, digest, keep_id, group_size, kept.

    Null text counts as empty, and empty texts are equal to each other. Of rows
    that repeat even the id, exactly one is kept. A null id sorts last. An empty
    table gives an empty result; other columns are ignored.
    """
    return _decide(docs, id_col, text_col, support, F.lit(None).cast("binary")).drop("key")


def _decide(docs: DataFrame, id_col: str, text_col: str, support: float, key: Column) -> DataFrame:
    """What decide gives, with the row's key beside it."""
    rows = docs.select(
        F.col(id_col),
        F.unhex(digest(F.col(text_col))).alias("digest"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_cp"),
        F.monotonically_increasing_id().alias("row"),
        key.alias("key"),
    )
    rows = scratch.keep(rows, "digests")
    total = rows.count()
    best = [F.count("*").alias("group_size"), F.min(_order(id_col)).alias("best")]
    maybe = rows.select(F.hex("digest").alias("h")).freqItems(["h"], support).select(F.explode("h_freqItems").alias("h")).select(F.unhex("h").alias("digest")).distinct()
    winners = scratch.keep(rows.join(F.broadcast(maybe), "digest", "left_semi").groupBy("digest").agg(*best).where(F.col("group_size") >= F.lit(max(2, int(total * support)))), "winners")
    hot = rows.join(F.broadcast(winners), "digest").select(*rows.columns, "group_size", "best")
    w = Window.partitionBy("digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(*rows.columns, F.count("*").over(w).alias("group_size"), F.min(_order(id_col)).over(w).alias("best"))
    return hot.unionByName(cold).select(id_col, "n_cp", "digest", F.col("best.c").alias("keep_id"), "group_size", (F.col("row") == F.col("best.d")).alias("kept"), "key")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The decisions with the digest as text: id, keep_id, group_size, kept, text_sha256."""
    made = lambda: decide(docs, id_col, text_col, support).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
    return scratch.settle(docs.sparkSession, made, "exact-copies")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The input rows that stay, one of each group of equal texts, with all their columns.

    It is the row with the most code points, then the least id (null last); of
    rows that agree in id and text, any one. The texts are not shuffled while the
    keys of what goes are few enough to broadcast.
    """

    def fewer() -> DataFrame:
        made = _decide(docs, id_col, text_col, support, row_keys.key(id_col, text_col)).where("group_size > 1")
        same = made.groupBy("key").agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
        return same.where(~F.col("stays") | (F.col("n") > 1)).select("key", "stays")

    return row_keys.thin(docs, row_keys.key(id_col, text_col), scratch.settle(docs.sparkSession, fewer, "copies"))
