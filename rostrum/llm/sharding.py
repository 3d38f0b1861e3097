"""Sharding by extendible hashing.

A directory maps prefixes of a 60-bit hash of the id to shards. It starts with
one bucket; a bucket above the byte limit is split on its next bit, others stay as
they are, until every bucket fits or holds a single row. A round looks at several
bits at once: rows of the buckets still too large are summed by a longer prefix,
and each prefix's ancestors are summed from these cells, so a row is read once a
round and a bucket is split only as deep as it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm.mixing import id_hash
from rostrum.llm.rows import free
from rostrum.plans import scratch

LIMIT_BYTES = 256 << 20
BITS = 60
#: Bits that a round after the first may add.
STEP = 6


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell (prefix of `high` bits): depth of its shallowest ancestor below `low` bits that fits, null if none does."""
    cells = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("part", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = cells.groupBy("depth", "part").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    sums = sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1))
    fit = cells.select("cell", "depth", "part").join(sums, ["depth", "part"])
    return fit.groupBy("cell").agg(F.min(F.struct("depth", "part", "shard_bytes", "shard_docs")).alias("leaf")).select("cell", "leaf.*")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """One row per input row: id, bytes, shard (prefix bits as text), depth, shard_bytes, shard_docs.

    bytes is the UTF-8 length of the text, 0 for null. A shard is above the limit
    only if it is a single row that is. Rows that repeat an id share all 60 bits;
    where they alone exceed the limit they go on splitting by a hash of their row
    number, so no shard is left too large. A null id hashes as empty text. An
    empty table gives an empty result; the root shard's name is empty.
    """
    made = lambda: _assign(docs, id_col, text_col, limit_bytes, []).withColumnRenamed("id", id_col)
    return scratch.settle(docs.sparkSession, made, "shards")


def _assign(docs: DataFrame, id_col: str, text_col: str, limit_bytes: int, carried: list) -> DataFrame:
    """What assign gives, with the carried columns of docs in a struct `row_of_docs` if there are any."""
    cols = ["row_of_docs"] if carried else []
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("bytes"), id_hash(F.col(id_col)).alias("h"), F.monotonically_increasing_id().alias("row"), *([F.struct(*carried).alias(cols[0])] if carried else []))
    rows = scratch.keep(rows, "bytes")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(2, total / limit_bytes))) + 2))
    left, done, base = rows.withColumn("name", F.lit("")), [], 0
    while True:
        cell = F.shiftright("h", BITS - high)
        cells = left.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        fit = scratch.keep(_leaves(cells, low, high, limit_bytes), "directory")
        here = left.withColumn("cell", cell)
        name = F.concat("name", F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("part").cast("string"), 10, 2), F.col("depth"), "0")))
        done.append(here.join(fit, "cell").select("id", "bytes", name.alias("shard"), (F.col("depth") + base).alias("depth"), "shard_bytes", "shard_docs", *cols))
        over = scratch.keep(here.join(fit, "cell", "left_anti").drop("cell"), "oversized")
        if not over.limit(1).count():
            out = done[0]
            for x in done[1:]:
                out = out.unionByName(x)
            return out
        if high == BITS:  # equal ids: one bucket each, split further by row
            if base:
                raise ValueError("row hashes collide")
            whole = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), BITS, "0")
            over = scratch.keep(over.select("id", "bytes", id_hash(F.col("row")).alias("h"), "row", whole.alias("name"), F.col("h").alias("id_hash"), *cols), "repeats")
            return _union(done, _rows_of_one_id(over, cols, limit_bytes))
        left, low, high = over, high + 1, min(BITS, high + STEP)


def _union(parts: list[DataFrame], last: DataFrame) -> DataFrame:
    for x in reversed(parts):
        last = x.unionByName(last)
    return last


def _rows_of_one_id(rows: DataFrame, cols: list[str], limit: int) -> DataFrame:
    """The same splitting within each 60-bit bucket, on the bits of the row's hash; a level per bit, as ids seldom repeat so."""
    left, parts = rows, []
    for depth in range(1, BITS + 1):
        left = left.withColumn("part", F.shiftright("h", BITS - depth))
        sums = left.groupBy("id_hash", "part").agg(F.sum("bytes").alias("shard_bytes"), F.count("*").alias("shard_docs"))
        fit = scratch.keep(sums.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)), "directory")
        bits = F.lpad(F.conv(F.col("part").cast("string"), 10, 2), depth, "0")
        parts.append(left.join(fit, ["id_hash", "part"]).select("id", "bytes", F.concat("name", bits).alias("shard"), F.lit(BITS + depth).alias("depth"), "shard_bytes", "shard_docs", *cols))
        left = scratch.keep(left.join(fit, ["id_hash", "part"], "left_anti").drop("part"), "oversized")
        if not left.limit(1).count():
            break
    return _union(parts[:-1], parts[-1])


def write(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Write the rows of docs, with all columns, as folders shard=<name> under `to`; returns shard, depth, shard_bytes, shard_docs.

    A row is carried through its assignment, so ids may be null or repeat. If docs
    has a column `shard`, the folders' column is `shard_`, and so on.
    """
    spark = docs.sparkSession
    made = scratch.settle(spark, lambda: _assign(docs, id_col, text_col, limit_bytes, docs.columns), "shards")
    name = free(docs, "shard")
    made.select("row_of_docs.*", F.col("shard").alias(name)).repartition(name).write.partitionBy(name).parquet(to)
    out = scratch.keep(made.select("shard", "depth", "shard_bytes", "shard_docs").distinct(), "directory")
    scratch.drop(made)
    return out


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
x AS (SELECT *, h >> (60 - depth) AS part FROM d, (SELECT unnest(range(0, 41)) AS depth)),
b AS (SELECT depth, part, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM x GROUP BY ALL),
l AS (SELECT x.doc_id, x.bytes, min(depth) AS depth, arg_min(part, depth) AS part, arg_min(shard_bytes, depth) AS shard_bytes, arg_min(shard_docs, depth) AS shard_docs
      FROM x JOIN b USING (depth, part) WHERE shard_bytes <= {LIMIT_BYTES} OR shard_docs = 1 GROUP BY x.doc_id, x.bytes)
SELECT doc_id, bytes, CASE WHEN depth = 0 THEN '' ELSE right(part::BIGINT::BIT::VARCHAR, depth::INT) END AS shard, depth, shard_bytes, shard_docs FROM l
"""
