"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the K smallest distinct shingle hashes of a text, cut to 48 bits and
written as base64. Sketches of parts merge into the sketch of the whole, equal texts
have equal sketches, and a text with fewer than K distinct shingles is its own sketch.
From two sketches come estimates of resemblance, containment and of the number of
distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import batches as arrow
from rostrum.llm.memo import Memo
from rostrum.llm.shingles import WIDTH, shingle_hashes, word_hashes
from rostrum.plans import scratch

K = 128
BITS = 48
#: Rows a range of ids holds, about; ranges are what is dealt out.
RANGE_ROWS = 1024
#: Most ranges; with more rows, ranges grow.
RANGES = 20_000


def sketch(text: bytes, k: int = K, width: int = WIDTH, known: Memo | None = None) -> np.ndarray:
    """The k smallest distinct 48-bit hashes of the text's shingles, ascending."""
    h = shingle_hashes(text, width, known) >> np.uint64(64 - BITS)
    while True:
        few = np.unique(np.partition(h, 4 * k)[: 4 * k] if len(h) > 4 * k else h)
        if len(few) >= k or len(h) <= 4 * k:
            return few[:k]
        h = np.unique(h)  # many repeats among the smallest
        if len(h) <= 4 * k:
            return h[:k]


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def from_text(t: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(t), np.uint8).reshape(-1, 6)
    return np.concatenate([np.zeros((len(raw), 2), np.uint8), raw], 1).reshape(-1).view(">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """About how many distinct shingles the text has; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**BITS)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """About |A and B| / |A or B|; two texts without shingles are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    shared = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(shared, both, assume_unique=True)) / len(both)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """About the share of A's shingles that B has; 1 for a text without shingles."""
    n = distinct(a, k)
    if not n:
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row per input row: id, fingerprint, n_shingles (estimate). Null text is as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_hashes()
        for b in batches:
            s = [sketch(t, k, width, known) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(to_text, s), pa.string()), pa.array([distinct(x, k) for x in s], pa.float64())], names=[id_col, "fingerprint", "n_shingles"])

    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, fingerprint string, n_shingles double")


_OUT = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit(k: int, width: int):
    """Rows (id, text, own) in the order of their ids, descending; each needs the text of the row after it."""

    def made(known: Memo, d, text: str, s: np.ndarray, after: str, after_s: np.ndarray) -> tuple:
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        raw = new.encode()
        e = sketch(raw, k, width, known)
        return d, len(text), hashlib.sha256(raw).hexdigest(), to_text(s), to_text(e), resemblance(s, e, k), resemblance(s, after_s, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, word_hashes()
        for b in batches:
            out = []
            for d, raw, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                text, s = raw.decode(), sketch(raw, k, width, known)
                if last is not None:
                    out.append(made(known, *last, text, s))
                last = (d, text, s) if own else None
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _OUT, strict=True)] if out else [pa.array([], f.type) for f in _OUT], schema=_OUT)

    return run


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and likeness to that and to the next document.

    The next document is the one before in the order of ids (after the least: the
    greatest; a null id is less than any). Rows that repeat an id follow each other
    in the order of their texts' hashes. The edited text is the text with its last
    floor(n/2) code points replaced by the next document's first as many, or all.
    Null text is as empty; one row alone is its own next; an empty table gives an
    empty result. Ids are long integers; other columns are ignored.

    Ids are cut into ranges by their quantiles; a range's rows go to one task, in
    order, and the first text of the range below follows them as a lender only.
    """
    spark = docs.sparkSession
    arrow.bound(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    keys = scratch.keep(rows.select("id", "tie"), "keys")
    n = keys.count()
    if not n:
        return spark.createDataFrame([], _sql(id_col))
    many = max(1, min(RANGES, n // RANGE_ROWS))
    cuts = sorted(set(keys.agg(F.percentile_approx("id", [i / many for i in range(1, many)], 100 * many)).first()[0] or [])) if many > 1 else []
    table = F.broadcast(spark.createDataFrame([(cuts,)], "cuts array<long>"))
    # a range is the number of cuts below the id, found by halving
    size = len(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(size.bit_length()))])
    further = lambda at, step: F.when(F.try_element_at("cuts", at + step) < F.col("id"), at + step).otherwise(at)
    place = F.aggregate(steps, F.lit(0), further) if size else F.lit(0)
    keys = keys.crossJoin(table).select("id", "tie", place.alias("range")) if size else keys.withColumn("range", F.lit(0))
    firsts = keys.groupBy("range").agg(F.max(F.struct("id", "tie")).alias("f")).sort("range").collect()  # one row a range
    lend = [(firsts[i - 1].f.id, firsts[i - 1].f.tie, r.range) for i, r in enumerate(firsts)]
    lend = F.broadcast(spark.createDataFrame(lend, "_id long, _tie long, to int"))
    own = rows.crossJoin(table).select("id", "tie", "text", place.alias("range")) if size else rows.withColumn("range", F.lit(0))
    lent = rows.join(lend, F.expr("id <=> _id AND tie = _tie")).dropDuplicates(["to"]).select("id", "tie", "text", F.col("to").alias("range"))
    both = own.withColumn("own", F.lit(True)).unionByName(lent.withColumn("own", F.lit(False)))
    both = both.repartition("range").sortWithinPartitions(F.col("range"), F.col("own").desc(), F.col("id").desc_nulls_last(), F.col("tie").desc())
    out = both.select("id", "text", "own").mapInArrow(_edit(k, width), _sql("id"))
    return out.withColumnRenamed("id", id_col)


def _sql(id_col: str) -> str:
    return f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
