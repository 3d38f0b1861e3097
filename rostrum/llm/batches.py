"""How much text an Arrow batch between Spark and Python holds."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch, about. A batch is several times in memory at once: rows, Arrow buffers on both sides, Python strings.
MOST = 4 << 20


def bound(spark: SparkSession) -> None:
    """From now on this session's batches hold at most MOST bytes, or less if it asked for less."""
    now = spark.conf.get(SETTING, "64m").lower()
    units = {"b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(now.rstrip("bkmg")) * units[now.lstrip("-0123456789")[:1] or "b"]
    if not 0 < size <= MOST:
        spark.conf.set(SETTING, str(MOST))
