"""Intermediate tables in the folder that every executor can reach.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
(tests, a notebook on one machine) a local temporary folder takes its place.
A written table cuts the lineage: a lost executor costs a re-read, never a
recomputation of everything before it. What was shuffled for it is deleted as soon
as it is written; else shuffle files of all tables would lie on disk until the
driver happens to collect garbage.

Who deletes them: settle() writes a result and deletes what was kept on the way to
it, so an operator that ends with settle() leaves one table, its result, which is
its caller's: drop() deletes it once it has been read.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
#: Spark's setting that a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of tables kept since the innermost settle() began.
_kept: ContextVar[list[str] | None] = ContextVar("kept", default=None)


def folder(spark: SparkSession) -> str:
    base = spark.conf.get(SETTING, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rostrum-")
        spark.conf.set(SETTING, base)
    return base.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, to: str, codec: str) -> None:
    """Write df; its shuffle files go with the end of the write. df's own later runs, if any, would shuffle anew."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(to)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df once and return it as read back; later uses don't compute it again."""
    spark = df.sparkSession
    to = path(spark, name)
    _write(df, to, codec)
    if (held := _kept.get()) is not None:
        held.append(to)
    return spark.read.schema(df.schema).parquet(to)


def settle(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written; every table that make() kept is deleted after that, or when it fails."""
    mark = _kept.set([])
    try:
        out = make()
        to = path(spark, name)
        _write(out, to, "zstd")
    finally:
        held = _kept.get()
        _kept.reset(mark)
        for x in held:
            _delete(spark, x)
    if (above := _kept.get()) is not None:
        above.append(to)
    return spark.read.schema(out.schema).parquet(to)


def drop(df: DataFrame) -> None:
    """Delete what keep() or settle() wrote, once nothing reads it any more; touches nothing outside the folder."""
    spark = df.sparkSession
    base = folder(spark).split(":", 1)[-1].lstrip("/")
    for top in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{base}/" in top.replace("///", "/").replace("//", "/"):
            _delete(spark, top)


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
