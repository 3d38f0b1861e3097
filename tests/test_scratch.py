"""What lies on disk once a table is written."""

from __future__ import annotations

from pyspark.sql import functions as F

from rostrum.plans import scratch


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffle_files_go_with_the_write(spark):
    setting = spark.conf.get(scratch.CLEANUP, None)
    made = lambda: spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("l"))
    df = made()
    kept = scratch.keep(df, "kept")
    settled = scratch.settle(spark, lambda: made().repartition("k"), "settled")
    assert kept.count() == settled.count() == df.count() == 7
    assert spark.conf.get(scratch.CLEANUP, None) == setting
    mark = _shuffle_files(spark)
    scratch.drop(scratch.keep(made(), "last"))
    assert _shuffle_files(spark) <= mark
