"""A series of roll-ups that is kept in a folder and brought up to date, input by input.

The folder holds the step sums of each input (a log file, say) under its month and its name.  An input that comes again
takes the place of what it gave before, so that a run may be repeated or overlap another.  Archives are sums over
inputs, consolidated.  Months that no archive reaches back to any more are taken out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import ARCHIVES, STEP, archives, rollup

_PARTS = ("month", "input_key")


def update(folder: str, flows: DataFrame, input_: str = "input_file", time: str = "recv_time") -> None:
    """Puts the step sums of the inputs in ``flows`` into the store, in place of what these inputs gave before.

    An input has to come whole.  Sums are made before anything is moved; each part is replaced by itself, so a run that
    fails half way is simply repeated.
    """
    named = flows.withColumn("input_key", F.md5(F.coalesce(F.col(input_).cast("string"), F.lit(""))))
    steps = rollup(named, time, STEP, ["input_key"]).withColumn("month", F.date_format("bin_start", "yyyy-MM"))
    spread = steps.repartition(*_PARTS)  # a file for each part
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(f"{folder}/steps")


def stored_steps(spark: SparkSession, folder: str) -> DataFrame:
    """bin_start and the sums of each step over all inputs."""
    held = spark.read.option("basePath", f"{folder}/steps").parquet(f"{folder}/steps")
    names = [c for c in held.columns if c not in ("bin_start", *_PARTS)]
    return held.groupBy("bin_start").agg(*[F.sum(c).alias(c) for c in names])


def stored_archives(spark: SparkSession, folder: str, columns: list[str] | None = None, kinds: tuple = ARCHIVES) -> DataFrame:
    """The archives of what the store holds: see :func:`~.series.archives`."""
    return archives(stored_steps(spark, folder), columns, kinds)


def retire(spark: SparkSession, folder: str, kinds: tuple = ARCHIVES) -> list[str]:
    """Takes out the months that end before the oldest point of all archives; gives their names.

    Archives count back from the newest step, so this changes none of them.
    """
    newest = spark.read.parquet(f"{folder}/steps").agg(F.max("bin_start")).first()[0]
    if newest is None:
        return []
    longest = max(per_point * kept for per_point, kept, _ in kinds) * STEP
    oldest = spark.range(1).select(F.date_format(F.timestamp_add("SECOND", F.lit(-longest), F.lit(newest)), "yyyy-MM")).first()[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/steps")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("month=") and name[6:] < oldest:
            files.delete(status.getPath(), True)
            gone.append(name[6:])
    return sorted(gone)
