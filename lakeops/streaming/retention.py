"""An audit folder that a stream fills and that keeps its newest days only."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.audit import KEEP_DAYS

# The partition column that tells micro-batches apart.
BATCH = "batch"


def _folder(spark: SparkSession, path: str):
    """A folder and its file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def held_days(spark: SparkSession, path: str) -> dict[datetime.date, str]:
    """The days of a folder and where each lies; read from the names of its partitions."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return {}
    found = {}
    for entry in files.listStatus(folder):
        column, _, day = entry.getPath().getName().partition("=")
        if column == "day" and day[:1].isdigit():
            found[datetime.date.fromisoformat(day)] = entry.getPath().toString()
    return found


def _drop_days(spark: SparkSession, places: list[str]) -> None:
    for place in places:
        folder, files = _folder(spark, place)
        files.delete(folder, True)


def retained_writer(
    path: str, days: int = KEEP_DAYS, max_bytes: int | None = None, line: str = "line"
) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` calls to keep a folder like ``roll_audit`` keeps a table.

    A micro-batch writes one partition per day and batch number and replaces just those, so a batch
    that is played again after a failure adds nothing. Then the days that are more than ``days``
    back from the newest one leave the folder, and, if ``max_bytes`` is given, the oldest whole days that
    do not fit it; the newest day always stays. Events of days that are already expired, or without a
    day, are not written. What comes to the driver is a line per day held.
    """
    if days < 1:
        raise ValueError("at least one day has to be kept")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            held = held_days(spark, path)
            newest = batch.agg(F.max("day")).first()[0]
            newest = max([day for day in (newest, *held) if day is not None], default=None)
            if newest is None:
                return
            first = newest - datetime.timedelta(days=days - 1)
            kept = batch.where(F.col("day") >= F.lit(first)).withColumn(BATCH, F.lit(number).cast("long"))
            writer = kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("day", BATCH).parquet(path)
        finally:
            batch.unpersist()
        _drop_days(spark, [place for day, place in held.items() if day < first])
        if max_bytes is not None:
            # At most ``days`` lines.
            sizes = spark.read.parquet(path).groupBy("day").agg(F.sum(F.octet_length(line) + 1).alias("bytes"))
            sizes, held, total = dict(sizes.collect()), held_days(spark, path), 0
            over = []
            for day in sorted(held, reverse=True):
                total += sizes.get(day) or 0
                if total > max_bytes and day != newest:
                    over.append(held[day])
            _drop_days(spark, over)

    return write


def retain_audit_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    days: int = KEEP_DAYS,
    max_bytes: int | None = None,
    line: str = "line",
    available_now: bool = False,
):
    """Start writing events (with a ``day``) to a folder that keeps its newest days."""
    writer = (
        events.writeStream.foreachBatch(retained_writer(path, days, max_bytes, line))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_retained(spark: SparkSession, path: str) -> DataFrame:
    """The events of such a folder."""
    return spark.read.parquet(path).drop(BATCH)
