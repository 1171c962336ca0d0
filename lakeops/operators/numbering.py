"""Consecutive numbers over a total order without one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeops.session import scratch_root


def number_rows(
    df: DataFrame, order: list[Column], name: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """Adds the 1-based place of every row in ``order``, which should be a total order.

    The rows are cut into sorted ranges and written to the shared folder, so that the ranges stay
    the same; every range numbers its own rows, and the rows before it are added. Only the range
    sizes come together in one task, a line per range.
    """
    spark = df.sparkSession
    scratch_root(spark)
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id that Spark gives the rows of a sorted range holds the range and the place in it.
    placed = (
        df.repartitionByRange(ranges, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
    )
    in_range, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_range", in_range)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(name, (place + F.col("_offset") + 1).cast("long"))
        .drop("_range", "_id", "_offset")
    )
