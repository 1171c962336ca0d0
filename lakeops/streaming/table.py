"""Run a stream over the input there is and read what it wrote."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from lakeops.session import scratch_path

# What streams with state of several kinds or with timers need; it keeps state on disk.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back."""
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into files in the shared folder and return them as a table."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    with state_store(spark):
        query = (
            stream.writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True)
            .start(f"{base}/rows")
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
