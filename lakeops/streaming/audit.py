"""The audit log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.operators.audit import parse_audit_lines

WATERMARK = "10 minutes"


def stream_audit(
    spark: SparkSession, path: str, max_files: int = 1000, watermark: str = WATERMARK
) -> DataFrame:
    """The typed audit table of a folder of JSON-line files, as a stream."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return typed_audit(lines, watermark)


def stream_audit_topic(
    spark: SparkSession, servers: str, topic: str, watermark: str = WATERMARK
) -> DataFrame:
    """The same from a topic; needs the Kafka package of Spark on the class path."""
    records = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    return typed_audit(records.select(F.col("value").cast("string").alias("value")), watermark)


def typed_audit(lines: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return parse_audit_lines(lines).withWatermark("ts", watermark)


def topic_records(events: DataFrame) -> DataFrame:
    """Events with their JSON ``line`` as topic records keyed by user."""
    return events.select(F.col("user").alias("key"), F.col("line").alias("value"))


def write_audit_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Start appending events to a folder with one partition per day."""
    writer = (
        events.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .partitionBy("day")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
