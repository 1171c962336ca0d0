"""Audit files: plain or gzip JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeops.operators.audit import parse_audit_lines


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The typed audit table of a folder of ``.log`` and ``.log.gz`` files."""
    return parse_audit_lines(spark.read.text(path))
