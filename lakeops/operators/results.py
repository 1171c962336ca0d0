"""Bounding, shaping and exporting query results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows kept for a screen, and the bound of an export that asks for one.
INTERACTIVE_ROWS = 1000
EXPORT_ROWS = 100_000


def bounded(df: DataFrame, max_rows: int = INTERACTIVE_ROWS) -> DataFrame:
    """The first ``max_rows`` rows with the column labels in order."""
    if max_rows <= 0:
        raise ValueError("max_rows must be positive")
    return df.limit(max_rows)


def sql_rows(spark: SparkSession, sql: str, max_rows: int = INTERACTIVE_ROWS) -> DataFrame:
    """Run SQL text; a statement without a result yields one ``message`` row."""
    result = spark.sql(sql)
    if not result.columns:
        return spark.sql("SELECT 'OK' AS message")
    return bounded(result, max_rows)


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, labels in order and nulls kept.

    A label that occurs twice keeps its first position and its last value.
    """
    labels = df.columns
    positional = df.toDF(*[f"_{i}" for i in range(len(labels))])
    last = {label: i for i, label in enumerate(labels)}
    fields = [F.col(f"_{last[label]}").alias(label) for label in dict.fromkeys(labels)]
    return positional.select(
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("row_json")
    )


def export_cells(df: DataFrame) -> DataFrame:
    """Typed export cells: numbers as double, booleans kept, everything else as text."""

    def cell(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.NumericType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        elif not isinstance(field.dataType, T.BooleanType):
            column = column.cast("string")
        return column.alias(field.name)

    return df.select(*[cell(field) for field in df.schema.fields])


def export(df: DataFrame, path: str, format: str = "csv", max_rows: int | None = None) -> None:
    """Write the typed rows to a file set; CSV files carry a header. ``max_rows`` bounds them, for
    instance to ``EXPORT_ROWS``; by default all are written."""
    rows = df if max_rows is None else bounded(df, max_rows)
    writer = export_cells(rows).write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
