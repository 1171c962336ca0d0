"""The deterministic lakehouse data set and its managed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The cities in the order in which ids cycle through them.
CITIES = ("Moscow", "SPb", "Kazan", "Novosibirsk", "Yekaterinburg")
# The tables, children first.
TABLES = ("order_items", "orders", "customers", "temporal_values", "interop_anomaly_values")

# Ending of the names under which tables are written before they replace the old ones.
STAGED = "__staged"

# The typed boundary rows. The last field of row 5 differs between the variants.
BOUNDARY_SCHEMA = (
    "id int, string_col string, event_date date, event_timestamp timestamp, "
    "int_value int, decimal_value decimal(20,6), double_value double"
)
BOUNDARY_ROWS = (
    (1, "year-1500", "1500-01-01", "1500-01-01 00:00:00", -2147483648, "-12345678901234.123456", -1.5),
    (2, "julian-last", "1582-10-04", "1582-10-04 12:34:56.123456", -1, "-0.000001", -0.0),
    (3, "gregorian-first", "1582-10-15", "1582-10-15 23:59:59.999999", 0, "0.000000", 0.0),
    (4, "year-1899", "1899-12-31", "1899-12-31 00:00:00", 1, "9999999999999.999999", 1.25),
    (5, None, "1900-01-01", "1900-01-01 00:00:00", 2147483647, "1.230000", 1.0e-12),
    (6, "modern", "2026-08-20", "2026-08-20 10:20:30.654321", 42, "42.420000", 3.141592653589793),
)


def _ids(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1)


def customers_of(ids: DataFrame) -> DataFrame:
    """Customer rows for a frame with a long ``id`` column."""
    cities = F.array(*[F.lit(city) for city in CITIES])
    return ids.select(
        F.col("id").alias("customer_id"),
        F.concat(F.lit("customer_"), F.col("id").cast("string")).alias("name"),
        F.element_at(cities, (F.col("id") % len(CITIES)).cast("int") + 1).alias("city"),
    )


def orders_of(ids: DataFrame, n_customers: int = 100) -> DataFrame:
    """Order rows for a frame with a long ``id`` column."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 365).cast("int"))
    return ids.select(
        F.col("id").alias("order_id"),
        (F.col("id") % n_customers + 1).alias("customer_id"),
        (F.lit(10) + F.col("id") * 7 % 990).cast("decimal(10,2)").alias("amount"),
        day.cast("timestamp").alias("order_timestamp"),
        ((F.col("id") % 5).cast("int") + 1).alias("priority"),
        (F.col("id") % 25 / 100.0).alias("discount_rate"),
        day.alias("order_date"),
    )


def order_items_of(ids: DataFrame, n_orders: int = 1000) -> DataFrame:
    """Order item rows for a frame with a long ``id`` column."""
    return ids.select(
        F.col("id").alias("item_id"),
        (F.col("id") % n_orders + 1).alias("order_id"),
        F.concat(F.lit("product_"), (F.col("id") % 20).cast("string")).alias("product"),
        ((F.col("id") % 5).cast("int") + 1).alias("qty"),
        (F.lit(5) + F.col("id") * 3 % 195).cast("decimal(10,2)").alias("price"),
    )


def customers(spark: SparkSession, n: int = 100) -> DataFrame:
    return customers_of(_ids(spark, n))


def orders(spark: SparkSession, n_orders: int = 1000, n_customers: int = 100) -> DataFrame:
    return orders_of(_ids(spark, n_orders), n_customers)


def order_items(spark: SparkSession, n_items: int = 5000, n_orders: int = 1000) -> DataFrame:
    return order_items_of(_ids(spark, n_items), n_orders)


def temporal_values(spark: SparkSession) -> DataFrame:
    """One row with the first instant and day of 1900."""
    return spark.sql(
        "SELECT TIMESTAMP'1900-01-01 00:00:00' AS event_timestamp, DATE'1900-01-01' AS event_date"
    )


def interop_values(spark: SparkSession, variant: str = "generated") -> DataFrame:
    """Six typed boundary rows: ``generated`` for the table, ``canonical`` for verification."""
    if variant not in ("generated", "canonical"):
        raise ValueError(f"unknown variant {variant!r}")
    rows = [
        row[:6] + (-0.0,) if variant == "generated" and row[0] == 5 else row
        for row in BOUNDARY_ROWS
    ]
    raw = spark.createDataFrame(
        rows,
        "id int, string_col string, event_date string, event_timestamp string, "
        "int_value int, decimal_value string, double_value double",
    )
    typed = [part.strip().split(" ", 1) for part in BOUNDARY_SCHEMA.replace("(20,6)", "@").split(",")]
    return raw.select(*[F.col(n).cast(t.replace("@", "(20,6)")).alias(n) for n, t in typed])


def write_lakehouse(
    spark: SparkSession,
    schema: str,
    sizes: tuple[int, int, int] = (100, 1000, 5000),
    mode: str = "generate",
) -> None:
    """Write the five tables anew, or drop them (children first) with ``mode='clean'``.

    All tables are written under staged names first. Only when every one is there do they take the
    place of the old ones, so a write that fails leaves the old tables as they were, and a table is
    missing no longer than its rename takes. Staged tables of an earlier failure are removed.
    """
    if mode not in ("generate", "clean"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "clean":
        for table in TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{table}")
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{table}{STAGED}")
        return
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    n_customers, n_orders, n_items = sizes
    frames = {
        "customers": customers(spark, n_customers),
        "orders": orders(spark, n_orders, n_customers),
        "order_items": order_items(spark, n_items, n_orders),
        "temporal_values": temporal_values(spark),
        "interop_anomaly_values": interop_values(spark),
    }
    try:
        for table, frame in frames.items():
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{table}{STAGED}")
            frame.write.format("parquet").saveAsTable(f"{schema}.{table}{STAGED}")
    except Exception:
        for table in frames:
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{table}{STAGED}")
        raise
    for table in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS {schema}.{table}")
        spark.sql(f"ALTER TABLE {schema}.{table}{STAGED} RENAME TO {schema}.{table}")


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` for each named frame."""
    counts = [
        frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, frame in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def assert_row_count(df: DataFrame, expected: int) -> DataFrame:
    """One row ``(expected, actual)``; running it fails unless the counts agree."""
    actual = df.agg(F.count(F.lit(1)).alias("actual"))
    message = F.format_string(f"expected {expected} rows, got %d", F.col("actual"))
    checked = F.when(F.col("actual") == expected, F.col("actual")).otherwise(
        F.raise_error(message).cast("long")
    )
    return actual.select(F.lit(expected).cast("long").alias("expected"), checked.alias("actual"))
