"""The lakehouse analytics queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def city_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct orders and their total amount per city, largest total first."""
    joined = orders.select("order_id", "customer_id", "amount").join(
        customers.select("customer_id", "city"), "customer_id"
    )
    return (
        joined.groupBy("city")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.round(F.sum("amount"), 2).alias("total_amount"),
        )
        .orderBy(F.desc("total_amount"), "city")
    )


def city_item_revenue(
    order_items: DataFrame, orders: DataFrame, customers: DataFrame
) -> DataFrame:
    """Units and item revenue per city, largest revenue first.

    Items are summed per order and orders per customer before each join, so a join sees one
    row per key on that side however many items one order or one customer has.
    """
    per_order = order_items.groupBy("order_id").agg(
        F.sum("qty").alias("units"), F.sum(F.col("qty") * F.col("price")).alias("revenue")
    )
    per_customer = (
        per_order.join(orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id")
        .agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))
    )
    return (
        per_customer.join(customers.select("customer_id", "city"), "customer_id")
        .groupBy("city")
        .agg(
            F.sum("units").alias("units"),
            F.round(F.sum("revenue"), 2).alias("item_revenue"),
        )
        .orderBy(F.desc("item_revenue"), "city")
    )


def boundary_aggregate(df: DataFrame, cutoff: str = "1900-01-01") -> DataFrame:
    """Rows, integer sum and non-null strings up to and including a date."""
    return df.where(F.col("event_date") <= F.lit(cutoff).cast("date")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("int_value").alias("int_sum"),
        F.count("string_col").alias("non_null_string_count"),
    )


def boundary_timestamp_count(
    df: DataFrame, ts: str = "1582-10-15 23:59:59.999999"
) -> DataFrame:
    """Rows at or after an instant given to the microsecond."""
    bound = F.lit(ts).cast(df.schema["event_timestamp"].dataType)
    return df.where(F.col("event_timestamp") >= bound).agg(
        F.count(F.lit(1)).alias("timestamp_count")
    )


def table_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def count_inline_relation(*parts: DataFrame) -> DataFrame:
    """Number of rows of a ``UNION ALL`` of the parts."""
    return table_count(reduce(DataFrame.unionByName, parts))
