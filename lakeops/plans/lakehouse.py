"""Queries of the lakehouse data set, its analytics and the scalar expressions."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.functions import text
from lakeops.operators import analytics
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables, millis
from lakeops.plans.registry import query
from lakeops.session import scratch_path
from lakeops.sources import lakehouse

_CITIES = ", ".join(f"'{city}'" for city in lakehouse.CITIES)


@query(
    "WITH k AS (SELECT c_custkey + 1 AS id FROM customer) "
    "SELECT id AS customer_id, 'customer_' || id AS name, "
    f"[{_CITIES}][id % 5 + 1] AS city FROM k"
)
def generated_customers(t: Tables) -> DataFrame:
    ids = t["customer"].select((F.col("c_custkey") + 1).alias("id"))
    return lakehouse.customers_of(ids)


@query(
    "WITH k AS (SELECT o_orderkey + 1 AS id FROM orders) "
    "SELECT id AS order_id, id % 100 + 1 AS customer_id, CAST(10 + (id * 7) % 990 AS DOUBLE) AS amount, "
    "strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d 00:00:00') AS order_timestamp, "
    "CAST(id % 5 + 1 AS INTEGER) AS priority, (id % 25) / 100.0::DOUBLE AS discount_rate, "
    "strftime(DATE '2024-01-01' + CAST(id % 365 AS INTEGER), '%Y-%m-%d') AS order_date FROM k"
)
def generated_orders(t: Tables) -> DataFrame:
    ids = t["orders"].select((F.col("o_orderkey") + 1).alias("id"))
    return lakehouse.orders_of(ids).withColumns(
        {
            "amount": F.col("amount").cast("double"),
            "order_timestamp": F.date_format("order_timestamp", "yyyy-MM-dd HH:mm:ss"),
            "order_date": F.col("order_date").cast("string"),
        }
    )


@query(
    "WITH k AS (SELECT l_orderkey * 10 + l_linenumber AS id FROM lineitem) "
    "SELECT id AS item_id, id % 1000 + 1 AS order_id, 'product_' || (id % 20) AS product, "
    "CAST(id % 5 + 1 AS INTEGER) AS qty, CAST(5 + (id * 3) % 195 AS DOUBLE) AS price FROM k"
)
def generated_order_items(t: Tables) -> DataFrame:
    ids = t["lineitem"].select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    items = lakehouse.order_items_of(ids)
    return items.withColumn("price", F.col("price").cast("double"))


_COUNTED = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", CAST(count(*) AS BIGINT) AS \"rows\" FROM {name}" for name in _COUNTED
    )
)
def table_row_counts(t: Tables) -> DataFrame:
    return lakehouse.table_row_counts({name: t[name] for name in _COUNTED})


_BOUNDARY = ", ".join(f"(DATE '{row[2]}', CAST('{row[5]}' AS DECIMAL(20,6)))" for row in lakehouse.BOUNDARY_ROWS)


@query(
    "WITH c AS (SELECT row_number() OVER () AS id FROM customer), o AS (SELECT row_number() OVER () AS id FROM orders), "
    "i AS (SELECT row_number() OVER () AS id FROM lineitem), w AS ("
    "SELECT 'customers' AS \"table\", CAST(NULL AS DATE) AS d, CAST(id AS DECIMAL(20,6)) AS v FROM c UNION ALL "
    "SELECT 'orders', CAST('2024-01-01' AS DATE) + CAST(id % 365 AS INTEGER), CAST(10 + id * 7 % 990 AS DECIMAL(20,6)) FROM o "
    "UNION ALL SELECT 'order_items', NULL, CAST((id % 5 + 1) * (5 + id * 3 % 195) AS DECIMAL(20,6)) FROM i "
    "UNION ALL SELECT 'temporal_values', DATE '1900-01-01', NULL "
    f"UNION ALL SELECT 'interop_anomaly_values', d, v FROM (VALUES {_BOUNDARY}) b(d, v)) "
    'SELECT "table", count(*) AS "rows", CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, '
    'CAST(CAST(sum(v) AS DECIMAL(30,6)) AS VARCHAR) AS total FROM w GROUP BY 1'
)
def written_lakehouse(t: Tables) -> DataFrame:
    """The five tables, written twice at the size of the given ones and read back."""
    schema = f"lakehouse_{uuid4().hex}"
    sizes = tuple(t[name].count() for name in ("customer", "orders", "lineitem"))
    value = {
        "customers": F.col("customer_id"),
        "orders": F.col("amount"),
        "order_items": F.col("qty") * F.col("price"),
        "temporal_values": F.lit(None),
        "interop_anomaly_values": F.col("decimal_value"),
    }
    day = {"orders": "order_date", "temporal_values": "event_date", "interop_anomaly_values": "event_date"}
    path = scratch_path(t.spark, "lakehouse")
    try:
        lakehouse.write_lakehouse(t.spark, schema, (1, 1, 1))
        lakehouse.write_lakehouse(t.spark, schema, sizes)
        parts = [
            t.spark.table(f"{schema}.{name}").agg(
                F.lit(name).alias("table"),
                F.count(F.lit(1)).alias("rows"),
                F.min(F.col(day[name]) if name in day else F.lit(None)).cast("string").alias("first_day"),
                F.max(F.col(day[name]) if name in day else F.lit(None)).cast("string").alias("last_day"),
                F.sum(value[name].cast("decimal(20,6)")).cast("decimal(30,6)").cast("string").alias("total"),
            )
            for name in lakehouse.TABLES
        ]
        reduce(DataFrame.unionByName, parts).write.parquet(path)
    finally:
        lakehouse.write_lakehouse(t.spark, schema, mode="clean")
        t.spark.sql(f"DROP SCHEMA IF EXISTS {schema}")
    return t.spark.read.parquet(path)


@query(
    "SELECT (SELECT count(*) FROM events) AS expected, (SELECT count(*) FROM v_cells) AS actual"
)
def row_count_gate(t: Tables) -> DataFrame:
    return lakehouse.assert_row_count(v.cells(t), t["events"].count())


@query(
    "WITH per_customer AS (SELECT customer_id, count(DISTINCT order_id) AS n, sum(amount) AS a "
    "FROM v_orders GROUP BY customer_id) "
    "SELECT city, CAST(sum(n) AS BIGINT) AS orders, CAST(round(sum(a), 2) AS DOUBLE) AS total_amount "
    "FROM per_customer JOIN v_customers USING (customer_id) GROUP BY city"
)
def city_orders(t: Tables) -> DataFrame:
    result = analytics.city_orders(v.orders(t), v.customers(t))
    return result.withColumn("total_amount", F.col("total_amount").cast("double"))


@query(
    "SELECT city, CAST(sum(qty) AS BIGINT) AS units, CAST(round(sum(qty * price), 2) AS DOUBLE) AS item_revenue "
    "FROM v_items JOIN v_orders USING (order_id) JOIN v_customers USING (customer_id) GROUP BY city"
)
def city_item_revenue(t: Tables) -> DataFrame:
    result = analytics.city_item_revenue(v.order_items(t), v.orders(t), v.customers(t))
    return result.withColumn("item_revenue", F.col("item_revenue").cast("double"))


@query(
    "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(int_value) AS BIGINT) AS int_sum, "
    "CAST(count(string_col) AS BIGINT) AS non_null_string_count FROM v_boundary "
    "WHERE event_date <= DATE '1997-06-30'"
)
def boundary_aggregate(t: Tables) -> DataFrame:
    return analytics.boundary_aggregate(v.boundary(t), "1997-06-30")


@query(
    "SELECT CAST(count(*) AS BIGINT) AS timestamp_count FROM v_boundary "
    "WHERE event_timestamp >= TIMESTAMP '1997-06-30 00:00:00.004321'"
)
def boundary_timestamp_count(t: Tables) -> DataFrame:
    return analytics.boundary_timestamp_count(v.boundary(t), "1997-06-30 00:00:00.004321")


@query("SELECT CAST(count(*) AS BIGINT) AS row_count FROM nation")
def nation_count(t: Tables) -> DataFrame:
    return analytics.table_count(t["nation"])


@query(
    "SELECT CAST((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) "
    "+ (SELECT count(*) FROM orders) AS BIGINT) AS row_count"
)
def union_count(t: Tables) -> DataFrame:
    parts = [
        t["customer"].select(F.col("c_custkey").alias("value")),
        t["supplier"].select(F.col("s_suppkey").alias("value")),
        t["orders"].select(F.col("o_orderkey").alias("value")),
    ]
    return analytics.count_inline_relation(*parts)


@query(
    "SELECT o_orderkey AS id, o_orderkey + o_custkey AS added, o_orderkey - o_custkey AS taken, "
    "o_orderkey * 7 AS times, (o_orderkey * 6) - 1 AS nested, (o_custkey / 4) + 2 AS divided, "
    "o_orderkey % 3 AS remainder, upper(o_orderpriority) AS upper_text, "
    "concat(o_orderstatus, o_orderpriority) AS joined, "
    "CASE WHEN o_totalprice > 250000 THEN 'yes' ELSE 'no' END AS chosen, "
    "CAST(o_custkey AS VARCHAR) AS as_text, CAST(o_custkey AS INTEGER) AS as_int, CAST(o_orderkey || '0000000000' AS BIGINT) AS as_bigint, epoch_us(CAST(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP)) AS as_timestamp, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS as_decimal, "
    "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS as_date, "
    "CAST(len([o_orderkey, o_custkey, 3]) AS INTEGER) AS array_size, "
    "['a', 'b', 'c', 'd', 'e'][o_orderkey % 5 + 1] AS element, "
    "coalesce(nullif(o_orderstatus, 'P'), 'fallback') AS filled, "
    "CAST(length(o_orderpriority) AS INTEGER) AS chars, power(2.0::DOUBLE, (o_orderkey % 6)::DOUBLE) AS raised, "
    "o_custkey IN (1, 5, 9) AS listed, round(o_custkey / 7, 2) AS rounded, "
    "strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 365 AS INTEGER), '%Y-%m-%d') AS moved, "
    "regexp_replace(trim('  ' || o_orderpriority || '   x '), '\\s+', ' ', 'g') AS tidy FROM orders"
)
def scalar_battery(t: Tables) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    day = F.col("o_orderdate").cast("date")
    letters = F.array(*[F.lit(letter) for letter in "abcde"])
    padded = F.concat(F.lit("  "), "o_orderpriority", F.lit("   x "))
    return t["orders"].select(
        key.alias("id"),
        (key + customer).alias("added"),
        (key - customer).alias("taken"),
        (key * 7).alias("times"),
        ((key * 6) - 1).alias("nested"),
        ((customer / 4) + 2).alias("divided"),
        (key % 3).alias("remainder"),
        F.upper("o_orderpriority").alias("upper_text"),
        F.concat("o_orderstatus", "o_orderpriority").alias("joined"),
        F.when(F.col("o_totalprice") > 250000, "yes").otherwise("no").alias("chosen"),
        customer.cast("string").alias("as_text"),
        customer.cast("int").alias("as_int"),
        F.concat("o_orderkey", F.lit("0000000000")).cast("bigint").alias("as_bigint"),
        F.unix_micros(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").cast("timestamp")).alias("as_timestamp"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("as_decimal"),
        day.cast("string").alias("as_date"),
        F.size(F.array(key, customer, F.lit(3))).alias("array_size"),
        F.element_at(letters, (key % 5).cast("int") + 1).alias("element"),
        F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("fallback")).alias("filled"),
        F.char_length("o_orderpriority").alias("chars"),
        F.power(F.lit(2), key % 6).alias("raised"),
        customer.isin(1, 5, 9).alias("listed"),
        F.round(customer / 7, 2).alias("rounded"),
        F.date_add(day, (key % 365).cast("int")).cast("string").alias("moved"),
        text.normalise_whitespace(padded).alias("tidy"),
    )


def _sql_size(n: str) -> str:
    ladder = [f"WHEN {n} < 1024 THEN {n} || ' B'"]
    for power, unit in enumerate(text.SIZE_UNITS[1:], start=1):
        shown = f"printf('%d.%d {unit}', ({n} * 20 + {1024**power}) // {2 * 1024**power} // 10, "
        shown += f"({n} * 20 + {1024**power}) // {2 * 1024**power} % 10)"
        ladder.append(
            f"ELSE {shown}" if unit == "TB" else f"WHEN {n} < {1024 ** (power + 1)} THEN {shown}"
        )
    return f"CASE {' '.join(ladder)} END"


@query(
    "WITH e AS (SELECT event_id, (event_id * event_id * 7919) AS bytes, epoch_us(ts) // 1000 AS ms, "
    "CAST(floor(value * 50000) AS BIGINT) AS took, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fT') AS iso, "
    "event_type || ' | ' || props || chr(10) || repeat(event_type, CAST(event_id % 40 AS INTEGER)) || ' ' AS note "
    "FROM events) "
    f"SELECT event_id, {_sql_size('bytes')} AS size_text, "
    "CASE WHEN event_id % 10 = 0 THEN '' ELSE strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') END AS date_text, "
    "CASE WHEN took = 0 THEN '' WHEN took // 1000 < 60 THEN (took // 1000) || 's' "
    "WHEN took // 60000 < 60 THEN (took // 60000) || 'm ' || (took // 1000 % 60) || 's' "
    "ELSE (took // 3600000) || 'h ' || (took // 60000 % 60) || 'm' END AS duration_text, "
    "substr(replace(substr(iso, 1, 11), 'T', ' ') || substr(iso, 12), 1, 19) AS start_text, "
    "CASE WHEN length(trim(replace(replace(note, '|', '\\|'), chr(10), ' '))) <= 60 "
    "THEN trim(replace(replace(note, '|', '\\|'), chr(10), ' ')) "
    "ELSE substr(trim(replace(replace(note, '|', '\\|'), chr(10), ' ')), 1, 59) || '…' END AS note_text FROM e"
)
def display_text(t: Tables) -> DataFrame:
    n = F.col("event_id")
    note = F.concat(
        "event_type",
        F.lit(" | "),
        "props",
        F.lit("\n"),
        F.repeat("event_type", (n % 40).cast("int")),
        F.lit(" "),
    )
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'T'")
    return t["events"].select(
        "event_id",
        text.format_size(n * n * 7919).alias("size_text"),
        text.format_date(F.when(n % 10 != 0, millis("ts"))).alias("date_text"),
        text.format_duration(F.floor(F.col("value") * 50000).cast("long")).alias("duration_text"),
        text.format_start(iso).alias("start_text"),
        text.truncate_cell(note, 60).alias("note_text"),
    )
