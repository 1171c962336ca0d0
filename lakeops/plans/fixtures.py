"""Views over the given tables that feed the registered queries, in Spark and in SQL.

Each view is defined twice: a function here and a line of ``VIEW_SQL`` for the SQL check.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.session import use_utc


class Tables:
    """The given tables of one scale."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        use_utc(spark)
        self.spark, self.sf_dir = spark, str(sf_dir).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def micros_text(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def millis(ts: Column | str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(ts.cast("timestamp"))


def padded(prefix: str, number: Column | str, width: int) -> Column:
    """``prefix`` and the number with leading zeros, as ``%0<width>d`` would print it."""
    digits = (F.col(number) if isinstance(number, str) else number).cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def _by_type(values: dict[str, str], default: str) -> Column:
    picked = F.lit(default)
    for event_type, value in values.items():
        picked = F.when(F.col("event_type") == event_type, value).otherwise(picked)
    return picked


def _sql_by_type(values: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items())
    return f"CASE event_type {whens} ELSE '{default}' END"


VIEW_SQL: dict[str, str] = {}


# ------------------------------------------------------------------ lakehouse


def customers(t: Tables) -> DataFrame:
    nation = t["nation"].select("n_nationkey", F.col("n_name").alias("city"))
    customer = t["customer"].select("c_custkey", "c_name", "c_nationkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), "city"
    )


VIEW_SQL["v_customers"] = (
    "SELECT c_custkey AS customer_id, c_name AS name, n_name AS city "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey"
)


def orders(t: Tables) -> DataFrame:
    return t["orders"].select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").alias("order_timestamp"),
    )


VIEW_SQL["v_orders"] = (
    "SELECT o_orderkey AS order_id, o_custkey AS customer_id, "
    "CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS order_timestamp FROM orders"
)


def order_items(t: Tables) -> DataFrame:
    part = t["part"].select(
        "p_partkey",
        F.col("p_name").alias("product"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
    )
    line = t["lineitem"].select("l_orderkey", "l_partkey", "l_quantity")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_id"),
        "product",
        F.col("l_quantity").cast("int").alias("qty"),
        "price",
    )


VIEW_SQL["v_items"] = (
    "SELECT l_orderkey AS order_id, p_name AS product, CAST(l_quantity AS INTEGER) AS qty, "
    "CAST(p_retailprice AS DECIMAL(18,2)) AS price "
    "FROM lineitem JOIN part ON l_partkey = p_partkey"
)


# ------------------------------------------------------------------ verification


def boundary(t: Tables) -> DataFrame:
    """Orders in the shape of the typed boundary table."""
    day = F.col("o_orderdate").cast("timestamp")
    moment = F.timestamp_micros(F.unix_micros(day) + F.col("o_orderkey") % 1_000_000)
    return t["orders"].select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("string_col"),
        day.cast("date").alias("event_date"),
        moment.alias("event_timestamp"),
        F.col("o_custkey").cast("int").alias("int_value"),
        F.col("o_totalprice").cast("decimal(20,6)").alias("decimal_value"),
        (F.col("o_totalprice") / 7).alias("double_value"),
    )


VIEW_SQL["v_boundary"] = (
    "SELECT o_orderkey AS id, "
    "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS string_col, "
    "CAST(o_orderdate AS DATE) AS event_date, "
    "o_orderdate + to_microseconds(o_orderkey % 1000000) AS event_timestamp, "
    "CAST(o_custkey AS INTEGER) AS int_value, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(20,6)) AS decimal_value, "
    "o_totalprice / 7 AS double_value FROM orders"
)


def boundary_copy(t: Tables) -> DataFrame:
    """A second reading of ``boundary`` with faults of every kind, timestamps in ISO text."""
    rows = boundary(t)
    key = F.col("id")
    iso = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    later = F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'999Z'")

    def every(n: int) -> Column:
        return key % n == 0

    changed = rows.where(~every(97)).select(
        F.when(every(101), key + 1_000_000_000).otherwise(key).alias("id"),
        F.when(every(53), "changed").otherwise(F.col("string_col")).alias("string_col"),
        F.when(every(59), F.date_add("event_date", 1)).otherwise(F.col("event_date")).alias("event_date"),
        F.when(every(61), later).otherwise(iso).alias("event_timestamp"),
        F.when(every(67), F.col("int_value") + 1).otherwise(F.col("int_value")).alias("int_value"),
        F.when(every(71), F.lit(None)).otherwise(F.col("decimal_value")).alias("decimal_value"),
        F.when(every(73), F.col("double_value") * 1.000001)
        .otherwise(F.col("double_value") * 1.0000000000001)
        .alias("double_value"),
    )
    return changed


VIEW_SQL["v_boundary_copy"] = (
    "SELECT CASE WHEN id % 101 = 0 THEN id + 1000000000 ELSE id END AS id, "
    "CASE WHEN id % 53 = 0 THEN 'changed' ELSE string_col END AS string_col, "
    "CASE WHEN id % 59 = 0 THEN CAST(event_date + INTERVAL 1 DAY AS DATE) ELSE event_date END AS event_date, "
    "CASE WHEN id % 61 = 0 THEN substr(strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f'), 1, 23) || '999' "
    "ELSE strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') END AS event_timestamp, "
    "CASE WHEN id % 67 = 0 THEN int_value + 1 ELSE int_value END AS int_value, "
    "CASE WHEN id % 71 = 0 THEN NULL ELSE decimal_value END AS decimal_value, "
    "CASE WHEN id % 73 = 0 THEN double_value * CAST(1.000001 AS DOUBLE) "
    "ELSE double_value * CAST(1.0000000000001 AS DOUBLE) END AS double_value "
    "FROM v_boundary WHERE id % 97 <> 0"
)


# ------------------------------------------------------------------ cells


def cells(t: Tables) -> DataFrame:
    deleted = (F.col("event_type") == "signup") & (F.col("value") < 20)
    return t["events"].select(
        F.encode(padded("u", "user_id", 8), "UTF-8").alias("row_key"),
        F.concat(F.lit("cf:"), "event_type").alias("column"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.encode(F.col("value").cast("decimal(18,2)").cast("string"), "UTF-8").alias("value"),
        deleted.alias("deleted"),
    )


VIEW_SQL["v_cells"] = (
    "SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS row_key, 'cf:' || event_type AS col, "
    "ts, event_id AS seq, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, "
    "event_type = 'signup' AND value < 20 AS deleted FROM events"
)
VIEW_SQL["v_latest"] = (
    "SELECT row_key, col, ts, seq, value FROM (SELECT *, row_number() OVER "
    "(PARTITION BY row_key, col ORDER BY ts DESC, seq DESC) AS rn FROM v_cells) "
    "WHERE rn = 1 AND NOT deleted"
)


# ------------------------------------------------------------------ history


def runs(t: Tables) -> DataFrame:
    n = F.col("event_id")
    statement = (
        F.when(n % 3 == 0, F.concat(F.lit("SELECT "), "event_type"))
        .when(n % 3 == 1, F.concat(F.lit("  SELECT   "), "event_type"))
        .otherwise(F.concat(F.lit("SELECT\t"), "event_type", F.lit(" ")))
    )
    job = F.concat(
        F.lit("Submitting job 'SELECT 1' ("), F.md5(n.cast("string").cast("binary")), F.lit(").")
    )
    error = F.col("value") >= 200
    started = millis("ts")
    return t["events"].select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("user"),
        F.when(n % 2 == 0, "kyuubi").otherwise("trino").alias("engine"),
        F.concat(F.lit("q"), n.cast("string")).alias("id"),
        statement.alias("statement"),
        started.alias("started_at"),
        (started + F.floor("value").cast("long")).alias("completed_at"),
        F.when(error, "ERROR").otherwise("FINISHED").alias("state"),
        F.when(error, F.concat(F.lit("boom "), "event_type")).otherwise("").alias("error"),
        F.lit(1).cast("long").alias("execution_count"),
        F.when(n % 7 == 0, F.array(F.lit("started"), job))
        .otherwise(F.array(F.lit("started")))
        .alias("logs"),
    )


VIEW_SQL["v_runs"] = (
    "SELECT 'user_' || user_id AS \"user\", "
    "CASE WHEN event_id % 2 = 0 THEN 'kyuubi' ELSE 'trino' END AS engine, 'q' || event_id AS id, "
    "CASE event_id % 3 WHEN 0 THEN 'SELECT ' || event_type "
    "WHEN 1 THEN '  SELECT   ' || event_type ELSE 'SELECT' || chr(9) || event_type || ' ' END "
    "AS statement, epoch_us(ts) // 1000 AS started_at, epoch_us(ts) // 1000 + CAST(floor(value) AS BIGINT) AS completed_at, "
    "CASE WHEN value >= 200 THEN 'ERROR' ELSE 'FINISHED' END AS state, "
    "CASE WHEN value >= 200 THEN 'boom ' || event_type ELSE '' END AS error, "
    "CAST(1 AS BIGINT) AS execution_count, "
    "CASE WHEN event_id % 7 = 0 THEN md5(CAST(event_id AS VARCHAR)) END AS job_id, "
    "'SELECT ' || event_type AS normal FROM events"
)
# Islands of equal neighbouring statements, numbered per user and engine in time order.
VIEW_SQL["v_islands"] = (
    'SELECT *, sum(fresh) OVER (PARTITION BY "user", engine ORDER BY started_at, id) AS island FROM ('
    'SELECT *, CASE WHEN lag(normal) OVER (PARTITION BY "user", engine ORDER BY started_at, id) = normal '
    "THEN 0 ELSE 1 END AS fresh FROM v_runs)"
)
VIEW_SQL["v_compact"] = (
    'SELECT "user", engine, arg_max(id, (started_at, id)) AS id, '
    "arg_max(statement, (started_at, id)) AS statement, max(started_at) AS started_at, "
    "arg_max(completed_at, (started_at, id)) AS completed_at, "
    "arg_max(state, (started_at, id)) AS state, arg_max(error, (started_at, id)) AS error, "
    "CAST(count(*) AS BIGINT) AS execution_count "
    'FROM v_islands GROUP BY "user", engine, island'
)


def query_log(t: Tables, all_end: bool = False) -> DataFrame:
    """Start and end events of the runs; runs of less than one millisecond end only if asked to."""
    r = runs(t)
    kinds = F.array(
        F.lit("start"), F.when(F.col("state") == "ERROR", "fail").otherwise("finish")
    )
    events = r.withColumn("kind", F.explode(kinds))
    start = F.col("kind") == "start"
    if not all_end:
        events = events.where(start | (F.col("completed_at") > F.col("started_at")))
    return events.select(
        "user",
        "engine",
        "id",
        "statement",
        F.when(start, F.col("started_at")).otherwise(F.col("completed_at")).alias("event_time"),
        F.when(start, 0).otherwise(1).cast("long").alias("seq"),
        "kind",
        F.when(F.col("kind") == "fail", F.col("error")).alias("error"),
        F.when(start, F.array().cast("array<string>")).otherwise(F.col("logs")).alias("logs"),
    )


_OPERATION_STATES = {
    "click": "FINISHED_STATE",
    "view": "running_state",
    "purchase": "PENDING_STATE",
    "error": "ERROR_STATE",
}


def operations(t: Tables) -> DataFrame:
    return t["events"].select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"),
        F.concat(F.lit("op"), F.col("event_id").cast("string")).alias("id"),
        _by_type(_OPERATION_STATES, "Canceled_State").alias("state"),
        (F.col("event_id") % 3 + 1).alias("execution_count"),
        millis("ts").alias("started_at"),
        (F.col("event_type") != "error").alias("ok"),
        (F.col("value") >= 25).alias("has_rows"),
    )


VIEW_SQL["v_operations"] = (
    "SELECT 's' || user_id AS session, 'op' || event_id AS id, "
    f"{_sql_by_type(_OPERATION_STATES, 'Canceled_State')} AS state, "
    "event_id % 3 + 1 AS execution_count, epoch_us(ts) // 1000 AS started_at, event_type <> 'error' AS ok, "
    "value >= 25 AS has_rows FROM events"
)


def snapshots(t: Tables) -> DataFrame:
    return (
        t["customer"]
        .where(F.col("c_mktsegment") != "BUILDING")
        .select(
            F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("session"),
            F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("engine_id"),
            (F.col("c_custkey") * 1000).alias("opened_at"),
            F.floor(F.abs("c_acctbal") / 50).cast("long").alias("total_operations"),
        )
    )


VIEW_SQL["v_snapshots"] = (
    "SELECT 's' || c_custkey AS session, 'e' || c_nationkey AS engine_id, "
    "c_custkey * 1000 AS opened_at, CAST(floor(abs(c_acctbal) / 50) AS BIGINT) AS total_operations "
    "FROM customer WHERE c_mktsegment <> 'BUILDING'"
)


# ------------------------------------------------------------------ jobs


def applications(t: Tables) -> DataFrame:
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
    took = F.floor("o_totalprice").cast("long")
    done = F.col("o_orderstatus") == "F"

    def text(at: Column) -> Column:
        return F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'.000GMT'")

    return t["orders"].select(
        padded("app-", "o_orderkey", 10).alias("id"),
        F.concat(F.lit("Job "), "o_orderpriority").alias("name"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("user"),
        text(seconds).alias("start_time"),
        F.when(done, text(seconds + F.floor(took / 1000))).otherwise("").alias("end_time"),
        F.when(done, took).otherwise(F.lit(0)).alias("duration_ms"),
        done.alias("completed"),
        F.lit("4.1").alias("version"),
    )


VIEW_SQL["v_applications"] = (
    "SELECT 'app-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id, "
    "'Job ' || o_orderpriority AS name, 'c' || o_custkey AS \"user\", "
    "strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%S.000GMT') AS start_time, "
    "CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate + to_seconds(o_orderkey % 86400 "
    "+ CAST(floor(floor(o_totalprice) / 1000) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.000GMT') ELSE '' END AS end_time, "
    "CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END AS duration_ms, "
    "o_orderstatus = 'F' AS completed, '4.1' AS version FROM orders"
)


def sessions(t: Tables) -> DataFrame:
    """Engine sessions for the live list: one per customer, some of them failed."""
    failed = F.col("c_mktsegment") == "MACHINERY"
    return t["customer"].select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("user"),
        F.when(failed, "FAILED").otherwise("READY").alias("state"),
        (F.lit(1_700_000_000_000) + F.col("c_custkey") * 1234).alias("created_at"),
    )


VIEW_SQL["v_live"] = (
    "SELECT 'kyuubi-' || c_custkey AS id, c_name AS name, 'c' || c_custkey AS \"user\", "
    "CASE WHEN (c_custkey * 1234) % 1000 = 0 "
    "THEN strftime(make_timestamp((1700000000000 + c_custkey * 1234) * 1000), '%Y-%m-%dT%H:%M:%SZ') "
    "ELSE strftime(make_timestamp((1700000000000 + c_custkey * 1234) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END "
    "AS start_time, '' AS end_time, "
    "greatest(CAST(0 AS BIGINT), 1700000500000 - (1700000000000 + c_custkey * 1234)) AS duration_ms, "
    "false AS completed, 'Kyuubi engine' AS version FROM customer WHERE c_mktsegment <> 'MACHINERY'"
)
LIVE_NOW = 1_700_000_500_000


# ------------------------------------------------------------------ security


def attempts(t: Tables) -> DataFrame:
    number = F.col("user_id").cast("string")
    return t["events"].select(
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("User"), number))
        .when(F.col("event_id") % 3 == 1, F.concat(F.lit(" user"), number, F.lit(" ")))
        .otherwise(F.concat(F.lit("USER"), number))
        .alias("username"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") == "signup").alias("success"),
    )


VIEW_SQL["v_attempts"] = (
    "SELECT 'user' || user_id AS \"user\", epoch_us(ts) AS us, event_id AS seq, "
    "event_type = 'signup' AS success, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n "
    "FROM events"
)


def requests(t: Tables) -> DataFrame:
    number = F.col("user_id").cast("string")
    return t["events"].select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), number)).alias("user"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        F.concat(F.lit("/api/"), "event_type").alias("path"),
        F.when(F.col("value") >= 100, 500)
        .when(F.col("value") >= 50, 403)
        .otherwise(200)
        .alias("status"),
    )


VIEW_SQL["v_requests"] = (
    "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS \"timestamp\", "
    "CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id ELSE 'anonymous' END AS \"user\", "
    "CASE WHEN event_type = 'view' THEN 'GET' ELSE 'POST' END AS method, '/api/' || event_type AS path, "
    "CASE WHEN value >= 100 THEN 500 WHEN value >= 50 THEN 403 ELSE 200 END AS status, "
    "ts, event_id, event_type FROM events"
)


# ------------------------------------------------------------------ policies


def inventory(t: Tables) -> DataFrame:
    """One table per customer, in a schema of about a hundred customers of one nation."""
    places = (
        t["nation"]
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "n_name", "r_name")
    )
    bucket = F.floor(F.col("c_custkey") / 100).cast("string")
    return (
        t["customer"]
        .select("c_custkey", "c_nationkey")
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("catalog"),
            F.concat(F.lower("n_name"), F.lit("_"), bucket).alias("schema"),
            F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("table"),
            F.col("c_custkey").alias("_key"),
        )
    )


VIEW_SQL["v_inventory"] = (
    "SELECT lower(replace(r_name, ' ', '_')) AS catalog, "
    "lower(n_name) || '_' || (c_custkey // 100) AS schema, 't' || c_custkey AS \"table\", c_custkey AS k "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
)


def _grant(scope: Column, kind: str, privilege: str, condition: str, pos: int) -> Column:
    return F.struct(
        scope.alias("resource"),
        F.lit(kind).alias("resource_type"),
        F.lit(pos).alias("pos"),
        F.lit(privilege).alias("privilege"),
        F.lit(condition).alias("condition"),
    )


# What the role of each customer holds, by customer key modulo five: scope, privilege, condition
# and place within the scope. The last two lines belong to the auditor of each nation's region.
_ROLE_SHAPES = {
    0: [("CATALOG", "USE_CATALOG", "ALLOW", 0), ("SCHEMA", "USE_SCHEMA", "allow", 0),
        ("SCHEMA", "SELECT_TABLE", "ALLOW", 1)],
    1: [("CATALOG", "USE_CATALOG", "ALLOW", 0), ("SCHEMA", "USE_SCHEMA", "ALLOW", 0),
        ("TABLE", "SELECT_TABLE", "ALLOW", 0)],
    2: [("TABLE", "SELECT_TABLE", "ALLOW", 0), ("TABLE", "USE_SCHEMA", "ALLOW", 1),
        ("TABLE", "USE_CATALOG", "ALLOW", 2)],
    3: [("SCHEMA", "USE_CATALOG", "ALLOW", 0), ("SCHEMA", "USE_SCHEMA", "ALLOW", 1),
        ("SCHEMA", "SELECT_TABLE", "DENY", 2)],
    4: [("CATALOG", "USE_CATALOG", "ALLOW", 0)],
}
_AUDITOR = [("CATALOG", "USE_CATALOG", "ALLOW", 0), ("CATALOG", "USE_SCHEMA", "ALLOW", 1),
            ("CATALOG", "SELECT_TABLE", "ALLOW", 2)]


def _scope(kind: str) -> Column:
    parts = {"CATALOG": 1, "SCHEMA": 2, "TABLE": 3}[kind]
    return F.concat_ws(".", *["catalog", "schema", "table"][:parts])


def role_privileges(t: Tables) -> DataFrame:
    held = F.array().cast(
        "array<struct<resource string, resource_type string, pos int, privilege string, condition string>>"
    )
    for shape, lines in _ROLE_SHAPES.items():
        grants = F.array(*[_grant(_scope(k), k, p, c, pos) for k, p, c, pos in lines])
        held = F.when(F.col("_key") % 5 == shape, grants).otherwise(held)
    own = inventory(t).select(
        F.concat(F.lit("role_"), F.col("_key").cast("string")).alias("role"),
        F.explode(held).alias("_g"),
    )
    regions = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    catalog = F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))
    auditors = regions.select(
        F.concat(F.lit("auditor_"), F.col("n_nationkey").cast("string")).alias("role"),
        F.explode(F.array(*[_grant(catalog, k, p, c, pos) for k, p, c, pos in _AUDITOR])).alias("_g"),
    )
    return own.unionByName(auditors).select("role", "_g.*")


def _sql_privileges() -> str:
    scopes = {
        "CATALOG": "catalog",
        "SCHEMA": "catalog || '.' || schema",
        "TABLE": "catalog || '.' || schema || '.' || \"table\"",
    }
    parts = [
        f"SELECT 'role_' || k AS role, {scopes[kind]} AS resource, '{kind}' AS resource_type, "
        f"{pos} AS pos, '{privilege}' AS privilege, '{condition}' AS condition "
        f"FROM v_inventory WHERE k % 5 = {shape}"
        for shape, lines in _ROLE_SHAPES.items()
        for kind, privilege, condition, pos in lines
    ]
    parts += [
        f"SELECT 'auditor_' || n_nationkey, lower(replace(r_name, ' ', '_')), '{kind}', {pos}, "
        f"'{privilege}', '{condition}' FROM nation JOIN region ON n_regionkey = r_regionkey"
        for kind, privilege, condition, pos in _AUDITOR
    ]
    return " UNION ALL ".join(parts)


VIEW_SQL["v_privileges"] = _sql_privileges()


def user_roles(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    own = t["customer"].select(
        F.concat(F.lit("user_"), F.floor(key / 3).cast("string")).alias("user"),
        F.concat(F.lit("role_"), key.cast("string")).alias("role"),
    )
    name = F.concat(F.lit("auditor_"), F.col("n_nationkey").cast("string"))
    return own.unionByName(t["nation"].select(name.alias("user"), name.alias("role")))


VIEW_SQL["v_user_roles"] = (
    "SELECT 'user_' || (c_custkey // 3) AS \"user\", 'role_' || c_custkey AS role FROM customer "
    "UNION ALL SELECT 'auditor_' || n_nationkey, 'auditor_' || n_nationkey FROM nation"
)

_OPERATIONS = {"click": "grant", "view": "REVOKE", "purchase": "Grant", "error": "revoke"}
_PRIVILEGE_CYCLE = (
    "USE_CATALOG", "USE_SCHEMA", "SELECT_TABLE", "INSERT_TABLE", "UPDATE_TABLE", "DELETE_TABLE",
    "ALTER_TABLE", "CREATE_TABLE", "DROP_TABLE", "OWN_TABLE", " ",
)


def mutations(t: Tables) -> DataFrame:
    """Changes to the roles and members of ``role_privileges``, some of them invalid."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    cycle = F.array(*[F.lit(p) for p in _PRIVILEGE_CYCLE])
    events = t["events"].select("event_id", "ts", "user_id", "event_type", "value")
    known = inventory(t).select("_key", "catalog", "schema", "table")
    joined = events.join(known, F.col("user_id") == F.col("_key"), "left")
    return joined.select(
        (n + 1).alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("admin"), (n % 3).cast("string")).alias("user"),
        F.lit("catalog").alias("tool"),
        _by_type(_OPERATIONS, "drop").alias("operation"),
        F.when(n % 13 != 0, F.concat(F.lit("role_"), user)).otherwise(" ").alias("role"),
        F.when(n % 4 == 0, F.concat(F.lit("user:user_"), user))
        .when(n % 4 == 3, F.lit("nobody"))
        .otherwise(F.concat(F.lit("role:role_"), user))
        .alias("subject"),
        F.when(n % 2 == 0, F.concat_ws(".", "catalog", "schema")).otherwise(F.col("catalog")).alias("resource"),
        F.get(cycle, (n % len(_PRIVILEGE_CYCLE)).cast("int")).alias("privilege"),
        (F.col("value") < 150).alias("backend_ok"),
    )


_sql_cycle = ", ".join(f"'{p}'" for p in _PRIVILEGE_CYCLE)
VIEW_SQL["v_mutations"] = (
    "SELECT event_id + 1 AS seq, ts, 'admin' || (event_id % 3) AS \"user\", 'catalog' AS tool, "
    f"{_sql_by_type(_OPERATIONS, 'drop')} AS operation, "
    "CASE WHEN event_id % 13 <> 0 THEN 'role_' || user_id ELSE ' ' END AS role, "
    "CASE event_id % 4 WHEN 0 THEN 'user:user_' || user_id WHEN 3 THEN 'nobody' "
    "ELSE 'role:role_' || user_id END AS subject, "
    "CASE WHEN event_id % 2 = 0 THEN concat_ws('.', catalog, schema) ELSE catalog END AS resource, "
    f"[{_sql_cycle}][event_id % {len(_PRIVILEGE_CYCLE)} + 1] AS privilege, value < 150 AS backend_ok "
    "FROM events LEFT JOIN v_inventory ON user_id = k"
)
VIEW_SQL["v_verdicts"] = (
    "SELECT *, CASE WHEN lower(operation) NOT IN ('grant', 'revoke') OR trim(role) = '' "
    "OR trim(subject) = '' OR trim(coalesce(resource, '')) = '' OR trim(privilege) = '' "
    "OR privilege = 'OWN_TABLE' THEN 'a field is missing, or operation or privilege is unknown' "
    "WHEN NOT (starts_with(subject, 'user:') OR starts_with(subject, 'role:')) "
    "THEN 'subject is neither a user nor a role' ELSE '' END AS reason FROM v_mutations"
)


# ------------------------------------------------------------------ reports and files

_SEVERITIES = ("CRITICAL", "high", "Medium", "MODERATE", "low", "INFO", "", "weird", "INFORMATIONAL")


def scan_rows(t: Tables) -> DataFrame:
    """Raw findings as a scanner reports them: mixed case, blanks and nulls."""
    key = F.col("p_partkey")
    names = F.array(*[F.lit(s) for s in _SEVERITIES])
    number = key.cast("string")
    return t["part"].select(
        key.alias("_key"),
        F.concat(F.lit("CVE-"), number).alias("cve"),
        F.get(names, F.col("p_size") % 9).alias("severity"),
        F.col("p_name").alias("package"),
        F.col("p_brand").alias("version"),
        F.when(key % 3 != 0, F.col("p_type")).alias("fixed"),
        F.when(key % 4 != 0, F.concat("p_name", F.lit(" title"))).alias("title"),
        F.when(key % 8 != 0, F.repeat(F.concat("p_name", F.lit(" | a\n")), 12)).alias("description"),
        F.when(key % 5 != 0, F.concat(F.lit("https://scan.test/"), number)).alias("url"),
    )


_sql_severities = ", ".join(f"'{s}'" for s in _SEVERITIES)
VIEW_SQL["v_scan"] = (
    "SELECT p_partkey AS k, 'CVE-' || p_partkey AS cve, "
    f"[{_sql_severities}][p_size % 9 + 1] AS severity, p_name AS package, p_brand AS version, "
    "CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS fixed, "
    "CASE WHEN p_partkey % 4 <> 0 THEN p_name || ' title' END AS title, "
    "CASE WHEN p_partkey % 8 <> 0 THEN repeat(p_name || ' | a' || chr(10), 12) END AS description, "
    "CASE WHEN p_partkey % 5 <> 0 THEN 'https://scan.test/' || p_partkey END AS url FROM part"
)


def findings(t: Tables) -> DataFrame:
    """Findings in the shape the report operators take."""
    severity = F.upper(F.when(F.col("severity") == "", "UNKNOWN").otherwise(F.col("severity")))
    return scan_rows(t).select(
        "cve",
        severity.alias("severity"),
        "package",
        "version",
        F.coalesce("fixed", F.lit("—")).alias("fixed"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


VIEW_SQL["v_findings"] = (
    "SELECT cve, upper(CASE WHEN severity = '' THEN 'UNKNOWN' ELSE severity END) AS severity, package, version, "
    "coalesce(fixed, '—') AS fixed, coalesce(description, '') AS description, coalesce(url, '') AS url "
    "FROM v_scan"
)
SQL_RANK = (
    "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'MODERATE' THEN 2 "
    "WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 WHEN 'INFORMATIONAL' THEN 4 WHEN 'UNKNOWN' THEN 5 "
    "WHEN '' THEN 5 ELSE 9 END"
)


def site_files(t: Tables) -> DataFrame:
    """Pages as files below one folder per host."""
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1)
    return t["pages"].select(
        F.concat(F.lit("/site/"), host, path).alias("path"),
        F.octet_length("html").cast("long").alias("size"),
    )


VIEW_SQL["v_files"] = (
    "SELECT '/site/' || regexp_extract(url, '^[a-z]+://([^/]+)', 1) || "
    "regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path, "
    "CAST(strlen(html) AS BIGINT) AS size FROM pages"
)

_DEPENDS = {
    "v_boundary_copy": ["v_boundary"],
    "v_latest": ["v_cells"],
    "v_islands": ["v_runs"],
    "v_compact": ["v_islands"],
    "v_privileges": ["v_inventory"],
    "v_mutations": ["v_inventory"],
    "v_verdicts": ["v_mutations"],
    "v_findings": ["v_scan"],
}


def with_views(sql: str) -> str:
    """Put the views a query names, and those they need, in front of it."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in _DEPENDS.get(name, []):
            need(other)
        if name not in needed:
            needed.append(name)

    for name in VIEW_SQL:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not needed:
        return sql
    head = ", ".join(f"{name} AS ({VIEW_SQL[name]})" for name in needed)
    if sql.lstrip().upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[len('WITH RECURSIVE '):]}"
    if sql.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {sql.lstrip()[len('WITH '):]}"
    return f"WITH {head} {sql}"
