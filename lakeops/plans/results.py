"""Queries of result shaping, export and cross-format verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import reconcile as rec
from lakeops.operators import results
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables
from lakeops.plans.registry import query
from lakeops.session import scratch_path


@query(
    "SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000"
)
def bounded_result(t: Tables) -> DataFrame:
    rows = t["orders"].select(
        F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )
    return results.bounded(rows.orderBy(F.desc("price"), "order_key"))


@query(
    "SELECT l_returnflag AS flag, l_linestatus AS status, CAST(count(*) AS BIGINT) AS items, "
    "CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2"
)
def sql_text_rows(t: Tables) -> DataFrame:
    t["lineitem"].createOrReplaceTempView("lakeops_lineitem")
    return results.sql_rows(
        t.spark,
        "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS items, "
        "sum(CAST(l_quantity AS BIGINT)) AS quantity FROM lakeops_lineitem GROUP BY 1, 2 ORDER BY 1, 2",
    )


@query(
    "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"status\":' || "
    "CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || "
    "',\"key\":' || o_custkey || ',\"priority\":\"' || o_orderpriority || '\"}' AS row_json FROM orders"
)
def result_rows_json(t: Tables) -> DataFrame:
    # The label "key" occurs twice: its place is the first, its value the last.
    return results.rows_as_json(
        t["orders"].select(
            "o_orderkey",
            F.nullif("o_orderstatus", F.lit("P")).alias("status"),
            F.col("o_orderkey").alias("key"),
            "o_orderpriority",
            F.col("o_custkey").alias("key"),
        ).toDF("o_orderkey", "status", "key", "priority", "key")
    )


@query(
    "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_orderstatus = 'F' AS done, o_totalprice, "
    "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS exact, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, "
    "strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders"
)
def export_cells(t: Tables) -> DataFrame:
    return results.export_cells(
        t["orders"].select(
            "o_orderkey",
            (F.col("o_orderstatus") == "F").alias("done"),
            "o_totalprice",
            F.col("o_totalprice").cast("decimal(18,2)").alias("exact"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"),
            F.col("o_orderdate").cast("date").alias("day"),
        )
    )


@query(
    "SELECT CAST(count(*) AS BIGINT) AS \"rows\" FROM orders"
)
def exported_file(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "export")
    rows = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    results.export(rows, path, "csv")
    written = t.spark.read.schema("o_orderkey double, o_orderstatus string, o_totalprice double")
    return written.option("header", True).csv(path).agg(F.count("o_orderkey").alias("rows"))


# ------------------------------------------------------------------ verification


def _writer_rows(t: Tables) -> DataFrame:
    return v.boundary(t).select(F.lit("orders").alias("writer"), "*")


@query(
    "SELECT 'orders' AS writer, id, string_col, CAST(event_date AS VARCHAR) AS event_date, "
    "CASE WHEN id % 1000000 = 0 THEN strftime(event_timestamp, '%Y-%m-%d %H:%M:%S') "
    "ELSE rtrim(strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f'), '0') END AS event_timestamp, int_value, "
    "CAST(decimal_value AS VARCHAR) AS decimal_value, double_value FROM v_boundary"
)
def canonical_text(t: Tables) -> DataFrame:
    return rec.canonical_text(_writer_rows(t))


@query(
    "SELECT id, CASE id % 3 WHEN 2 THEN strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.000000') "
    "ELSE strftime(event_timestamp, '%Y-%m-%d %H:%M:%S.%f') END AS event_timestamp FROM v_boundary"
)
def normalised_timestamps(t: Tables) -> DataFrame:
    ts, key = F.col("event_timestamp"), F.col("id")
    shapes = (
        F.when(key % 3 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(key % 3 == 1, F.concat(v.micros_text(ts), F.lit("000")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
    )
    rows = v.boundary(t).select("id", shapes.alias("event_timestamp"))
    return rec.normalise_timestamps(rows)


_RULES = {k: r for k, r in rec.BOUNDARY_RULES.items() if k != "writer"}
_PAIRED = (
    "SELECT coalesce(e.id, a.id) AS id, e.id IS NULL AS extra, a.id IS NULL AS missing, "
    "e.string_col IS DISTINCT FROM a.string_col AS string_col, "
    "e.event_date IS DISTINCT FROM a.event_date AS event_date, "
    "strftime(e.event_timestamp, '%Y-%m-%d %H:%M:%S.%f') IS DISTINCT FROM a.event_timestamp AS event_timestamp, "
    "e.int_value IS DISTINCT FROM a.int_value AS int_value, "
    "e.decimal_value IS DISTINCT FROM a.decimal_value AS decimal_value, "
    "NOT coalesce(abs(e.double_value - a.double_value) <= greatest("
    "1e-12::DOUBLE * greatest(abs(e.double_value), abs(a.double_value)), 1e-12::DOUBLE), false) AS double_value "
    "FROM v_boundary e FULL JOIN v_boundary_copy a ON e.id = a.id"
)
_FINDINGS = (
    f"WITH p AS ({_PAIRED}), f AS ("
    "SELECT id, '*' AS \"column\", CASE WHEN missing THEN 'missing' ELSE 'extra' END AS reason "
    "FROM p WHERE missing OR extra "
    + " ".join(
        f"UNION ALL SELECT id, '{c}', 'mismatch' FROM p WHERE {c} AND NOT missing AND NOT extra"
        for c in _RULES
    )
    + ") "
)


def _diff(t: Tables) -> DataFrame:
    return rec.reconcile(v.boundary(t), v.boundary_copy(t), ["id"], _RULES)


@query(
    _FINDINGS + "SELECT f.id, \"column\", CASE WHEN \"column\" = 'string_col' THEN e.string_col "
    "WHEN \"column\" = 'int_value' THEN CAST(e.int_value AS VARCHAR) END AS expected, "
    "CASE WHEN \"column\" = 'string_col' THEN a.string_col "
    "WHEN \"column\" = 'int_value' THEN CAST(a.int_value AS VARCHAR) END AS actual, reason "
    "FROM f LEFT JOIN v_boundary e ON f.id = e.id LEFT JOIN v_boundary_copy a ON f.id = a.id"
)
def reconciled_rows(t: Tables) -> DataFrame:
    # Texts of timestamps, decimals and doubles differ between engines; the verdict does not.
    shown = F.col("column").isin("string_col", "int_value")
    return _diff(t).select(
        "id",
        "column",
        F.when(shown, F.col("expected")).alias("expected"),
        F.when(shown, F.col("actual")).alias("actual"),
        "reason",
    )


@query(
    _FINDINGS + "SELECT \"column\", reason, CAST(count(*) AS BIGINT) AS mismatches FROM f GROUP BY 1, 2"
)
def reconcile_summary(t: Tables) -> DataFrame:
    return rec.reconcile_summary(_diff(t))


@query(
    "WITH s AS (SELECT count(*) AS n, count(*) FILTER (early) AS n_early, sum(int_value) FILTER (early) AS total, "
    "count(string_col) FILTER (early) AS strings, count(*) FILTER (event_timestamp >= TIMESTAMP '1582-10-15 23:59:59.999999') AS late "
    "FROM (SELECT *, event_date <= DATE '1900-01-01' AS early FROM (SELECT * REPLACE ("
    "CAST(event_date - INTERVAL 96 YEAR AS DATE) AS event_date) FROM v_boundary))) "
    "SELECT w.f AS writer, r.f AS reader, n AS \"rows\", n_early AS early_rows, CAST(total AS BIGINT) AS early_sum, "
    "strings AS early_strings, late AS late_rows, CAST(0 AS BIGINT) AS mismatches, true AS passed, '' AS detail "
    "FROM (VALUES ('parquet'), ('orc'), ('json'), ('csv')) w(f), "
    "(VALUES ('parquet'), ('orc'), ('json'), ('csv')) r(f), s WHERE w.f <> r.f"
)
def interop_matrix(t: Tables) -> DataFrame:
    # 96 years back, so that the boundary date cuts through the rows.
    rows = v.boundary(t).withColumn("event_date", F.add_months("event_date", -96 * 12))
    found = rec.interop_matrix(t.spark, rows, scratch_path(t.spark, "interop"))
    names = ["early_rows", "early_sum", "early_strings", "late_rows"]
    shape = [F.col("shape")[k].alias(name) for k, name in enumerate(names)]
    return found.select("writer", "reader", "rows", *shape, "mismatches", "passed", "detail")


@query(
    "SELECT 'boundary_aggregate' AS \"check\", count(*) || ',' || sum(o_custkey) || ',' || "
    "count(*) FILTER (WHERE o_orderpriority <> '5-LOW') AS actual, count(*) > 0 AS passed FROM orders "
    "WHERE CAST(o_orderdate AS DATE) <= DATE '1996-01-01' UNION ALL "
    "SELECT 'boundary_timestamp_count', CAST(count(*) AS VARCHAR), true FROM orders"
)
def query_shape_check(t: Tables) -> DataFrame:
    # 96 years back, so that the boundary date cuts through the rows. What is expected comes from
    # the orders themselves, not from the checked functions.
    rows = v.boundary(t).withColumn("event_date", F.add_months("event_date", -96 * 12))
    early = F.col("o_orderdate").cast("date") <= F.lit("1996-01-01").cast("date")
    filled = F.col("o_orderpriority") != "5-LOW"
    expected = t["orders"].agg(
        F.count_if(early), F.sum(F.when(early, F.col("o_custkey"))), F.count_if(early & filled)
    )
    checked = rec.query_shape_check(rows, tuple(expected.first()), t["orders"].count())
    shown = F.array_join(F.transform("actual", lambda n: n.cast("string")), ",")
    return checked.select("check", shown.alias("actual"), "passed")
