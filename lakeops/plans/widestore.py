"""Queries of the versioned wide-column store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.cells import display_key, is_binary
from lakeops.operators import widestore as ws
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables, micros_text
from lakeops.plans.registry import query
from lakeops.session import scratch_path

_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
_LIVE = f"SELECT row_key, col AS \"column\", value, {_TS} AS ts FROM v_latest"


def _shown(live: DataFrame, *more: str) -> DataFrame:
    return ws.display_cells(live).select(
        "row_key", "column", "value", micros_text("ts").alias("ts"), *more
    )


def _key_text() -> Column:
    return display_key(F.col("row_key")).alias("row_key")


@query(_LIVE)
def latest_cells(t: Tables) -> DataFrame:
    return _shown(ws.latest_cells(v.cells(t)))


@query(
    f"{_LIVE} WHERE row_key IN (SELECT DISTINCT row_key FROM v_latest WHERE row_key >= 'u00000007' "
    "AND col IN ('cf:click', 'cf:signup') ORDER BY row_key LIMIT 50) AND col IN ('cf:click', 'cf:signup')"
)
def scan_from_key(t: Tables) -> DataFrame:
    rows = ws.scan(v.cells(t), start="u00000007", limit=50, columns=["cf:click", "cf:signup"])
    return _shown(rows)


@query(
    f"{_LIVE} WHERE row_key IN (SELECT DISTINCT row_key FROM v_latest WHERE row_key > 'u00000003' "
    "ORDER BY row_key LIMIT 1000)"
)
def scan_after_key(t: Tables) -> DataFrame:
    rows = ws.scan(
        v.cells(t), start="u00000003", start_inclusive=False, prefix="u", limit=1000, columns=["cf"]
    )
    return _shown(rows)


@query(
    f"{_LIVE} WHERE row_key IN (SELECT row_key FROM v_latest WHERE col = 'cf:purchase' AND value >= '3')"
)
def rows_with_column_value(t: Tables) -> DataFrame:
    rows = ws.select_rows(v.cells(t), predicates=[ws.ColumnValue("cf:purchase", ">=", "3")])
    return _shown(rows)


@query(
    f"{_LIVE} WHERE value = (SELECT min(value) FROM v_latest) AND row_key NOT IN "
    "(SELECT row_key FROM v_latest WHERE col = 'cf:signup' AND NOT value <> '1.00')"
)
def cells_with_value(t: Tables) -> DataFrame:
    cells = v.cells(t)
    least = ws.latest_cells(cells).agg(F.min("value")).first()[0]
    predicates = [
        ws.ColumnValue("cf:signup", "!=", "1.00", keep_missing=True),
        ws.ValueEquals(bytes(least)),
    ]
    return _shown(ws.select_rows(cells, predicates=predicates))


@query(
    "WITH k AS (SELECT DISTINCT row_key FROM v_latest WHERE row_key > 'u00000004'), "
    "p AS (SELECT row_key FROM k ORDER BY row_key LIMIT 25) "
    f"SELECT row_key, col AS \"column\", value, {_TS} AS ts, (SELECT count(*) FROM k) > 25 AS has_next, "
    "CASE WHEN (SELECT count(*) FROM k) > 25 THEN (SELECT max(row_key) FROM p) END AS next_cursor "
    "FROM v_latest WHERE row_key IN (SELECT row_key FROM p)"
)
def row_page(t: Tables) -> DataFrame:
    page = ws.page(v.cells(t), cursor=b"u00000004", size=25)
    cursor = display_key(F.lit(page.next_cursor).cast("binary"))
    return _shown(page.rows).withColumns(
        {"has_next": F.lit(page.has_next), "next_cursor": cursor}
    )


@query(
    f"{_LIVE} WHERE row_key IN (SELECT DISTINCT row_key FROM v_latest WHERE starts_with(row_key, 'u0000000') "
    "ORDER BY row_key LIMIT 50)"
)
def row_search(t: Tables) -> DataFrame:
    return _shown(ws.search_rows(v.cells(t), " u0000000* "))


@query("SELECT DISTINCT row_key FROM v_latest WHERE starts_with(row_key, 'u000000') ORDER BY row_key LIMIT 20")
def row_autocomplete(t: Tables) -> DataFrame:
    return ws.autocomplete(v.cells(t), "u000000").select(_key_text())


@query(
    f"{_LIVE} WHERE row_key IN (SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') FROM customer)"
)
def rows_by_key(t: Tables) -> DataFrame:
    key = F.encode(v.padded("u", "c_custkey", 8), "UTF-8").alias("row_key")
    return _shown(ws.get_rows(v.cells(t), t["customer"].select(key)))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY row_key, col ORDER BY ts DESC, seq DESC) AS n, "
    "bool_or(deleted) OVER (PARTITION BY row_key, col ORDER BY ts DESC, seq DESC) AS cut FROM v_cells) "
    f"SELECT row_key, col AS \"column\", CAST(n AS INTEGER) AS version, {_TS} AS ts, value "
    "FROM r WHERE n <= 10 AND NOT cut"
)
def cell_versions(t: Tables) -> DataFrame:
    return ws.cell_versions(v.cells(t), n=10).select(
        _key_text(), "column", "version", micros_text("ts").alias("ts"), F.decode("value", "UTF-8").alias("value")
    )


@query(
    "WITH a AS (SELECT row_key, col, ts, seq, value, deleted FROM v_cells UNION ALL "
    "SELECT 'u' || lpad(CAST(c_custkey AS VARCHAR), 8, '0'), 'cf:segment', TIMESTAMP '2025-01-01', c_custkey, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END, false FROM customer) "
    f"SELECT row_key, col AS \"column\", value, {_TS} AS ts FROM ("
    "SELECT *, row_number() OVER (PARTITION BY row_key, col ORDER BY ts DESC, seq DESC) AS n FROM a) "
    "WHERE n = 1 AND NOT deleted"
)
def rows_after_put(t: Tables) -> DataFrame:
    updates = t["customer"].select(
        F.encode(v.padded("u", "c_custkey", 8), "UTF-8").alias("row_key"),
        F.lit("cf:segment").alias("column"),
        F.lit("2025-01-01").cast("timestamp").alias("ts"),
        F.col("c_custkey").alias("seq"),
        F.encode(F.nullif("c_mktsegment", F.lit("BUILDING")), "UTF-8").alias("value"),
    )
    return _shown(ws.latest_cells(ws.put_rows(v.cells(t), updates)))


_DOOMED = "SELECT 'u' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') FROM supplier WHERE s_acctbal < 5000"


def _doomed(t: Tables) -> DataFrame:
    return (
        t["supplier"]
        .where(F.col("s_acctbal") < 5000)
        .select(
            F.encode(v.padded("u", "s_suppkey", 8), "UTF-8").alias("row_key"),
            F.lit("2025-01-01").cast("timestamp").alias("ts"),
            F.col("s_suppkey").alias("seq"),
        )
    )


@query(f"{_LIVE} WHERE row_key NOT IN ({_DOOMED})")
def rows_after_row_delete(t: Tables) -> DataFrame:
    cells = v.cells(t)
    return _shown(ws.latest_cells(ws.delete_rows(cells, _doomed(t))))


@query(f"{_LIVE} WHERE NOT (col = 'cf:view' AND row_key IN ({_DOOMED}))")
def rows_after_cell_delete(t: Tables) -> DataFrame:
    keys = _doomed(t).withColumn("column", F.lit("cf:view"))
    return _shown(ws.latest_cells(ws.delete_cells(v.cells(t), keys)))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY row_key, col ORDER BY ts DESC, seq DESC) AS n, "
    "CASE WHEN col IN ('cf:click', 'cf:view') THEN 3 WHEN col = 'cf:purchase' THEN 5 END AS most, "
    "CASE WHEN col IN ('cf:click', 'cf:view') THEN 1 WHEN col = 'cf:error' THEN 2 ELSE 0 END AS least, "
    "CASE WHEN col IN ('cf:click', 'cf:view', 'cf:error') THEN CAST(864000 AS BIGINT) END AS ttl FROM v_cells) "
    "SELECT row_key, col AS \"column\", seq FROM r WHERE (most IS NULL OR n <= most) AND (ttl IS NULL "
    "OR epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) <= ttl * 1000000 OR n <= least)"
)
def retained_cells(t: Tables) -> DataFrame:
    # One family per column here, so that the limits differ.
    family = F.replace("column", F.lit("cf:"), F.lit(""))
    cells = v.cells(t).withColumn("column", F.concat(family, F.lit(":v")))
    families = t.spark.createDataFrame(
        [
            ("click", 3, 1, 864000),
            ("view", 3, 1, 864000),
            ("purchase", 5, None, None),
            ("error", None, 2, 864000),
        ],
        "family string, max_versions int, min_versions int, ttl_seconds long",
    )
    kept = ws.apply_retention(cells, families, "2024-01-31")
    column = F.concat(F.lit("cf:"), F.substring_index("column", ":", 1))
    return kept.select(_key_text(), column.alias("column"), "seq")


def _bulk_rows(t: Tables) -> DataFrame:
    return t["customer"].select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("row"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"\nline 2')).alias("cf:name"),
        F.when(F.col("c_nationkey") != 7, F.col("c_nationkey").cast("string")).alias("cf:nation"),
        F.lit("").alias("cf:none"),
    )


@query(
    "SELECT 'c' || c_custkey AS row_key, 'cf:name' AS \"column\", "
    "c_name || ', \"' || c_mktsegment || '\"' || chr(10) || 'line 2' AS value FROM customer UNION ALL "
    "SELECT 'c' || c_custkey, 'cf:nation', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey <> 7"
)
def bulk_loaded_cells(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "bulk")
    _bulk_rows(t).write.options(header=True, quote='"', escape='"').csv(path)
    live = ws.latest_cells(ws.bulk_load(t.spark, path, "2025-01-01"))
    return ws.display_cells(live).select("row_key", "column", "value")


@query(
    "SELECT 'c' || c_custkey AS row_key, count(*) AS cells, CAST(sum(length(c_name)) AS BIGINT) AS name_chars FROM ("
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, '' FROM customer WHERE c_nationkey <> 7) GROUP BY 1"
)
def bulk_loaded_large_file(t: Tables) -> DataFrame:
    # One file, which is cut into records by blocks whatever its size.
    path = scratch_path(t.spark, "bulk")
    _bulk_rows(t).coalesce(1).write.options(header=True, quote='"', escape='"').csv(path)
    cells = ws.bulk_load(t.spark, path, "2025-01-01", large_file=0)
    name = F.when(F.col("column") == "cf:name", F.length(F.substring_index(F.col("value").cast("string"), ", ", 1))).otherwise(0)
    found = cells.groupBy(F.col("row_key").cast("string").alias("row_key"))
    return found.agg(F.count(F.lit(1)).alias("cells"), F.sum(name).alias("name_chars"))


@query("SELECT CAST(count(*) AS BIGINT) AS rows_written FROM customer")
def bulk_rows_written(t: Tables) -> DataFrame:
    return ws.rows_written(_bulk_rows(t))


_GRID = ["cf:click", "cf:error", "cf:purchase"]
_GRID_SQL = ", ".join(
    f"coalesce(max(CASE WHEN col = '{c}' THEN value END), '') AS \"{c}\"" for c in _GRID
)


@query(
    f"SELECT row_key, {_GRID_SQL}, 3 AS columns_shown, 5 AS columns_total FROM v_latest GROUP BY row_key"
)
def cell_grid(t: Tables) -> DataFrame:
    return ws.to_grid(ws.latest_cells(v.cells(t)), max_columns=3)


@query(
    "SELECT doc_id, text AS shown, false AS \"binary\" FROM documents "
    "WHERE NOT regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') UNION ALL "
    "SELECT doc_id, to_base64(encode(text)), true FROM documents "
    "WHERE regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') UNION ALL "
    "SELECT -1 - doc_id, to_base64('\\x00\\xFF'::BLOB || encode(text)), true FROM documents"
)
def decoded_values(t: Tables) -> DataFrame:
    from lakeops.functions.cells import decoded_text

    raw = t["documents"].select("doc_id", F.encode("text", "UTF-8").alias("value"))
    marked = raw.select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.concat(F.lit(b"\x00\xff"), "value").alias("value")
    )
    return raw.unionByName(marked).select(
        "doc_id",
        decoded_text(F.col("value")).alias("shown"),
        is_binary(F.col("value")).alias("binary"),
    )


@query(
    "SELECT part_key, string_agg(shown, '' ORDER BY i) AS shown FROM ("
    "SELECT p_partkey AS part_key, i, CASE WHEN hex BETWEEN '20' AND '7E' AND hex <> '5C' "
    "THEN chr(('0x' || hex)::INTEGER) ELSE '\\x' || hex END AS shown FROM ("
    "SELECT p_partkey, i, substr(h, CAST(i * 2 + 1 AS BIGINT), 2) AS hex FROM ("
    "SELECT p_partkey, hex(encode(chr(0) || p_name || '\\' || chr(233) || chr(127) || p_type)) AS h FROM part) x, "
    "(SELECT unnest(range(200)) AS i) n WHERE i * 2 < length(h))) GROUP BY part_key"
)
def display_keys(t: Tables) -> DataFrame:
    key = F.concat(F.lit("\x00"), "p_name", F.lit("\\é\x7f"), "p_type")
    return t["part"].select(
        F.col("p_partkey").alias("part_key"), display_key(F.encode(key, "UTF-8")).alias("shown")
    )


@query(
    "SELECT 'r' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS row_key, 'cf:a' AS \"column\", "
    "'value-' || o_orderkey AS value FROM orders UNION ALL "
    "SELECT 'r' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 'cf:b', 'other-' || o_orderkey FROM orders"
)
def generated_row_cells(t: Tables) -> DataFrame:
    ids = t["orders"].select(F.col("o_orderkey").alias("id"))
    return ws.display_cells(ws.row_table_cells(ids)).select("row_key", "column", "value")


@query(
    "SELECT 'wide' AS row_key, 'cf:c' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS \"column\", "
    "'v' || c_custkey AS value FROM customer"
)
def generated_wide_cells(t: Tables) -> DataFrame:
    ids = t["customer"].select(F.col("c_custkey").alias("id"))
    return ws.display_cells(ws.wide_row_cells(ids)).select("row_key", "column", "value")


@query(
    "SELECT 'gen_tiny_' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS \"table\", 'r0' AS row_key, "
    "'cf:a' AS \"column\", 'seed' AS value FROM supplier"
)
def generated_tiny_cells(t: Tables) -> DataFrame:
    cells = ws.tiny_table_cells(t["supplier"].select(F.col("s_suppkey").alias("id")))
    return cells.select(
        "table", _key_text(), "column", F.decode("value", "UTF-8").alias("value")
    )


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring')")
def filtered_table_names(t: Tables) -> DataFrame:
    names = t["part"].select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return ws.table_filter(names, " RING ")
