"""Queries of the query history and the session counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import history as h
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables
from lakeops.plans.registry import query

_ENTRY = ["user", "engine", "id", "statement", "started_at", "completed_at", "state", "error"]
_SQL_ENTRY = ", ".join(f'"{c}"' for c in _ENTRY)


def _compact(t: Tables) -> DataFrame:
    return h.compact_consecutive(v.runs(t))


@query(
    f"SELECT \"user\", engine, id, statement, started_at, "
    "CASE WHEN completed_at > started_at THEN completed_at ELSE 0 END AS completed_at, "
    "CASE WHEN completed_at > started_at THEN state ELSE 'RUNNING' END AS state, "
    "CASE WHEN completed_at > started_at THEN error ELSE '' END AS error, execution_count, "
    "CASE WHEN completed_at > started_at AND state = 'FINISHED' "
    "THEN CASE WHEN job_id IS NULL THEN 1 ELSE 2 END ELSE 0 END AS log_lines FROM v_runs"
)
def folded_runs(t: Tables) -> DataFrame:
    folded = h.fold_runs(v.query_log(t))
    return folded.select(*_ENTRY, "execution_count", F.size("logs").alias("log_lines"))


@query(f"SELECT {_SQL_ENTRY}, execution_count FROM v_compact")
def compacted_runs(t: Tables) -> DataFrame:
    return _compact(t).select(*_ENTRY, "execution_count")


@query(f"SELECT {_SQL_ENTRY}, execution_count FROM v_compact")
def compacted_runs_of_busy_users(t: Tables) -> DataFrame:
    """The same with the runs cut into many slices, so that most users lie in several."""
    return h.compact_consecutive(v.runs(t), slices=64).select(*_ENTRY, "execution_count")


def _capped(n: int, key: str) -> str:
    return (
        f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY started_at DESC, id DESC) AS n, "
        f"first_value(execution_count) OVER (PARTITION BY {key} ORDER BY started_at DESC, id DESC) AS top "
        f"FROM v_compact) SELECT {_SQL_ENTRY}, execution_count FROM r "
        f"WHERE n <= {n} - CASE WHEN top > 1 THEN 1 ELSE 0 END"
    )


@query(_capped(100, '"user", engine'))
def capped_history(t: Tables) -> DataFrame:
    return h.cap_history(_compact(t)).select(*_ENTRY, "execution_count")


@query(_capped(20, '"user", engine'))
def capped_operations(t: Tables) -> DataFrame:
    return h.cap_operations(_compact(t), h.OWNER).select(*_ENTRY, "execution_count")


@query(f"SELECT {_SQL_ENTRY} FROM v_runs WHERE \"user\" = 'user_3' AND engine = 'kyuubi'")
def history_of_user(t: Tables) -> DataFrame:
    return h.history_for(v.runs(t), "user_3", "kyuubi").select(*_ENTRY)


@query(f"SELECT {_SQL_ENTRY} FROM v_runs WHERE engine = 'trino'")
def history_of_all_users(t: Tables) -> DataFrame:
    return h.history_all_users(v.runs(t), "trino").select(*_ENTRY)


def _asked(t: Tables) -> DataFrame:
    return t["orders"].select(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")).alias("id"))


@query(
    "SELECT id, statement FROM v_runs WHERE id IN (SELECT 'q' || o_orderkey FROM orders)"
)
def looked_up_statements(t: Tables) -> DataFrame:
    return h.statement_lookup(v.runs(t), _asked(t))


@query(
    "SELECT DISTINCT 'q' || o_orderkey AS id FROM orders WHERE 'q' || o_orderkey NOT IN (SELECT id FROM v_runs)"
)
def unknown_statement_ids(t: Tables) -> DataFrame:
    return h.unknown_ids(v.runs(t), _asked(t))


_COUNTERS = ", ".join(
    f"CAST(coalesce(sum(execution_count) FILTER (WHERE replace(upper(state), '_STATE', '') IN ({states})), 0) "
    f"AS BIGINT) AS {name}"
    for name, states in {
        "pending": "'PENDING'",
        "running": "'RUNNING'",
        "finished": "'FINISHED'",
        "failed": "'ERROR', 'CANCELED'",
    }.items()
)
_SESSION_SQL = (
    f"SELECT session, {_COUNTERS}, CAST(sum(execution_count) AS BIGINT) AS executions "
    "FROM v_operations GROUP BY session"
)


@query(_SESSION_SQL)
def session_counters(t: Tables) -> DataFrame:
    return h.session_counters(v.operations(t))


@query(
    f"WITH c AS ({_SESSION_SQL}) SELECT session, engine_id, coalesce(opened_at, 0) AS opened_at, "
    "greatest(coalesce(total_operations, 0), coalesce(executions, 0)) AS total, coalesce(pending, 0) AS pending, "
    "coalesce(running, 0) AS running, coalesce(finished, 0) AS finished, coalesce(failed, 0) AS failed "
    "FROM c FULL JOIN v_snapshots USING (session)"
)
def session_totals(t: Tables) -> DataFrame:
    return h.session_totals(v.operations(t), v.snapshots(t))


@query(
    "SELECT session, arg_max(id, (has_rows, started_at, id)) AS id, "
    "arg_max(started_at, (has_rows, started_at, id)) AS started_at, bool_or(has_rows) AS has_rows "
    "FROM v_operations WHERE ok GROUP BY session"
)
def last_result_marker(t: Tables) -> DataFrame:
    return h.last_result_marker(v.operations(t))
