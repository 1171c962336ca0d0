"""Queries of the application and job listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import jobs as j
from lakeops.operators.numbering import number_rows
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables
from lakeops.plans.registry import query

_APP = list(j.APPLICATION)
_SQL_APP = ", ".join(f'"{c}"' for c in _APP)
_ISO = (
    "CASE WHEN {ms} % 1000 = 0 THEN strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%SZ') "
    "ELSE strftime(make_timestamp(({ms}) * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END"
)


@query(
    "SELECT id, name, "
    "CASE WHEN name = 'Job 5-LOW' THEN '' ELSE \"user\" END AS \"user\", "
    "CASE WHEN name = 'Job 5-LOW' THEN '' ELSE start_time END AS start_time, "
    "CASE WHEN name = 'Job 5-LOW' THEN '' ELSE end_time END AS end_time, "
    "CASE WHEN name = 'Job 5-LOW' THEN 0 ELSE duration_ms END AS duration_ms, "
    "name <> 'Job 5-LOW' AND completed AS completed, "
    "CASE WHEN name = 'Job 5-LOW' THEN '' ELSE version END AS version FROM v_applications"
)
def flattened_applications(t: Tables) -> DataFrame:
    # Documents as the history source returns them: newest attempt first, some without any.
    newest = F.struct(
        F.col("user").alias("sparkUser"),
        F.col("start_time").alias("startTime"),
        F.col("end_time").alias("endTime"),
        F.col("duration_ms").alias("duration"),
        "completed",
        F.col("version").alias("appSparkVersion"),
    )
    older = F.struct(
        F.lit("older").alias("sparkUser"),
        F.lit("").alias("startTime"),
        F.lit("").alias("endTime"),
        F.lit(1).cast("long").alias("duration"),
        F.lit(True).alias("completed"),
        F.lit("").alias("appSparkVersion"),
    )
    attempts = F.when(F.col("name") != "Job 5-LOW", F.array(newest, older))
    docs = v.applications(t).select(
        F.to_json(F.struct("id", "name", attempts.alias("attempts"))).alias("json")
    )
    return j.flatten_applications(docs)


@query(
    f"SELECT {_SQL_APP} FROM v_applications WHERE start_time >= '1996-01-01' "
    "ORDER BY start_time DESC, id LIMIT 5000"
)
def recent_applications(t: Tables) -> DataFrame:
    return j.recent_applications(v.applications(t), 5000, "1996-01-01")


@query(f"SELECT {_SQL_APP} FROM v_live")
def live_applications(t: Tables) -> DataFrame:
    return j.live_applications(v.sessions(t), v.LIVE_NOW)


@query(
    f"SELECT {_SQL_APP}, 0 AS source_rank FROM v_live WHERE \"user\" = 'c7' UNION ALL "
    f"SELECT {_SQL_APP}, 1 FROM v_applications WHERE \"user\" = 'c7'"
)
def own_applications(t: Tables) -> DataFrame:
    # Another user is asked for, but only administrators may do that.
    live = j.live_applications(v.sessions(t), v.LIVE_NOW)
    return j.visible_applications(live, v.applications(t), "c7", False, "c8")


@query(
    f"SELECT {_SQL_APP}, 0 AS source_rank FROM v_live UNION ALL SELECT {_SQL_APP}, 1 FROM v_applications"
)
def all_applications(t: Tables) -> DataFrame:
    live = j.live_applications(v.sessions(t), v.LIVE_NOW)
    return j.visible_applications(live, v.applications(t), "root", True, " ")


_STATES = ["RUNNING", "CREATED", "RESTARTING", "RECONCILING", "INITIALIZING", "FINISHED", "CANCELED"]
_SQL_STATES = ", ".join(f"'{s}'" for s in _STATES)
_OVERVIEW = (
    "WITH o AS (SELECT event_id, event_type, epoch_us(ts) // 1000 AS ms, "
    "CAST(floor(value) AS BIGINT) AS took, [{states}][event_id % 7 + 1] AS state FROM events) "
).format(states=_SQL_STATES)


def _overview_docs(t: Tables) -> DataFrame:
    """One overview document per event, with a live or ended job, and one unreadable line."""
    ms, took = v.millis("ts"), F.floor("value").cast("long")
    state = F.get(F.array(*[F.lit(s) for s in _STATES]), (F.col("event_id") % 7).cast("int"))
    live = state.isin(*j.LIVE_STATES)
    job = F.struct(
        F.concat(F.lit("j"), F.col("event_id").cast("string")).alias("jid"),
        F.col("event_type").alias("name"),
        state.alias("state"),
        ms.alias("start-time"),
        F.when(live, F.lit(-1)).otherwise(ms + took).alias("end-time"),
        took.alias("duration"),
    )
    docs = t["events"].select(F.to_json(F.struct(F.array(job).alias("jobs"))).alias("json"))
    return docs.unionByName(t["region"].select(F.concat(F.lit("{not json "), "r_name").alias("json")))


def _sql_overview(running: bool) -> str:
    live = "state IN ('RUNNING', 'CREATED', 'RESTARTING', 'RECONCILING', 'INITIALIZING')"
    end = "''" if running else _ISO.format(ms="(ms + took)")
    return (
        f"SELECT 'flink-j' || event_id AS id, event_type AS name, '' AS \"user\", "
        f"{_ISO.format(ms='ms')} AS start_time, {end} AS end_time, took AS duration_ms, "
        f"{str(not running).lower()} AS completed, 'Flink job' AS version "
        f"FROM o WHERE {'' if running else 'NOT '}{live}"
    )


@query(_OVERVIEW + _sql_overview(True))
def running_jobs(t: Tables) -> DataFrame:
    return j.flatten_job_overview(_overview_docs(t), running=True)


@query(_OVERVIEW + _sql_overview(False))
def ended_jobs(t: Tables) -> DataFrame:
    return j.flatten_job_overview(_overview_docs(t), running=False)


_QUERIES = (
    "SELECT CASE WHEN job_id IS NOT NULL THEN 'flink-' || job_id ELSE 'kyuubi-flink-query-' || id END AS id, "
    f"statement AS name, \"user\", {_ISO.format(ms='started_at')} AS start_time, "
    f"{_ISO.format(ms='completed_at')} AS end_time, completed_at - started_at AS duration_ms, "
    "true AS completed, 'Kyuubi Flink SQL query' AS version FROM v_runs"
)


@query(_QUERIES)
def queries_as_jobs(t: Tables) -> DataFrame:
    return j.queries_as_jobs(v.runs(t))


def _job_sources(t: Tables) -> list[DataFrame]:
    """Engines, queries, and the same jobs again as the job server lists them."""
    engines = j.live_applications(v.sessions(t), v.LIVE_NOW)
    queries = j.queries_as_jobs(v.runs(t))
    again = queries.withColumns({"user": F.lit(""), "version": F.lit(j.JOB_LABEL)})
    running = again.where(F.col("duration_ms") < 20).withColumn("completed", F.lit(False))
    renamed = F.replace("id", F.lit("query-q1"), F.lit("other-q1"))
    return [engines, queries, running, again.withColumn("id", renamed)]


@query(
    f"WITH q AS ({_QUERIES}), s AS (SELECT {_SQL_APP}, 0 AS source_rank FROM v_live "
    f"UNION ALL SELECT {_SQL_APP}, 1 FROM q UNION ALL "
    "SELECT id, name, '', start_time, end_time, duration_ms, false, 'Flink job', 2 FROM q WHERE duration_ms < 20 "
    "UNION ALL SELECT replace(id, 'query-q1', 'other-q1'), name, '', start_time, end_time, duration_ms, "
    "completed, 'Flink job', 3 FROM q) "
    f"SELECT {_SQL_APP}, source_rank FROM s "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY source_rank) = 1"
)
def merged_jobs(t: Tables) -> DataFrame:
    return j.merged_jobs(*_job_sources(t), is_admin=True)


@query(f"WITH q AS ({_QUERIES}) SELECT {_SQL_APP}, 1 AS source_rank FROM q WHERE \"user\" = 'user_5'")
def merged_own_jobs(t: Tables) -> DataFrame:
    return j.merged_jobs(*_job_sources(t), is_admin=False, user="user_5")


@query(f"SELECT {_SQL_APP} FROM v_applications WHERE substr(start_time, 1, 10) BETWEEN '1996-02-10' AND '1998-03-01'")
def applications_in_range(t: Tables) -> DataFrame:
    return j.date_range(v.applications(t), "1996-02-10", "1998-03-01")


@query(f"SELECT {_SQL_APP} FROM v_applications WHERE substr(start_time, 1, 10) >= '2001-07-02'")
def applications_of_last_days(t: Tables) -> DataFrame:
    return j.date_range(v.applications(t), last_days=30, today="2001-08-01")


@query(
    f"SELECT {_SQL_APP} FROM v_applications WHERE contains(lower(name || ' ' || id || ' ' || "
    "replace(substr(start_time, 1, 19), 'T', ' ')), 'urgent app-00000')"
)
def searched_applications(t: Tables) -> DataFrame:
    return j.search(v.applications(t), "  Urgent APP-00000 ")


@query(f"SELECT {_SQL_APP} FROM v_applications WHERE NOT completed")
def running_applications(t: Tables) -> DataFrame:
    return j.state_filter(v.applications(t), "running")


@query(
    "SELECT CAST(count(*) FILTER (WHERE NOT completed) AS BIGINT) AS running, "
    "CAST(count(*) FILTER (WHERE completed) AS BIGINT) AS completed FROM v_applications"
)
def application_state_counts(t: Tables) -> DataFrame:
    return j.state_counts(v.applications(t))


@query(
    "SELECT id, duration_ms, row_number() OVER (ORDER BY duration_ms DESC, id) AS place FROM v_applications"
)
def sorted_applications(t: Tables) -> DataFrame:
    apps = v.applications(t).select("id", "duration_ms")
    return number_rows(apps, j.sort_order(apps, "duration_ms", "desc", "id"), "place")


@query(
    f"SELECT {_SQL_APP} FROM v_applications ORDER BY start_time DESC, id LIMIT 100 OFFSET 200"
)
def application_page(t: Tables) -> DataFrame:
    return j.page_of(v.applications(t), page=3, size=100).rows


@query(
    "SELECT 'c' || (event_id % 50) AS \"user\", event_type = 'signup' AS is_admin, "
    "'app-' || lpad(CAST(event_id * 2 AS VARCHAR), 10, '0') AS app_id, "
    "event_type = 'signup' OR coalesce(event_id % 50 = o_custkey, false) AS allowed "
    "FROM events LEFT JOIN orders ON event_id * 2 = o_orderkey"
)
def view_permissions(t: Tables) -> DataFrame:
    asked = t["events"].select(
        F.concat(F.lit("c"), (F.col("event_id") % 50).cast("string")).alias("user"),
        (F.col("event_type") == "signup").alias("is_admin"),
        v.padded("app-", F.col("event_id") * 2, 10).alias("app_id"),
    )
    return j.can_view(asked, v.applications(t))


@query(
    "SELECT 'user_' || (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END) AS \"user\", "
    "event_type = 'signup' AS is_admin, md5(CAST(event_id AS VARCHAR)) AS job_id, "
    "event_type = 'signup' OR (event_id % 7 = 0 AND (event_id % 3 <> 0 OR user_id = 1)) AS allowed FROM events"
)
def job_permissions(t: Tables) -> DataFrame:
    key = F.col("event_id")
    user = F.when(key % 3 == 0, F.lit(1)).otherwise(F.col("user_id")).cast("string")
    asked = t["events"].select(
        F.concat(F.lit("user_"), user).alias("user"),
        (F.col("event_type") == "signup").alias("is_admin"),
        F.md5(key.cast("string").cast("binary")).alias("job_id"),
    )
    return j.can_open_job(asked, v.runs(t))
