"""Listings of applications and jobs: flattening, merging, owner rules, search, sort and pages."""

from __future__ import annotations

import datetime
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.operators.numbering import number_rows

from lakeops.functions.text import format_start, iso_instant, job_id_in

APPLICATION = (
    "id",
    "name",
    "user",
    "start_time",
    "end_time",
    "duration_ms",
    "completed",
    "version",
)
# List limits, page size, live job states and the id prefixes and labels of rows.
DEFAULT_LIMIT = 500
MAX_LIMIT = 5000
PAGE_SIZE = 25
LIVE_STATES = ("RUNNING", "CREATED", "RESTARTING", "RECONCILING", "INITIALIZING")
SESSION_PREFIX = "kyuubi-"
JOB_PREFIX = "flink-"
QUERY_PREFIX = "kyuubi-flink-query-"
SESSION_LABEL = "Kyuubi engine"
JOB_LABEL = "Flink job"
QUERY_LABEL = "Kyuubi Flink SQL query"

HISTORY_JSON = (
    "id string, name string, attempts array<struct<sparkUser string, startTime string, "
    "endTime string, duration long, completed boolean, appSparkVersion string>>"
)
OVERVIEW_JSON = (
    "jobs array<struct<jid string, name string, state string, `start-time` long, "
    "`end-time` long, duration long>>"
)


def _text(value: Column | str) -> Column:
    return F.coalesce(value, F.lit(""))


def flatten_applications(docs: DataFrame, column: str = "json") -> DataFrame:
    """History documents, one application each, to rows by their newest (first) attempt.

    Missing fields become empty text, 0 or false.
    """
    app = F.from_json(F.col(column), HISTORY_JSON)
    parsed = docs.select(app.alias("_a")).select(
        "_a.id", "_a.name", F.get("_a.attempts", F.lit(0)).alias("_t")
    )
    return parsed.select(
        _text("id").alias("id"),
        _text("name").alias("name"),
        _text("_t.sparkUser").alias("user"),
        _text("_t.startTime").alias("start_time"),
        _text("_t.endTime").alias("end_time"),
        F.coalesce("_t.duration", F.lit(0)).cast("long").alias("duration_ms"),
        F.coalesce("_t.completed", F.lit(False)).alias("completed"),
        _text("_t.appSparkVersion").alias("version"),
    )


def recent_applications(
    apps: DataFrame, limit: int = DEFAULT_LIMIT, min_date: str | None = None
) -> DataFrame:
    """The newest applications from a start date on: one at least, 5000 at most; a larger limit is
    refused.

    This limit comes before any owner filter.
    """
    if limit > MAX_LIMIT:
        raise ValueError(f"at most {MAX_LIMIT} applications can be asked for, not {limit}")
    rows = apps.where(F.col("start_time") >= min_date) if min_date else apps
    return rows.orderBy(F.desc("start_time"), "id").limit(max(1, limit))


def live_applications(sessions: DataFrame, now_ms: int) -> DataFrame:
    """Sessions ``(id, name, user, state, created_at)`` that have not failed, as running rows."""
    age = F.greatest(F.lit(0).cast("long"), F.lit(now_ms).cast("long") - F.col("created_at"))
    return sessions.where(F.col("state") != "FAILED").select(
        F.concat(F.lit(SESSION_PREFIX), "id").alias("id"),
        "name",
        "user",
        iso_instant("created_at").alias("start_time"),
        F.lit("").alias("end_time"),
        age.alias("duration_ms"),
        F.lit(False).alias("completed"),
        F.lit(SESSION_LABEL).alias("version"),
    )


def visible_applications(
    live: DataFrame,
    history: DataFrame,
    user: str,
    is_admin: bool,
    requested_user: str | None = None,
) -> DataFrame:
    """Live rows, then history, that a user may see; ``source_rank`` keeps that order.

    Others than administrators always get their own rows, whatever user they ask for.
    """
    rows = (
        live.select(*APPLICATION)
        .withColumn("source_rank", F.lit(0))
        .unionByName(history.select(*APPLICATION).withColumn("source_rank", F.lit(1)))
    )
    wanted = requested_user if is_admin else user
    return rows.where(F.col("user") == wanted) if wanted and wanted.strip() else rows


def flatten_job_overview(docs: DataFrame, running: bool, column: str = "json") -> DataFrame:
    """Job overview documents to rows: the live jobs, or all others.

    A document that cannot be read yields no rows.
    """
    job = F.explode(F.from_json(F.col(column), OVERVIEW_JSON)["jobs"])
    jobs = docs.select(job.alias("_j")).select("_j.*")
    live = F.coalesce(F.col("state").isin(*LIVE_STATES), F.lit(False))
    end = F.coalesce(F.col("`end-time`"), F.lit(0))
    ended = F.lit("") if running else F.when(end <= 0, "").otherwise(iso_instant(end))
    return jobs.where(live if running else ~live).select(
        F.concat(F.lit(JOB_PREFIX), _text("jid")).alias("id"),
        _text("name").alias("name"),
        F.lit("").alias("user"),
        iso_instant(F.coalesce(F.col("`start-time`"), F.lit(0))).alias("start_time"),
        ended.alias("end_time"),
        F.coalesce("duration", F.lit(0)).cast("long").alias("duration_ms"),
        F.lit(not running).alias("completed"),
        F.lit(JOB_LABEL).alias("version"),
    )


def queries_as_jobs(entries: DataFrame) -> DataFrame:
    """History entries as job rows, under the job id their logs name if there is one."""
    job = job_id_in("logs")
    completed = F.col("state") != "RUNNING"
    end = F.when(completed, F.col("completed_at")).otherwise(F.lit(0))
    took = F.greatest(F.lit(0).cast("long"), end - F.col("started_at"))
    return entries.select(
        F.when(job.isNotNull(), F.concat(F.lit(JOB_PREFIX), job))
        .otherwise(F.concat(F.lit(QUERY_PREFIX), "id"))
        .alias("id"),
        F.col("statement").alias("name"),
        "user",
        iso_instant("started_at").alias("start_time"),
        F.when(end == 0, "").otherwise(iso_instant(end)).alias("end_time"),
        F.when(end == 0, F.lit(0)).otherwise(took).cast("long").alias("duration_ms"),
        completed.alias("completed"),
        F.lit(QUERY_LABEL).alias("version"),
    )


def merged_jobs(
    engines: DataFrame,
    queries: DataFrame,
    running: DataFrame,
    completed: DataFrame,
    is_admin: bool,
    user: str | None = None,
) -> DataFrame:
    """The job list with ``source_rank``: engines, queries, running, completed.

    Administrators see every source, and of rows with one id the first in source order, newest
    start first within a source. Others see their own engines and queries, repeats included.
    """
    sources = [engines, queries, running, completed] if is_admin else [engines, queries]
    ranked = [
        df.select(*APPLICATION).withColumn("source_rank", F.lit(rank))
        for rank, df in enumerate(sources)
    ]
    rows = reduce(DataFrame.unionByName, ranked)
    if not is_admin:
        return rows.where(F.col("user") == user)
    # The lowest source rank first, then the newest start; the rest makes the choice unique.
    place = ["start_time", *[c for c in APPLICATION if c not in ("id", "start_time")]]
    first = F.max(F.struct((-F.col("source_rank")).alias("_order"), *place)).alias("_r")
    return rows.groupBy("id").agg(first).select("id", "_r.*").select(
        *APPLICATION, (-F.col("_order")).alias("source_rank")
    )


def date_range(
    apps: DataFrame,
    lower: str | None = None,
    upper: str | None = None,
    last_days: int | None = None,
    today: str | None = None,
) -> DataFrame:
    """Rows that start within days, both inclusive: the last 1, 7 or 30 days, or custom bounds.

    Starts are texts that begin with the day, so they are compared as they are and the bounds reach
    the scan.
    """
    start = F.col("start_time")
    if last_days is not None:
        base = datetime.date.fromisoformat(today) if today else datetime.datetime.now(datetime.UTC).date()
        lower, upper = (base - datetime.timedelta(days=last_days)).isoformat(), None
    if lower:
        apps = apps.where(start >= lower)
    if upper:
        after = datetime.date.fromisoformat(upper) + datetime.timedelta(days=1)
        apps = apps.where(start < after.isoformat())
    return apps


def search(apps: DataFrame, needle: str) -> DataFrame:
    """Rows whose name, id or start contains the text, whatever the case."""
    needle = needle.strip().lower()
    if not needle:
        return apps
    hay = F.concat_ws(" ", _text("name"), _text("id"), format_start("start_time"))
    return apps.where(F.contains(F.lower(hay), F.lit(needle)))


def state_filter(apps: DataFrame, state: str = "all") -> DataFrame:
    """``all``, ``running`` or ``completed`` rows."""
    if state not in ("all", "running", "completed"):
        raise ValueError(f"unknown state {state!r}")
    if state == "all":
        return apps
    return apps.where(F.col("completed") if state == "completed" else ~F.col("completed"))


def state_counts(apps: DataFrame) -> DataFrame:
    """How many rows are running and completed."""
    return apps.agg(
        F.count_if(~F.col("completed")).alias("running"),
        F.count_if(F.col("completed")).alias("completed"),
    )


def sort_order(df: DataFrame, key: str, direction: str, position: str) -> list[Column]:
    if direction not in ("asc", "desc"):
        raise ValueError(f"unknown direction {direction!r}")
    value = F.col(key)
    if dict(df.dtypes)[key] == "string":
        value = F.collate(F.coalesce(value, F.lit("")), "UNICODE")
    return [value.asc() if direction == "asc" else value.desc(), F.col(position).asc()]


def sort_by(
    apps: DataFrame, key: str = "start_time", direction: str = "desc", position: str = "id"
) -> DataFrame:
    """Sort by one column: numbers by value, false before true, text in language order.

    Ties keep the source order, given by the ``position`` column, in both directions.
    """
    return apps.orderBy(*sort_order(apps, key, direction, position))


# Rows that one task sorts for a page, and the ranges into which the keys of more rows are cut.
PAGE_SORT_ROWS = 250_000
PAGE_RANGES = 32


@dataclass(frozen=True)
class _Before:
    """Which rows may be on a page, and how many come before all of these."""

    where: Column
    rows: int


def _rows_around(
    apps: DataFrame, skipped: int, size: int, total: int, key: str, direction: str
) -> tuple[DataFrame | None, _Before]:
    """The rows among which those from rank ``skipped`` on are found, without sorting all.

    A sample of the keys cuts them into ranges, the rows of each range are counted (a line per range), and
    only the ranges that hold the ranks asked for are read again, cut anew as long as that makes
    them smaller. No rows are given if there are still more than one task should sort, as when many
    rows share a key.
    """
    held = _Before(F.lit(True), 0)
    while total > PAGE_SORT_ROWS:
        where, before, left = _range_around(apps.where(held.where), skipped - held.rows, size, total, key, direction)
        shrunk = left < total
        held, total = _Before(held.where & where, held.rows + before), left
        if not shrunk:
            return None, held
    return apps.where(held.where), held


def _range_around(
    apps: DataFrame, skipped: int, size: int, total: int, key: str, direction: str
) -> tuple[Column, int, int]:
    """One cut: which rows may be on the page, how many come before them, and how many they are."""
    text = dict(apps.dtypes)[key] == "string"
    value = F.coalesce(F.col(key), F.lit("")) if text else F.col(key)
    share = min(1.0, 32 * PAGE_RANGES / total)
    sampled = apps.select(value.alias("v")).where("v IS NOT NULL").sample(share, 7)
    sampled = sampled.orderBy(F.collate("v", "UNICODE") if text else F.col("v")).limit(64 * PAGE_RANGES)
    values = [row.v for row in sampled.collect()]
    cuts = values[len(values) // PAGE_RANGES :: max(1, len(values) // PAGE_RANGES)]

    def at_least(cut) -> Column:
        if text:
            return F.collate(value, "UNICODE") >= F.collate(F.lit(cut), "UNICODE")
        return value >= F.lit(cut)

    # Range 0 holds the nulls, range 1 what lies below all cuts, range k + 1 what reaches k cuts.
    def reached_from(low: int, high: int) -> Column:
        """The range, given that it is one from ``low`` to ``high``: halved by a comparison each."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(at_least(cuts[middle - 2]), reached_from(middle, high)).otherwise(reached_from(low, middle - 1))

    reached = F.when(value.isNotNull(), reached_from(1, len(cuts) + 1))
    ranges = dict(apps.groupBy(F.coalesce(reached, F.lit(0)).alias("range")).count().collect())
    last = skipped + size
    passed, found, before = 0, [], 0
    for number in sorted(ranges, reverse=direction == "desc"):
        if passed + ranges[number] > skipped and passed < last:
            before = passed if not found else before
            found.append(number)
        passed += ranges[number]
    if not found:
        return F.lit(False), 0, 0
    low, high = min(found), max(found)
    where = F.lit(True) if low == 0 else value.isNotNull()
    if low > 1:
        where = where & at_least(cuts[low - 2])
    if high <= len(cuts):
        below = ~at_least(cuts[high - 1]) if high else F.lit(False)
        where = where & F.coalesce(below, F.lit(low == 0))
        if low == 0 and high == 0:
            where = value.isNull()
    return where, before, sum(ranges[n] for n in found)


@dataclass(frozen=True)
class Page:
    """One page of a sorted list and where it stands."""

    rows: DataFrame
    page: int
    pages: int
    first: int
    last: int
    total: int


def page_of(
    apps: DataFrame,
    page: int = 1,
    size: int = PAGE_SIZE,
    key: str = "start_time",
    direction: str = "desc",
    position: str = "id",
) -> Page:
    """Page ``page`` of the sorted rows; a page past the end becomes the last one."""
    if size <= 0:
        raise ValueError("page size must be positive")
    total = apps.count()
    pages = max(1, -(-total // size))
    page = max(1, min(page, pages))
    skipped = (page - 1) * size
    near, before = _rows_around(apps, skipped, size, total, key, direction)
    order = sort_order(apps, key, direction, position)
    if near is None:
        rows = number_rows(apps.where(before.where), order, "_place")
        low = skipped - before.rows
        rows = rows.where(F.col("_place").between(low + 1, low + size)).orderBy("_place").drop("_place")
    else:
        rows = near.orderBy(*order).offset(skipped - before.rows).limit(size)
    first = skipped + 1 if total else 0
    return Page(rows, page, pages, first, min(page * size, total), total)


def can_view(requests: DataFrame, apps: DataFrame) -> DataFrame:
    """Adds ``allowed`` to ``requests(user, is_admin, app_id)``.

    Administrators may view everything, others the applications they own; unknown ids are refused.
    """
    owners = apps.select(F.col("id").alias("app_id"), "user").distinct()
    return requests.join(owners.withColumn("_owned", F.lit(True)), ["app_id", "user"], "left").select(
        *requests.columns,
        (F.col("is_admin") | F.coalesce("_owned", F.lit(False))).alias("allowed"),
    )


def can_use_job_ui(requests: DataFrame, live: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``allowed`` to ``requests(user, is_admin)``: whether the user may see the job pages.

    Others than administrators need a live engine of their own (``live(user)``) or a query whose
    log names a job (``entries(user, logs)``).
    """
    recorded = entries.where(job_id_in("logs").isNotNull()).select("user")
    known = live.select("user").unionAll(recorded).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, "user", "left").select(
        *requests.columns,
        (F.col("is_admin") | F.coalesce("_known", F.lit(False))).alias("allowed"),
    )


def can_open_job(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``allowed`` to ``requests(user, is_admin, job_id)``.

    Others than administrators may open the jobs that the logs of their own queries name.
    """
    recorded = (
        entries.select("user", job_id_in("logs").alias("job_id"))
        .where(F.col("job_id").isNotNull())
        .distinct()
        .withColumn("_recorded", F.lit(True))
    )
    return requests.join(recorded, ["user", "job_id"], "left").select(
        *requests.columns,
        (F.col("is_admin") | F.coalesce("_recorded", F.lit(False))).alias("allowed"),
    )
