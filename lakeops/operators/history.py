"""Query history: folding start/finish events, compacting repeats, capping, session counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeops.functions.text import normalise_whitespace
from lakeops.session import scratch_root

OWNER = ("user", "engine")
# Entries kept per user and engine, operations kept per session, anonymous user.
HISTORY_ENTRIES = 100
SESSION_OPERATIONS = 20
ANONYMOUS = "anonymous"


def owner_name(user: Column) -> Column:
    """A run without a login belongs to ``anonymous``."""
    return F.when(F.coalesce(user, F.lit("")) == "", F.lit(ANONYMOUS)).otherwise(user)


def fold_runs(query_log: DataFrame) -> DataFrame:
    """One line per run from its ``start`` and ``finish`` or ``fail`` events.

    ``query_log(user, engine, id, statement, event_time, kind, error, logs)`` with ``event_time`` in
    epoch milliseconds. A run without an end is RUNNING. A failed run keeps its message, or the
    ``error_class`` of the event if the log has that column and there is no message, and loses its
    logs.
    """
    message = F.col("error")
    if "error_class" in query_log.columns:
        message = F.coalesce(message, F.col("error_class"))
    time = F.col("event_time")
    started, failed = F.col("kind") == "start", F.col("kind") == "fail"
    ended = ~started
    start = F.when(started, F.struct("event_time", "statement"))
    end = F.when(ended, F.struct(time.alias("ended"), failed.alias("failed"), message.alias("error"), "logs"))
    folded = (
        query_log.withColumn("user", owner_name(F.col("user")))
        .groupBy(*OWNER, "id")
        .agg(
            F.min(start).alias("_start"),
            F.max(end).alias("_end"),
        )
        .where(F.col("_start").isNotNull())
    )
    error = F.col("_end.failed")
    running = F.col("_end").isNull()
    no_logs = F.array().cast("array<string>")
    return folded.select(
        *OWNER,
        "id",
        "_start.statement",
        F.col("_start.event_time").alias("started_at"),
        F.coalesce("_end.ended", F.lit(0)).cast("long").alias("completed_at"),
        F.when(running, "RUNNING").when(error, "ERROR").otherwise("FINISHED").alias("state"),
        F.when(error, F.coalesce("_end.error", F.lit(""))).otherwise(F.lit("")).alias("error"),
        F.lit(1).cast("long").alias("execution_count"),
        F.when(running | error, no_logs).otherwise(F.coalesce("_end.logs", no_logs)).alias("logs"),
    )


def compact_consecutive(
    runs: DataFrame, keys: tuple[str, ...] = OWNER, slices: int | None = None
) -> DataFrame:
    """Merge neighbouring runs of a key whose statements match up to whitespace.

    The newest run of a group survives with the summed ``execution_count``; a RUNNING run does not
    absorb the runs before it. Runs of a key must not overlap.

    The runs are sorted into ``slices`` ranges of about equal size (as many as shuffle partitions
    by default), so a busy key is spread over several. Runs are merged inside a range first; then
    only the first and last group of a key in a range can still join a neighbour, and only these,
    at most two per key and range, are brought together. Whether two neighbours join depends on
    their texts and the state of the later one, so a group carries the state of its first run.
    """
    spark = runs.sparkSession
    scratch_root(spark)
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k) for k in keys] + [F.col("started_at"), F.col("id")]
    rows = runs.withColumns(
        {
            "_text": normalise_whitespace("statement"),
            "execution_count": F.col("execution_count").cast("long"),
            "_first_running": F.coalesce(F.col("state").isin("RUNNING", "RUNNING_STATE"), F.lit(False)),
        }
    )
    # Written down, so that a lost executor cannot change which range a run is in.
    sliced = (
        rows.repartitionByRange(count, *order).withColumn("_slice", F.spark_partition_id()).checkpoint()
    )
    inside = _merged(sliced, [*keys, "_slice"], _same_text)
    # Groups that cannot join a neighbour stay with their slice, the others meet under null.
    parted = inside.withColumn("_part", F.when(~F.col("_edge"), F.col("_slice"))).drop("_edge")
    return _merged(parted, [*keys, "_part"], _same_text_next_slice).select(*runs.columns)


def _same_text(window) -> Column:
    return F.lead("_text").over(window) == F.col("_text")


def _same_text_next_slice(window) -> Column:
    return _same_text(window) & (F.lead("_slice").over(window) != F.col("_slice"))


def _merged(df: DataFrame, group: list[str], joins_next: Callable[..., Column]) -> DataFrame:
    """The newest run of every group of neighbours, with the executions of the group.

    ``_first_running`` becomes the state of the group's first run, ``_edge`` marks the first and
    the last group in the order of ``group``.
    """
    window = W.partitionBy(*group).orderBy("started_at", "id")
    so_far = window.rowsBetween(W.unboundedPreceding, 0)
    joined = F.coalesce(joins_next(window) & ~F.lead("_first_running").over(window), F.lit(False))
    begins = ~F.coalesce(F.lag("_joined").over(window), F.lit(False))
    newest = (
        df.withColumns({"_joined": joined, "_total": F.sum("execution_count").over(so_far)})
        .withColumn("_starts", F.when(begins, F.col("_first_running")))
        .withColumn("_first_running", F.last("_starts", ignorenulls=True).over(so_far))
        .where(~F.col("_joined"))
    )
    # What was counted since the group before. The rows are still in the order of the first
    # window, so neither a shuffle nor a sort comes in between.
    before, after = F.lag("_total").over(window), F.lead("_total").over(window)
    return newest.withColumns(
        {
            "execution_count": F.col("_total") - F.coalesce(before, F.lit(0)),
            "_edge": before.isNull() | after.isNull(),
        }
    ).drop("_joined", "_total", "_starts")


def cap_history(
    entries: DataFrame, n: int = HISTORY_ENTRIES, keys: tuple[str, ...] = OWNER
) -> DataFrame:
    """The newest ``n`` entries per key, or ``n - 1`` when the newest is a merged one.

    The list is cut when a run starts and a merge then shortens it by one.
    """
    newest_first = W.partitionBy(*keys).orderBy(F.desc("started_at"), F.desc("id"))
    kept = entries.withColumn("_n", F.row_number().over(newest_first)).where(F.col("_n") <= n)
    newest = F.first("execution_count").over(newest_first)
    limit = F.lit(n) - (newest > 1).cast("int")
    return kept.withColumn("_limit", limit).where(F.col("_n") <= F.col("_limit")).drop("_n", "_limit")


def cap_operations(operations: DataFrame, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """``cap_history`` with the session limits: 20 operations, 19 after a merge."""
    return cap_history(operations, SESSION_OPERATIONS, keys)


def history_for(entries: DataFrame, user: str, engine: str) -> DataFrame:
    """One user's entries on one engine, newest first."""
    mine = (F.col("user") == user) & (F.col("engine") == engine)
    return entries.where(mine).orderBy(F.desc("started_at"), F.desc("id"))


def history_all_users(entries: DataFrame, engine: str) -> DataFrame:
    """Every user's entries on one engine, with the owner."""
    return entries.where(F.col("engine") == engine)


def statement_lookup(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The original statement of every requested id that is known."""
    return ids.select("id").distinct().join(entries.select("id", "statement"), "id")


def unknown_ids(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids without an entry; a lookup of these is an error."""
    return ids.select("id").distinct().join(entries.select("id"), "id", "left_anti")


def operation_state(state: Column) -> Column:
    """Upper case without the ``_STATE`` suffix."""
    return F.replace(F.upper(state), F.lit("_STATE"), F.lit(""))


def session_counters(operations: DataFrame) -> DataFrame:
    """Executions per session by state: pending, running, finished and failed."""
    state = operation_state(F.col("state"))

    def weighed(*states: str) -> Column:
        return F.sum(F.when(state.isin(*states), F.col("execution_count")).otherwise(0)).cast("long")

    return operations.groupBy("session").agg(
        weighed("PENDING").alias("pending"),
        weighed("RUNNING").alias("running"),
        weighed("FINISHED").alias("finished"),
        weighed("ERROR", "CANCELED").alias("failed"),
        F.sum("execution_count").cast("long").alias("executions"),
    )


def session_totals(operations: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Counters and engine snapshots of all sessions that have either.

    The total is the larger of the snapshot's total and our own count of executions. Further
    columns of the snapshot (engine name and address, pool sizes) follow as they are.
    """
    counters = session_counters(operations)
    zero = F.lit(0).cast("long")
    known = ("session", "engine_id", "opened_at", "total_operations")
    more = [F.col(f"`{c}`") for c in snapshots.columns if c not in known]
    numbers = ("pending", "running", "finished", "failed")
    return counters.join(snapshots, "session", "full").select(
        "session",
        "engine_id",
        F.coalesce("opened_at", zero).alias("opened_at"),
        F.greatest(F.coalesce("total_operations", zero), F.coalesce("executions", zero)).alias("total"),
        *[F.coalesce(n, zero).alias(n) for n in numbers],
        *more,
    )


def last_result_marker(runs: DataFrame) -> DataFrame:
    """Per session the newest successful run that returned rows, else the newest successful one."""
    return (
        runs.where(F.col("ok"))
        .groupBy("session")
        .agg(F.max(F.struct("has_rows", "started_at", "id")).alias("_r"))
        .select("session", "_r.id", "_r.started_at", "_r.has_rows")
    )
