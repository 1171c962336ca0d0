"""Queries that run as streams over the given tables until their input is used up.

Each must equal its batch twin, so it has the same SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.plans import fixtures as v
from lakeops.plans import security
from lakeops.plans.fixtures import Tables
from lakeops.plans.history import _capped
from lakeops.plans.registry import query
from lakeops.session import scratch_path
from lakeops.streaming.audit import typed_audit
from lakeops.streaming.retention import read_retained, retain_audit_stream
from lakeops.streaming.lockouts import stream_lockouts
from lakeops.streaming.runs import latest_history, stream_runs
from lakeops.streaming.table import drain


# Bounds what one micro-batch, and so one user in it, can bring to a task.
BATCH_BYTES = 1024**3


class StreamedTables(Tables):
    """The given tables, with ``events`` as a stream of its files.

    Files that arrive in time order give the batch results; rows behind those already seen of
    their user come out as late.
    """

    def __getitem__(self, name: str) -> DataFrame:
        if name != "events":
            return super().__getitem__(name)
        schema = self.spark.read.parquet(self.path(name)).schema
        # A pattern, because the stream source takes a folder or a pattern, not one file.
        stream = self.spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES)
        return stream.parquet(f"{self.path(name)}*")


def _streamed(t: Tables) -> StreamedTables:
    return StreamedTables(t.spark, t.sf_dir)


@query(security.AUDIT_SQL.replace("SELECT event_id, ", "SELECT ", 1))
def streamed_audit(t: Tables) -> DataFrame:
    lines = security.audit_lines(_streamed(t)["events"])
    return security.shown_audit(drain(typed_audit(lines), "audit"))


@query(security.SHOWN_LOCKOUT_SQL)
def streamed_lockouts(t: Tables) -> DataFrame:
    outcomes = stream_lockouts(v.attempts(_streamed(t)), lockout_seconds=86_400)
    return security.shown_outcomes(drain(outcomes, "lockouts"))


@query(_capped(100, '"user", engine'))
def streamed_runs(t: Tables) -> DataFrame:
    versions = stream_runs(v.query_log(_streamed(t), all_end=True))
    entries = latest_history(drain(versions, "runs"))
    columns = ["user", "engine", "id", "statement", "started_at", "completed_at", "state", "error"]
    return entries.select(*columns, F.col("execution_count"))


@query(security.RECENT_DAYS_SQL)
def streamed_retention(t: Tables) -> DataFrame:
    folder = scratch_path(t.spark, "retained")
    events = security.dated(_streamed(t))
    running = retain_audit_stream(events, f"{folder}/days", f"{folder}/checkpoint", days=7, available_now=True)
    running.awaitTermination()
    return read_retained(t.spark, f"{folder}/days").select("timestamp", "user", "path")
