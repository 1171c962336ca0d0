"""Audit events: building, reading and rolling them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Days kept, total size kept, user of a request without a login.
KEEP_DAYS = 90
KEEP_BYTES = 5 * 1024**3
ANONYMOUS = "anonymous"

EVENT_JSON = (
    "timestamp string, user string, method string, path string, status int, operation string, "
    "tool string, subject string, resource string, result string, _corrupt string"
)


def parse_audit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to the typed audit table.

    ``event_kind`` tells the shapes apart: ``request``, ``policy``, ``degraded`` (only user and
    path) and ``corrupt`` for lines that are no JSON object; those keep their text in ``raw``.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    event = F.from_json(F.col(column), EVENT_JSON, options)
    parsed = lines.select(F.col(column).alias("_line"), event.alias("_e")).select("_line", "_e.*")
    kind = (
        F.when(F.col("_corrupt").isNotNull(), "corrupt")
        .when(F.col("operation").isNotNull(), "policy")
        .when(F.col("method").isNotNull(), "request")
        .when(F.col("path").isNotNull(), "degraded")
        .otherwise("corrupt")
    )
    ts = F.try_to_timestamp(F.col("timestamp"))
    return parsed.select(
        ts.alias("ts"),
        "user",
        "method",
        "path",
        "status",
        "operation",
        "tool",
        "subject",
        "resource",
        "result",
        kind.alias("event_kind"),
        ts.cast("date").alias("day"),
        F.when(kind == "corrupt", F.col("_line")).alias("raw"),
    )


def _instant(ts: Column) -> Column:
    return F.date_format(ts.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def make_audit_events(requests: DataFrame) -> DataFrame:
    """One event per handled request ``(ts, user, method, path, status)``, with its JSON line."""
    event = requests.select(
        _instant(F.col("ts")).alias("timestamp"),
        F.coalesce("user", F.lit(ANONYMOUS)).alias("user"),
        "method",
        "path",
        F.col("status").cast("int").alias("status"),
    )
    return event.withColumn("line", F.to_json(F.struct(*event.columns)))


def policy_audit(verdicts: DataFrame) -> DataFrame:
    """One event per policy change, failed ones included.

    ``verdicts`` is the output of ``validate_mutations`` with ``ts``, ``user``, ``tool`` and a
    ``backend_ok`` flag. Invalid input is status 400, a failing backend 502.
    """
    status = F.when(~F.col("valid"), 400).when(~F.col("backend_ok"), 502).otherwise(200)
    event = verdicts.select(
        _instant(F.col("ts")).alias("timestamp"),
        F.coalesce("user", F.lit(ANONYMOUS)).alias("user"),
        "operation",
        "tool",
        "subject",
        "resource",
        F.when(status == 200, "success").otherwise("failure").alias("result"),
        status.alias("status"),
    )
    body = [c for c in event.columns if c != "status"]
    return event.withColumn("line", F.to_json(F.struct(*body)))


def roll_audit(
    events: DataFrame, days: int = KEEP_DAYS, max_bytes: int | None = None, line: str | None = None
) -> DataFrame:
    """Keep the newest ``days`` days, and of those whole days up to ``max_bytes`` of lines.

    Days are counted back from the newest event. The newest day always stays.
    """
    newest = events.agg(F.max("day")).scalar()
    kept = events.where(F.col("day") >= F.date_sub(newest, days - 1))
    if max_bytes is None:
        return kept
    # One row per day, at most ``days`` of them.
    sizes = kept.groupBy("day").agg(F.sum(F.octet_length(F.col(line)) + 1).alias("_bytes"))
    newer = W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, 0)
    fitting = (
        sizes.withColumn("_total", F.sum("_bytes").over(newer))
        .withColumn("_rank", F.row_number().over(W.orderBy(F.desc("day"))))
        .where((F.col("_total") <= max_bytes) | (F.col("_rank") == 1))
        .select("day")
    )
    return kept.join(fitting, "day", "left_semi")


def write_audit(events: DataFrame, path: str) -> None:
    """Append events to a folder with one partition per day."""
    events.write.mode("append").partitionBy("day").parquet(path)
