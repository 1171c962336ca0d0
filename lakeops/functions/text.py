"""Text, size, time and identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Size units and the sizes at which the next unit starts.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")
# Fixed value: the log line that names a submitted job.
JOB_ID_PATTERN = r"Submitting job '.*?' \(([0-9a-f]{32})\)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalise_whitespace(text: Column | str) -> Column:
    """Trim, and turn every run of whitespace into one space. Null becomes empty."""
    inner = F.regexp_replace(F.coalesce(_col(text), F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(inner, r"\s+", " ")


def format_size(size: Column | str) -> Column:
    """Bytes as ``512 B``, ``1.5 KB`` ... ``2.0 TB`` (base 1024, at most TB)."""
    n = _col(size)
    text = F.when(n.isNull(), F.lit(None).cast("string")).when(
        n < 1024, F.concat(n.cast("string"), F.lit(" B"))
    )
    for power, unit in enumerate(SIZE_UNITS[1:], start=1):
        # Tenths of the unit, rounded half up without leaving integers.
        tenths = F.shiftright(n.cast("long") * 20 + 1024**power, 10 * power + 1)
        shown = (tenths.cast("decimal(20,0)") / 10).cast("decimal(20,1)").cast("string")
        label = F.concat(shown, F.lit(f" {unit}"))
        last = unit == SIZE_UNITS[-1]
        text = text.otherwise(label) if last else text.when(n < 1024 ** (power + 1), label)
    return text


def format_date(millis: Column | str) -> Column:
    """Epoch milliseconds as ``yyyy-MM-dd HH:mm:ss`` in UTC; empty for null and zero."""
    ms = _col(millis)
    shown = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")
    return F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit("")).otherwise(shown)


def format_duration(millis: Column | str) -> Column:
    """Milliseconds as ``42s``, ``3m 7s`` or ``5h 2m``; empty for null and zero."""
    ms = _col(millis)
    seconds = F.floor(ms / 1000).cast("long")
    minutes = F.floor(seconds / 60).cast("long")
    hours = F.floor(minutes / 60).cast("long")

    def part(value: Column, unit: str) -> Column:
        return F.concat(value.cast("string"), F.lit(unit))

    return (
        F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(""))
        .when(seconds < 60, part(seconds, "s"))
        .when(minutes < 60, F.concat_ws(" ", part(minutes, "m"), part(seconds % 60, "s")))
        .otherwise(F.concat_ws(" ", part(hours, "h"), part(minutes % 60, "m")))
    )


def format_start(text: Column | str) -> Column:
    """ISO text with its first ``T`` as a space, cut to seconds."""
    spaced = F.regexp_replace(F.coalesce(_col(text), F.lit("")), "^([^T]*)T", "$1 ")
    return F.substring(spaced, 1, 19)


def iso_instant(millis: Column | str) -> Column:
    """Epoch milliseconds as an ISO instant; the fraction shows only when it is not zero."""
    ms = _col(millis)
    stamp = F.timestamp_millis(ms)
    whole = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fraction = F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.when(F.pmod(ms, F.lit(1000)) == 0, whole).otherwise(fraction)


def escape_cell(text: Column | str) -> Column:
    """Text that is safe inside a pipe table cell."""
    value = F.coalesce(_col(text).cast("string"), F.lit(""))
    value = F.replace(value, F.lit("|"), F.lit("\\|"))
    value = F.regexp_replace(value, r"[\n\r]", " ")
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def truncate_cell(text: Column | str, limit: int = 180) -> Column:
    """Escaped text; longer than ``limit`` it ends in an ellipsis."""
    value = escape_cell(text)
    cut = F.concat(F.substring(value, 1, limit - 1), F.lit("…"))
    return F.when(F.char_length(value) <= limit, value).otherwise(cut)


def job_id_in(logs: Column | str) -> Column:
    """The job id in the first log line that names one, or null."""
    found = F.transform(_col(logs), lambda line: F.regexp_extract(line, JOB_ID_PATTERN, 1))
    return F.get(F.filter(found, lambda job: job != ""), F.lit(0))


def path_label(path: Column | str) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(F.regexp_replace(_col(path), "/+$", ""), "/"), -1)
