"""Finding keys that hold too many rows for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of one key that one task sorts and folds without trouble.
TARGET_ROWS = 1_000_000


def busy_keys(df: DataFrame, keys: list[str], target_rows: int = TARGET_ROWS) -> DataFrame | None:
    """The keys with more than ``target_rows`` rows, or None if there are none.

    This counts the rows per key once, combined before the shuffle. There are at most
    ``rows / target_rows`` such keys; whether to broadcast them is left to Spark, which knows their
    size by the time it joins.
    """
    busy = df.groupBy(*keys).count().where(F.col("count") > target_rows).select(*keys)
    return None if busy.isEmpty() else busy
