"""Failed-login lockouts on a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeops.functions.attempts import FRESH, NEVER, fold
from lakeops.operators.lockout import LOCKOUT_SECONDS, MAX_ATTEMPTS, user_key

_FIELDS = (
    "user string, at long, seq long, success boolean, outcome string, count int, until long"
)
# How far the attempts of all users may lie apart in a stream before states expire.
DELAY = "1 day"


class Lockouts(StatefulProcessor):
    """One user's attempts. The state is ``(count, until, last, timer)``: that of ``fold``, the
    latest attempt, and the instant in milliseconds at which the state may go (none: ``NEVER``)."""

    def __init__(self, max_attempts: int, lockout: int):
        self.max_attempts, self.lockout = max_attempts, lockout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "count int, until long, last long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        columns = [[b[c].to_numpy() for c in ("at", "seq", "success")] for b in rows]
        at, seq, success = (np.concatenate(parts) for parts in zip(*columns))
        order = np.lexsort((seq, at))
        at, seq, success = at[order], seq[order], success[order]
        state = self.state.get()
        if state is None:
            # A user without a state is new or has lost an expired one, which no attempt from
            # the watermark on would have noticed.
            state = (*FRESH, timerValues.getCurrentWatermarkInMs() * 1000, NEVER)
        count, until, last, timer = state
        late = int(np.searchsorted(at, last, side="left"))
        before = (count, until)
        outcomes, counts, untils, (count, until) = fold(
            at[late:].tolist(), success[late:].tolist(), before, self.max_attempts, self.lockout
        )
        if late < len(at):
            self._keep(count, until, int(at[-1]), timer)
        yield pd.DataFrame(
            {
                "user": key[0],
                "at": at,
                "seq": seq,
                "success": success,
                "outcome": ["late"] * late + outcomes,
                "count": [before[0]] * late + counts,
                "until": [before[1]] * late + untils,
            }
        )

    def _keep(self, count: int, until: int, last: int, timer: int) -> None:
        if until != NEVER:
            due = (until + self.lockout) // 1000 + 1
        elif count == 0:
            due = last // 1000 + 1
        else:
            due = NEVER  # failures count until a success or a lock
        if due != timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            if due != NEVER:
                self.handle.registerTimer(due)
        self.state.update((count, until, last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_lockouts(
    attempts: DataFrame,
    max_attempts: int = MAX_ATTEMPTS,
    lockout_seconds: int = LOCKOUT_SECONDS,
    delay: str = DELAY,
) -> DataFrame:
    """``lockouts`` continuously; ``attempts(username, ts, seq, success)`` is a stream.

    The attempts of a user in one micro-batch are taken in time order. An attempt older than the
    last one of its user comes out as ``late`` and changes nothing. A micro-batch holds what the
    source limits it to, so give the source a file or offset limit.

    States expire once they can no longer matter: that of a locked user when the watermark (the
    latest attempt of the stream less ``delay``) has passed the end of the lock by another lockout,
    that of a user without failures when it has passed their last attempt. Open failures are kept,
    as they count until a success. The watermark drops no attempt: every one comes out once, and
    one that is older than the watermark, of a user without a state, is late as well.
    The stream needs the RocksDB state store, see ``table.state_store``.
    """
    processor = Lockouts(max_attempts, lockout_seconds * 1_000_000)
    ts = F.col("ts").cast("timestamp")
    return (
        attempts.select(user_key(F.col("username")).alias("user"), ts.alias("ts"), "seq", "success")
        .withWatermark("ts", delay)
        # A plain number, so that the watermark moves timers and filters no rows.
        .select("user", F.unix_micros("ts").alias("at"), "seq", "success")
        .groupBy("user")
        .transformWithStateInPandas(processor, _FIELDS, "Append", "EventTime")
        .select(
            "user",
            F.timestamp_micros("at").alias("ts"),
            "seq",
            "success",
            "outcome",
            "count",
            F.when(F.col("until") != NEVER, F.timestamp_micros("until")).alias("locked_until"),
            F.greatest(F.lit(max_attempts) - F.col("count"), F.lit(0)).alias("remaining"),
        )
    )
