"""Query history kept live from a stream of start, finish and fail events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakeops.functions.history import normalise
from lakeops.operators.history import HISTORY_ENTRIES, OWNER, owner_name

_ENTRY = (
    "id string, statement string, state string, started_at long, completed_at long, "
    "error string, execution_count long, logs array<string>"
)
_COLUMNS = [field.split()[0] for field in _ENTRY.split(", ")]
# Entries by number that are one line of the state. A call of the state costs more than a page, and the
# entries of a history of the usual length lie in two pages at most.
PAGE = 128
_FIELDS = f"user string, engine string, version long, number long, change string, {_ENTRY}"


class Entries:
    """The entries of one owner by their number, the order in which they started.

    ``live`` holds ``(number, id)`` of the entries there are, oldest first. Contents are read from
    the state when they are needed; what was changed is known afterwards.
    """

    def __init__(self, live: list[tuple[int, str]], following: int, limit: int, read):
        self.live, self.following, self.limit, self.read = live, following, limit, read
        self.known: dict[int, tuple] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def _content(self, number: int) -> tuple:
        if number not in self.known:
            self.known = self.read(number // PAGE) | self.known
        return self.known[number]

    def _put(self, number: int, content: tuple) -> None:
        self.known[number] = content
        self.changed.add(number)

    def _drop(self, place: int) -> None:
        number, _ = self.live.pop(place)
        self.changed.discard(number)
        self.gone.add(number)

    def start(self, key: str, statement: str, at: int) -> None:
        self._put(self.following, (key, statement, "RUNNING", at, 0, "", 1, []))
        self.live.append((self.following, key))
        self.following += 1
        if len(self.live) > self.limit:
            self._drop(0)

    def end(self, key: str, at: int, error: str | None, logs) -> None:
        """Ends a run, with an error (failed) or without (``None``); an entry that is gone stays gone."""
        number = next((n for n, k in reversed(self.live) if k == key), None)
        if number is None:
            return
        key, statement, _, started, _, _, runs, _ = self._content(number)
        if error is None:
            ended = ("FINISHED", started, at, "", runs, [] if logs is None else list(logs))
        else:
            ended = ("ERROR", started, at, error, runs, [])
        self._put(number, (key, statement, *ended))
        self._fold_newest()

    def pages(self) -> Iterator[tuple[int, dict[int, tuple]]]:
        """The pages that hold something new or lost something, with what they hold now."""
        touched = {number // PAGE for number in self.changed | self.gone}
        held: dict[int, dict[int, tuple]] = {page: {} for page in touched}
        for number, _ in self.live:
            if number // PAGE in touched:
                held[number // PAGE][number] = self._content(number)
        yield from held.items()

    def _fold_newest(self) -> None:
        """The newest entry, if it has ended, takes in the one before it when their statements match."""
        if len(self.live) < 2:
            return
        newest = self.live[-1][0]
        content, before = self._content(newest), self._content(self.live[-2][0])
        if content[2] != "RUNNING" and normalise(content[1]) == normalise(before[1]):
            self._put(newest, (*content[:6], content[6] + before[6], content[7]))
            self._drop(-2)


class Runs(StatefulProcessor):
    """The history of one owner: a map holds the entries in pages, a value their order."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.order = handle.getValueState(
            "order", "version long, last long, following long, numbers array<long>, ids array<string>"
        )
        entry = ", ".join(field.replace(" ", ": ", 1) for field in ("number long, " + _ENTRY).split(", "))
        self.stored = handle.getMapState("entries", "page long", f"entries array<struct<{entry}>>")

    def _read(self, page: int) -> dict[int, tuple]:
        found = self.stored.getValue((page,))
        return {number: tuple(entry) for number, *entry in found[0]} if found else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        version, last, following, numbers, ids = self.order.get() or (0, -1, 0, [], [])
        version += 1
        frames = list(rows)
        events = frames[0] if len(frames) == 1 else pd.concat(frames)
        order = np.lexsort((events["seq"].to_numpy(), events["event_time"].to_numpy())).tolist()
        history = Entries(list(zip(numbers, ids)), following, self.limit, self._read)
        lines = []
        columns = ("kind", "id", "statement", "event_time", "error", "logs")
        given = list(zip(*(events[c].tolist() for c in columns)))
        for kind, id_, statement, at, error, logs in map(given.__getitem__, order):
            if at < last:
                lines.append((*key, version, None, "late", id_, statement, "LATE", at, 0, "", 0, []))
                continue
            last = at
            if kind == "start":
                history.start(id_, statement, at)
            else:
                history.end(id_, at, (error or "") if kind == "fail" else None, logs)
        for page, held in history.pages():
            if held:
                self.stored.updateValue((page,), ([(number, *entry) for number, entry in held.items()],))
            elif page * PAGE < following:
                self.stored.removeKey((page,))
        for number in history.gone.intersection(numbers):
            lines.append((*key, version, number, "removed", *[None] * len(_COLUMNS)))
        for number in history.changed:
            lines.append((*key, version, number, "set", *history.known[number]))
        numbers, ids = zip(*history.live) if history.live else ((), ())
        self.order.update((version, last, history.following, list(numbers), list(ids)))
        if lines:
            names = [*OWNER, "version", "number", "change", *_COLUMNS]
            whole = ("version", "number", "started_at", "completed_at", "execution_count")
            kinds = [pd.Int64Dtype() if name in whole else object for name in names]
            yield pd.DataFrame({name: pd.Series(list(c), dtype=k) for name, c, k in zip(names, zip(*lines), kinds)})

    def close(self) -> None:
        pass


def stream_runs(query_log: DataFrame, n: int = HISTORY_ENTRIES) -> DataFrame:
    """What changes in the history of every user and engine, micro-batch by micro-batch.

    Events ``(user, engine, id, statement, event_time, seq, kind, error, logs)`` of one owner are
    applied one by one in ``(event_time, seq)`` order, so overlapping runs behave as they do live:
    a start is a new entry and pushes out the oldest beyond ``n``; an end is written to its entry,
    and the newest entry, once ended, takes in an equal one before it.

    A batch yields one line for each entry that it changed (``change`` is ``set``, with the
    entry as it is now) or took away (``removed``), under the entry's ``number`` and the next
    ``version``, so lines are as many as events, whatever the length of the list;
    ``latest_history`` makes the lists of them. An event older than the last one of its owner comes
    out as ``late`` with state ``LATE``. The stream needs the RocksDB state store, see ``table.state_store``.
    """
    return (
        query_log.withColumn("user", owner_name(F.col("user")))
        .groupBy(*OWNER)
        .transformWithStateInPandas(Runs(n), _FIELDS, "Append", "None")
    )


def latest_history(changes: DataFrame) -> DataFrame:
    """The list of every owner from what ``stream_runs`` wrote, late lines left out."""
    fields = ["change", *_COLUMNS]
    newest = (
        changes.where(F.col("number").isNotNull())
        .groupBy(*OWNER, "number")
        .agg(F.max_by(F.struct(*fields), "version").alias("entry"))
    )
    return newest.where("entry.change = 'set'").select(*OWNER, *[f"entry.{c}" for c in _COLUMNS])
