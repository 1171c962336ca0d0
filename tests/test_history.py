import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeops.functions.history import normalise
from lakeops.operators import history as h
from lakeops.streaming.runs import Runs, latest_history, stream_runs
from lakeops.streaming.table import drain

RUN = "user string, engine string, id string, statement string, started_at long, completed_at long, state string, error string, execution_count long, logs array<string>"
LOG = "user string, engine string, id string, statement string, event_time long, seq long, kind string, error string, logs array<string>"


def run(i, statement, state="FINISHED", user="alice", engine="trino", at=None, logs=()):
    start = i * 1000 if at is None else at
    return (user, engine, f"q{i:04}", statement, start, start + 10, state, "", 1, list(logs))


def events(i, statement, start, end, kind="finish", user="alice", error=None, logs=()):
    first = (user, "trino", f"q{i:04}", statement, start, 2 * i, "start", None, None)
    last = (user, "trino", f"q{i:04}", statement, end, 2 * i + 1, kind, error, list(logs))
    return [first] if end is None else [first, last]


def apply_event(entries: list[dict], event: dict, limit: int) -> None:
    """Change the newest-first list in place.

    A start goes to the front and cuts the list. An end is written to its entry, wherever that is;
    then the two newest entries become one if their statements match and the newest has ended. An
    end whose entry is gone changes nothing.
    """
    if event["kind"] == "start":
        entry = {
            "id": event["id"],
            "statement": event["statement"],
            "state": "RUNNING",
            "started_at": event["event_time"],
            "completed_at": 0,
            "error": "",
            "execution_count": 1,
            "logs": [],
        }
        entries.insert(0, entry)
        del entries[limit:]
        return
    entry = next((e for e in entries if e["id"] == event["id"]), None)
    if entry is None:
        return
    failed = event["kind"] == "fail"
    entry["state"] = "ERROR" if failed else "FINISHED"
    entry["completed_at"] = event["event_time"]
    entry["error"] = (event["error"] or "") if failed else ""
    entry["logs"] = [] if failed else list(event["logs"] if event["logs"] is not None else [])
    if len(entries) < 2:
        return
    newest, before = entries[:2]
    if newest["state"] != "RUNNING" and normalise(newest["statement"]) == normalise(
        before["statement"]
    ):
        newest["execution_count"] += before["execution_count"]
        del entries[1]


def replay(log, limit=100):
    lists = {}
    for event in sorted(log, key=lambda e: (e[4], e[5])):
        row = dict(zip([c.split()[0] for c in LOG.split(", ")], event))
        apply_event(lists.setdefault((row["user"], row["engine"]), []), row, limit)
    return lists


def test_fixture_two_spellings_become_one_entry(spark):
    log = events(1, "SELECT 1", 1000, 1010, logs=["warning"]) + events(2, " SELECT   1 ", 2000, 2010)
    folded = h.fold_runs(spark.createDataFrame(log, LOG))
    entry = h.compact_consecutive(folded).collect()
    assert len(entry) == 1
    assert (entry[0].id, entry[0].execution_count, entry[0].logs, entry[0].statement) == ("q0002", 2, [], " SELECT   1 ")
    assert h.history_for(folded, "alice", "starrocks").count() == 0
    assert h.history_for(folded, "bob", "trino").count() == 0


def test_fold_states(spark):
    log = (
        events(1, "a", 1, 2, logs=["x"])
        + events(2, "b", 3, 4, "fail", error="boom", logs=["x"])
        + events(3, "c", 5, None, user=None)
        + events(4, "d", 6, 7, "fail")
    )
    rows = {r.id: r for r in h.fold_runs(spark.createDataFrame(log, LOG)).collect()}
    assert (rows["q0001"].state, rows["q0001"].logs, rows["q0001"].completed_at) == ("FINISHED", ["x"], 2)
    assert (rows["q0002"].state, rows["q0002"].error, rows["q0002"].logs) == ("ERROR", "boom", [])
    assert (rows["q0003"].state, rows["q0003"].user, rows["q0003"].completed_at) == ("RUNNING", "anonymous", 0)
    assert rows["q0004"].error == ""


def test_running_run_is_not_merged(spark):
    rows = [run(1, "x"), run(2, "x"), run(3, "x", "RUNNING")]
    got = h.compact_consecutive(spark.createDataFrame(rows, RUN)).orderBy("started_at").collect()
    assert [(r.id, r.execution_count) for r in got] == [("q0002", 2), ("q0003", 1)]


@pytest.mark.parametrize("slices", [1, 2, 7, 40])
def test_compaction_against_replay(spark, slices):
    rng = random.Random(slices)
    rows, log, at = [], [], {}
    for i in range(400):
        user = "hot" if rng.random() < 0.7 else rng.choice("ab")
        at[user] = at.get(user, 0) + rng.randrange(20, 3000)
        text = rng.choice(["x", " x", "y", "z\n1", "z 1", "X"])
        rows.append(run(i, text, user=user, at=at[user]))
        log += events(i, text, at[user], at[user] + 10, user=user)
    runs = spark.createDataFrame(rows, RUN)
    got = h.compact_consecutive(runs, h.OWNER, slices).collect()
    want = replay(log, 10**9)
    for (user, _), entries in want.items():
        mine = sorted((r for r in got if r.user == user), key=lambda r: -r.started_at)
        assert [(r.id, r.statement, r.execution_count) for r in mine] == [
            (e["id"], e["statement"], e["execution_count"]) for e in entries
        ]
    assert sum(r.execution_count for r in got) == 400


@pytest.mark.parametrize("slices", [1, 2, 5, 60])
def test_unfinished_runs_between_slices(spark, slices):
    """A group that begins with a running run never joins the one before, in any slice."""
    rng = random.Random(7)
    rows = [run(i, rng.choice("xxy"), rng.choice(["FINISHED", "FINISHED", "RUNNING"])) for i in range(120)]
    want, before = [], None
    for i, row in enumerate(rows):
        entry = dict(zip([c.split()[0] for c in RUN.split(", ")], row))
        if before and before["statement"] == entry["statement"] and entry["state"] != "RUNNING":
            want[-1] = (entry["id"], want[-1][1] + 1)
        else:
            want.append((entry["id"], 1))
        before = entry
    got = h.compact_consecutive(spark.createDataFrame(rows, RUN), h.OWNER, slices).orderBy("started_at").collect()
    assert [(r.id, r.execution_count) for r in got] == want


def test_error_class_stands_for_a_missing_message(spark):
    log = spark.createDataFrame(events(1, "a", 1, 2, "fail"), LOG)
    named = log.withColumn("error_class", F.when(F.col("kind") == "fail", "TimeoutException"))
    assert [r.error for r in h.fold_runs(named).collect()] == ["TimeoutException"]


def test_sessions_without_operations_have_totals(spark):
    operations = spark.createDataFrame([("s1", "RUNNING", 2)], "session string, state string, execution_count long")
    snapshots = spark.createDataFrame(
        [("s2", "e", 5, 7, "main", 4)],
        "session string, engine_id string, opened_at long, total_operations long, engine_name string, pool_size int",
    )
    got = {r.session: r for r in h.session_totals(operations, snapshots).collect()}
    assert (got["s1"].total, got["s1"].running, got["s1"].engine_name) == (2, 2, None)
    assert (got["s2"].total, got["s2"].finished, got["s2"].pool_size) == (7, 0, 4)


def test_cap_is_99_after_a_merge(spark):
    rows = [run(i, f"s{i}") for i in range(101)]
    size = lambda rows: h.cap_history(h.compact_consecutive(spark.createDataFrame(rows, RUN))).collect()
    assert len(size(rows)) == 100
    merged = size(rows + [run(101, "s100")])
    assert len(merged) == 99 and max(merged, key=lambda r: r.started_at).execution_count == 2
    assert len(size(rows + [run(101, "s100"), run(102, "new")])) == 100
    log = [e for i in range(102) for e in events(i, f"s{min(i, 100)}", i * 1000, i * 1000 + 10)]
    assert sorted(r.id for r in merged) == sorted(e["id"] for e in replay(log)[("alice", "trino")])


def test_lookup_and_markers(spark):
    entries = spark.createDataFrame([run(1, "a"), run(2, "b")], RUN)
    ids = spark.createDataFrame([("q0001",), ("nope",), ("nope",)], "id string")
    assert [tuple(r) for r in h.statement_lookup(entries, ids).collect()] == [("q0001", "a")]
    assert [r.id for r in h.unknown_ids(entries, ids).collect()] == ["nope"]
    runs = spark.createDataFrame(
        [("s", "a", 1, True, True), ("s", "b", 2, True, False), ("s", "c", 3, False, True), ("t", "d", 1, True, False), ("t", "e", 2, True, False)],
        "session string, id string, started_at long, ok boolean, has_rows boolean",
    )
    assert {r.session: r.id for r in h.last_result_marker(runs).collect()} == {"s": "a", "t": "e"}


def test_session_totals(spark):
    operations = spark.createDataFrame(
        [("s", "pending", 1), ("s", "RUNNING_STATE", 2), ("s", "FINISHED", 3), ("s", "ERROR_STATE", 4), ("s", "Canceled", 5), ("t", "TIMEDOUT", 1)],
        "session string, state string, execution_count int",
    )
    snapshots = spark.createDataFrame([("t", "e", 9, 40)], "session string, engine_id string, opened_at long, total_operations long")
    rows = {r.session: r for r in h.session_totals(operations, snapshots).collect()}
    assert tuple(rows["s"])[1:] == (None, 0, 15, 1, 2, 3, 9)
    assert tuple(rows["t"])[1:] == ("e", 9, 40, 0, 0, 0, 0)


def test_stream_replays_overlapping_runs_over_several_batches(spark, tmp_path):
    rng = random.Random(11)
    log, clock = [], 0
    for i in range(150):
        clock += rng.randrange(1, 40)
        end = None if rng.random() < 0.05 else clock + rng.randrange(1, 120)
        log += events(i, rng.choice(["x", " x ", "y"]), clock, end, rng.choice(["finish", "fail"]), rng.choice("ab"))
    log.sort(key=lambda e: (e[4], e[5]))
    for n in range(0, len(log), 60):  # one file per micro-batch, in time order
        df = spark.createDataFrame(log[n : n + 60], LOG).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    versions = drain(stream_runs(stream, n=20), "runs")
    got = latest_history(versions).collect()
    for (user, _), entries in replay(log, 20).items():
        mine = {r.id: (r.state, r.execution_count, r.completed_at) for r in got if r.user == user}
        assert mine == {e["id"]: (e["state"], e["execution_count"], e["completed_at"]) for e in entries}


def test_stream_marks_late_events(spark, tmp_path):
    for batch in (events(2, "b", 100, 110), events(1, "a", 50, 60)):
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    versions = drain(stream_runs(stream), "runs").cache()
    assert versions.where("change = 'late' and state = 'LATE'").count() == 2
    assert [r.id for r in latest_history(versions).collect()] == ["q0002"]


def test_stream_emits_changed_entries_only(spark, tmp_path):
    """A long history is not written again for one event; equal neighbours and the oldest entry are taken away."""
    batches = [
        [e for i in range(40) for e in events(i, f"s{i}", 10 * i, 10 * i + 5)],
        events(40, "s39", 1000, 1005) + events(41, "other", 1010, 1015),
    ]
    for n, batch in enumerate(batches):
        folder = tmp_path / "log" / f"part={n}"
        spark.createDataFrame(batch, LOG).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "part=*"))
    changes = drain(stream_runs(stream, n=40), "runs").cache()
    assert changes.where("version = 1").count() == 40
    second = {r.number: (r.change, r.execution_count) for r in changes.where("version = 2").collect()}
    # The start of 40 pushes out 0, its end takes in 39; then 41 finds room.
    assert second == {0: ("removed", None), 39: ("removed", None), 40: ("set", 2), 41: ("set", 1)}
    assert {r.id for r in latest_history(changes).collect()} == {f"q{i:04d}" for i in range(1, 42)} - {"q0039"}


class _Held:
    """State of one owner in memory; counts what is written."""

    def __init__(self):
        self.value, self.pages, self.calls = None, {}, 0

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        return self.pages.get(key)

    def updateValue(self, key, value):
        self.pages[key], self.calls = value, self.calls + 1

    def removeKey(self, key):
        self.pages.pop(key, None)
        self.calls += 1


def test_stream_writes_few_pages_an_owner():
    """A batch that fills a history writes its entries with two calls of the state at most."""
    events = [
        ("u", "e", f"q{i}", f"SELECT {i}", 10 * i + k, k, kind, None, [])
        for i in range(100)
        for k, kind in enumerate(("start", "finish"))
    ]
    columns = ["user", "engine", "id", "statement", "event_time", "seq", "kind", "error", "logs"]
    frame = pd.DataFrame(events[::-1], columns=columns)
    runs, held = Runs(100), _Held()
    runs.order = runs.stored = held
    (first,) = runs.handleInputRows(("u", "e"), iter([frame.iloc[:150], frame.iloc[150:]]), None)
    assert held.calls <= 2 and held.value[:3] == (1, 991, 100)
    assert first["id"].tolist() == [f"q{i}" for i in range(100)] and set(first["change"]) == {"set"}
    later = frame.assign(event_time=frame["event_time"] + 2000, id=frame["id"] + "x", statement=frame["statement"] + " x")
    (second,) = runs.handleInputRows(("u", "e"), iter([later]), None)
    assert held.calls <= 6 and second["change"].value_counts().to_dict() == {"removed": 100, "set": 100}
    assert sum(len(page[0]) for page in held.pages.values()) == 100
