"""The audit folder that expires its days, beside the batch rule."""

import datetime

import pytest
from pyspark.sql import functions as F

from lakeops.operators.audit import roll_audit
from lakeops.streaming.retention import held_days, read_retained, retain_audit_stream, retained_writer

SCHEMA = "day date, line string"


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def events(spark, rows):
    return spark.createDataFrame([(None if n is None else day(n), line) for n, line in rows], SCHEMA)


def lines(spark, path):
    return sorted((r.day, r.line) for r in read_retained(spark, path).collect())


BATCHES = [
    [(0, "a"), (0, "b"), (1, "c"), (None, "lost")],
    [(1, "d"), (5, "e"), (2, "f")],
    [(9, "g"), (3, "expired on arrival"), (8, "h")],
    [(9, "g"), (7, "i")],
]


def test_days_leave_the_folder_and_a_replay_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    write = retained_writer(path, days=4)
    for number, rows in enumerate(BATCHES):
        write(events(spark, rows), number)
        kept = roll_audit(events(spark, [r for part in BATCHES[: number + 1] for r in part]), 4).where("line NOT LIKE 'expired%'")
        expected = sorted((r.day, r.line) for r in kept.collect())
        assert lines(spark, path) == expected
        write(events(spark, rows), number)
        assert lines(spark, path) == expected
        assert set(held_days(spark, path)) == {d for d, _ in expected}


def test_size_bound_takes_whole_days(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [(0, "x" * 9), (1, "y" * 9), (1, "z" * 9), (2, "w" * 99)]
    write = retained_writer(path, days=10, max_bytes=120)
    write(events(spark, rows), 0)
    assert lines(spark, path) == sorted((r.day, r.line) for r in roll_audit(events(spark, rows), 10, 120, "line").collect())
    assert set(held_days(spark, path)) == {day(1), day(2)}
    retained_writer(path, days=10, max_bytes=1)(events(spark, []), 1)
    assert set(held_days(spark, path)) == {day(2)}


def test_no_events_and_refused_bounds(spark, tmp_path):
    retained_writer(str(tmp_path / "days"))(events(spark, []), 0)
    assert held_days(spark, str(tmp_path / "days")) == {}
    with pytest.raises(ValueError):
        retained_writer(str(tmp_path / "days"), days=0)


def test_as_a_stream_that_starts_again(spark, tmp_path):
    source, path = tmp_path / "source", str(tmp_path / "days")
    for number, rows in enumerate(BATCHES):
        events(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        running = retain_audit_stream(stream, path, str(tmp_path / "checkpoint"), days=4, available_now=True)
        running.awaitTermination()
    assert lines(spark, path) == [(day(7), "i"), (day(8), "h"), (day(9), "g"), (day(9), "g")]
    assert read_retained(spark, path).where(F.col("day") < F.lit(day(6))).isEmpty()
