import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import jobs as j

APP = "id string, name string, user string, start_time string, end_time string, duration_ms long, completed boolean, version string"


def app(id, user="u", name="n", start="2024-01-01T00:00:00.000GMT", ms=0, done=True):
    return (id, name, user, start, "", ms, done, "v")


def apps(spark, *rows):
    return spark.createDataFrame(list(rows), APP)


def test_flatten_applications(spark):
    docs = [
        ('{"id":"a","name":"n","attempts":[{"sparkUser":"u","startTime":"s","endTime":"e","duration":5,"completed":true,"appSparkVersion":"4"},{"sparkUser":"old"}]}',),
        ('{"id":"b","name":"m","attempts":[]}',),
        ('{"id":"c"}',),
    ]
    got = j.flatten_applications(spark.createDataFrame(docs, "json string")).collect()
    assert [tuple(r) for r in got] == [
        ("a", "n", "u", "s", "e", 5, True, "4"),
        ("b", "m", "", "", "", 0, False, ""),
        ("c", "", "", "", "", 0, False, ""),
    ]


OVERVIEW = '{"jobs":[{"jid":"abc","name":"wordcount","state":"RUNNING","start-time":1000,"end-time":-1,"duration":5000},{"jid":"def","name":"done","state":"FINISHED","start-time":2000,"end-time":2500,"duration":500}]}'


def test_job_overview_golden(spark):
    docs = spark.createDataFrame([(OVERVIEW,), ("",), (None,)], "json string")
    running = j.flatten_job_overview(docs, True).collect()
    assert [(r.id, r.completed, r.duration_ms, r.end_time, r.user) for r in running] == [("flink-abc", False, 5000, "", "")]
    ended = j.flatten_job_overview(docs, False).collect()
    assert [(r.id, r.completed, r.end_time) for r in ended] == [("flink-def", True, "1970-01-01T00:00:02.500Z")]
    assert j.flatten_job_overview(docs.limit(0), True).count() == 0


def test_owner_rules(spark):
    history = apps(spark, app("own", "analyst"), app("foreign", "admin"))
    ids = lambda *args: [r.id for r in j.visible_applications(history.limit(0), history, *args).collect()]
    assert ids("analyst", False, "admin") == ["own"]
    assert ids("admin", True, "admin") == ["foreign"]
    assert sorted(ids("admin", True, " ")) == sorted(ids("admin", True)) == ["foreign", "own"]


def test_limit_comes_before_the_owner_filter(spark):
    rows = [app(f"a{i}", "u" if i % 2 else "v", start=f"2024-01-0{i}") for i in range(1, 7)]
    newest = j.recent_applications(apps(spark, *rows), 3)
    assert [r.id for r in newest.collect()] == ["a6", "a5", "a4"]
    assert [r.id for r in j.visible_applications(newest.limit(0), newest, "u", False).collect()] == ["a5"]
    assert j.recent_applications(apps(spark, *rows), 0).count() == 1
    assert j.recent_applications(apps(spark, *rows), 500, "2024-01-05").count() == 2


def test_live_applications(spark):
    sessions = spark.createDataFrame([("1", "s", "u", "READY", 1000), ("2", "s", "u", "FAILED", 0), ("3", "s", "u", "STARTING", 9000)], "id string, name string, user string, state string, created_at long")
    got = j.live_applications(sessions, 5000).collect()
    assert [(r.id, r.duration_ms, r.start_time, r.completed) for r in got] == [
        ("kyuubi-1", 4000, "1970-01-01T00:00:01Z", False),
        ("kyuubi-3", 0, "1970-01-01T00:00:09Z", False),
    ]


JOB = "0123456789abcdef0123456789abcdef"
ENTRY = "user string, id string, statement string, started_at long, completed_at long, state string, logs array<string>"


def test_merge_order_and_job_ids(spark):
    entries = spark.createDataFrame(
        [("analyst", "query-1", "SELECT 1", 1000, 3500, "FINISHED", []), ("analyst", "q2", "SELECT 2", 9000, 0, "RUNNING", [f"Submitting job 'SELECT 1' ({JOB})."])],
        ENTRY,
    )
    queries = j.queries_as_jobs(entries)
    rows = {r.id: r for r in queries.collect()}
    assert set(rows) == {"kyuubi-flink-query-query-1", f"flink-{JOB}"}
    assert (rows[f"flink-{JOB}"].end_time, rows[f"flink-{JOB}"].duration_ms, rows[f"flink-{JOB}"].completed) == ("", 0, False)
    assert rows["kyuubi-flink-query-query-1"].duration_ms == 2500
    engines = apps(spark, app("kyuubi-flink-analyst", "analyst"))
    running = apps(spark, app("flink-run", ""), app(f"flink-{JOB}", "", name="again"))
    completed = apps(spark, app("flink-done", ""), app("flink-run", "", name="late"))
    merged = j.merged_jobs(engines, queries, running, completed, True).orderBy("source_rank", "id").collect()
    assert [(r.id, r.source_rank) for r in merged] == [
        ("kyuubi-flink-analyst", 0), (f"flink-{JOB}", 1), ("kyuubi-flink-query-query-1", 1), ("flink-run", 2), ("flink-done", 3),
    ]
    assert {r.name for r in merged if r.id == "flink-run"} == {"n"}
    assert j.merged_jobs(engines, queries, running, completed, False, "analyst").count() == 3
    asked = spark.createDataFrame([("analyst", False, JOB), ("analyst", False, "f" * 32), ("eve", False, JOB), ("root", True, "x")], "user string, is_admin boolean, job_id string")
    allowed = {(r.user, r.job_id): r.allowed for r in j.can_open_job(asked, entries).collect()}
    assert allowed == {("analyst", JOB): True, ("analyst", "f" * 32): False, ("eve", JOB): False, ("root", "x"): True}


def test_can_view(spark):
    asked = spark.createDataFrame([("u", False, "a"), ("v", False, "a"), ("u", False, "none"), ("r", True, "none")], "user string, is_admin boolean, app_id string")
    got = {(r.user, r.app_id): r.allowed for r in j.can_view(asked, apps(spark, app("a", "u"))).collect()}
    assert got == {("u", "a"): True, ("v", "a"): False, ("u", "none"): False, ("r", "none"): True}


def test_search_range_and_state(spark):
    rows = apps(spark, app("ID-1", name="Count Words", start="2024-01-05T10:00:00.000GMT"), app("id-2", name="other", start="2024-01-07T10:00:00.000GMT", done=False))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(j.search(rows, " WORDS id-1 2024-01-05 10 ")) == ["ID-1"]
    assert ids(j.search(rows, "")) == ["ID-1", "id-2"]
    assert ids(j.date_range(rows, upper="2024-01-05")) == ["ID-1"]
    assert ids(j.date_range(rows, last_days=1, today="2024-01-08")) == ["id-2"]
    assert ids(j.state_filter(rows, "running")) == ["id-2"] and ids(j.state_filter(rows, "completed")) == ["ID-1"]
    assert tuple(j.state_counts(rows).first()) == (1, 1)
    with pytest.raises(ValueError):
        j.state_filter(rows, "lost")


def test_sort_is_stable_and_follows_the_language(spark):
    rows = apps(spark, app("1", name="b", ms=5), app("2", name="A", ms=5), app("3", name="a", ms=9, done=False), app("4", name="B", ms=1))
    ids = lambda *args: [r.id for r in j.sort_by(rows, *args).collect()]
    assert ids("name", "asc") == ["3", "2", "1", "4"]
    assert ids("duration_ms", "desc") == ["3", "1", "2", "4"]
    assert ids("duration_ms", "asc") == ["4", "1", "2", "3"]
    assert ids("completed", "asc") == ["3", "1", "2", "4"]
    with pytest.raises(ValueError):
        ids("name", "up")


def test_pages(spark):
    rows = spark.range(53).select(
        F.format_string("a%02d", "id").alias("id"), F.lit("n").alias("name"), F.lit("s").alias("start_time"), F.lit(True).alias("completed")
    )
    page = j.page_of(rows, 3)
    assert (page.page, page.pages, page.first, page.last, page.total) == (3, 3, 51, 53, 53)
    assert [r.id for r in page.rows.collect()] == ["a50", "a51", "a52"]
    assert j.page_of(rows, 99).page == 3
    empty = j.page_of(rows.limit(0), 2)
    assert (empty.page, empty.pages, empty.first, empty.last, empty.total) == (1, 1, 0, 0, 0)
    seen = [r.id for n in (1, 2, 3) for r in j.page_of(rows, n).rows.collect()]
    assert seen == sorted(seen) and len(set(seen)) == 53


@pytest.mark.parametrize("key, direction", [("n", "desc"), ("name", "asc"), ("x", "desc")])
def test_far_pages_read_only_their_ranges(spark, monkeypatch, key, direction):
    """Pages of a table that is cut into ranges are those of the sorted table: nulls, ties and NaN included."""
    rng = random.Random(key + direction)
    names = [None, "", "a", "B", "b", "é", "Zz", *[f"job {i}" for i in range(60)]]
    numbers = [None, *range(40)]
    doubles = [None, float("nan"), -0.5, *[i / 7 for i in range(90)]]
    rows = [(f"id{i:04}", rng.choice(numbers), rng.choice(names), rng.choice(doubles)) for i in range(400)]
    rows += [(f"tie{i:04}", 7, "job 7", 1.0) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, n int, name string, x double").repartition(4)
    expected = [r.id for r in j.sort_by(df, key, direction).collect()]
    monkeypatch.setattr(j, "PAGE_SORT_ROWS", 100)
    monkeypatch.setattr(j, "PAGE_RANGES", 16)
    for page in (1, 9, 22, 99):
        found = j.page_of(df, page, 25, key, direction)
        at = (found.page - 1) * 25
        assert [r.id for r in found.rows.collect()] == expected[at : at + 25], page
        assert (found.pages, found.total) == (22, 550)
