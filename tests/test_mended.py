"""Cases of single operators: repeats, exact decimals, refused limits, file order, dotted names."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import jobs as j
from lakeops.operators import reconcile as rec
from lakeops.operators import results
from lakeops.operators import widestore as ws
from lakeops.operators.numbering import number_rows


def diff(spark, left, right, kind="string", rule="exact"):
    fields = f"k int, v {kind}"
    found = rec.reconcile(spark.createDataFrame(left, fields), spark.createDataFrame(right, fields), ["k"], {"v": rule})
    return sorted((r.k if r.k is not None else -1, r.reason) for r in found.collect())


def test_reconcile_repeated_and_null_keys(spark):
    rows = [(1, "a"), (1, "b"), (1, "b"), (None, "n"), (None, None)]
    assert diff(spark, rows, rows[::-1]) == []
    assert diff(spark, rows, rows[:2] + rows[3:]) == [(1, "missing")]
    assert diff(spark, rows, [*rows, (None, "x")]) == [(-1, "extra")]
    assert diff(spark, [(1, "a"), (1, "c")], [(1, "a"), (1, "d")]) == [(1, "mismatch")]
    assert diff(spark, [], rows[:1]) == [(1, "extra")]


def test_reconcile_reads_only_unequal_buckets(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7).cast("string").alias("v"))
    right = left.withColumn("v", F.when(F.col("k") == 777, "x").otherwise(F.col("v"))).where("k <> 5")
    found = rec.reconcile(left, right, ["k"])
    assert sorted((r.k, r.reason, r.actual) for r in found.collect()) == [(5, "missing", None), (777, "mismatch", "x")]
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    same = rec.reconcile(left, left.orderBy(F.desc("k")), ["k"])
    assert same.count() == 0


def test_reconcile_places_of_nulls_and_nested_values(spark):
    fields = "k int, a int, b int, c array<int>"
    left = spark.createDataFrame([(1, None, 2, [None, 1]), (2, 1, 1, None)], fields)
    right = spark.createDataFrame([(1, 2, None, [1, None]), (2, 1, 1, None)], fields)
    assert sorted(r["column"] for r in rec.reconcile(left, right, ["k"]).collect()) == ["a", "b", "c"]


def test_reconcile_types_that_differ(spark):
    left = spark.createDataFrame([(1, 5, "7"), (2, 6, "8")], "k int, a int, b string")
    right = spark.createDataFrame([(1, 5.0, 7), (2, 6.5, 9)], "k long, a double, b int")
    assert sorted((r.k, r["column"]) for r in rec.reconcile(left, right, ["k"]).collect()) == [(2, "a"), (2, "b")]


@pytest.mark.parametrize("buckets", [1, 7])
def test_reconcile_copies_like_one_by_one(spark, buckets):
    rng = random.Random(buckets)
    source = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "a", "b"])) for _ in range(30)]
    copies = {"same": source[::-1], "none": [], "less": source[3:], "more": [*source, (9, "z"), (1, "a")]}
    fields = "k int, v string"
    given = spark.createDataFrame(source, fields)
    rows = spark.createDataFrame([(name, *row) for name, part in copies.items() for row in part], f"_copy string, {fields}")
    got = rec.reconcile_copies(given, rows, list(copies), ["k"], buckets=buckets).collect()
    for name, part in copies.items():
        alone = rec.reconcile(given, spark.createDataFrame(part, fields), ["k"]).collect()
        key = lambda r: (r.k or -1, r["column"], r.expected or "", r.actual or "", r.reason)
        assert sorted(key(r) for r in got if r["_copy"] == name) == sorted(map(key, alone)), name


def test_reconcile_decimals_exactly(spark):
    assert diff(spark, [(1, "0.12345678901")], [(1, "0.12345678902")], rule="decimal") == [(1, "mismatch")]
    long = "12345678901234567890123456789012345678"
    assert diff(spark, [(1, long)], [(1, long + ".000")], rule="decimal") == []
    assert diff(spark, [(1, "-0.50"), (2, "00.0"), (3, "+7")], [(1, "-.5".replace("-.", "-0.")), (2, "-0"), (3, "7.")], rule="decimal") == []


def test_limits_are_refused_and_exports_whole(spark, tmp_path):
    cells = spark.createDataFrame([], ws.CELLS_SCHEMA)
    for call in (lambda: ws.scan(cells, limit=1001), lambda: ws.page(cells, size=1000), lambda: ws.autocomplete(cells, limit=0)):
        with pytest.raises(ValueError, match="can be asked for"):
            call()
    with pytest.raises(ValueError, match="can be asked for"):
        j.recent_applications(spark.createDataFrame([], "id string, start_time string"), 5001)
    results.export(spark.range(120_000), str(tmp_path / "all"))
    assert spark.read.option("header", True).csv(str(tmp_path / "all")).count() == 120_000


def test_grid_with_dots_and_backticks(spark):
    now = datetime.datetime(2024, 1, 1)
    rows = [(b"r", "cf:a.b", now, 1, b"x", False), (b"s", "cf:q`t", now, 1, b"y", False)]
    grid = ws.to_grid(ws.latest_cells(spark.createDataFrame(rows, ws.CELLS_SCHEMA)))
    got = {r["row_key"]: (r["cf:a.b"], r["cf:q`t"]) for r in grid.collect()}
    assert got == {"r": ("x", ""), "s": ("", "y")}


def test_bulk_files_in_order_of_their_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("key,cf:v\nk,first\n")
    (tmp_path / "z.csv").write_text("key,cf:v\n" + "".join(f"n{i},{'x' * 50}\n" for i in range(500)) + "k,second\n")
    cells = ws.bulk_load(spark, str(tmp_path), "2024-01-01")
    live = ws.latest_cells(cells).where(F.col("row_key") == F.lit(b"k"))
    assert [bytes(r.value) for r in live.collect()] == [b"second"]
    assert ws.rows_written(ws.read_bulk_csv(spark, str(tmp_path))).first()[0] == 502


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(50)))
    got = number_rows(df, [F.col("v"), F.col("id")], "n", 7).orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 1001))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)
    assert number_rows(df.limit(0), [F.col("v")]).count() == 0


def test_day_bounds_reach_the_scan(spark, tmp_path):
    apps = spark.createDataFrame([("a", "2024-01-01T23:59:59.999GMT"), ("b", "2024-01-02T00:00:00.000GMT")], "id string, start_time string")
    apps.write.parquet(str(tmp_path / "apps"))
    stored = spark.read.parquet(str(tmp_path / "apps"))
    day = j.date_range(stored, "2024-01-01", "2024-01-01")
    assert [r.id for r in day.collect()] == ["a"]
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(start_time" in plan and "GreaterThanOrEqual(start_time" in plan


def test_job_pages_need_an_engine_or_a_recorded_job(spark):
    job = "0123456789abcdef0123456789abcdef"
    requests = spark.createDataFrame([("admin", True), ("live", False), ("ran", False), ("none", False)], "user string, is_admin boolean")
    live = spark.createDataFrame([("live",)], "user string")
    entries = spark.createDataFrame([("ran", [f"Submitting job 'SELECT 1' ({job})."]), ("none", ["nothing"])], "user string, logs array<string>")
    got = {r.user: r.allowed for r in j.can_use_job_ui(requests, live, entries).collect()}
    assert got == {"admin": True, "live": True, "ran": True, "none": False}
