from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakeops.operators import analytics, reconcile as rec, results
from lakeops.sources import lakehouse as lake


def test_city_orders_golden(spark):
    rows = analytics.city_orders(lake.orders(spark), lake.customers(spark)).collect()
    assert [tuple(r) for r in rows] == [
        ("Novosibirsk", 200, Decimal("100370.00")),
        ("Moscow", 200, Decimal("100200.00")),
        ("Kazan", 200, Decimal("99960.00")),
        ("Yekaterinburg", 200, Decimal("99790.00")),
        ("SPb", 200, Decimal("99620.00")),
    ]


def test_city_item_revenue_golden(spark):
    rows = analytics.city_item_revenue(
        lake.order_items(spark), lake.orders(spark), lake.customers(spark)
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("SPb", 5000, Decimal("534550.00")),
        ("Moscow", 4000, Decimal("415640.00")),
        ("Yekaterinburg", 3000, Decimal("302730.00")),
        ("Novosibirsk", 2000, Decimal("195820.00")),
        ("Kazan", 1000, Decimal("95090.00")),
    ]


def test_repeated_orders_count_once_but_add_up(spark):
    orders = lake.orders(spark, 10, 5)
    twice = orders.unionByName(orders)
    row = analytics.city_orders(twice, lake.customers(spark, 5)).agg(F.sum("orders")).first()
    assert row[0] == 10


def test_boundary_queries_golden(spark):
    for variant in ("generated", "canonical"):
        rows = lake.interop_values(spark, variant)
        assert tuple(analytics.boundary_aggregate(rows).first()) == (5, -1, 4)
        assert analytics.boundary_timestamp_count(rows).first()[0] == 4
    assert rec.query_shape_check(rows, (5, -1, 4), 4).agg(F.every("passed")).first()[0]
    assert not rec.query_shape_check(rows, (5, -1, 4), 3).agg(F.every("passed")).first()[0]


def test_variants_differ_in_row_five(spark):
    of = lambda name: {r.id: r.double_value for r in lake.interop_values(spark, name).collect()}
    assert of("generated")[5] == 0.0 and of("canonical")[5] == 1.0e-12
    with pytest.raises(ValueError):
        lake.interop_values(spark, "other")


def test_write_lakehouse_is_repeatable_and_cleans(spark):
    for _ in range(2):
        lake.write_lakehouse(spark, "shop", (10, 20, 40))
        counts = lake.table_row_counts({t: spark.table(f"shop.{t}") for t in lake.TABLES})
        assert dict(tuple(r) for r in counts.collect()) == {
            "customers": 10,
            "orders": 20,
            "order_items": 40,
            "temporal_values": 1,
            "interop_anomaly_values": 6,
        }
    row = spark.table("shop.temporal_values").first()
    assert str(row.event_date) == "1900-01-01"
    lake.write_lakehouse(spark, "shop", mode="clean")
    assert spark.sql("SHOW TABLES IN shop").count() == 0


def test_failed_write_leaves_the_old_lakehouse(spark, monkeypatch):
    lake.write_lakehouse(spark, "kept", (10, 20, 40))
    broken = lambda *sizes: spark.range(1).select(F.raise_error(F.lit("lost")).alias("item_id"))
    with monkeypatch.context() as patched:
        patched.setattr(lake, "order_items", broken)
        with pytest.raises(Exception, match="lost"):
            lake.write_lakehouse(spark, "kept", (1, 2, 4))
    assert {r.tableName for r in spark.sql("SHOW TABLES IN kept").collect()} == set(lake.TABLES)
    assert [spark.table(f"kept.{t}").count() for t in ("customers", "orders", "order_items")] == [10, 20, 40]
    lake.write_lakehouse(spark, "kept", (1, 2, 4))
    assert [spark.table(f"kept.{t}").count() for t in ("customers", "orders", "order_items")] == [1, 2, 4]
    lake.write_lakehouse(spark, "kept", mode="clean")


def test_row_count_gate(spark):
    assert tuple(lake.assert_row_count(spark.range(6), 6).first()) == (6, 6)
    with pytest.raises(Exception, match="expected 7 rows, got 6"):
        lake.assert_row_count(spark.range(6), 7).collect()


def test_interop_matrix_golden(spark, tmp_path):
    verdicts = rec.interop_matrix(spark, lake.interop_values(spark, "canonical"), str(tmp_path)).collect()
    assert len(verdicts) == 12
    assert all(v.passed for v in verdicts), verdicts


def test_interop_matrix_failed_writer_counts_for_all_its_readers(spark, tmp_path):
    verdicts = rec.interop_matrix(
        spark, lake.interop_values(spark), str(tmp_path), ("parquet", "nosuch", "orc")
    )
    failed = {(v.writer, v.reader): v.detail.split(":")[0] for v in verdicts.where("NOT passed").collect()}
    assert failed == {
        ("nosuch", "orc"): "writer failed",
        ("nosuch", "parquet"): "writer failed",
        ("parquet", "nosuch"): "reader failed",
        ("orc", "nosuch"): "reader failed",
    }


def test_interop_matrix_finds_a_lossy_writer(spark, tmp_path):
    """A format that loses microseconds fails where it writes first or takes over, and nowhere else."""

    def write(df, path, fmt):
        lossy = df.withColumn("event_timestamp", F.date_trunc("second", "event_timestamp")) if fmt == "json" else df
        rec.write_format(lossy, path, fmt)

    found = rec.interop_matrix(spark, lake.interop_values(spark, "canonical"), str(tmp_path), write=write).collect()
    assert {(v.writer, v.reader): v.passed for v in found} == {
        (w, r): "json" not in (w, r) for w in rec.FORMATS for r in rec.FORMATS if w != r
    }
    assert {v.mismatches for v in found if not v.passed} == {3} and {v.rows for v in found} == {6}
    assert {v.detail for v in found if not v.passed} == {"boundary_timestamp_count,rows"}


def test_interop_matrix_without_rows(spark, tmp_path):
    found = rec.interop_matrix(spark, lake.interop_values(spark).limit(0), str(tmp_path), ("parquet", "csv")).collect()
    assert [(v.rows, v.mismatches) for v in found] == [(0, 0)] * 2


@pytest.mark.parametrize("fmt", rec.FORMATS)
def test_written_formats_are_compressed_in_bounded_files(spark, tmp_path, monkeypatch, fmt):
    monkeypatch.setattr(rec, "FILE_ROWS", 400)
    rows = spark.range(1000, numPartitions=1).withColumn("text", F.lit("the same words again, " * 10 + "end"))
    rec.write_format(rows, str(tmp_path / fmt), fmt)
    files = [f for f in (tmp_path / fmt).iterdir() if f.name.startswith("part-")]
    assert len(files) == 3 and all(rec.COMPRESSION[fmt][:2] in f.name.partition(".")[2] for f in files)
    assert sum(f.stat().st_size for f in files) < 40_000
    assert rec.read_format(spark, str(tmp_path / fmt), fmt, rows.schema).exceptAll(rows).isEmpty()


def _boundary(spark, **changes):
    rows = lake.interop_values(spark, "canonical").withColumn("writer", F.lit("w"))
    for name, value in changes.items():
        kind = rows.schema[name].dataType
        rows = rows.withColumn(name, F.when(F.col("id") == 5, F.lit(value).cast(kind)).otherwise(F.col(name)))
    return rows


@pytest.mark.parametrize(
    "changes, columns",
    [
        ({}, []),
        ({"double_value": 0.0}, []),  # within the absolute tolerance
        ({"double_value": 2.1e-12}, ["double_value"]),
        ({"string_col": "x"}, ["string_col"]),
        ({"decimal_value": "1.230001"}, ["decimal_value"]),
        ({"event_date": "1900-01-02"}, ["event_date"]),
        ({"event_timestamp": "1900-01-01 00:00:00.000001"}, ["event_timestamp"]),
        ({"int_value": None, "writer": "v"}, ["int_value", "writer"]),
    ],
)
def test_reconcile_rules(spark, changes, columns):
    diff = rec.reconcile(_boundary(spark), _boundary(spark, **changes), ["id"], rec.BOUNDARY_RULES)
    found = diff.collect()
    assert sorted(r["column"] for r in found) == columns
    assert all(r.id == 5 and r.reason == "mismatch" for r in found)


def test_reconcile_strict_missing_extra_and_null_keys(spark):
    rows = _boundary(spark)
    strict = rec.reconcile(rows, _boundary(spark, double_value=0.0), ["id"], rec.BOUNDARY_RULES, strict=True)
    assert [r["column"] for r in strict.collect()] == ["double_value"]
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    right = spark.createDataFrame([(None, "b"), (3, "d"), (4, "e")], "k int, x string")
    found = {(r.k, r["column"], r.reason) for r in rec.reconcile(left, right, ["k"]).collect()}
    assert found == {(1, "*", "missing"), (3, "x", "mismatch"), (4, "*", "extra")}
    assert not rec.reconcile_passed(rec.reconcile(left, right, ["k"])).first().passed


def test_normalise_timestamps(spark):
    texts = ["2026-08-20T10:20:30.654321Z", "1900-01-01 00:00:00", "1582-10-15 23:59:59.999999000"]
    df = spark.createDataFrame([(t,) for t in texts], "event_timestamp string")
    assert [r[0] for r in rec.normalise_timestamps(df).collect()] == [
        "2026-08-20 10:20:30.654321",
        "1900-01-01 00:00:00.000000",
        "1582-10-15 23:59:59.999999",
    ]


def test_rows_as_json_keeps_nulls_and_the_last_of_equal_labels(spark):
    df = spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b, 2 AS a")
    assert results.rows_as_json(df).first()[0] == '{"a":2,"b":null}'


def test_sql_rows(spark):
    assert results.sql_rows(spark, "SELECT * FROM range(5000)").count() == 1000
    assert results.sql_rows(spark, "DROP TABLE IF EXISTS none_such").collect()[0].message == "OK"
    with pytest.raises(ValueError):
        results.bounded(spark.range(1), 0)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export(spark, tmp_path, fmt):
    df = spark.range(10).select("id", (F.col("id") > 4).alias("big"), F.lit(None).cast("int").alias("none"))
    results.export(df, str(tmp_path / fmt), fmt, max_rows=7)
    reader = spark.read.schema("id double, big boolean, none double").option("header", True)
    back = reader.format(fmt).load(str(tmp_path / fmt))
    assert back.count() == 7 and back.agg(F.sum("id")).first()[0] == 21.0


def test_export_cells_of_nested_values(spark):
    df = spark.sql("SELECT array(1, 2) AS xs, DATE'2024-01-02' AS d, 3 AS n, true AS b")
    assert tuple(results.export_cells(df).first()) == ("[1,2]", "2024-01-02", 3.0, True)
