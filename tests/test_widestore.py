import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import widestore as ws


def make(spark, rows):
    """Cells from ``(key, column, second, value)``; a value of ... is a tombstone."""
    data = [
        (ws.as_key(k), c, s, i, None if v is ... else ws.as_key(v), v is ...)
        for i, (k, c, s, v) in enumerate(rows)
    ]
    df = spark.createDataFrame(data, "row_key binary, column string, s long, seq long, value binary, deleted boolean")
    return df.select("row_key", "column", F.timestamp_seconds("s").alias("ts"), "seq", "value", "deleted")


def shown(df):
    return [(bytes(r.row_key), r.column, bytes(r.value).decode("latin1")) for r in df.collect()]


def test_latest_and_display_fixture(spark):
    cells = make(spark, [(b"\x00r/1", "cf:a", 12, "hello"), (b"\x00r/1", "cf:a", 11, "older"), (b"\x00r/1", "cf:b", 11, b"\x00\x01")])
    rows = {r.column: (r.row_key, r.value, r.binary) for r in ws.display_cells(ws.latest_cells(cells)).collect()}
    assert rows == {"cf:a": ("\\x00r/1", "hello", False), "cf:b": ("\\x00r/1", "AAE=", True)}


def test_lifecycle(spark):
    cells = make(spark, [])
    cells = ws.put_row(cells, "r1", {"cf:a": "old", "cf:remove": "x", "cf:none": None}, "2024-01-01", 1)
    cells = ws.put_row(cells, "r1", {"cf:a": "new"}, "2024-01-02", 2)
    assert [(r.version, bytes(r.value)) for r in ws.cell_versions(cells, "r1", "cf:a").collect()] == [(1, b"new"), (2, b"old")]
    keys = spark.sql("SELECT encode('r1', 'UTF-8') AS row_key, 'cf:remove' AS column, '2024-01-03' AS ts, 3L AS seq")
    after = ws.delete_cells(cells, keys)
    assert shown(ws.get_row(after, "r1")) == [(b"r1", "cf:a", "new"), (b"r1", "cf:none", "")]
    assert shown(ws.get_row(after, "r1", ["cf:a"])) == [(b"r1", "cf:a", "new")]
    gone = ws.delete_rows(after, keys.drop("column"))
    assert shown(ws.get_row(gone, "r1")) == [] and ws.first_keys(ws.latest_cells(gone), 5).count() == 0
    back = ws.put_row(gone, "r1", {"cf:a": "again"}, "2024-01-04", 4)
    assert [bytes(r.value) for r in ws.cell_versions(back, "r1", "cf:a").collect()] == [b"again"]


def test_put_without_cells_is_an_error(spark):
    cells = make(spark, [])
    with pytest.raises(ValueError):
        ws.put_row(cells, "r", {}, "2024-01-01", 1)
    empty = spark.sql("SELECT encode('r','UTF-8') AS row_key, CAST(NULL AS STRING) AS column, '2024-01-01' AS ts, 1L AS seq, encode('v','UTF-8') AS value")
    with pytest.raises(Exception, match="an update needs a column"):
        ws.put_rows(cells, empty).collect()


def test_scan_start_prefix_and_byte_order(spark):
    keys = [b"row_c", b"row_a", b"row_b", b"\xffz", b"\x00", b"\x7f", b"\xff\xff", b"row`"]
    cells = make(spark, [(k, "cf:a", 1, "v") for k in keys])
    order = [r[0] for r in shown(ws.scan(cells))]
    assert order == sorted(keys)
    assert [r[0] for r in shown(ws.scan(cells, "row_b", False, "row_"))] == [b"row_c"]
    assert [r[0] for r in shown(ws.scan(cells, prefix=b"\xff"))] == [b"\xffz", b"\xff\xff"]
    assert [r[0] for r in shown(ws.search_rows(cells, "row_a"))][:2] == [b"row_a", b"row_b"]
    assert [r[0] for r in shown(ws.search_rows(cells, "row_*"))] == [b"row_a", b"row_b", b"row_c"]
    with pytest.raises(ValueError):
        ws.scan(cells, limit=0)


def test_predicates(spark):
    cells = make(
        spark,
        [("a", "cf:q", 1, "5"), ("a", "cf:r", 1, "x"), ("b", "cf:q", 1, "7"), ("b", "cf:r", 1, "5"), ("c", "cf:r", 1, "5")],
    )
    of = lambda *p: [(k, c) for k, c, _ in shown(ws.scan(cells, predicates=list(p)))]
    assert of(ws.ValueEquals("5")) == [(b"a", "cf:q"), (b"b", "cf:r"), (b"c", "cf:r")]
    assert of(ws.ColumnValue("cf:q", "=", "5")) == [(b"a", "cf:q"), (b"a", "cf:r")]
    assert of(ws.ColumnValue("cf:q", ">", "5", keep_missing=True)) == [(b"b", "cf:q"), (b"b", "cf:r"), (b"c", "cf:r")]


def test_pages_cover_the_rows_exactly_once(spark):
    rng = random.Random(7)
    keys = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    rows = [(k, f"cf:{c}", 1, "v") for k in keys for c in range(rng.randrange(1, 4))]
    dead = sorted(keys)[::7]
    rows += [(k, c, 2, ...) for k, c, _, _ in rows if k in dead]
    cells = make(spark, rows).cache()
    seen, cursor = [], None
    for _ in range(20):
        page = ws.page(cells, cursor, size=9)
        keys_here = sorted({bytes(r.row_key) for r in page.rows.collect()})
        assert len(keys_here) <= 9
        seen += keys_here
        cursor = page.next_cursor
        if not page.has_next:
            assert cursor is None
            break
        assert cursor == keys_here[-1]
    assert seen == sorted(keys - set(dead))


def test_scan_goes_on_behind_many_deleted_rows(spark):
    rows = [(f"k{i:03}", "cf:a", 1, "v") for i in range(200)]
    rows += [(k, c, 2, ...) for k, c, _, _ in rows if "k005" < k < "k190"]
    cells = make(spark, rows).cache()
    keys = [k for k, _, _ in shown(ws.scan(cells, limit=8))]
    assert keys == [f"k{i:03}".encode() for i in [0, 1, 2, 3, 4, 5, 190, 191]]
    rest = ws.page(cells, cursor=b"k198", size=1)
    assert (shown(rest.rows), rest.has_next) == ([(b"k199", "cf:a", "v")], False)
    empty = ws.page(cells, cursor=b"k199")
    assert (empty.rows.count(), empty.has_next, empty.next_cursor) == (0, False, None)


def test_scan_reads_a_narrow_range(spark, tmp_path):
    make(spark, [(f"k{i:04}", "cf:a", 1, "v") for i in range(100)]).write.parquet(str(tmp_path / "cells"))
    plan = ws.scan(spark.read.parquet(str(tmp_path / "cells")), start="k0050", limit=3)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row_key" in text and "LessThanOrEqual(row_key" in text


def test_versions_against_brute_force(spark):
    rng = random.Random(3)
    rows = [
        (rng.choice("ab"), rng.choice(["cf:x", "cf:y"]), rng.randrange(30), ... if rng.random() < 0.15 else str(i))
        for i in range(120)
    ]
    cells = make(spark, rows).cache()
    for n in (1, 3, 50):
        expected = set()
        for cell in {(k, c) for k, c, _, _ in rows}:
            versions = sorted(((s, i, v) for i, (k, c, s, v) in enumerate(rows) if (k, c) == cell), reverse=True)
            for place, (_, i, value) in enumerate(versions[:n], start=1):
                if value is ...:
                    break
                expected.add((*cell, place, value))
        got = {
            (bytes(r.row_key).decode(), r.column, r.version, bytes(r.value).decode())
            for r in ws.cell_versions(cells, n=n).collect()
        }
        assert got == expected


def test_retention_against_brute_force(spark):
    rng = random.Random(5)
    families = {"a": (3, 1, 50), "b": (None, 2, 40), "c": (2, None, None), "d": (None, None, 30)}
    rows = [(rng.choice("kl"), f"{rng.choice('abcde')}:q", rng.randrange(100), str(i)) for i in range(300)]
    cells = make(spark, rows)
    table = spark.createDataFrame([(f, *v) for f, v in families.items()], "family string, max_versions int, min_versions int, ttl_seconds long")
    expected = set()
    for cell in {(k, c) for k, c, _, _ in rows}:
        most, least, ttl = families.get(cell[1][0], (None, None, None))
        versions = sorted(((s, i) for i, (k, c, s, _) in enumerate(rows) if (k, c) == cell), reverse=True)
        for place, (s, i) in enumerate(versions, start=1):
            if (most is None or place <= most) and (ttl is None or 100 - s <= ttl or place <= (least or 0)):
                expected.add(i)
    kept = ws.apply_retention(cells, table, "1970-01-01 00:01:40")
    assert {r.seq for r in kept.collect()} == expected
    assert kept.columns == cells.columns


def test_bulk_load_edge_file(spark, tmp_path):
    path = tmp_path / "bulk.csv"
    path.write_text('row,cf:a,cf:b\nr1,"x, ""q""\nline2",y\n\n,z,z\nr2,,\nr3,v\nr1,,again\n')
    rows = ws.read_bulk_csv(spark, str(path))
    assert ws.rows_written(rows).first()[0] == 3
    live = ws.latest_cells(ws.bulk_load(spark, str(path), "2024-01-01"))
    assert sorted(shown(live)) == [(b"r1", "cf:a", 'x, "q"\nline2'), (b"r1", "cf:b", "again"), (b"r3", "cf:a", "v")]


@pytest.mark.parametrize("content", ["row,cf:a\n", "row\nr1\n"])
def test_bulk_load_needs_a_header_and_a_row(spark, tmp_path, content):
    path = tmp_path / "bulk.csv"
    path.write_text(content)
    with pytest.raises(ValueError):
        ws.bulk_load(spark, str(path), "2024-01-01")


def test_grid(spark):
    rows = [("r1", f"cf:{i:02}", 1, "v" * (139 + i)) for i in range(4)] + [("r2", "cf:00", 1, b"\x00")]
    grid = ws.to_grid(ws.latest_cells(make(spark, rows)), max_columns=3).orderBy("row_key").collect()
    assert list(grid[0].asDict()) == ["row_key", "cf:00", "cf:01", "cf:02", "columns_shown", "columns_total"]
    assert grid[0]["cf:01"] == "v" * 140 and grid[0]["cf:02"] == "v" * 140 + "…"
    assert (grid[1]["cf:00"], grid[1]["cf:01"]) == ("⬡ binary", "")
    assert (grid[0].columns_shown, grid[0].columns_total) == (3, 4)


def test_generators(spark):
    tables = ws.generate_row_tables(spark, (1, 10))
    assert {n: df.count() for n, df in tables.items()} == {"gen_rows_1": 2, "gen_rows_10": 20}
    wide = ws.generate_wide_rows(spark, (3,))["gen_cols_3"]
    assert shown(wide) == [(b"wide", f"cf:c{i:05}", f"v{i}") for i in range(3)]
    tiny = ws.generate_tiny_tables(spark, 2).select("table", "row_key", "column").collect()
    assert [(r.table, bytes(r.row_key)) for r in tiny] == [("gen_tiny_0001", b"r0"), ("gen_tiny_0002", b"r0")]


def test_table_filter_and_autocomplete(spark):
    names = spark.createDataFrame([("Alpha",), ("beta",)], "name string")
    assert [r.name for r in ws.table_filter(names, " ALP ").collect()] == ["Alpha"]
    assert ws.table_filter(names, "  ").count() == 2
    cells = make(spark, [("a1", "cf:a", 1, "v"), ("a2", "cf:a", 1, "v"), ("b", "cf:a", 1, "v")])
    assert [bytes(r[0]) for r in ws.autocomplete(cells, "a").collect()] == [b"a1", b"a2"]
