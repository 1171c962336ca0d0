"""Quoted CSV in many tasks beside Spark's multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import widestore as ws
from lakeops.sources.quoted import ends_open, quoted_records, read_quoted


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that borders fall everywhere."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


def field(rng):
    kind = rng.randrange(7)
    if kind == 0:
        return ""
    if kind < 4:
        return "".join(rng.choice('ab "é') for _ in range(rng.randrange(1, 5))).lstrip('"') or "x"
    inner = "".join(rng.choice(['a', '""', "\n", ",", "b", "\n\n", ' ""\n']) for _ in range(rng.randrange(0, 12)))
    return f'"{inner}"'


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, size", [(1, 16), (3, 64)])
def test_same_rows_as_the_multi_line_reader(spark, small_blocks, tmp_path, seed, size):
    rng = random.Random(seed)
    for name in ("a.csv", "b.csv"):
        lines = [f'k{i},"{"n" * rng.randrange(20)}\n{i}",' + field(rng) + "," + field(rng) for i in range(15)]
        text = "key,cf:a,cf:b,cf:c\n" + "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        (tmp_path / name).write_text(text)
    expected = rows_of(ws.read_bulk_csv(spark, str(tmp_path)))
    small_blocks(size)
    found = read_quoted(spark, str(tmp_path), ["key", "cf:a", "cf:b", "cf:c"])
    assert found.columns == ["key", "cf:a", "cf:b", "cf:c", "_position"]
    if size < 100:
        assert quoted_records(spark, str(tmp_path)).select("block").distinct().count() > 5
    assert rows_of(found.drop("_position")) == expected
    order = [r.key for r in found.orderBy("_position").collect()]
    assert order == [f"k{i}" for i in range(15)] * 2


def test_one_field_over_many_blocks_and_an_open_end(spark, small_blocks, tmp_path):
    long = "\n".join(f"line {i}, with ""quotes""" for i in range(40))
    (tmp_path / "one.csv").write_text(f'key,cf:v\nfirst,1\nbig,"{long}"\nlast,2\n')
    (tmp_path / "two.csv").write_text('key,cf:v\r\nwin,"a\r\nb"\r\nopen,"never closed\nto the end')
    small_blocks(20)
    cells = ws.latest_cells(ws.bulk_load(spark, str(tmp_path), "2024-01-01", large_file=10))
    got = {bytes(r.row_key).decode(): bytes(r.value).decode() for r in cells.collect()}
    assert got == {"first": "1", "big": long, "last": "2", "win": "a\r\nb", "open": "never closed\nto the end"}


def test_last_line_of_a_repeated_key_wins(spark, small_blocks, tmp_path):
    lines = [f'k{i % 7},"v\n{i}"' for i in range(200)]
    (tmp_path / "r.csv").write_text("key,cf:v\n" + "\n".join(lines))
    small_blocks(50)
    cells = ws.latest_cells(ws.bulk_load(spark, str(tmp_path), "2024-01-01", large_file=10))
    assert {bytes(r.row_key): bytes(r.value) for r in cells.collect()} == {
        f"k{i % 7}".encode(): f"v\n{i}".encode() for i in range(193, 200)
    }


def test_states_of_lines():
    cases = {
        "": (False, True), 'a"b,c': (False, False), '"a': (True, False), 'x,"a""': (True, False), '"a""b"': (False, True),
        '"a"x"y,"b': (True, True), '","': (False, True), 'a,"b",c': (False, True), '""': (False, True),
    }
    for line, (outside, inside) in cases.items():
        assert ends_open(line, False) is outside, line
    assert ends_open("a", True) and not ends_open('a"', True) and ends_open('a""', True) and ends_open('a","b', True)
    assert not ends_open('"', True) and ends_open('""', True) and not ends_open('"x,y', True)
