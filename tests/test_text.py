import pytest
from pyspark.sql import functions as F

from lakeops.functions import text
from lakeops.functions.cells import decoded_text, display_key, is_binary


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "size, shown",
    [
        (0, "0 B"),
        (1023, "1023 B"),
        (1024, "1.0 KB"),
        (1536, "1.5 KB"),
        (1048524, "1023.9 KB"),
        (1048575, "1024.0 KB"),
        (1048576, "1.0 MB"),
        (5 * 1024**4, "5.0 TB"),
        (2048 * 1024**4, "2048.0 TB"),
    ],
)
def test_format_size(spark, size, shown):
    assert one(spark, text.format_size(F.lit(size).cast("long"))) == shown


@pytest.mark.parametrize(
    "ms, shown",
    [(None, ""), (0, ""), (999, "0s"), (59_999, "59s"), (60_000, "1m 0s"), (3_599_999, "59m 59s"), (7_320_000, "2h 2m")],
)
def test_format_duration(spark, ms, shown):
    assert one(spark, text.format_duration(F.lit(ms).cast("long"))) == shown


def test_dates(spark):
    assert one(spark, text.format_date(F.lit(1_000))) == "1970-01-01 00:00:01"
    assert one(spark, text.format_date(F.lit(0))) == ""
    assert one(spark, text.format_start(F.lit("2024-01-02T03:04:05.000GMT"))) == "2024-01-02 03:04:05"
    assert one(spark, text.iso_instant(F.lit(2500))) == "1970-01-01T00:00:02.500Z"
    assert one(spark, text.iso_instant(F.lit(2000))) == "1970-01-01T00:00:02Z"


def test_cells_of_a_table(spark):
    assert one(spark, text.escape_cell(F.lit(" a|b\r\nc "))) == "a\\|b  c"
    assert one(spark, text.truncate_cell(F.lit("x" * 180))) == "x" * 180
    assert one(spark, text.truncate_cell(F.lit("x" * 181))) == "x" * 179 + "…"
    assert one(spark, text.normalise_whitespace(F.lit("\n SELECT \t 1 "))) == "SELECT 1"


def test_job_id(spark):
    job = "0123456789abcdef0123456789abcdef"
    logs = ["other", f"x Submitting job 'SELECT 1' ({job}).", "Submitting job 'b' (" + "f" * 32 + ")"]
    assert one(spark, text.job_id_in(F.array(*[F.lit(x) for x in logs]))) == job
    assert one(spark, text.job_id_in(F.array(F.lit("nothing")))) is None


@pytest.mark.parametrize(
    "raw, shown, binary",
    [
        (b"hello", "hello", False),
        (b"\x00\x01", "AAE=", True),
        (b"a\tb\r\nc\x7f", "a\tb\r\nc\x7f", False),
        ("é".encode(), "é", False),
        (b"\xff", "/w==", True),
        (b"\x00'binary'\xff", "ACdiaW5hcnkn/w==", True),
        (b"", "", False),
    ],
)
def test_decode_value(spark, raw, shown, binary):
    row = spark.range(1).select(decoded_text(F.lit(raw)), is_binary(F.lit(raw))).first()
    assert tuple(row) == (shown, binary)


def test_long_binary_stays_on_one_line(spark):
    assert "\n" not in one(spark, decoded_text(F.lit(b"\x00" * 200)))


@pytest.mark.parametrize(
    "raw, shown",
    [(b"\x00r/1", "\\x00r/1"), (b"plain ~", "plain ~"), (b"a\\b", "a\\x5Cb"), (b"\xc3\xa9", "\\xC3\\xA9"), (b"", "")],
)
def test_display_key(spark, raw, shown):
    assert one(spark, display_key(F.lit(raw))) == shown
