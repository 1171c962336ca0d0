"""A versioned wide-column store kept as an append-only table of cells.

``cells(row_key binary, column string, ts timestamp, seq long, value binary, deleted boolean)``:
a cell is ``(row_key, column)``; its versions are ordered by ``(ts, seq)``. Rows come back in long
form, one line per cell, because a row may hold any number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lakeops.functions.cells import decoded_text, display_key, is_binary
from lakeops.operators.numbering import number_rows
from lakeops.sources.quoted import read_quoted

CELLS_SCHEMA = (
    "row_key binary, column string, ts timestamp, seq long, value binary, deleted boolean"
)
# Largest scan, largest page, columns in a grid, characters in a grid cell.
MAX_SCAN = 1000
MAX_PAGE = MAX_SCAN - 1
MAX_GRID_COLUMNS = 60
MAX_GRID_TEXT = 140

_CELL = ("row_key", "column")
# Place of a bulk line over all its files.
POSITION = "_position"


def as_key(key: str | bytes) -> bytes:
    return key.encode("utf-8") if isinstance(key, str) else bytes(key)


def _lit_key(key: str | bytes) -> Column:
    return F.lit(as_key(key))


# ------------------------------------------------------------------ selecting


def latest_cells(cells: DataFrame) -> DataFrame:
    """The newest version of every cell; cells whose newest version is a tombstone are gone."""
    newest = cells.groupBy(*_CELL).agg(
        F.max(F.struct("ts", "seq", "deleted", "value")).alias("_v")
    )
    return newest.where(~F.col("_v.deleted")).select(
        *_CELL, F.col("_v.ts").alias("ts"), F.col("_v.seq").alias("seq"), F.col("_v.value").alias("value")
    )


def _key_range(start: str | bytes, start_inclusive: bool, prefix: str | bytes | None) -> Column:
    """Plain comparisons on ``row_key``, which Parquet can use to skip row groups."""
    start, prefix = as_key(start), as_key(prefix or b"")
    condition = F.lit(True)
    if start:
        key = F.col("row_key")
        condition = key >= F.lit(start) if start_inclusive else key > F.lit(start)
    if prefix:
        condition = condition & (F.col("row_key") >= F.lit(prefix))
        after = prefix.rstrip(b"\xff")
        if after:  # the first key past the prefix
            condition = condition & (F.col("row_key") < F.lit(after[:-1] + bytes([after[-1] + 1])))
    return condition


def _chosen_columns(columns: list[str] | None) -> Column:
    """``cf`` selects a family, ``cf:q`` one column."""
    wanted = [c.strip() for c in columns or [] if c and c.strip()]
    if not wanted:
        return F.lit(True)
    exact = [c for c in wanted if ":" in c and not c.endswith(":")]
    families = [c.rstrip(":") for c in wanted if c not in exact]
    condition = F.lit(False)
    if exact:
        condition = condition | F.col("column").isin(exact)
    for family in families:
        condition = condition | F.col("column").startswith(f"{family}:")
    return condition


@dataclass(frozen=True)
class ValueEquals:
    """Keeps the cells that hold this value."""

    value: str | bytes


@dataclass(frozen=True)
class ColumnValue:
    """Keeps the rows whose cell in ``column`` compares like this with ``value``."""

    column: str
    op: str
    value: str | bytes
    keep_missing: bool = False

    def matches(self) -> Column:
        cell, value = F.col("value"), _lit_key(self.value)
        operators = {
            "=": cell == value,
            "!=": cell != value,
            "<": cell < value,
            "<=": cell <= value,
            ">": cell > value,
            ">=": cell >= value,
        }
        return operators[self.op]


def filter_cells(live: DataFrame, predicates: list[ValueEquals | ColumnValue]) -> DataFrame:
    """Apply value predicates to latest cells: cell filters keep cells, row filters rows."""
    for predicate in predicates:
        if isinstance(predicate, ValueEquals):
            live = live.where(F.col("value") == _lit_key(predicate.value))
            continue
        cell = live.where(F.col("column") == predicate.column)
        if predicate.keep_missing:
            failing = cell.where(~predicate.matches()).select("row_key")
            live = live.join(failing, "row_key", "left_anti")
        else:
            passing = cell.where(predicate.matches()).select("row_key")
            live = live.join(passing, "row_key", "left_semi")
    return live


def first_keys(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` distinct row keys in byte order."""
    return rows.select("row_key").distinct().orderBy("row_key").limit(limit)


def _live_cells(cells: DataFrame) -> DataFrame:
    """The keys of ``latest_cells``; values are neither read nor shuffled."""
    newest = cells.groupBy(*_CELL).agg(F.max(F.struct("ts", "seq", "deleted")).alias("_v"))
    return newest.where(~F.col("_v.deleted")).select(*_CELL)


def _page_keys(selected: DataFrame, predicates: list | None, limit: int) -> list[bytes]:
    """The first ``limit`` row keys that show anything, at most 1000 of them.

    Without predicates the versions of the whole store are not compared: candidates are the
    first keys of all, and only the cells up to the last candidate are looked at. Should too many
    of those rows be deleted, the search goes on behind them with more candidates.
    """
    if predicates:
        live = filter_cells(latest_cells(selected), predicates)
        return [bytes(row[0]) for row in first_keys(live, limit).collect()]
    found: list[bytes] = []
    ahead, asked = selected, 2 * limit
    while len(found) < limit:
        last, seen = first_keys(ahead, asked).agg(F.max("row_key"), F.count("row_key")).first()
        if not seen:
            break
        near = _live_cells(ahead.where(F.col("row_key") <= F.lit(bytes(last))))
        found += [bytes(row[0]) for row in first_keys(near, limit - len(found)).collect()]
        if seen < asked:
            break
        ahead, asked = selected.where(F.col("row_key") > F.lit(bytes(last))), 4 * asked
    return found


def _check_limit(limit: int, most: int) -> None:
    """A limit that cannot be met is refused, not cut."""
    if not 0 < limit <= most:
        raise ValueError(f"between 1 and {most} rows can be asked for, not {limit}")


def _rows_of(chosen: DataFrame, keys: list[bytes], predicates: list | None) -> DataFrame:
    """The selected cells of at most 1000 rows, read by their key range."""
    if not keys:
        page = chosen.where(F.lit(False))
    else:
        within = F.col("row_key").between(F.lit(keys[0]), F.lit(keys[-1]))
        page = chosen.where(within & F.col("row_key").isin(keys))
    return filter_cells(latest_cells(page), predicates or []).orderBy("row_key", "column")


def select_rows(
    cells: DataFrame,
    start: str | bytes = "",
    start_inclusive: bool = True,
    prefix: str | bytes | None = None,
    columns: list[str] | None = None,
    predicates: list[ValueEquals | ColumnValue] | None = None,
) -> DataFrame:
    """Latest cells of every selected row, without a limit."""
    chosen = cells.where(_key_range(start, start_inclusive, prefix)).where(_chosen_columns(columns))
    return filter_cells(latest_cells(chosen), predicates or [])


def scan(
    cells: DataFrame,
    start: str | bytes = "",
    start_inclusive: bool = True,
    prefix: str | bytes | None = None,
    limit: int = 50,
    columns: list[str] | None = None,
    predicates: list[ValueEquals | ColumnValue] | None = None,
) -> DataFrame:
    """Latest cells of the first ``limit`` rows in key order; more than 1000 are refused.

    The keys of these rows are found first, which runs right away and brings at most 1000 keys
    to the driver. The result then reads only their key range, whatever the size of the store.
    """
    _check_limit(limit, MAX_SCAN)
    chosen = cells.where(_chosen_columns(columns))
    selected = chosen.where(_key_range(start, start_inclusive, prefix))
    keys = _page_keys(selected, predicates, limit)
    return _rows_of(chosen, keys, predicates)


@dataclass(frozen=True)
class RowPage:
    """The cells of one page of rows, and where the next page starts."""

    rows: DataFrame
    has_next: bool
    next_cursor: bytes | None


def page(
    cells: DataFrame,
    cursor: str | bytes | None = None,
    size: int = 50,
    prefix: str | bytes | None = None,
    columns: list[str] | None = None,
    predicates: list[ValueEquals | ColumnValue] | None = None,
    start: str | bytes = "",
) -> RowPage:
    """One page of rows. The next page starts strictly after ``next_cursor``, raw key bytes.

    One key more than the page shows is fetched to learn whether there is a next page.
    """
    _check_limit(size, MAX_PAGE)
    first = cursor is None
    chosen = cells.where(_chosen_columns(columns))
    selected = chosen.where(_key_range(start if first else cursor, first, prefix))
    keys = _page_keys(selected, predicates, size + 1)
    more, shown = len(keys) > size, keys[:size]
    return RowPage(_rows_of(chosen, shown, predicates), more, shown[-1] if more else None)


def search_rows(cells: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Row search: ``abc*`` scans the keys with that prefix, ``abc`` scans on from that key."""
    text = text.strip()
    if text.endswith("*"):
        return scan(cells, start=text[:-1], prefix=text[:-1], limit=limit)
    return scan(cells, start=text, limit=limit)


def autocomplete(cells: DataFrame, prefix: str | bytes = "", limit: int = 20) -> DataFrame:
    """The first row keys with a prefix."""
    _check_limit(limit, MAX_SCAN)
    selected = cells.where(_key_range("", True, prefix))
    keys = _page_keys(selected, None, limit)
    return cells.sparkSession.createDataFrame([(key,) for key in keys], "row_key binary")


def get_row(cells: DataFrame, key: str | bytes, columns: list[str] | None = None) -> DataFrame:
    """The newest cells of one row; no lines if there is no such row."""
    chosen = cells.where(F.col("row_key") == _lit_key(key)).where(_chosen_columns(columns))
    return latest_cells(chosen).orderBy("column")


def get_rows(cells: DataFrame, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``get_row`` for a table of keys of any size."""
    wanted = cells.where(_chosen_columns(columns)).join(keys.select("row_key"), "row_key", "left_semi")
    return latest_cells(wanted)


def cell_versions(
    cells: DataFrame, key: str | bytes | None = None, column: str | None = None, n: int = 10
) -> DataFrame:
    """The newest ``n`` versions of every cell, or of one, newest first as ``version`` 1, 2, ...

    Versions at or below the newest tombstone of a cell are hidden.
    """
    chosen = cells
    if key is not None:
        chosen = chosen.where(F.col("row_key") == _lit_key(key))
    if column is not None:
        chosen = chosen.where(F.col("column") == column)
    newest_first = W.partitionBy(*_CELL).orderBy(F.desc("ts"), F.desc("seq"))
    ranked = chosen.withColumn("version", F.row_number().over(newest_first))
    # A tombstone cuts the list: keep what is newer than the newest tombstone seen so far.
    kept = ranked.where(F.col("version") <= n).withColumn(
        "_cut", F.max(F.col("deleted")).over(newest_first.rowsBetween(W.unboundedPreceding, 0))
    )
    return kept.where(~F.col("_cut")).select(*_CELL, "version", "ts", "seq", "value")


# ------------------------------------------------------------------ mutations


def put_rows(cells: DataFrame, updates: DataFrame) -> DataFrame:
    """Append one new version per given cell; a null value is stored as empty bytes.

    ``updates`` holds ``row_key, column, ts, seq, value``. It fails when it has a row key without
    a column, which is a put without cells.
    """
    checked = F.when(F.col("column").isNull(), F.raise_error(F.lit("an update needs a column"))).otherwise(
        F.col("column")
    )
    new = updates.select(
        "row_key",
        checked.cast("string").alias("column"),
        F.col("ts").cast(cells.schema["ts"].dataType).alias("ts"),
        "seq",
        F.coalesce(F.col("value"), F.lit(b"")).alias("value"),
        F.lit(False).alias("deleted"),
    )
    return cells.unionByName(new)


def put_row(
    cells: DataFrame, key: str | bytes, values: dict[str, str | bytes | None], ts: str, seq: int
) -> DataFrame:
    """Write the given cells of one row at one time."""
    if not values:
        raise ValueError("an update needs a column")
    spark = cells.sparkSession
    rows = [
        (as_key(key), column, ts, seq, None if value is None else as_key(value))
        for column, value in values.items()
    ]
    return put_rows(
        cells,
        spark.createDataFrame(
            rows, "row_key binary, column string, ts string, seq long, value binary"
        ),
    )


def delete_cells(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Append tombstones for ``row_key, column, ts, seq``: they hide the versions up to then."""
    tombstones = keys.select(
        "row_key",
        "column",
        F.col("ts").cast(cells.schema["ts"].dataType).alias("ts"),
        "seq",
        F.lit(None).cast("binary").alias("value"),
        F.lit(True).alias("deleted"),
    )
    return cells.unionByName(tombstones)


def delete_rows(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """Append tombstones for every cell of the rows in ``row_key, ts, seq``."""
    doomed = cells.select(*_CELL).join(keys, "row_key").select(*_CELL, "ts", "seq").distinct()
    return delete_cells(cells, doomed)


def apply_retention(cells: DataFrame, families: DataFrame, now: str) -> DataFrame:
    """Keep per cell the newest ``max_versions``, and of those older than the TTL only the newest
    ``min_versions``.

    ``families`` holds ``family, max_versions, min_versions, ttl_seconds``; a null limit, or a
    family that is not listed, keeps everything.
    """
    newest_first = W.partitionBy(*_CELL).orderBy(F.desc("ts"), F.desc("seq"))
    names = ["max_versions", "min_versions", "ttl_seconds"]
    rules = families.select(F.col("family").alias("_family"), *names)
    # A family list is configuration of a few lines; its largest limit bounds every ranking below.
    deepest = rules.agg(F.max(F.greatest("max_versions", "min_versions"))).first()[0] or 0
    ruled = cells.withColumn("_family", F.substring_index("column", ":", 1)).join(
        rules, "_family", "left"
    )
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.col("ttl_seconds").isNull() | (age <= F.col("ttl_seconds") * 1_000_000)
    uncapped = F.col("max_versions").isNull()
    spared = F.col("_n") <= F.coalesce(F.col("min_versions"), F.lit(0))
    # Versions that no cap touches need no ranking. The others are cut to the deepest limit before
    # they are shuffled, so a cell with very many versions does not reach one task whole.
    untouched = ruled.where(uncapped & fresh)
    ranked = (
        ruled.where(~uncapped | F.col("ttl_seconds").isNotNull())
        .withColumn("_n", F.row_number().over(newest_first))
        .where(F.col("_n") <= int(deepest))
    )
    capped = ~uncapped & (F.col("_n") <= F.col("max_versions")) & (fresh | spared)
    stale = uncapped & ~fresh & spared
    return untouched.select(*cells.columns).unionByName(
        ranked.where(capped | stale).select(*cells.columns)
    )


# ------------------------------------------------------------------ bulk load and display


def cells_from_rows(rows: DataFrame, ts: str, seq: Column | None = None) -> DataFrame:
    """Cells of a table whose first column is the row key and the others are ``cf:q`` text.

    Rows with an empty key and empty fields are skipped. ``seq`` orders repeated keys, the last one
    wins: a column, or the position in the input of a table that is one file or made in order.
    """
    key, *columns = [c for c in rows.columns if c != POSITION]
    if seq is None and POSITION in rows.columns:
        seq = F.col(POSITION)
    if not columns:
        raise ValueError("bulk rows need a key and one more column")
    numbered = rows.withColumn("_seq", F.monotonically_increasing_id() if seq is None else seq)
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("text")) for c in columns]
    )
    filled = F.filter(entries, lambda cell: F.coalesce(cell["text"], F.lit("")) != "")
    return (
        numbered.where(F.coalesce(F.col(f"`{key}`"), F.lit("")) != "")
        .select(F.col(f"`{key}`").alias("_key"), "_seq", F.explode(filled).alias("_c"))
        .select(
            F.encode("_key", "UTF-8").alias("row_key"),
            F.col("_c.column").alias("column"),
            F.lit(ts).cast("timestamp").alias("ts"),
            F.col("_seq").alias("seq"),
            F.encode("_c.text", "UTF-8").alias("value"),
            F.lit(False).alias("deleted"),
        )
    )


def rows_written(rows: DataFrame) -> DataFrame:
    """How many rows of a bulk table have a key and at least one filled field."""
    key, *columns = [c for c in rows.columns if c != POSITION]

    def filled(column: str) -> Column:
        return F.coalesce(F.col(f"`{column}`"), F.lit("")) != ""

    any_cell = F.exists(F.array(*[filled(c) for c in columns]), lambda ok: ok)
    return rows.where(filled(key) & any_cell).agg(F.count(F.lit(1)).alias("rows_written"))


def read_bulk_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A bulk file as text columns by Spark's own reader. Quoted line breaks need ``multi_line``, which
    reads a file in one task; ``bulk_load`` has another way for large files."""
    # The header alone names the columns; all of them stay text.
    header = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"')
    rows = header.csv(path)
    if len(rows.columns) < 2 or rows.isEmpty():
        raise ValueError("a bulk file needs a header with a key and one more column, and a line of data")
    return rows


# Files beyond this size are read by many tasks each.
LARGE_FILE = 128 * 1024**2


def bulk_load(
    spark: SparkSession, path: str, ts: str, multi_line: bool = True, large_file: int = LARGE_FILE
) -> DataFrame:
    """The cells of CSV files whose header is the key and ``cf:q`` columns.

    Files are taken in the order of their paths, lines in the order of the file; of repeated keys
    the last line wins. Spark reads a file with quoted line breaks in one task; if there is one of more than
    ``large_file`` bytes, all are cut into records by many tasks instead, with the same result.
    """
    rows = read_bulk_csv(spark, path, multi_line)
    if multi_line:
        # Listed, not read.
        sizes = spark.read.format("binaryFile").load(path).agg(F.max("length"))
        if sizes.first()[0] > large_file:
            return cells_from_rows(read_quoted(spark, path, rows.columns, POSITION), ts)
    return cells_from_rows(in_file_order(rows), ts)


def in_file_order(rows: DataFrame) -> DataFrame:
    """Adds ``POSITION``: consecutive numbers by file path, block of the file and line in it.

    Spark packs blocks of files into tasks by size, so the number that tasks give their lines says
    nothing about the order of files; within a block it does.
    """
    placed = rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    order = [F.col("_file"), F.col("_block"), F.col("_line")]
    return number_rows(placed, order, POSITION).drop("_file", "_block", "_line")


def display_cells(live: DataFrame) -> DataFrame:
    """Latest cells as text: display key, column, value, version time and binary flag."""
    return live.select(
        display_key(F.col("row_key")).alias("row_key"),
        "column",
        decoded_text(F.col("value")).alias("value"),
        "ts",
        is_binary(F.col("value")).alias("binary"),
    )


def grid_columns(live: DataFrame, max_columns: int = MAX_GRID_COLUMNS) -> tuple[list[str], int]:
    """The first columns in name order (at most ``max_columns``) and how many there are."""
    distinct = live.select("column").distinct()
    names = [r[0] for r in distinct.orderBy("column").limit(max_columns).collect()]
    total = len(names) if len(names) < max_columns else distinct.count()
    return names, total


def to_grid(live: DataFrame, max_columns: int = MAX_GRID_COLUMNS) -> DataFrame:
    """One line per row with a column per ``cf:q``, missing cells empty.

    ``columns_shown`` and ``columns_total`` say whether the column cap left some out.
    """
    names, total = grid_columns(live, max_columns)
    value = F.col("value")
    text = value.cast("string")
    # The marker and the cut are what the grid shows, not the stored value.
    shown = F.when(is_binary(value), F.lit("⬡ binary")).otherwise(
        F.when(
            F.char_length(text) > MAX_GRID_TEXT,
            F.concat(F.substring(text, 1, MAX_GRID_TEXT), F.lit("…")),
        ).otherwise(text)
    )
    grid = live.select("row_key", "column", shown.alias("_shown")).groupBy("row_key")
    grid = grid.pivot("column", names).agg(F.first("_shown"))

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    return grid.select(
        display_key(F.col("row_key")).alias("row_key"),
        *[F.coalesce(quoted(n), F.lit("")).alias(n) for n in names],
        F.lit(len(names)).alias("columns_shown"),
        F.lit(total).alias("columns_total"),
    )


def table_filter(names: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Table names that contain the text, whatever the case; blank text keeps all."""
    needle = text.strip().lower()
    return names.where(F.contains(F.lower(F.col(column)), F.lit(needle))) if needle else names


# ------------------------------------------------------------------ generators


def _seeded(key: Column, column: Column, value: Column) -> list[Column]:
    """The fields of a generated cell: version time zero, first in its order."""
    return [
        F.encode(key, "UTF-8").alias("row_key"),
        column.alias("column"),
        F.timestamp_millis(F.lit(0)).alias("ts"),
        F.lit(0).cast("long").alias("seq"),
        F.encode(value, "UTF-8").alias("value"),
        F.lit(False).alias("deleted"),
    ]


def row_table_cells(ids: DataFrame) -> DataFrame:
    """Two cells per long ``id``: ``cf:a`` and ``cf:b`` of row ``r%08d``."""
    number = F.col("id").cast("string")
    pair = F.create_map(
        F.lit("cf:a"),
        F.concat(F.lit("value-"), number),
        F.lit("cf:b"),
        F.concat(F.lit("other-"), number),
    )
    both = ids.select("id", F.explode(pair).alias("_column", "_value"))
    return both.select(_seeded(F.format_string("r%08d", "id"), F.col("_column"), F.col("_value")))


def generate_row_tables(
    spark: SparkSession, sizes: tuple[int, ...] = (1, 10, 100, 1000, 10_000, 100_000)
) -> dict[str, DataFrame]:
    """One table of ``n`` rows per size."""
    return {f"gen_rows_{n}": row_table_cells(spark.range(n)) for n in sizes}


def wide_row_cells(ids: DataFrame) -> DataFrame:
    """One row ``wide`` with the cell ``cf:c%05d`` for every long ``id``."""
    value = F.concat(F.lit("v"), F.col("id").cast("string"))
    return ids.select(_seeded(F.lit("wide"), F.format_string("cf:c%05d", "id"), value))


def generate_wide_rows(
    spark: SparkSession, widths: tuple[int, ...] = (1, 10, 100, 1000, 5000)
) -> dict[str, DataFrame]:
    """One table with one row of ``n`` columns per width."""
    return {f"gen_cols_{n}": wide_row_cells(spark.range(n)) for n in widths}


def tiny_table_cells(ids: DataFrame) -> DataFrame:
    """A one-cell table ``gen_tiny_%04d`` for every long ``id``, told apart by ``table``."""
    name = F.format_string("gen_tiny_%04d", "id").alias("table")
    return ids.select(name, *_seeded(F.lit("r0"), F.lit("cf:a"), F.lit("seed")))


def generate_tiny_tables(spark: SparkSession, n: int = 200) -> DataFrame:
    return tiny_table_cells(spark.range(1, n + 1))
