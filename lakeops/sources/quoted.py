"""Quoted CSV files read by many tasks, line breaks inside quotes included.

Spark hands out the lines of a file by blocks. Whether a block begins inside a quoted field
depends on all text before it, so this takes two passes without a shuffle of the text. First every
block tells where it leads: the state after it if it began outside quotes, and if it began inside.
A window over these lines, one per block, gives the state at the beginning of each block. Then
every block cuts its own records, and only records that reach over a border are put together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lines that say how blocks begin are broadcast; more blocks than this are refused.
MAX_BLOCKS = 1_000_000
OPTIONS = {"multiLine": "true", "quote": '"', "escape": '"'}


def ends_open(line: str, inside: bool) -> bool:
    """Whether a line ends inside a quoted field, given how it begins.

    A quote opens a field at its very start only; inside, two quotes are one. What follows a closing
    quote belongs to the field up to the comma.
    """
    at = 0
    if not inside:
        if line[:1] == '"':
            at = 1
        else:
            at = line.find(',"') + 2
            if at == 1:
                return False
    while True:
        at = line.find('"', at)
        while at >= 0 and line[at + 1 : at + 2] == '"':
            at = line.find('"', at + 2)
        if at < 0:
            return True
        comma = line.find(",", at + 1)
        if comma < 0:
            return False
        if line[comma + 1 : comma + 2] == '"':
            at = comma + 2
        else:
            at = line.find(',"', comma + 1) + 2
            if at == 1:
                return False


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and way of beginning: the state after it, and whether a record begins in it; its lines."""
    names = ["file", "block", "after_out", "after_in", "begins_in", "lines"]
    block, state = None, None

    def line_of() -> dict:
        return dict(zip(names, [*block, *state]))

    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))
    for batch in batches:
        out = []
        for file, start, value in zip(*(column.to_pylist() for column in batch.columns)):
            if block != (file, start):
                if block:
                    out.append(line_of())
                # After beginning outside and inside, whether a record begins in a block that
                # begins inside, and the number of lines.
                block, state = (file, start), [False, True, False, 0]
            state[2] = state[2] or not state[1]
            state[3] += 1
            if '"' in value:
                same = state[0] == state[1]
                state[0] = ends_open(value, state[0])
                state[1] = state[0] if same else ends_open(value, state[1])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
    if block:
        yield pa.RecordBatch.from_pylist([line_of()], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of every block. ``piece`` is set on what continues a record of an earlier block
    or goes on in a later one."""
    schema = pa.schema(
        [("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()), ("part", pa.int64()), ("piece", pa.bool_()), ("text", pa.string())]
    )
    block, lines, number, first, piece, inside = None, [], 0, 0, False, False
    out: list[dict] = []

    def add(piece: bool) -> None:
        # A piece is filed under the block and line where its record begins.
        out.append({"file": block[0], "block": first, "line": number, "part": block[1], "piece": piece, "text": "\n".join(lines)})

    for batch in batches:
        for file, start, value, began_inside, begun in zip(*(column.to_pylist() for column in batch.columns)):
            if block != (file, start):
                if lines:
                    add(inside or piece)
                block, lines, inside, piece = (file, start), [], began_inside, began_inside
                # What continues an earlier record comes after all lines of the block where it began.
                first, number = (begun, -1) if began_inside else (start, 0)
            lines.append(value)
            if '"' in value:
                inside = ends_open(value, inside)
            if not inside:
                if piece or lines not in ([""], ["\r"]):
                    add(piece)
                    number += 1
                lines, piece, first = [], False, start
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out.clear()
    if lines:
        add(inside or piece)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of CSV files as they stand: ``file``, ``block`` and ``line`` tell where a record begins,
    ``position`` grows with the order of files, by path, and of records in them, ``text`` is a record
    without its line feed. Records end at line feeds outside quotes; empty lines are none.
    """
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    schema = "file string, block long, after_out boolean, after_in boolean, begins_in boolean, lines long"
    # A block sets the state, leaves it or turns it round. The state before a block is the one last
    # set, turned round by the blocks in between.
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    is_set = F.col("after_in") == F.col("after_out")
    starts = (
        lines.mapInArrow(_summaries, schema)
        .withColumn("turn", F.when(~F.col("after_in") & F.col("after_out"), 1).otherwise(0))
        .withColumn("turned", F.coalesce(F.sum("turn").over(before), F.lit(0)))
        .withColumn("known", F.when(is_set, F.struct(F.col("after_in").cast("int").alias("v"), F.col("turned").alias("t"))))
        .withColumn("known", F.last("known", ignorenulls=True).over(before))
        .withColumn("odd", F.coalesce(F.col("known.v") + F.col("turned") - F.col("known.t"), F.col("turned")) % 2)
        .withColumn("inside", F.col("odd") == 1)
        .withColumn("own", F.when(~F.col("inside") | F.col("begins_in"), F.col("block")))
        .withColumn("begun", F.coalesce(F.last("own", ignorenulls=True).over(before), F.lit(0)))
        .withColumn("torn", F.col("inside") | F.when(F.col("inside"), F.col("after_in")).otherwise(F.col("after_out")))
        .select("file", "block", "inside", "begun", "torn", "lines")
    )
    found = sorted(starts.limit(MAX_BLOCKS + 1).collect())
    if len(found) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks; raise spark.sql.files.maxPartitionBytes")
    offsets = [0, *accumulate(block.lines for block in found)]
    blocks = [(*block[:5], offset) for block, offset in zip(found, offsets)]
    blocks = F.broadcast(spark.createDataFrame(blocks, "file string, block long, inside boolean, begun long, torn boolean, offset long"))

    def cut(of: DataFrame) -> DataFrame:
        placed = lines.join(of, ["file", "block"]).select("file", "block", "value", "inside", "begun")
        return placed.mapInArrow(_cut, "file string, block long, line long, part long, piece boolean, text string")

    records = cut(blocks).where("NOT piece").select("file", "block", "line", "text")
    if any(block.torn for block in found):
        # At most one record reaches over the end of a block. Its pieces are in blocks that begin or
        # end inside a field.
        pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
        joined = cut(blocks.where("torn")).where("piece").groupBy("file", "block")
        records = records.unionByName(joined.agg(F.max("line").alias("line"), F.array_join(pieces, "\n").alias("text")))
    offset = blocks.select("file", "block", "offset")
    return records.join(F.broadcast(offset), ["file", "block"]).select(
        "file", "block", "line", (F.col("offset") + F.col("line")).alias("position"), "text"
    )


def read_quoted(spark: SparkSession, path: str, names: list[str], position: str = "_position") -> DataFrame:
    """CSV files with a header as text columns ``names``, like Spark's multi-line reader but in many tasks.

    ``position`` is a last column that grows with the order of the records. Every file has a header,
    which is its first line that is not empty.
    """
    records = quoted_records(spark, path)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    text = F.regexp_replace("text", "\r$", "")
    rows = records.where((F.col("block") > 0) | (F.col("line") > 0)).select("position", F.from_csv(text, schema, OPTIONS).alias("r"))
    columns = [F.col(f"r.c{i}").alias(name) for i, name in enumerate(names)]
    return rows.select(*columns, F.col("position").alias(position))
