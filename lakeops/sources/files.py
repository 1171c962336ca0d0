"""File listings, previews and directory roll-ups."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import format_size, path_label
from lakeops.session import scratch_path

# Fixed value: bytes shown of a file.
PREVIEW_BYTES = 64 * 1024

ENTRIES = (
    "name string, path string, directory boolean, size long, owner string, group string, permission string, "
    "modification_time timestamp"
)
SCHEME = re.compile("^([A-Za-z][A-Za-z0-9+.-]+):")
# Stores that the Python side of a task can open; other ones are listed by Spark's file source.
IN_TASKS = ("", "file", "s3", "s3a", "s3n", "gs", "gcs")
# Directories that a task lists in a row.
DIRECTORIES_PER_TASK = 64


def _scheme(path: str) -> str:
    found = SCHEME.match(path)
    return found.group(1).lower() if found else ""


def _openers():
    """Functions for tasks: entries of a directory, and the head of a file."""
    import stat as modes

    def is_local(path: str) -> bool:
        return path.startswith("file:") or "://" not in path

    def local(path: str) -> str:
        # file:/a, file:///a and /a are one path; names are not percent-encoded.
        rest = re.sub("^file:", "", path)
        return "/" + rest.lstrip("/") if rest != path else rest

    def store(path: str):
        from pyarrow import fs

        # Hadoop and Arrow name the same store by different schemes.
        bucket, _, key = re.sub("^[^:]+://", "", path).partition("/")
        system, root = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path.split("://")[0] + "://" + bucket))
        return system, f"{root}/{key}".rstrip("/")

    def name_of(numbers, key: int, field: str) -> str:
        try:
            return getattr(numbers(key), field)
        except KeyError:
            return str(key)

    def entries(directory: str) -> Iterator[tuple]:
        import grp
        import os
        import pwd

        base = directory.rstrip("/")
        if is_local(directory):
            top = local(directory)
            if not os.path.isdir(top):
                found = [(os.path.basename(top), directory, os.lstat(top))]
            else:
                with os.scandir(top) as listed:
                    found = [(e.name, f"{base}/{e.name}", e.stat(follow_symlinks=False)) for e in listed]
            for name, path, s in found:
                is_directory = modes.S_ISDIR(s.st_mode)
                yield (
                    name, path, is_directory, 0 if is_directory else s.st_size, name_of(pwd.getpwuid, s.st_uid, "pw_name"),
                    name_of(grp.getgrgid, s.st_gid, "gr_name"), f"{s.st_mode & 0o1777:o}", s.st_mtime_ns // 1000,
                )
        else:
            from pyarrow import fs

            system, top = store(directory)
            one = system.get_file_info(top)
            if one.type == fs.FileType.NotFound:
                raise FileNotFoundError(directory)
            infos = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(top))
            for i in infos:
                path = directory if i is one else f"{base}/{i.base_name}"
                at = i.mtime_ns // 1000 if i.mtime_ns is not None else None
                yield i.base_name, path, i.type == fs.FileType.Directory, i.size or 0, None, None, None, at

    def head(path: str, max_bytes: int) -> str:
        if is_local(path):
            with open(local(path), "rb") as file:
                return file.read(max_bytes).decode("utf-8", errors="replace")
        system, name = store(path)
        with system.open_input_file(name) as file:
            return file.read(max_bytes).decode("utf-8", errors="replace")

    return entries, head


def _list_directories(hidden: bool):
    entries, _ = _openers()
    columns = ["name", "path", "directory", "size", "owner", "group", "permission", "modification_time"]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for directory in batch["path"]:
                rows = [e for e in entries(directory) if hidden or e[0][:1] not in ("_", ".")]
                if rows:
                    out = pd.DataFrame(rows, columns=columns)
                    out["modification_time"] = pd.to_datetime(out["modification_time"], unit="us", utc=True)
                    yield out

    return listed


def _by_file_source(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """Files as Spark lists them, and the directories on the way to them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    unknown = F.lit(None).cast("string")
    # Spark writes the paths out in full; the path asked for, without its store, leads to all of them.
    root = "/" + re.sub("^[^:/]+:(//[^/]*)?", "", path).strip("/") + "/"
    files = reader.load(path).select("path", "length", "modificationTime")
    start = F.instr("path", root)
    inside = F.split(F.substring(F.col("path"), start + len(root), F.length("path")), "/")
    files = files.select("*", F.when(start > 0, inside).otherwise(F.array(path_label("path"))).alias("_p"))
    steps = F.sequence(F.lit(1), F.size("_p")) if recursive else F.array(F.lit(1))
    each = files.select("*", F.explode(steps).alias("_n")).select(
        "length",
        "modificationTime",
        (F.col("_n") < F.size("_p")).alias("directory"),
        F.get("_p", F.col("_n") - 1).alias("name"),
        F.when(F.col("_n") == F.size("_p"), F.col("path"))
        .otherwise(F.expr("substring_index(path, '/', size(split(path, '/')) - size(_p) + _n)"))
        .alias("path"),
    )
    return each.groupBy("path", "name", "directory").agg(
        F.max(F.when(F.col("directory"), F.lit(0)).otherwise(F.col("length"))).cast("long").alias("size"),
        F.max("modificationTime").alias("modification_time"),
    ).select("name", "path", "directory", "size", *[unknown.alias(c) for c in ("owner", "group", "permission")], "modification_time")


def file_inventory(spark: SparkSession, path: str, recursive: bool = False, hidden: bool = False) -> DataFrame:
    """One line per entry of a directory, or of the whole tree below it. Contents are not read.

    Files and directories with size (0 of a directory), owner, group, permission bits in octal and time of
    change. Names that begin with ``_`` or ``.`` are left out unless ``hidden``. A link is an entry and is
    not followed; the path of a file gives that file; a path that does not exist is an error.

    Tasks list the directories, a level of the tree after the other; each level is written to the shared
    folder, so neither the driver nor a task sees more than its directories. Object stores know no owner,
    group and permission. Stores that tasks cannot open by themselves are listed by Spark's file source:
    directories are then those that hold files, changed when the newest of them was, and ``hidden`` is refused.
    """
    if _scheme(path) not in IN_TASKS:
        if hidden:
            raise ValueError(f"hidden entries of {path} cannot be listed")
        return _by_file_source(spark, path, recursive)
    level = spark.createDataFrame([(path,)], "path string")
    if not recursive:
        return level.mapInPandas(_list_directories(hidden), ENTRIES)
    target, depth = scratch_path(spark, "inventory"), 0
    while True:
        written = f"{target}/level={depth}"
        level.mapInPandas(_list_directories(hidden), ENTRIES).write.parquet(written)
        inner = spark.read.schema(ENTRIES).parquet(written).where("directory").select("path")
        count = inner.count()
        if not count:
            return spark.read.schema(ENTRIES).parquet(f"{target}/level=*")
        # By the directory's own path: a retried task lists what it listed before.
        level, depth = inner.repartition(-(-count // DIRECTORIES_PER_TASK), "path"), depth + 1


def _read_heads(max_bytes: int):
    _, head = _openers()

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(preview=[head(path, max_bytes) for path in batch["path"]])

    return heads


def file_previews(
    spark: SparkSession, path: str, max_bytes: int = PREVIEW_BYTES, recursive: bool = False
) -> DataFrame:
    """The head of each file as text; bytes that are no UTF-8 show as U+FFFD.

    Every task opens its files itself and reads only the head, since the file source of Spark
    would read them whole; it does so for stores that tasks cannot open.
    """
    if _scheme(path) not in IN_TASKS:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        head = F.make_valid_utf8(F.substring("content", 1, max_bytes).cast("string"))
        return reader.load(path).select(path_label("path").alias("name"), "path", F.col("length").alias("size"), head.alias("preview"))
    listed = file_inventory(spark, path, recursive).where("NOT directory").select("name", "path", "size")
    return listed.mapInPandas(
        _read_heads(max_bytes), "name string, path string, size long, preview string"
    )


def path_ancestors(paths: DataFrame, column: str = "path") -> DataFrame:
    """The breadcrumbs of every path: ``depth``, ``label`` and accumulated ``crumb``, root first."""
    segments = F.filter(F.split(F.col(column), "/"), lambda s: s != "")
    crumbs = F.transform(
        F.sequence(F.lit(0), F.size("_s")),
        lambda n: F.struct(
            n.alias("depth"),
            F.when(n == 0, "/").otherwise(F.get(F.col("_s"), n - 1)).alias("label"),
            F.concat(F.lit("/"), F.array_join(F.slice("_s", F.lit(1), n), "/")).alias("crumb"),
        ),
    )
    return (
        paths.withColumn("_s", segments)
        .select(*paths.columns, F.explode(crumbs).alias("_c"))
        .select(*paths.columns, "_c.*")
    )


def directory_rollup(inventory: DataFrame) -> DataFrame:
    """Files and bytes below every directory, the sizes also as text.

    Files are added up per directory first, so a directory with very many files adds one line to
    each of its ancestors.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    folder = F.concat(F.lit("/"), F.array_join(F.slice(segments, F.lit(1), F.size(segments) - 1), "/"))
    per_folder = inventory.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("_files"), F.sum("size").alias("_bytes")
    )
    return (
        path_ancestors(per_folder, "folder")
        .groupBy(F.col("crumb").alias("directory"))
        .agg(F.sum("_files").alias("files"), F.sum("_bytes").alias("bytes"))
        .withColumn("size_text", format_size("bytes"))
    )
