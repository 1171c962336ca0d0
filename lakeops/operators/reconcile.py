"""Check that data written in one format reads back identically in others."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeops.operators.analytics import boundary_aggregate, boundary_timestamp_count

# Tolerance of double comparison and the timestamp text form.
REL_TOL = 1e-12
ABS_TOL = 1e-12
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
FORMATS = ("parquet", "orc", "json", "csv")

# Comparison rule per column of the boundary table.
BOUNDARY_RULES = {
    "writer": "exact",
    "string_col": "exact",
    "event_date": "date",
    "event_timestamp": "timestamp",
    "int_value": "int",
    "decimal_value": "decimal",
    "double_value": "double",
}


def canonical_text(df: DataFrame) -> DataFrame:
    """The verification view: dates, timestamps and decimals as text, ordered by id."""
    return df.select(
        "writer",
        "id",
        "string_col",
        F.col("event_date").cast("string").alias("event_date"),
        F.col("event_timestamp").cast("string").alias("event_timestamp"),
        "int_value",
        F.col("decimal_value").cast("string").alias("decimal_value"),
        "double_value",
    ).orderBy("id")


def normalise_timestamp(text: Column) -> Column:
    """``T`` to space, no ``Z``, always a fraction, at most 26 characters."""
    plain = F.replace(F.replace(text.cast("string"), F.lit("T"), F.lit(" ")), F.lit("Z"), F.lit(""))
    full = F.when(F.contains(plain, F.lit(".")), plain).otherwise(F.concat(plain, F.lit(".000000")))
    return F.substring(full, 1, 26)


def normalise_timestamps(df: DataFrame, *columns: str) -> DataFrame:
    """Normalise the timestamp text columns, every timestamp-named column by default."""
    names = columns or [c for c in df.columns if c.endswith("timestamp")]
    return df.withColumns({name: normalise_timestamp(F.col(name)) for name in names})


def timestamp_text(df: DataFrame, column: str) -> Column:
    """A timestamp to the microsecond: typed columns are printed, text is normalised."""
    if isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, TIMESTAMP_FORMAT)
    return normalise_timestamp(F.col(column))


def _plain_decimal(value: Column) -> Column:
    """A decimal as text without sign of plus, leading and trailing zeros: exact at any length."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"^(-?)\+?0*(?=[0-9])", "$1")
    text = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\.$", ""), "^-(?=0$)", "")


def _canonical(df: DataFrame, column: str, rule: str) -> Column:
    """What a rule compares: columns with equal canonical values pass, except that doubles may also
    pass within their tolerance."""
    value = F.col(column)
    if rule == "exact":
        kind = df.schema[column].dataType
        nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        return F.to_json(value, {"ignoreNullFields": "false"}) if nested else value
    if rule == "timestamp":
        return timestamp_text(df, column)
    if rule == "date":
        return F.substring(value.cast("string"), 1, 10)
    if rule == "int":
        return value.cast("long")
    if rule == "decimal":
        return _plain_decimal(value)
    if rule == "double":
        return value.cast("double")
    raise ValueError(f"unknown rule {rule!r}")


def _differs(rule: str, a: str, b: str, strict: bool) -> str:
    """SQL that is true where canonical values fail a rule; a null matches only a null."""
    if rule != "double" or strict:
        return f"NOT ({a} <=> {b})"
    bound = f"greatest({REL_TOL!r}D * greatest(abs({a}), abs({b})), {ABS_TOL!r}D)"
    return f"NOT ({a} <=> {b} OR coalesce(abs({a} - {b}) <= {bound}, false))"


def _text(value: str) -> str:
    """A string as SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _comparable(expected: DataFrame, actual: DataFrame, columns: dict[str, str]) -> list[DataFrame]:
    """Both sides with columns ``v0, v1, ...`` of canonical values. Numbers of different types are
    compared in their common type, other types as text. Decimals are numbers if both sides have
    room for each other's digits, dates and timestamps instants if both sides are; else they are text."""
    kinds = [(expected.schema[c].dataType, actual.schema[c].dataType) for c in columns]
    sides = []
    for df in (expected, actual):
        values = []
        for i, ((c, rule), pair) in enumerate(zip(columns.items(), kinds)):
            decimals = all(isinstance(kind, T.DecimalType) for kind in pair)
            if rule == "decimal" and decimals:
                scale = max(kind.scale for kind in pair)
                digits = max(kind.precision - kind.scale for kind in pair) + scale
                if digits <= 38:
                    values.append(F.col(c).cast(T.DecimalType(digits, scale)).alias(f"v{i}"))
                    continue
            times = pair[0] == pair[1] and isinstance(pair[0], (T.DateType, T.TimestampType, T.TimestampNTZType))
            if times and rule == ("date" if isinstance(pair[0], T.DateType) else "timestamp"):
                values.append(F.col(c).alias(f"v{i}"))
                continue
            values.append(_canonical(df, c, rule).alias(f"v{i}"))
        sides.append(df.select(*[c for c in df.columns if c == COPY], *values))
    for i in range(len(columns)):
        types = [df.schema[f"v{i}"].dataType for df in sides]
        if types[0] != types[1] and not all(isinstance(kind, T.NumericType) for kind in types):
            sides = [df.withColumn(f"v{i}", F.col(f"v{i}").cast("string")) for df in sides]
    return sides


# The column that tells copies apart, and the number of key buckets whose fingerprints are compared.
COPY = "_copy"
BUCKETS = 4096


def _fingerprints(rows: DataFrame, values: list[str]) -> DataFrame:
    """Copy and bucket where the two sides do not hold the same rows as often.

    A bucket's fingerprint is the count of its rows and the sum of their 64-bit hashes, whatever the order
    of the rows. The sum is kept in three parts of 22 bits at most, so that it holds four
    billion rows a thousand times over. Hashes skip nulls, so the places of the nulls are hashed
    too. There is a line per copy and bucket, added up before the shuffle.
    """
    parts = [f"(_hash >> {shift}) & {(1 << 22) - 1}" for shift in (0, 22)] + ["_hash >> 44"]
    hashed = rows.select(COPY, "_bucket", "_sign", F.xxhash64(_null_places(values), *values).alias("_hash"))
    sums = ["sum(_sign) AS _sum", *[f"sum(_sign * ({part})) AS _sum{k}" for k, part in enumerate(parts)]]
    found = hashed.groupBy(COPY, "_bucket").agg(*map(F.expr, sums))
    return found.where("_sum <> 0 OR _sum0 <> 0 OR _sum1 <> 0 OR _sum2 <> 0").select(COPY, "_bucket")


def _null_places(values: list[str]) -> Column:
    """A number with a bit for each null among the values; values beyond 62 share bits."""
    bits = [f"if({v} IS NULL, {1 << (i % 62)}L, 0L)" for i, v in enumerate(values)]
    return F.expr(" ^ ".join(["0L", *bits]))


def reconcile_copies(
    expected: DataFrame,
    copies: DataFrame,
    names: list[str],
    keys: list[str],
    rules: dict[str, str] | None = None,
    strict: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``reconcile`` of one table with many copies of it, in one plan.

    ``copies`` holds the rows of all copies, told apart by the column ``_copy``, whose values are
    ``names``; a copy without rows is one where all is missing. The result has that column in front.
    """
    rules = rules or {c: "exact" for c in expected.columns if c not in (*keys, COPY)}
    given, found = _comparable(expected, copies, {**{k: "exact" for k in keys}, **rules})
    n_keys, n = len(keys), len(keys) + len(rules)
    values = [f"v{i}" for i in range(n)]
    key_values = values[:n_keys]
    bucket = F.pmod(F.xxhash64(_null_places(key_values), *key_values), F.lit(buckets)).cast("int").alias("_bucket")
    # The source stands beside every copy.
    every = F.lit(names[0]) if len(names) == 1 else F.explode(F.array(*[F.lit(name) for name in names]))
    given = given.select(every.alias(COPY), *values, F.lit(1).alias("_sign"))
    found = found.select(COPY, *values, F.lit(-1).alias("_sign"))
    rows = given.unionAll(found).select("*", bucket)

    # At most a line per copy and bucket, whatever the sides hold.
    unequal = [tuple(line) for line in _fingerprints(rows, values).collect()]
    if 2 * len(unequal) < buckets * len(names):
        spark = expected.sparkSession
        unequal = spark.createDataFrame(unequal, f"{COPY} string, _bucket int")
        rows = rows.join(F.broadcast(unequal), [COPY, "_bucket"], "left_semi")

    # Equal rows cancel out, as often as they occur on both sides.
    net = rows.groupBy(COPY, *values).agg(F.sum("_sign").alias("_net")).where("_net <> 0")
    # What is left is numbered within its key and side; equal numbers form a pair.
    in_key = W.partitionBy(COPY, *key_values, "_side").orderBy(*values[n_keys:], "_nth")
    spare = (
        net.withColumn("_side", F.col("_net") > 0)
        .withColumn("_nth", F.explode(F.sequence(F.lit(1), F.abs("_net").cast("int"))))
        .repartition(COPY, *key_values)
        .withColumn("_nth", F.row_number().over(in_key))
    )
    line = F.struct(*values[n_keys:])
    pairs = spare.groupBy(COPY, *key_values, "_nth").agg(
        F.first(F.when(F.col("_side"), line), ignorenulls=True).alias("e"),
        F.first(F.when(~F.col("_side"), line), ignorenulls=True).alias("a"),
    )

    def shown(value: str, name: str) -> str:
        if isinstance(given.schema[name].dataType, (T.TimestampType, T.TimestampNTZType)):
            return f"date_format({value}, '{TIMESTAMP_FORMAT}')"
        return value

    def finding(column: str, was: str, now: str, reason: str) -> str:
        return (
            f"named_struct('column', {_text(column)}, 'expected', CAST({was} AS STRING), "
            f"'actual', CAST({now} AS STRING), 'reason', '{reason}')"
        )

    failures = [
        f"CASE WHEN {_differs(rule, f'e.v{i}', f'a.v{i}', strict)} "
        f"THEN {finding(c, shown(f'e.v{i}', f'v{i}'), shown(f'a.v{i}', f'v{i}'), 'mismatch')} END"
        for i, (c, rule) in enumerate(rules.items(), n_keys)
    ]
    found = F.expr(
        f"CASE WHEN a IS NULL THEN array({finding('*', 'NULL', 'NULL', 'missing')}) "
        f"WHEN e IS NULL THEN array({finding('*', 'NULL', 'NULL', 'extra')}) "
        f"ELSE array_compact(array({', '.join(failures)})) END"
    )
    shown_keys = [F.col(v).alias(k) for v, k in zip(key_values, keys)]
    return pairs.select(COPY, *shown_keys, F.explode(found).alias("_f")).select(COPY, *keys, "_f.*")


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    keys: list[str],
    rules: dict[str, str] | None = None,
    strict: bool = False,
    buckets: int = BUCKETS,
) -> DataFrame:
    """One row per mismatch: the keys, ``column``, the values compared (``expected``, ``actual``) and
    the ``reason``.

    Both sides are compared by a fingerprint per bucket of keys; only buckets that differ are read
    again. There, rows that are the same on both sides cancel out as often as they occur, so that a
    key that is frequent on both sides costs nothing. What is left pairs up on null-safe keys, in
    the order of the values where a key repeats. Rows on one side only give a ``missing`` or ``extra``
    line; pairs give one ``mismatch`` line per failed rule. Where sides agree but for some rows of
    a few buckets, a run costs one pass of hashing and a shuffle of fingerprints. They are compared
    at once, when this is called.
    """
    copies = actual.withColumn(COPY, F.lit(""))
    return reconcile_copies(expected, copies, [""], keys, rules, strict, buckets).drop(COPY)


def reconcile_summary(diff: DataFrame) -> DataFrame:
    """Mismatches per column and reason."""
    return diff.groupBy("column", "reason").agg(F.count(F.lit(1)).alias("mismatches"))


def reconcile_passed(diff: DataFrame) -> DataFrame:
    """One row: whether there is no mismatch, and how many there are."""
    return diff.agg(F.count(F.lit(1)).alias("mismatches")).select(
        (F.col("mismatches") == 0).alias("passed"), "mismatches"
    )


def query_shape_check(
    df: DataFrame, aggregate: tuple[int, int, int], timestamp_count: int
) -> DataFrame:
    """Check the two boundary queries against the expected tuples, one row per check."""
    sums = boundary_aggregate(df)
    seen = F.array(*[F.col(c).cast("long") for c in sums.columns])
    counted = boundary_timestamp_count(df)
    parts = [
        sums.select(
            F.lit("boundary_aggregate").alias("check"),
            F.array(*[F.lit(v).cast("long") for v in aggregate]).alias("expected"),
            seen.alias("actual"),
        ),
        counted.select(
            F.lit("boundary_timestamp_count").alias("check"),
            F.array(F.lit(timestamp_count).cast("long")).alias("expected"),
            F.array(F.col("timestamp_count")).alias("actual"),
        ),
    ]
    both = parts[0].unionByName(parts[1])
    return both.withColumn("passed", F.col("expected").eqNullSafe(F.col("actual")))


def _options(fmt: str) -> dict[str, str]:
    if fmt not in ("csv", "json"):
        return {}
    options = {"timestampFormat": TIMESTAMP_FORMAT, "timestampNTZFormat": TIMESTAMP_FORMAT}
    return {**options, "header": "true"} if fmt == "csv" else options


# How files are compressed. One task reads a compressed text file as a whole, so files have a bound.
COMPRESSION = {"csv": "gzip", "json": "gzip", "parquet": "zstd", "orc": "zstd"}
FILE_ROWS = 1_000_000


def write_format(df: DataFrame, path: str, fmt: str) -> None:
    """Write with microseconds kept in every format, compressed."""
    packed = {"compression": COMPRESSION[fmt]} if fmt in COMPRESSION else {}
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS)
    writer.options(**_options(fmt), **packed).format(fmt).save(path)


def read_format(spark: SparkSession, path: str, fmt: str, schema) -> DataFrame:
    """Read with an explicit schema, independent of what the writer recorded."""
    return spark.read.schema(schema).options(**_options(fmt)).format(fmt).load(path)


def _shapes(rows: DataFrame, by: list[str]) -> DataFrame:
    """The answers to both boundary queries, per group: ``shape`` (rows, integer sum and non-null strings
    up to 1900, rows from the last instant of the calendar reform on)."""
    early = F.col("event_date") <= F.lit("1900-01-01").cast("date")
    late = F.col("event_timestamp") >= F.lit("1582-10-15 23:59:59.999999").cast(rows.schema["event_timestamp"].dataType)
    parts = [
        F.count_if(early),
        F.sum(F.when(early, F.col("int_value"))).cast("long"),
        F.count(F.when(early, F.col("string_col"))),
        F.count_if(late),
    ]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.array(*parts).alias("shape"))


def _at_once(jobs: list[tuple], work) -> dict:
    """``work`` for every job, several at a time; an error of Spark is the job's result."""

    def attempt(job):
        try:
            work(*job)
        except (PySparkException, Py4JJavaError) as error:
            return error
        return None

    with ThreadPoolExecutor(max_workers=4) as pool:
        return dict(zip(jobs, pool.map(attempt, jobs)))


def interop_matrix(
    spark: SparkSession,
    source: DataFrame,
    base_dir: str,
    formats: tuple[str, ...] = FORMATS,
    write=write_format,
) -> DataFrame:
    """Write with each format, read back from each of the others: one verdict per pair.

    The table a format wrote is handed to another format by reading it and writing it there; the
    pair passes when that copy reconciles with the source and gives the same answers to both
    boundary queries. A failed writer fails all its pairs, and a reader that cannot take the table
    over fails its own; ``detail`` says so. All copies are then checked together: they are
    one table with the pair as a column, reconciled with the source in one plan, and one
    aggregate gives the verdicts: ``rows``, ``shape`` (see ``_shapes``) and ``mismatches`` of the
    copy, null where there is none.
    """
    pairs = [(w, r) for w in formats for r in formats if w != r]
    own = {w: source.select(F.lit(w).alias("writer"), "*") for w in formats}
    schema = own[formats[0]].schema
    written = _at_once([(w,) for w in formats], lambda w: write(own[w], f"{base_dir}/{w}", w))

    def hand_over(writer: str, reader: str) -> None:
        table = read_format(spark, f"{base_dir}/{writer}", writer, schema)
        write(table, f"{base_dir}/{writer}-{reader}", reader)

    ready = [(w, r) for w, r in pairs if written[w,] is None]
    handed = _at_once(ready, hand_over)
    copied = [f"{w}-{r}" for w, r in ready if handed[w, r] is None]

    def failure(writer: str, reader: str) -> str:
        who, error = ("writer", written[writer,]) if written[writer,] else ("reader", handed[writer, reader])
        return f"{who} failed: {type(error).__name__}: {str(error)[:200]}" if error else ""

    lines = spark.createDataFrame(
        [(f"{w}-{r}", w, r, failure(w, r)) for w, r in pairs], f"{COPY} string, writer string, reader string, failed string"
    )
    if not copied:
        missing = ("rows long", "shape array<long>", "mismatches long")
        return lines.select(
            "writer", "reader", *[F.lit(None).cast(m.split()[1]).alias(m.split()[0]) for m in missing],
            F.lit(False).alias("passed"), F.col("failed").alias("detail"),
        )
    copies = reduce(
        DataFrame.unionAll,
        [
            read_format(spark, f"{base_dir}/{pair}", pair.rpartition("-")[2], schema).select(F.lit(pair).alias(COPY), "*")
            for pair in copied
        ],
    )
    # The copy says which format wrote it; the source is the same for all.
    named_writer = copies.withColumn("writer", F.col("writer").eqNullSafe(F.substring_index(COPY, "-", 1)))
    expected = source.select(F.lit(True).alias("writer"), "*")
    diff = reconcile_copies(expected, named_writer, copied, ["id"], BOUNDARY_RULES)
    found = diff.groupBy(COPY).agg(F.count(F.lit(1)).alias("mismatches"))
    right = _shapes(source, []).select(F.col("shape").alias("right"))
    checked = (
        lines.join(_shapes(copies, [COPY]), COPY, "left")
        .join(found, COPY, "left")
        .join(right, F.lit(True), "left")
        .withColumn("mismatches", F.when(F.col("failed") == "", F.coalesce("mismatches", F.lit(0))))
        .withColumn("rows", F.when(F.col("failed") == "", F.coalesce("rows", F.lit(0))))
        .withColumn("shape", F.when(F.col("failed") == "", F.coalesce("shape", F.expr("array(0L, CAST(NULL AS BIGINT), 0L, 0L)"))))
    )
    faults = F.array_compact(
        F.array(
            F.when(F.col("mismatches") > 0, F.lit("rows")),
            F.when(~F.slice("shape", 1, 3).eqNullSafe(F.slice("right", 1, 3)), F.lit("boundary_aggregate")),
            F.when(~F.col("shape")[3].eqNullSafe(F.col("right")[3]), F.lit("boundary_timestamp_count")),
        )
    )
    detail = F.when(F.col("failed") == "", F.array_join(F.array_sort(faults), ",")).otherwise(F.col("failed"))
    return checked.withColumn("detail", detail).select(
        "writer", "reader", "rows", "shape", "mismatches", (F.col("detail") == "").alias("passed"), "detail"
    )
