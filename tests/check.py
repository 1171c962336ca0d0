"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return ("", "null")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return ("n", float(f"{number:.12g}") if math.isfinite(number) else str(number))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return ("t", str(value))
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sf_dir):
    """None if the results agree, else a short text of the difference."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(query.sql)
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} rows, expected {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference\n   {a}\n   {b}"
    return None if got[1] else "no rows"


if __name__ == "__main__":
    from lakeops.session import local_session
    from __spark_entry__ import queries

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name, query in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            if query.sql:
                verdict = compare(spark, con, query, sf_dir)
            else:
                verdict = None if query(spark, sf_dir).count() else "no rows"
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:900]}"
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {time.time() - began:.1f}s", flush=True)
        if verdict:
            bad.append(name)
            print("     " + verdict[:1500], flush=True)
    print(len(bad), "failed:", bad)
