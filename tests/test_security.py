import os
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeops.functions.attempts import FRESH, NEVER, Exits, enter, fold
from lakeops.operators import audit as a
from lakeops.operators import lockout as lock
from lakeops.operators import policy as p
from lakeops.sources.audit import read_audit
from lakeops.streaming.audit import stream_audit, topic_records, write_audit_stream
from lakeops.streaming.lockouts import stream_lockouts
from lakeops.streaming.table import drain, state_store

T0 = datetime(2024, 1, 1)
ATTEMPTS = "username string, ts timestamp, seq long, success boolean"


def attempts(spark, rows):
    data = [(u, T0 + timedelta(minutes=m), i, ok) for i, (u, m, ok) in enumerate(rows)]
    return spark.createDataFrame(data, ATTEMPTS)


GOLDEN = [("Bob", 0, False), (" bob ", 1, False), ("bob", 2, False), ("bob", 3, False), ("bob", 4, False)]
GOLDEN += [("bob", 10, True), ("bob", 19, False), ("bob", 35, False), ("bob", 36, True)]
GOLDEN_OUT = ["failed"] * 4 + ["locked", "blocked", "locked", "failed", "success"]


@pytest.mark.parametrize("target_rows", [1_000_000, 3, 1])
def test_lockout_golden(spark, target_rows):
    rows = lock.lockouts(attempts(spark, GOLDEN), target_rows=target_rows).orderBy("seq").collect()
    assert [r.outcome for r in rows] == GOLDEN_OUT
    assert [r.remaining for r in rows] == [4, 3, 2, 1, 0, 0, 0, 4, 5]
    minute = lambda ts: None if ts is None else (ts - T0).total_seconds() / 60
    assert [minute(r.locked_until) for r in rows] == [None] * 4 + [19, 19, 34, None, None]
    assert {r.user for r in rows} == {"bob"}


def test_lock_status(spark):
    outcomes = lock.lockouts(attempts(spark, GOLDEN))
    at = lambda minute: tuple(lock.lock_status(outcomes, str(T0 + timedelta(minutes=minute))).first())
    assert at(4) == ("bob", True, 0, 900)
    assert at(18.99) == ("bob", True, 0, 0)
    assert at(34.5) == ("bob", False, 0, 0)  # expired, but nothing has happened since
    assert at(35) == ("bob", False, 4, 0)
    assert at(60) == ("bob", False, 5, 0)


@pytest.mark.parametrize("seed", range(60))
def test_exits_agree_with_the_fold(seed):
    rng = random.Random(seed)
    limit, lockout = rng.choice([1, 2, 3, 5]), rng.choice([3, 7, 20])
    times = sorted(rng.randrange(40) for _ in range(rng.randrange(1, 30)))
    oks = [rng.random() < rng.choice([0.0, 0.2, 0.6]) for _ in times]
    exits = Exits(times, oks, limit, lockout)
    for count in range(limit):
        assert exits.from_count(count) == fold(times, oks, (count, NEVER), limit, lockout)[3]
    lines = exits.from_locks()
    for until in range(times[0] - 3, times[0] + lockout + 1):
        for count in (limit, limit + 2):
            expected = fold(times, oks, (count, until), limit, lockout)[3]
            assert enter((count, until), *lines) == expected, until


@pytest.mark.parametrize("seed", range(4))
def test_stretches_agree_with_one_fold(spark, seed):
    rng = random.Random(seed)
    rows, clock = [], 0.0
    for _ in range(900):
        clock += rng.choice([0, 0.01, 0.5, 1, 5, 15])
        user = "hot" if rng.random() < 0.8 else rng.choice(["a", "b"])
        rows.append((user, clock, rng.random() < rng.choice([0.02, 0.3])))
    df = attempts(spark, rows).cache()
    seen = lambda target: sorted(tuple(r) for r in lock.lockouts(df, target_rows=target).fillna({}).collect())
    key = lambda target: [(r[0], r[2], r[4], r[5], r[6]) for r in seen(target)]
    assert key(40) == key(10**6)


def test_streamed_lockouts_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    rows, clock = [], 0.0
    for _ in range(200):
        clock += rng.choice([0.1, 1, 4, 15])
        rows.append((rng.choice(["a", " A", "b"]), clock, rng.random() < 0.2))
    df = attempts(spark, rows)
    for n in range(0, 200, 50):
        part = df.where(F.col("seq").between(n, n + 49)).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(stream_lockouts(stream), "lockouts")
    key = lambda d: sorted((r.seq, r.user, r.outcome, r["count"], r.remaining) for r in d.collect())
    assert key(got) == key(lock.lockouts(df))


def test_streamed_lockouts_mark_late_attempts(spark, tmp_path):
    for batch in ([("a", 5, False)], [("a", 1, False), ("a", 6, False)]):
        attempts(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(stream_lockouts(stream), "lockouts").orderBy("ts").collect()
    assert [(r.outcome, r.remaining) for r in got] == [("late", 4), ("failed", 4), ("failed", 3)]


def test_streamed_lockouts_lose_no_attempt(spark, tmp_path):
    """Batches far behind those before: attempts of known users are late, a new user's are folded."""
    folder = tmp_path / "in"
    batches = [[("a", 500, False)], [("b", 10, False), ("a", 20, False)], [("a", 501, False)], [("c", 0, False), ("b", 9, False)]]
    for n, batch in enumerate(batches):
        attempts(spark, batch).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
        newest.rename(folder / f"{n}.parquet")
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))
    got = {(r.user, (r.ts - T0).total_seconds() / 60): r.outcome for r in drain(stream_lockouts(stream), "lockouts").collect()}
    assert got == {("a", 500): "failed", ("b", 10): "failed", ("a", 20): "late", ("a", 501): "failed", ("c", 0): "failed", ("b", 9): "late"}


def test_streamed_lockouts_forget_users(spark, tmp_path):
    """A lock that ended a lockout ago leaves the state, and so does a user without failures; open failures stay."""
    folder = tmp_path / "in"
    batches = [
        [("a", m, False) for m in range(5)] + [("b", 3, True), ("c", 4, False)],
        [("d", 300, True)],
        [("e", 301, True)],  # the watermark, 290 by now, has passed a's lock and b's success
        [("a", 100, False), ("a", 250, False), ("b", 291, False), ("c", 291, False)],
    ]
    for n, batch in enumerate(batches):
        attempts(spark, batch).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
        os.utime(newest, (1_700_000_000 + n, 1_700_000_000 + n))
        newest.rename(folder / f"{n}.parquet")
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(folder / "*.parquet"))
    with state_store(spark):
        query = (
            stream_lockouts(stream, delay="10 minutes")
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start(str(tmp_path / "out"))
        )
        query.awaitTermination()
    kept = {}
    for progress in query.recentProgress:
        for operator in progress.stateOperators:
            kept[progress.batchId] = operator.numRowsTotal
    assert kept[0] == 3  # a, b, c
    assert kept[1] == 4 and kept[2] == 3  # c's open failure, d and e
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.user, round((r.ts - T0).total_seconds() / 60)): (r.outcome, r["count"]) for r in rows if r.ts > T0 + timedelta(minutes=50)}
    assert got == {
        ("d", 300): ("success", 0), ("e", 301): ("success", 0),
        ("a", 100): ("late", 0), ("a", 250): ("late", 0),  # before the watermark
        ("b", 291): ("failed", 1), ("c", 291): ("failed", 2),
    }


# ------------------------------------------------------------------ audit

LINES = [
    '{"timestamp":"2024-01-02T03:04:05.123Z","user":"u","method":"GET","path":"/a","status":200}',
    '{"timestamp":"2024-01-03T00:00:00Z","user":"o","operation":"grant","tool":"t","subject":"role:r","resource":"c","result":"success"}',
    '{"user":"u","path":"/b"}',
    "audit kafka publish failed: timeout",
]


def test_audit_files_and_stream_agree(spark, tmp_path):
    import gzip

    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "audit.log").write_text("\n".join(LINES[:2]) + "\n")
    (folder / "audit.2024-01-01.0.log.gz").write_bytes(gzip.compress("\n".join(LINES[2:]).encode()))
    batch = read_audit(spark, str(folder))
    kinds = {r.event_kind: r for r in batch.collect()}
    assert set(kinds) == {"request", "policy", "degraded", "corrupt"}
    assert (kinds["request"].status, str(kinds["request"].day)) == (200, "2024-01-02")
    assert (kinds["policy"].result, kinds["policy"].method) == ("success", None)
    assert kinds["corrupt"].raw == LINES[3] and kinds["degraded"].path == "/b"
    query = write_audit_stream(stream_audit(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), True)
    query.awaitTermination()
    streamed = spark.read.schema(batch.schema).parquet(str(tmp_path / "out"))
    pick = ["ts", "user", "method", "path", "status", "event_kind", "raw"]
    assert sorted(map(str, streamed.select(pick).collect())) == sorted(map(str, batch.select(pick).collect()))
    assert (tmp_path / "out" / "day=2024-01-02").is_dir()


def test_audit_events_and_retention(spark):
    days = spark.range(100).select(
        F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(None).cast("string").alias("user"),
        F.lit("GET").alias("method"), F.lit("/").alias("path"), F.lit(200).alias("status"),
    )
    events = a.make_audit_events(days).withColumn("day", F.to_date(F.substring("timestamp", 1, 10)))
    assert events.first().line == '{"timestamp":"1970-01-01T00:00:00.000000Z","user":"anonymous","method":"GET","path":"/","status":200}'
    assert a.roll_audit(events).count() == 90
    size = len(events.first().line) + 1
    assert a.roll_audit(events, 90, 10 * size, "line").count() == 10
    assert a.roll_audit(events, 90, 1, "line").count() == 1
    assert topic_records(events).columns == ["key", "value"]


def test_policy_audit(spark):
    rows = [("grant", "SELECT_TABLE", True), ("grant", "NOPE", True), ("revoke", "SELECT_TABLE", False)]
    df = spark.createDataFrame(
        [(T0, None, "t", op, "r", "role:r", "c", pr, ok) for op, pr, ok in rows],
        "ts timestamp, user string, tool string, operation string, role string, subject string, resource string, privilege string, backend_ok boolean",
    )
    got = a.policy_audit(p.validate_mutations(df)).collect()
    assert [(r.status, r.result, r.user) for r in got] == [(200, "success", "anonymous"), (400, "failure", "anonymous"), (502, "failure", "anonymous")]


# ------------------------------------------------------------------ policies

READER = ("demo_customers_reader", [("catalog_iceberg", "CATALOG", ["USE_CATALOG"]), ("catalog_iceberg.demo", "SCHEMA", ["USE_SCHEMA"]), ("catalog_iceberg.demo.customers", "TABLE", ["SELECT_TABLE"])])
BROWSER = ("demo_catalog_reader", [("catalog_iceberg", "CATALOG", ["USE_CATALOG", "USE_SCHEMA", "SELECT_TABLE"])])


def seeded(spark):
    import json

    docs = []
    for n, (role, objects) in enumerate([READER, BROWSER]):
        doc = {"name": role, "securableObjects": [{"fullName": f, "type": t, "privileges": [{"name": x, "condition": "allow"} for x in ps]} for f, t, ps in objects]}
        docs.append((json.dumps({"role": doc} if n else doc),))
    docs += [("{}",), ('{"name":"empty","securableObjects":[{"fullName":"x","type":"CATALOG","privileges":[]}]}',), ("broken",)]
    privileges = p.flatten_roles(spark.createDataFrame(docs, "json string"))
    members = spark.createDataFrame([("analyst", READER[0]), ("admin", BROWSER[0])], "user string, role string")
    tables = ["customers", "orders", "order_items", "temporal_values", "interop_anomaly_values"]
    inventory = spark.createDataFrame([("catalog_iceberg", "demo", t) for t in tables], "catalog string, schema string, table string")
    return privileges, members, inventory


def test_visible_tables_golden(spark):
    privileges, members, inventory = seeded(spark)
    assert privileges.count() == 6
    seen = p.visible_tables(inventory, privileges, members).collect()
    assert sorted(r.table for r in seen if r.user == "analyst") == ["customers"]
    assert len([r for r in seen if r.user == "admin"]) == 5 and len(seen) == 6
    listed = {(r.resource, r.subject): r.actions for r in p.list_policies(privileges).collect()}
    assert listed[("catalog_iceberg", "role:demo_catalog_reader")] == ["USE_CATALOG", "USE_SCHEMA", "SELECT_TABLE"]
    assert len(listed) == 4


MUTATION = "seq long, operation string, role string, subject string, resource string, privilege string"


def test_validation(spark):
    rows = [
        (1, "GRANT", "r", "role:r", "c", "SELECT_TABLE"),
        (2, "grant", "r", "role:r", "c", "OWN"),
        (3, "grant", "r", "someone", "c", "SELECT_TABLE"),
        (4, "drop", "r", "role:r", "c", "SELECT_TABLE"),
        (5, "grant", " \t", "role:r", "c", "SELECT_TABLE"),
        (6, "revoke", "r", "user:u", None, "SELECT_TABLE"),
        (7, "revoke", "r", "user:u", "c", "DROP_TABLE"),
        (8, None, "r", "user:u", "c", "DROP_TABLE"),
        (9, "grant", "r", "user:u", "c", None),
    ]
    got = p.validate_mutations(spark.createDataFrame(rows, MUTATION)).orderBy("seq").collect()
    assert [r.valid for r in got] == [True, False, False, False, False, False, True, False, False]
    assert got[2].reason.startswith("subject")


def test_grant_then_revoke_is_identity_and_membership_changes(spark):
    privileges, members, inventory = seeded(spark)
    lines = privileges.select("role", "resource", "privilege", F.upper("condition").alias("condition"))
    change = lambda *rows: spark.createDataFrame(list(rows), MUTATION)
    new = (1, "grant", READER[0], "role:x", "catalog_iceberg", "DROP_TABLE")
    back = (2, "revoke", READER[0], "role:x", "catalog_iceberg", "DROP_TABLE")
    after, _ = p.apply_mutations(privileges, members, change(new, back))
    shown = after.select("role", "resource", "privilege", F.upper("condition"))
    assert sorted(map(tuple, shown.collect())) == sorted(map(tuple, lines.collect()))
    granted, _ = p.apply_mutations(privileges, members, change(back, (3, *new[1:])))
    assert granted.count() == lines.count() + 1
    _, joined = p.apply_mutations(
        privileges, members,
        change((1, "grant", BROWSER[0], "user:analyst", "c", "SELECT_TABLE"), (2, "revoke", BROWSER[0], "user:admin", "c", "SELECT_TABLE")),
    )
    seen = p.visible_tables(inventory, privileges, joined).collect()
    assert {r.user for r in seen} == {"analyst"} and len(seen) == 5


def test_other_lines_stay_and_the_listing_takes_the_result(spark):
    lines = [("r", "c", "CATALOG", 0, "USE_CATALOG", "allow"), ("r", "c", "CATALOG", 1, "USE_CATALOG", "DENY"), ("r", "c", "CATALOG", 2, "DROP_TABLE", "DENY")]
    privileges = spark.createDataFrame(lines, "role string, resource string, resource_type string, pos int, privilege string, condition string")
    changes = [(1, "grant", "r", "role:r", "c", "DROP_TABLE"), (2, "grant", "n", "role:n", "a.b", "SELECT_TABLE"), (3, "grant", "r", "role:r", "c", "USE_CATALOG")]
    after = p.apply_to_privileges(privileges, spark.createDataFrame(changes, MUTATION))
    assert {tuple(r) for r in after.select("role", "resource", "resource_type", "pos", "privilege", "condition").collect()} == {
        *lines, ("r", "c", "CATALOG", 3, "DROP_TABLE", "ALLOW"), ("n", "a.b", "SCHEMA", 0, "SELECT_TABLE", "ALLOW")
    }
    assert {(r.subject, tuple(r.actions)) for r in p.list_policies(after).collect()} == {("role:r", ("USE_CATALOG", "DROP_TABLE")), ("role:n", ("SELECT_TABLE",))}
    members = spark.createDataFrame([("u", "r")], "user string, role string")
    joined = p.apply_to_memberships(members, spark.createDataFrame([(1, "grant", "r", "user:superuser:x", "c", "DROP_TABLE")], MUTATION))
    assert {r.user for r in joined.collect()} == {"u", "superuser:x"}


def test_role_lists(spark):
    role = '{"name":"%s","securableObjects":[{"fullName":"c","type":"CATALOG","privileges":[{"name":"USE_CATALOG","condition":"ALLOW"}]}]}'
    docs = ['{"roles":[%s,{"role":%s}]}' % (role % "a", role % "b"), " [%s]" % (role % "c"), role % "d", '{"role":%s}' % (role % "e"), None]
    got = p.flatten_roles(spark.createDataFrame([(d,) for d in docs], "json string")).collect()
    assert sorted((r.role, r.resource, r.pos, r.privilege) for r in got) == [(x, "c", 0, "USE_CATALOG") for x in "abcde"]


def test_describe_and_inventory(spark):
    df = spark.createDataFrame([("c",), ("c.s",), ("c.s.t 1",), ("a.b.c.d",)], "resource string")
    got = {r.resource: (r.resource_type, r.segment, r.qualified_name) for r in p.describe_resources(df).collect()}
    assert got == {"c": ("CATALOG", "c", "c"), "c.s": ("SCHEMA", "c.s", "c.s"), "c.s.t 1": ("TABLE", "c.s.t1", "c.s.t 1"), "a.b.c.d": ("TABLE", "a.b.c.d", "a.b.c")}
    docs = spark.createDataFrame([('{"identifiers":[{"namespace":["a","b"],"name":"t"}]}',), ('{"identifiers":[]}',)], "json string")
    assert [tuple(r) for r in p.catalog_inventory(docs, "lake").collect()] == [("lake", "a.b", "t")]
    names = spark.createDataFrame([('{"namespaces":[["a","b"],["c"]]}',)], "json string")
    assert [r.schema for r in p.catalog_schemas(names, "lake").collect()] == ["a.b", "c"]
    spark.sql("CREATE SCHEMA IF NOT EXISTS listed")
    spark.range(1).write.mode("overwrite").saveAsTable("listed.one")
    assert p.session_inventory(spark).where("schema = 'listed'").collect()[0].table == "one"


def test_catalog_tree_keeps_forbidden_apart_from_empty(spark):
    inventory = spark.createDataFrame([("a", "s", "t2"), ("a", "s", "t1"), ("a", "void", None), ("f", "s", "t")], "catalog string, schema string, table string")
    catalogs = spark.createDataFrame([("a", True, True), ("e", True, True), ("f", True, False), ("u", False, True)], "catalog string, reachable boolean, permitted boolean")
    tree = [(r.kind, r.path, r.children, r.status) for r in p.catalog_tree(inventory, catalogs).orderBy("path").collect()]
    assert tree == [
        ("catalog", "a", 2, "available"),
        ("schema", "a.s", 2, None),
        ("table", "a.s.t1", 0, None),
        ("table", "a.s.t2", 0, None),
        ("schema", "a.void", 0, None),
        ("catalog", "e", 0, "empty"),
        ("catalog", "f", 0, "forbidden"),
        ("catalog", "u", 0, "unavailable"),
    ]


@pytest.mark.parametrize("seed", range(5))
def test_visible_tables_against_brute_force(spark, seed):
    rng = random.Random(seed)
    tables = [(f"c{i % 2}", f"s{i % 5}", f"t{i}") for i in range(20)]
    scopes = sorted({".".join(t[:n]) for t in tables for n in (1, 2, 3)})
    lines = [(f"r{rng.randrange(8)}", rng.choice(scopes), rng.choice(list(p.PRIVILEGES[:4])), rng.choice(["ALLOW", "allow", "DENY"])) for _ in range(150)]
    members = [(f"u{rng.randrange(4)}", f"r{rng.randrange(8)}") for _ in range(8)]
    held = {(u, res, pr) for u, r in members for r2, res, pr, c in lines if r == r2 and c.upper() == "ALLOW"}
    want = {
        (u, *t)
        for u in {m[0] for m in members}
        for t in tables
        if all(any((u, ".".join(t[:n]), pr) in held for n in (1, 2, 3)) for pr in p.PRIVILEGES[:3])
    }
    got = p.visible_tables(
        spark.createDataFrame(tables, "catalog string, schema string, table string"),
        spark.createDataFrame(lines, "role string, resource string, privilege string, condition string"),
        spark.createDataFrame(members, "user string, role string"),
    ).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_session_inventory_of_many_schemas(spark):
    names = [f"many_{k}" for k in range(40)] + ["2024"]
    try:
        for name in names:
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{name}`")
        for name in names[::10]:
            spark.sql(f"CREATE TABLE `{name}`.held (a INT) USING parquet")
        listed = p.session_inventory(spark)
        got = {(x.schema.strip("`"), x.table) for x in listed.collect()}
        assert {x for x in got if x[0] in names} == {(name, "held") for name in names[::10]}
        assert "Union" not in listed._jdf.queryExecution().toString()
    finally:
        for name in names:
            spark.sql(f"DROP SCHEMA IF EXISTS `{name}` CASCADE")
