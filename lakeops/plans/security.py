"""Queries of the audit log, login lockouts and access policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import audit as a
from lakeops.operators import lockout as lock
from lakeops.operators import policy as p
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import Tables, micros_text
from lakeops.plans.registry import query

# ------------------------------------------------------------------ audit

_KIND = "CASE event_id % 4 WHEN 0 THEN 'policy' WHEN 1 THEN 'degraded' WHEN 2 THEN 'corrupt' ELSE 'request' END"
AUDIT_SQL = (
    "SELECT event_id, kind AS event_kind, "
    "CASE WHEN kind IN ('policy', 'request') THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, "
    "CASE WHEN kind <> 'corrupt' THEN \"user\" END AS \"user\", "
    "CASE WHEN kind = 'request' THEN method END AS method, "
    "CASE WHEN kind IN ('request', 'degraded') THEN path END AS path, "
    "CASE WHEN kind = 'request' THEN status END AS status, "
    "CASE WHEN kind = 'policy' THEN 'grant' END AS operation, "
    "CASE WHEN kind = 'policy' THEN event_type END AS resource, "
    "CASE WHEN kind = 'policy' THEN 'success' END AS result, "
    "CASE WHEN kind IN ('policy', 'request') THEN strftime(ts, '%Y-%m-%d') END AS \"day\" "
    f"FROM (SELECT *, {_KIND} AS kind FROM v_requests)"
)


def audit_lines(events: DataFrame) -> DataFrame:
    """Log lines of every shape, one per event, with the event id beside each."""
    n, number = F.col("event_id"), F.col("user_id").cast("string")
    user = F.when(F.col("user_id") % 10 != 0, F.concat(F.lit("u"), number)).otherwise("anonymous")
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    path = F.concat(F.lit("/api/"), "event_type").alias("path")
    status = F.when(F.col("value") >= 100, 500).when(F.col("value") >= 50, 403).otherwise(200)
    policy = F.struct(
        stamp,
        user.alias("user"),
        F.lit("grant").alias("operation"),
        F.lit("catalog").alias("tool"),
        F.lit("role:r").alias("subject"),
        F.col("event_type").alias("resource"),
        F.lit("success").alias("result"),
    )
    request = F.struct(
        stamp,
        user.alias("user"),
        F.when(F.col("event_type") == "view", "GET").otherwise("POST").alias("method"),
        path,
        status.alias("status"),
    )
    line = (
        F.when(n % 4 == 0, F.to_json(policy))
        .when(n % 4 == 1, F.to_json(F.struct(user.alias("user"), path)))
        .when(n % 4 == 2, F.concat(F.lit("audit failed: "), "event_type"))
        .otherwise(F.to_json(request))
    )
    return events.select("event_id", line.alias("value"))


def shown_audit(table: DataFrame) -> DataFrame:
    return table.select(
        "event_kind",
        micros_text("ts").alias("ts"),
        "user",
        "method",
        "path",
        "status",
        "operation",
        "resource",
        "result",
        F.col("day").cast("string").alias("day"),
    )


@query(AUDIT_SQL.replace("SELECT event_id, ", "SELECT ", 1))
def parsed_audit(t: Tables) -> DataFrame:
    return shown_audit(a.parse_audit_lines(audit_lines(t["events"])))


@query(
    "SELECT \"timestamp\", \"user\", method, path, status, "
    "'{\"timestamp\":\"' || \"timestamp\" || '\",\"user\":\"' || \"user\" || '\",\"method\":\"' || method || "
    "'\",\"path\":\"' || path || '\",\"status\":' || status || '}' AS line FROM v_requests"
)
def audit_events(t: Tables) -> DataFrame:
    return a.make_audit_events(v.requests(t))


@query(
    "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS \"timestamp\", \"user\", operation, subject, resource, "
    "CASE WHEN reason = '' AND backend_ok THEN 'success' ELSE 'failure' END AS result, "
    "CASE WHEN reason <> '' THEN 400 WHEN NOT backend_ok THEN 502 ELSE 200 END AS status FROM v_verdicts"
)
def policy_audit(t: Tables) -> DataFrame:
    events = a.policy_audit(p.validate_mutations(v.mutations(t)))
    return events.drop("tool", "line")


def dated(t: Tables) -> DataFrame:
    events = a.make_audit_events(v.requests(t))
    return events.withColumn("day", F.to_date(F.substring("timestamp", 1, 10)))


RECENT_DAYS_SQL = (
    "SELECT \"timestamp\", \"user\", path FROM v_requests "
    "WHERE CAST(ts AS DATE) >= (SELECT max(CAST(ts AS DATE)) FROM v_requests) - 6"
)


@query(RECENT_DAYS_SQL)
def recent_audit_days(t: Tables) -> DataFrame:
    return a.roll_audit(dated(t), days=7).select("timestamp", "user", "path")




@query(
    "WITH d AS (SELECT CAST(ts AS DATE) AS d, sum(strlen('{\"timestamp\":\"' || \"timestamp\" || "
    "'\",\"user\":\"' || \"user\" || '\",\"method\":\"' || method || '\",\"path\":\"' || path || "
    "'\",\"status\":' || status || '}') + 1) AS b FROM v_requests GROUP BY 1), "
    "c AS (SELECT d, sum(b) OVER (ORDER BY d DESC) AS total, row_number() OVER (ORDER BY d DESC) AS n FROM d) "
    "SELECT \"timestamp\", \"user\", path FROM v_requests "
    "WHERE CAST(ts AS DATE) IN (SELECT d FROM c WHERE total <= 500000 OR n = 1)"
)
def size_capped_audit(t: Tables) -> DataFrame:
    kept = a.roll_audit(dated(t), days=90, max_bytes=500_000, line="line")
    return kept.select("timestamp", "user", "path")


# ------------------------------------------------------------------ lockouts

_DAY = 86_400
_STATE = "CASE WHEN f.until >= 0 AND n.us > f.until THEN 0 ELSE f.cnt END"
LOCKOUT_SQL = (
    "WITH RECURSIVE f AS ("
    "SELECT \"user\", us, seq, success, n, CASE WHEN success THEN 'success' ELSE 'failed' END AS outcome, "
    "CASE WHEN success THEN 0 ELSE 1 END AS cnt, CAST(-1 AS BIGINT) AS until FROM v_attempts WHERE n = 1 "
    "UNION ALL SELECT n.\"user\", n.us, n.seq, n.success, n.n, "
    "CASE WHEN n.us < f.until THEN 'blocked' WHEN n.success THEN 'success' "
    f"WHEN {_STATE} >= 4 THEN 'locked' ELSE 'failed' END, "
    f"CASE WHEN n.us < f.until THEN f.cnt WHEN n.success THEN 0 ELSE {_STATE} + 1 END, "
    "CASE WHEN n.us < f.until THEN f.until WHEN n.success THEN -1 "
    f"WHEN {_STATE} >= 4 THEN n.us + {_DAY}000000 ELSE -1 END "
    "FROM f JOIN v_attempts n ON n.\"user\" = f.\"user\" AND n.n = f.n + 1) "
)


def shown_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.select(
        "user",
        "seq",
        "outcome",
        "count",
        F.unix_micros("locked_until").alias("locked_until"),
        "remaining",
    )


SHOWN_LOCKOUT_SQL = LOCKOUT_SQL + (
    "SELECT \"user\", seq, outcome, CAST(cnt AS INTEGER) AS \"count\", "
    "CASE WHEN until >= 0 THEN until END AS locked_until, CAST(greatest(5 - cnt, 0) AS INTEGER) AS remaining FROM f"
)


@query(SHOWN_LOCKOUT_SQL)
def lockouts(t: Tables) -> DataFrame:
    return shown_outcomes(lock.lockouts(v.attempts(t), lockout_seconds=_DAY))


@query(SHOWN_LOCKOUT_SQL)
def lockouts_of_busy_users(t: Tables) -> DataFrame:
    """The same with every user of more than 75 attempts cut into stretches."""
    return shown_outcomes(lock.lockouts(v.attempts(t), lockout_seconds=_DAY, target_rows=75))


_AS_OF = "epoch_us(TIMESTAMP '2024-01-20')"


@query(
    LOCKOUT_SQL + "SELECT \"user\", until > x.now AS blocked, "
    "CAST(CASE WHEN until > x.now THEN 0 ELSE greatest(5 - cnt, 0) END AS INTEGER) AS remaining, "
    "greatest(CASE WHEN until >= 0 THEN CAST(floor((until - x.now) / 1000000) AS BIGINT) ELSE 0 END, 0) AS seconds_left "
    f"FROM (SELECT *, {_AS_OF} AS now FROM f WHERE us <= {_AS_OF} "
    "QUALIFY row_number() OVER (PARTITION BY \"user\" ORDER BY n DESC) = 1) x"
)
def lock_status(t: Tables) -> DataFrame:
    outcomes = lock.lockouts(v.attempts(t), lockout_seconds=_DAY)
    return lock.lock_status(outcomes, "2024-01-20")


# ------------------------------------------------------------------ policies


@query("SELECT role, resource, resource_type, pos, privilege, condition FROM v_privileges")
def flattened_roles(t: Tables) -> DataFrame:
    # One document per resource of a role; every other role comes wrapped in "role".
    lines = v.role_privileges(t)
    held = F.array_sort(F.collect_list(F.struct("pos", "privilege", "condition")))
    objects = lines.groupBy("role", "resource", "resource_type").agg(held.alias("held"))
    privileges = F.transform(
        "held", lambda h: F.struct(h["privilege"].alias("name"), h["condition"].alias("condition"))
    )
    role = F.struct(
        F.col("role").alias("name"),
        F.array(
            F.struct(
                F.col("resource").alias("fullName"),
                F.col("resource_type").alias("type"),
                privileges.alias("privileges"),
            )
        ).alias("securableObjects"),
    )
    wrapped = F.length("role") % 2 == 0
    docs = objects.select(
        F.when(wrapped, F.to_json(F.struct(role.alias("role")))).otherwise(F.to_json(role)).alias("json")
    )
    return p.flatten_roles(docs)


@query(
    "SELECT resource, 'role:' || role AS subject, string_agg(privilege, ',' ORDER BY pos) AS actions, "
    "'ALLOW' AS effect FROM v_privileges WHERE upper(condition) = 'ALLOW' GROUP BY role, resource"
)
def listed_policies(t: Tables) -> DataFrame:
    policies = p.list_policies(v.role_privileges(t))
    return policies.withColumn("actions", F.array_join("actions", ","))


@query(
    "SELECT seq, operation, role, subject, resource, privilege, reason, reason = '' AS valid FROM v_verdicts"
)
def validated_mutations(t: Tables) -> DataFrame:
    return p.validate_mutations(v.mutations(t)).drop("ts", "user", "tool", "backend_ok")


# The privileges, with a second line that denies what every role with an odd name length holds.
_AFTER = (
    "WITH p AS (SELECT role, resource, privilege, condition FROM v_privileges UNION ALL "
    "SELECT role, resource, privilege, 'DENY' FROM v_privileges WHERE length(role) % 2 = 1), "
    "e AS (SELECT role, resource, privilege, max(seq) FILTER (WHERE lower(operation) = 'revoke') AS r, "
    "max(seq) FILTER (WHERE lower(operation) = 'grant') AS g FROM v_verdicts "
    "WHERE reason = '' AND starts_with(subject, 'role:') GROUP BY role, resource, privilege), "
    "b AS (SELECT p.* FROM p LEFT JOIN e USING (role, resource, privilege) WHERE e.r IS NULL), "
    "a AS (SELECT * FROM b UNION ALL SELECT role, resource, privilege, 'ALLOW' FROM e "
    "WHERE g > coalesce(r, -1) AND NOT EXISTS (SELECT 1 FROM b WHERE b.role = e.role "
    "AND b.resource = e.resource AND b.privilege = e.privilege AND upper(b.condition) = 'ALLOW')) "
)


def _with_denials(t: Tables) -> DataFrame:
    lines = v.role_privileges(t)
    denied = lines.where(F.length("role") % 2 == 1).withColumn("condition", F.lit("DENY"))
    return lines.unionByName(denied)


@query(
    _AFTER + "SELECT role, resource, privilege, condition FROM a"
)
def privileges_after_mutations(t: Tables) -> DataFrame:
    after = p.apply_to_privileges(_with_denials(t), v.mutations(t))
    return after.select("role", "resource", "privilege", "condition")


@query(
    _AFTER + "SELECT resource, 'role:' || role AS subject, "
    "string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS actions, "
    "'ALLOW' AS effect FROM a WHERE upper(condition) = 'ALLOW' GROUP BY role, resource"
)
def policies_after_mutations(t: Tables) -> DataFrame:
    policies = p.list_policies(p.apply_to_privileges(_with_denials(t), v.mutations(t)))
    return policies.withColumn("actions", F.array_join(F.array_sort("actions"), ","))


@query(
    "WITH m AS (SELECT substr(subject, 6) AS \"user\", role, seq, lower(operation) AS op "
    "FROM v_verdicts WHERE reason = '' AND starts_with(subject, 'user:') UNION ALL "
    "SELECT \"user\", role, 0, 'grant' FROM v_user_roles), "
    "l AS (SELECT *, row_number() OVER (PARTITION BY \"user\", role ORDER BY seq DESC) AS n FROM m) "
    "SELECT \"user\", role FROM l WHERE n = 1 AND op = 'grant'"
)
def memberships_after_mutations(t: Tables) -> DataFrame:
    return p.apply_to_memberships(v.user_roles(t), v.mutations(t))


@query(
    "SELECT DISTINCT resource, CASE WHEN len(string_split(resource, '.')) >= 3 THEN 'TABLE' "
    "WHEN len(string_split(resource, '.')) = 2 THEN 'SCHEMA' ELSE 'CATALOG' END AS resource_type, "
    "regexp_replace(resource, '[^A-Za-z0-9._~-]', '', 'g') AS segment, resource AS qualified_name "
    "FROM v_privileges"
)
def described_resources(t: Tables) -> DataFrame:
    return p.describe_resources(v.role_privileges(t))


@query(
    "SELECT 'lake' AS catalog, catalog || '.' || schema AS schema, \"table\" FROM v_inventory"
)
def catalog_inventory(t: Tables) -> DataFrame:
    # One listing document per table, its namespace in two levels.
    entry = F.struct(
        F.array("catalog", "schema").alias("namespace"), F.col("table").alias("name")
    )
    docs = v.inventory(t).select(F.to_json(F.struct(F.array(entry).alias("identifiers"))).alias("json"))
    return p.catalog_inventory(docs, "lake")


@query("SELECT 'lake' AS catalog, catalog || '.' || schema AS schema FROM v_inventory")
def catalog_schemas(t: Tables) -> DataFrame:
    levels = F.array(F.array("catalog", "schema")).alias("namespaces")
    docs = v.inventory(t).select(F.to_json(F.struct(levels)).alias("json"))
    return p.catalog_schemas(docs, "lake")


@query(
    "WITH g AS (SELECT DISTINCT u.\"user\", resource, privilege FROM v_privileges r "
    "JOIN v_user_roles u ON u.role = r.role WHERE upper(condition) = 'ALLOW'), "
    "s AS (SELECT catalog, schema, \"table\", unnest([catalog, catalog || '.' || schema, "
    "catalog || '.' || schema || '.' || \"table\"]) AS scope FROM v_inventory) "
    "SELECT g.\"user\", catalog, schema, \"table\" FROM s JOIN g ON g.resource = s.scope "
    "WHERE privilege IN ('USE_CATALOG', 'USE_SCHEMA', 'SELECT_TABLE') "
    "GROUP BY ALL HAVING count(DISTINCT privilege) = 3"
)
def visible_tables(t: Tables) -> DataFrame:
    inventory = v.inventory(t).drop("_key")
    return p.visible_tables(inventory, v.role_privileges(t), v.user_roles(t))


@query(
    "WITH c AS (SELECT lower(replace(r_name, ' ', '_')) AS catalog, r_regionkey <> 1 AS reachable, "
    "r_regionkey <> 2 AS permitted FROM region UNION ALL SELECT 'nothing', true, true), "
    "n AS (SELECT catalog, count(DISTINCT schema) AS k FROM v_inventory GROUP BY catalog), "
    "r AS (SELECT c.catalog, CASE WHEN NOT reachable THEN 'unavailable' WHEN NOT permitted THEN 'forbidden' "
    "WHEN k IS NULL THEN 'empty' ELSE 'available' END AS status, coalesce(k, 0) AS k FROM c LEFT JOIN n USING (catalog)), "
    "a AS (SELECT i.* FROM v_inventory i JOIN r USING (catalog) WHERE status = 'available') "
    "SELECT 'catalog' AS kind, catalog AS path, CASE WHEN status = 'available' THEN k ELSE 0 END AS children, "
    "status FROM r UNION ALL SELECT 'schema', catalog || '.' || schema, count(*), NULL FROM a GROUP BY ALL "
    "UNION ALL SELECT 'table', catalog || '.' || schema || '.' || \"table\", 0, NULL FROM a"
)
def catalog_tree(t: Tables) -> DataFrame:
    catalogs = t["region"].select(
        F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("catalog"),
        (F.col("r_regionkey") != 1).alias("reachable"),
        (F.col("r_regionkey") != 2).alias("permitted"),
    )
    extra = t.spark.sql("SELECT 'nothing' AS catalog, true AS reachable, true AS permitted")
    return p.catalog_tree(v.inventory(t).drop("_key"), catalogs.unionByName(extra))
