"""Queries of scan reports, test reports and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeops.operators import reports as r
from lakeops.plans import fixtures as v
from lakeops.plans.fixtures import SQL_RANK, Tables
from lakeops.plans.registry import query
from lakeops.session import scratch_path
from lakeops.sources import files


@query(
    "SELECT 'app.jar' AS target, cve, CASE WHEN severity = '' THEN 'UNKNOWN' ELSE upper(severity) END AS severity, "
    "package, version, coalesce(fixed, '—') AS fixed, coalesce(title, description, '') AS description, "
    "coalesce(url, '') AS url FROM v_scan"
)
def package_findings(t: Tables) -> DataFrame:
    finding = F.struct(
        F.col("cve").alias("VulnerabilityID"),
        F.col("severity").alias("Severity"),
        F.col("package").alias("PkgName"),
        F.col("version").alias("InstalledVersion"),
        F.col("fixed").alias("FixedVersion"),
        F.col("title").alias("Title"),
        F.col("description").alias("Description"),
        F.col("url").alias("PrimaryURL"),
    )
    result = F.struct(F.lit("app.jar").alias("Target"), F.array(finding).alias("Vulnerabilities"))
    clean = F.struct(F.lit("clean.jar").alias("Target"), F.lit(None).alias("Vulnerabilities"))
    docs = v.scan_rows(t).select(
        F.to_json(F.struct(F.array(clean, result).alias("Results"))).alias("json")
    )
    return r.flatten_package_scan(docs)


@query(
    "SELECT cve, CASE WHEN severity = '' THEN 'UNKNOWN' ELSE upper(severity) END AS severity, package, "
    "CASE k % 4 WHEN 0 THEN (k % 10) || '.5' WHEN 1 THEN (k % 7) || '.1' WHEN 2 THEN (k % 9) || '.9' ELSE '' END AS score, "
    "coalesce(description, '') AS description, coalesce(url, '') AS url FROM v_scan"
)
def dependency_findings(t: Tables) -> DataFrame:
    key = F.col("_key")

    def score(modulus: int, tail: str):
        return F.concat((key % modulus).cast("string"), F.lit(tail))

    # The score sits in the newest version block, flat or nested, or nowhere.
    v4 = F.when(key % 4 == 0, F.struct(score(10, ".5").alias("baseScore")))
    v3 = F.when(
        key % 4 == 1,
        F.struct(F.struct(score(7, ".1").alias("baseScore")).alias("cvssData")),
    )
    v2 = F.when(key % 4 != 3, F.struct(score(9, ".9").alias("baseScore")))
    finding = F.struct(
        F.col("cve").alias("name"),
        "severity",
        v4.alias("cvssv4"),
        v3.alias("cvssv3"),
        v2.alias("cvssv2"),
        F.when(F.col("url").isNotNull(), F.array(F.struct("url"))).alias("references"),
        "description",
    )
    dependency = F.struct(
        F.col("package").alias("fileName"), F.array(finding).alias("vulnerabilities")
    )
    docs = v.scan_rows(t).select(
        F.to_json(F.struct(F.array(dependency).alias("dependencies"))).alias("json")
    )
    return r.flatten_dependency_scan(docs)


@query(
    f"SELECT row_number() OVER (ORDER BY {SQL_RANK}, cve) AS number, cve, severity FROM v_findings"
)
def sorted_findings(t: Tables) -> DataFrame:
    return r.sort_findings(v.findings(t).select("cve", "severity"))


@query(
    "WITH c AS (SELECT severity, count(*) AS n FROM v_findings GROUP BY severity) "
    f"SELECT string_agg(severity || ': ' || n, ', ' ORDER BY {SQL_RANK}, severity) AS summary FROM c"
)
def severity_summary(t: Tables) -> DataFrame:
    return r.severity_summary(v.findings(t))


_NOTE = "trim(replace(replace(description, '|', '\\|'), chr(10), ' '))"


@query(
    "SELECT CASE WHEN url <> '' THEN '[' || cve || '](' || url || ')' ELSE cve END AS cve, severity, package, "
    f"version, fixed, CASE WHEN length({_NOTE}) <= 180 THEN {_NOTE} ELSE substr({_NOTE}, 1, 179) || '…' END "
    "AS description FROM v_findings"
)
def findings_table(t: Tables) -> DataFrame:
    return r.findings_table(v.findings(t))


# ------------------------------------------------------------------ test reports


def _suites(t: Tables) -> DataFrame:
    """One suite document per part: a passed, a failed, an erroneous and a skipped case."""
    number = F.col("p_partkey").cast("string")
    xml = F.concat(
        F.lit('<testsuite name="suite '),
        number,
        F.lit('"><testcase name="ok" time="0.5"/><testcase name="bad" time="1.25"><failure message="boom '),
        number,
        F.lit('">trace</failure></testcase><testcase name="err"><error>'),
        F.lit("trace of "),
        number,
        F.lit('</error></testcase><testcase name="off" time="0"><skipped/></testcase></testsuite>'),
    )
    return t["part"].select(xml.alias("xml"))


@query(
    "SELECT 'suite ' || p_partkey AS suite, c.name, c.time, c.status, "
    "replace(c.details, '#', CAST(p_partkey AS VARCHAR)) AS details FROM part, (VALUES "
    "('ok', '0.5', 'Passed', ''), ('bad', '1.25', 'Failed', 'boom #'), "
    "('err', '0', 'Failed', 'trace of #'), ('off', '0', 'Skipped', '')) AS c(name, time, status, details)"
)
def test_cases(t: Tables) -> DataFrame:
    return r.parse_test_suites(_suites(t))


@query(
    "SELECT CAST(count(*) * 4 AS BIGINT) AS total, CAST(count(*) * 2 AS BIGINT) AS failed, "
    "CAST(count(*) AS BIGINT) AS skipped FROM part"
)
def test_totals(t: Tables) -> DataFrame:
    return r.test_totals(r.parse_test_suites(_suites(t)))


# ------------------------------------------------------------------ files


@query(
    "WITH s AS (SELECT path, size, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM v_files), "
    "d AS (SELECT path, size, p, unnest(range(len(p) + 1)) AS depth FROM s) "
    "SELECT path, size, CAST(depth AS INTEGER) AS depth, CASE WHEN depth = 0 THEN '/' ELSE p[depth] END AS label, "
    "'/' || array_to_string(p[1:depth], '/') AS crumb FROM d"
)
def path_breadcrumbs(t: Tables) -> DataFrame:
    return files.path_ancestors(v.site_files(t))


@query(
    "WITH s AS (SELECT size, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM v_files), "
    "d AS (SELECT size, '/' || array_to_string(p[1:unnest(range(len(p)))], '/') AS directory FROM s), "
    "g AS (SELECT directory, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY directory) "
    "SELECT directory, files, bytes, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 "
    "THEN printf('%d.%d KB', (bytes * 20 + 1024) // 2048 // 10, (bytes * 20 + 1024) // 2048 % 10) "
    "ELSE printf('%d.%d MB', (bytes * 20 + 1048576) // 2097152 // 10, (bytes * 20 + 1048576) // 2097152 % 10) END "
    "AS size_text FROM g"
)
def directory_rollup(t: Tables) -> DataFrame:
    return files.directory_rollup(v.site_files(t))


def _customer_files(t: Tables) -> str:
    """A folder with a directory for every hundred customers, and in it a file with a line for each."""
    path = scratch_path(t.spark, "customers")
    block = F.floor(F.col("c_custkey") / 100).cast("long").alias("block")
    rows = t["customer"].select(block, "c_custkey", F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("line"))
    # A directory is written by one task, so it has one file.
    rows = rows.repartition("block").sortWithinPartitions("block", "c_custkey")
    rows.select("block", "line").write.partitionBy("block").text(path)
    return path


_CUSTOMER_LINES = (
    "WITH l AS (SELECT CAST(floor(c_custkey / 100.0) AS BIGINT) AS block, c_custkey, "
    "c_custkey || '|' || c_name || '|' || c_mktsegment AS line FROM customer)"
)


@query(
    f"{_CUSTOMER_LINES}, f AS (SELECT 'block=' || block AS folder, CAST(sum(strlen(line) + 1) AS BIGINT) AS size FROM l GROUP BY block) "
    "SELECT folder, true AS directory, CAST(0 AS BIGINT) AS size, CAST(1 AS BIGINT) AS entries FROM f UNION ALL "
    "SELECT folder, false, size, 1 FROM f"
)
def written_entries(t: Tables) -> DataFrame:
    """The tree of files written from customers: every directory, and the files of each with their bytes."""
    path = _customer_files(t)
    listed = files.file_inventory(t.spark, path, recursive=True)
    folder = F.when(F.col("directory"), F.col("name")).otherwise(F.element_at(F.split("path", "/"), -2)).alias("folder")
    return listed.groupBy(folder, "directory").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("entries"))


@query(
    f"{_CUSTOMER_LINES} SELECT 'block=' || block AS folder, CAST(sum(strlen(line) + 1) AS BIGINT) AS size, "
    "left(string_agg(line, chr(10) ORDER BY c_custkey) || chr(10), 1000) AS preview FROM l GROUP BY block"
)
def written_heads(t: Tables) -> DataFrame:
    """The first 1000 bytes of every file written from customers."""
    heads = files.file_previews(t.spark, _customer_files(t), max_bytes=1000, recursive=True)
    return heads.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "size", "preview")
