"""Scan findings and test reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeops.functions.text import escape_cell, truncate_cell
from lakeops.operators.numbering import number_rows

# Place of each severity in a report; any other severity comes last.
SEVERITY_RANK = {
    "CRITICAL": 0,
    "HIGH": 1,
    "MEDIUM": 2,
    "MODERATE": 2,
    "LOW": 3,
    "INFO": 4,
    "INFORMATIONAL": 4,
    "UNKNOWN": 5,
    "": 5,
}
OTHER_RANK = 9
NO_FIX = "—"

PACKAGE_SCAN = (
    "Results array<struct<Target string, Vulnerabilities array<struct<VulnerabilityID string, "
    "Severity string, PkgName string, InstalledVersion string, FixedVersion string, "
    "Title string, Description string, PrimaryURL string>>>>"
)
_CVSS = "struct<baseScore string, cvssData struct<baseScore string>>"
DEPENDENCY_SCAN = (
    "dependencies array<struct<fileName string, vulnerabilities array<struct<name string, "
    f"severity string, cvssv4 {_CVSS}, cvssv3 {_CVSS}, cvssv2 {_CVSS}, "
    "references array<struct<url string>>, description string>>>>"
)
_PROBLEM = "struct<_VALUE string, _message string>"
SUITE = (
    f"_name string, testcase array<struct<_name string, _time string, failure {_PROBLEM}, "
    f"error {_PROBLEM}, skipped {_PROBLEM}>>"
)


def _first_text(*columns: Column | str) -> Column:
    """The first column that is neither null nor empty, else empty text."""
    picked = F.lit("")
    for column in reversed(columns):
        value = F.col(column) if isinstance(column, str) else column
        picked = F.when(F.coalesce(value, F.lit("")) != "", value).otherwise(picked)
    return picked


def _severity(column: str) -> Column:
    return F.upper(_first_text(column, F.lit("UNKNOWN")))


def flatten_package_scan(docs: DataFrame, column: str = "json") -> DataFrame:
    """Package scan documents to one line per finding."""
    doc = F.from_json(F.col(column), PACKAGE_SCAN)
    result = docs.select(F.explode(doc["Results"]).alias("_r"))
    found = result.select(
        F.col("_r.Target").alias("target"), F.explode("_r.Vulnerabilities").alias("_v")
    ).select("target", "_v.*")
    return found.select(
        F.coalesce("target", F.lit("")).alias("target"),
        F.coalesce("VulnerabilityID", F.lit("")).alias("cve"),
        _severity("Severity").alias("severity"),
        F.coalesce("PkgName", F.lit("")).alias("package"),
        F.coalesce("InstalledVersion", F.lit("")).alias("version"),
        _first_text("FixedVersion", F.lit(NO_FIX)).alias("fixed"),
        _first_text("Title", "Description").alias("description"),
        F.coalesce("PrimaryURL", F.lit("")).alias("url"),
    )


def flatten_dependency_scan(docs: DataFrame, column: str = "json") -> DataFrame:
    """Dependency scan documents to one line per finding; the score is the newest CVSS version's."""
    doc = F.from_json(F.col(column), DEPENDENCY_SCAN)
    dependency = docs.select(F.explode(doc["dependencies"]).alias("_d"))
    found = dependency.select(
        F.col("_d.fileName").alias("file"), F.explode("_d.vulnerabilities").alias("_v")
    ).select("file", "_v.*")
    scores = [f"{v}.{at}" for v in ("cvssv4", "cvssv3", "cvssv2") for at in ("baseScore", "cvssData.baseScore")]
    return found.select(
        F.coalesce("name", F.lit("")).alias("cve"),
        _severity("severity").alias("severity"),
        F.coalesce("file", F.lit("")).alias("package"),
        F.coalesce(*scores, F.lit("")).alias("score"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(F.get("references", F.lit(0))["url"], F.lit("")).alias("url"),
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(OTHER_RANK)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(severity == name, value).otherwise(rank)
    return rank


def sort_findings(findings: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """Findings with their place in the report, ordered by severity rank and id.

    ``tie`` names further columns that order findings of one id.
    """
    order = [severity_rank(F.col("severity")), F.col("cve"), *[F.col(c) for c in tie or []]]
    return number_rows(findings, order, "number")


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def severity_summary(findings: DataFrame) -> DataFrame:
    """One row ``summary`` such as ``CRITICAL: 2, LOW: 5``, or ``none``.

    Severities of one rank are ordered by name.
    """
    entry = F.struct(
        severity_rank(F.col("severity")).alias("rank"), F.col("severity"), F.col("findings")
    )
    # One entry per severity name.
    ordered = F.array_sort(F.collect_list(entry))
    text = F.array_join(
        F.transform(
            ordered, lambda s: F.concat(s["severity"], F.lit(": "), s["findings"].cast("string"))
        ),
        ", ",
    )
    summary = F.when(F.count(F.lit(1)) == 0, "none").otherwise(text)
    return severity_counts(findings).agg(summary.alias("summary"))


def findings_table(findings: DataFrame) -> DataFrame:
    """Presentation columns: escaped text, linked ids and shortened descriptions."""
    cve = escape_cell("cve")
    linked = F.concat(F.lit("["), cve, F.lit("]("), F.col("url"), F.lit(")"))
    shown = [
        F.when(F.coalesce("url", F.lit("")) != "", linked).otherwise(cve).alias("cve"),
        escape_cell("severity").alias("severity"),
    ]
    for name in ("score", "package", "version", "fixed"):
        if name in findings.columns:
            shown.append(escape_cell(name).alias(name))
    kept = [c for c in ("number",) if c in findings.columns]
    return findings.select(*kept, *shown, truncate_cell("description").alias("description"))


def _cases(suites: DataFrame) -> DataFrame:
    exploded = suites.select(
        F.coalesce("_name", F.lit("")).alias("suite"), F.explode("testcase").alias("_c")
    ).select("suite", "_c.*")
    problem = F.coalesce("failure", "error")
    return exploded.select(
        "suite",
        F.coalesce("_name", F.lit("")).alias("name"),
        F.coalesce("_time", F.lit("0")).alias("time"),
        F.when(problem.isNotNull(), "Failed")
        .when(F.col("skipped").isNotNull(), "Skipped")
        .otherwise("Passed")
        .alias("status"),
        F.when(problem.isNotNull(), _first_text(problem["_message"], problem["_VALUE"]))
        .otherwise("")
        .alias("details"),
    )


def read_test_reports(spark: SparkSession, path: str) -> DataFrame:
    """Suite XML files to one line per test case."""
    return _cases(spark.read.schema(SUITE).option("rowTag", "testsuite").format("xml").load(path))


def parse_test_suites(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Suite documents in a text column to one line per test case."""
    suite = F.from_xml(F.col(column), F.lit(SUITE))
    return _cases(docs.select(suite.alias("_s")).select("_s.*"))


def test_totals(cases: DataFrame) -> DataFrame:
    return cases.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.count_if(F.col("status") == "Skipped").alias("skipped"),
    )


test_totals.__test__ = False  # not a test
