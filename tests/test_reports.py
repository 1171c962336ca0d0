import json
import random

import pytest
from pyspark.sql import functions as F

from lakeops.operators import reports as r
from lakeops.operators.numbering import number_rows
from lakeops.sources import files


def test_package_scan(spark):
    doc = {
        "Results": [
            {"Target": "t", "Vulnerabilities": [
                {"VulnerabilityID": "CVE-1", "Severity": "high", "PkgName": "p", "InstalledVersion": "1", "FixedVersion": "", "Title": "", "Description": "d", "PrimaryURL": None},
                {"VulnerabilityID": "CVE-2"},
            ]},
            {"Target": "clean", "Vulnerabilities": None},
            {"Target": "absent"},
        ]
    }
    docs = spark.createDataFrame([(json.dumps(doc),), ("{}",), ('{"Results":null}',)], "json string")
    got = [tuple(x) for x in r.flatten_package_scan(docs).collect()]
    assert got == [
        ("t", "CVE-1", "HIGH", "p", "1", "—", "d", ""),
        ("t", "CVE-2", "UNKNOWN", "", "", "—", "", ""),
    ]


def test_dependency_scan_score_order(spark):
    cases = [
        ({"cvssv4": {"baseScore": 9.1}, "cvssv3": {"baseScore": 5.0}}, "9.1"),
        ({"cvssv4": {"cvssData": {"baseScore": 8.2}}, "cvssv2": {"baseScore": 1.0}}, "8.2"),
        ({"cvssv4": {}, "cvssv3": {"baseScore": 0}}, "0"),
        ({"cvssv2": {"baseScore": 2.5}}, "2.5"),
        ({}, ""),
    ]
    doc = {"dependencies": [{"fileName": "f.jar", "vulnerabilities": [
        {"name": f"CVE-{i}", "severity": "Low", "references": [{"url": "u"}, {"url": "v"}] if i else [], **extra} for i, (extra, _) in enumerate(cases)
    ]}, {"fileName": "none"}]}
    rows = r.flatten_dependency_scan(spark.createDataFrame([(json.dumps(doc),)], "json string")).orderBy("cve").collect()
    assert [x.score for x in rows] == [score for _, score in cases]
    assert [x.url for x in rows] == ["", "u", "u", "u", "u"]
    assert {(x.package, x.severity) for x in rows} == {("f.jar", "LOW")}


def test_summary_and_order(spark):
    names = ["LOW", "WEIRD", "", "MODERATE", "CRITICAL", "MEDIUM", "LOW", "UNKNOWN", "INFORMATIONAL"]
    df = spark.createDataFrame([(f"CVE-{i}", s) for i, s in enumerate(names)], "cve string, severity string")
    assert r.severity_summary(df).first()[0] == "CRITICAL: 1, MEDIUM: 1, MODERATE: 1, LOW: 2, INFORMATIONAL: 1, : 1, UNKNOWN: 1, WEIRD: 1"
    assert r.severity_summary(df.limit(0)).first()[0] == "none"
    order = [x.cve for x in r.sort_findings(df).orderBy("number").collect()]
    assert order == ["CVE-4", "CVE-3", "CVE-5", "CVE-0", "CVE-6", "CVE-8", "CVE-2", "CVE-7", "CVE-1"]


def test_numbering_matches_a_global_row_number(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i) for i in range(500)]
    got = number_rows(spark.createDataFrame(rows, "a int, b int"), [F.desc("a"), F.col("b")], "n", 7).collect()
    want = {row: n for n, row in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), start=1)}
    assert {(x.a, x.b): x.n for x in got} == want
    assert number_rows(spark.range(0).toDF("b"), [F.col("b")]).count() == 0


def test_findings_table(spark):
    df = spark.createDataFrame([("CVE|1", "HIGH", "p", "u", " a|b\nc "), ("CVE-2", "LOW", "p", "", "x" * 200)], "cve string, severity string, package string, url string, description string")
    rows = r.findings_table(df).collect()
    assert (rows[0].cve, rows[0].description) == ("[CVE\\|1](u)", "a\\|b c")
    assert rows[1].cve == "CVE-2" and len(rows[1].description) == 180 and rows[1].description.endswith("…")


SUITE = '<testsuite name="s"><testcase name="x" time="0.1"/><testcase name="y" time="2"><failure message="boom">trace</failure></testcase><testcase name="z"><skipped/></testcase></testsuite>'
ERROR = '<testsuite name="e"><testcase name="only" time="3"><error>stack</error></testcase></testsuite>'


def test_test_reports(spark, tmp_path):
    (tmp_path / "TEST-a.xml").write_text('<?xml version="1.0"?>\n' + SUITE)
    (tmp_path / "TEST-b.xml").write_text(ERROR)
    cases = r.read_test_reports(spark, str(tmp_path))
    rows = {x.name: tuple(x) for x in cases.collect()}
    assert rows == {
        "x": ("s", "x", "0.1", "Passed", ""),
        "y": ("s", "y", "2", "Failed", "boom"),
        "z": ("s", "z", "0", "Skipped", ""),
        "only": ("e", "only", "3", "Failed", "stack"),
    }
    assert tuple(r.test_totals(cases.where("suite = 's'")).first()) == (3, 1, 1)
    parsed = r.parse_test_suites(spark.createDataFrame([(SUITE,), (ERROR,)], "xml string"))
    assert sorted(map(tuple, parsed.collect())) == sorted(rows.values())


def _tree(top):
    (top / "sub" / "deep").mkdir(parents=True)
    (top / "empty").mkdir()
    (top / "a b.txt").write_bytes(b"x" * 70_000)
    (top / "a%20b#?.txt").write_bytes(b"other")
    (top / "_hidden").write_bytes(b"h")
    (top / "sub" / "c.bin").write_bytes(b"ok\xff")
    (top / "sub" / "deep" / "cut.txt").write_bytes("é".encode() * 3)
    (top / "sub" / "c.bin").chmod(0o640)
    (top / "sub").chmod(0o750)


def test_files(spark, tmp_path):
    _tree(tmp_path)
    (tmp_path / "loop").symlink_to(tmp_path)
    top = {x.name: x for x in files.file_inventory(spark, str(tmp_path)).collect()}
    assert {n: (x.directory, x.size) for n, x in top.items() if n != "loop"} == {
        "sub": (True, 0), "empty": (True, 0), "a b.txt": (False, 70_000), "a%20b#?.txt": (False, 5),
    }
    assert top["loop"].directory is False
    listed = {x.path.removeprefix(f"{tmp_path}/"): x for x in files.file_inventory(spark, f"{tmp_path}/", recursive=True).collect()}
    assert set(listed) == {"sub", "empty", "a b.txt", "a%20b#?.txt", "loop", "sub/c.bin", "sub/deep", "sub/deep/cut.txt"}
    found, s = listed["sub/c.bin"], (tmp_path / "sub" / "c.bin").stat()
    assert (found.owner, found.group, found.permission) == (
        (tmp_path / "sub" / "c.bin").owner(), (tmp_path / "sub" / "c.bin").group(), "640")
    assert listed["sub"].permission == "750"
    micros = files.file_inventory(spark, str(tmp_path / "sub" / "c.bin")).selectExpr("name", "unix_micros(modification_time) AS m").collect()
    assert [tuple(x) for x in micros] == [("c.bin", s.st_mtime_ns // 1000)]
    assert "_hidden" in {x.name for x in files.file_inventory(spark, f"file:{tmp_path}", hidden=True).collect()}
    assert files.file_inventory(spark, str(tmp_path / "empty"), recursive=True).count() == 0
    with pytest.raises(Exception, match="No such file"):
        files.file_inventory(spark, str(tmp_path / "absent")).collect()


def test_previews(spark, tmp_path):
    _tree(tmp_path)
    heads = {x.name: x.preview for x in files.file_previews(spark, str(tmp_path), recursive=True).collect()}
    assert len(heads["a b.txt"]) == 65_536 and heads["c.bin"] == "ok\ufffd" and heads["a%20b#?.txt"] == "other"
    cut = {x.name: x.preview for x in files.file_previews(spark, f"file://{tmp_path}", max_bytes=3, recursive=True).collect()}
    assert cut["cut.txt"] == "é\ufffd"


def test_stores_that_only_spark_reads(spark, tmp_path):
    _tree(tmp_path)
    listed = files._by_file_source(spark, str(tmp_path), True)
    found = {(x.path.removeprefix(f"file:{tmp_path}/"), x.name, x.directory, x.size) for x in listed.collect()}
    assert {x for x in found if "#" not in x[0]} == {
        ("sub", "sub", True, 0), ("sub/deep", "deep", True, 0), ("sub/c.bin", "c.bin", False, 3),
        ("sub/deep/cut.txt", "cut.txt", False, 6), ("a b.txt", "a b.txt", False, 70_000),
    }
    assert {(x.name, x.directory) for x in files._by_file_source(spark, str(tmp_path), False).collect()} >= {("sub", True), ("a b.txt", False)}
    with pytest.raises(ValueError):
        files.file_inventory(spark, "viewfs://x/y", hidden=True)


def test_breadcrumbs_and_rollup(spark):
    df = spark.createDataFrame([("/a//b/c.txt", 2000), ("/a/d", 24), ("/", 0)], "path string, size long")
    crumbs = files.path_ancestors(df).where("path = '/a//b/c.txt'").orderBy("depth").collect()
    assert [(x.label, x.crumb) for x in crumbs] == [("/", "/"), ("a", "/a"), ("b", "/a/b"), ("c.txt", "/a/b/c.txt")]
    assert [x.crumb for x in files.path_ancestors(df).where("path = '/'").collect()] == ["/"]
    rolled = {x.directory: (x.files, x.bytes, x.size_text) for x in files.directory_rollup(df.where("path <> '/'")).collect()}
    assert rolled == {"/": (2, 2024, "2.0 KB"), "/a": (2, 2024, "2.0 KB"), "/a/b": (1, 2000, "2.0 KB")}
