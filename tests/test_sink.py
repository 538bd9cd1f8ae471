"""The report sink: streamed files equal rendered ones, a job that fails shows nothing."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.findings import FINDING_FIELDS
from lodestrata.report import sink
from lodestrata.report.render import report_of, to_json, to_sarif

SUMMARY = "repo_id string, status string, risk struct<severity: string, score: int>, summary struct<files: long, findings: long>"
FINDINGS = "repo_id string, id string, severity string, confidence string, score int, title string, message string, file string, line long, evidence array<string>, emit_seq long, severity_rank int"


def tables(spark):
    summary = spark.createDataFrame([("a/b c", "complete", ("critical", 97), (3, 4)), ("empty", "incomplete", ("informational", 0), (0, 0)), ("é", "complete", ("low", 10), (1, 1))], SUMMARY)
    found = [
        ("a/b c", "R2", "low", "high", 10, "two", "m \"q\"", "x.js", 4, ["e1", "é\n"], 1, 1), ("a/b c", "R1", "critical", "very_high", 97, "one", "m", None, None, [], 2, 4),
        ("a/b c", "R2", "low", "high", 10, "two", "m", "a ü.js", None, ["e"], 3, 1), ("a/b c", "R1", "critical", "high", 97, "one again", "m", "z", 1, [], 4, 4), ("é", "R1", "low", "low", 10, "one", "m", "f", 2, [], 0, 1),
    ]
    return summary, spark.createDataFrame(found, FINDINGS)


def expected(summary, findings):
    out = {}
    for r in summary.collect():
        own = [f.asDict() for f in findings.collect() if f.repo_id == r.repo_id]
        own.sort(key=lambda f: (-f["severity_rank"], f["file"] is not None, f["file"] or "", f["id"], f["emit_seq"]))
        row = {"status": r.status, "risk": r.risk.asDict(), "summary": r.summary.asDict(), "files": [], "findings": [{k: f[k] for k in FINDING_FIELDS} for f in own], "unresolved_edges": ["x -> y"] if r.repo_id == "é" else [], "incomplete_reasons": []}
        out[r.repo_id] = report_of(row, r.repo_id)
    return out


@pytest.mark.parametrize("kind, render", [("json", to_json), ("sarif", to_sarif)])
def test_files_equal_rendered_reports(spark, tmp_path, kind, render):
    summary, findings = tables(spark)
    edges = spark.createDataFrame([("é", "x -> y")], "repo_id string, edge string")
    sink.write_reports(sink.report_lines(summary, findings, {3: (edges, F.to_json(F.struct("edge")))} if False else {3: (edges, F.concat(F.lit('"'), "edge", F.lit('"')))}), str(tmp_path / "out"), kind)
    names = json.loads((tmp_path / "out" / sink.MANIFEST).read_text())["reports"]
    assert sorted(os.listdir(tmp_path / "out")) == sorted([sink.MANIFEST, *names])
    for repo, report in expected(summary, findings).items():
        written = json.loads((tmp_path / "out" / (sink.quote(repo, safe="") + sink.SUFFIXES[kind])).read_text())
        assert written == json.loads(render(report))


def test_overwrite_replaces_earlier_reports(spark, tmp_path):
    summary, findings = tables(spark)
    out = str(tmp_path / "out")
    sink.write_reports(sink.report_lines(summary, findings), out, "json")
    sink.write_reports(sink.report_lines(summary.filter("repo_id = 'empty'"), findings.limit(0)), out, "json")
    assert sorted(os.listdir(out)) == [sink.MANIFEST, "empty.json"]


def test_a_failed_task_leaves_nothing_visible(spark, tmp_path):
    out = tmp_path / "out"
    rows = [(f"r{i}", 0, 0, json.dumps({"status": "complete", "profile": "p", "rules": []})) for i in range(8)] + [("r5", 2, 1, "{ broken")]
    with pytest.raises(Exception, match=r"Expecting property name|PYTHON|broken"):
        sink.write_reports(spark.createDataFrame(rows, sink.COLUMNS), str(out), "json")
    assert not out.exists() or os.listdir(out) == []


def test_no_rows(spark, tmp_path):
    sink.write_reports(spark.createDataFrame([], sink.COLUMNS), str(tmp_path / "none"), "sarif")
    assert os.listdir(tmp_path / "none") == [sink.MANIFEST]
