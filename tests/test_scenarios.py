"""The quick ones of the case queries against their written-out rows; test_scan.py scans whole repositories."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from tests.cases import inline, inline_sql
from tests.cases.case_rows import EXPECTED
from tests.cases.scenarios import QUERIES

QUICK = [
    "signal_samples", "module_imports", "module_calls", "module_languages", "command_targets", "script_chains", "execution_root_files", "name_tables", "document_scripts", "source_variants", "rule_catalogue",
    "walked_tree", "git_diff_report", "project_findings", "project_routes", "project_summaries", "report_lines",
]


@pytest.mark.parametrize("name", QUICK)
def test_rows(spark, name):
    columns, rows = EXPECTED[name]
    found = QUERIES[name](spark, "")
    assert found.columns == [c.split(" ")[0] for c in columns.split(", ")]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, rows))


def test_every_oracle_has_its_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(inline.QUERIES))
def test_inline_queries_match_their_sql(spark, name):
    found = inline.QUERIES[name](spark, "")
    if name not in inline_sql.ORACLE_SQL:  # routes and whole scans are written out
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, EXPECTED[name][1]))
        return
    told = duckdb.connect().execute(inline_sql.ORACLE_SQL[name])
    assert comparable([tuple(r) for r in found.collect()], found.columns) == comparable(told.fetchall(), [c[0] for c in told.description])
