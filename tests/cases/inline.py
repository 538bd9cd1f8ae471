"""Operators over the inline corpora; inline_sql.py says the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import paths as P
from lodestrata.limits import DEFAULT
from lodestrata.operators import files as FILE
from lodestrata.operators import graph as G
from lodestrata.operators.configs import analyse_configs, npm_scripts
from lodestrata.operators.languages import matched
from lodestrata.operators.signatures import SIGNATURES, matches
from lodestrata.plans.scan import scan_rows
from lodestrata.sources.walk import WALK_SCHEMA

from . import corpora as C

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _files(spark: SparkSession) -> DataFrame:
    return C.inline(spark, C.FILES, "id long, path string, text string").withColumn("content", F.encode("text", "UTF-8"))


@query
def extension_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    return _files(spark).select("id", P.extension(path).alias("extension"), F.array_join(P.roles(path), ",").alias("roles"), P.language(path).alias("language"))


@query
def type_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, content = F.col("path"), F.col("content")
    suffix = P.extension(path)
    mime = FILE.detected_mime(content)
    found = FILE.type_mismatch(path, suffix, mime, F.col("text"))
    return _files(spark).select("id", found.alias("f")).filter("f is not null").select("id", "f.severity", F.col("f.score").cast("long").alias("score"), F.element_at("f.evidence", 1).alias("evidence"))


@query
def executable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = P.extension(F.col("path"))
    return _files(spark).select("id", FILE.executable_markers(F.col("text")).cast("long").alias("markers"), FILE.executable_content(F.col("path"), suffix, F.col("text")).isNotNull().alias("flagged"))


@query
def language_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, source = P.language(F.col("path")), F.lower("text")
    sources, sinks = matched(lang, source, 0), matched(lang, source, 1)
    return _files(spark).filter(lang.isNotNull()).select("id", lang.alias("language"), F.array_join(sources, ",").alias("sources"), F.array_join(sinks, ",").alias("sinks"))


@query
def signature_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = [F.when(matches(F.col("content"), patterns), F.lit(id)) for _, id, _, _, patterns in SIGNATURES]
    return _files(spark).select("id", F.explode(F.array_compact(F.array(*hits))).alias("rule"))


@query
def manifest_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifests = _files(spark).filter(P.basename(F.col("path")) == "package.json")
    return npm_scripts(manifests).select("path", "name", "command", "rule")


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    one = F.lit("r").alias("repo_id")
    modules = C.inline(spark, C.MODULES, "seq long, id string, path string").select(one, "*")
    imports = C.inline(spark, C.IMPORTS, "module_id string, seq long, specifier string, line long").select(one, "*")
    roots = C.inline(spark, C.ROOTS, "seq long, file string, trigger string, line long").select(one, "*")
    calls = C.inline(spark, C.CALLS, "module_id string, seq long, name string, line long, capability string, function string").select(one, "*", F.col("name").alias("evidence"))
    return modules, imports, roots, calls


@query
def import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, imports, _, _ = _graph(spark)
    return G.resolve_imports(imports, modules).select("module_id", "seq", "specifier", "target")


@query
def unresolved_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, imports, _, _ = _graph(spark)
    return G.unresolved_imports(imports, G.resolve_imports(imports, modules), modules).select("edge")


@query
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    modules, imports, roots, _ = _graph(spark)
    edges = G.import_edges(G.resolve_imports(imports, modules), modules)
    return G.reachable_modules(roots, edges, modules)[0].select("id", F.col("depth").cast("long").alias("depth"))


@query
def call_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.called_functions(_graph(spark)[3]).select("module_id", "function")


@query
def graph_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the import graph, routes included."""
    modules, imports, roots, calls = _graph(spark)
    edges = G.import_edges(G.resolve_imports(imports, modules), modules)
    reached, _ = G.reachable_modules(roots, edges, modules)
    signals = C.inline(spark, [("r", "src/a.js", ["possible XOR string decoder", "long timer delay"]), ("r", "icon.png", [])], "repo_id string, path string, raw_signals array<string>")
    return G.graph_findings(modules, calls, reached, signals).select("id", "file", "line", "severity", F.array_join("evidence", " | ").alias("evidence"))


def _walked(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Inline repositories as walked rows."""
    files = [(r, i, p, "file", len(t.encode()), False, None, None, t.encode(), "worktree", None) for i, (r, p, t) in enumerate(rows)]
    counts = [(r, 0, None, "#counts", sum(x[0] == r for x in rows), False, None, None, None, "worktree", "files") for r in sorted({x[0] for x in rows})]
    return spark.createDataFrame(files + counts, WALK_SCHEMA)


@query
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan over inline repositories: walk to findings."""
    result = scan_rows(_walked(spark, C.REPOSITORIES), DEFAULT)
    return result.findings.select("repo_id", "id", "severity", F.col("score").cast("long").alias("score"), "file", "line", F.element_at("evidence", 1).alias("first_evidence"))


@query
def configuration_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over manifests and developer-tool files of the inline repositories."""
    rows = [(r, i, p, t) for i, (r, p, t) in enumerate(C.REPOSITORIES)]
    found = analyse_configs(C.inline(spark, rows, "repo_id string, seq long, path string, text string"))
    return found.filter("id is not null").select("repo_id", "path", "id", "severity", F.col("score").cast("long").alias("score"), "line", F.array_join("evidence", " | ").alias("evidence"))
