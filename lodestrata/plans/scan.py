"""The whole scan as one plan over any number of repositories."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..js.tables import analyse_sources, flow_findings
from ..limits import PROFILES, ScanLimits
from ..operators import graph as G
from ..operators.budget import within_budget
from ..operators.configs import analyse_configs, execution_roots
from ..operators.files import classify
from ..operators.findings import FINDING_FIELDS, cap_per_repo, finding, risk, severity_rank
from ..operators.languages import analyse_languages
from ..operators.ranges import places
from ..schemas import FILES
from ..sources.walk import walk_repositories
from ..storage import durable

#: Numbers of a file's modules and roots are its own number times this, plus their place.
PER_FILE = 1_000_000
FINDING_LIMIT = "finding limit reached"


@dataclass
class ScanResult:
    files: DataFrame
    findings: DataFrame
    unresolved: DataFrame
    coverage: DataFrame
    summary: DataFrame
    counts: DataFrame

    def report_rows(self) -> DataFrame:
        """One row per repository with everything nested, in report order."""
        def gathered(df: DataFrame, value, name: str) -> DataFrame:
            return df.groupBy("repo_id").agg(F.array_sort(F.collect_list(value)).alias(name))

        rank = F.struct("place", F.struct(*FINDING_FIELDS).alias("f"))
        place = G.numbered(self.findings, [F.col("severity_rank").desc(), F.col("file").asc_nulls_first(), "id", "emit_seq"], "place")
        findings = gathered(place, rank, "findings").withColumn("findings", F.transform("findings", lambda x: x["f"]))
        record = F.struct(*[c for c in FILES.fieldNames() if c not in ("repo_id", "seq")])
        files = gathered(self.files, record, "files")
        out = self.summary
        for part in (files, findings, gathered(self.unresolved, F.col("edge"), "unresolved_edges"), gathered(self.coverage, F.col("reason"), "incomplete_reasons")):
            out = out.join(part, "repo_id", "left")
        for name in ("files", "findings", "unresolved_edges", "incomplete_reasons"):
            out = out.withColumn(name, F.coalesce(name, F.expr(f"cast(array() as {out.schema[name].dataType.simpleString()})")))
        return out


def greedy_modules(modules: DataFrame, limits: ScanLimits) -> tuple[DataFrame, DataFrame]:
    """(modules within the budgets, reasons): a module that doesn't fit is left out, later smaller ones may still fit, up to so many. Only sizes are folded, of repositories that are over a budget."""
    sizes = modules.select("repo_id", "seq", "source_bytes")
    over = sizes.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("source_bytes").alias("b")).filter((F.col("n") > limits.modules) | (F.col("b") > limits.module_bytes)).select("repo_id")
    todo = durable(sizes.join(over, "repo_id", "left_semi"), "module-sizes")
    dropped = todo.select("repo_id", "seq")
    if not todo.isEmpty():
        judged = durable(within_budget(todo, "repo_id", ["seq"], "source_bytes", limits.module_bytes), "module-budget")
        late = places(judged.filter("fits").select("repo_id", "seq"), ["repo_id"], ["seq"]).filter(F.col("place") > limits.modules)
        dropped = durable(judged.filter("not fits").select("repo_id", "seq").unionByName(late.select("repo_id", "seq")), "module-dropped")
    first = dropped.groupBy("repo_id").agg(F.min("seq").alias("seq")).join(modules.select("repo_id", "seq", "path", "origin"), ["repo_id", "seq"])
    where = F.when(F.col("origin") == "archive", F.concat(F.lit("archive member "), "path")).otherwise(F.col("path"))
    text = F.concat(F.lit(f"JS/TS global semantic analysis limit of {limits.modules} modules or {limits.module_bytes} source bytes reached before "), where, F.lit("; additional modules were omitted"))
    return modules.join(dropped, ["repo_id", "seq"], "left_anti"), first.select("repo_id", text.alias("reason"))


def _walk_findings(raw: DataFrame) -> DataFrame:
    path = F.col("path")
    target = F.array(F.concat(F.lit("target: "), F.col("symlink_target")))
    none = F.array().cast("array<string>")
    found = (
        F.when(F.col("kind") == "#escape", finding("FS-PATH-ESCAPE", "high", "high", 80, "Path escaped repository root", "A repository entry resolved outside the scan root and was not read.", file=path, evidence=none))
        .when(F.col("kind") == "special", finding("FS-SPECIAL-FILE", "medium", "very_high", 45, "Repository contains a special file", "Devices, FIFOs, and sockets are never opened by the scanner.", file=path, evidence=none))
        .when(F.col("note") == "escapes", finding("FS-SYMLINK-ESCAPE", "high", "very_high", 80, "Symlink escapes repository root", "The symlink target is outside the repository and was not read.", file=path, evidence=target))
        .when(F.col("note") == "absolute", finding("FS-ABSOLUTE-SYMLINK", "medium", "very_high", 40, "Repository contains an absolute symlink", "Absolute symlinks are not followed during scanning.", file=path, evidence=target))
    )
    return raw.filter(~F.col("kind").isin("#reason", "#counts")).select("repo_id", F.col("seq").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), found.alias("found")).filter("found is not null")


def scan_repositories(spark: SparkSession, paths: dict[str, str], profile: str = "default", limits: ScanLimits | None = None) -> ScanResult:
    """Scans repositories {repo_id: path} with a profile's limits."""
    limits = limits or PROFILES[profile]
    raw = durable(walk_repositories(spark, paths, limits), "walk")
    return scan_rows(raw, limits)


def scan_rows(raw: DataFrame, limits: ScanLimits) -> ScanResult:
    """The scan of walked rows; see walk.WALK_SCHEMA. Contents are read once, by classification; later steps see decoded text."""
    real = raw.filter(~F.col("kind").startswith("#"))
    files = durable(analyse_languages(classify(real), limits.language_bytes).drop("content"), "classified")
    texts = files.filter("content_scanned")
    configs = durable(analyse_configs(texts, limits), "configs")
    sources = durable(analyse_sources(texts, limits), "sources")
    origins = files.select("repo_id", "seq", "origin")

    # Modules and what they import and call
    module = sources.join(origins, ["repo_id", "seq"]).select("repo_id", F.col("seq").alias("file_seq"), "path", "origin", F.posexplode("modules").alias("place", "m"))
    module = module.select("repo_id", (F.col("file_seq") * PER_FILE + F.col("place")).alias("seq"), "path", "origin", "m.*")
    modules, module_reasons = greedy_modules(durable(module, "modules"), limits)
    imports = modules.select("repo_id", F.col("id").alias("module_id"), F.col("seq").alias("module_seq"), F.posexplode("imports").alias("seq", "i")).select("repo_id", "module_id", "module_seq", F.col("seq").cast("long").alias("seq"), "i.*")
    calls = modules.select("repo_id", F.col("id").alias("module_id"), F.posexplode("calls").alias("seq", "c")).select("repo_id", "module_id", F.col("seq").cast("long").alias("seq"), "c.*")

    # Execution roots
    commands = durable(execution_roots(texts, limits), "roots")
    named = commands.filter("file is not null").select("repo_id", (F.col("file_seq") * PER_FILE + F.col("position")).alias("seq"), "file", "trigger", "line")
    document = F.when(F.col("origin") == "archive", "inline script in archive document ").otherwise("inline script in HTML document ")
    inline = sources.join(origins, ["repo_id", "seq"]).select("repo_id", F.col("seq").alias("file_seq"), F.concat(document, "path").alias("trigger"), F.posexplode("embedded").alias("place", "e"))
    inline = inline.select("repo_id", (F.col("file_seq") * PER_FILE + limits.roots_per_file + F.col("place")).alias("seq"), F.col("e.id").alias("file"), "trigger", F.col("e.line").alias("line"))
    roots, roots_over = cap_per_repo(named.unionByName(inline), limits.roots, "seq")

    # Graph and flow
    slim = modules.select("repo_id", "seq", "id", "path")
    resolved = durable(G.resolve_imports(imports, slim), "resolved")
    edges, lost, cut = G.within_edge_limit(G.import_edges(resolved, slim), G.lost_imports(imports, resolved, slim), imports, slim, limits.graph_edges)
    reached, route_limits = G.reachable_modules(roots, edges, slim, limits.route_length)
    graph_found = G.graph_findings(slim, calls, reached, files)
    flows = durable(flow_findings(modules, reached, limits), "flows")
    flow_found = flows.filter("reason is null").withColumn("emit_seq", F.col("position"))
    combined = G.combined_chains(flow_found)
    unresolved = lost.select("repo_id", "edge").unionByName(G.unresolved_roots(roots, slim)).distinct()

    # Findings in order of emission: by file (classifier, configuration, JavaScript, language), then graph, flow, walk
    disguised = sources.filter("disguised").select("repo_id", "seq", "path", F.lit(True).alias("disguised"))
    own = files.join(disguised.drop("path"), ["repo_id", "seq"], "left")
    shown = F.when(F.col("disguised"), F.filter("found", lambda f: f["id"] != "FILE-EXECUTABLE-CONTENT")).otherwise(F.col("found"))
    suffix = F.regexp_extract("path", r"[^/]\.([^./]*)$", 1)
    parsed = finding(
        "FILE-PARSEABLE-JAVASCRIPT", "medium", "high", 45, "JavaScript parses under a non-code extension",
        "Executable-looking text was parsed as JavaScript. No execution path is established by this finding alone.", file=F.col("path"),
        evidence=F.array(F.concat(F.lit("extension: ."), F.when(suffix == "", "(none)").otherwise(suffix))),
    )

    def listed(df: DataFrame, array: str, producer: int) -> DataFrame:
        return df.select("repo_id", F.col("seq").alias("a"), F.lit(producer).alias("b"), F.posexplode(array).alias("c", "found"))

    as_struct = F.struct(*FINDING_FIELDS)
    parts = [
        listed(own.withColumn("shown", shown), "shown", 0)
        .unionByName(configs.filter("id is not null").select("repo_id", F.col("seq").alias("a"), F.lit(1).alias("b"), F.col("position").alias("c"), as_struct.alias("found")))
        .unionByName(disguised.select("repo_id", F.col("seq").alias("a"), F.lit(2).alias("b"), F.lit(0).alias("c"), parsed.alias("found")))
        .unionByName(listed(files, "language_found", 3)),
        graph_found.select("repo_id", F.col("module_seq").alias("a"), F.lit(0).alias("b"), F.col("position").alias("c"), as_struct.alias("found")),
        flow_found.select("repo_id", F.lit(0).cast("long").alias("a"), F.lit(0).alias("b"), F.col("position").cast("int").alias("c"), as_struct.alias("found"))
        .unionByName(combined.select("repo_id", F.lit(1).cast("long").alias("a"), F.lit(0).alias("b"), F.col("emit_seq").cast("int").alias("c"), as_struct.alias("found"))),
        _walk_findings(raw),
    ]
    ordered = G.numbered(G.union_in_order(parts), ["part", "a", "b", "c"]).select("repo_id", "emit_seq", "found.*")
    findings, over = cap_per_repo(durable(ordered, "findings"), limits.max_findings)
    findings = with_rank(findings)

    reasons = [
        raw.filter("kind = '#reason'").select("repo_id", F.col("note").alias("reason")),
        configs.select("repo_id", F.explode("reasons").alias("reason")),
        sources.select("repo_id", F.explode("reasons").alias("reason")),
        files.filter("language_reason is not null").select("repo_id", F.col("language_reason").alias("reason")),
        module_reasons,
        commands.filter("limited").join(files.select("repo_id", F.col("seq").alias("file_seq"), "path"), ["repo_id", "file_seq"]).select("repo_id", F.concat(F.lit("JS/TS execution root extraction limit reached: "), "path").alias("reason")),
        roots_over.select("repo_id", F.lit(f"JS/TS global execution root limit of {limits.roots} reached; remaining roots omitted").alias("reason")),
        route_limits.select("repo_id", F.lit(f"JS/TS execution route depth limit of {limits.route_length} reached").alias("reason")),
        cut.select("repo_id", F.lit(f"JS/TS graph edge limit of {limits.graph_edges} reached").alias("reason")),
        flows.filter("reason is not null").select("repo_id", "reason"),
        over.select("repo_id", F.lit(FINDING_LIMIT).alias("reason")),
    ]
    coverage = reduce(DataFrame.unionByName, reasons).distinct()
    languages = sources.select("repo_id", "seq", F.col("language").alias("js_language"))
    records = files.join(languages, ["repo_id", "seq"], "left").withColumn("parsed_language", F.coalesce("js_language", "language")).select(*FILES.fieldNames())
    counts = raw.filter("kind = '#counts'").select("repo_id", "note", "size")
    return ScanResult(records, findings, unresolved, coverage, summaries(counts, findings, coverage), counts)


def summaries(counts: DataFrame, findings: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per repository of counts(repo_id, note, size): totals, risk and status."""
    totals = counts.groupBy("repo_id").pivot("note", ["entries", "files", "directories", "symlinks", "special_files", "content_bytes"]).agg(F.first("size"))
    struct = F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("entries", "files", "directories", "symlinks", "special_files", "content_bytes")], F.coalesce("n", F.lit(0)).cast("long").alias("findings"))
    joined = totals.join(findings.groupBy("repo_id").agg(F.count("*").alias("n")), "repo_id", "left").join(risk(findings), "repo_id", "left").join(coverage.groupBy("repo_id").agg(F.count("*").alias("reasons")), "repo_id", "left")
    return joined.select(
        "repo_id", struct.alias("summary"), F.struct(F.coalesce("severity", F.lit("informational")).alias("severity"), F.coalesce("score", F.lit(0)).cast("int").alias("score")).alias("risk"),
        F.when(F.coalesce("reasons", F.lit(0)) > 0, "incomplete").otherwise("complete").alias("status"),
    )


def with_history(result: ScanResult, found: DataFrame, reasons: DataFrame, limits: ScanLimits) -> ScanResult:
    """result with the findings of commits behind its own, within the same limit, and its summary made anew."""
    own = result.findings.drop("severity_rank").withColumn("part", F.lit(0))
    ordered = G.numbered(own.unionByName(found.withColumn("part", F.lit(1))).withColumnRenamed("emit_seq", "before"), ["part", "before"]).drop("part", "before")
    findings, over = cap_per_repo(durable(ordered, "findings"), limits.max_findings)
    findings = with_rank(findings)
    coverage = result.coverage.unionByName(reasons).unionByName(over.select("repo_id", F.lit(FINDING_LIMIT).alias("reason"))).distinct()
    counts = result.counts
    return ScanResult(result.files, findings, result.unresolved, coverage, summaries(counts, findings, coverage), counts)


def with_rank(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity_rank", severity_rank(F.col("severity")))

