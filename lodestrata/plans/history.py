"""What commits introduced: the file rules over changed blobs, minus what the blobs before them had."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..js.tables import analyse_sources
from ..limits import PROFILES, ScanLimits
from ..operators import graph as G
from ..operators.configs import analyse_configs
from ..operators.files import classify
from ..operators.findings import FINDING_FIELDS, cap_per_repo, finding
from ..operators.languages import analyse_languages
from ..sources.git import changed_blobs, parse_range
from ..storage import durable


@dataclass
class ChangeResult:
    findings: DataFrame  # repo_id, commit_no, commit, path, place, and the finding
    coverage: DataFrame
    counts: DataFrame  # repo_id, changed_blobs


def _blob_findings(blobs: DataFrame, limits: ScanLimits) -> tuple[DataFrame, DataFrame]:
    """(findings, reasons) of blobs(repo_id, seq, path, content), the JavaScript graph and flow left out."""
    rows = blobs.select("repo_id", "seq", "path", F.lit("file").alias("kind"), "size", F.lit(False).alias("readonly"), F.lit(None).cast("int").alias("mode"), F.lit(None).cast("string").alias("symlink_target"), "content", F.lit("git").alias("origin"))
    files = durable(analyse_languages(classify(rows), limits.language_bytes).drop("content"), "blob-files")
    configs, sources = durable(analyse_configs(files, limits), "blob-configs"), durable(analyse_sources(files, limits), "blob-sources")
    suffix = F.regexp_extract("path", r"[^/]\.([^./]*)$", 1)
    parsed = finding(
        "FILE-PARSEABLE-JAVASCRIPT", "medium", "high", 45, "JavaScript parses under a non-code extension",
        "Executable-looking text was parsed as JavaScript. No execution path is established by this finding alone.", file=F.col("path"),
        evidence=F.array(F.concat(F.lit("extension: ."), F.when(suffix == "", "(none)").otherwise(suffix))),
    )
    as_struct = F.struct(*FINDING_FIELDS).alias("f")
    found = G.union_in_order([
        files.select("repo_id", "seq", F.posexplode("found").alias("position", "f")),
        configs.filter("id is not null").select("repo_id", "seq", "position", as_struct),
        sources.filter("disguised").select("repo_id", "seq", F.lit(0).alias("position"), parsed.alias("f")),
        files.select("repo_id", "seq", F.posexplode("language_found").alias("position", "f")),
    ])
    reasons = (
        configs.select("repo_id", F.explode("reasons").alias("reason"))
        .unionByName(sources.select("repo_id", F.explode("reasons").alias("reason")))
        .unionByName(files.filter("language_reason is not null").select("repo_id", F.col("language_reason").alias("reason")))
    )
    return found, reasons


def compare_commits(spark: SparkSession, paths: dict[str, str], base: str | None, limits: ScanLimits) -> ChangeResult:
    """New findings between base and HEAD, or of each commit of the history where base is None."""
    changes = durable(changed_blobs(spark, paths, base, limits), "changes")
    blobs = changes.filter(F.col("side").isin("new", "old"))
    # A blob's number within its repository: commits first, then the file's place, then the side.
    numbered = durable(G.numbered(blobs.withColumnRenamed("seq", "place"), ["commit_no", "place", "side"], "seq"), "blobs")
    found, reasons = _blob_findings(numbered, limits)
    keyed = found.join(numbered.select("repo_id", "seq", "commit_no", "commit", "path", "place", "side"), ["repo_id", "seq"])
    line = F.coalesce("f.line", F.lit(0))
    keyed = keyed.withColumn("key", F.concat_ws("|", "f.id", line.cast("string"), F.array_join("f.evidence", "|")))
    keys = ["repo_id", "commit_no", "place", "key"]
    # Of findings of a blob with the same key the last one stands, as a key doesn't hold all fields.
    current = keyed.filter("side = 'new'").groupBy(*keys, "commit", "path").agg(F.max_by("f", F.struct("part", "position")).alias("f"))
    fresh = current.join(keyed.filter("side = 'old'").select(*keys).distinct(), keys, "left_anti")
    unread = changes.filter("side = 'reason'").select("repo_id", F.col("note").alias("reason"))
    findings = fresh.select("repo_id", "commit_no", "commit", "path", "place", "key", "f.*")
    return ChangeResult(findings, unread.unionByName(reasons).distinct(), changes.filter("side = 'count'").groupBy("repo_id").agg(F.sum("size").alias("changed_blobs")))


def diff_repositories(spark: SparkSession, paths: dict[str, str], commit_range: str, limits: ScanLimits | None = None) -> ChangeResult:
    return compare_commits(spark, paths, parse_range(commit_range), limits or PROFILES["default"])


def scan_history(spark: SparkSession, paths: dict[str, str], profile: str = "default", limits: ScanLimits | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings as a scan reports them, reasons) of the commits of each repository."""
    limits = limits or PROFILES[profile]
    result = compare_commits(spark, paths, None, limits)
    told = F.concat(F.lit("A scanner finding first appeared in this historical blob. Current worktree contents may differ. "), "message")
    rows = result.findings.withColumn("title", F.concat(F.lit("Historical commit introduced: "), "title")).withColumn("message", told).withColumn("evidence", F.concat("evidence", F.array(F.concat(F.lit("commit: "), "commit"))))
    ordered = G.numbered(rows, ["commit_no", "place", "key"])
    # The cap ends a commit, not the walk: once it is reached, each later commit still adds its first finding.
    first = Window.partitionBy("repo_id", "commit_no").orderBy("emit_seq")
    shown = ordered.withColumn("n", F.row_number().over(first)).filter((F.col("emit_seq") <= limits.git_history_findings) | (F.col("n") == 1)).drop("n")
    _, over = cap_per_repo(ordered.withColumn("emit_seq", F.col("emit_seq") + 1), limits.git_history_findings)
    reasons = result.coverage.unionByName(over.select("repo_id", F.lit(f"Git history finding limit of {limits.git_history_findings} reached").alias("reason"))).distinct()
    return shown.select("repo_id", "emit_seq", *FINDING_FIELDS), reasons


def diff_text(result: ChangeResult, repo_id: str, base: str) -> str:
    """The report of one repository's diff."""
    count = result.counts.filter(F.col("repo_id") == repo_id).first()
    found = result.findings.filter(F.col("repo_id") == repo_id).orderBy("place", "key").select("id", "path").collect()
    reasons = sorted(r.reason for r in result.coverage.filter(F.col("repo_id") == repo_id).collect())
    lines = [f"Git diff {base}..HEAD", f"Changed blobs: {count.changed_blobs if count else 0}", *(f"+ {f.id}  {f.path}" for f in found)]
    lines += [] if found else ["No new scanner findings were identified in changed blobs."]
    lines += ["Coverage: INCOMPLETE", *(f"- {r}" for r in reasons)] if reasons else []
    return "\n".join(lines) + "\n"
