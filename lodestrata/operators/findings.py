"""Findings as data: building, ordering, capping, comparing and rolling up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import FINDING_STRUCT, SEVERITIES

FINDING_FIELDS = ["id", "severity", "confidence", "score", "title", "message", "file", "line", "evidence"]


def finding(
    id: str, severity: Column | str, confidence: Column | str, score: Column | int, title: Column | str, message: Column | str, *, file: Column, evidence: Column, line: Column | None = None
) -> Column:
    """A finding struct."""

    def column(value: Column | str | int) -> Column:
        return value if isinstance(value, Column) else F.lit(value)

    values = [column(id), column(severity), column(confidence), column(score).cast("int"), column(title), column(message), file, F.lit(None).cast("long") if line is None else line.cast("long"), evidence]
    return F.struct(*[v.alias(n) for v, n in zip(values, FINDING_FIELDS, strict=True)]).cast(FINDING_STRUCT)


def severity_rank(severity: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1).cast("int")


def severity_at_least(findings: DataFrame, threshold: str) -> DataFrame:
    """Findings of at least the given severity; "info" is another name of the lowest."""
    name = "informational" if threshold == "info" else threshold
    if name not in SEVERITIES:
        raise ValueError(f"unknown severity: {threshold}")
    return findings.filter(severity_rank(F.col("severity")) >= SEVERITIES.index(name))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. The least order value is aggregated before the shuffle, so a hot key costs a row a task."""
    columns = rows.columns
    best = F.min_by(F.struct(*columns), F.struct(*order)).alias("row")
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best).select("row.*")


def cap_per_repo(rows: DataFrame, limit: int, order: str = "emit_seq") -> tuple[DataFrame, DataFrame]:
    """(the first `limit` rows of each repository, one (repo_id, dropped) row per repository that had more).

    Window group limits cut each partition to `limit` rows before the shuffle.
    """
    w = Window.partitionBy("repo_id").orderBy(order)
    kept = rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")
    over = rows.groupBy("repo_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("repo_id", (F.col("n") - limit).alias("dropped"))
    return kept, over


def new_findings(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Findings whose (id, line, evidence) no previous finding of the same file has."""
    keys = ["repo_id", "path", "id", "line", "evidence"]
    matched = F.lit(True)
    for k in keys:
        matched = matched & current[k].eqNullSafe(previous[k])
    return current.join(previous, matched, "left_anti")


def risk(findings: DataFrame) -> DataFrame:
    """Per repository the highest severity and the highest score, each by itself."""
    top = F.max(severity_rank(F.col("severity")))
    return findings.groupBy("repo_id").agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), top + 1).alias("severity"), F.max("score").alias("score"))
