"""Schemas of every table the engine produces. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_KINDS = {
    "STRING": T.StringType(), "LONG": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _table(ddl: str) -> T.StructType:
    """Read here and not by Spark, as workers import this without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


FILES_RAW = _table(
    "repo_id STRING, seq LONG, path STRING, kind STRING, size LONG, readonly BOOLEAN, mode INT, symlink_target STRING, content BINARY, origin STRING"
)
FINDING = "id STRING, severity STRING, confidence STRING, score INT, title STRING, message STRING, file STRING, line LONG, evidence ARRAY<STRING>"
FINDING_STRUCT = "STRUCT<" + ", ".join(x.replace(" ", ": ", 1) for x in FINDING.split(", ")) + ">"
FINDINGS = _table(f"repo_id STRING, {FINDING}, emit_seq LONG")
FILES = _table(
    "repo_id STRING, seq LONG, path STRING, kind STRING, size LONG, readonly BOOLEAN, mode INT, sha256 STRING, extension STRING, detected_mime STRING, "
    "encoding STRING, entropy DOUBLE, line_count LONG, max_line_length LONG, symlink_target STRING, roles ARRAY<STRING>, raw_signals ARRAY<STRING>, "
    "content_scanned BOOLEAN, parsed_language STRING"
)
MODULES = _table("repo_id STRING, seq LONG, id STRING, path STRING, flow_enabled BOOLEAN, source_bytes LONG, flow_ir BINARY")
IMPORTS = _table("repo_id STRING, module_id STRING, seq LONG, specifier STRING, line LONG")
CALLS = _table("repo_id STRING, module_id STRING, seq LONG, name STRING, line LONG, evidence STRING, capability STRING, function STRING")
ROOTS = _table("repo_id STRING, seq LONG, file STRING, trigger STRING, line LONG")
COVERAGE = _table("repo_id STRING, reason STRING")

#: Ascending; the position is the rank that sorts, compares and aggregates.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high", "very_high")
