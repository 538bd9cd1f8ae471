"""Command line: scan, diff, rules, explain, doctor, version."""

from __future__ import annotations

import os
import platform
import re
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .limits import PROFILES
from .report.render import NAME, RENDERERS, VERSION, exit_code, report_of
from .rules import RULES, show
from .schemas import SEVERITIES
from .storage import clean

HELP = f"""{NAME}: static inspection of source repositories

  {NAME} scan <path> [--format terminal|json|markdown|sarif] [--fail-on SEVERITY] [--quick|--deep] [--history]
  {NAME} <path> [options]
  {NAME} diff <good-commit>..HEAD
  {NAME} rules | rules show <rule-id> | explain <rule-id>
  {NAME} doctor | version | --help | --version

Severities: informational, low, medium, high, critical"""


class UsageError(ValueError):
    pass


def parse(args: list[str]) -> tuple[str, dict[str, object]]:
    """(command, its arguments)."""
    if not args or args[0] in ("--help", "-h"):
        return _alone(args[1:], "help")
    if args[0] in ("version", "--version", "-V"):
        return _alone(args[1:], "version")
    if args[0] == "doctor":
        return _alone(args[1:], "doctor")
    if args[0] in ("rules", "explain"):
        rest = args[1:]
        if args[0] == "rules":
            if not rest:
                return "rules", {}
            if rest[0] != "show":
                raise UsageError("expected rules show <rule-id>")
            rest = rest[1:]
        if not rest:
            raise UsageError(f"{args[0]} requires a rule ID")
        _alone(rest[1:], "rule")
        return "rule", {"id": rest[0]}
    if args[0] == "diff":
        ranges = [a for a in args[1:] if a != "--no-sandbox"]
        if len(ranges) > 1:
            raise UsageError("diff accepts one commit range")
        if not ranges or not re.fullmatch(r"[0-9a-fA-F]{7,64}\.\.HEAD", ranges[0]):
            raise UsageError("diff requires a hexadecimal commit ID followed by ..HEAD")
        return "diff", {"range": ranges[0]}
    return "scan", _scan_arguments(args[1:] if args[0] == "scan" else args)


def _alone(rest: list[str], command: str) -> tuple[str, dict[str, object]]:
    if rest:
        raise UsageError("unexpected argument")
    return command, {}


def _scan_arguments(args: list[str]) -> dict[str, object]:
    out: dict[str, object] = {"path": None, "format": "terminal", "fail_on": "high", "quick": False, "deep": False, "history": False}
    rest = iter(args)
    for a in rest:
        name, joined, value = a.partition("=")
        if name in ("--format", "--fail-on"):
            if not joined and (value := next(rest, None)) is None:
                raise UsageError(f"{name} requires a value")
            if name == "--format" and value not in RENDERERS:
                raise UsageError(f"unsupported format: {value}")
            if name == "--fail-on" and (value := value.lower()) not in ("info", *SEVERITIES):
                raise UsageError(f"unsupported severity: {value}")
            out[name[2:].replace("-", "_")] = value
        elif a in ("--quick", "--deep", "--history"):
            out[a[2:]] = True
        elif a == "--no-sandbox":
            continue  # nothing is sandboxed by the operating system here; contents are never run
        elif a.startswith("-"):
            raise UsageError(f"unknown option: {a}")
        elif out["path"] is not None:
            raise UsageError("unexpected extra path argument")
        else:
            out["path"] = a
    if out["quick"] and out["deep"]:
        raise UsageError("--quick and --deep cannot be combined")
    if out["path"] is None:
        raise UsageError("scan requires a path")
    return out


def scan(spark: SparkSession, path: str, profile: str = "default", history: bool = False) -> dict:
    """The report document of one repository."""
    from .plans.history import scan_history
    from .plans.scan import scan_repositories, with_history

    paths = {"repository": path}
    result = scan_repositories(spark, paths, profile)
    if history:
        result = with_history(result, *scan_history(spark, paths, profile), PROFILES[profile])
    row = result.report_rows().first().asDict(recursive=True)
    return report_of(row, os.path.realpath(path), profile)


def main(args: list[str] | None = None) -> int:
    try:
        command, given = parse(sys.argv[1:] if args is None else args)
    except UsageError as error:
        print(f"{error}\n\n{HELP}", file=sys.stderr)
        return 3
    if command == "help":
        print(HELP)
    elif command == "version":
        print(f"{NAME} {VERSION}")
    elif command == "rules":
        print("".join(f"{i}\t{d}\n" for i, d in RULES.items()), end="")
    elif command == "rule":
        if (text := show(given["id"])) is None:
            print(f"unknown rule: {given['id']}", file=sys.stderr)
            return 3
        print(text)
    elif command == "doctor":
        print(f"{NAME} doctor\nPlatform: {platform.system().lower()}-{platform.machine()}\nScanner: {VERSION}\nRepository scans: offline; target code is not executed")
    else:
        spark = SparkSession.builder.appName(NAME).getOrCreate()
        try:
            if command == "diff":
                return _diff(spark, given["range"])
            report = scan(spark, given["path"], "quick" if given["quick"] else "deep" if given["deep"] else "default", given["history"])
        finally:
            clean(spark)
        print(RENDERERS[given["format"]](report), end="")
        return exit_code(report, given["fail_on"])
    return 0


def _diff(spark: SparkSession, commit_range: str) -> int:
    from .plans.history import diff_repositories, diff_text

    result = diff_repositories(spark, {"repository": "."}, commit_range)
    failed = result.coverage.filter(F.col("reason").startswith("diff analysis failed")).first()
    if failed:
        print(failed.reason, file=sys.stderr)
        return 2
    print(diff_text(result, "repository", commit_range.split("..")[0]), end="")
    return 0 if result.coverage.isEmpty() else 2


if __name__ == "__main__":
    sys.exit(main())
