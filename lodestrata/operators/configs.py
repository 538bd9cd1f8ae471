"""Rules over package manifests and developer-tool configuration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import json5
from ..limits import DEFAULT, ScanLimits
from ..schemas import FINDING
from .commands import DEVCONTAINER_HOOKS, SMALL_MANIFEST, file_roots, strict_json

# Hooks, needles and limits.
LIFECYCLE = ["preinstall", "install", "postinstall", "prepare"]
EXECUTION = ["start", "dev", "build", "test"]
DOWNLOADERS = ["curl ", "wget ", "invoke-webrequest", "iwr "]
EXECUTORS = ["| sh", "|sh", "| bash", "|bash", "invoke-expression", "iex ", "powershell", "pwsh"]
HIDDEN_PATHS = [".vscode", ".devcontainer", "package.json", "vite.config", "webpack.config", "tailwind.config"]
EVIDENCE_CHARS = 512

Found = dict[str, object]


def shortened(value: str) -> str:
    return value if len(value) <= EVIDENCE_CHARS else value[:EVIDENCE_CHARS] + "…"


def downloads_and_executes(command: str) -> bool:
    low = command.lower()
    return any(d in low for d in DOWNLOADERS) and any(e in low for e in EXECUTORS)


def is_lifecycle(name: Column) -> Column:
    return name.isin(LIFECYCLE)


def is_execution_script(name: Column) -> Column:
    return is_lifecycle(name) | name.isin(EXECUTION) | name.startswith("pre") | name.startswith("post")


def npm_scripts(manifests: DataFrame) -> DataFrame:
    """(path, name, command, rule) of the scripts of manifests(path, text) that are execution roots; entirely in the JVM."""
    scripts = F.from_json("text", "scripts map<string,string>")["scripts"]
    return (
        manifests.select("path", F.explode(scripts).alias("name", "command"))
        .filter(is_execution_script(F.col("name")) & F.col("command").isNotNull())
        .withColumn("rule", F.when(is_lifecycle(F.col("name")), "NPM-LIFECYCLE-SCRIPT").otherwise("NPM-EXECUTION-SCRIPT"))
    )


def is_config(path: Column) -> Column:
    return (F.substring_index(path, "/", -1) == "package.json") | path.startswith(".vscode/") | (path == ".devcontainer/devcontainer.json")


def _line(text: str, needle: str) -> int | None:
    return next((i for i, line in enumerate(text.split("\n"), 1) if needle in line), None) if needle else 1


def _found(path: str, id: str, severity: str, score: int, title: str, message: str, evidence: list[str], line: int | None = None, confidence: str = "very_high") -> Found:
    return {"id": id, "severity": severity, "confidence": confidence, "score": score, "title": title, "message": message, "file": path, "line": line, "evidence": evidence}


def _manifest(path: str, text: str) -> tuple[list[Found], list[str]]:
    try:
        value = strict_json(text)
    except (ValueError, RecursionError) as error:
        message = "The package manifest is malformed, so execution-root analysis is incomplete."
        return [_found(path, "CONFIG-PARSE-FAILED", "medium", 45, "Security-relevant configuration could not be parsed", message, [str(error)])], [f"could not parse package manifest {path}: {error}"]
    scripts = value.get("scripts") if isinstance(value, dict) else None
    out = []
    for name, command in sorted(scripts.items()) if isinstance(scripts, dict) else []:
        lifecycle = name in LIFECYCLE
        if not isinstance(command, str) or not (lifecycle or name in EXECUTION or name.startswith(("pre", "post"))):
            continue
        line = _line(text, f'"{name}"') if len(scripts) <= SMALL_MANIFEST else None
        message = f"The npm script '{name}' can execute repository-controlled commands."
        if lifecycle:
            out.append(_found(path, "NPM-LIFECYCLE-SCRIPT", "medium", 35, "Package lifecycle script can execute during installation", message, [f"{name}: {shortened(command)}"], line))
        else:
            out.append(_found(path, "NPM-EXECUTION-SCRIPT", "informational", 10, "Package script is an execution root", message, [f"{name}: {shortened(command)}"], line))
    return out, []


def _command(value: object) -> str | None:
    if isinstance(value, str):
        return value
    parts = value if isinstance(value, list) else value.values() if isinstance(value, dict) else None
    return None if parts is None else " ".join(p for p in parts if isinstance(p, str))


def _at(value: object, *keys: str) -> object:
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _tasks(path: str, text: str, value: object) -> Iterator[Found]:
    tasks = _at(value, "tasks")
    for task in tasks if isinstance(tasks, list) else []:
        if _at(task, "runOptions", "runOn") != "folderOpen":
            continue
        command, label = _command(_at(task, "command")), _at(task, "label")
        evidence = [f"task: {label if isinstance(label, str) else 'unnamed task'}", "runOn: folderOpen"]
        evidence += [f"command: {shortened(command)}"] if command is not None else []
        evidence += ["terminal reveal: never"] if _at(task, "presentation", "reveal") == "never" else []
        message = "A VS Code folder-open task can execute repository-controlled commands before the developer intentionally runs the project."
        line = _line(text, "folderOpen")
        if downloads_and_executes(command or ""):
            yield _found(path, "IDE-FOLDER-OPEN-DOWNLOAD-EXECUTE", "critical", 97, "Repository downloads or executes content when opened", message, evidence, line)
        else:
            yield _found(path, "IDE-FOLDER-OPEN-TASK", "high", 85, "Repository task runs automatically when opened", message, evidence, line)


def _settings(path: str, text: str, value: object) -> Iterator[Found]:
    key = "task.allowAutomaticTasks"
    if _at(value, key) == "on":
        yield _found(path, "IDE-AUTOMATIC-TASKS", "high", 80, "Repository enables automatic tasks", "Workspace settings allow tasks to run automatically.", [f"{key}: on"], _line(text, key))
    for section in ("files.exclude", "search.exclude"):
        patterns = _at(value, section)
        for pattern, on in patterns.items() if isinstance(patterns, dict) else []:
            if on is True and any(h in pattern.lower() for h in HIDDEN_PATHS):
                message = "Explorer or search exclusions conceal developer-tool or configuration files."
                yield _found(path, "IDE-HIDDEN-SECURITY-FILES", "high", 75, "Workspace settings hide security-relevant files", message, [f"{section}: {pattern}"], _line(text, pattern), "high")


def _launch(path: str, text: str, value: object) -> Iterator[Found]:
    configurations = _at(value, "configurations")
    for configuration in configurations if isinstance(configurations, list) else []:
        if isinstance(task := _at(configuration, "preLaunchTask"), str):
            message = "Starting this debug configuration triggers a named workspace task."
            yield _found(path, "IDE-PRELAUNCH-TASK", "informational", 10, "Debug configuration invokes a repository task", message, [f"preLaunchTask: {task}"], _line(text, "preLaunchTask"))


def _devcontainer(path: str, text: str, value: object) -> Iterator[Found]:
    for hook in DEVCONTAINER_HOOKS:
        if (command := _command(_at(value, hook))) is not None:
            message = "Opening or creating the development container can execute repository-controlled commands."
            yield _found(path, "DEVCONTAINER-EXECUTION-HOOK", "high", 75, "Devcontainer configuration contains an execution hook", message, [f"{hook}: {shortened(command)}"], _line(text, hook))


_BY_NAME = {"tasks.json": _tasks, "settings.json": _settings, "launch.json": _launch, "devcontainer.json": _devcontainer}


def config_findings(path: str, text: str, limits: ScanLimits = DEFAULT) -> tuple[list[Found], list[str]]:
    """(findings, reasons why coverage is incomplete) of one configuration file; anything else has none."""
    name = path.split("/")[-1]
    manifest, tool = name == "package.json", path.startswith(".vscode/") or path == ".devcontainer/devcontainer.json"
    if not manifest and not tool:
        return [], []
    if len(text.encode()) > limits.config_bytes:
        return [], [f"security-relevant configuration exceeds {limits.config_bytes} byte parse limit: {path}"]
    if manifest:
        return _manifest(path, text)
    try:
        value = json5.loads(text)
    except json5.Json5Error as error:
        message = "A security-relevant IDE or devcontainer file is malformed or unsupported."
        found = _found(path, "CONFIG-PARSE-FAILED", "medium", 45, "Developer-tool configuration could not be parsed", message, [str(error)])
        return [found], [f"could not parse developer-tool configuration {path}: {error}"]
    return list(_BY_NAME[name](path, text, value)) if name in _BY_NAME else [], []


CONFIG_SCHEMA = f"repo_id string, seq long, path string, reasons array<string>, {FINDING.lower().replace('line long', 'line long')}, position int"
ROOT_SCHEMA = "repo_id string, file_seq long, position int, file string, trigger string, line long, limited boolean"


def analyse_configs(texts: DataFrame, limits: ScanLimits = DEFAULT) -> DataFrame:
    """Findings and reasons of texts(repo_id, seq, path, text). Other files are filtered out before Python sees a row; a row with a null id only carries reasons."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in CONFIG_SCHEMA.split(", ")]
        blank = dict.fromkeys(columns)
        for batch in batches:
            rows = []
            for repo, seq, path, text in zip(batch["repo_id"], batch["seq"], batch["path"], batch["text"], strict=True):
                found, reasons = config_findings(path, text, limits)
                if reasons:
                    rows.append(blank | {"repo_id": repo, "seq": seq, "path": path, "reasons": reasons})
                rows += [blank | {"repo_id": repo, "seq": seq, "path": path, "reasons": [], "position": i, **f} for i, f in enumerate(found)]
            out = pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in columns})
            yield out.astype({"score": "Int32", "line": "Int64", "position": "Int32", "seq": "int64"})

    return texts.filter(is_config(F.col("path")) & F.col("text").isNotNull()).select("repo_id", "seq", "path", "text").mapInPandas(run, CONFIG_SCHEMA)


def execution_roots(texts: DataFrame, limits: ScanLimits = DEFAULT) -> DataFrame:
    """Roots of texts(repo_id, seq, path, text, roles), in order of (file_seq, position)."""
    relevant = F.exists("roles", lambda r: r.isin("executable_config", "npm_manifest", "ci_config", "build_script")) | F.col("path").isin(".vscode/tasks.json", ".devcontainer/devcontainer.json")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repo, seq, path, text, roles in zip(batch["repo_id"], batch["seq"], batch["path"], batch["text"], batch["roles"], strict=True):
                found, limited = file_roots(path, text, list(roles), limits)
                rows += [(repo, seq, i, *root, limited) for i, root in enumerate(found)]
                if limited and not found:
                    rows.append((repo, seq, -1, None, None, None, True))
            yield pd.DataFrame(rows, columns=["repo_id", "file_seq", "position", "file", "trigger", "line", "limited"]).astype({"line": "Int64"})

    return texts.filter(relevant).select("repo_id", "seq", "path", "text", "roles").mapInPandas(run, ROOT_SCHEMA)
