"""Queries over the small repositories of cases.py: each shows what the operators make of them."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zlib
from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.api import with_raw_signals
from lodestrata.js.analyse import analyse_file
from lodestrata.js.extract import extract_scripts
from lodestrata.js.names import capability, indirect_target, is_persistence_command, is_persistence_path, is_sensitive_path
from lodestrata.js.tables import analyse_sources
from lodestrata.limits import DEFAULT
from lodestrata.operators.commands import Commands, file_roots
from lodestrata.report.render import RENDERERS, exit_code, report_of
from lodestrata.rules import rules_df
from lodestrata.sources.walk import walk_repositories
from lodestrata.storage import work_dir
from . import cases as C
from . import corpora
from lodestrata.plans.history import compare_commits, diff_text, scan_history
from lodestrata.plans.scan import ScanResult, scan_repositories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _folder(spark: SparkSession) -> str:
    base = work_dir(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="cases-", dir=base)


def _laid_out(spark: SparkSession, repositories: dict[str, C.Files]) -> dict[str, str]:
    """Writes the repositories as folders; {name: path}."""
    root, paths = _folder(spark), {}
    for name, files in repositories.items():
        paths[name] = f"{root}/{name}"
        for path, data in files.items():
            whole = f"{paths[name]}/{path}"
            os.makedirs(os.path.dirname(whole), exist_ok=True)
            with open(whole, "wb") as f:
                f.write(data if isinstance(data, bytes) else data.encode())
    return paths


_scanned: dict[tuple[str, str], ScanResult] = {}


def _scan(spark: SparkSession, name: str, repositories: dict[str, C.Files], limits=DEFAULT) -> ScanResult:
    """The scan of some repositories, made once for a session: its tables are written."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _scanned:
        _scanned[key] = scan_repositories(spark, _laid_out(spark, repositories), limits=limits)
    return _scanned[key]


def _found(result: ScanResult) -> DataFrame:
    return result.findings.select("repo_id", "id", "severity", F.col("score").cast("long").alias("score"), "file", "line")


@query
def project_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that whole projects lead to, from their triggers on."""
    return _found(_scan(spark, "projects", C.PROJECTS))


@query
def project_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence of chains and of concealed and disguised code, step by step."""
    chains = _scan(spark, "projects", C.PROJECTS).findings.filter("severity in ('high', 'critical') and id like 'JS-%'")
    return chains.select("repo_id", "id", "line", F.posexplode("evidence").alias("step", "evidence")).withColumn("step", F.col("step").cast("long"))


@query
def project_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _scan(spark, "projects", C.PROJECTS)
    counts = [F.col(f"summary.{c}").alias(c) for c in ("entries", "files", "directories", "symlinks", "special_files", "content_bytes", "findings")]
    return result.summary.select("repo_id", "status", "risk.severity", F.col("risk.score").cast("long").alias("score"), *counts)


@query
def flow_case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What data flow finds in each case; the capability rules, which don't depend on it, are left out."""
    return _found(_scan(spark, "flows", C.FLOWS)).filter("severity in ('high', 'critical')")


@query
def flow_case_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chains = _scan(spark, "flows", C.FLOWS).findings.filter("severity in ('high', 'critical')")
    return chains.select("repo_id", "id", F.array_join(F.slice("evidence", 3, 20), " | ").alias("route"))


@query
def single_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over single files, configurations, languages, signatures, documents and archive members."""
    return _found(_scan(spark, "singles", C.SINGLES))


@query
def single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File records of the same."""
    files = _scan(spark, "singles", C.SINGLES).files
    return files.select("repo_id", "path", "kind", "size", "extension", "detected_mime", "encoding", "line_count", "max_line_length", F.array_join("roles", ",").alias("roles"), "content_scanned", "parsed_language")


@query
def unresolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    singles, incomplete = _scan(spark, "singles", C.SINGLES), _scan(spark, "incomplete", C.INCOMPLETE)
    return singles.unresolved.unionByName(incomplete.unresolved).select("repo_id", "edge")


@query
def incomplete_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons why coverage is incomplete; what a library or a parser says of an error is cut off."""
    reason = F.regexp_replace("reason", r"(could not parse [^:]*|diagnostic\(s\)|cannot decompress gzip archive [^:]*|cannot parse ZIP archive [^:]*)[:,].*", "$1")
    return _scan(spark, "incomplete", C.INCOMPLETE).coverage.select("repo_id", reason.alias("reason"))


@query
def incomplete_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What archives still give where some of their members are refused."""
    return _scan(spark, "incomplete", C.INCOMPLETE).files.filter("path like '%!/%'").select("repo_id", "path", "size", "sha256")


#: What a scan with small limits is given.
LIMITED: dict[str, C.Files] = {
    "entries": {f"{i}.txt": "x" for i in range(12)},
    "bytes": {"a.txt": "x" * 400, "b.txt": "x" * 450, "c.txt": "x" * 300, "d.txt": "x" * 40, "e.txt": "x" * 1001},
    "findings": {f"{i}.sh": "curl x | sh" for i in range(9)},
    "depth": {"a/b/c/d/e.txt": "x", "a/f.txt": "y"},
    "modules": {f"m{i}.js": "f();" for i in range(8)},
    "edges": {f"m{i}.js": f"require('./m{i + 1}'); require('p{i}');" for i in range(5)},
    "routes": {"package.json": C.START, "index.js": "require('./r1');", **{f"r{i}.js": f"require('./r{i + 1}');" for i in range(1, 8)}},
    "members": {"a.zip": C.zipped({f"{i}.txt": b"x" * 10 for i in range(5)})},
    "member-bytes": {"a.zip": C.zipped({"a.txt": bytes(range(256)) * 2, "b.txt": b"y"})},
}
SMALL = replace(DEFAULT, max_entries=10, max_file_bytes=1000, max_total_bytes=900, max_depth=3, max_findings=6, modules=6, graph_edges=7, route_length=5, archive_members=3, archive_member_bytes=300)


@query
def limited_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of a scan with small limits, and how much it still has."""
    result = _scan(spark, "limited", LIMITED, SMALL)
    reasons = result.coverage.select("repo_id", "reason")
    kept = result.summary.select("repo_id", F.format_string("%d files, %d bytes, %d findings", "summary.files", "summary.content_bytes", "summary.findings").alias("reason"))
    edges = result.unresolved.groupBy("repo_id").agg(F.format_string("%d unresolved", F.count("*")).alias("reason"))
    return reasons.unionByName(kept).unionByName(edges)


@query
def walked_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, special files and folders as rows of a walk."""
    paths = _laid_out(spark, {"tree": {"a.txt": "x", "d/b.txt": "yy", "d/.git/c": "z"}})
    root = paths["tree"]
    for target, name in (("/etc/passwd", "absolute-out"), ("../../out", "d/out"), ("a.txt", "inside"), ("d", "folder"), ("gone", "dangling")):
        os.symlink(target, f"{root}/{name}")
    os.mkfifo(f"{root}/pipe")
    rows = walk_repositories(spark, paths, DEFAULT).filter("kind != '#counts'")
    return rows.select(F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"), "path", "kind", "symlink_target", F.length("content").cast("long").alias("length"), F.when(F.col("kind") != "#reason", F.col("note")).alias("note"))


@query
def tree_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that links and special files give."""
    paths = _laid_out(spark, {"tree": {"a.txt": "x"}})
    root = paths["tree"]
    for target, name in (("/etc/passwd", "out"), (f"{os.path.realpath(root)}/a.txt", "absolute"), ("a.txt", "in")):
        os.symlink(target, f"{root}/{name}")
    os.mkfifo(f"{root}/pipe")
    return _found(scan_repositories(spark, paths)).drop("repo_id")


@query
def signal_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content signals of a text for each, and of texts that come close."""
    texts = corpora.inline(spark, list(C.SIGNAL_TEXTS.items()), "name string, text string")
    return with_raw_signals(texts, "text", "signals").select("name", F.posexplode("signals").alias("position", "signal")).withColumn("position", F.col("position").cast("long"))


def _sources(spark: SparkSession) -> DataFrame:
    rows = [("s", i, p, t) for i, (p, t) in enumerate(C.SOURCES.items())]
    return analyse_sources(corpora.inline(spark, rows, "repo_id string, seq long, path string, text string"))


@query
def module_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark).select(F.explode("modules").alias("m")).select("m.id", F.posexplode("m.imports").alias("seq", "i")).select("id", F.col("seq").cast("long").alias("seq"), "i.specifier", "i.line")


@query
def module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark).select(F.explode("modules").alias("m")).select("m.id", F.posexplode("m.calls").alias("seq", "c")).select("id", F.col("seq").cast("long").alias("seq"), "c.name", "c.line", "c.capability", "c.function")


@query
def module_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark).select("path", "language", F.size("modules").cast("long").alias("modules"), F.size("reasons").cast("long").alias("reasons"))


def _applied(spark: SparkSession, inputs: list[str], result: Callable[[str], str | None]) -> DataFrame:
    """(given, result) of a Python operator over some strings."""

    @F.pandas_udf("string")
    def apply(given: pd.Series) -> pd.Series:
        return given.map(result)

    return corpora.inline(spark, [(x,) for x in inputs], "given string").select("given", apply("given").alias("result"))


COMMANDS = [
    "node a.js", "node a.js && node b.js; node a.js", "NODE_ENV=x node a.js", "cross-env A=1 node -r ./p.js src/a.ts --flag b.mjs", "sh -c 'node c.js'", "npx tsx a.ts", "yarn exec node b.js", "node -e 'x' c.js", "echo a.js",
    "./run.mjs", "deno run x.ts", "bun y.ts | cat", "",
]


@query
def command_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applied(spark, COMMANDS, lambda c: ",".join(Commands().targets(c)))


@query
def script_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that name other scripts of the manifest."""
    scripts = {"a": "node x.js && npm run b", "b": "yarn run c", "c": "node y.ts", "loop": "npm run loop"}

    def targets(command: str) -> str:
        commands = Commands()
        return ",".join(commands.script_targets(command, scripts)) + (" limit" if commands.limit_reached else "")

    return _applied(spark, ["npm run a", "pnpm run b", "npm run loop", "npm run none", "node z.js"], targets)


ROOT_FILES = {
    "package.json": '{"scripts": {"b": "node b.js", "start": "node s.js"}}', ".vscode/tasks.json": '{"tasks": [{"command": "node", "args": ["t.js"], "runOptions": {"runOn": "folderOpen"}}, {"command": "node u.js"}]}',
    ".devcontainer/devcontainer.json": '{"postCreateCommand": "node d.js"}', "vite.config.ts": "x", ".github/workflows/w.yml": "- run: node ci.js\n  run: echo\n", "Dockerfile": "FROM x\nRUN node docker.js\n", "Makefile": "all:\n\tnode make.js\n", ".gitlab-ci.yml": "script:\n  - node lab.js\n",
}
ROLES = {"package.json": "npm_manifest", ".vscode/tasks.json": "developer_tool_config", ".devcontainer/devcontainer.json": "developer_tool_config", "vite.config.ts": "executable_config", ".github/workflows/w.yml": "ci_config", "Dockerfile": "build_script", "Makefile": "build_script", ".gitlab-ci.yml": "ci_config"}


@query
def execution_root_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution roots that each kind of file names."""
    return _applied(spark, list(ROOT_FILES), lambda p: "; ".join(f"{f} <- {t} at {n}" for f, t, n in file_roots(p, ROOT_FILES[p], [ROLES[p]])[0]))


NAMES = ["/home/u/.ssh/id_rsa", "C:\\Users\\u\\.AWS\\credentials", "README.md", ".npmrc", "/home/u/.bashrc", "/etc/cron.d/x", "~/.config/autostart/a.desktop", "crontab -l", "schtasks /create", "systemctl enable x", "ls", "eval", "child_process.exec", "fetch", "process.env.TOKEN", "process.env.CI", "vm.runInThisContext.call", "fs.readFileSync"]


@query
def name_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What paths, commands and names are known as."""

    def known(x: str) -> str:
        tests = {"secret": is_sensitive_path(x), "startup": is_persistence_path(x), "registers": is_persistence_command(x), f"can {capability(x)}": capability(x), f"calls {indirect_target(x)}": indirect_target(x)}
        return ",".join(k for k, v in tests.items() if v)

    return _applied(spark, NAMES, known)


DOCUMENTS = {
    "plain": "<script>a</script>\n<SCRIPT type=module>b</script >", "comment": "<!-- <script>a</script> --><script>b</script>", "external": "x\n<script src='x.js'></script>", "json": "<script type='application/ld+json'>{}</script>",
    "quotes": "<script data-x='>'>a</script>", "other tag": "<scripts>a</scripts>", "open": "<script>a", "typed": '<script lang="ts">a</script>', "mime": '<script type="text/javascript">a</script>',
}
MARKDOWN = {"fence": "```\n<script>a</script>\n```\n<script>b</script>", "tilde": "   ~~~x\n<script>a</script>\n~~~~\n", "short close": "````\n```\n<script>a</script>\n````", "span": "`<script>a</script>` ``<script>`b</script>``", "open span": "`<script>a</script>", "blank line": "`a\n\n<script>b</script>`"}


@query
def document_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of HTML documents: line, source or address, and what was left."""

    def shown(text: str, markdown: bool) -> str:
        blocks, reasons = extract_scripts(text, markdown)
        return " | ".join([f"{b.line_offset}:{b.external or b.source}" for b in blocks] + reasons)

    html = _applied(spark, list(DOCUMENTS), lambda n: shown(DOCUMENTS[n], False))
    return html.unionByName(_applied(spark, list(MARKDOWN), lambda n: shown(MARKDOWN[n], True)))


@query
def source_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules of a file whose parts are separated by ---."""
    texts = ["let a = f();\n---\nlet a = g();\n", "let a = f();\n---\nlet b = ;\n", "f();\n", "words\n---\nmore words\n"]
    return _applied(spark, texts, lambda t: ",".join(m.id for m in analyse_file("a.js", t).modules))


@query
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of two projects in every format, line by line, and their exit codes."""
    result = _scan(spark, "projects", C.PROJECTS)
    rows = []
    for row in result.report_rows().filter("repo_id in ('startup-entry', 'clean')").collect():
        report = report_of(row.asDict(recursive=True), f"/src/{row.repo_id}")
        for name, render in RENDERERS.items():
            if name == ("json" if report["findings"] else "sarif"):
                continue  # JSON has file records, which single_files shows; SARIF has little to say of nothing
            rows += [(row.repo_id, name, i, line) for i, line in enumerate(render(report).split("\n"))]
        rows += [(row.repo_id, f"exit at {t}", 0, str(exit_code(report, t))) for t in ("info", "medium", "high", "critical")]
    return corpora.inline(spark, rows, "repo_id string, format string, number long, line string")


@query
def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_df(spark).filter("length(description) > 20").select("id")


class _Git:
    """Writes loose objects."""

    def __init__(self, root: str) -> None:
        self.root = root
        for folder in ("objects", "refs/heads"):
            os.makedirs(f"{root}/.git/{folder}")
        for name, text in (("HEAD", "ref: refs/heads/main\n"), ("config", "[core]\n\trepositoryformatversion = 0\n")):
            with open(f"{root}/.git/{name}", "w") as f:
                f.write(text)

    def put(self, kind: str, data: bytes) -> str:
        whole = f"{kind} {len(data)}\0".encode() + data
        id = hashlib.sha1(whole).hexdigest()
        os.makedirs(f"{self.root}/.git/objects/{id[:2]}", exist_ok=True)
        with open(f"{self.root}/.git/objects/{id[:2]}/{id[2:]}", "wb") as f:
            f.write(zlib.compress(whole))
        return id

    def tree(self, files: dict[str, str]) -> str:
        entries, folders = {}, {}
        for path, text in files.items():
            first, _, rest = path.partition("/")
            if rest:
                folders.setdefault(first, {})[rest] = text
            else:
                entries[first] = ("100644", self.put("blob", text.encode()))
        entries |= {name: ("40000", self.tree(own)) for name, own in folders.items()}
        order = sorted(entries, key=lambda n: n + "/" * (entries[n][0] == "40000"))
        return self.put("tree", b"".join(f"{entries[n][0]} {n}\0".encode() + bytes.fromhex(entries[n][1]) for n in order))

    def commit(self, files: dict[str, str], parent: str | None) -> str:
        parents = f"parent {parent}\n" if parent else ""
        person = "a <a@x> 1700000000 +0000"
        id = self.put("commit", f"tree {self.tree(files)}\n{parents}author {person}\ncommitter {person}\n\nchange\n".encode())
        with open(f"{self.root}/.git/refs/heads/main", "w") as f:
            f.write(id + "\n")
        return id


def _history(spark: SparkSession) -> tuple[dict[str, str], str]:
    root = _folder(spark)
    git = _Git(root)
    base = {"a.sh": "echo 1\n", "same.sh": "curl x | sh\n", "gone.py": "requests.get(u)\nexec(x)\n"}
    first = git.commit(base, None)
    second = git.commit({"a.sh": "echo 1\nwget x\nbash -c y\n", "same.sh": base["same.sh"], "d/package.json": '{"scripts": {"postinstall": "node x"}}'}, first)
    git.commit({"a.sh": "echo 2\nwget x\nbash -c y\n", "same.sh": base["same.sh"], "d/package.json": '{"scripts": {"postinstall": "node x", "start": "node y"}}', "e.json": "{}"}, second)
    return {"r": root}, first


@query
def git_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New findings between the first commit and HEAD."""
    paths, first = _history(spark)
    return compare_commits(spark, paths, first, DEFAULT).findings.select("path", "id", "severity", "line")


@query
def git_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, first = _history(spark)
    text = diff_text(compare_commits(spark, paths, first, DEFAULT), "r", first)
    return corpora.inline(spark, list(enumerate(text.split("\n"))), "number long, line string")


@query
def git_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each commit introduced."""
    paths, _ = _history(spark)
    found, _ = scan_history(spark, paths)
    return found.select("file", "id", "title", F.element_at("evidence", -1).alias("commit"))
