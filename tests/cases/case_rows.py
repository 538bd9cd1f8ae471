"""What the queries of scenarios.py have to give: expected rows, written out one by one."""

from __future__ import annotations

#: query: (columns, rows)
EXPECTED: dict[str, tuple[str, list[tuple]]] = {
    "project_findings": (
        "repo_id VARCHAR, id VARCHAR, severity VARCHAR, score BIGINT, file VARCHAR, line BIGINT",
        [
            ("both-chains", "JS-COMBINED-ATTACK-CHAIN", "critical", 99, "index.js", 3),
            ("both-chains", "JS-DYNAMIC-EXECUTION", "medium", 45, "index.js", 3),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 3),
            ("both-chains", "JS-SECRET-EXFILTRATION", "critical", 97, "index.js", 1),
            ("both-chains", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("concealed-late", "JS-CONCEALED-EXECUTION", "high", 88, "index.js", 1),
            ("concealed-late", "JS-DYNAMIC-EXECUTION", "medium", 45, "index.js", 1),
            ("concealed-late", "JS-DYNAMIC-EXECUTION", "medium", 45, "index.js", 1),
            ("concealed-late", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("concealed-late", "RAW-HIDDEN-AFTER-WHITESPACE", "high", 75, "index.js", 1),
            ("concealed-process", "JS-CONCEALED-EXECUTION", "high", 88, "main.js", 5),
            ("concealed-process", "JS-PROCESS-EXECUTION", "medium", 45, "main.js", 5),
            ("concealed-process", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", "critical", 97, "tools/gather.js", 5),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", "critical", 97, "tools/gather.js", 7),
            ("credentials-sent", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 1),
            ("disguised", "FILE-PARSEABLE-JAVASCRIPT", "medium", 45, "icon.woff2", None),
            ("disguised", "FILE-TYPE-MISMATCH", "medium", 45, "icon.woff2", None),
            ("disguised", "JS-DYNAMIC-EXECUTION", "medium", 45, "icon.woff2", 2),
            ("disguised", "JS-REACHABLE-DISGUISED-SOURCE", "critical", 95, "icon.woff2", 1),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "icon.woff2", 2),
            ("disguised", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("folder-open", "FILE-PARSEABLE-JAVASCRIPT", "medium", 45, "fonts/text.woff2", None),
            ("folder-open", "FILE-TYPE-MISMATCH", "medium", 45, "fonts/text.woff2", None),
            ("folder-open", "IDE-FOLDER-OPEN-TASK", "high", 85, ".vscode/tasks.json", 1),
            ("folder-open", "JS-DYNAMIC-EXECUTION", "medium", 45, "fonts/text.woff2", 4),
            ("folder-open", "JS-REACHABLE-DISGUISED-SOURCE", "critical", 95, "fonts/text.woff2", 2),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "fonts/text.woff2", 4),
            ("from-ci", "JS-DYNAMIC-EXECUTION", "medium", 45, "tools/run.js", 2),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "tools/run.js", 2),
            ("from-config", "FILE-PARSEABLE-JAVASCRIPT", "medium", 45, "asset.png", None),
            ("from-config", "FILE-TYPE-MISMATCH", "medium", 45, "asset.png", None),
            ("from-config", "JS-DYNAMIC-EXECUTION", "medium", 45, "asset.png", 2),
            ("from-config", "JS-REACHABLE-DISGUISED-SOURCE", "critical", 95, "asset.png", 1),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "asset.png", 2),
            ("no-trigger", "JS-DYNAMIC-EXECUTION", "medium", 45, "index.js", 3),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 3),
            ("no-trigger", "JS-SECRET-EXFILTRATION", "critical", 97, "index.js", 1),
            ("npm-chain", "JS-DYNAMIC-EXECUTION", "medium", 45, "lib/x.js", 2),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "lib/x.js", 2),
            ("npm-chain", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("remote-eval", "JS-DYNAMIC-EXECUTION", "medium", 45, "src/main.js", 3),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "src/main.js", 3),
            ("remote-eval", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("secret-sent", "JS-SECRET-EXFILTRATION", "critical", 97, "src/main.js", 2),
            ("secret-sent", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1),
            ("startup-entry", "JS-PERSISTENCE-WRITE", "high", 85, "tools/setup.js", 3),
            ("startup-entry", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 1),
        ],
    ),
    "project_routes": (
        "repo_id VARCHAR, id VARCHAR, line BIGINT, step BIGINT, evidence VARCHAR",
        [
            ("both-chains", "JS-COMBINED-ATTACK-CHAIN", 3, 0, "component: JS-REMOTE-CODE-EXECUTION at index.js:3"),
            ("both-chains", "JS-COMBINED-ATTACK-CHAIN", 3, 1, "component: JS-SECRET-EXFILTRATION at index.js:1"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 0, "trigger: npm start (package.json) at line 1"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 1, "entry: index.js"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 2, "source: index.js:2 fetch"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 3, "property: index.js r.text"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 4, "transform: index.js:2 r.text"),
            ("both-chains", "JS-REMOTE-CODE-EXECUTION", 3, 5, "sink: index.js:3 eval"),
            ("both-chains", "JS-SECRET-EXFILTRATION", 1, 0, "trigger: npm start (package.json) at line 1"),
            ("both-chains", "JS-SECRET-EXFILTRATION", 1, 1, "entry: index.js"),
            ("both-chains", "JS-SECRET-EXFILTRATION", 1, 2, "source: index.js process.env"),
            ("both-chains", "JS-SECRET-EXFILTRATION", 1, 3, "property: index.js process.env.KEY"),
            ("both-chains", "JS-SECRET-EXFILTRATION", 1, 4, "sink: index.js:1 fetch"),
            ("concealed-late", "JS-CONCEALED-EXECUTION", 1, 0, "trigger: npm start (package.json) at line 1"),
            ("concealed-late", "JS-CONCEALED-EXECUTION", 1, 1, "entry: index.js"),
            ("concealed-late", "JS-CONCEALED-EXECUTION", 1, 2, "concealment: code follows 600 horizontal whitespace bytes"),
            ("concealed-late", "JS-CONCEALED-EXECUTION", 1, 3, "capability: eval"),
            ("concealed-process", "JS-CONCEALED-EXECUTION", 5, 0, "trigger: npm start (package.json) at line 1"),
            ("concealed-process", "JS-CONCEALED-EXECUTION", 5, 1, "entry: main.js"),
            ("concealed-process", "JS-CONCEALED-EXECUTION", 5, 2, "concealment: possible XOR string decoder"),
            ("concealed-process", "JS-CONCEALED-EXECUTION", 5, 3, "concealment: anti-debugging or automation check"),
            ("concealed-process", "JS-CONCEALED-EXECUTION", 5, 4, "capability: node:child_process.exec"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 5, 0, "trigger: npm postinstall (package.json) at line 1"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 5, 1, "entry: tools/gather.js"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 5, 2, "source: tools/gather.js:4 node:fs.readFileSync (path evidence: $HOME/.npmrc)"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 5, 3, "sink: tools/gather.js:5 fetch"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 0, "trigger: npm postinstall (package.json) at line 1"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 1, "entry: tools/gather.js"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 2, "source: tools/gather.js process.env"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 3, "property: tools/gather.js process.env.NPM_TOKEN"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 4, "transform: tools/gather.js:7 JSON.stringify"),
            ("credentials-sent", "JS-SECRET-EXFILTRATION", 7, 5, "sink: tools/gather.js:7 fetch"),
            ("disguised", "JS-REACHABLE-DISGUISED-SOURCE", 1, 0, "trigger: npm start (package.json) at line 1"),
            ("disguised", "JS-REACHABLE-DISGUISED-SOURCE", 1, 1, "entry: index.js"),
            ("disguised", "JS-REACHABLE-DISGUISED-SOURCE", 1, 2, "index.js:1 imports icon.woff2"),
            ("disguised", "JS-REACHABLE-DISGUISED-SOURCE", 1, 3, "capability: fetch at line 1"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 0, "trigger: npm start (package.json) at line 1"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 1, "entry: index.js"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 2, "index.js:1 imports icon.woff2"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 3, "source: icon.woff2:1 fetch"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 4, "property: icon.woff2 r.text"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 5, "transform: icon.woff2:1 r.text"),
            ("disguised", "JS-REMOTE-CODE-EXECUTION", 2, 6, "sink: icon.woff2:2 Function"),
            ("folder-open", "JS-REACHABLE-DISGUISED-SOURCE", 2, 0, "trigger: VS Code folderOpen task at line 1"),
            ("folder-open", "JS-REACHABLE-DISGUISED-SOURCE", 2, 1, "entry: stage.js"),
            ("folder-open", "JS-REACHABLE-DISGUISED-SOURCE", 2, 2, "stage.js:1 imports fonts/text.woff2"),
            ("folder-open", "JS-REACHABLE-DISGUISED-SOURCE", 2, 3, "capability: fetch at line 2"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 0, "trigger: VS Code folderOpen task at line 1"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 1, "entry: stage.js"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 2, "stage.js:1 imports fonts/text.woff2"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 3, "source: fonts/text.woff2:2 fetch"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 4, "property: fonts/text.woff2 answer.text"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 5, "transform: fonts/text.woff2:3 answer.text"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 6, "decode: fonts/text.woff2:3 Buffer.from"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 7, "property: fonts/text.woff2 answer.text.toString"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 8, "transform: fonts/text.woff2:3 answer.text.toString"),
            ("folder-open", "JS-REMOTE-CODE-EXECUTION", 4, 9, "sink: fonts/text.woff2:4 Function"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 0, "trigger: build or CI command in .github/workflows/a.yml at line 2"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 1, "entry: tools/run.js"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 2, "source: tools/run.js:1 fetch"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 3, "property: tools/run.js r.text"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 4, "transform: tools/run.js:1 r.text"),
            ("from-ci", "JS-REMOTE-CODE-EXECUTION", 2, 5, "sink: tools/run.js:2 eval"),
            ("from-config", "JS-REACHABLE-DISGUISED-SOURCE", 1, 0, "trigger: build config webpack.config.js"),
            ("from-config", "JS-REACHABLE-DISGUISED-SOURCE", 1, 1, "entry: webpack.config.js"),
            ("from-config", "JS-REACHABLE-DISGUISED-SOURCE", 1, 2, "webpack.config.js:1 imports asset.png"),
            ("from-config", "JS-REACHABLE-DISGUISED-SOURCE", 1, 3, "capability: fetch at line 1"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 0, "trigger: build config webpack.config.js"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 1, "entry: webpack.config.js"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 2, "webpack.config.js:1 imports asset.png"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 3, "source: asset.png:1 fetch"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 4, "property: asset.png r.text"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 5, "transform: asset.png:1 r.text"),
            ("from-config", "JS-REMOTE-CODE-EXECUTION", 2, 6, "sink: asset.png:2 Function"),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", 3, 0, "trigger: unresolved"),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", 3, 1, "source: index.js:2 fetch"),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", 3, 2, "property: index.js r.text"),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", 3, 3, "transform: index.js:2 r.text"),
            ("no-trigger", "JS-REMOTE-CODE-EXECUTION", 3, 4, "sink: index.js:3 eval"),
            ("no-trigger", "JS-SECRET-EXFILTRATION", 1, 0, "trigger: unresolved"),
            ("no-trigger", "JS-SECRET-EXFILTRATION", 1, 1, "source: index.js process.env"),
            ("no-trigger", "JS-SECRET-EXFILTRATION", 1, 2, "property: index.js process.env.KEY"),
            ("no-trigger", "JS-SECRET-EXFILTRATION", 1, 3, "sink: index.js:1 fetch"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 0, "trigger: npm start (package.json) at line 1"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 1, "entry: lib/x.js"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 2, "source: lib/x.js:1 fetch"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 3, "property: lib/x.js r.text"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 4, "transform: lib/x.js:1 r.text"),
            ("npm-chain", "JS-REMOTE-CODE-EXECUTION", 2, 5, "sink: lib/x.js:2 eval"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 0, "trigger: npm start (package.json) at line 1"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 1, "entry: src/main.js"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 2, "source: src/main.js:2 fetch"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 3, "property: src/main.js answer.text"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 4, "transform: src/main.js:3 answer.text"),
            ("remote-eval", "JS-REMOTE-CODE-EXECUTION", 3, 5, "sink: src/main.js:3 eval"),
            ("secret-sent", "JS-SECRET-EXFILTRATION", 2, 0, "trigger: npm start (package.json) at line 1"),
            ("secret-sent", "JS-SECRET-EXFILTRATION", 2, 1, "entry: src/main.js"),
            ("secret-sent", "JS-SECRET-EXFILTRATION", 2, 2, "source: src/main.js process.env"),
            ("secret-sent", "JS-SECRET-EXFILTRATION", 2, 3, "property: src/main.js process.env.NPM_TOKEN"),
            ("secret-sent", "JS-SECRET-EXFILTRATION", 2, 4, "sink: src/main.js:2 fetch"),
            ("startup-entry", "JS-PERSISTENCE-WRITE", 3, 0, "trigger: npm preinstall (package.json) at line 1"),
            ("startup-entry", "JS-PERSISTENCE-WRITE", 3, 1, "entry: tools/setup.js"),
            ("startup-entry", "JS-PERSISTENCE-WRITE", 3, 2, "write target: $HOME/.config/autostart/u.desktop"),
        ],
    ),
    "project_summaries": (
        "repo_id VARCHAR, status VARCHAR, severity VARCHAR, score BIGINT, entries BIGINT, files BIGINT, directories BIGINT, symlinks BIGINT, special_files BIGINT, content_bytes BIGINT, findings BIGINT",
        [
            ("both-chains", "complete", "critical", 99, 2, 2, 1, 0, 0, 182, 5),
            ("clean", "complete", "informational", 0, 1, 1, 1, 0, 0, 26, 0),
            ("concealed-late", "complete", "high", 88, 2, 2, 1, 0, 0, 659, 5),
            ("concealed-process", "complete", "high", 88, 2, 2, 1, 0, 0, 177, 3),
            ("credentials-sent", "complete", "critical", 97, 3, 2, 2, 0, 0, 453, 3),
            ("disguised", "complete", "critical", 98, 3, 3, 1, 0, 0, 182, 6),
            ("folder-open", "complete", "critical", 98, 5, 3, 3, 0, 0, 324, 6),
            ("from-ci", "complete", "critical", 98, 5, 2, 4, 0, 0, 122, 2),
            ("from-config", "complete", "critical", 98, 2, 2, 1, 0, 0, 119, 5),
            ("no-trigger", "complete", "critical", 98, 1, 1, 1, 0, 0, 143, 3),
            ("npm-chain", "complete", "critical", 98, 3, 2, 2, 0, 0, 164, 3),
            ("remote-eval", "complete", "critical", 98, 3, 2, 2, 0, 0, 166, 3),
            ("secret-sent", "complete", "critical", 97, 3, 2, 2, 0, 0, 147, 2),
            ("startup-entry", "complete", "high", 85, 3, 2, 2, 0, 0, 195, 2),
        ],
    ),
    "flow_case_findings": (
        "repo_id VARCHAR, id VARCHAR, severity VARCHAR, score BIGINT, file VARCHAR, line BIGINT",
        [
            ("all", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("assigned", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("called-by-call", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("chunks", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("class", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("clipboard", "JS-SECRET-EXFILTRATION", "critical", 97, "index.js", 1),
            ("commonjs", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "lib/index.js", 1),
            ("computed", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("decoded", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("download-joined", "JS-DOWNLOAD-WRITE-EXECUTE", "critical", 98, "index.js", 1),
            ("download-run", "JS-DOWNLOAD-WRITE-EXECUTE", "critical", 98, "index.js", 1),
            ("env-secret", "JS-SECRET-EXFILTRATION", "critical", 97, "index.js", 1),
            ("events", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("field-hit", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("file-secret", "JS-SECRET-EXFILTRATION", "critical", 97, "index.js", 1),
            ("finally", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("live-branch", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("loaded", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("loop", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("method", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("modules", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "lib/a.js", 1),
            ("persistence", "JS-PERSISTENCE-COMMAND", "high", 85, "index.js", 2),
            ("persistence", "JS-PERSISTENCE-WRITE", "high", 85, "index.js", 3),
            ("process", "JS-REMOTE-PROCESS-EXECUTION", "critical", 97, "index.js", 1),
            ("process-apply", "JS-REMOTE-PROCESS-EXECUTION", "critical", 97, "index.js", 1),
            ("pushed", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("resource", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("returned", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 3),
            ("same-line-twice", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 2),
            ("socket", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("spread", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("star", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("taken-apart", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("template", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("then-chain", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("thrown", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 3),
            ("values", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
            ("vm-alias", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "index.js", 1),
        ],
    ),
    "flow_case_routes": (
        "repo_id VARCHAR, id VARCHAR, route VARCHAR",
        [
            ("all", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("assigned", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | property: index.js r.text.a | sink: index.js:1 eval"),
            ("called-by-call", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("chunks", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 https.get | sink: index.js:1 eval"),
            ("class", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("clipboard", "JS-SECRET-EXFILTRATION", "source: index.js:1 navigator.clipboard.readText | sink: index.js:1 fetch"),
            ("commonjs", "JS-REMOTE-CODE-EXECUTION", "index.js:1 imports lib/index.js | source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: lib/index.js:1 eval"),
            ("computed", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 global.eval"),
            ("decoded", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | decode: index.js:1 Buffer.from | property: index.js r.text.toString | transform: index.js:1 r.text.toString | sink: index.js:1 vm.runInThisContext"),
            ("download-joined", "JS-DOWNLOAD-WRITE-EXECUTE", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | write: index.js:1 fs.writeFileSync | sink: index.js:1 child_process.spawn"),
            ("download-run", "JS-DOWNLOAD-WRITE-EXECUTE", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | write: index.js:1 fs.writeFileSync | chmod: index.js:1 fs.chmodSync | sink: index.js:1 child_process.spawn"),
            ("env-secret", "JS-SECRET-EXFILTRATION", "source: index.js process.env | property: index.js process.env.TOKEN | transform: index.js:1 JSON.stringify | sink: index.js:1 fetch"),
            ("events", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 EventSource | property: index.js EventSource.data | sink: index.js:1 eval"),
            ("field-hit", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | property: index.js r.text.a | sink: index.js:1 eval"),
            ("file-secret", "JS-SECRET-EXFILTRATION", "source: index.js:1 fs.readFileSync (path evidence: $HOME/.ssh/id_rsa) | sink: index.js:1 WebSocket.send"),
            ("finally", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | exception flow: index.js throw/catch | sink: index.js:1 eval"),
            ("live-branch", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("loaded", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 require"),
            ("loop", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("method", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | property: index.js r.text.trim | transform: index.js:1 r.text.trim | property: index.js r.text.trim.slice | transform: index.js:1 r.text.trim.slice | sink: index.js:1 eval"),
            ("modules", "JS-REMOTE-CODE-EXECUTION", "index.js:1 imports lib/a.js | source: lib/b.ts:1 fetch | property: lib/b.ts r.text | transform: lib/b.ts:1 r.text | return: lib/b.ts get | sink: lib/a.js:1 eval"),
            ("persistence", "JS-PERSISTENCE-COMMAND", "command: crontab /tmp/x"),
            ("persistence", "JS-PERSISTENCE-WRITE", "write target: /home/u/.bashrc"),
            ("process", "JS-REMOTE-PROCESS-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 child_process.exec"),
            ("process-apply", "JS-REMOTE-PROCESS-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 child_process.exec"),
            ("pushed", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | property: index.js l.* | sink: index.js:1 eval"),
            ("resource", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("returned", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | return: index.js get | sink: index.js:3 eval"),
            ("same-line-twice", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:2 eval"),
            ("socket", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 WebSocket | property: index.js WebSocket.data | sink: index.js:1 eval"),
            ("spread", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | property: index.js r.text.a | sink: index.js:1 eval"),
            ("star", "JS-REMOTE-CODE-EXECUTION", "source: lib/b.js:1 fetch | property: lib/b.js r.text | transform: lib/b.js:1 r.text | return: lib/b.js get | sink: index.js:1 eval"),
            ("taken-apart", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js rest.code | sink: index.js:1 eval"),
            ("template", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 eval"),
            ("then-chain", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 Function"),
            ("thrown", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | exception flow: index.js throw/catch | sink: index.js:3 eval"),
            ("values", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | transform: index.js:1 Object.values | property: index.js r.text.* | sink: index.js:1 eval"),
            ("vm-alias", "JS-REMOTE-CODE-EXECUTION", "source: index.js:1 fetch | property: index.js r.text | transform: index.js:1 r.text | sink: index.js:1 node:vm.runInNewContext"),
        ],
    ),
    "single_findings": (
        "repo_id VARCHAR, id VARCHAR, severity VARCHAR, score BIGINT, file VARCHAR, line BIGINT",
        [
            ("after-eof", "RAW-CONTENT-AFTER-EOF", "high", 75, "a.txt", None),
            ("devcontainer", "DEVCONTAINER-EXECUTION-HOOK", "high", 75, ".devcontainer/devcontainer.json", 1),
            ("devcontainer", "DEVCONTAINER-EXECUTION-HOOK", "high", 75, ".devcontainer/devcontainer.json", 2),
            ("dotnet", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.csproj", 1),
            ("executable-text", "FILE-EXECUTABLE-CONTENT", "medium", 45, "a.json", None),
            ("gap", "RAW-HIDDEN-AFTER-WHITESPACE", "high", 75, "a.txt", 2),
            ("go", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.go", 1),
            ("html", "JS-DYNAMIC-EXECUTION", "medium", 45, "a.html", 2),
            ("html", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "a.html", 2),
            ("java", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "A.java", 1),
            ("launch", "IDE-PRELAUNCH-TASK", "informational", 10, ".vscode/launch.json", 1),
            ("long-line", "RAW-EXTREME-LINE", "medium", 40, "a.txt", None),
            ("magic", "FILE-TYPE-MISMATCH", "high", 80, "b.png", None),
            ("magic", "FILE-TYPE-MISMATCH", "medium", 45, "c.gz", None),
            ("magic", "FILE-TYPE-MISMATCH", "medium", 45, "d.svg", None),
            ("magic", "FILE-TYPE-MISMATCH", "medium", 45, "f.woff2", None),
            ("markdown-block", "JS-DYNAMIC-EXECUTION", "medium", 45, "a.md", 4),
            ("members", "LANG-EXECUTION-ROOT", "informational", 10, "a.zip!/in/install.sh", None),
            ("members", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.zip!/in/install.sh", 1),
            ("members", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.zip!/n.tgz!/content!/d/b.py", 1),
            ("npm", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 6),
            ("npm", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 7),
            ("npm", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 8),
            ("npm", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 2),
            ("npm", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 3),
            ("npm", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 4),
            ("npm", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 5),
            ("php", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.php", 1),
            ("powershell", "LANG-REMOTE-DOWNLOAD-EXECUTE", "high", 85, "a.ps1", 1),
            ("python", "LANG-EXECUTION-ROOT", "informational", 10, "setup.py", None),
            ("python", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.py", 1),
            ("ruby", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "a.rb", 1),
            ("rust", "LANG-EXECUTION-ROOT", "informational", 10, "build.rs", None),
            ("rust", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 60, "build.rs", 1),
            ("settings", "IDE-AUTOMATIC-TASKS", "high", 80, ".vscode/settings.json", 1),
            ("settings", "IDE-HIDDEN-SECURITY-FILES", "high", 75, ".vscode/settings.json", 1),
            ("shebang", "FILE-PARSEABLE-JAVASCRIPT", "medium", 45, "run", None),
            ("shebang", "JS-PROCESS-EXECUTION", "medium", 45, "run", 3),
            ("shell", "LANG-EXECUTION-ROOT", "informational", 10, "install.sh", None),
            ("shell", "LANG-REMOTE-DOWNLOAD-EXECUTE", "high", 85, "install.sh", 2),
            ("signatures", "YARA-JS-ENCRYPTED-LOADER", "medium", 60, "b.txt", None),
            ("signatures", "YARA-POWERSHELL-DOWNLOAD-EXEC", "medium", 60, "a.bin", None),
            ("tasks-download", "IDE-FOLDER-OPEN-DOWNLOAD-EXECUTE", "critical", 97, ".vscode/tasks.json", 2),
            ("tasks-plain", "IDE-FOLDER-OPEN-TASK", "high", 85, ".vscode/tasks.json", 1),
            ("variants", "JS-DYNAMIC-EXECUTION", "medium", 45, "a.js", 3),
            ("vue", "JS-DYNAMIC-EXECUTION", "medium", 45, "a.vue", 4),
        ],
    ),
    "single_files": (
        "repo_id VARCHAR, path VARCHAR, kind VARCHAR, size BIGINT, extension VARCHAR, detected_mime VARCHAR, encoding VARCHAR, line_count BIGINT, max_line_length BIGINT, roles VARCHAR, content_scanned BOOLEAN, parsed_language VARCHAR",
        [
            ("after-eof", "a.txt", "file", 12, "txt", None, "utf-8", 1, 12, "", True, None),
            ("devcontainer", ".devcontainer/devcontainer.json", "file", 75, "json", None, "utf-8", 2, 40, "developer_tool_config", True, None),
            ("dotnet", "a.csproj", "file", 25, "csproj", None, "utf-8", 1, 25, "", True, "dotnet"),
            ("elsewhere", "sub/.vscode/tasks.json", "file", 82, "json", None, "utf-8", 1, 82, "", True, None),
            ("encodings", "a.txt", "file", 5, "txt", None, "utf-8-bom", 1, 5, "", True, None),
            ("encodings", "b.txt", "file", 6, "txt", None, "utf-16le", 1, 6, "", True, None),
            ("encodings", "c.txt", "file", 6, "txt", None, "utf-16be", 1, 6, "", True, None),
            ("encodings", "d.txt", "file", 3, "txt", None, "binary", 1, 3, "", True, None),
            ("encodings", "e.js", "file", 4, "js", None, "utf-8", 1, 4, "", True, None),
            ("encodings", "f.txt", "file", 6, "txt", None, "unknown", 1, 6, "", True, None),
            ("encodings", "g.txt", "file", 1, "txt", None, "unknown", 1, 1, "", True, None),
            ("encodings", "h.txt", "file", 0, "txt", None, "utf-8", 0, 0, "", True, None),
            ("executable-text", "a.json", "file", 31, "json", None, "utf-8", 1, 31, "", True, None),
            ("gap", "a.txt", "file", 518, "txt", None, "utf-8", 2, 514, "", True, None),
            ("go", "a.go", "file", 27, "go", None, "utf-8", 2, 15, "", True, "go"),
            ("html", "a.html", "file", 204, "html", None, "utf-8", 3, 104, "", True, "javascript"),
            ("html", "b.js", "file", 4, "js", None, "utf-8", 1, 4, "", True, "javascript"),
            ("java", "A.java", "file", 47, "java", None, "utf-8", 1, 47, "", True, "java"),
            ("launch", ".vscode/launch.json", "file", 72, "json", None, "utf-8", 1, 72, "developer_tool_config", True, None),
            ("long-line", "a.txt", "file", 10000, "txt", None, "utf-8", 1, 10000, "", True, None),
            ("magic", "a.png", "file", 12, "png", "image/png", "unknown", 3, 5, "", True, None),
            ("magic", "b.png", "file", 8, "png", "application/x-executable", "utf-8", 1, 8, "", True, None),
            ("magic", "c.gz", "file", 12, "gz", "image/png", "unknown", 3, 5, "", True, None),
            ("magic", "d.svg", "file", 3, "svg", None, "utf-8", 1, 3, "", True, None),
            ("magic", "e.svg", "file", 14, "svg", None, "utf-8", 1, 14, "", True, None),
            ("magic", "f.woff2", "file", 8, "woff2", None, "utf-8", 1, 8, "", True, None),
            ("magic", "g.jpg", "file", 8, "jpg", "image/jpeg", "unknown", 1, 8, "", True, None),
            ("magic", "h.gif", "file", 8, "gif", "image/gif", "utf-8", 1, 8, "", True, None),
            ("magic", "i.webp", "file", 16, "webp", "image/webp", "binary", 1, 16, "", True, None),
            ("make", "Makefile", "file", 17, None, None, "utf-8", 2, 12, "build_script", True, None),
            ("markdown", "a.md", "file", 102, "md", None, "utf-8", 7, 31, "", True, None),
            ("markdown-block", "a.md", "file", 104, "md", None, "utf-8", 5, 78, "", True, "javascript"),
            ("members", "a.zip!/in/install.sh", "file", 17, "sh", None, "utf-8", 1, 17, "", True, "shell"),
            ("members", "a.zip!/n.tgz!/content!/d/b.py", "file", 18, "py", None, "utf-8", 2, 10, "", True, "python"),
            ("members", "a.zip!/n.tgz!/content", "file", 10240, None, "application/x-tar", "binary", 2, 9717, "", True, None),
            ("members", "a.zip!/n.tgz", "file", 117, "tgz", "application/gzip", "binary", 2, 103, "", True, None),
            ("members", "a.zip", "file", 345, "zip", "application/zip", "binary", 2, 202, "", True, None),
            ("npm", "package.json", "file", 186, "json", None, "utf-8", 9, 27, "npm_manifest", True, None),
            ("php", "a.php", "file", 45, "php", None, "utf-8", 2, 30, "", True, "php"),
            ("plain-js", "a.js", "file", 16, "js", None, "utf-8", 1, 16, "", True, None),
            ("powershell", "a.ps1", "file", 43, "ps1", None, "utf-8", 2, 22, "", True, "powershell"),
            ("python", "a.py", "file", 23, "py", None, "utf-8", 2, 15, "", True, "python"),
            ("python", "setup.py", "file", 7, "py", None, "utf-8", 1, 7, "", True, "python"),
            ("ruby", "a.rb", "file", 21, "rb", None, "utf-8", 2, 11, "", True, "ruby"),
            ("rust", "build.rs", "file", 31, "rs", None, "utf-8", 2, 15, "", True, "rust"),
            ("settings", ".vscode/settings.json", "file", 84, "json", None, "utf-8", 1, 84, "developer_tool_config", True, None),
            ("settings-off", ".vscode/settings.json", "file", 75, "json", None, "utf-8", 1, 75, "developer_tool_config", True, None),
            ("shebang", "run", "file", 68, None, "text/x-shellscript", "utf-8", 3, 35, "", True, "javascript"),
            ("shell", "install.sh", "file", 24, "sh", None, "utf-8", 2, 19, "", True, "shell"),
            ("signatures", "a.bin", "file", 51, "bin", None, "binary", 1, 51, "", True, None),
            ("signatures", "b.txt", "file", 44, "txt", None, "utf-8", 1, 44, "", True, None),
            ("signatures", "c.txt", "file", 40, "txt", None, "utf-8", 1, 40, "", True, None),
            ("tasks-download", ".vscode/tasks.json", "file", 98, "json", None, "utf-8", 2, 92, "developer_tool_config", True, None),
            ("tasks-plain", ".vscode/tasks.json", "file", 121, "json", None, "utf-8", 1, 121, "developer_tool_config", True, None),
            ("variants", "a.js", "file", 40, "js", None, "utf-8", 4, 18, "", True, "javascript"),
            ("vue", "a.vue", "file", 70, "vue", None, "utf-8", 5, 20, "", True, "typescript"),
        ],
    ),
    "unresolved_edges": (
        "repo_id VARCHAR, edge VARCHAR",
        [
            ("devcontainer", "devcontainer initializeCommand (command target unresolved)"),
            ("devcontainer", "devcontainer postCreateCommand (command target unresolved)"),
            ("html", "a.html:3 -> b.js (external package not inspected)"),
            ("npm", "npm install (package.json) -> b.js (entry unresolved)"),
            ("npm", "npm lint (package.json) (command target unresolved)"),
            ("npm", "npm postinstall (package.json) -> c.js (entry unresolved)"),
            ("npm", "npm postx (package.json) (command target unresolved)"),
            ("npm", "npm predev (package.json) (command target unresolved)"),
            ("npm", "npm preinstall (package.json) -> a.js (entry unresolved)"),
            ("npm", "npm prepare (package.json) -> d.js (entry unresolved)"),
            ("npm", "npm start (package.json) -> e.js (entry unresolved)"),
            ("npm-loop", "npm start (package.json) (command target unresolved)"),
            ("tasks-download", "VS Code folderOpen task (command target unresolved)"),
            ("tasks-plain", "VS Code folderOpen task (command target unresolved)"),
            ("unresolved", "a.js:1 -> ./missing (relative import unresolved)"),
            ("unresolved", "a.js:2 -> lodash (external package not inspected)"),
            ("unresolved", "a.js:3 -> <dynamic require> (dynamic module target unresolved)"),
            ("unresolved", "npm start (package.json) -> gone.js (entry unresolved)"),
        ],
    ),
    "incomplete_scans": (
        "repo_id VARCHAR, reason VARCHAR",
        [
            ("bad-manifest", "could not parse package manifest package.json"),
            ("bad-tasks", "could not parse developer-tool configuration .vscode/tasks.json"),
            ("broken", "cannot decompress gzip archive b.gz"),
            ("broken", "cannot parse ZIP archive a.zip"),
            ("deep", "JS/TS nesting limit of 256 exceeded: a.js"),
            ("linked", "ZIP symlink member skipped: a.zip!/l"),
            ("many-scripts", "embedded script limit of 256 reached: a.html"),
            ("nested", "archive recursion limit reached at a.zip!/b.zip!/c.zip!/d.zip"),
            ("not-utf8", "cannot decode JS/TS source: a.js"),
            ("npm-loop", "JS/TS execution root extraction limit reached: package.json"),
            ("open-script", "unterminated embedded JavaScript block: a.html"),
            ("ratio", "gzip compression ratio limit reached: a.gz!/a"),
            ("tar-links", "TAR link member skipped: a.tar!/h"),
            ("tar-links", "TAR link member skipped: a.tar!/s"),
            ("tar-links", "unsupported TAR member skipped: a.tar!/f"),
            ("traversal", "archive traversal path rejected: ../x in a.zip"),
            ("twice", "JS/TS semantic analysis could not fully inspect a.js: 1 diagnostic(s)"),
        ],
    ),
    "incomplete_members": (
        "repo_id VARCHAR, path VARCHAR, size BIGINT, sha256 VARCHAR",
        [
            ("linked", "a.zip!/ok.txt", 1, "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35"),
            ("nested", "a.zip!/b.zip!/c.zip!/d.zip", 111, "26f5b352b27c44cbf2980df3e87143ac70aef8960f074da24ef070e11ac25f67"),
            ("nested", "a.zip!/b.zip!/c.zip", 172, "5a05841572a536e0283f8e2fffae1ad1a7cf0f24f46e32d858cebbe4b8068cfd"),
            ("nested", "a.zip!/b.zip", 235, "716fda6bf0269eeae65efc4a7660c0c7d194fe7b64d5826681968b474b352ed8"),
            ("tar-links", "a.tar!/a", 1, "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"),
            ("traversal", "a.zip!/ok.txt", 1, "d4735e3a265e16eee03f59718b9b5d03019c07d8b6c51f90da3a666eec13ab35"),
        ],
    ),
    "limited_scans": (
        "repo_id VARCHAR, reason VARCHAR",
        [
            ("bytes", "5 files, 890 bytes, 0 findings"),
            ("bytes", "file exceeds 1000 byte limit: e.txt"),
            ("bytes", "total content byte limit 900 reached before c.txt"),
            ("depth", "1 files, 1 bytes, 0 findings"),
            ("depth", "maximum directory depth 3 reached at a/b/c/d"),
            ("edges", "3 unresolved"),
            ("edges", "5 files, 155 bytes, 0 findings"),
            ("edges", "JS/TS graph edge limit of 7 reached"),
            ("entries", "10 files, 10 bytes, 0 findings"),
            ("entries", "maximum entry count 10 reached"),
            ("findings", "9 files, 99 bytes, 6 findings"),
            ("findings", "finding limit reached"),
            ("member-bytes", "2 files, 474 bytes, 0 findings"),
            ("member-bytes", "archive member exceeds byte limit: a.zip!/a.txt"),
            ("members", "4 files, 507 bytes, 0 findings"),
            ("members", "archive member limit of 3 reached at a.zip"),
            ("modules", "8 files, 32 bytes, 0 findings"),
            ("modules", "JS/TS global semantic analysis limit of 6 modules or 67108864 source bytes reached before m6.js; additional modules were omitted"),
            ("routes", "1 unresolved"),
            ("routes", "9 files, 167 bytes, 1 findings"),
            ("routes", "JS/TS execution route depth limit of 5 reached"),
            ("routes", "JS/TS global semantic analysis limit of 6 modules or 67108864 source bytes reached before r6.js; additional modules were omitted"),
        ],
    ),
    "walked_tree": (
        "place BIGINT, path VARCHAR, kind VARCHAR, symlink_target VARCHAR, length BIGINT, note VARCHAR",
        [
            (1, "a.txt", "file", None, 1, None),
            (10, "d/.git/c", "file", None, 1, None),
            (2, "absolute-out", "symlink", "/etc/passwd", None, "escapes"),
            (3, "dangling", "symlink", "gone", None, None),
            (4, "folder", "symlink", "d", None, None),
            (5, "inside", "symlink", "a.txt", None, None),
            (6, None, "#reason", None, None, None),
            (7, "pipe", "special", None, None, None),
            (8, "d/b.txt", "file", None, 2, None),
            (9, "d/out", "symlink", "../../out", None, "escapes"),
        ],
    ),
    "tree_findings": (
        "id VARCHAR, severity VARCHAR, score BIGINT, file VARCHAR, line BIGINT",
        [
            ("FS-ABSOLUTE-SYMLINK", "medium", 40, "absolute", None),
            ("FS-SPECIAL-FILE", "medium", 45, "pipe", None),
            ("FS-SYMLINK-ESCAPE", "high", 80, "out", None),
        ],
    ),
    "signal_samples": (
        "name VARCHAR, position BIGINT, signal VARCHAR",
        [
            ("addresses", 0, "IPv4 address occurrences: 2"),
            ("base64", 0, "large base64-like sequence: 600 bytes"),
            ("blank run", 0, "extreme horizontal whitespace: 600 bytes"),
            ("char codes", 0, "character-code string construction"),
            ("char codes, quoted", 0, "character-code string construction"),
            ("debugger", 0, "anti-debugging or automation check"),
            ("entropy", 0, "high-entropy text: 6.48 bits per byte"),
            ("eof", 0, "content follows an apparent logical EOF marker"),
            ("escapes", 0, "unicode escape sequences: 32"),
            ("gap", 0, "code follows 512 horizontal whitespace bytes"),
            ("hexadecimal", 0, "large base64-like sequence: 512 bytes"),
            ("hexadecimal", 1, "large hexadecimal sequence: 512 bytes"),
            ("identifiers", 0, "_0x-style identifiers: 8"),
            ("locale", 0, "locale or regional environment check"),
            ("long line", 0, "extreme line length: 10000 bytes"),
            ("machines", 0, "virtual-machine environment check"),
            ("powershell", 0, "PowerShell download or execution primitive"),
            ("processes", 0, "security-tool process enumeration check"),
            ("short link", 0, "shortened URL"),
            ("timer", 0, "long timer delay"),
            ("timer, zeros", 0, "long timer delay"),
            ("urls", 0, "URL occurrences: 3"),
            ("wallet", 0, "wallet-like identifiers: 1"),
            ("webdriver", 0, "anti-debugging or automation check"),
            ("webhook", 0, "webhook endpoint"),
            ("xor", 0, "possible XOR string decoder"),
        ],
    ),
    "module_imports": (
        "id VARCHAR, seq BIGINT, specifier VARCHAR, line BIGINT",
        [
            ("imports.mjs", 0, "m", 1),
            ("imports.mjs", 1, "./y.js", 2),
            ("imports.mjs", 2, "./z.js", 3),
            ("imports.mjs", 3, "w", 4),
            ("imports.mjs", 4, "v", 5),
            ("imports.mjs", 5, "<dynamic require>", 6),
            ("names.js", 0, "child_process", 1),
        ],
    ),
    "module_calls": (
        "id VARCHAR, seq BIGINT, name VARCHAR, line BIGINT, capability VARCHAR, function VARCHAR",
        [
            ("commonjs.js", 0, "eval", 2, "DynamicCode", None),
            ("functions.js", 0, "eval", 1, "DynamicCode", "boot"),
            ("functions.js", 1, "local:boot", 2, None, "go"),
            ("functions.js", 2, "local:go", 3, None, None),
            ("functions.js", 3, "fetch", 4, "Network", "<anonymous>"),
            ("functions.js", 4, "eval", 5, "DynamicCode", "<anonymous>"),
            ("imports.mjs", 0, "import", 4, "DynamicCode", None),
            ("imports.mjs", 1, "require", 5, None, None),
            ("imports.mjs", 2, "dynamic require", 6, "DynamicCode", None),
            ("imports.mjs", 3, "require", 6, None, None),
            ("names.js", 0, "require", 1, None, None),
            ("names.js", 1, "local:run", 3, None, None),
            ("names.js", 2, "child_process.exec", 4, "Process", None),
            ("names.js", 3, "fetch", 6, "Network", None),
            ("names.js", 4, "window.eval", 7, "DynamicCode", None),
            ("names.js", 5, "child_process.exec", 8, "Process", None),
            ("names.js", 6, "Function", 9, "DynamicCode", None),
            ("secrets.js", 0, "process.env.TOKEN", 1, "Secret", None),
            ("types.ts", 0, "eval", 3, "DynamicCode", None),
            ("types.ts", 1, "local:f", 3, None, None),
            ("using.mjs", 0, "open", 1, None, None),
            ("using.mjs", 1, "open", 2, None, None),
            ("using.mjs", 2, "eval", 3, "DynamicCode", None),
            ("view.jsx", 0, "eval", 1, "DynamicCode", "<anonymous>"),
        ],
    ),
    "module_languages": (
        "path VARCHAR, language VARCHAR, modules BIGINT, reasons BIGINT",
        [
            ("commonjs.js", "javascript", 1, 0),
            ("empty.js", None, 0, 0),
            ("functions.js", "javascript", 1, 0),
            ("imports.mjs", "javascript", 1, 0),
            ("names.js", "javascript", 1, 0),
            ("secrets.js", "javascript", 1, 0),
            ("twice.js", None, 0, 1),
            ("types.ts", "typescript", 1, 0),
            ("using.mjs", "javascript", 1, 0),
            ("view.jsx", "javascript", 1, 0),
            ("wrong.ts", None, 0, 1),
        ],
    ),
    "command_targets": (
        "given VARCHAR, result VARCHAR",
        [
            ("node -e 'x' c.js", ""),
            ("sh -c 'node c.js'", "c.js"),
            ("", ""),
            ("./run.mjs", ""),
            ("NODE_ENV=x node a.js", ""),
            ("bun y.ts | cat", "y.ts"),
            ("cross-env A=1 node -r ./p.js src/a.ts --flag b.mjs", "./p.js,b.mjs,src/a.ts"),
            ("deno run x.ts", "x.ts"),
            ("echo a.js", ""),
            ("node a.js && node b.js; node a.js", "a.js,b.js"),
            ("node a.js", "a.js"),
            ("npx tsx a.ts", "a.ts"),
            ("yarn exec node b.js", "b.js"),
        ],
    ),
    "script_chains": (
        "given VARCHAR, result VARCHAR",
        [
            ("node z.js", "z.js"),
            ("npm run a", "x.js,y.ts"),
            ("npm run loop", " limit"),
            ("npm run none", ""),
            ("pnpm run b", "y.ts"),
        ],
    ),
    "execution_root_files": (
        "given VARCHAR, result VARCHAR",
        [
            (".devcontainer/devcontainer.json", "d.js <- devcontainer postCreateCommand at 1"),
            (".github/workflows/w.yml", "ci.js <- build or CI command in .github/workflows/w.yml at 1"),
            (".gitlab-ci.yml", "lab.js <- build or CI command in .gitlab-ci.yml at 2"),
            (".vscode/tasks.json", "t.js <- VS Code folderOpen task at 1"),
            ("Dockerfile", "docker.js <- build or CI command in Dockerfile at 2"),
            ("Makefile", "make.js <- build or CI command in Makefile at 2"),
            ("package.json", "s.js <- npm start (package.json) at 1; b.js <- npm b (package.json) at 1"),
            ("vite.config.ts", "vite.config.ts <- build config vite.config.ts at None"),
        ],
    ),
    "name_tables": (
        "given VARCHAR, result VARCHAR",
        [
            (".npmrc", "secret"),
            ("/etc/cron.d/x", "startup"),
            ("/home/u/.bashrc", "startup"),
            ("/home/u/.ssh/id_rsa", "secret"),
            ("C:\\Users\\u\\.AWS\\credentials", "secret"),
            ("README.md", ""),
            ("child_process.exec", "can Process"),
            ("crontab -l", "registers"),
            ("eval", "can DynamicCode"),
            ("fetch", "can Network"),
            ("fs.readFileSync", "can FileRead"),
            ("ls", ""),
            ("process.env.CI", ""),
            ("process.env.TOKEN", "can Secret"),
            ("schtasks /create", "registers"),
            ("systemctl enable x", ""),
            ("vm.runInThisContext.call", "calls vm.runInThisContext"),
            ("~/.config/autostart/a.desktop", "startup"),
        ],
    ),
    "document_scripts": (
        "given VARCHAR, result VARCHAR",
        [
            ("blank line", "2:b"),
            ("comment", "0:b"),
            ("external", "1:x.js"),
            ("fence", "3:b"),
            ("json", ""),
            ("mime", "0:a"),
            ("open span", "0:a"),
            ("open", "unterminated embedded JavaScript block"),
            ("other tag", ""),
            ("plain", "0:a | 1:b"),
            ("quotes", "0:a"),
            ("short close", ""),
            ("span", ""),
            ("tilde", ""),
            ("typed", "0:a"),
        ],
    ),
    "source_variants": (
        "given VARCHAR, result VARCHAR",
        [
            ("f();\n", "a.js"),
            ("let a = f();\n---\nlet a = g();\n", "a.js#source-case-0,a.js#source-case-1"),
            ("let a = f();\n---\nlet b = ;\n", "a.js#source-case-0"),
            ("words\n---\nmore words\n", "a.js#source-case-0"),
        ],
    ),
    "report_lines": (
        "repo_id VARCHAR, format VARCHAR, number BIGINT, line VARCHAR",
        [
            ("clean", "exit at critical", 0, "0"),
            ("clean", "exit at high", 0, "0"),
            ("clean", "exit at info", 0, "0"),
            ("clean", "exit at medium", 0, "0"),
            ("clean", "json", 0, "{"),
            ("clean", "json", 1, "  \"schema_version\": 2,"),
            ("clean", "json", 10, "    \"score\": 0"),
            ("clean", "json", 11, "  },"),
            ("clean", "json", 12, "  \"summary\": {"),
            ("clean", "json", 13, "    \"entries\": 1,"),
            ("clean", "json", 14, "    \"files\": 1,"),
            ("clean", "json", 15, "    \"directories\": 1,"),
            ("clean", "json", 16, "    \"symlinks\": 0,"),
            ("clean", "json", 17, "    \"special_files\": 0,"),
            ("clean", "json", 18, "    \"content_bytes\": 26,"),
            ("clean", "json", 19, "    \"findings\": 0"),
            ("clean", "json", 2, "  \"scanner\": \"lodestrata\","),
            ("clean", "json", 20, "  },"),
            ("clean", "json", 21, "  \"files\": ["),
            ("clean", "json", 22, "    {"),
            ("clean", "json", 23, "      \"path\": \"index.js\","),
            ("clean", "json", 24, "      \"kind\": \"file\","),
            ("clean", "json", 25, "      \"size\": 26,"),
            ("clean", "json", 26, "      \"readonly\": false,"),
            ("clean", "json", 27, "      \"mode\": 33188,"),
            ("clean", "json", 28, "      \"sha256\": \"a2098bd92b10bf8b816d24b7556b1ce8c49a879d130489065ef1051c17e042f6\","),
            ("clean", "json", 29, "      \"extension\": \"js\","),
            ("clean", "json", 3, "  \"scanner_version\": \"0.1.0\","),
            ("clean", "json", 30, "      \"detected_mime\": null,"),
            ("clean", "json", 31, "      \"encoding\": \"utf-8\","),
            ("clean", "json", 32, "      \"entropy\": 3.931208948910323,"),
            ("clean", "json", 33, "      \"line_count\": 1,"),
            ("clean", "json", 34, "      \"max_line_length\": 25,"),
            ("clean", "json", 35, "      \"symlink_target\": null,"),
            ("clean", "json", 36, "      \"roles\": [],"),
            ("clean", "json", 37, "      \"raw_signals\": [],"),
            ("clean", "json", 38, "      \"content_scanned\": true,"),
            ("clean", "json", 39, "      \"parsed_language\": \"javascript\""),
            ("clean", "json", 4, "  \"target\": \"/src/clean\","),
            ("clean", "json", 40, "    }"),
            ("clean", "json", 41, "  ],"),
            ("clean", "json", 42, "  \"findings\": [],"),
            ("clean", "json", 43, "  \"unresolved_edges\": [],"),
            ("clean", "json", 44, "  \"incomplete_reasons\": []"),
            ("clean", "json", 45, "}"),
            ("clean", "json", 46, ""),
            ("clean", "json", 5, "  \"profile\": \"default\","),
            ("clean", "json", 6, "  \"status\": \"complete\","),
            ("clean", "json", 7, "  \"network_access\": \"disabled\","),
            ("clean", "json", 8, "  \"risk\": {"),
            ("clean", "json", 9, "    \"severity\": \"informational\","),
            ("clean", "markdown", 0, "<!-- lodestrata Markdown v2 -->"),
            ("clean", "markdown", 1, ""),
            ("clean", "markdown", 10, ""),
            ("clean", "markdown", 11, "No significant malicious indicators were identified by this version of lodestrata."),
            ("clean", "markdown", 12, "No repository code was executed during this scan."),
            ("clean", "markdown", 13, ""),
            ("clean", "markdown", 2, "# lodestrata 0.1.0"),
            ("clean", "markdown", 3, ""),
            ("clean", "markdown", 4, "- **Target:** `/src/clean`"),
            ("clean", "markdown", 5, "- **Profile:** default"),
            ("clean", "markdown", 6, "- **Status:** COMPLETE"),
            ("clean", "markdown", 7, "- **Files:** 1"),
            ("clean", "markdown", 8, "- **Risk:** INFORMATIONAL (0/100)"),
            ("clean", "markdown", 9, "- **Network:** disabled"),
            ("clean", "terminal", 0, "lodestrata 0.1.0"),
            ("clean", "terminal", 1, "Scanning: /src/clean"),
            ("clean", "terminal", 10, "Scan status: COMPLETE"),
            ("clean", "terminal", 11, ""),
            ("clean", "terminal", 12, "No significant malicious indicators were identified by this version of lodestrata."),
            ("clean", "terminal", 13, ""),
            ("clean", "terminal", 14, "No repository code was executed during this scan."),
            ("clean", "terminal", 15, "Network access: disabled"),
            ("clean", "terminal", 16, ""),
            ("clean", "terminal", 2, "Profile: default"),
            ("clean", "terminal", 3, ""),
            ("clean", "terminal", 4, "Files        1"),
            ("clean", "terminal", 5, "Directories  1"),
            ("clean", "terminal", 6, "Symlinks     0"),
            ("clean", "terminal", 7, "Content      26 bytes"),
            ("clean", "terminal", 8, ""),
            ("clean", "terminal", 9, "Repository risk: INFORMATIONAL — 0/100"),
            ("startup-entry", "exit at critical", 0, "0"),
            ("startup-entry", "exit at high", 0, "1"),
            ("startup-entry", "exit at info", 0, "1"),
            ("startup-entry", "exit at medium", 0, "1"),
            ("startup-entry", "markdown", 0, "<!-- lodestrata Markdown v2 -->"),
            ("startup-entry", "markdown", 1, ""),
            ("startup-entry", "markdown", 10, ""),
            ("startup-entry", "markdown", 11, "## HIGH — JavaScript writes to an automatic startup location"),
            ("startup-entry", "markdown", 12, ""),
            ("startup-entry", "markdown", 13, "A filesystem write targets a recognized persistence location."),
            ("startup-entry", "markdown", 14, ""),
            ("startup-entry", "markdown", 15, "**Location:** `tools/setup.js:3`"),
            ("startup-entry", "markdown", 16, ""),
            ("startup-entry", "markdown", 17, "**Rule:** `JS-PERSISTENCE-WRITE`  "),
            ("startup-entry", "markdown", 18, "**Confidence:** High  "),
            ("startup-entry", "markdown", 19, "**Risk:** 85/100"),
            ("startup-entry", "markdown", 2, "# lodestrata 0.1.0"),
            ("startup-entry", "markdown", 20, ""),
            ("startup-entry", "markdown", 21, "- `trigger: npm preinstall (package.json) at line 1`"),
            ("startup-entry", "markdown", 22, "- `entry: tools/setup.js`"),
            ("startup-entry", "markdown", 23, "- `write target: $HOME/.config/autostart/u.desktop`"),
            ("startup-entry", "markdown", 24, ""),
            ("startup-entry", "markdown", 25, "## MEDIUM — Package lifecycle script can execute during installation"),
            ("startup-entry", "markdown", 26, ""),
            ("startup-entry", "markdown", 27, "The npm script 'preinstall' can execute repository-controlled commands."),
            ("startup-entry", "markdown", 28, ""),
            ("startup-entry", "markdown", 29, "**Location:** `package.json:1`"),
            ("startup-entry", "markdown", 3, ""),
            ("startup-entry", "markdown", 30, ""),
            ("startup-entry", "markdown", 31, "**Rule:** `NPM-LIFECYCLE-SCRIPT`  "),
            ("startup-entry", "markdown", 32, "**Confidence:** VeryHigh  "),
            ("startup-entry", "markdown", 33, "**Risk:** 35/100"),
            ("startup-entry", "markdown", 34, ""),
            ("startup-entry", "markdown", 35, "- `preinstall: node tools/setup.js`"),
            ("startup-entry", "markdown", 36, ""),
            ("startup-entry", "markdown", 37, "No repository code was executed during this scan."),
            ("startup-entry", "markdown", 38, ""),
            ("startup-entry", "markdown", 4, "- **Target:** `/src/startup-entry`"),
            ("startup-entry", "markdown", 5, "- **Profile:** default"),
            ("startup-entry", "markdown", 6, "- **Status:** COMPLETE"),
            ("startup-entry", "markdown", 7, "- **Files:** 2"),
            ("startup-entry", "markdown", 8, "- **Risk:** HIGH (85/100)"),
            ("startup-entry", "markdown", 9, "- **Network:** disabled"),
            ("startup-entry", "sarif", 0, "{"),
            ("startup-entry", "sarif", 1, "  \"$schema\": \"https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json\","),
            ("startup-entry", "sarif", 10, "            {"),
            ("startup-entry", "sarif", 100, "          ],"),
            ("startup-entry", "sarif", 101, "          \"relatedLocations\": ["),
            ("startup-entry", "sarif", 102, "            {"),
            ("startup-entry", "sarif", 103, "              \"id\": 1,"),
            ("startup-entry", "sarif", 104, "              \"message\": {"),
            ("startup-entry", "sarif", 105, "                \"text\": \"preinstall: node tools/setup.js\""),
            ("startup-entry", "sarif", 106, "              }"),
            ("startup-entry", "sarif", 107, "            }"),
            ("startup-entry", "sarif", 108, "          ]"),
            ("startup-entry", "sarif", 109, "        }"),
            ("startup-entry", "sarif", 11, "              \"id\": \"JS-PERSISTENCE-WRITE\","),
            ("startup-entry", "sarif", 110, "      ],"),
            ("startup-entry", "sarif", 111, "      \"properties\": {"),
            ("startup-entry", "sarif", 112, "        \"scanStatus\": \"complete\","),
            ("startup-entry", "sarif", 113, "        \"networkAccess\": \"disabled\","),
            ("startup-entry", "sarif", 114, "        \"scanProfile\": \"default\""),
            ("startup-entry", "sarif", 115, "      }"),
            ("startup-entry", "sarif", 116, "    }"),
            ("startup-entry", "sarif", 117, "  ]"),
            ("startup-entry", "sarif", 118, "}"),
            ("startup-entry", "sarif", 119, ""),
            ("startup-entry", "sarif", 12, "              \"name\": \"JS-PERSISTENCE-WRITE\","),
            ("startup-entry", "sarif", 13, "              \"shortDescription\": {"),
            ("startup-entry", "sarif", 14, "                \"text\": \"JavaScript writes to an automatic startup location\""),
            ("startup-entry", "sarif", 15, "              },"),
            ("startup-entry", "sarif", 16, "              \"defaultConfiguration\": {"),
            ("startup-entry", "sarif", 17, "                \"level\": \"error\""),
            ("startup-entry", "sarif", 18, "              }"),
            ("startup-entry", "sarif", 19, "            },"),
            ("startup-entry", "sarif", 2, "  \"version\": \"2.1.0\","),
            ("startup-entry", "sarif", 20, "            {"),
            ("startup-entry", "sarif", 21, "              \"id\": \"NPM-LIFECYCLE-SCRIPT\","),
            ("startup-entry", "sarif", 22, "              \"name\": \"NPM-LIFECYCLE-SCRIPT\","),
            ("startup-entry", "sarif", 23, "              \"shortDescription\": {"),
            ("startup-entry", "sarif", 24, "                \"text\": \"Package lifecycle script can execute during installation\""),
            ("startup-entry", "sarif", 25, "              },"),
            ("startup-entry", "sarif", 26, "              \"defaultConfiguration\": {"),
            ("startup-entry", "sarif", 27, "                \"level\": \"warning\""),
            ("startup-entry", "sarif", 28, "              }"),
            ("startup-entry", "sarif", 29, "            }"),
            ("startup-entry", "sarif", 3, "  \"runs\": ["),
            ("startup-entry", "sarif", 30, "          ]"),
            ("startup-entry", "sarif", 31, "        }"),
            ("startup-entry", "sarif", 32, "      },"),
            ("startup-entry", "sarif", 33, "      \"results\": ["),
            ("startup-entry", "sarif", 34, "        {"),
            ("startup-entry", "sarif", 35, "          \"ruleId\": \"JS-PERSISTENCE-WRITE\","),
            ("startup-entry", "sarif", 36, "          \"ruleIndex\": 0,"),
            ("startup-entry", "sarif", 37, "          \"level\": \"error\","),
            ("startup-entry", "sarif", 38, "          \"message\": {"),
            ("startup-entry", "sarif", 39, "            \"text\": \"A filesystem write targets a recognized persistence location.\""),
            ("startup-entry", "sarif", 4, "    {"),
            ("startup-entry", "sarif", 40, "          },"),
            ("startup-entry", "sarif", 41, "          \"properties\": {"),
            ("startup-entry", "sarif", 42, "            \"confidence\": \"high\","),
            ("startup-entry", "sarif", 43, "            \"riskScore\": 85"),
            ("startup-entry", "sarif", 44, "          },"),
            ("startup-entry", "sarif", 45, "          \"locations\": ["),
            ("startup-entry", "sarif", 46, "            {"),
            ("startup-entry", "sarif", 47, "              \"physicalLocation\": {"),
            ("startup-entry", "sarif", 48, "                \"artifactLocation\": {"),
            ("startup-entry", "sarif", 49, "                  \"uri\": \"tools/setup.js\""),
            ("startup-entry", "sarif", 5, "      \"tool\": {"),
            ("startup-entry", "sarif", 50, "                },"),
            ("startup-entry", "sarif", 51, "                \"region\": {"),
            ("startup-entry", "sarif", 52, "                  \"startLine\": 3"),
            ("startup-entry", "sarif", 53, "                }"),
            ("startup-entry", "sarif", 54, "              }"),
            ("startup-entry", "sarif", 55, "            }"),
            ("startup-entry", "sarif", 56, "          ],"),
            ("startup-entry", "sarif", 57, "          \"relatedLocations\": ["),
            ("startup-entry", "sarif", 58, "            {"),
            ("startup-entry", "sarif", 59, "              \"id\": 1,"),
            ("startup-entry", "sarif", 6, "        \"driver\": {"),
            ("startup-entry", "sarif", 60, "              \"message\": {"),
            ("startup-entry", "sarif", 61, "                \"text\": \"trigger: npm preinstall (package.json) at line 1\""),
            ("startup-entry", "sarif", 62, "              }"),
            ("startup-entry", "sarif", 63, "            },"),
            ("startup-entry", "sarif", 64, "            {"),
            ("startup-entry", "sarif", 65, "              \"id\": 2,"),
            ("startup-entry", "sarif", 66, "              \"message\": {"),
            ("startup-entry", "sarif", 67, "                \"text\": \"entry: tools/setup.js\""),
            ("startup-entry", "sarif", 68, "              }"),
            ("startup-entry", "sarif", 69, "            },"),
            ("startup-entry", "sarif", 7, "          \"name\": \"lodestrata\","),
            ("startup-entry", "sarif", 70, "            {"),
            ("startup-entry", "sarif", 71, "              \"id\": 3,"),
            ("startup-entry", "sarif", 72, "              \"message\": {"),
            ("startup-entry", "sarif", 73, "                \"text\": \"write target: $HOME/.config/autostart/u.desktop\""),
            ("startup-entry", "sarif", 74, "              }"),
            ("startup-entry", "sarif", 75, "            }"),
            ("startup-entry", "sarif", 76, "          ]"),
            ("startup-entry", "sarif", 77, "        },"),
            ("startup-entry", "sarif", 78, "        {"),
            ("startup-entry", "sarif", 79, "          \"ruleId\": \"NPM-LIFECYCLE-SCRIPT\","),
            ("startup-entry", "sarif", 8, "          \"version\": \"0.1.0\","),
            ("startup-entry", "sarif", 80, "          \"ruleIndex\": 1,"),
            ("startup-entry", "sarif", 81, "          \"level\": \"warning\","),
            ("startup-entry", "sarif", 82, "          \"message\": {"),
            ("startup-entry", "sarif", 83, "            \"text\": \"The npm script 'preinstall' can execute repository-controlled commands.\""),
            ("startup-entry", "sarif", 84, "          },"),
            ("startup-entry", "sarif", 85, "          \"properties\": {"),
            ("startup-entry", "sarif", 86, "            \"confidence\": \"veryhigh\","),
            ("startup-entry", "sarif", 87, "            \"riskScore\": 35"),
            ("startup-entry", "sarif", 88, "          },"),
            ("startup-entry", "sarif", 89, "          \"locations\": ["),
            ("startup-entry", "sarif", 9, "          \"rules\": ["),
            ("startup-entry", "sarif", 90, "            {"),
            ("startup-entry", "sarif", 91, "              \"physicalLocation\": {"),
            ("startup-entry", "sarif", 92, "                \"artifactLocation\": {"),
            ("startup-entry", "sarif", 93, "                  \"uri\": \"package.json\""),
            ("startup-entry", "sarif", 94, "                },"),
            ("startup-entry", "sarif", 95, "                \"region\": {"),
            ("startup-entry", "sarif", 96, "                  \"startLine\": 1"),
            ("startup-entry", "sarif", 97, "                }"),
            ("startup-entry", "sarif", 98, "              }"),
            ("startup-entry", "sarif", 99, "            }"),
            ("startup-entry", "terminal", 0, "lodestrata 0.1.0"),
            ("startup-entry", "terminal", 1, "Scanning: /src/startup-entry"),
            ("startup-entry", "terminal", 10, "JavaScript writes to an automatic startup location"),
            ("startup-entry", "terminal", 11, "tools/setup.js:3"),
            ("startup-entry", "terminal", 12, "A filesystem write targets a recognized persistence location."),
            ("startup-entry", "terminal", 13, "  trigger: npm preinstall (package.json) at line 1"),
            ("startup-entry", "terminal", 14, "  entry: tools/setup.js"),
            ("startup-entry", "terminal", 15, "  write target: $HOME/.config/autostart/u.desktop"),
            ("startup-entry", "terminal", 16, "Confidence: High  Risk: 85/100"),
            ("startup-entry", "terminal", 17, ""),
            ("startup-entry", "terminal", 18, "MEDIUM  NPM-LIFECYCLE-SCRIPT"),
            ("startup-entry", "terminal", 19, "Package lifecycle script can execute during installation"),
            ("startup-entry", "terminal", 2, "Profile: default"),
            ("startup-entry", "terminal", 20, "package.json:1"),
            ("startup-entry", "terminal", 21, "The npm script 'preinstall' can execute repository-controlled commands."),
            ("startup-entry", "terminal", 22, "  preinstall: node tools/setup.js"),
            ("startup-entry", "terminal", 23, "Confidence: VeryHigh  Risk: 35/100"),
            ("startup-entry", "terminal", 24, ""),
            ("startup-entry", "terminal", 25, "Repository risk: HIGH — 85/100"),
            ("startup-entry", "terminal", 26, "Scan status: COMPLETE"),
            ("startup-entry", "terminal", 27, ""),
            ("startup-entry", "terminal", 28, "No repository code was executed during this scan."),
            ("startup-entry", "terminal", 29, "Network access: disabled"),
            ("startup-entry", "terminal", 3, ""),
            ("startup-entry", "terminal", 30, ""),
            ("startup-entry", "terminal", 4, "Files        2"),
            ("startup-entry", "terminal", 5, "Directories  2"),
            ("startup-entry", "terminal", 6, "Symlinks     0"),
            ("startup-entry", "terminal", 7, "Content      195 bytes"),
            ("startup-entry", "terminal", 8, ""),
            ("startup-entry", "terminal", 9, "HIGH  JS-PERSISTENCE-WRITE"),
        ],
    ),
    "rule_catalogue": (
        "id VARCHAR",
        [
            ("CONFIG-PARSE-FAILED",),
            ("DEVCONTAINER-EXECUTION-HOOK",),
            ("FILE-EXECUTABLE-CONTENT",),
            ("FILE-PARSEABLE-JAVASCRIPT",),
            ("FILE-TYPE-MISMATCH",),
            ("FS-ABSOLUTE-SYMLINK",),
            ("FS-PATH-ESCAPE",),
            ("FS-SPECIAL-FILE",),
            ("FS-SYMLINK-ESCAPE",),
            ("IDE-AUTOMATIC-TASKS",),
            ("IDE-FOLDER-OPEN-DOWNLOAD-EXECUTE",),
            ("IDE-FOLDER-OPEN-TASK",),
            ("IDE-HIDDEN-SECURITY-FILES",),
            ("IDE-PRELAUNCH-TASK",),
            ("JS-COMBINED-ATTACK-CHAIN",),
            ("JS-CONCEALED-EXECUTION",),
            ("JS-DOWNLOAD-WRITE-EXECUTE",),
            ("JS-DYNAMIC-EXECUTION",),
            ("JS-PERSISTENCE-COMMAND",),
            ("JS-PERSISTENCE-WRITE",),
            ("JS-PROCESS-EXECUTION",),
            ("JS-REACHABLE-DISGUISED-SOURCE",),
            ("JS-REMOTE-CODE-EXECUTION",),
            ("JS-REMOTE-PROCESS-EXECUTION",),
            ("JS-SECRET-EXFILTRATION",),
            ("LANG-EXECUTION-ROOT",),
            ("LANG-REMOTE-DATA-EXECUTION-CAPABILITY",),
            ("LANG-REMOTE-DOWNLOAD-EXECUTE",),
            ("NPM-EXECUTION-SCRIPT",),
            ("NPM-LIFECYCLE-SCRIPT",),
            ("RAW-CONTENT-AFTER-EOF",),
            ("RAW-EXTREME-LINE",),
            ("RAW-HIDDEN-AFTER-WHITESPACE",),
            ("YARA-JS-ENCRYPTED-LOADER",),
            ("YARA-POWERSHELL-DOWNLOAD-EXEC",),
        ],
    ),
    "git_diff": (
        "path VARCHAR, id VARCHAR, severity VARCHAR, line BIGINT",
        [
            ("a.sh", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "medium", 2),
            ("d/package.json", "NPM-EXECUTION-SCRIPT", "informational", 1),
            ("d/package.json", "NPM-LIFECYCLE-SCRIPT", "medium", 1),
        ],
    ),
    "git_diff_report": (
        "number BIGINT, line VARCHAR",
        [
            (0, "Git diff 7374dae5168bfa9c5cc2276529c1f73c94d5b6dd..HEAD"),
            (1, "Changed blobs: 3"),
            (2, "+ LANG-REMOTE-DATA-EXECUTION-CAPABILITY  a.sh"),
            (3, "+ NPM-EXECUTION-SCRIPT  d/package.json"),
            (4, "+ NPM-LIFECYCLE-SCRIPT  d/package.json"),
            (5, ""),
        ],
    ),
    "git_history": (
        "file VARCHAR, id VARCHAR, title VARCHAR, commit VARCHAR",
        [
            ("a.sh", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "Historical commit introduced: Remote input and execution capabilities occur in one source file", "commit: afd1c6b019e19a1a41490f736607724a58771f1e"),
            ("d/package.json", "NPM-EXECUTION-SCRIPT", "Historical commit introduced: Package script is an execution root", "commit: b76ad2d97ed5d5f689b612e0906a1d42d97cffca"),
            ("d/package.json", "NPM-LIFECYCLE-SCRIPT", "Historical commit introduced: Package lifecycle script can execute during installation", "commit: afd1c6b019e19a1a41490f736607724a58771f1e"),
            ("gone.py", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", "Historical commit introduced: Remote input and execution capabilities occur in one source file", "commit: 7374dae5168bfa9c5cc2276529c1f73c94d5b6dd"),
            ("same.sh", "LANG-REMOTE-DOWNLOAD-EXECUTE", "Historical commit introduced: Remote content is directly piped or passed to execution", "commit: 7374dae5168bfa9c5cc2276529c1f73c94d5b6dd"),
        ],
    ),
    "graph_rules": (
        "id VARCHAR, file VARCHAR, line BIGINT, severity VARCHAR, evidence VARCHAR",
        [
            ("JS-CONCEALED-EXECUTION", "src/a.js", 3, "high", "trigger: npm start (package.json) at line 3 | entry: src/a.js | concealment: possible XOR string decoder | concealment: long timer delay | capability: eval"),
            ("JS-DYNAMIC-EXECUTION", "lone.js", 2, "medium", "call: eval"),
            ("JS-DYNAMIC-EXECUTION", "src/a.js", 3, "medium", "trigger: npm start (package.json) at line 3 | entry: src/a.js | call: eval"),
            ("JS-DYNAMIC-EXECUTION", "src/a.js", 9, "medium", "call: eval"),
            ("JS-PROCESS-EXECUTION", "icon.png", 2, "medium", "trigger: npm start (package.json) at line 3 | entry: src/a.js | src/a.js:1 imports src/lib/b.ts | src/lib/b.ts:1 imports page.html | page.html:9 imports icon.png | call: child_process.exec"),
            ("JS-REACHABLE-DISGUISED-SOURCE", "icon.png", 2, "critical", "trigger: npm start (package.json) at line 3 | entry: src/a.js | src/a.js:1 imports src/lib/b.ts | src/lib/b.ts:1 imports page.html | page.html:9 imports icon.png | capability: child_process.exec at line 2"),
        ],
    ),
    "repository_scan": (
        "repo_id VARCHAR, id VARCHAR, severity VARCHAR, score BIGINT, file VARCHAR, line BIGINT, first_evidence VARCHAR",
        [
            ("eval", "JS-DYNAMIC-EXECUTION", "medium", 45, "src/index.js", 4, "trigger: npm start (package.json) at line 1"),
            ("eval", "JS-REMOTE-CODE-EXECUTION", "critical", 98, "src/index.js", 4, "trigger: npm start (package.json) at line 1"),
            ("eval", "NPM-EXECUTION-SCRIPT", "informational", 10, "package.json", 1, "start: node src/index.js"),
            ("secret", "JS-SECRET-EXFILTRATION", "critical", 97, "scripts/collect.js", 2, "trigger: npm postinstall (package.json) at line 1"),
            ("secret", "NPM-LIFECYCLE-SCRIPT", "medium", 35, "package.json", 1, "postinstall: node scripts/collect.js"),
            ("tasks", "FILE-PARSEABLE-JAVASCRIPT", "medium", 45, "fonts/icon.woff2", None, "extension: .woff2"),
            ("tasks", "FILE-TYPE-MISMATCH", "medium", 45, "fonts/icon.woff2", None, "extension: .woff2"),
            ("tasks", "IDE-FOLDER-OPEN-TASK", "high", 85, ".vscode/tasks.json", 1, "task: a"),
            ("tasks", "JS-PROCESS-EXECUTION", "medium", 45, "fonts/icon.woff2", 2, "call: cp.exec(t)"),
            ("tasks", "JS-REACHABLE-DISGUISED-SOURCE", "critical", 95, "fonts/icon.woff2", 2, "trigger: VS Code folderOpen task at line 1"),
            ("tasks", "JS-REMOTE-PROCESS-EXECUTION", "critical", 97, "fonts/icon.woff2", 2, "trigger: VS Code folderOpen task at line 1"),
        ],
    ),
}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def _select(columns: str, rows: list[tuple]) -> str:
    names, kinds = zip(*(c.split(" ") for c in columns.split(", ")), strict=True)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f"CAST({n} AS {k}) AS {n}" for n, k in zip(names, kinds, strict=True)) + f" FROM (VALUES {values}) AS t({', '.join(names)})"


#: The same as SQL.
CASE_SQL = {name: _select(columns, rows) for name, (columns, rows) in EXPECTED.items()}
