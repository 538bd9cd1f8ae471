"""DuckDB SQL for the queries of inline.py."""

from __future__ import annotations

from . import corpora as C

_SUFFIX = "CASE WHEN regexp_matches(regexp_extract(path, '[^/]*$'), '^.+[.][^.]*$') THEN lower(regexp_extract(path, '[.]([^./]*)$', 1)) END"
_NAME = "regexp_extract(path, '[^/]*$')"
_FILES = C.values_sql(C.FILES, "id, path, text")


_GRAPH = f"""
m AS (SELECT * FROM {C.values_sql(C.MODULES, 'seq, id, path')}),
i AS (SELECT * FROM {C.values_sql(C.IMPORTS, 'module_id, seq, specifier, line')}),
r AS (SELECT * FROM {C.values_sql(C.ROOTS, 'seq, file, trigger, line')}),
c AS (SELECT * FROM {C.values_sql(C.CALLS, 'module_id, seq, name, line, capability, function')}),
rel AS (SELECT i.*, m.path AS source, list_filter(string_split(regexp_replace(m.path, '[^/]*$', '') || specifier, '/'), lambda x: x NOT IN ('', '.')) AS parts FROM i JOIN m ON m.id = i.module_id WHERE specifier LIKE '.%'),
walk AS (
  SELECT module_id, seq, source, specifier, line, parts, 1 AS n, CAST([] AS VARCHAR[]) AS done, true AS ok FROM rel
  UNION ALL
  SELECT module_id, seq, source, specifier, line, parts, n + 1, CASE WHEN parts[n] = '..' THEN done[1:len(done) - 1] ELSE list_append(done, parts[n]) END, ok AND NOT (parts[n] = '..' AND len(done) = 0) FROM walk WHERE n <= len(parts)),
base AS (SELECT * , array_to_string(done, '/') AS b FROM walk WHERE n = len(parts) + 1),
tried AS (SELECT base.*, k, b || ['', '.js', '.cjs', '.mjs', '.ts', '.cts', '.mts', '.jsx', '.tsx', '/index.js', '/index.ts'][k] AS cand FROM base, range(1, 12) AS g(k) WHERE ok AND b != ''),
hit AS (SELECT module_id, seq, arg_min(cand, k) AS target FROM tried JOIN (SELECT DISTINCT path FROM m) p ON p.path = cand GROUP BY ALL),
res AS (SELECT rel.module_id, rel.seq, rel.source, rel.specifier, rel.line, target FROM rel LEFT JOIN hit USING (module_id, seq)),
e AS (SELECT DISTINCT module_id AS src, m.id AS dst FROM res JOIN m ON m.path = target)
"""


ORACLE_SQL = {
    "extension_roles": f"""SELECT CAST(id AS BIGINT) AS id, {_SUFFIX} AS extension, array_to_string(list_filter([
        CASE WHEN {_NAME} = 'package.json' THEN 'npm_manifest' END,
        CASE WHEN {_NAME} IN ('package-lock.json', 'npm-shrinkwrap.json', 'yarn.lock', 'pnpm-lock.yaml') THEN 'dependency_lockfile' END,
        CASE WHEN path LIKE '.vscode/%' OR path = '.devcontainer/devcontainer.json' THEN 'developer_tool_config' END,
        CASE WHEN regexp_matches({_NAME}, '^(vite|webpack|tailwind|postcss|eslint|next|babel|jest|rollup)[.]config[.]') THEN 'executable_config' END,
        CASE WHEN path LIKE '.github/workflows/%' OR {_NAME} IN ('.gitlab-ci.yml', 'Jenkinsfile') THEN 'ci_config' END,
        CASE WHEN {_NAME} IN ('Makefile', 'Dockerfile', 'justfile', 'Taskfile', 'Taskfile.yml') OR {_NAME} LIKE 'docker-compose%' THEN 'build_script' END], lambda x: x IS NOT NULL), ',') AS roles,
        CASE WHEN {_NAME} = 'setup.py' OR path LIKE '%.py' THEN 'python' WHEN path LIKE '%.sh' THEN 'shell' WHEN path LIKE '%.ps1' THEN 'powershell' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.csproj' THEN 'dotnet' WHEN path LIKE '%.rb' THEN 'ruby' END AS language
        FROM {_FILES}""",
    "type_mismatch": f"SELECT CAST(id AS BIGINT) AS id, 'medium' AS severity, CAST(45 AS BIGINT) AS score, 'extension: .' || {_SUFFIX} AS evidence FROM {_FILES} WHERE {_SUFFIX} IN ('png', 'woff2', 'gz') OR ({_SUFFIX} = 'svg' AND NOT (ltrim(text) LIKE '<svg%' OR ltrim(text) LIKE '<?xml%'))",
    "executable_text": f"SELECT CAST(id AS BIGINT) AS id, k AS markers, k >= 2 AND coalesce({_SUFFIX}, '') IN ('svg', 'woff', 'woff2', 'png', 'jpg', 'jpeg', 'gif', 'webp', 'json', 'data', 'txt', 'md', 'lock') AS flagged FROM (SELECT *, CAST(len(list_filter(['require(', 'module.exports', 'child_process', 'process.env', 'eval(', 'new Function', 'function ', 'const ', 'import ', 'Invoke-Expression', '#!/bin/'], lambda x: contains(text, x))) AS BIGINT) AS k FROM {_FILES})",
    "language_capability": f"""SELECT CAST(id AS BIGINT) AS id, language, array_to_string(list_filter(src, lambda x: contains(lower(text), x)), ',') AS sources, array_to_string(list_filter(snk, lambda x: contains(lower(text), x)), ',') AS sinks
        FROM {_FILES} JOIN (VALUES
          ('shell', '(^|/)[^/]*[.]sh$', ['curl', 'wget', 'invoke-webrequest', 'downloadstring'], ['| sh', '| bash', 'invoke-expression', 'bash -c', 'sh -c']),
          ('python', '[.]py$', ['requests.get', 'urllib.request', 'urlopen(', 'httpx.get'], ['exec(', 'eval(', 'subprocess.', 'os.system(']),
          ('powershell', '[.]ps1$', ['invoke-webrequest', 'downloadstring', 'start-bitstransfer'], ['invoke-expression', 'iex ', 'start-process', 'scriptblock::create']),
          ('go', '[.]go$', ['http.get(', 'http.newrequest', 'client.do(', 'net.dial('], ['exec.command(', 'commandcontext(', '.start(', '.run(']),
          ('dotnet', '[.]csproj$', ['httpclient', 'webclient', 'downloadstring(', 'downloadfile('], ['process.start(', 'powershell', 'assembly.load(']),
          ('ruby', '[.]rb$', ['net::http', 'open-uri', 'http.get('], ['kernel.system', 'system(', 'exec(', 'open3.capture'])) AS l(language, pattern, src, snk) ON regexp_matches(path, pattern)""",
    "signature_rules": f"SELECT CAST(id AS BIGINT) AS id, rule FROM {_FILES} JOIN (VALUES ('YARA-JS-ENCRYPTED-LOADER', 'createdecipheriv', 'aes-256-cbc', 'new\\s+function'), ('YARA-POWERSHELL-DOWNLOAD-EXEC', 'downloadstring', 'frombase64string', 'invoke-expression')) AS y(rule, p, q, s) ON regexp_matches(text, '(?i)' || p) AND regexp_matches(text, '(?i)' || q) AND regexp_matches(text, '(?i)' || s)",
    "manifest_scripts": f"SELECT f.path, key AS name, json_extract_string(value, '$') AS command, CASE WHEN key IN ('preinstall', 'install', 'postinstall', 'prepare') THEN 'NPM-LIFECYCLE-SCRIPT' ELSE 'NPM-EXECUTION-SCRIPT' END AS rule FROM (SELECT * FROM {_FILES} WHERE path = 'package.json') f, json_each(text, '$.scripts') WHERE key IN ('preinstall', 'install', 'postinstall', 'prepare', 'start', 'dev', 'build', 'test') OR key LIKE 'pre%' OR key LIKE 'post%'",
    "import_resolution": f"WITH RECURSIVE {_GRAPH} SELECT module_id, CAST(seq AS BIGINT) AS seq, specifier, target FROM res",
    "unresolved_imports": f"""WITH RECURSIVE {_GRAPH} SELECT DISTINCT path || ':' || CAST(line AS VARCHAR) || ' -> ' || specifier || CASE WHEN specifier LIKE '<dynamic %' THEN ' (dynamic module target unresolved)' ELSE ' (external package not inspected)' END AS edge
        FROM i JOIN m ON m.id = i.module_id WHERE specifier NOT LIKE '.%' AND specifier NOT LIKE 'node:%' AND specifier NOT IN ('fs', 'os', 'path', 'http', 'https', 'vm', 'child_process', 'crypto', 'net', 'tls')
        UNION SELECT source || ':' || CAST(line AS VARCHAR) || ' -> ' || specifier || ' (relative import unresolved)' FROM res WHERE target IS NULL""",
    "reachability": f"WITH RECURSIVE {_GRAPH}, w AS (SELECT m.id, 0 AS depth FROM m JOIN r ON r.file = m.id UNION SELECT e.dst, depth + 1 FROM w JOIN e ON e.src = w.id WHERE depth < 20) SELECT id, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY id",
    "call_closure": f"WITH RECURSIVE {_GRAPH}, n AS (SELECT module_id, function AS caller, substr(name, 7) AS function FROM c WHERE name LIKE 'local:%'), w AS (SELECT module_id, function FROM n WHERE caller IS NULL UNION SELECT n.module_id, n.function FROM n JOIN w ON w.module_id = n.module_id AND w.function = n.caller) SELECT DISTINCT module_id, function FROM w",
    "configuration_findings": f"""SELECT repo_id, manifest AS path, CASE key WHEN 'postinstall' THEN 'NPM-LIFECYCLE-SCRIPT' ELSE 'NPM-EXECUTION-SCRIPT' END AS id, CASE key WHEN 'postinstall' THEN 'medium' ELSE 'informational' END AS severity,
        CAST(CASE key WHEN 'postinstall' THEN 35 ELSE 10 END AS BIGINT) AS score, CAST(1 AS BIGINT) AS line, key || ': ' || json_extract_string(value, '$') AS evidence
        FROM (SELECT repo_id, path AS manifest, text FROM {C.values_sql(C.REPOSITORIES, 'repo_id, path, text')} WHERE path = 'package.json') m, json_each(text, '$.scripts')
        UNION ALL SELECT repo_id, path, 'IDE-FOLDER-OPEN-TASK', 'high', 85, 1, 'task: ' || regexp_extract(text, '"label": "([^"]*)"', 1) || ' | runOn: folderOpen | command: ' || regexp_extract(text, '"command": "([^"]*)"', 1)
        FROM {C.values_sql(C.REPOSITORIES, 'repo_id, path, text')} WHERE path = '.vscode/tasks.json'""",
}
