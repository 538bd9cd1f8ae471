"""DuckDB SQL for the registered queries, written independently of the operators."""

from __future__ import annotations

from . import given_tables

_FINDINGS = """
f AS (
  SELECT source AS repo_id, lang || '/' || CAST(doc_id % 50 AS VARCHAR) AS file, id, severity, score, doc_id * 10 + row_number() OVER (PARTITION BY doc_id ORDER BY rule) - 1 AS emit_seq,
    list_position(['informational', 'low', 'medium', 'high', 'critical'], severity) AS rank, doc_id
  FROM (
    SELECT *, 1 AS rule, 'LONG-TEXT' AS id, 'medium' AS severity, 40 AS score FROM documents WHERE length(text) > 5000
    UNION ALL SELECT *, 2, 'SYMBOLS', 'high', 75 FROM documents WHERE contains(text, '###')
    UNION ALL SELECT *, 3, 'SHORT-TEXT', 'low', 10 FROM documents WHERE length(text) < 400
    UNION ALL SELECT *, 4, 'PIPES', 'critical', 97 FROM documents WHERE contains(text, ' | ')))
"""
_ENTROPY = """
hexed AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
counted AS (SELECT doc_id, b, count(*) AS n FROM hexed GROUP BY ALL),
entropies AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM counted) GROUP BY doc_id)
"""
_LINES = "list_max(list_transform(string_split(text, chr(10)), lambda x: octet_length(encode(x))))"


def _runs(text: str, pattern: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({text}, '{pattern}'), lambda x: octet_length(encode(x)))), 0)"


def _count(needle: str) -> str:
    return f"CAST((length(text) - length(replace(text, '{needle}', ''))) / {len(needle)} AS BIGINT)"


def _any(*needles: str) -> str:
    return "(" + " OR ".join(f"contains(text, '{n.replace(chr(39), chr(39) * 2)}')" for n in needles) + ")"


_IPV4 = "len(list_filter(regexp_split_to_array(text, '[^0-9.]'), lambda x: regexp_full_match(x, '(0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})[.]){3}0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})')))"
_WALLET = "len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9]'), lambda x: regexp_full_match(x, '[0-9a-fA-F]{40}')))"
_GAP = r"regexp_extract(text, '(?:^|[^ \t])([ \t]{512,1000})(?:[^ \t\n\r]|\r[^\n])', 1)"

_SIGNAL_LIST = f"""[
  CASE WHEN {_LINES} >= 10000 THEN 'extreme line length: ' || CAST({_LINES} AS VARCHAR) || ' bytes' END,
  CASE WHEN regexp_matches(text, '(?s)^[^\\x1A]*\\x1A.*[^\\s\\x00-\\x1F]') THEN 'content follows an apparent logical EOF marker' END,
  CASE WHEN length({_GAP}) > 0 THEN 'code follows ' || CAST(length({_GAP}) AS VARCHAR) || ' horizontal whitespace bytes' END,
  CASE WHEN length({_GAP}) = 0 AND {_runs('text', '[ \\t]+')} >= 512 THEN 'extreme horizontal whitespace: ' || CAST({_runs('text', '[ \\t]+')} AS VARCHAR) || ' bytes' END,
  CASE WHEN {_runs('text', '[A-Za-z0-9+/=]+')} >= 512 THEN 'large base64-like sequence: ' || CAST({_runs('text', '[A-Za-z0-9+/=]+')} AS VARCHAR) || ' bytes' END,
  CASE WHEN {_runs('text', '[0-9A-Fa-f]+')} >= 512 THEN 'large hexadecimal sequence: ' || CAST({_runs('text', '[0-9A-Fa-f]+')} AS VARCHAR) || ' bytes' END,
  CASE WHEN {_count(chr(92) + 'u')} >= 32 THEN 'unicode escape sequences: ' || CAST({_count(chr(92) + 'u')} AS VARCHAR) END,
  CASE WHEN {_any('String.fromCharCode', "String['fromCharCode']")} THEN 'character-code string construction' END,
  CASE WHEN contains(text, 'charCodeAt') AND contains(text, '^') THEN 'possible XOR string decoder' END,
  CASE WHEN {_count('_0x')} >= 8 THEN '_0x-style identifiers: ' || CAST({_count('_0x')} AS VARCHAR) END,
  CASE WHEN {_any('debugger;', 'navigator.webdriver')} THEN 'anti-debugging or automation check' END,
  CASE WHEN {_any('VirtualBox', 'VMware', 'QEMU', 'Parallels')} THEN 'virtual-machine environment check' END,
  CASE WHEN {_any('navigator.language', 'process.env.LANG', 'Intl.DateTimeFormat')} THEN 'locale or regional environment check' END,
  CASE WHEN {_any('tasklist', 'Get-Process', 'ps aux', '/proc/')} AND {_any('Wireshark', 'ProcessHacker', 'x64dbg', 'OllyDbg', 'Procmon')} THEN 'security-tool process enumeration check' END,
  CASE WHEN {_any('setTimeout', 'setInterval')} AND len(list_filter(flatten(list_transform(regexp_extract_all(text, '(?s)(?:setTimeout|setInterval)(.{{0,128}})', 1), lambda w: regexp_extract_all(w, '[0-9]+'))), lambda d: length(d) >= 4 AND TRY_CAST(d AS UBIGINT) >= 5000)) > 0 THEN 'long timer delay' END,
  CASE WHEN {_any('Invoke-WebRequest', 'Invoke-Expression')} THEN 'PowerShell download or execution primitive' END,
  CASE WHEN {_count('http://')} + {_count('https://')} > 0 THEN 'URL occurrences: ' || CAST({_count('http://')} + {_count('https://')} AS VARCHAR) END,
  CASE WHEN {_IPV4} > 0 THEN 'IPv4 address occurrences: ' || CAST({_IPV4} AS VARCHAR) END,
  CASE WHEN {_WALLET} > 0 THEN 'wallet-like identifiers: ' || CAST({_WALLET} AS VARCHAR) END,
  CASE WHEN {_any('discord.com/api/webhooks', 'hooks.slack.com')} THEN 'webhook endpoint' END,
  CASE WHEN {_any('bit.ly/', 'tinyurl.com/', 't.co/')} THEN 'shortened URL' END,
  CASE WHEN octet_length(encode(text)) >= 2048 AND e >= 5.5 THEN 'high-entropy text: ' || printf('%.2f', e) || ' bits per byte' END]"""
_SIGNALS = f"{_ENTROPY}, s AS (SELECT doc_id, source, octet_length(encode(text)) AS size, list_filter({_SIGNAL_LIST}, lambda x: x IS NOT NULL) AS signals, {_LINES} AS longest, length({_GAP}) AS gap, text FROM documents LEFT JOIN entropies USING (doc_id))"

ORACLE_SQL = {
    **given_tables.ORACLE_SQL,
    "byte_entropies": f"WITH {_ENTROPY} SELECT doc_id, round(coalesce(e, 0), 6) AS entropy FROM documents LEFT JOIN entropies USING (doc_id)",
    "line_metrics": f"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS line_count, CAST({_LINES} AS BIGINT) AS max_line_length FROM documents",
    "longest_runs": f"SELECT doc_id, CAST({_runs('text', '[0-9A-Fa-f]+')} AS BIGINT) AS hex_run, CAST({_runs('text', '[A-Za-z0-9+/=]+')} AS BIGINT) AS base64_run, CAST({_runs('text', '[ \\t]+')} AS BIGINT) AS blank_run FROM documents",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sql_functions": f"WITH {_ENTROPY} SELECT doc_id, round(coalesce(e, 0), 6) AS entropy, CAST({_runs('text', '[0-9A-Fa-f]+')} AS BIGINT) AS hex_run, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN right(text, 1) = chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents LEFT JOIN entropies USING (doc_id)",
    "duplicate_content": "SELECT sha256(text) AS sha256, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1",
    "address_tokens": f"SELECT doc_id, CAST({_IPV4} AS BIGINT) AS ipv4, CAST({_WALLET} AS BIGINT) AS wallets FROM documents",
    "raw_signal_rows": f"WITH {_SIGNALS} SELECT doc_id, CAST(generate_subscripts(signals, 1) - 1 AS BIGINT) AS position, unnest(signals) AS signal FROM s",
    "raw_signal_counts": f"WITH {_SIGNALS} SELECT regexp_replace(signal, '[: ]*[0-9][0-9.]*.*$', '') AS signal, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(signals) AS signal FROM s) GROUP BY 1",
    "concealment_risk": f"""WITH {_SIGNALS},
        x AS (SELECT *, (longest >= 10000)::INT AS a, (gap > 0)::INT AS b, (len(list_filter(signals, lambda y: y LIKE 'content follows%')) > 0)::INT AS c,
          ((contains(text, 'require('))::INT + contains(text, 'module.exports')::INT + contains(text, 'child_process')::INT + contains(text, 'process.env')::INT + contains(text, 'eval(')::INT + contains(text, 'new Function')::INT
           + contains(text, 'function ')::INT + contains(text, 'const ')::INT + contains(text, 'import ')::INT + contains(text, 'Invoke-Expression')::INT + contains(text, '#!/bin/')::INT >= 2)::INT AS d FROM s)
        SELECT source AS repo_id, CAST(count(*) AS BIGINT) AS files, CAST(sum(size) AS BIGINT) AS content_bytes, CAST(sum(len(signals)) AS BIGINT) AS signals, CAST(sum(a + b + c + d) AS BIGINT) AS findings,
          CAST(max(greatest(a * 40, b * 75, c * 75, d * 45)) AS BIGINT) AS score FROM x GROUP BY source""",
    "risk_rollup": f"WITH {_FINDINGS} SELECT repo_id, ['informational', 'low', 'medium', 'high', 'critical'][max(rank)] AS severity, max(score) AS score FROM f GROUP BY repo_id",
    "severity_threshold": f"WITH {_FINDINGS} SELECT repo_id, severity, CAST(count(*) AS BIGINT) AS n FROM f WHERE rank >= 4 GROUP BY ALL",
    "summary_counts": f"""WITH {_FINDINGS}, g AS (SELECT repo_id, count(*) AS n, max(rank) AS rank, max(score) AS score FROM f GROUP BY repo_id)
        SELECT source AS repo_id, CASE WHEN max(octet_length(encode(text))) > 40000 THEN 'incomplete' ELSE 'complete' END AS status, ['informational', 'low', 'medium', 'high', 'critical'][coalesce(any_value(rank), 1)] AS severity,
          CAST(coalesce(any_value(score), 0) AS BIGINT) AS score, CAST(count(*) AS BIGINT) AS entries, CAST(count(*) AS BIGINT) AS files, CAST(0 AS BIGINT) AS symlinks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS content_bytes, CAST(coalesce(any_value(n), 0) AS BIGINT) AS findings
        FROM documents LEFT JOIN g ON g.repo_id = source GROUP BY source""",
    "finding_cap": f"WITH {_FINDINGS} SELECT repo_id, id, emit_seq FROM f QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY emit_seq) <= 7",
    "first_finding_per_key": f"WITH {_FINDINGS} SELECT repo_id, id, file, min(emit_seq) AS emit_seq FROM f GROUP BY ALL",
    "finding_order": f"WITH {_FINDINGS} SELECT repo_id, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY rank DESC, file NULLS FIRST, id, emit_seq) AS BIGINT) AS place, severity, file, id, emit_seq FROM f",
    "union_findings": f"WITH {_FINDINGS} SELECT CAST(5 - rank AS INTEGER) AS part, repo_id, id, CAST(count(*) AS BIGINT) AS n, min(emit_seq) AS first_seq FROM f WHERE rank >= 3 GROUP BY ALL",
    "new_findings": f"WITH {_FINDINGS}, p AS (SELECT repo_id, file, id FROM f WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT repo_id, file, id, emit_seq FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.repo_id = f.repo_id AND p.file = f.file AND p.id = f.id)",
    "tree_diff": "SELECT o_orderkey AS path, o_orderstatus AS blob FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0",
    "script_blocks": "SELECT page_id, CAST(generate_subscripts(b, 1) - 1 AS BIGINT) AS number, unnest(b) AS body FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script(?:\\s[^>]*)?>(.*?)</script>', 1) AS b FROM pages)",
    "combined_chains": """WITH f AS (SELECT source AS repo_id, doc_id, lang || '.js' AS file, lang, CASE doc_id % 3 WHEN 0 THEN 'JS-REMOTE-CODE-EXECUTION' WHEN 1 THEN 'JS-SECRET-EXFILTRATION' ELSE 'JS-PERSISTENCE-WRITE' END AS id FROM documents WHERE doc_id % 5 != 0),
        s AS (SELECT repo_id, lang, min(doc_id) AS line FROM f WHERE id = 'JS-SECRET-EXFILTRATION' GROUP BY ALL)
        SELECT f.repo_id, f.file, f.doc_id AS line, 'component: JS-REMOTE-CODE-EXECUTION at ' || f.file || ':' || CAST(f.doc_id AS VARCHAR) AS execution, 'component: JS-SECRET-EXFILTRATION at ' || f.file || ':' || CAST(s.line AS VARCHAR) AS exfiltration
        FROM f JOIN s USING (repo_id, lang) WHERE id = 'JS-REMOTE-CODE-EXECUTION'""",
    "page_modules": "SELECT page_id, CAST((length(html) - length(replace(html, '<script', ''))) / 7 AS BIGINT) AS modules, CAST((length(html) - length(replace(html, 'track(', ''))) / 6 AS BIGINT) AS calls, CAST(0 AS BIGINT) AS unread FROM pages",
    "archive_members": "SELECT CAST(page_id AS VARCHAR) AS repo_id, CAST(page_id AS VARCHAR) || '.html.gz!/' || CAST(page_id AS VARCHAR) || '.html' AS path, sha256(html) AS sha256, CAST(NULL AS VARCHAR) AS reason FROM pages",
}
