"""Reports of one repository, from the nested row that ScanResult.report_rows gives."""

from __future__ import annotations

import json
from typing import Any

from ..schemas import SEVERITIES

NAME, VERSION, SCHEMA_VERSION = "lodestrata", "0.1.0", 2
# Levels, schema address.
SARIF_LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "none"}
SARIF_SCHEMA = "https://docs.oasis-open.org/sarif/sarif/v2.1.0/errata01/os/schemas/sarif-schema-2.1.0.json"
URI_SAFE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789/-_.~")
CLEAN = f"No significant malicious indicators were identified by this version of {NAME}."
CLOSING = "No repository code was executed during this scan."

Report = dict[str, Any]


def report_of(row: Report, target: str, profile: str = "default") -> Report:
    """The report document of a row of report_rows, in the order of its schema."""
    return {
        "schema_version": SCHEMA_VERSION, "scanner": NAME, "scanner_version": VERSION, "target": target, "profile": profile, "status": row["status"], "network_access": "disabled",
        "risk": dict(row["risk"]), "summary": dict(row["summary"]), "files": list(row["files"]), "findings": list(row["findings"]),
        "unresolved_edges": list(row["unresolved_edges"]), "incomplete_reasons": list(row["incomplete_reasons"]),
    }


def escaped_controls(text: str) -> str:
    """Control characters as \\n, \\t, \\r or \\u{..}, so that a report can't steer a terminal."""
    short = {"\n": "\\n", "\t": "\\t", "\r": "\\r"}
    return "".join(short.get(c, f"\\u{{{ord(c):x}}}") if ord(c) < 32 or 127 <= ord(c) < 160 else c for c in text)


def escaped_markdown(text: str) -> str:
    marks = {"\\": "\\\\", "`": "\\`", "|": "\\|", "<": "&lt;", ">": "&gt;"}
    return "".join(marks[c] if c in marks else escaped_controls(c) for c in text)


def encoded_uri(path: str) -> str:
    return "".join(chr(b) if b in URI_SAFE else f"%{b:02X}" for b in path.replace("\\", "/").encode())


def spelled(confidence: str) -> str:
    """very_high as VeryHigh."""
    return "".join(w.capitalize() for w in confidence.split("_"))


def location(finding: Report) -> str | None:
    return finding["file"] if finding["file"] is None or finding["line"] is None else f"{finding['file']}:{finding['line']}"


def to_json(report: Report) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def to_terminal(report: Report) -> str:
    summary, safe = report["summary"], escaped_controls
    lines = [f"{NAME} {report['scanner_version']}", f"Scanning: {safe(report['target'])}", f"Profile: {safe(report['profile'])}", ""]
    lines += [f"Files        {summary['files']}", f"Directories  {summary['directories']}", f"Symlinks     {summary['symlinks']}", f"Content      {summary['content_bytes']} bytes"]
    for f in report["findings"]:
        lines += ["", f"{f['severity'].upper()}  {safe(f['id'])}", safe(f["title"]), *([safe(location(f))] if location(f) else []), safe(f["message"])]
        lines += [*(f"  {safe(e)}" for e in f["evidence"]), f"Confidence: {spelled(f['confidence'])}  Risk: {f['score']}/100"]
    lines += ["", f"Repository risk: {report['risk']['severity'].upper()} — {report['risk']['score']}/100", f"Scan status: {report['status'].upper()}"]
    if report["status"] == "incomplete":
        lines += ["", "SCAN INCOMPLETE", *(f"  - {safe(r)}" for r in report["incomplete_reasons"])]
    elif not report["findings"]:
        lines += ["", CLEAN]
    if report["unresolved_edges"]:
        lines += ["", "Unresolved execution edges:", *(f"  - {safe(e)}" for e in report["unresolved_edges"])]
    return "\n".join([*lines, "", CLOSING, f"Network access: {report['network_access']}"]) + "\n"


def to_markdown(report: Report) -> str:
    safe = escaped_markdown
    head = {
        "Target": f"`{safe(report['target'])}`", "Profile": safe(report["profile"]), "Status": report["status"].upper(), "Files": report["summary"]["files"],
        "Risk": f"{report['risk']['severity'].upper()} ({report['risk']['score']}/100)", "Network": safe(report["network_access"]),
    }
    out = f"<!-- {NAME} Markdown v2 -->\n\n# {NAME} {safe(report['scanner_version'])}\n\n" + "".join(f"- **{k}:** {v}\n" for k, v in head.items()) + "\n"
    if not report["findings"] and report["status"] == "complete":
        out += CLEAN + "\n"
    for f in report["findings"]:
        out += f"## {f['severity'].upper()} — {safe(f['title'])}\n\n{safe(f['message'])}\n\n"
        if location(f):
            out += f"**Location:** `{safe(location(f))}`\n\n"
        out += f"**Rule:** `{safe(f['id'])}`  \n**Confidence:** {spelled(f['confidence'])}  \n**Risk:** {f['score']}/100\n"
        out += "".join(f"\n- `{safe(e)}`" for e in f["evidence"]) + "\n\n"
    if report["status"] == "incomplete":
        out += "## Scan incomplete\n\n" + "".join(f"- {safe(r)}\n" for r in report["incomplete_reasons"]) + "\n"
    return out + CLOSING + "\n"


def sarif_result(f: Report, index: int) -> Report:
    out: Report = {"ruleId": f["id"], "ruleIndex": index, "level": SARIF_LEVELS[f["severity"]], "message": {"text": f["message"]}, "properties": {"confidence": spelled(f["confidence"]).lower(), "riskScore": f["score"]}}
    if f["file"] is not None:
        place: Report = {"artifactLocation": {"uri": encoded_uri(f["file"])}}
        if f["line"] is not None:
            place["region"] = {"startLine": f["line"]}
        out["locations"] = [{"physicalLocation": place}]
    if f["evidence"]:
        out["relatedLocations"] = [{"id": i, "message": {"text": e}} for i, e in enumerate(f["evidence"], 1)]
    return out


def to_sarif(report: Report) -> str:
    first = {}
    for f in report["findings"]:
        first.setdefault(f["id"], f)
    ids = sorted(first)
    rules = [{"id": i, "name": i, "shortDescription": {"text": first[i]["title"]}, "defaultConfiguration": {"level": SARIF_LEVELS[first[i]["severity"]]}} for i in ids]
    run = {
        "tool": {"driver": {"name": NAME, "version": report["scanner_version"], "rules": rules}},
        "results": [sarif_result(f, ids.index(f["id"])) for f in report["findings"]],
        "properties": {"scanStatus": report["status"], "networkAccess": report["network_access"], "scanProfile": report["profile"]},
    }
    return json.dumps({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [run]}, indent=2, ensure_ascii=False) + "\n"


RENDERERS = {"terminal": to_terminal, "json": to_json, "markdown": to_markdown, "sarif": to_sarif}


def exit_code(report: Report, threshold: str = "high") -> int:
    """2 for incomplete coverage, 1 for a finding of at least the threshold, else 0."""
    if report["status"] == "incomplete":
        return 2
    least = SEVERITIES.index("informational" if threshold == "info" else threshold)
    return int(any(SEVERITIES.index(f["severity"]) >= least for f in report["findings"]))
