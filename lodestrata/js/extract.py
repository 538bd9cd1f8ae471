"""Scripts inside documents: HTML, XHTML, Vue, SVG and Markdown."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import regex

from ..limits import DEFAULT, ScanLimits

# Script types that are JavaScript, and document kinds by extension: (HTML, Markdown).
SCRIPT_TYPES = {
    "module", "text/javascript", "application/javascript", "application/x-javascript", "application/ecmascript", "application/x-ecmascript", "text/ecmascript",
    "text/babel", "text/jsx", *(f"text/javascript1.{n}" for n in range(6)),
}
DOCUMENT_KINDS = {"html": (True, False), "htm": (True, False), "xhtml": (True, False), "vue": (False, False), "svg": (False, False), "md": (False, True), "mdx": (False, True)}

_OPEN = regex.compile(r"<script", regex.I | regex.A)
_CLOSE = regex.compile(r"</script(?=[ \t\n\r\f>/]|\Z)", regex.I | regex.A)
_TAG_REST = regex.compile(r"""(?:[^>'"]|'[^']*'|"[^"]*")*+>""")
_ATTRIBUTE = regex.compile(r"""([^ \t\n\r\f=]+)[ \t\n\r\f]*(?:=[ \t\n\r\f]*(?:'([^']*)'?|"([^"]*)"?|([^ \t\n\r\f>'"][^ \t\n\r\f>]*|)))?""")
_FENCE = regex.compile(r"[ \t]{0,3}(`{3,}|~{3,})([^\n]*)")
_INLINE = regex.compile(r"(?<blank>\r?\n[ \t]*(?=[\r\n]))|(?<ticks>`+)")


@dataclass
class ScriptBlock:
    source: str
    typescript: bool
    jsx: bool
    line_offset: int
    external: str | None


def attribute(attributes: str, name: str) -> str | None:
    """The first value of an attribute; None without it or without a value."""
    for m in _ATTRIBUTE.finditer(attributes):
        value = next((g for g in m.groups()[1:] if g is not None), None)
        if value is not None and m[1].lower() == name:
            return value
    return None


def script_language(attributes: str) -> tuple[bool, bool] | None:
    """(TypeScript, JSX) of a script tag, None for scripts that are data or another language."""
    kind = (attribute(attributes, "type") or "").split(";")[0].strip().lower()
    lang = (attribute(attributes, "lang") or "").lower()
    typescript = "typescript" in kind or "text/tsx" in kind or lang in ("ts", "typescript", "tsx")
    if kind and not typescript and kind not in SCRIPT_TYPES:
        return None
    if typescript:
        return True, "tsx" in kind or lang == "tsx"
    return False, kind in ("text/babel", "text/jsx") or lang == "jsx"


def fenced_ranges(text: str, reasons: list[str], limit: int) -> list[tuple[int, int]]:
    """Fenced code of Markdown; a fence is closed by a run of its own character that is at least as long."""
    ranges: list[tuple[int, int]] = []
    opened: tuple[str, int, int] | None = None
    at = 0

    def add(start: int, end: int) -> bool:
        if len(ranges) == limit:
            reasons.append(f"Markdown fence limit of {limit} reached")
            if ranges:
                ranges[-1] = (ranges[-1][0], len(text))
            return False
        ranges.append((start, end))
        return True

    for line in text.splitlines(keepends=True) if "\r" not in text and "\x0b" not in text else regex.findall(r"[^\n]*\n|[^\n]+", text):
        m = _FENCE.match(line)
        if m:
            mark, size = m[1][0], len(m[1])
            if opened is None:
                opened = (mark, size, at)
            elif mark == opened[0] and size >= opened[1] and not m[2].strip():
                if not add(opened[2], at + len(line)):
                    return ranges
                opened = None
        at += len(line)
    if opened:
        add(opened[2], len(text))
    return ranges


def code_spans(text: str, fences: list[tuple[int, int]], reasons: list[str], limit: int) -> list[tuple[int, int]]:
    """Inline code of Markdown: runs of backticks of equal length, not escaped, within one paragraph."""
    spans: list[tuple[int, int]] = []
    pending: dict[int, int] = {}
    starts = [s for s, _ in fences]
    at = 0
    while m := _INLINE.search(text, at):
        inside = bisect.bisect_right(starts, m.start()) - 1
        crossed = bisect.bisect_right(starts, m.start()) - bisect.bisect_right(starts, at)
        if inside >= 0 and m.start() < fences[inside][1]:
            at = fences[inside][1]
            pending.clear()
            continue
        if crossed:
            pending.clear()
        at = m.end()
        if m["blank"] is not None:
            pending.clear()
            continue
        before = text[: m.start()]
        if (len(before) - len(before.rstrip("\\"))) % 2:
            continue
        size = len(m["ticks"])
        if size not in pending:
            pending[size] = m.start()
            continue
        if len(spans) == limit:
            reasons.append(f"Markdown code span limit of {limit} reached")
            spans.append((pending[size], len(text)))
            break
        spans.append((pending.pop(size), m.end()))
    return spans


def extract_scripts(text: str, markdown: bool, limits: ScanLimits = DEFAULT) -> tuple[list[ScriptBlock], list[str]]:
    """(script blocks in order, reasons why some were left out)."""
    blocks: list[ScriptBlock] = []
    reasons: list[str] = []
    excluded: list[tuple[int, int]] = []
    if markdown:
        fences = fenced_ranges(text, reasons, limits.markdown_fences)
        excluded = sorted(fences + code_spans(text, fences, reasons, limits.markdown_spans))
    at = total = 0
    while opened := _OPEN.search(text, at):
        comment = text.find("<!--", at, opened.start())
        if comment >= 0:
            end = text.find("-->", comment + 4)
            if end < 0:
                reasons.append("unterminated HTML comment before embedded script")
                break
            at = end + 3
            continue
        at = opened.end()
        if any(s <= opened.start() < e for s, e in excluded) or text[at : at + 1] not in ("", ">", *" \t\n\r\f"):
            continue
        tag = _TAG_REST.match(text, at)
        if not tag:
            reasons.append("unterminated embedded script tag")
            break
        attributes, body = text[at : tag.end() - 1], tag.end()
        language = script_language(attributes)
        close = _CLOSE.search(text, body)
        closing = close and _TAG_REST.match(text, close.end())
        if language is None:
            at = closing.end() if closing else len(text)
            continue
        if not closing:
            reasons.append("unterminated embedded script closing tag" if close else "unterminated embedded JavaScript block")
            break
        if len(blocks) == limits.embedded_scripts:
            reasons.append(f"embedded script limit of {limits.embedded_scripts} reached")
            break
        source, line = text[body : close.start()], text.count("\n", 0, body)
        size, external = len(source.encode()), attribute(attributes, "src")
        if external is None and size > limits.parse_bytes:
            reasons.append(f"embedded JS/TS parse limit of {limits.parse_bytes} bytes exceeded at line {line + 1}")
        elif external is None and total + size > limits.parse_bytes:
            reasons.append(f"embedded JS/TS total parse limit of {limits.parse_bytes} bytes reached at line {line + 1}")
            break
        else:
            total += size
            blocks.append(ScriptBlock(source, *language, line, external))
        at = closing.end()
    return blocks, reasons
