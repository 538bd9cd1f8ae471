"""From a file's text to modules, by file kind."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..limits import DEFAULT, ScanLimits
from ..operators.files import EXECUTABLE_MARKERS, JS_EXTENSIONS
from .extract import DOCUMENT_KINDS, extract_scripts
from .facts import Collector, FactLimit, ModuleFacts
from .lower import lower
from .parser import JsSyntaxError, Node, parse
from .scopes import ScopeBuilder

# How text starts that may be source, and what only source contains.
SOURCE_PREFIXES = (
    "#!", "const ", "let ", "var ", "function ", "async ", "await ", "class ", "import ", "export ", "if ", "if(", "for ", "for(", "while ", "try ", "switch ", "throw ", "new ",
    "module.", "exports.", "require(", "eval(", "new Function", "global", "process.", "fetch(", "axios", "http.", "https.", "WebSocket", "console.", "setTimeout(", "setInterval(",
    "(()", "(function ", "(async ", '"use strict"', "'use strict'",
)
ASSET_EXTENSIONS = ("svg", "woff", "woff2", "png", "jpg", "gif")
ASSET_PREFIXES = ("eval(", "require(", "module.exports", "const ", "function ")
CODE_PUNCTUATION = set("{}()[];=<>:")
CODE_MARKERS = (
    "const ", "let ", "var ", "function ", "class ", "import ", "export ", "return ", "async ", "await ", "if(", "if ", "try ", "require(", "eval(", "process.", "fetch(", "module.", "exports.", "=>",
)
_LEADING = re.compile(r"\s*(?://[^\n]*(?:\n|\Z)\s*|/\*(?:.*?\*/|.*)\s*)*", re.S)
_FLOW_PRAGMA = re.compile(r"\A\s*(?:/\*[^*]*@flow\b|//[^\n]*@flow\b)")


@dataclass
class FileAnalysis:
    language: str | None = None
    disguised: bool = False
    reasons: list[str] = field(default_factory=list)
    modules: list[ModuleFacts] = field(default_factory=list)
    embedded: list[tuple[str, int]] = field(default_factory=list)  # (module id, line) of scripts that a document runs


class Unreadable(ValueError):
    """A source that can't be analysed, and why."""


def exact_extension(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1] if "." in name[1:] else None


def looks_like_source(text: str) -> bool:
    return any(c in CODE_PUNCTUATION for c in text) or any(m in text for m in CODE_MARKERS)


def is_suspicious(text: str, suffix: str | None) -> bool:
    """Whether text under another extension is worth parsing: it starts like source, and looks executable."""
    first = text.split("\n", 1)[0]
    if first.startswith("#!") and "node" not in first[2:].lower():
        return False
    start = text[_LEADING.match(text).end() :]
    if not start.startswith(SOURCE_PREFIXES):
        return False
    return sum(m in text for m in EXECUTABLE_MARKERS) >= 2 or (suffix in ASSET_EXTENSIONS and start.startswith(ASSET_PREFIXES))


def source_cases(text: str) -> list[tuple[int, str]] | None:
    """(lines before, source) of the parts between lines of ---, if there are at least two."""
    cases, line = [], 0
    parts = re.split(r"(?m)^[^\S\n]*---[^\S\n]*(?:\n|\Z)", text)
    for part in parts:
        if part.strip():
            cases.append((line, part))
        line += part.count("\n") + 1
    return cases if len(parts) > 1 and len(cases) > 1 else None


def tree_of(source: str, typescript: bool, jsx: bool) -> tuple[Node, bool]:
    """(tree, whether it took types): as it is, with a top-level return, with types, with elements."""
    readings = [{"typescript": typescript, "jsx": jsx}]
    if "return" in source:
        readings.append({"typescript": typescript, "jsx": jsx, "commonjs": True})
    if not typescript:
        readings += [{"typescript": True, "jsx": True}, {"jsx": True}]
    elif not jsx and "<" in source and ">" in source:
        readings.append({"typescript": True, "jsx": False})
    first: JsSyntaxError | None = None
    for reading in readings:
        try:
            return parse(source, **reading), bool(reading.get("typescript"))
        except JsSyntaxError as error:
            first = first or error
        except RecursionError:
            raise Unreadable("JS/TS nesting limit exceeded") from None
    if _FLOW_PRAGMA.search(source):
        raise Unreadable("Flow syntax is unsupported by the JS/TS parser")
    raise Unreadable(f"JS/TS parser could not fully parse: 1 diagnostic(s), first: {first} at line {first.line}")


def module_of(path: str, id: str, source: str, *, typescript: bool, jsx: bool, line_offset: int = 0, flow_enabled: bool = True, facts: int | None = None, limits: ScanLimits = DEFAULT) -> ModuleFacts | None:
    """The module of a source, None for an empty program; Unreadable if it can't be analysed fully."""
    size = len(source.encode())
    if size > limits.parse_bytes:
        raise Unreadable(f"JS/TS parse limit of {limits.parse_bytes} bytes exceeded")
    depth = 0
    for c in source:
        if c in "([{":
            depth += 1
            if depth > limits.parse_nesting:
                raise Unreadable(f"JS/TS nesting limit of {limits.parse_nesting} exceeded")
        elif c in ")]}" and depth:
            depth -= 1
    tree, typed = tree_of(source, typescript, jsx)
    if not tree.body:
        return None
    try:
        clashes = ScopeBuilder(tree, typed).clashes
        if clashes:
            raise Unreadable(f"JS/TS semantic analysis could not fully inspect {path}: {len(clashes)} diagnostic(s), first: Identifier `{clashes[0]}` has already been declared")
        module = ModuleFacts(id, path, flow_enabled, size)
        module.flow = lower(tree, source, line_offset)
        limit = limits.module_facts if facts is None else facts
        Collector(module, source, line_offset, limit).collect(tree)
    except FactLimit:
        raise Unreadable(f"JS/TS fact limit of {limit} reached: {path}") from None
    except RecursionError:
        raise Unreadable("JS/TS nesting limit exceeded") from None
    return module


def _documents(path: str, text: str, out: FileAnalysis, html: bool, markdown: bool, limits: ScanLimits) -> None:
    blocks, reasons = extract_scripts(text, markdown, limits)
    out.reasons += [f"{r}: {path}" for r in reasons]
    used = 0
    for number, block in enumerate(blocks):
        room = limits.module_facts - used
        if room <= 0:
            out.reasons.append(f"JS/TS fact limit of {limits.module_facts} reached: {path}")
            break
        id = f"{path}#embedded-script-{number}"
        if block.external is not None:
            module = ModuleFacts(id, path, not markdown, 0, [(block.external, block.line_offset + 1)])
            module.flow = lower(Node("Program", 0, 0, body=[]), "", 0)
        else:
            try:
                module = module_of(path, id, block.source, typescript=block.typescript, jsx=block.jsx, line_offset=block.line_offset, flow_enabled=not markdown, facts=room, limits=limits)
            except Unreadable as error:
                out.reasons.append(f"{error} at line {block.line_offset + 1}: {path}")
                continue
            if module is None:
                continue
        if html:
            out.embedded.append((id, block.line_offset + 1))
        used += len(module.imports) + len(module.calls)
        out.language = out.language or ("typescript" if block.typescript else "javascript")
        out.modules.append(module)


def _cases(path: str, cases: list[tuple[int, str]], out: FileAnalysis, language: dict[str, bool], limits: ScanLimits) -> None:
    used = 0
    for number, (line_offset, source) in enumerate(cases):
        room = limits.module_facts - used
        if room <= 0:
            out.reasons.append(f"JS/TS fact limit of {limits.module_facts} reached across separated source cases: {path}")
            break
        try:
            module = module_of(path, f"{path}#source-case-{number}", source, line_offset=line_offset, facts=room, limits=limits, **language)
        except Unreadable as error:
            if looks_like_source(source):
                out.reasons.append(f"{error} in source case {number + 1}: {path}")
            continue
        if module is not None:
            used += len(module.imports) + len(module.calls)
            out.modules.append(module)


def analyse_file(path: str, text: str | None, limits: ScanLimits = DEFAULT) -> FileAnalysis:
    suffix, out = exact_extension(path), FileAnalysis()
    declared = suffix in JS_EXTENSIONS
    if text is None:
        if declared:
            out.reasons.append(f"cannot decode JS/TS source: {path}")
        return out
    if suffix in DOCUMENT_KINDS:
        _documents(path, text, out, *DOCUMENT_KINDS[suffix], limits)
        if out.modules or out.reasons:
            return out
    if not declared and not is_suspicious(text, suffix):
        return out
    typescript = declared and suffix in ("ts", "cts", "mts", "tsx")
    language = {"typescript": typescript, "jsx": declared and suffix in ("jsx", "tsx")}
    name = "typescript" if typescript else "javascript"
    try:
        module = module_of(path, path, text, limits=limits, **language)
    except Unreadable as error:
        if declared and (cases := source_cases(text)):
            _cases(path, cases, out, language, limits)
            if out.modules or out.reasons:
                out.language = name
                return out
        if not declared or looks_like_source(text) or "limit" in str(error):
            out.reasons.append(f"{error}: {path}")
        return out
    if module is not None:
        out.language, out.disguised = name, not declared
        out.modules.append(module)
    return out
