"""Readers and helpers that need no cluster."""

from __future__ import annotations

import random

import pytest

from lodestrata import json5
from lodestrata.cli import UsageError, parse
from lodestrata.js.analyse import analyse_file
from lodestrata.js.extract import extract_scripts
from lodestrata.js.flow import analyse_flows
from lodestrata.js.parser import JsSyntaxError
from lodestrata.js.parser import parse as parse_js
from lodestrata.limits import DEFAULT
from lodestrata.operators.commands import Commands, file_roots, resolve_from
from lodestrata.report.render import encoded_uri, escaped_controls, escaped_markdown
from lodestrata.rules import RULES
from lodestrata.sources.archives import ArchiveExpander, safe_member_path

VALID = [
    "const a = b?.c?.[d]?.(e) ?? f; x = a ? (b) : c => d;",
    "for await (const x of y) {} label: for (;;) { continue label }",
    "class A extends B { static #p = 1; get x() { return this.#p } static { f() } async *[k]() {} }",
    "`a${b + `c${d}`}e`; tag`x`; /[/]x/g.test(y) / 2",
    "const {a = 1, ...r} = {...s, get b() { return 1 }, async *c() {}}; let [d, , ...e] = f;",
    "async x => await x; (async () => {})(); new (foo())(1); import('x')",
    "import d, * as n from 'm'; export {d as default}; export * from 'k'; export default class {}",
    "a = b\n++c\nlet x\nif (y) z; else w",
    "using a = f(), b = g(); await using c = h(); for (using d of e) {} for (await using d of e) {} using(x); using = 1; using\nz",
]
INVALID = ["const a = ;", "function (", "a b", "{", "`x${", "'a", "for (", "const a", "return 1", "a => {} ()"]
TYPED = [
    "interface I<T extends {} = {}> { a?: string; [k: string]: any; new (x: T): I<T>; m<U>(): asserts x is U }",
    "type C<T> = T extends infer U extends string ? U[] : [a: 1, ...b: number[]]; enum E { A = 1 }",
    "const f = <T,>(x: T): T => x as unknown as T; f<string>('a')!.b; g(a < b, c > d);",
    "abstract class Q<T> implements R { constructor(private readonly a: string, b?: number) { super() } abstract m(): void; declare x: y }",
    "declare module 'm' { export const x: number } function o(a: string): void; function o(a: any) {} let u = c ? (x): y => z : w;",
]


@pytest.mark.parametrize("source", VALID)
def test_javascript(source):
    assert parse_js(source).body


@pytest.mark.parametrize("source", INVALID)
def test_no_javascript(source):
    with pytest.raises(JsSyntaxError):
        parse_js(source)


@pytest.mark.parametrize("source", TYPED)
def test_typescript(source):
    assert parse_js(source, typescript=True).body


def test_elements():
    (statement,) = parse_js("x = <A b='c' {...d} e={f}>text {g} <h.i/> <></></A>", jsx=True).body
    assert statement.expression.right.type == "JSXElement"


def test_mutations_end_in_a_tree_or_an_error():
    rng = random.Random(5)
    pieces = [*"(){}[]<>;,.=+-/*`'\"\\ \n", "=>", "class", "async", "await", "function", "${", "?.", "x", "1", "in", "of", "import"]
    for _ in range(1500):
        source = "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25)))
        for options in ({}, {"typescript": True}, {"typescript": True, "jsx": True}):
            try:
                parse_js(source, **options)
            except JsSyntaxError:
                pass


def test_json5():
    assert json5.loads("{b: 'x', a: [1, .5, 0x1F, +3, -Infinity,], /* c */ \"d\": \"\\u0041\\\n\",} // e") == {"a": [1, 0.5, 31, 3, float("-inf")], "b": "x", "d": "A"}
    for bad in ("", "{", "{a}", "[1 2]", "01", "'a", "{a: 1} x", "undefined"):
        with pytest.raises(json5.Json5Error):
            json5.loads(bad)


def test_commands():
    c = Commands()
    assert c.targets("NODE_ENV=x node a.js") == []
    assert c.targets("cross-env A=1 node -r ./p.js src/a.ts --flag b.mjs && sh -c 'node c.js'") == ["./p.js", "b.mjs", "c.js", "src/a.ts"]
    assert c.targets("npx tsx a.ts; yarn exec node b.js; node -e 'x' c.js") == ["a.ts", "b.js"]
    assert c.script_targets("npm run b", {"b": "node x.js && npm run b"}) == ["x.js"] and c.limit_reached
    assert resolve_from("a/b.js", "../c.js") == "c.js" and resolve_from("a/b.js", "../../c.js") == "" and resolve_from("a.js", "/c.js") == ""
    roots, limited = file_roots("package.json", '{"scripts": {"b": "node b.js", "start": "node s.js"}}', ["npm_manifest"])
    assert [r[:2] for r in roots] == [("s.js", "npm start (package.json)"), ("b.js", "npm b (package.json)")] and not limited


def test_script_extraction():
    blocks, reasons = extract_scripts("<!-- <script>a</script> -->\n<SCRIPT type=module>b</script >\n<script src='x.js'></script><script type='application/ld+json'>{}</script><scripts>", False)
    assert [(b.source, b.line_offset, b.external) for b in blocks] == [("b", 1, None), ("", 2, "x.js")] and not reasons
    assert extract_scripts("<script>a", False)[1] == ["unterminated embedded JavaScript block"]
    many, reasons = extract_scripts("<script>a</script>" * 257, False)
    assert len(many) == 256 and reasons == ["embedded script limit of 256 reached"]


def test_source_cases():
    found = analyse_file("a.js", "let a = f();\n---\nlet a = g();\n---\n")
    assert not found.reasons and [m.id for m in found.modules] == ["a.js"] or [m.id for m in found.modules] == ["a.js#source-case-0", "a.js#source-case-1"]
    assert analyse_file("a.js", "plain words only").modules == [] and analyse_file("a.js", "plain words only").reasons == []


def test_work_limit_is_reported():
    body = "".join(f"if (a{i}) {{ x = y{i}; }} " for i in range(3000))
    facts = analyse_file("a.js", "const big = {" + ",".join(f"k{i}: 'v{i}'" for i in range(2000)) + "};" + body)
    found, reasons = analyse_flows(facts.modules, {})
    assert len(reasons) == 1 and "data-flow work limit" in reasons[0]


def test_deep_sums_are_read():
    import sys

    from lodestrata.js.tables import with_deep_stack

    before = sys.getrecursionlimit()
    text = "const a = " + " + ".join(f"'{i}'" for i in range(6000)) + "; f(a);"
    assert with_deep_stack(lambda: len(analyse_file("a.js", text).modules[0].calls)) == 1
    sys.setrecursionlimit(before)


def test_archives():
    for bad in (b"", b"/a", b"a/../b", b"a:b", b"a\x01", b"\xff", b"x" * 5000, b"..\\x"):
        with pytest.raises(ValueError):
            safe_member_path(bad)
    assert safe_member_path(b"a\\b") == "a/b"
    late = ArchiveExpander(DEFAULT, clock=iter([0.0, 100.0, 100.0, 100.0]).__next__)
    assert late.expand("a.gz", b"\x1f\x8b\x08") == [] and late.reasons == ["archive time limit reached at a.gz"]


def test_report_escapes():
    assert escaped_controls("a\x1b[1m\n") == "a\\u{1b}[1m\\n" and escaped_markdown("a|`<\\") == "a\\|\\`&lt;\\\\" and encoded_uri("a b\\ü") == "a%20b/%C3%BC"


def test_command_line():
    assert parse(["x", "--format=json", "--fail-on", "INFO", "--quick"])[1] == {"path": "x", "format": "json", "fail_on": "info", "quick": True, "deep": False, "history": False}
    assert parse([])[0] == "help" and parse(["rules"])[0] == "rules" and parse(["explain", "X"]) == ("rule", {"id": "X"})
    assert parse(["diff", "abcdef1..HEAD"]) == ("diff", {"range": "abcdef1..HEAD"})
    for bad in (["scan"], ["x", "y"], ["x", "--what"], ["x", "--quick", "--deep"], ["diff", "HEAD..HEAD"], ["x", "--format"], ["version", "x"], ["rules", "x"]):
        with pytest.raises(UsageError):
            parse(bad)
    assert len(RULES) == 35
