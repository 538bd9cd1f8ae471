"""From trees to the small language that data flow is computed on.

Everything is plain tuples, lists and strings, so a module's flow can be
pickled into a column.

bindings    ("name", n) ("object", [(property or *, binding)]) ("array", [binding]) ("none",)
statements  ("bind", binding, e) ("do", e) ("return", e) ("throw", e) ("branch", test, yes, no)
            ("iterate", binding, e, body) ("try", body, (binding, body) or None, finally)
expressions ("name", n) ("string", s) ("bool", b) ("member", e, property or *) ("call", e, args, line)
            ("new", e, args, line) ("then", e, binding, body) ("message", e, binding, body, event)
            ("object", [(property or *, e)]) ("array", [e]) ("combine", [e]) ("sequence", [e])
            ("assign", n, e) ("unknown",)

Functions are kept in a table by name and only analysed where they are called;
a callback's body is put where the callback is handed over.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .facts import Lines, key_name, static_string, string_argument
from .names import MESSAGE_EVENTS
from .parser import Node

NOTHING, UNKNOWN = ("none",), ("unknown",)
ERROR_NAMES = (("name", "err"), ("name", "error"))
FUNCTION_VALUES = ("ArrowFunctionExpression", "FunctionExpression")


@dataclass
class ModuleFlow:
    imports: dict[str, tuple[str, str]] = field(default_factory=dict)  # local: (specifier, exported)
    exports: dict[str, str] = field(default_factory=dict)  # exported: local
    reexports: dict[str, tuple[str, str]] = field(default_factory=dict)  # exported or *: (specifier, imported)
    functions: dict[str, tuple[list, list]] = field(default_factory=dict)  # name: (parameters, body)
    body: list = field(default_factory=list)


def binding(pattern: Node | None) -> tuple:
    match pattern and pattern.type:
        case "Identifier":
            return ("name", pattern.name)
        case "ObjectPattern":
            named = [(key, binding(value)) for k, value in pattern.properties if (key := key_name(k)) is not None]
            return ("object", named + ([("*", binding(pattern.rest))] if pattern.rest else []))
        case "ArrayPattern":
            return ("array", [binding(e) for e in pattern.elements if e is None or e.type != "RestElement"])
        case "AssignmentPattern":
            return binding(pattern.left)
    return NOTHING


class Lowering:
    def __init__(self, source: str, line_offset: int) -> None:
        self.line = Lines(source, line_offset)
        self.flow = ModuleFlow()

    # Expressions

    def expr(self, node: Node | None) -> tuple:
        handler = getattr(self, f"_{node.type}", None) if node is not None else None
        return handler(node) if handler else UNKNOWN

    def all(self, nodes: list[Node]) -> list[tuple]:
        return [self.expr(n.argument if n is not None and n.type == "SpreadElement" else n) for n in nodes]

    def _Identifier(self, node: Node) -> tuple:
        return ("name", node.name)

    def _StringLiteral(self, node: Node) -> tuple:
        return ("string", node.value)

    def _BooleanLiteral(self, node: Node) -> tuple:
        return ("bool", node.value)

    def _TemplateLiteral(self, node: Node) -> tuple:
        parts = []
        for i, text in enumerate(node.quasis):
            parts.append(("string", text))
            parts += [self.expr(e) for e in node.expressions[i : i + 1]]
        return ("combine", parts)

    def _MemberExpression(self, node: Node) -> tuple:
        part = node.property if not node.computed else static_string(node.property)
        return ("member", self.expr(node.object), "*" if part is None else part)

    def plain_call(self, node: Node) -> tuple:
        return ("call", self.expr(node.callee), self.all(node.arguments), self.line(node))

    def _CallExpression(self, node: Node) -> tuple:
        callee, arguments = node.callee, node.arguments
        method = callee.property if callee.type == "MemberExpression" and not callee.computed else None
        if method == "then" and arguments and (handed := self.callback(arguments[0])):
            return ("then", self.expr(callee.object), *handed)
        if method in ("on", "addEventListener") and (event := string_argument(arguments)) in MESSAGE_EVENTS and len(arguments) > 1 and (handed := self.callback(arguments[1])):
            return ("message", self.expr(callee.object), *handed, event)
        if arguments and (handed := self.callback(arguments[-1])):
            return ("then", self.plain_call(node), *handed)
        return self.plain_call(node)

    def _NewExpression(self, node: Node) -> tuple:
        return ("new", self.expr(node.callee), self.all(node.arguments), self.line(node))

    def _ImportExpression(self, node: Node) -> tuple:
        return ("call", ("name", "import"), [self.expr(node.source)], self.line(node))

    def _ChainExpression(self, node: Node) -> tuple:
        inner = node.expression
        return self.plain_call(inner) if inner.type == "CallExpression" else self.expr(inner)

    def _transparent(self, node: Node) -> tuple:
        return self.expr(node.expression)

    _ParenthesizedExpression = _TSExpression = _transparent

    def _AwaitExpression(self, node: Node) -> tuple:
        return self.expr(node.argument)

    def _UnaryExpression(self, node: Node) -> tuple:
        return ("combine", [self.expr(node.argument)])

    def _BinaryExpression(self, node: Node) -> tuple:
        return ("combine", [self.expr(node.left), self.expr(node.right)])

    _LogicalExpression = _BinaryExpression

    def _ConditionalExpression(self, node: Node) -> tuple:
        return ("combine", [self.expr(node.consequent), self.expr(node.alternate)])

    def _ObjectExpression(self, node: Node) -> tuple:
        out = []
        for p in node.properties:
            if p.type == "SpreadElement":
                out.append(("*", self.expr(p.argument)))
            elif (key := key_name(p.key)) is not None:
                out.append((key, self.expr(p.value)))
        return ("object", out)

    def _ArrayExpression(self, node: Node) -> tuple:
        return ("array", [UNKNOWN if e is None or e.type == "SpreadElement" else self.expr(e) for e in node.elements])

    def _SequenceExpression(self, node: Node) -> tuple:
        return ("sequence", [self.expr(e) for e in node.expressions])

    def _AssignmentExpression(self, node: Node) -> tuple:
        right = self.expr(node.right)
        if node.left.type != "Identifier":
            return right
        name = node.left.name
        return ("assign", name, right if node.operator == "=" else ("combine", [("name", name), right]))

    # Functions

    def function(self, node: Node) -> tuple[list, list]:
        params = [binding(p) for p in node.params if p.type != "RestElement"]
        if node.body is None:
            return params, []
        if node.body.type != "BlockStatement":
            return params, [("return", self.expr(node.body))]
        return params, self.statements(node.body.body)

    def callback(self, node: Node) -> tuple[tuple, list] | None:
        """(the parameter that receives the value, body) of a function that is handed over. Its own functions aren't the module's."""
        if node.type not in FUNCTION_VALUES:
            return None
        kept, self.flow.functions = self.flow.functions, {}
        params, body = self.function(node)
        self.flow.functions = kept
        place = 1 if len(params) > 1 and params[0] in ERROR_NAMES else 0
        return (params[place] if len(params) > place else NOTHING), body

    def named_function(self, name: str, node: Node) -> bool:
        if node.type not in FUNCTION_VALUES:
            return False
        self.flow.functions[name] = self.function(node)
        return True

    def class_methods(self, node: Node) -> None:
        if not node.id:
            return
        for m in node.members:
            if m.type == "MethodDefinition" and not m.abstract and (key := key_name(m.key)) is not None:
                self.flow.functions[node.id if m.kind == "constructor" else f"{node.id}.{key}"] = self.function(m.value)

    # Statements

    def statements(self, nodes: list[Node]) -> list[tuple]:
        return [s for n in nodes for s in self.statement(n)]

    def statement(self, node: Node | None) -> list[tuple]:
        handler = getattr(self, f"_do_{node.type}", None) if node is not None else None
        return handler(node) if handler else []

    def _do_FunctionDeclaration(self, node: Node) -> list[tuple]:
        if node.id:
            self.flow.functions[node.id] = self.function(node)
        return []

    def _do_ClassDeclaration(self, node: Node) -> list[tuple]:
        self.class_methods(node)
        return []

    def _do_VariableDeclaration(self, node: Node) -> list[tuple]:
        out = []
        for item in node.declarations:
            target, init = binding(item.id), item.init
            if target[0] == "name" and init is not None:
                self.named_function(target[1], init)
                if init.type == "ObjectExpression":
                    for p in init.properties:
                        if p.type == "Property" and (key := key_name(p.key)) is not None:
                            self.named_function(f"{target[1]}.{key}", p.value)
            out.append(("bind", target, self.expr(init)))
        return out

    def _do_ExportDeclaration(self, node: Node) -> list[tuple]:
        return self.statement(node.declaration)

    def _do_ExportDefaultDeclaration(self, node: Node) -> list[tuple]:
        value = node.declaration
        if value.type == "FunctionDeclaration":
            self.flow.functions["default"] = self.function(value)
            return []
        if self.named_function("default", value):
            return [("do", self.expr(value))]
        return [] if value.type in ("ClassDeclaration", "EmptyStatement") else [("do", self.expr(value))]

    def _do_ExpressionStatement(self, node: Node) -> list[tuple]:
        return [("do", self.expr(node.expression))]

    def _do_ReturnStatement(self, node: Node) -> list[tuple]:
        return [] if node.argument is None else [("return", self.expr(node.argument))]

    def _do_ThrowStatement(self, node: Node) -> list[tuple]:
        return [("throw", self.expr(node.argument))]

    def _do_LabeledStatement(self, node: Node) -> list[tuple]:
        return self.statement(node.body)

    def _do_BlockStatement(self, node: Node) -> list[tuple]:
        return self.statements(node.body)

    def _do_IfStatement(self, node: Node) -> list[tuple]:
        return [("branch", self.expr(node.test), self.statement(node.consequent), self.statement(node.alternate))]

    def _do_WhileStatement(self, node: Node) -> list[tuple]:
        return [("branch", self.expr(node.test), self.statement(node.body), [])]

    def _do_DoWhileStatement(self, node: Node) -> list[tuple]:
        return self.statement(node.body)

    def _do_ForStatement(self, node: Node) -> list[tuple]:
        init = node.init
        out = [] if init is None else self.statement(init) if init.type == "VariableDeclaration" else [("do", self.expr(init))]
        body = self.statement(node.body) + ([("do", self.expr(node.update))] if node.update is not None else [])
        return [*out, ("branch", self.expr(node.test) if node.test is not None else ("bool", True), body, [])]

    def _do_ForInStatement(self, node: Node) -> list[tuple]:
        left = node.left
        target = binding(left.declarations[0].id) if left.type == "VariableDeclaration" else binding(left) if left.type == "Identifier" else NOTHING
        return [("iterate", target, self.expr(node.right), self.statement(node.body))]

    _do_ForOfStatement = _do_ForInStatement

    def _do_SwitchStatement(self, node: Node) -> list[tuple]:
        bodies = [self.statements(c.consequent) for c in node.cases]
        if not bodies:
            return []
        combined = bodies[0]
        for body in bodies[1:]:
            combined = [("branch", UNKNOWN, combined, body)]
        return [("branch", UNKNOWN, combined, [("do", self.expr(node.discriminant))])]

    def _do_TryStatement(self, node: Node) -> list[tuple]:
        handler = node.handler
        caught = None if handler is None else (binding(handler.param), self.statements(handler.body.body))
        return [("try", self.statements(node.block.body), caught, self.statements(node.finalizer.body) if node.finalizer else [])]

    # Module level

    def module(self, program: Node) -> ModuleFlow:
        for node in program.body:
            if handler := getattr(self, f"_link_{node.type}", None):
                handler(node)
        self.flow.body = self.statements(program.body)
        return self.flow

    def _link_ImportDeclaration(self, node: Node) -> None:
        for s in node.specifiers:
            exported = {"ImportSpecifier": getattr(s, "imported", ""), "ImportDefaultSpecifier": "default", "ImportNamespaceSpecifier": "*"}[s.type]
            self.flow.imports[s.local] = (node.source, exported)

    def _link_ExportDeclaration(self, node: Node) -> None:
        made = node.declaration
        names = [made.id] if made.type in ("FunctionDeclaration", "ClassDeclaration") and made.id else []
        if made.type == "VariableDeclaration":
            names = [d.id.name for d in made.declarations if d.id.type == "Identifier"]
        self.flow.exports.update((n, n) for n in names)

    def _link_ExportNamedDeclaration(self, node: Node) -> None:
        self.flow.exports.update((exported, local) for local, exported in node.specifiers)

    def _link_ExportDefaultDeclaration(self, node: Node) -> None:
        made = node.declaration
        if made.type == "ClassDeclaration":
            self.class_methods(made)
        self.flow.exports["default"] = made.id if made.type == "ClassDeclaration" and made.id else "default"

    def _link_ExportFromDeclaration(self, node: Node) -> None:
        self.flow.reexports.update((exported, (node.source, local)) for local, exported in node.specifiers)

    def _link_ExportAllDeclaration(self, node: Node) -> None:
        self.flow.reexports["*"] = (node.source, "*")

    def _link_ExpressionStatement(self, node: Node) -> None:
        """exports.x = ..., module.exports.x = ... and module.exports = ..."""
        e = node.expression
        if e.type != "AssignmentExpression" or e.left.type != "MemberExpression" or e.left.computed:
            return
        owner, name = dotted(e.left.object), e.left.property
        if owner in ("exports", "module.exports"):
            self.export(name, e.right)
        elif owner == "module" and name == "exports":
            if e.right.type != "ObjectExpression":
                self.export("default", e.right)
                return
            for p in e.right.properties:
                if p.type == "Property" and (key := key_name(p.key)) is not None:
                    self.export(key, p.value)

    def export(self, exported: str, value: Node) -> None:
        if value.type == "Identifier":
            self.flow.exports[exported] = value.name
        elif self.named_function(exported, value):
            self.flow.exports[exported] = exported


def dotted(node: Node) -> str | None:
    if node.type == "Identifier":
        return node.name
    if node.type == "MemberExpression" and not node.computed and (base := dotted(node.object)):
        return f"{base}.{node.property}"
    return None


def lower(program: Node, source: str, line_offset: int) -> ModuleFlow:
    return Lowering(source, line_offset).module(program)
