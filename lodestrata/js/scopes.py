"""Which declaration an identifier refers to, and declarations that clash."""

from __future__ import annotations

from collections.abc import Iterator

from .parser import Node

#: Node types that open a scope for lexical names.
BLOCKS = {"BlockStatement", "ForStatement", "ForInStatement", "ForOfStatement", "SwitchStatement", "CatchClause", "StaticBlock"}
FUNCTIONS = {"FunctionDeclaration", "FunctionExpression", "ArrowFunctionExpression", "Method"}
CLASSES = {"ClassDeclaration", "ClassExpression"}


class Scope:
    def __init__(self, parent: Scope | None, function: bool) -> None:
        self.parent, self.function = parent, function
        self.names: dict[str, str] = {}  # name: kind

    def lookup(self, name: str) -> Scope | None:
        scope = self
        while scope is not None and name not in scope.names:
            scope = scope.parent
        return scope

    def function_scope(self) -> Scope:
        scope = self
        while not scope.function:
            scope = scope.parent
        return scope


def children(node: Node) -> Iterator[Node]:
    """Direct child nodes in source order."""
    for key, value in node.__dict__.items():
        if isinstance(value, Node):
            yield value
        elif isinstance(value, list) and key != "names":
            for item in value:
                if isinstance(item, Node):
                    yield item
                elif isinstance(item, tuple):
                    yield from (x for x in item if isinstance(x, Node))


def bound_names(pattern: Node | None) -> Iterator[str]:
    if pattern is None:
        return
    match pattern.type:
        case "Identifier":
            yield pattern.name
        case "ObjectPattern":
            for _, value in pattern.properties:
                yield from bound_names(value)
            yield from bound_names(pattern.rest)
        case "ArrayPattern":
            for element in pattern.elements:
                yield from bound_names(element)
        case "RestElement":
            yield from bound_names(pattern.argument)
        case "AssignmentPattern":
            yield from bound_names(pattern.left)


class ScopeBuilder:
    """Attaches a scope to each node that opens one; clashes holds the names that are declared twice where that is an error."""

    def __init__(self, program: Node, typescript: bool) -> None:
        self.clashes: list[str] = []
        self.typescript = typescript
        program.scope = Scope(None, True)
        self._visit_all(program.body, program.scope)

    def _declare(self, scope: Scope, name: str, kind: str) -> None:
        before = scope.names.get(name)
        lexical = {"let", "const", "class", "import"}
        overload = self.typescript and {kind, before} <= {"function", "class", "import"}
        if before and (kind in lexical or before in lexical) and not (before == "parameter" and kind == "function") and not overload:
            self.clashes.append(name)
        scope.names.setdefault(name, kind)

    def _visit_all(self, nodes, scope: Scope) -> None:
        for node in nodes:
            if node is not None:
                self._visit(node, scope)

    def _visit(self, node: Node, scope: Scope) -> None:
        kind = node.type
        if kind == "VariableDeclaration":
            target = scope.function_scope() if node.kind == "var" else scope
            for item in node.declarations:
                for name in bound_names(item.id):
                    if node.kind == "var":
                        self._hoist(scope, target, name)
                    else:
                        self._declare(target, name, node.kind)
        elif kind == "ImportDeclaration":
            for s in node.specifiers:
                self._declare(scope, s.local, "import")
            return
        elif kind == "FunctionDeclaration" and node.id:
            self._declare(scope, node.id, "function")
        elif kind == "ClassDeclaration" and node.id:
            self._declare(scope, node.id, "class")
        elif kind == "EnumDeclaration":
            scope.names.setdefault(node.name, "var")
        if kind in FUNCTIONS:
            inner = node.scope = Scope(scope, True)
            if kind == "FunctionExpression" and node.id:
                inner.names[node.id] = "var"
            for parameter in node.params:
                for name in bound_names(parameter):
                    inner.names[name] = "parameter"
                self._visit(parameter, inner)
            if node.body is not None:
                if node.body.type == "BlockStatement":
                    node.body.scope = inner
                    self._visit_all(node.body.body, inner)
                else:
                    self._visit(node.body, inner)
            return
        if kind in CLASSES:
            inner = node.scope = Scope(scope, False)
            if node.id:
                inner.names[node.id] = "var"
            self._visit_all(children(node), inner)
            return
        if kind in BLOCKS:
            inner = node.scope = Scope(scope, False)
            if kind == "CatchClause":
                for name in bound_names(node.param):
                    inner.names[name] = "catch"
            self._visit_all(children(node), inner)
            return
        self._visit_all(children(node), scope)

    def _hoist(self, scope: Scope, target: Scope, name: str) -> None:
        at = scope
        while at is not target:  # a var may not cross a lexical declaration of its name
            if at.names.get(name) in ("let", "const", "class"):
                self.clashes.append(name)
            at = at.parent
        self._declare(target, name, "var")
