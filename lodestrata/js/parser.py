"""A JavaScript parser that also reads TypeScript and JSX.

It builds a tree of Node objects in the usual shape of such trees; types are
checked for syntax and dropped. It is driven by the grammar, so whether a slash
starts a regular expression, or an angle bracket a type or an element, is
decided where it is met. Where that needs to look ahead, it tries and goes back.
"""

from __future__ import annotations

from collections.abc import Callable

import regex


class JsSyntaxError(ValueError):
    def __init__(self, message: str, line: int) -> None:
        super().__init__(message)
        self.line = line


class Node:
    """A tree node: type, start, end and whatever belongs to its type."""

    def __init__(self, type: str, start: int, end: int, **fields: object) -> None:
        self.type, self.start, self.end = type, start, end
        self.__dict__.update(fields)

    def __repr__(self) -> str:
        return f"{self.type}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in ('type', 'start', 'end'))})"


# Fixed values of the grammar.
_SKIP = regex.compile(r"(?:[\s\uFEFF]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", regex.S)
_NAME = regex.compile(r"(?:[\p{ID_Start}$_]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))(?:[\p{ID_Continue}$\u200C\u200D]|\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\}))*")
_NUMBER = regex.compile(r"0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?n?")
_PUNCT = regex.compile(r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
_STRING = {q: regex.compile(rf"{q}(?:[^{q}\\\n\r]|\\(?:\r\n|.))*{q}", regex.S) for q in "\"'"}
_REGEX = regex.compile(r"/(?:[^\\/\[\n\r]|\\.|\[(?:[^\]\\\n\r]|\\.)*\])+/[\p{ID_Continue}$]*")
_TEMPLATE = regex.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", regex.S)
_JSX_TEXT = regex.compile(r"[^{<]*")
_JSX_NAME = regex.compile(r"[\p{ID_Start}$_][\p{ID_Continue}$\-]*(?:[:.][\p{ID_Start}$_][\p{ID_Continue}$\-]*)*")
_ESCAPE = regex.compile(r"\\(?:u\{([0-9a-fA-F]+)\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([0-7]{1,3})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v"}
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare accessor async get set".split())


def cooked(raw: str) -> str:
    """A string's value from the text between its quotes."""

    def replace(m: regex.Match) -> str:
        brace, four, two, octal, other = m.groups()
        if digits := brace or four or two:
            return chr(int(digits, 16)) if int(digits, 16) < 0x110000 else "\uFFFD"
        if octal:
            return chr(int(octal, 8))
        return "" if other in ("\n", "\r", "\r\n", "\u2028", "\u2029") else _SIMPLE.get(other, other)

    out = _ESCAPE.sub(replace, raw) if "\\" in raw else raw
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class Token:
    __slots__ = ("kind", "value", "start", "end", "newline")

    def __init__(self, kind: str, value: str, start: int, end: int, newline: bool) -> None:
        self.kind, self.value, self.start, self.end, self.newline = kind, value, start, end, newline


class Parser:
    def __init__(self, source: str, *, typescript: bool = False, jsx: bool = False, commonjs: bool = False) -> None:
        self.source, self.ts, self.jsx = source, typescript, jsx
        self.in_function = 1 if commonjs else 0
        self.is_async, self.is_generator = True, False
        self.last_end = 0
        self.no_in = False
        self.not_arrows: set[int] = set()
        start = source.index("\n") if source.startswith("#!") and "\n" in source else len(source) if source.startswith("#!") else 0
        self.tok = self._scan(start)

    # Tokens

    def fail(self, message: str = "Unexpected token", at: int | None = None) -> JsSyntaxError:
        return JsSyntaxError(message, self.source.count("\n", 0, self.tok.start if at is None else at) + 1)

    def _scan(self, at: int) -> Token:
        src = self.source
        begin = _SKIP.match(src, at).end()
        newline = any(c in "\n\r\u2028\u2029" for c in src[at:begin])
        if begin >= len(src):
            return Token("eof", "", len(src), len(src), newline)
        c = src[begin]
        if c in "\"'":
            if not (m := _STRING[c].match(src, begin)):
                raise JsSyntaxError("Unterminated string", src.count("\n", 0, begin) + 1)
            return Token("string", c, begin, m.end(), newline)
        if c == "`":
            return Token("template", c, begin, begin + 1, newline)
        if m := _NAME.match(src, begin):
            name = m[0]
            return Token("name", cooked(name) if "\\" in name else name, begin, m.end(), newline)
        if (c.isdigit() or (c == "." and src[begin + 1 : begin + 2].isdigit())) and (m := _NUMBER.match(src, begin)):
            if _NAME.match(src, m.end()):
                raise JsSyntaxError("Invalid number", src.count("\n", 0, begin) + 1)
            return Token("number", m[0], begin, m.end(), newline)
        if c == "#" and (m := _NAME.match(src, begin + 1)):
            return Token("private", m[0], begin, m.end(), newline)
        if m := _PUNCT.match(src, begin):
            return Token("punct", m[0], begin, m.end(), newline)
        raise JsSyntaxError("Unexpected character", src.count("\n", 0, begin) + 1)

    def next(self) -> Token:
        tok = self.tok
        self.last_end = tok.end
        self.tok = self._scan(tok.end)
        return tok

    def peek(self) -> Token:
        return self._scan(self.tok.end)

    def is_(self, *values: str) -> bool:
        return self.tok.kind in ("punct", "name") and self.tok.value in values

    def eat(self, value: str) -> bool:
        if self.tok.kind in ("punct", "name") and self.tok.value == value:
            self.next()
            return True
        return False

    def expect(self, value: str) -> Token:
        if not self.is_(value):
            raise self.fail(f"Expected `{value}` but found `{self.tok.value or 'end of file'}`")
        return self.next()

    def is_name(self) -> bool:
        return self.tok.kind == "name" and self.tok.value not in RESERVED

    def name(self) -> str:
        if not self.is_name():
            raise self.fail("Expected an identifier")
        return self.next().value

    def semicolon(self) -> None:
        if not self.eat(";") and not (self.is_("}") or self.tok.kind == "eof" or self.tok.newline):
            raise self.fail("Expected a semicolon")

    def split(self, value: str) -> None:
        """Takes one character off a punctuator that starts with it, as type arguments end in >> or >>=."""
        if self.tok.kind != "punct" or not self.tok.value.startswith(value):
            raise self.fail()
        end = self.tok.start + len(value)
        if self.tok.value == value:
            self.next()
            return
        self.last_end = end
        self.tok = self._scan(end)

    def attempt(self, parse: Callable[[], object]) -> object | None:
        """What parse gives, or None with the position as before."""
        saved = (self.tok, self.last_end, self.in_function, self.is_async, self.is_generator, self.no_in)
        try:
            return parse()
        except JsSyntaxError:
            self.tok, self.last_end, self.in_function, self.is_async, self.is_generator, self.no_in = saved
            return None

    def node(self, type: str, start: int, **fields: object) -> Node:
        return Node(type, start, self.last_end, **fields)

    # Statements

    def program(self) -> Node:
        body = []
        while self.tok.kind != "eof":
            body.append(self.statement())
        return Node("Program", 0, len(self.source), body=body)

    def block(self) -> Node:
        start = self.expect("{").start
        body = []
        while not self.is_("}"):
            if self.tok.kind == "eof":
                raise self.fail("Expected `}` but found `end of file`")
            body.append(self.statement())
        self.next()
        return self.node("BlockStatement", start, body=body)

    def statement(self) -> Node:
        tok = self.tok
        start = tok.start
        if tok.kind == "punct":
            if tok.value == "{":
                return self.block()
            if tok.value == ";":
                self.next()
                return self.node("EmptyStatement", start)
            if tok.value == "@":
                self.decorators()
                return self.statement()
        if tok.kind == "name":
            parse = getattr(self, f"_{tok.value}_statement", None) if tok.value.isalpha() and tok.value.isascii() else None
            if parse and (found := parse(start)) is not None:
                return found
            if tok.value not in RESERVED and self.peek().value == ":" and self.peek().kind == "punct":
                self.next()
                self.next()
                return self.node("LabeledStatement", start, body=self.statement())
        expression = self.expression()
        self.semicolon()
        return self.node("ExpressionStatement", start, expression=expression)

    def _parenthesised(self) -> Node:
        self.expect("(")
        e = self.expression()
        self.expect(")")
        return e

    def _var_statement(self, start: int) -> Node:
        return self.variables(start, True)

    def _const_statement(self, start: int) -> Node | None:
        if self.ts and self.peek().value == "enum":
            self.next()
            return self._enum_statement(start)
        return self.variables(start, True)

    def _let_statement(self, start: int) -> Node | None:
        after = self.peek()
        if after.kind == "name" and after.value not in ("in", "instanceof", "of") or after.value in ("[", "{"):
            return self.variables(start, True)
        return None

    def declares_resource(self, using: Token) -> bool:
        """Whether the token `using` begins a declaration: a name follows on its line."""
        after = self._scan(using.end)
        return using.kind == "name" and using.value == "using" and after.kind == "name" and not after.newline and after.value not in ("in", "instanceof", "of", "as", "satisfies")

    def _using_statement(self, start: int) -> Node | None:
        return self.variables(start, True) if self.declares_resource(self.tok) else None

    def _await_statement(self, start: int) -> Node | None:
        after = self.peek()
        if after.newline or not self.declares_resource(after):
            return None
        self.next()
        return self.variables(start, True)

    def variables(self, start: int, statement: bool) -> Node:
        kind, items = self.next().value, []
        while True:
            at = self.tok.start
            target = self.pattern()
            if self.ts:
                self.eat("!")
            self.annotation()
            init = self.assignment() if self.eat("=") else None
            items.append(self.node("VariableDeclarator", at, id=target, init=init))
            if not self.eat(","):
                break
        out = self.node("VariableDeclaration", start, kind=kind, declarations=items)
        if statement:
            for item in items:
                if item.init is None and (kind in ("const", "using") or item.id.type != "Identifier") and not self.declaring:
                    raise self.fail("Missing initializer", item.start)
            self.semicolon()
        return out

    declaring = False

    def _if_statement(self, start: int) -> Node:
        self.next()
        test = self._parenthesised()
        yes = self.statement()
        no = self.statement() if self.eat("else") else None
        return self.node("IfStatement", start, test=test, consequent=yes, alternate=no)

    def _while_statement(self, start: int) -> Node:
        self.next()
        return self.node("WhileStatement", start, test=self._parenthesised(), body=self.statement())

    def _do_statement(self, start: int) -> Node:
        self.next()
        body = self.statement()
        self.expect("while")
        test = self._parenthesised()
        self.eat(";")
        return self.node("DoWhileStatement", start, body=body, test=test)

    def _for_statement(self, start: int) -> Node:
        self.next()
        self.eat("await")
        self.expect("(")
        init = None
        saved, self.no_in = self.no_in, True
        if self.is_("var", "const") or (self.is_("let") and self.peek().kind in ("name", "punct") and self.peek().value not in ("in", "of", ";", "=", ".")):
            init = self.variables(self.tok.start, False)
        elif self.declares_resource(self.tok) or (self.is_("await") and self.declares_resource(self.peek())):
            self.eat("await")
            init = self.variables(self.tok.start, False)
        elif not self.is_(";"):
            init = self.expression()
        self.no_in = saved
        if init is not None and self.is_("of", "in"):
            kind = "ForOfStatement" if self.next().value == "of" else "ForInStatement"
            right = self.expression()
            self.expect(")")
            return self.node(kind, start, left=init, right=right, body=self.statement())
        self.expect(";")
        test = None if self.is_(";") else self.expression()
        self.expect(";")
        update = None if self.is_(")") else self.expression()
        self.expect(")")
        return self.node("ForStatement", start, init=init, test=test, update=update, body=self.statement())

    def _return_statement(self, start: int) -> Node:
        if not self.in_function:
            raise self.fail("Illegal return statement")
        self.next()
        argument = None if self.is_(";", "}") or self.tok.newline or self.tok.kind == "eof" else self.expression()
        self.semicolon()
        return self.node("ReturnStatement", start, argument=argument)

    def _throw_statement(self, start: int) -> Node:
        self.next()
        argument = self.expression()
        self.semicolon()
        return self.node("ThrowStatement", start, argument=argument)

    def _jump(self, start: int) -> Node:
        self.next()
        if self.is_name() and not self.tok.newline:
            self.next()
        self.semicolon()
        return self.node("EmptyStatement", start)

    _break_statement = _continue_statement = _debugger_statement = _jump

    def _try_statement(self, start: int) -> Node:
        self.next()
        body, handler, final = self.block(), None, None
        if self.is_("catch"):
            at = self.next().start
            param = None
            if self.eat("("):
                param = self.pattern()
                self.annotation()
                self.expect(")")
            handler = Node("CatchClause", at, at, param=param, body=self.block())
        if self.eat("finally"):
            final = self.block()
        if handler is None and final is None:
            raise self.fail("Missing catch or finally")
        return self.node("TryStatement", start, block=body, handler=handler, finalizer=final)

    def _switch_statement(self, start: int) -> Node:
        self.next()
        subject, cases = self._parenthesised(), []
        self.expect("{")
        while not self.eat("}"):
            at = self.tok.start
            if self.eat("default"):
                test = None
            else:
                self.expect("case")
                test = self.expression()
            self.expect(":")
            body = []
            while not self.is_("case", "default", "}"):
                if self.tok.kind == "eof":
                    raise self.fail()
                body.append(self.statement())
            cases.append(self.node("SwitchCase", at, test=test, consequent=body))
        return self.node("SwitchStatement", start, discriminant=subject, cases=cases)

    def _with_statement(self, start: int) -> Node:
        self.next()
        self._parenthesised()
        return self.statement()

    def _function_statement(self, start: int) -> Node:
        return self.function(start, "FunctionDeclaration")

    def _async_statement(self, start: int) -> Node | None:
        after = self.peek()
        return self.function(start, "FunctionDeclaration") if after.value == "function" and after.kind == "name" and not after.newline else None

    def _class_statement(self, start: int) -> Node:
        return self.class_(start, "ClassDeclaration")

    def _import_statement(self, start: int) -> Node | None:
        if self.peek().value in ("(", "."):
            return None
        self.next()
        type_only = False
        if self.ts and self.is_("type") and self.peek().value not in (",", "from", "=") or (self.ts and self.is_("type") and self.peek().value == "from" and self._scan(self.peek().end).value == "from"):
            self.next()
            type_only = True
        if self.tok.kind == "string":
            source = self.string()
            self._attributes()
            self.semicolon()
            return self.node("ImportDeclaration", start, specifiers=[], source=source, type_only=False)
        specifiers = []
        if self.is_name():
            at = self.tok.start
            local = self.name()
            specifiers.append(self.node("ImportDefaultSpecifier", at, local=local))
            if self.ts and self.eat("="):
                value = self.assignment()
                self.semicolon()
                target = Node("Identifier", at, at, name=local)
                return self.node("VariableDeclaration", start, kind="const", declarations=[self.node("VariableDeclarator", at, id=target, init=value)])
            if not self.is_("from"):
                self.expect(",")
        if self.is_("*"):
            at = self.next().start
            self.expect("as")
            specifiers.append(self.node("ImportNamespaceSpecifier", at, local=self.name()))
        elif self.eat("{"):
            while not self.eat("}"):
                at = self.tok.start
                if self.ts and self.is_("type") and self.peek().value not in (",", "}", "as"):
                    self.next()
                imported = self.module_name()
                local = self.name() if self.eat("as") else imported
                specifiers.append(self.node("ImportSpecifier", at, imported=imported, local=local))
                if not self.is_("}"):
                    self.expect(",")
        self.expect("from")
        source = self.string()
        self._attributes()
        self.semicolon()
        return self.node("ImportDeclaration", start, specifiers=specifiers, source=source, type_only=type_only)

    def _attributes(self) -> None:
        if self.is_("with", "assert") and not self.tok.newline:
            self.next()
            self.object(self.tok.start)

    def module_name(self) -> str:
        if self.tok.kind == "string":
            return self.string()
        if self.tok.kind != "name":
            raise self.fail()
        return self.next().value

    def string(self) -> str:
        if self.tok.kind != "string":
            raise self.fail("Expected a string")
        tok = self.next()
        return cooked(self.source[tok.start + 1 : tok.end - 1])

    def _export_statement(self, start: int) -> Node:
        self.next()
        if self.ts and self.eat("="):
            value = self.assignment()
            self.semicolon()
            return self.node("ExpressionStatement", start, expression=value)
        if self.ts and self.is_("as") and self.peek().value == "namespace":
            self.next()
            self.next()
            self.name()
            self.semicolon()
            return self.node("EmptyStatement", start)
        if self.ts and self.is_("type") and self.peek().value in ("{", "*"):
            self.next()
        if self.eat("default"):
            at = self.tok.start
            if self.is_("function") or (self.is_("async") and self.peek().value == "function"):
                value = self.function(at, "FunctionDeclaration")
            elif self.is_("class") or self.is_("@") or (self.ts and self.is_("abstract") and self.peek().value == "class"):
                if self.is_("@"):
                    self.decorators()
                self.eat("abstract")
                value = self.class_(at, "ClassDeclaration")
            elif self.ts and self.is_("interface"):
                value = self.statement()
            else:
                value = self.assignment()
                self.semicolon()
            return self.node("ExportDefaultDeclaration", start, declaration=value)
        if self.eat("*"):
            exported = self.module_name() if self.eat("as") else None
            self.expect("from")
            source = self.string()
            self._attributes()
            self.semicolon()
            return self.node("ExportAllDeclaration", start, source=source, exported=exported)
        if self.eat("{"):
            specifiers = []
            while not self.eat("}"):
                if self.ts and self.is_("type") and self.peek().value not in (",", "}", "as"):
                    self.next()
                local = self.module_name()
                specifiers.append((local, self.module_name() if self.eat("as") else local))
                if not self.is_("}"):
                    self.expect(",")
            if self.eat("from"):
                source = self.string()
                self._attributes()
                self.semicolon()
                return self.node("ExportFromDeclaration", start, specifiers=specifiers, source=source)
            self.semicolon()
            return self.node("ExportNamedDeclaration", start, specifiers=specifiers)
        declaration = self.statement()
        if declaration.type == "ExpressionStatement":
            raise self.fail("Expected a declaration", start)
        return self.node("ExportDeclaration", start, declaration=declaration)

    # TypeScript statements

    def _type_statement(self, start: int) -> Node | None:
        after = self.peek()
        if not self.ts or after.kind != "name" or after.newline:
            return None
        self.next()
        self.name()
        self.type_parameters()
        self.expect("=")
        self.type()
        self.semicolon()
        return self.node("EmptyStatement", start)

    def _interface_statement(self, start: int) -> Node | None:
        if not self.ts or self.peek().kind != "name":
            return None
        self.next()
        self.name()
        self.type_parameters()
        if self.eat("extends"):
            self.type()
            while self.eat(","):
                self.type()
        self.type_members()
        return self.node("EmptyStatement", start)

    def _enum_statement(self, start: int) -> Node:
        if not self.ts:
            raise self.fail()
        self.expect("enum")
        name = self.name()
        self.expect("{")
        while not self.eat("}"):
            if self.tok.kind == "string":
                self.string()
            elif self.is_("["):
                self.next()
                self.expression()
                self.expect("]")
            else:
                self.next()
            if self.eat("="):
                self.assignment()
            if not self.is_("}"):
                self.expect(",")
        return self.node("EnumDeclaration", start, name=name)

    def _declare_statement(self, start: int) -> Node | None:
        after = self.peek()
        if not self.ts or after.kind != "name" or after.newline:
            return None
        self.next()
        saved, self.declaring = self.declaring, True
        if self.is_("global") and self.peek().value == "{":
            self.next()
            self.block()
        else:
            self.statement()
        self.declaring = saved
        return self.node("EmptyStatement", start)

    def _namespace_statement(self, start: int) -> Node | None:
        after = self.peek()
        if not self.ts or after.kind not in ("name", "string") or after.newline:
            return None
        self.next()
        if self.tok.kind == "string":
            self.string()
        else:
            self.name()
            while self.eat("."):
                self.name()
        if self.is_("{"):
            body = self.block()
            return self.node("StaticBlock", start, body=body)
        self.semicolon()
        return self.node("EmptyStatement", start)

    _module_statement = _namespace_statement

    def _abstract_statement(self, start: int) -> Node | None:
        if not self.ts or self.peek().value != "class":
            return None
        self.next()
        return self.class_(start, "ClassDeclaration")

    # Functions and classes

    def function(self, start: int, type: str) -> Node:
        is_async = self.eat("async")
        self.expect("function")
        generator = self.eat("*")
        name = self.name() if self.is_name() else None
        return self.function_rest(start, type, name, is_async, generator)

    def function_rest(self, start: int, type: str, name: str | None, is_async: bool, generator: bool) -> Node:
        self.type_parameters()
        saved = (self.in_function, self.is_async, self.is_generator, self.no_in)
        self.in_function, self.is_async, self.is_generator, self.no_in = self.in_function + 1, is_async, generator, False
        params = self.parameters()
        self.annotation(returns=True)
        body = None
        if self.is_("{"):
            body = self.block()
        elif self.ts and type != "FunctionExpression" or self.ts and self.declaring:
            self.semicolon()
        else:
            raise self.fail("Expected a function body")
        self.in_function, self.is_async, self.is_generator, self.no_in = saved
        return self.node(type, start, id=name, params=params, body=body)

    def parameters(self) -> list[Node]:
        self.expect("(")
        params = []
        while not self.eat(")"):
            while self.is_("@"):
                self.decorators()
            while self.ts and self.tok.kind == "name" and self.tok.value in _MODIFIERS and self.peek().value not in (",", ")", ":", "=", "?"):
                self.next()
            if self.ts and self.is_("this") and self.peek().value in (":", ",", ")"):
                self.next()
                self.annotation()
            else:
                params.append(self.parameter())
            if not self.is_(")"):
                self.expect(",")
        return params

    def parameter(self) -> Node:
        start = self.tok.start
        rest = self.eat("...")
        target = self.pattern()
        if self.ts:
            self.eat("?")
        self.annotation()
        if rest:
            return self.node("RestElement", start, argument=target)
        if self.eat("="):
            return self.node("AssignmentPattern", start, left=target, right=self.assignment())
        return target

    def pattern(self) -> Node:
        start = self.tok.start
        if self.eat("["):
            elements = []
            while not self.eat("]"):
                if self.is_(","):
                    elements.append(None)
                else:
                    elements.append(self.parameter())
                if not self.is_("]"):
                    self.expect(",")
            return self.node("ArrayPattern", start, elements=elements)
        if self.eat("{"):
            properties, rest = [], None
            while not self.eat("}"):
                if self.eat("..."):
                    rest = self.pattern()
                else:
                    at = self.tok.start
                    plain = self.is_name()
                    key = self.property_key()
                    if self.eat(":"):
                        value = self.parameter()
                    elif plain:
                        value = Node("Identifier", at, self.last_end, name=key.name)
                        if self.eat("="):
                            value = self.node("AssignmentPattern", at, left=value, right=self.assignment())
                    else:
                        raise self.fail()
                    properties.append((key, value))
                if not self.is_("}"):
                    self.expect(",")
            return self.node("ObjectPattern", start, properties=properties, rest=rest)
        return self.node("Identifier", start, name=self.name())

    def property_key(self) -> Node:
        """StaticKey (name), StringKey (value), or another kind that no rule names."""
        tok = self.tok
        if tok.kind == "name":
            self.next()
            return self.node("StaticKey", tok.start, name=tok.value)
        if tok.kind == "string":
            return self.node("StringKey", tok.start, value=self.string())
        if tok.kind in ("number", "private"):
            self.next()
            return self.node("OtherKey", tok.start, expression=None)
        self.expect("[")
        saved, self.no_in = self.no_in, False
        e = self.assignment()
        self.no_in = saved
        self.expect("]")
        return self.node("OtherKey", tok.start, expression=e)

    def decorators(self) -> None:
        while self.eat("@"):
            self.subscripts(self.primary(), calls=True)

    def class_(self, start: int, type: str) -> Node:
        self.expect("class")
        name = self.name() if self.is_name() and not (self.is_("implements") and self.ts) else None
        self.type_parameters()
        parent = None
        if self.eat("extends"):
            parent = self.left_hand_side()
            if self.ts and self.is_("<"):
                self.type_arguments()
        if self.ts and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.expect("{")
        members = []
        while not self.eat("}"):
            if not self.eat(";"):
                members += self.member()
        return self.node(type, start, id=name, parent=parent, members=members)

    def member(self) -> list[Node]:
        while self.is_("@"):
            self.decorators()
        start = self.tok.start
        words: set[str] = set()
        while self.tok.kind == "name" and self.tok.value in _MODIFIERS:
            after = self.peek()
            if after.value in ("(", "=", ";", "}", ",", ":", "?", "!", "<") or (after.newline and self.tok.value not in ("static", "public", "private", "protected", "readonly", "abstract", "override")):
                break
            words.add(self.next().value)
            if words == {"static"} and self.is_("{"):
                saved, self.in_function = self.in_function, 0
                body = self.block()
                self.in_function = saved
                return [self.node("StaticBlock", start, body=body)]
        generator = self.eat("*")
        if self.ts and self.is_("["):  # an index signature, unless it is a computed name
            if self.attempt(self._index_signature):
                return []
        key = self.property_key()
        if self.ts:
            self.eat("?") or self.eat("!")
        if self.is_("(", "<"):
            value = self.function_rest(self.tok.start, "Method", None, "async" in words, generator)
            kind = "constructor" if key.type in ("StaticKey", "StringKey") and getattr(key, "name", getattr(key, "value", None)) == "constructor" and "static" not in words else "method"
            return [self.node("MethodDefinition", start, key=key, value=value, kind=kind, abstract="abstract" in words)]
        self.annotation()
        saved = (self.in_function, self.is_async)
        self.is_async = False
        value = self.assignment() if self.eat("=") else None
        self.in_function, self.is_async = saved
        self.semicolon()
        return [self.node("PropertyDefinition", start, key=key, value=value)]

    def _index_signature(self) -> bool:
        self.expect("[")
        self.name()
        self.expect(":")
        self.type()
        self.expect("]")
        self.annotation()
        self.semicolon()
        return True

    # Expressions

    def expression(self) -> Node:
        start = self.tok.start
        first = self.assignment()
        if not self.is_(","):
            return first
        items = [first]
        while self.eat(","):
            items.append(self.assignment())
        return self.node("SequenceExpression", start, expressions=items)

    def assignment(self) -> Node:
        start, tok = self.tok.start, self.tok
        if tok.kind == "name" and tok.value == "yield" and self.is_generator:
            self.next()
            star = self.eat("*")
            value = None if not star and (self.tok.newline or self.is_(")", "]", "}", ",", ";", ":") or self.tok.kind == "eof") else self.assignment()
            return self.node("YieldExpression", start, argument=value)
        if arrow := self.arrow():
            return arrow
        left = self.conditional()
        if self.tok.kind == "punct" and self.tok.value in _ASSIGN:
            target = left
            while target.type in ("ParenthesizedExpression", "TSExpression"):
                target = target.expression
            if target.type not in ("Identifier", "MemberExpression", "ObjectExpression", "ArrayExpression"):
                raise self.fail("Invalid assignment target", start)
            operator = self.next().value
            return self.node("AssignmentExpression", start, operator=operator, left=target, right=self.assignment())
        return left

    def arrow(self) -> Node | None:
        tok = self.tok
        start = tok.start
        if tok.kind == "name" and tok.value not in RESERVED:
            after = self.peek()
            if after.value == "=>" and not after.newline:
                target = self.node("Identifier", start, name=self.name())
                return self.arrow_body(start, [target], False)
            if tok.value != "async" or after.newline:
                return None
            if after.kind == "name" and after.value not in RESERVED and self._scan(after.end).value == "=>":
                self.next()
                at = self.tok.start
                return self.arrow_body(start, [self.node("Identifier", at, name=self.name())], True)
            if after.value not in ("(", "<"):
                return None
        elif not (tok.kind == "punct" and (tok.value == "(" or tok.value == "<" and self.ts)):
            return None
        if start in self.not_arrows:
            return None
        found = self.attempt(lambda: self._arrow_head(start))
        if found is None:
            self.not_arrows.add(start)
            return None
        return self.arrow_body(start, *found)

    def _arrow_head(self, start: int) -> tuple[list[Node], bool]:
        is_async = self.eat("async")
        if self.ts:
            self.type_parameters()
        saved, self.is_async = self.is_async, is_async or self.is_async
        params = self.parameters()
        self.is_async = saved
        if self.ts and self.is_(":"):
            self.annotation(returns=True)
        if not self.is_("=>") or self.tok.newline:
            raise self.fail()
        return params, is_async

    def arrow_body(self, start: int, params: list[Node], is_async: bool) -> Node:
        self.expect("=>")
        saved = (self.in_function, self.is_async, self.is_generator, self.no_in)
        self.is_async, self.is_generator = is_async, False
        if self.is_("{"):
            self.in_function += 1
            self.no_in = False
            body, expression = self.block(), False
        else:
            body, expression = self.assignment(), True
        self.in_function, self.is_async, self.is_generator, self.no_in = saved
        return self.node("ArrowFunctionExpression", start, params=params, body=body, expression=expression)

    def conditional(self) -> Node:
        start = self.tok.start
        test = self.binary(self.unary(), 0, start)
        if not self.is_("?"):
            return test
        self.next()
        saved, self.no_in = self.no_in, False
        yes = self._conditional_branch()
        self.no_in = saved
        self.expect(":")
        return self.node("ConditionalExpression", start, test=test, consequent=yes, alternate=self.assignment())

    def _conditional_branch(self) -> Node:
        """With types, `a ? (b) : c => d` may read as an arrow with a return type; such a reading must leave a colon."""
        if not self.ts or not self.is_("(", "async", "<"):
            return self.assignment()
        start = self.tok.start

        def with_colon() -> Node:
            found = self.assignment()
            if not self.is_(":"):
                raise self.fail()
            return found

        if (found := self.attempt(with_colon)) is not None:
            return found
        self.not_arrows.add(start)
        return self.assignment()

    def binary(self, left: Node, least: int, start: int) -> Node:
        while True:
            tok = self.tok
            if self.ts and tok.kind == "name" and tok.value in ("as", "satisfies") and not tok.newline and least < 8:
                self.next()
                if not self.eat("const"):
                    self.type()
                left = self.node("TSExpression", start, expression=left)
                continue
            if tok.kind not in ("punct", "name") or (level := _BINARY.get(tok.value)) is None or level <= least and not (tok.value == "**" and level == least):
                return left
            if tok.value == "in" and self.no_in:
                return left
            self.next()
            at = self.tok.start
            right = self.binary(self.unary(), level - (tok.value == "**"), at)
            kind = "LogicalExpression" if tok.value in ("&&", "||", "??") else "BinaryExpression"
            left = self.node(kind, start, operator=tok.value, left=left, right=right)

    def unary(self) -> Node:
        tok = self.tok
        start = tok.start
        if tok.kind == "punct":
            if tok.value in ("!", "~", "+", "-"):
                self.next()
                return self.node("UnaryExpression", start, operator=tok.value, argument=self.unary())
            if tok.value in ("++", "--"):
                self.next()
                return self.node("UpdateExpression", start, argument=self.unary())
            if tok.value == "<" and self.ts and not self.jsx:
                self.type_arguments()
                return self.node("TSExpression", start, expression=self.unary())
        elif tok.kind == "name":
            if tok.value in ("typeof", "void", "delete"):
                self.next()
                return self.node("UnaryExpression", start, operator=tok.value, argument=self.unary())
            if tok.value == "await" and self.is_async and (after := self.peek()).value not in (")", "]", "}", ",", ";", "=", ":", ".", "=>", "?", "in", "of") and after.kind != "eof":
                self.next()
                return self.node("AwaitExpression", start, argument=self.unary())
        if tok.kind == "private":  # #x in object
            self.next()
            if not self.is_("in"):
                raise self.fail()
            return self.node("PrivateName", start)
        out = self.left_hand_side()
        if self.is_("++", "--") and not self.tok.newline:
            self.next()
            return self.node("UpdateExpression", start, argument=out)
        return out

    def left_hand_side(self) -> Node:
        return self.subscripts(self.primary(), calls=True)

    def subscripts(self, out: Node, calls: bool) -> Node:
        start, chain = out.start, False
        while True:
            tok = self.tok
            if tok.kind == "template":
                self.template()
                out = self.node("TaggedTemplateExpression", start, tag=out)
                continue
            if tok.kind != "punct":
                break
            if tok.value == "?.":
                if not calls:
                    break
                self.next()
                chain = True
                if self.is_("("):
                    out = self.node("CallExpression", start, callee=out, arguments=self.arguments())
                    continue
                if self.is_("["):
                    tok = self.tok
                elif self.tok.kind == "template":
                    raise self.fail()
                else:
                    out = self.dot(out, start)
                    continue
            if tok.value == ".":
                self.next()
                out = self.dot(out, start)
            elif tok.value == "[":
                self.next()
                saved, self.no_in = self.no_in, False
                e = self.expression()
                self.no_in = saved
                self.expect("]")
                out = self.node("MemberExpression", start, object=out, property=e, computed=True)
            elif tok.value == "(" and calls:
                out = self.node("CallExpression", start, callee=out, arguments=self.arguments())
            elif tok.value == "!" and self.ts and not tok.newline:
                self.next()
                out = self.node("TSExpression", start, expression=out)
            elif tok.value in ("<", "<<") and self.ts and (self.attempt(self._call_type_arguments)):
                out = self.node("TSExpression", start, expression=out) if not self.is_("(") and self.tok.kind != "template" else out
            else:
                break
        return self.node("ChainExpression", start, expression=out) if chain else out

    def _call_type_arguments(self) -> bool:
        self.type_arguments()
        tok = self.tok
        starts_operand = tok.kind in ("number", "string", "private") or tok.kind == "name" and tok.value not in ("as", "satisfies", "in", "instanceof", "of") or tok.value in ("[", "{", "!", "~")
        if starts_operand and not tok.newline and tok.value not in ("(",):
            raise self.fail()
        return True

    def dot(self, target: Node, start: int) -> Node:
        if self.tok.kind not in ("name", "private"):
            raise self.fail("Expected a property name")
        tok = self.next()
        return self.node("MemberExpression", start, object=target, property=tok.value, computed=False)

    def arguments(self) -> list[Node]:
        self.expect("(")
        saved, self.no_in = self.no_in, False
        out = []
        while not self.eat(")"):
            out.append(self.spread_or_assignment())
            if not self.is_(")"):
                self.expect(",")
        self.no_in = saved
        return out

    def spread_or_assignment(self) -> Node:
        start = self.tok.start
        if self.eat("..."):
            return self.node("SpreadElement", start, argument=self.assignment())
        return self.assignment()

    def primary(self) -> Node:
        tok = self.tok
        start = tok.start
        if tok.kind == "string":
            return self._string_literal()
        if tok.kind == "number":
            self.next()
            return self.node("NumericLiteral", start)
        if tok.kind == "template":
            return self.template()
        if tok.kind == "punct":
            if tok.value == "(":
                self.next()
                saved, self.no_in = self.no_in, False
                e = self.expression()
                self.no_in = saved
                self.expect(")")
                return self.node("ParenthesizedExpression", start, expression=e)
            if tok.value == "[":
                return self.array(start)
            if tok.value == "{":
                return self.object(start)
            if tok.value in ("/", "/="):
                if not (m := _REGEX.match(self.source, start)):
                    raise self.fail("Unterminated regular expression")
                self.last_end = m.end()
                self.tok = self._scan(m.end())
                return self.node("RegExpLiteral", start)
            if tok.value == "<" and self.jsx:
                return self.jsx_element(start)
            if tok.value == "@":
                self.decorators()
                return self.class_(start, "ClassExpression")
            raise self.fail()
        if tok.kind != "name":
            raise self.fail("Unexpected end of file" if tok.kind == "eof" else "Unexpected token")
        match tok.value:
            case "function":
                return self.function(start, "FunctionExpression")
            case "async" if (after := self.peek()).value == "function" and not after.newline:
                return self.function(start, "FunctionExpression")
            case "class":
                return self.class_(start, "ClassExpression")
            case "new":
                return self.new(start)
            case "import":
                return self.import_expression(start)
            case "true" | "false":
                self.next()
                return self.node("BooleanLiteral", start, value=tok.value == "true")
            case "null":
                self.next()
                return self.node("NullLiteral", start)
            case "this":
                self.next()
                return self.node("ThisExpression", start)
            case "super":
                self.next()
                return self.node("Super", start)
        if tok.value in RESERVED:
            raise self.fail()
        self.next()
        return self.node("Identifier", start, name=tok.value)

    def _string_literal(self) -> Node:
        start = self.tok.start
        value = self.string()
        return self.node("StringLiteral", start, value=value)

    def import_expression(self, start: int) -> Node:
        self.next()
        if self.eat("."):
            if self.tok.kind != "name":
                raise self.fail()
            self.next()
            if not self.is_("("):
                return self.node("MetaProperty", start)
        arguments = self.arguments()
        if not arguments:
            raise self.fail("Expected a module specifier")
        return self.node("ImportExpression", start, source=arguments[0], options=arguments[1:])

    def new(self, start: int) -> Node:
        self.next()
        if self.eat("."):
            self.name()
            return self.node("MetaProperty", start)
        at = self.tok.start
        callee = self.new(at) if self.is_("new") else self.primary()
        callee = self.subscripts(callee, calls=False)
        if self.ts and self.is_("<"):
            self.attempt(self.type_arguments_true)
        return self.node("NewExpression", start, callee=callee, arguments=self.arguments() if self.is_("(") else [])

    def type_arguments_true(self) -> bool:
        self.type_arguments()
        return True

    def array(self, start: int) -> Node:
        self.expect("[")
        saved, self.no_in = self.no_in, False
        elements = []
        while not self.eat("]"):
            if self.is_(","):
                self.next()
                elements.append(None)
                continue
            elements.append(self.spread_or_assignment())
            if not self.is_("]"):
                self.expect(",")
        self.no_in = saved
        return self.node("ArrayExpression", start, elements=elements)

    def object(self, start: int) -> Node:
        self.expect("{")
        saved, self.no_in = self.no_in, False
        properties = []
        while not self.eat("}"):
            properties.append(self.property())
            if not self.is_("}"):
                self.expect(",")
        self.no_in = saved
        return self.node("ObjectExpression", start, properties=properties)

    def property(self) -> Node:
        start = self.tok.start
        if self.eat("..."):
            return self.node("SpreadElement", start, argument=self.assignment())
        is_async = generator = False
        if self.is_("async") and self.peek().value not in (",", ":", "(", "}", "=", "<") and not self.peek().newline:
            self.next()
            is_async = True
        if self.eat("*"):
            generator = True
        elif self.is_("get", "set") and self.peek().value not in (",", ":", "(", "}", "=", "<"):
            self.next()
            key = self.property_key()
            return self.node("Property", start, key=key, value=self.function_rest(self.tok.start, "FunctionExpression", None, False, False), shorthand=False)
        plain = self.is_name()
        key = self.property_key()
        if self.is_("(", "<"):
            return self.node("Property", start, key=key, value=self.function_rest(self.tok.start, "FunctionExpression", None, is_async, generator), shorthand=False)
        if self.eat(":"):
            return self.node("Property", start, key=key, value=self.assignment(), shorthand=False)
        if not plain or is_async or generator:
            raise self.fail()
        value = Node("Identifier", key.start, key.end, name=key.name)
        if self.eat("="):  # only valid where the object turns out to be a pattern
            self.assignment()
        return self.node("Property", start, key=key, value=value, shorthand=True)

    def template(self) -> Node:
        start = self.tok.start
        at = self.tok.end
        quasis, expressions = [], []
        while True:
            m = _TEMPLATE.match(self.source, at)
            quasis.append(cooked(m[0].replace("\r\n", "\n")))
            at = m.end()
            if self.source.startswith("`", at):
                self.last_end = at + 1
                self.tok = self._scan(at + 1)
                return self.node("TemplateLiteral", start, quasis=quasis, expressions=expressions)
            if not self.source.startswith("${", at):
                raise self.fail("Unterminated template", start)
            self.tok = self._scan(at + 2)
            saved, self.no_in = self.no_in, False
            expressions.append(self.expression())
            self.no_in = saved
            if not self.is_("}"):
                raise self.fail()
            at = self.tok.end

    # JSX

    def jsx_element(self, start: int) -> Node:
        """Everything inside is kept as a list of expressions."""
        inner: list[Node] = []
        self.last_end = self._jsx(start, inner)
        self.tok = self._scan(self.last_end)
        return self.node("JSXElement", start, expressions=inner)

    def _jsx(self, at: int, inner: list[Node]) -> int:
        src = self.source
        at = _SKIP.match(src, at + 1).end()
        name = _JSX_NAME.match(src, at)
        at = name.end() if name else at
        if name and self.ts:
            after = _SKIP.match(src, at).end()
            if src.startswith("<", after):
                self.tok = self._scan(after)
                self.type_arguments()
                at = self.last_end
        while name:
            at = _SKIP.match(src, at).end()
            if src.startswith("{", at):
                at = self._jsx_braces(at, inner)
            elif m := _JSX_NAME.match(src, at):
                at = _SKIP.match(src, m.end()).end()
                if src.startswith("=", at):
                    at = _SKIP.match(src, at + 1).end()
                    if src[at : at + 1] in ("'", '"'):
                        end = src.find(src[at], at + 1)
                        if end < 0:
                            raise self.fail("Unterminated attribute", at)
                        at = end + 1
                    elif src.startswith("{", at):
                        at = self._jsx_braces(at, inner)
                    elif src.startswith("<", at):
                        at = self._jsx(at, inner)
                    else:
                        raise self.fail("Expected an attribute value", at)
            else:
                break
        if src.startswith("/", at):
            at = _SKIP.match(src, at + 1).end()
            if not src.startswith(">", at):
                raise self.fail("Expected `>`", at)
            return at + 1
        if not src.startswith(">", at):
            raise self.fail("Expected `>`", at)
        at += 1
        while True:
            at = _JSX_TEXT.match(src, at).end()
            if src.startswith("{", at):
                at = self._jsx_braces(at, inner)
            elif m := regex.compile(r"<\s*/").match(src, at):
                at = _SKIP.match(src, m.end()).end()
                close = _JSX_NAME.match(src, at)
                if (close[0] if close else "") != (name[0] if name else ""):
                    raise self.fail("Expected a matching closing tag", at)
                at = _SKIP.match(src, close.end() if close else at).end()
                if not src.startswith(">", at):
                    raise self.fail("Expected `>`", at)
                return at + 1
            elif src.startswith("<", at):
                at = self._jsx(at, inner)
            else:
                raise self.fail("Unterminated element", at)

    def _jsx_braces(self, at: int, inner: list[Node]) -> int:
        self.tok = self._scan(at + 1)
        if self.eat("..."):
            pass
        if not self.is_("}"):
            inner.append(self.expression())
        if not self.is_("}"):
            raise self.fail()
        return self.tok.end

    # Types

    def annotation(self, returns: bool = False) -> None:
        if self.ts and self.is_(":"):
            self.next()
            if returns and (self.is_("asserts") or self.is_name() or self.is_("this")):
                if self.attempt(self._predicate):
                    return
            self.type()

    def _predicate(self) -> bool:
        asserts = False
        if self.is_("asserts") and self.peek().kind == "name" and self.peek().value != "is" and not self.peek().newline:
            self.next()
            asserts = True
        self.next()
        if self.is_("is") and not self.tok.newline:
            self.next()
            self.type()
        elif not asserts:
            raise self.fail()
        return True

    def type_parameters(self) -> None:
        if not (self.ts and self.is_("<")):
            return
        self.next()
        while not (self.tok.kind == "punct" and self.tok.value.startswith(">")):
            while self.is_("const", "in", "out") and self.peek().kind == "name":
                self.next()
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(","):
                break
        self.split(">")

    def type_arguments(self) -> None:
        self.split("<")
        while not (self.tok.kind == "punct" and self.tok.value.startswith(">")):
            self.type()
            if not self.eat(","):
                break
        self.split(">")

    def type(self) -> None:
        if self.is_("new") or self.is_("<") or (self.is_("abstract") and self.peek().value == "new"):
            self.eat("abstract")
            self.eat("new")
            self._function_type()
            return
        if self.is_("(") and self.attempt(self._function_type):
            return
        self._union()
        if self.is_("extends") and not self.tok.newline and not self.no_conditional:
            self.next()
            saved, self.no_conditional = self.no_conditional, True
            self.type()
            self.no_conditional = False
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()
            self.no_conditional = saved

    no_conditional = False

    def _function_type(self) -> bool:
        self.type_parameters()
        self.parameters()
        self.expect("=>")
        if self.is_("asserts") or self.is_name() or self.is_("this"):
            if self.attempt(self._predicate):
                return True
        self.type()
        return True

    def _union(self) -> None:
        self.eat("|") or self.eat("&")
        self._prefixed()
        while self.eat("|") or self.eat("&"):
            if self.is_("new", "<") or self.is_("(") and self.attempt(self._function_type):
                if self.is_("new", "<"):
                    self.type()
                continue
            self._prefixed()

    def _prefixed(self) -> None:
        while self.is_("keyof", "unique", "readonly", "infer") and self.peek().value not in (",", ")", "]", "}", ";", ">", "=", "|", "&", "[", "?", ":", "extends") or (self.is_("keyof", "readonly") and self.peek().value in ("[", "(")):
            infer = self.next().value == "infer"
            if infer:
                self.name()
                if self.is_("extends"):
                    self.attempt(self._infer_constraint)
                return self._postfix()
        if self.is_("typeof"):
            self.next()
            if self.is_("import"):
                self._import_type()
            else:
                self.next()
                while self.eat("."):
                    self.next()
                if self.is_("<") and not self.tok.newline:
                    self.type_arguments()
            return self._postfix()
        self._primary_type()
        self._postfix()

    def _infer_constraint(self) -> bool:
        self.expect("extends")
        saved, self.no_conditional = self.no_conditional, True
        self.type()
        self.no_conditional = saved
        if self.is_("?") and not self.no_conditional:
            raise self.fail()
        return True

    def _postfix(self) -> None:
        while self.is_("[") and not self.tok.newline:
            self.next()
            if not self.is_("]"):
                self.type()
            self.expect("]")

    def _import_type(self) -> None:
        self.next()
        self.arguments()
        while self.eat("."):
            self.next()
        if self.is_("<"):
            self.type_arguments()

    def _primary_type(self) -> None:
        tok = self.tok
        if tok.kind in ("string", "number"):
            self.next()
        elif tok.kind == "template":
            self._template_type()
        elif self.is_("-") and self.peek().kind == "number":
            self.next()
            self.next()
        elif self.is_("("):
            self.next()
            saved, self.no_conditional = self.no_conditional, False
            self.type()
            self.no_conditional = saved
            self.expect(")")
        elif self.is_("["):
            self.next()
            while not self.eat("]"):
                self.eat("...")
                if self.tok.kind == "name" and (self.peek().value == ":" or self.peek().value == "?" and self._scan(self.peek().end).value == ":"):
                    self.next()
                    self.eat("?")
                    self.expect(":")
                    self.eat("...")
                self.type()
                self.eat("?")
                if not self.is_("]"):
                    self.expect(",")
        elif self.is_("{"):
            self.type_members()
        elif self.is_("import"):
            self._import_type()
        elif tok.kind == "name" and (tok.value not in RESERVED or tok.value in ("void", "null", "this", "true", "false")):
            self.next()
            while self.eat("."):
                self.next()
            if self.is_("<") and not self.tok.newline:
                self.type_arguments()
        else:
            raise self.fail("Expected a type")

    def _template_type(self) -> None:
        at = self.tok.end
        while True:
            at = _TEMPLATE.match(self.source, at).end()
            if self.source.startswith("`", at):
                self.last_end = at + 1
                self.tok = self._scan(at + 1)
                return
            if not self.source.startswith("${", at):
                raise self.fail("Unterminated template")
            self.tok = self._scan(at + 2)
            self.type()
            if not self.is_("}"):
                raise self.fail()
            at = self.tok.end

    def type_members(self) -> None:
        self.expect("{")
        while not self.eat("}"):
            if self.eat(";") or self.eat(","):
                continue
            if self.is_("+", "-"):
                self.next()
            while self.is_("readonly", "get", "set", "new", "async") and self.peek().value not in ("(", ":", "?", ";", ",", "}", "<"):
                self.next()
            if self.is_("new") and self.peek().value in ("(", "<"):
                self.next()
            if self.is_("["):
                self.next()
                if self.tok.kind == "name" and self.peek().value in (":", "in"):
                    self.next()
                    self.next()
                    self.type()
                    if self.eat("as"):
                        self.type()
                else:
                    self.expression()
                self.expect("]")
            elif not self.is_("(", "<"):
                if self.tok.kind == "eof" or self.tok.kind == "punct":
                    raise self.fail()
                self.next()
            if self.is_("+", "-"):
                self.next()
            self.eat("?")
            if self.is_("(", "<"):
                self.type_parameters()
                self.parameters()
            self.annotation(returns=True)
            if not self.is_("}"):
                if not (self.eat(";") or self.eat(",") or self.tok.newline):
                    raise self.fail()


def parse(source: str, **options: bool) -> Node:
    """The tree of a program; JsSyntaxError for what isn't one."""
    return Parser(source, **options).program()
