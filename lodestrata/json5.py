"""A small JSON5 reader. Objects keep their keys sorted, the order in which their entries are reported."""

from __future__ import annotations

import regex

MAX_NESTING = 128
_GAP = regex.compile(r"(?:[\s\uFEFF]|//[^\n\r\u2028\u2029]*|/\*.*?\*/)*", regex.S)
_NUMBER = regex.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|Infinity|NaN|(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
_NAME = regex.compile(r"[\p{L}\p{Nl}$_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}$_\u200C\u200D]*")
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
_WORDS = {"true": True, "false": False, "null": None}


class Json5Error(ValueError):
    pass


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, what: str) -> Json5Error:
        line = self.text.count("\n", 0, self.at) + 1
        column = self.at - (self.text.rfind("\n", 0, self.at) + 1) + 1
        return Json5Error(f"{what} at line {line} column {column}")

    def gap(self) -> str:
        self.at = _GAP.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def value(self, depth: int) -> object:
        if depth > MAX_NESTING:
            raise self.fail("too deeply nested")
        c = self.gap()
        if c == "{":
            return self.object(depth)
        if c == "[":
            return self.array(depth)
        if c and c in "\"'":
            return self.string(c)
        if m := _NUMBER.match(self.text, self.at):
            self.at = m.end()
            return self.number(m[0])
        if (m := _NAME.match(self.text, self.at)) and m[0] in _WORDS:
            self.at = m.end()
            return _WORDS[m[0]]
        raise self.fail("expected a value")

    @staticmethod
    def number(text: str) -> float | int:
        sign, bare = (-1 if text[0] == "-" else 1), text.lstrip("+-")
        if bare[:2] in ("0x", "0X"):
            return sign * int(bare, 16)
        if bare in ("Infinity", "NaN"):
            return sign * float(bare.replace("Infinity", "inf"))
        return sign * (int(bare) if bare.isdigit() else float(bare))

    def string(self, quote: str) -> str:
        out, self.at = [], self.at + 1
        while True:
            c = self.text[self.at : self.at + 1]
            if not c or c in "\n\r":
                raise self.fail("unterminated string")
            self.at += 1
            if c == quote:
                break
            if c != "\\":
                out.append(c)
                continue
            c = self.text[self.at : self.at + 1]
            self.at += 1
            if c in ("x", "u"):
                width = 2 if c == "x" else 4
                digits = self.text[self.at : self.at + width]
                if len(digits) < width or not regex.fullmatch("[0-9a-fA-F]+", digits):
                    raise self.fail("bad escape")
                out.append(chr(int(digits, 16)))
                self.at += width
            elif c == "\r" and self.text[self.at : self.at + 1] == "\n":
                self.at += 1
            elif c not in ("\n", "\r", "\u2028", "\u2029"):
                out.append(_ESCAPES.get(c, c))
        joined = "".join(out)
        try:
            return joined.encode("utf-16", "surrogatepass").decode("utf-16")
        except UnicodeDecodeError as error:
            raise self.fail("lone surrogate") from error

    def object(self, depth: int) -> dict[str, object]:
        out: dict[str, object] = {}
        self.at += 1
        while (c := self.gap()) != "}":
            if c and c in "\"'":
                key = self.string(c)
            elif m := _NAME.match(self.text, self.at):
                key, self.at = m[0], m.end()
            else:
                raise self.fail("expected a key")
            if self.gap() != ":":
                raise self.fail("expected a colon")
            self.at += 1
            out[key] = self.value(depth + 1)
            self.separator("}")
        self.at += 1
        return dict(sorted(out.items()))

    def array(self, depth: int) -> list[object]:
        out: list[object] = []
        self.at += 1
        while self.gap() != "]":
            out.append(self.value(depth + 1))
            self.separator("]")
        self.at += 1
        return out

    def separator(self, close: str) -> None:
        if (c := self.gap()) == ",":
            self.at += 1
        elif c != close:
            raise self.fail(f"expected a comma or {close}")


def loads(text: str) -> object:
    """The value of a JSON5 text; Json5Error says where it went wrong."""
    reader = _Reader(text)
    found = reader.value(0)
    if reader.gap():
        raise reader.fail("unexpected text after the value")
    return found
