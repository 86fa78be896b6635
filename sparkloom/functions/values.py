"""Document text: a superset of JSON with typed literals, type expressions and parameters, as Python values.

null, true, false, numbers (suffixes ll, ull, ul, u, d, f and _s8 to _u64; 0x,
0b and 0 radices), strings in either quotes, [arrays], {maps} with quoted or
plain keys, typed values 'text'@Type, typed containers <T>[...] and <K, V>{...},
?parameters, type expressions, // comments and a leading type directory
#{Name: Type, ...} whose types are referred to as #Name.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any


class SyntaxProblem(ValueError):
    """Text that doesn't parse; carries the place."""

    def __init__(self, message: str, text: str, at: int):
        super().__init__(f"{message} at {at}: {text[at : at + 20]!r}")
        self.at = at


@dataclass(frozen=True)
class Datatype:
    """A type expression: name, parameters, constructor arguments and qualifiers."""

    name: str
    params: tuple[Any, ...] = ()
    args: tuple[Any, ...] = ()
    qualifiers: tuple[str, ...] = ()

    def __str__(self) -> str:
        params = f"<{', '.join(map(str, self.params))}>" if self.params else ""
        args = f"({', '.join(to_text(a) for a in self.args)})" if self.args else ""
        words = [q for q in self.qualifiers if q.isalpha()]
        marks = "".join(q for q in self.qualifiers if not q.isalpha())
        return " ".join([*words, f"{self.name}{params}{args}{marks}"])


@dataclass(frozen=True)
class TypedValue:
    type: Datatype
    value: Any


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass
class TypedContainer:
    types: tuple[Datatype, ...]
    value: Any


@dataclass
class Document:
    value: Any
    types: dict[str, Datatype] = field(default_factory=dict)


_SPACE = re.compile(r"(?:\s+|//[^\n]*)*")
_NAME = re.compile(r"[^\W\d]\w*")
_FLOAT = re.compile(r"[+-]?(?:\d+\.\d*|\.\d+|\d+(?=[eEdDfF]))(?:[eE][+-]?\d+)?([dfDF]?)(?!\w)")
_INT = re.compile(r"[+-]?(?:0[xX][0-9a-fA-F]+|0[bB][01]+|\d+)(ll|ull|ul|u|_[su](?:8|16|32|64))?(?![\w])")
# The bits of each integer suffix, and whether it is unsigned.
_SUFFIX = {None: (32, False), "ll": (64, False), "ull": (64, True), "ul": (64, True), "u": (32, True)}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


class Reader:
    """Recursive descent over one text."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at, self.types = text, at, {}

    def fail(self, message: str) -> SyntaxProblem:
        return SyntaxProblem(message, self.text, self.at)

    def skip(self) -> None:
        self.at = _SPACE.match(self.text, self.at).end()

    def peek(self, token: str) -> bool:
        self.skip()
        return self.text.startswith(token, self.at)

    def take(self, token: str) -> bool:
        if self.peek(token):
            self.at += len(token)
            return True
        return False

    def need(self, token: str) -> None:
        if not self.take(token):
            raise self.fail(f"expected {token!r}")

    def name(self) -> str:
        self.skip()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise self.fail("expected a name")
        self.at = m.end()
        return m[0]

    def string(self) -> str:
        self.skip()
        quote = self.text[self.at]
        self.at += 1
        out = []
        while True:
            if self.at >= len(self.text):
                raise self.fail("string without end")
            c = self.text[self.at]
            self.at += 1
            if c == quote:
                return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            if c == "\\":
                c = self.text[self.at : self.at + 1]
                self.at += 1
                if c == "u":
                    out.append(chr(int(self.text[self.at : self.at + 4], 16)))
                    self.at += 4
                else:
                    out.append(_ESCAPES.get(c, c))
            else:
                out.append(c)

    def many(self, close: str, one) -> list:
        out = []
        if self.take(close):
            return out
        while True:
            out.append(one())
            if self.take(close):
                return out
            self.need(",")

    def datatype(self) -> Datatype:
        qualifiers = []
        while (word := self.name()) in ("const", "volatile", "unsigned", "signed"):
            qualifiers.append(word)
        while self.take("::"):
            word += "::" + self.name()
        params = tuple(self.many(">", self.param)) if self.take("<") else ()
        args = tuple(self.many(")", self.value)) if self.take("(") else ()
        while self.peek("*") or self.peek("&"):
            qualifiers.append(self.text[self.at])
            self.at += 1
        return Datatype(word, params, args, tuple(qualifiers))

    def param(self) -> Any:
        self.skip()
        return self.datatype() if _NAME.match(self.text, self.at) else self.value()

    def number(self) -> Any:
        m = _FLOAT.match(self.text, self.at)
        if m:
            self.at = m.end()
            return float(m[0].rstrip("dDfF"))
        m = _INT.match(self.text, self.at)
        if not m:
            raise self.fail("expected a value")
        self.at = m.end()
        digits, suffix = (m[0][: -len(m[1])] if m[1] else m[0]), m[1]
        value = int(digits, 0) if digits[:2].lower() in ("0x", "0b") else int(digits, 10)
        bits, unsigned = _SUFFIX.get(suffix) or (int(suffix[2:]), suffix[1] == "u")
        low, high = (0, (1 << bits) - 1) if unsigned else (-(1 << bits - 1), (1 << bits - 1) - 1)
        if suffix and not low <= value <= high:
            raise self.fail(f"{value} doesn't fit {suffix}")
        return value

    def entry(self) -> tuple[str, Any]:
        self.skip()
        key = self.string() if self.text[self.at : self.at + 1] in "\"'" else self.name()
        self.need(":")
        return key, self.value()

    def value(self) -> Any:
        self.skip()
        c = self.text[self.at : self.at + 1]
        if c and c in "\"'":
            s = self.string()
            return TypedValue(self.reference(), s) if self.take("@") else s
        if self.take("["):
            return self.many("]", self.value)
        if self.take("{"):
            return dict(self.many("}", self.entry))
        if self.take("<"):
            types = tuple(self.many(">", self.reference))
            self.skip()
            if len(types) not in (1, 2):
                raise self.fail("one type or two")
            self.need("[" if len(types) == 1 else "{")
            inner = self.many("]", self.value) if len(types) == 1 else dict(self.many("}", self.keyed))
            return TypedContainer(types, inner)
        if self.take("?"):
            return Parameter(self.name())
        if c == "#":
            return self.reference()
        m = _NAME.match(self.text, self.at)
        if m:
            if m[0] in ("null", "true", "false"):
                self.at = m.end()
                return {"null": None, "true": True, "false": False}[m[0]]
            return self.datatype()
        return self.number()

    def keyed(self) -> tuple[Any, Any]:
        self.skip()
        key = self.string() if self.text[self.at : self.at + 1] in "\"'" else self.number() if not _NAME.match(self.text, self.at) else self.name()
        self.need(":")
        return key, self.value()

    def reference(self) -> Datatype:
        if self.take("#"):
            name = self.name()
            if name not in self.types:
                raise self.fail(f"no type {name} in the directory")
            return self.types[name]
        return self.datatype()

    def directory(self) -> dict[str, Datatype]:
        if self.peek("#{"):
            self.at += 2

            def one():
                name = self.name()
                self.need(":")
                self.types[name] = self.datatype()

            self.many("}", one)
        return self.types

    def end(self) -> None:
        self.skip()
        if self.at < len(self.text):
            raise self.fail("text after the end")


def parse_document(text: str) -> Document:
    r = Reader(text)
    types = r.directory()
    value = r.value()
    r.end()
    return Document(value, dict(types))


def parse_value(text: str) -> Any:
    return parse_document(text).value


def parse_datatype(text: str) -> Datatype:
    r = Reader(text)
    out = r.datatype()
    r.end()
    return out


def plain(value: Any, params: dict[str, Any] | None = None) -> Any:
    """Values that JSON has: parameters bound, typed values and containers by their contents, types by their text."""
    if isinstance(value, Parameter):
        if params is None or value.name not in params:
            raise KeyError(f"parameter {value.name} has no value")
        return plain(params[value.name])
    if isinstance(value, TypedValue):
        if value.type.name in ("TinyInt", "SmallInt", "Integer", "BigInt", "UTinyInt", "USmallInt", "UInteger", "UBigInt"):
            return int(value.value)
        if value.type.name in ("Real", "Double"):
            return float(value.value)
        return {"true": True, "false": False}.get(value.value, value.value) if value.type.name == "Boolean" else value.value
    if isinstance(value, TypedContainer):
        return plain(value.value, params)
    if isinstance(value, Datatype):
        return str(value)
    if isinstance(value, list):
        return [plain(x, params) for x in value]
    if isinstance(value, dict):
        return {str(k): plain(x, params) for k, x in value.items()}
    return value


def to_text(value: Any, pretty: bool = False) -> str:
    """A value as document text; typed values and containers keep their types."""
    if isinstance(value, TypedValue):
        return f"{json.dumps(value.value, ensure_ascii=False)}@{value.type}"
    if isinstance(value, TypedContainer):
        return f"<{', '.join(map(str, value.types))}>{to_text(value.value)}"
    if isinstance(value, Parameter):
        return f"?{value.name}"
    if isinstance(value, Datatype):
        return str(value)
    if isinstance(value, list) and not pretty:
        return f"[{', '.join(map(to_text, value))}]"
    if isinstance(value, dict) and not pretty:
        return "{" + ", ".join(f"{json.dumps(str(k), ensure_ascii=False)}: {to_text(x)}" for k, x in value.items()) + "}"
    return json.dumps(plain(value) if pretty else value, ensure_ascii=False, indent=2 if pretty else None)
