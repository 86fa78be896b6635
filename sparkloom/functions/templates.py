"""String templates over documents, compiled to one STRING column.

{{ path }} prints a value; {% for x in path %}...{% endfor %}, {% if path %}
...{% elif path %}...{% else %}...{% endif %} and {% set x = path %} control
what is printed. A name is looked up in the innermost loop or set first, then
in the document. `-` inside a tag strips all white space on that side, `+`
keeps it; by default the blank part of a line next to a {% tag %} goes, and the
line break after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import path_naive
from .path_syntax import parse_path
from .paths import Compiler, _plain_string, array, norm, truthy


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    path: Any


@dataclass(frozen=True)
class For:
    name: str
    path: Any
    body: tuple[Any, ...]


@dataclass(frozen=True)
class If:
    branches: tuple[tuple[Any, tuple[Any, ...]], ...]
    otherwise: tuple[Any, ...]


@dataclass(frozen=True)
class Set:
    name: str
    path: Any


_TAG = re.compile(r"\{\{([-+]?)(.*?)([-+]?)\}\}|\{%([-+]?)(.*?)([-+]?)%\}", re.S)
_FOR = re.compile(r"for\s+([^\W\d]\w*)\s+in\s+(.+)", re.S)
_SET = re.compile(r"set\s+([^\W\d]\w*)\s*=\s*(.+)", re.S)


def _pieces(text: str) -> list[tuple[str, str]]:
    """("text" | "print" | "tag", content), with white space next to tags already settled."""
    out: list[tuple[str, str]] = []
    at, strip = 0, ""
    for m in [*_TAG.finditer(text), None]:
        plain = text[at : m.start() if m else len(text)]
        if "{#" in plain:
            raise TemplateError("{# is reserved")
        if strip == "-":
            plain = plain.lstrip()
        elif strip == "line":
            plain = re.sub(r"\A[ \t]*\n", "", plain)
        kind = None
        if m:
            kind = "print" if m[2] is not None else "tag"
            left, body, right = (m[1], m[2], m[3]) if kind == "print" else (m[4], m[5], m[6])
            if left == "-":
                plain = plain.rstrip()
            elif kind == "tag" and left != "+" and (at or "\n" in plain or not plain.strip()):
                plain = re.sub(r"(\A|\n)[ \t]+\Z", r"\1", plain) if not at or "\n" in plain else plain
            strip = "-" if right == "-" else "line" if kind == "tag" and right != "+" else ""
            at = m.end()
        if plain:
            out.append(("text", plain))
        if m:
            out.append((kind, body.strip()))
    return out


@lru_cache(maxsize=256)
def parse_template(text: str) -> tuple[Any, ...]:
    pieces, at = _pieces(text), 0

    def block(*ends: str) -> tuple[tuple[Any, ...], str]:
        nonlocal at
        out: list[Any] = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            word = body.split(None, 1)[0] if kind == "tag" and body else ""
            if kind == "text":
                out.append(Text(body))
            elif kind == "print":
                out.append(Print(parse_path(body)))
            elif word in ends:
                return tuple(out), body
            elif word == "for":
                m = _FOR.fullmatch(body)
                if not m:
                    raise TemplateError(f"unreadable tag: {body}")
                out.append(For(m[1], parse_path(m[2]), block("endfor")[0]))
            elif word == "set":
                m = _SET.fullmatch(body)
                if not m:
                    raise TemplateError(f"unreadable tag: {body}")
                out.append(Set(m[1], parse_path(m[2])))
            elif word == "if":
                branches, test, otherwise = [], parse_path(body[2:]), ()
                while True:
                    inner, end = block("elif", "else", "endif")
                    branches.append((test, inner))
                    if end.startswith("elif"):
                        test = parse_path(end[4:])
                        continue
                    if end == "else":
                        otherwise, _ = block("endif")
                    break
                out.append(If(tuple(branches), otherwise))
            else:
                raise TemplateError(f"unexpected tag: {body}")
        if ends:
            raise TemplateError(f"no {' or '.join(ends)}")
        return tuple(out), ""

    return block()[0]


def render(template: str, doc: Column | str, params: dict[str, Any] | None = None) -> Column:
    """The template filled from a VARIANT column. Null prints nothing; a loop over no array runs zero times."""
    doc = norm(F.col(doc) if isinstance(doc, str) else doc)

    def filled(nodes: tuple[Any, ...], scope: dict[str, Column]) -> Column:
        scope, parts = dict(scope), [F.lit("")]
        for node in nodes:
            value = lambda path: Compiler(params, scope=scope).compile(path, doc, root=True)  # noqa: B023, E731
            match node:
                case Text(text):
                    parts.append(F.lit(text))
                case Print(path):
                    parts.append(F.coalesce(_plain_string(value(path)), F.lit("")))
                case Set(name, path):
                    scope = {**scope, name: value(path)}
                case For(name, path, body):
                    loop = _loop(filled, body, scope, name)
                    parts.append(F.coalesce(F.array_join(F.transform(array(value(path)), loop), ""), F.lit("")))
                case If(branches, otherwise):
                    tests = [(truthy(value(path)), filled(body, scope)) for path, body in branches]
                    case = F.when(*tests[0])
                    for test in tests[1:]:
                        case = case.when(*test)
                    parts.append(case.otherwise(filled(otherwise, scope)))
        return F.concat(*parts)

    return filled(parse_template(template), {})


def _loop(filled, body, scope, name):
    return lambda x: filled(body, {**scope, name: norm(x)})


def render_naive(template: str, value: Any, params: dict[str, Any] | None = None) -> str:
    """The same in plain Python, for tests."""

    def filled(nodes, scope):
        scope, out = dict(scope), []
        for node in nodes:
            get = lambda path: path_naive._eval(path, {**value, **scope} if isinstance(value, dict) else value, params or {})  # noqa: B023, E731
            match node:
                case Text(text):
                    out.append(text)
                case Print(path):
                    v = get(path)
                    v = str(v).lower() if isinstance(v, bool) else v
                    out.append("" if v is None else path_naive._call("to_string", [v], None))
                case Set(name, path):
                    scope[name] = get(path)
                case For(name, path, body):
                    items = get(path)
                    out += [filled(body, {**scope, name: x}) for x in (items if isinstance(items, list) else [])]
                case If(branches, otherwise):
                    out.append(filled(next((b for p, b in branches if path_naive.truthy(get(p))), otherwise), scope))
        return "".join(out)

    return filled(parse_template(template), {})
