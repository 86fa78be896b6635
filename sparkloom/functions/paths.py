"""Paths compiled to Columns over VARIANT: one expression tree that Catalyst sees whole.

A value is a VARIANT column; JSON null and a missing key are both SQL NULL.
Deviations from an error: an operand of the wrong type gives null, or with
strict=True an error at run time. Unknown functions, wrong arities and unbound
parameters are errors when the path is compiled.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import path_syntax as S
from .values import plain

VARIANT, ARRAY, MAP = "variant", "array<variant>", "map<string,variant>"


class PathError(ValueError):
    """A path that can't be compiled."""


def get(v: Column, kind: str) -> Column:
    """v as kind, or null."""
    return F.try_variant_get(v, "$", kind)


def norm(v: Column) -> Column:
    return F.when(~F.is_variant_null(v), v)


def array(v: Column) -> Column:
    return get(v, ARRAY)


def mapping(v: Column) -> Column:
    return get(v, MAP)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def is_string(v: Column) -> Column:
    return _kind(v) == "STRING"


def is_boolean(v: Column) -> Column:
    return _kind(v) == "BOOLEAN"


def is_number(v: Column) -> Column:
    return _numeric_kind(_kind(v))


def _numeric_kind(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL")


def is_integer(v: Column) -> Column:
    return _kind(v) == "BIGINT"


def string(v: Column) -> Column:
    return F.when(is_string(v), get(v, "string"))


def number(v: Column) -> Column:
    return F.when(is_number(v), get(v, "double"))


def variant(x: Column) -> Column:
    return x.cast(VARIANT)


def literal(value: Any) -> Column:
    return norm(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))


def truthy(v: Column) -> Column:
    """null, false, empty strings, arrays and maps are false; all else is true, numbers included."""
    k = _kind(v)
    return F.coalesce(
        F.when(k == "BOOLEAN", get(v, "boolean"))
        .when(k == "STRING", get(v, "string") != "")
        .when(k.startswith("ARRAY"), F.size(array(v)) > 0)
        .when(k.startswith("OBJECT"), F.size(mapping(v)) > 0)
        .when(k == "VOID", F.lit(False))
        .otherwise(v.isNotNull()),
        F.lit(False),
    )


def _exact(v: Column) -> Column:
    """A number's digits where a double can't tell it from its neighbours: 20 before the point and 18 after it."""
    return F.coalesce(get(v, "decimal(38,18)"), F.lit(0).cast("decimal(38,18)"))


def measure(v: Column) -> Column:
    """A struct that compares as numbers do, whole ones of any BIGINT included; null for other kinds."""
    return F.when(is_number(v), F.struct(get(v, "double").alias("size"), _exact(v).alias("exact")))


def order(v: Column) -> Column:
    """A struct that sorts as values do: null < boolean < number < string < array < map."""

    def of(k: Column) -> Column:
        rank = F.when(k == "BOOLEAN", 1).when(_numeric_kind(k), 2).when(k == "STRING", 3).when(k.startswith("ARRAY"), 4).when(k.startswith("OBJECT"), 5)
        rank = rank.otherwise(0)
        size = F.when(rank == 1, get(v, "boolean").cast("double")).when(rank == 2, get(v, "double")).otherwise(0.0)
        exact = F.when(rank == 2, _exact(v)).otherwise(F.lit(0).cast("decimal(38,18)"))
        text = F.when(rank == 3, get(v, "string")).when(rank > 3, F.to_json(v)).otherwise("")
        return F.struct(rank.alias("rank"), size.alias("size"), exact.alias("exact"), text.alias("text"))

    return once(_kind(v), of)


def equal(a: Column, b: Column) -> Column:
    """Never null: both null is equal; a boolean equals a string as its being 'true'."""
    cross = F.when(is_boolean(a) & is_string(b), get(a, "boolean") == (get(b, "string") == "true"))
    cross = cross.when(is_string(a) & is_boolean(b), get(b, "boolean") == (get(a, "string") == "true"))
    return F.coalesce(cross.otherwise(order(a) == order(b)), F.lit(False))


def _plain_string(v: Column) -> Column:
    k = _kind(v)
    return F.when(k.startswith("ARRAY") | k.startswith("OBJECT"), F.to_json(v)).otherwise(get(v, "string"))


class Compiler:
    def __init__(self, params: dict[str, Any] | None = None, strict: bool = False, scope: dict[str, Column] | None = None):
        self.params, self.strict, self.scope = params or {}, strict, scope or {}

    def check(self, ok: Column, out: Column, what: str) -> Column:
        ok = F.coalesce(ok, F.lit(False))
        return F.when(ok, out).otherwise(variant(F.raise_error(F.lit(f"{what}: wrong type")))) if self.strict else F.when(ok, out)

    def compile(self, node: Any, v: Column, root: bool = False) -> Column:
        """root: names of the scope go before v's own fields."""
        go = functools.partial(self.compile, v=v, root=root)
        match node:
            case S.Current():
                return v
            case S.Field(name) if root and name in self.scope:
                return self.scope[name]
            case S.Field() | S.Then() if steps := _steps(node, self.scope if root else {}):
                return norm(F.try_variant_get(v, f"${steps}", VARIANT))
            case S.Field(name):
                return norm(F.try_element_at(mapping(v), F.lit(name)))
            case S.Literal(value):
                try:
                    return literal(plain(value, self.params))
                except KeyError as e:
                    raise PathError(str(e)) from None
            case S.Then(left, right):
                return self.bind(left, go(left), lambda x: self.compile(right, x))
            case S.Index(at):
                return norm(F.try_element_at(array(v), F.lit(at + 1 if at >= 0 else at)))
            case S.Project(left, items, right):
                base = go(left)
                found = self.items(items, base)
                if isinstance(right, S.Current):
                    return variant(F.filter(found, lambda x: norm(x).isNotNull()))
                return variant(F.filter(F.transform(found, lambda x: self.compile(right, x)), lambda x: x.isNotNull()))
            case S.MultiList(parts):
                return F.when(v.isNotNull(), variant(F.array(*(go(p) for p in parts))))
            case S.MultiHash(parts):
                fields = [go(p).alias(k) for k, p in parts]
                return F.when(v.isNotNull(), F.to_variant_object(F.struct(*fields)))
            case S.Compare():
                return variant(self.comparison(node, v, root))
            case S.Not(part):
                return variant(~self.test(part, v, root))
            case S.And(left, right):
                return F.when(self.test(left, v, root), go(right)).otherwise(go(left))
            case S.Or(left, right):
                return F.when(self.test(left, v, root), go(left)).otherwise(go(right))
            case S.Call(name, args):
                return self.call(name, args, go)
        raise PathError(f"{node} can't stand here")

    def bind(self, node: Any, value: Column, f: Callable[[Column], Column]) -> Column:
        """f(value); a value that costs more than a look-up is evaluated once."""
        return f(value) if isinstance(node, S.Field | S.Current | S.Literal) or _steps(node, {}) else once(value, f)

    def test(self, node: Any, v: Column, root: bool = False) -> Column:
        """Is what the node finds true? A native boolean, never null."""
        go = functools.partial(self.compile, v=v, root=root)
        match node:
            case S.Not(part):
                return ~self.test(part, v, root)
            case S.And(left, right):
                return self.test(left, v, root) & self.test(right, v, root)
            case S.Or(left, right):
                return self.test(left, v, root) | self.test(right, v, root)
            case S.Compare():
                return F.coalesce(self.comparison(node, v, root), F.lit(False))
        return self.bind(node, go(node), truthy)

    def comparison(self, node: S.Compare, v: Column, root: bool) -> Column:
        """A native boolean; null where an order between the operands isn't defined."""
        op, left, right = node.op, node.left, node.right
        go = functools.partial(self.compile, v=v, root=root)
        for x, other, turned in ((left, right, op), (right, left, _TURNED[op])):
            if isinstance(other, S.Literal) and not isinstance(x, S.Literal):
                try:
                    value = plain(other.value, self.params)
                except KeyError as e:
                    raise PathError(str(e)) from None
                if (found := self.against(turned, value)) is not None:
                    return self.bind(x, go(x), found)
        return self.bind(left, go(left), lambda a: self.bind(right, go(right), lambda b: self.compare(op, a, b)))

    def against(self, op: str, value: Any) -> Callable[[Column], Column] | None:
        """The test of an operand against a literal, where its kind makes that a native comparison."""
        if self.strict and op not in ("==", "!=") or isinstance(value, bool):
            return None
        if isinstance(value, str):
            def same(x: Column) -> Column:
                k = _kind(x)
                return F.when(k == "STRING", get(x, "string") == value).when(k == "BOOLEAN", get(x, "boolean") == F.lit(value == "true"))

            read = string
        elif isinstance(value, int | float) and abs(value) < 2**53:  # a double tells it from all other numbers
            read = number
            same = lambda x: number(x) == float(value)
        else:
            return None
        literal_ = F.lit(value if isinstance(value, str) else float(value))
        if op in ("==", "!="):
            equal_ = lambda x: F.coalesce(same(x), F.lit(False))
            return equal_ if op == "==" else lambda x: ~equal_(x)
        return lambda x: _TESTS[op](read(x), literal_)

    def function(self, body: Any) -> Callable[[Column], Column]:
        return lambda x: self.compile(body, norm(x))

    def items(self, items: S.Items, base: Column) -> Column:
        xs = array(base)
        if items.kind == "hash":
            return F.transform(F.array_sort(F.map_entries(mapping(base)), lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)), lambda e: e["value"])
        if items.kind == "flatten":
            return F.flatten(F.transform(xs, lambda x: F.coalesce(array(x), F.array(x))))
        if items.kind == "filter":
            return F.filter(xs, lambda x: self.test(items.arg, x))
        if items.kind == "slice":
            return once(xs, lambda xs: _sliced(xs, *items.arg))
        return xs

    def compare(self, op: str, a: Column, b: Column) -> Column:
        if op in ("==", "!="):
            return equal(a, b) if op == "==" else ~equal(a, b)
        out = F.coalesce(_TESTS[op](measure(a), measure(b)), _TESTS[op](string(a), string(b)))
        if self.strict:
            out = F.coalesce(out, F.raise_error(F.lit(f"{op}: the operands can't be compared")).cast("boolean"))
        return out

    def call(self, name: str, args: tuple[Any, ...], go) -> Column:
        if name not in FUNCTIONS:
            raise PathError(f"unknown function {name}")
        arity, make = FUNCTIONS[name]
        if arity is not None and len(args) != arity or arity is None and name == "not_null" and not args:
            raise PathError(f"{name} takes {arity if arity is not None else 'at least 1'} arguments, not {len(args)}")
        wants = {"map": 0, "sort_by": 1, "max_by": 1, "min_by": 1}.get(name)
        given: list[Any] = []
        for i, a in enumerate(args):
            if isinstance(a, S.Lambda) != (i == wants):
                raise PathError(f"{name}: argument {i + 1} must {'' if i == wants else 'not '}be an expression argument")
            given.append(self.function(a.body) if isinstance(a, S.Lambda) else go(a))

        def bound(i: int, *done: Any) -> Column:
            if i == len(given):
                return make(self, *done)
            if callable(given[i]) and not isinstance(given[i], Column):
                return bound(i + 1, *done, given[i])
            return self.bind(args[i], given[i], lambda x: bound(i + 1, *done, x))

        return bound(0)


_TESTS: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y
}
_TURNED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def _steps(node: Any, scope: dict[str, Column]) -> str:
    """A chain of plain names and indexes from the front as one variant path ('' for other nodes)."""
    match node:
        case S.Field(name) if name.isidentifier() and name.isascii() and name not in scope:
            return f".{name}"
        case S.Index(at) if at >= 0:
            return f"[{at}]"
        case S.Then(left, right):
            a, b = _steps(left, scope), _steps(right, {})
            return a + b if a and b else ""
    return ""


def _sliced(xs: Column, start: int | None, stop: int | None, step: int | None) -> Column:
    step = step or 1
    n = F.size(xs)

    def clamp(i: int | None, otherwise: Column, low: int, high: Column) -> Column:
        if i is None:
            return otherwise
        at = F.lit(i) if i >= 0 else n + F.lit(i)
        return F.greatest(F.lit(low), F.least(at, high))

    if step > 0:
        first, last = clamp(start, F.lit(0), 0, n), clamp(stop, n, 0, n) - 1
        some = last >= first
    else:
        first, last = clamp(start, n - 1, -1, n - 1), clamp(stop, F.lit(-1), -1, n - 1) + 1
        some = first >= last
    return F.when(xs.isNotNull() & some, F.transform(F.sequence(first, last, F.lit(step)), lambda i: F.get(xs, i))).when(xs.isNotNull(), F.slice(xs, 1, 0))


def _numeric(c: Compiler, v: Column, of_int: Callable, of_double: Callable, what: str) -> Column:
    out = F.when(is_integer(v), variant(of_int(get(v, "bigint")))).otherwise(variant(of_double(get(v, "double"))))
    return c.check(is_number(v), out, what)


def _total(c: Compiler, v: Column, what: str) -> Column:
    def of(xs: Column) -> Column:
        total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        out = total if what == "sum" else F.when(F.size(xs) > 0, total / F.size(xs))
        return c.check(F.forall(xs, lambda x: x.isNotNull()), variant(out), what)

    return once(F.transform(array(v), number), of)


def _contains(c: Compiler, v: Column, x: Column) -> Column:
    inside = F.exists(array(v), lambda e: equal(e, x))
    text = F.coalesce(F.contains(get(v, "string"), string(x)), F.lit(False))
    return c.check(is_string(v) | array(v).isNotNull(), variant(F.when(is_string(v), text).otherwise(inside)), "contains")


def _affix(c: Compiler, f: Callable, v: Column, x: Column, what: str) -> Column:
    return c.check(is_string(v) & is_string(x), variant(f(string(v), string(x))), what)


def _join(c: Compiler, glue: Column, v: Column) -> Column:
    xs = array(v)
    ok = is_string(glue) & F.forall(xs, lambda x: F.coalesce(is_string(x), F.lit(False)))
    return c.check(ok, variant(F.call_function("array_join", F.transform(xs, lambda x: get(x, "string")), string(glue))), "join")


def _entries(c: Compiler, v: Column, part: str) -> Column:
    keys = F.array_sort(F.map_keys(mapping(v)))
    out = keys if part == "keys" else F.transform(keys, lambda k: F.element_at(mapping(v), k))
    return c.check(mapping(v).isNotNull(), variant(out), part)


def _length(c: Compiler, v: Column) -> Column:
    n = F.when(is_string(v), F.char_length(get(v, "string"))).otherwise(F.coalesce(F.size(array(v)), F.size(mapping(v))))
    n = F.when(is_string(v) | array(v).isNotNull() | mapping(v).isNotNull(), n)
    return c.check(n.isNotNull(), variant(n.cast("bigint")), "length")


def _keyed(xs: Column, key: Callable[[Column], Column], sign: int = 1) -> Column:
    """(k, i) of all items: their keys' order and their places, negative if sign is."""
    return F.transform(xs, lambda x, i: F.struct(order(key(norm(x))).alias("k"), (i * sign).alias("i")))


def _extreme(v: Column, key: Callable[[Column], Column], least: bool) -> Column:
    """The first item with the least (or greatest) known key; null for none."""

    def of(xs: Column) -> Column:
        known = F.filter(_keyed(xs, key, 1 if least else -1), lambda p: p["k"]["rank"] > 0)
        best = F.array_min(known) if least else F.array_max(known)
        return norm(F.get(xs, F.abs(best["i"])))

    return once(array(v), of)


def _sorted(v: Column, key: Callable[[Column], Column]) -> Column:
    """Stable: ties keep their places."""
    return once(array(v), lambda xs: variant(F.transform(F.array_sort(_keyed(xs, key)), lambda p: F.get(xs, p["i"]))))


def _merge(c: Compiler, *vs: Column) -> Column:
    """Later maps win."""
    if not vs:
        return literal({})
    maps = [mapping(v) for v in vs]
    out = maps[0]
    for m in maps[1:]:
        out = _overlaid(out, m)
    return F.to_variant_object(out)


def _overlaid(a: Column, b: Column) -> Column:
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _to_boolean(v: Column) -> Column:
    text = ~get(v, "string").isin("false", "0") & (get(v, "string") != "")
    return F.when(v.isNotNull(), variant(F.when(is_string(v), text).when(is_number(v), get(v, "double") != 0).otherwise(truthy(v))))


def _type(v: Column) -> Column:
    k = _kind(v)
    name = F.when(k == "BOOLEAN", "Boolean").when(k == "BIGINT", "BigInt").when(is_number(v), "Double").when(k == "STRING", "Varchar")
    return variant(name.when(k.startswith("ARRAY"), "ObjectArray").when(k.startswith("OBJECT"), "ObjectMap"))


def _to_bigint(c: Compiler, v: Column) -> Column:
    out = F.when(is_string(v), get(v, "string").try_cast("bigint")).when(
        is_number(v), F.coalesce(get(v, "decimal(38,18)").try_cast("bigint"), get(v, "double").try_cast("bigint"))
    )
    return variant(F.when(is_integer(v), get(v, "bigint")).otherwise(out.when(is_boolean(v), get(v, "boolean").cast("bigint"))))


def _to_double(v: Column) -> Column:
    return F.when(is_number(v), v).when(is_string(v), variant(get(v, "string").try_cast("double")))


same = lambda x: x
FUNCTIONS: dict[str, tuple[int | None, Callable[..., Column]]] = {
    "abs": (1, lambda c, v: _numeric(c, v, F.abs, F.abs, "abs")),
    "avg": (1, lambda c, v: _total(c, v, "avg")),
    "ceil": (1, lambda c, v: _numeric(c, v, same, lambda x: F.ceil(x).cast("double"), "ceil")),
    "contains": (2, _contains),
    "ends_with": (2, lambda c, v, x: _affix(c, F.endswith, v, x, "ends_with")),
    "floor": (1, lambda c, v: _numeric(c, v, same, lambda x: F.floor(x).cast("double"), "floor")),
    "join": (2, _join),
    "keys": (1, lambda c, v: _entries(c, v, "keys")),
    "length": (1, _length),
    "map": (2, lambda c, f, v: c.check(array(v).isNotNull(), variant(F.transform(array(v), f)), "map")),
    "max": (1, lambda c, v: _extreme(v, same, False)),
    "max_by": (2, lambda c, v, f: _extreme(v, f, False)),
    "merge": (None, _merge),
    "min": (1, lambda c, v: _extreme(v, same, True)),
    "min_by": (2, lambda c, v, f: _extreme(v, f, True)),
    "not_null": (None, lambda c, *vs: F.coalesce(*vs)),
    "reverse": (1, lambda c, v: c.check(array(v).isNotNull(), variant(F.reverse(array(v))), "reverse")),
    "sort": (1, lambda c, v: _sorted(v, same)),
    "sort_by": (2, lambda c, v, f: _sorted(v, f)),
    "starts_with": (2, lambda c, v, x: _affix(c, F.startswith, v, x, "starts_with")),
    "sum": (1, lambda c, v: _total(c, v, "sum")),
    "to_array": (1, lambda c, v: F.when(array(v).isNotNull(), v).otherwise(variant(F.array(v)))),
    "to_string": (1, lambda c, v: variant(_plain_string(v))),
    "to_double": (1, lambda c, v: _to_double(v)),
    "to_bigint": (1, _to_bigint),
    "to_boolean": (1, lambda c, v: _to_boolean(v)),
    "type": (1, lambda c, v: _type(v)),
    "values": (1, lambda c, v: _entries(c, v, "values")),
}


def document(x: Column | str) -> Column:
    """JSON text as a document; text that doesn't parse is null."""
    return norm(F.try_parse_json(F.col(x) if isinstance(x, str) else x))


def search(doc: Column | str, path: str, params: dict[str, Any] | None = None, strict: bool = False) -> Column:
    """What the path finds in a VARIANT column, as VARIANT."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return Compiler(params, strict).compile(S.parse_path(path), norm(doc))


def search_as(doc: Column | str, path: str, kind: str, params: dict[str, Any] | None = None) -> Column:
    """The same, read as an SQL type; null where it doesn't convert."""
    return get(search(doc, path, params), kind)


def where(df: DataFrame, doc: Column | str, test: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows whose document passes the test."""
    doc = F.col(doc) if isinstance(doc, str) else doc
    return df.where(Compiler(params).test(S.parse_path(test), norm(doc)))


def _typed(df: DataFrame, node: Any, params: dict[str, Any]) -> Column | None:
    """A test over a row's own columns as a native predicate, or None where it needs documents.

    Comparisons of a numeric or string column with a literal of its kind, and
    their combinations, have the same truth in SQL; such predicates reach the
    scan.
    """
    match node:
        case S.Compare(op, S.Field(name), S.Literal(value)) if name in df.columns:
            value, kind = plain(value, params), df.schema[name].dataType
            alike = (isinstance(kind, T.NumericType) and isinstance(value, int | float) and not isinstance(value, bool)) or (
                isinstance(kind, T.StringType) and isinstance(value, str)
            )
            if not alike:
                return None
            x, v = F.col(f"`{name}`"), F.lit(value)
            return {"<": x < v, "<=": x <= v, ">": x > v, ">=": x >= v, "==": x.eqNullSafe(v), "!=": ~x.eqNullSafe(v)}[op]
        case S.And(left, right) | S.Or(left, right):
            a, b = _typed(df, left, params), _typed(df, right, params)
            if a is None or b is None:
                return None
            return a & b if isinstance(node, S.And) else a | b
        case S.Not(part):
            a = _typed(df, part, params)
            return None if a is None else ~F.coalesce(a, F.lit(False))
    return None


def _row(df: DataFrame) -> Column:
    return F.to_variant_object(F.struct(*(F.col(f"`{c}`") for c in df.columns)))


def where_rows(df: DataFrame, test: str, params: dict[str, Any] | None = None) -> DataFrame:
    """The rows that pass a test in which names are columns; plain comparisons become native, pushed-down predicates."""
    native = _typed(df, S.parse_path(test), params or {})
    return df.where(native) if native is not None else where(df, _row(df), test, params)


def select_rows(df: DataFrame, fields: dict[str, tuple[str, str] | str], params: dict[str, Any] | None = None) -> DataFrame:
    """Columns by name: a path that is a column's name is that column, other paths need their SQL type beside them."""
    out = []
    for name, given in fields.items():
        path, kind = given if isinstance(given, tuple) else (given, "")
        node = S.parse_path(path)
        if isinstance(node, S.Field) and node.name in df.columns:
            x = F.col(f"`{node.name}`")
            out.append((x.cast(kind) if kind else x).alias(name))
        elif kind:
            out.append(get(search(_row(df), path, params), kind).alias(name))
        else:
            raise PathError(f"{path} isn't a column: name its type")
    return df.select(*out)


def explode(df: DataFrame, doc: Column | str, path: str, name: str = "item", params: dict[str, Any] | None = None) -> DataFrame:
    """A row for each item of the array that the path finds; none where it finds no array."""
    return df.withColumn(name, F.explode(array(search(doc, path, params))))
