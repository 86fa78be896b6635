"""A plain Python evaluator of the path language over JSON-like values: the reference point of the tests."""

from __future__ import annotations

import functools
import json
import math
from typing import Any

from . import path_syntax as S
from .values import Parameter, plain


class PathError(ValueError):
    pass


def truthy(v: Any) -> bool:
    """null, false, empty strings, arrays and maps are false; all else is true, numbers included."""
    return v is not None and v is not False and not (isinstance(v, str | list | dict) and not v)


def rank(v: Any) -> int:
    """null < boolean < number < string < array < map."""
    for i, kind in enumerate((bool, int | float, str, list, dict), 1):
        if isinstance(v, kind):
            return i
    return 0


def _order(v: Any) -> tuple:
    r = rank(v)
    return (r, float(v) if r in (1, 2) else 0.0, v if r == 3 else json.dumps(v, sort_keys=True, ensure_ascii=False) if r > 3 else "")


def equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) and isinstance(b, str):
        return a == (b == "true")
    if isinstance(b, bool) and isinstance(a, str):
        return equal(b, a)
    return rank(a) == rank(b) and a == b


def _number(v: Any) -> bool:
    return isinstance(v, int | float) and not isinstance(v, bool)


def compare(op: str, a: Any, b: Any) -> Any:
    if op in ("==", "!="):
        return equal(a, b) == (op == "==")
    if not (_number(a) and _number(b) or isinstance(a, str) and isinstance(b, str)):
        return None
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def bounds(n: int, start: int | None, stop: int | None, step: int | None) -> list[int]:
    return list(range(n))[slice(start, stop, step)]


def search(text: str, value: Any, params: dict[str, Any] | None = None) -> Any:
    return _eval(S.parse_path(text), value, params or {})


def _eval(node: Any, v: Any, params: dict[str, Any]) -> Any:
    go = functools.partial(_eval, params=params)
    match node:
        case S.Current():
            return v
        case S.Field(name):
            return v.get(name) if isinstance(v, dict) else None
        case S.Literal(value):
            return plain(value, params)
        case S.Then(left, right):
            left = go(left, v)
            return None if left is None and not isinstance(right, S.Literal | S.Call | S.Or | S.And | S.Not | S.Compare) else go(right, left)
        case S.Index(at):
            return v[at] if isinstance(v, list) and -len(v) <= at < len(v) else None
        case S.Project(left, items, right):
            base = go(left, v)
            if items.kind == "hash":
                found = [base[k] for k in sorted(base)] if isinstance(base, dict) else None
            elif not isinstance(base, list):
                found = None
            elif items.kind == "flatten":
                found = [y for x in base for y in (x if isinstance(x, list) else [x])]
            elif items.kind == "filter":
                found = [x for x in base if truthy(go(items.arg, x))]
            elif items.kind == "slice":
                found = [base[i] for i in bounds(len(base), *items.arg)]
            else:
                found = base
            if found is None:
                return None
            return [y for x in found if (y := go(right, x)) is not None]
        case S.MultiList(parts):
            return None if v is None else [go(p, v) for p in parts]
        case S.MultiHash(parts):
            return None if v is None else {k: go(p, v) for k, p in parts}
        case S.Compare(op, left, right):
            return compare(op, go(left, v), go(right, v))
        case S.And(left, right):
            left = go(left, v)
            return go(right, v) if truthy(left) else left
        case S.Or(left, right):
            left = go(left, v)
            return left if truthy(left) else go(right, v)
        case S.Not(part):
            return not truthy(go(part, v))
        case S.Call(name, args):
            return _call(name, [a.body if isinstance(a, S.Lambda) else go(a, v) for a in args], go)
    raise PathError(f"{node} has no value")


def _call(name: str, args: list[Any], go) -> Any:
    a = args[0] if args else None
    array = a if isinstance(a, list) else None
    key = functools.cmp_to_key(lambda x, y: (_order(x) > _order(y)) - (_order(x) < _order(y)))
    match name:
        case "abs":
            return abs(a) if _number(a) else None
        case "ceil" | "floor":
            return a if isinstance(a, int) and _number(a) else float(getattr(math, name)(a)) if _number(a) else None
        case "avg" | "sum":
            if array is None or not all(map(_number, array)):
                return None
            return float(sum(array)) if name == "sum" else (float(sum(array)) / len(array) if array else None)
        case "contains":
            if isinstance(a, str):
                return args[1] in a if isinstance(args[1], str) else False
            return any(equal(x, args[1]) for x in array) if array is not None else None
        case "starts_with" | "ends_with":
            ok = isinstance(a, str) and isinstance(args[1], str)
            return (a.startswith(args[1]) if name == "starts_with" else a.endswith(args[1])) if ok else None
        case "join":
            return a.join(args[1]) if isinstance(a, str) and isinstance(args[1], list) and all(isinstance(x, str) for x in args[1]) else None
        case "keys" | "values":
            return ([k if name == "keys" else a[k] for k in sorted(a)]) if isinstance(a, dict) else None
        case "length":
            return len(a) if isinstance(a, str | list | dict) else None
        case "map":
            return [go(args[0], x) for x in args[1]] if isinstance(args[1], list) else None
        case "max" | "min":
            known = [x for x in array or [] if x is not None]
            return (max if name == "max" else min)(known, key=key) if known else None
        case "max_by" | "min_by":
            known = [x for x in array or [] if go(args[1], x) is not None]
            return (max if name == "max_by" else min)(known, key=lambda x: key(go(args[1], x))) if known else None
        case "merge":
            return functools.reduce(lambda x, y: x | y, args, {}) if all(isinstance(x, dict) for x in args) else None
        case "not_null":
            return next((x for x in args if x is not None), None)
        case "reverse":
            return array[::-1] if array is not None else None
        case "sort":
            return sorted(array, key=key) if array is not None else None
        case "sort_by":
            return sorted(array, key=lambda x: key(go(args[1], x))) if array is not None else None
        case "to_array":
            return array if array is not None else [a]
        case "to_string":
            return a if isinstance(a, str) or a is None else json.dumps(a, separators=(",", ":"), sort_keys=True, ensure_ascii=False)
        case "to_double":
            try:
                return a if _number(a) else float(a) if isinstance(a, str) else None
            except ValueError:
                return None
        case "to_bigint":
            try:
                return int(a) if _number(a) or isinstance(a, bool) else int(a, 10) if isinstance(a, str) else None
            except ValueError:
                return None
        case "to_boolean":
            return None if a is None else a not in ("false", "0") and truthy(a) if isinstance(a, str) else a != 0 if _number(a) else truthy(a)
        case "type":
            return (None, "Boolean", "BigInt" if isinstance(a, int) else "Double", "Varchar", "ObjectArray", "ObjectMap")[rank(a)]
    raise PathError(f"unknown function {name}")
