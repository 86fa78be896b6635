"""Columns for documents: parsing, text, arrays, maps, comparison and kinds of values."""

from __future__ import annotations

import json
from functools import cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.workers import shipped

from .paths import array, equal, get, is_boolean, is_integer, is_number, is_string, mapping, norm, order
from .values import parse_datatype, parse_document, plain, to_text


def _json_texts(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return None if text is None else json.dumps(plain(parse_document(text).value, {}), ensure_ascii=False)
        except (KeyError, ValueError):
            return None

    return texts.map(one)


_NAMES = ("name", "text", "params", "args", "qualifiers")


def _datatypes(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        try:
            t = parse_datatype(text)
            out.append((t.name, str(t), [to_text(p) for p in t.params], [to_text(a) for a in t.args], list(t.qualifiers)))
        except (ValueError, TypeError):
            out.append((None,) * len(_NAMES))
    return pd.DataFrame(out, columns=list(_NAMES))


@cache
def _udfs():
    shipped(SparkSession.active())
    words = T.ArrayType(T.StringType())
    parts = T.StructType([T.StructField(n, T.StringType() if n in ("name", "text") else words) for n in _NAMES])
    return F.pandas_udf(_json_texts, T.StringType()), F.pandas_udf(_datatypes, parts)


def parse(text: Column | str) -> Column:
    """Document text as VARIANT: JSON stays in the JVM, only the superset's other texts go through Python; null if neither."""
    text = F.col(text) if isinstance(text, str) else text
    plain_json = F.try_parse_json(text)
    return norm(F.when(plain_json.isNotNull(), plain_json).otherwise(F.try_parse_json(_udfs()[0](F.when(plain_json.isNull(), text)))))


def datatype(text: Column | str) -> Column:
    """A type expression as a struct of name, canonical text, parameters, constructor arguments and qualifiers."""
    return _udfs()[1](F.col(text) if isinstance(text, str) else text)


def to_string(doc: Column) -> Column:
    return F.to_json(doc)


def to_pretty(doc: Column) -> Column:
    return F.to_json(doc, {"pretty": "true"})


def array_get(doc: Column, i: int) -> Column:
    return norm(F.try_element_at(array(doc), F.lit(i + 1 if i >= 0 else i)))


def array_set(doc: Column, i: int, value: Column) -> Column:
    return F.transform(array(doc), lambda x, k: F.when(k == i, value.cast("variant")).otherwise(x)).cast("variant")


def array_push(doc: Column, value: Column) -> Column:
    return F.array_append(array(doc), value.cast("variant")).cast("variant")


def array_remove(doc: Column, start: int, end: int | None = None) -> Column:
    """Without the items from start up to end (the one at start, by default)."""
    end = start + 1 if end is None else end
    return F.filter(array(doc), lambda x, k: (k < start) | (k >= end)).cast("variant")


def size(doc: Column) -> Column:
    return F.coalesce(F.when(array(doc).isNotNull(), F.size(array(doc))), F.when(mapping(doc).isNotNull(), F.size(mapping(doc))))


def map_get(doc: Column, key: str) -> Column:
    return norm(F.try_element_at(mapping(doc), F.lit(key)))


def map_expect(doc: Column, key: str) -> Column:
    """The value, or an error at run time for a missing key."""
    has = F.coalesce(F.map_contains_key(mapping(doc), F.lit(key)), F.lit(False))
    return F.when(has, map_get(doc, key)).otherwise(F.raise_error(F.lit(f"no key {key}")).cast("variant"))


def map_put(doc: Column, key: str, value: Column) -> Column:
    rest = F.map_filter(mapping(doc), lambda k, _: k != key)
    return F.to_variant_object(F.map_concat(rest, F.create_map(F.lit(key), value.cast("variant"))))


def map_remove(doc: Column, key: str) -> Column:
    return F.to_variant_object(F.map_filter(mapping(doc), lambda k, _: k != key))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in the order of all values; null if either is null."""
    x, y = order(a), order(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(x < y, -1).when(x > y, 1).otherwise(0))


def convert(doc: Column, kind: str) -> Column:
    return get(doc, kind)


equals = equal
is_varchar, is_numeric, is_bool, is_bigint = is_string, is_number, is_boolean, is_integer


def is_array(doc: Column) -> Column:
    return array(doc).isNotNull()


def is_map(doc: Column) -> Column:
    return mapping(doc).isNotNull()
