"""JSON text functions, on VARIANT where Spark has it."""

from __future__ import annotations

import decimal
import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def path_of(keys: Sequence[str | int]) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f"['{k}']" for k in keys)


def get_path(j: Column, *keys: str | int) -> Column:
    """JSON text of the value at a path; NULL when the path does not exist."""
    return F.to_json(F.variant_get(F.parse_json(j), path_of(keys), "variant"))


def get_text(j: Column, *keys: str | int) -> Column:
    """Value at a path as text, without quotes; JSON null gives NULL."""
    return F.get_json_object(j, path_of(keys))


def elements(j: Column) -> Column:
    """JSON text of each array element."""
    return F.transform(F.from_json(j, "array<variant>"), lambda v: F.to_json(v))


def element_from_end(j: Column, i: int) -> Column:
    """Element by a negative index; -1 is the last."""
    return F.try_element_at(elements(j), F.lit(i))


def entries(j: Column) -> Column:
    """Map from key to JSON text of the value, one level deep."""
    return F.transform_values(F.from_json(j, "map<string,variant>"), lambda k, v: F.to_json(v))


def keys(j: Column) -> Column:
    return F.json_object_keys(j)


def type_of(j: Column) -> Column:
    """object, array, string, number, boolean or null."""
    head = F.substring(F.ltrim(j), 1, 1)
    return (
        F.when(head == "{", "object").when(head == "[", "array").when(head == '"', "string").when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null").otherwise("number")
    )


def quote(text: Column) -> Column:
    """JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(text)), r"^\[(.*)\]$", 1)


def from_entries(m: Column) -> Column:
    """JSON object text from a map of key to JSON text, keys sorted."""
    pairs = F.array_sort(F.map_entries(m))
    return F.concat(
        F.lit("{"), F.array_join(F.transform(pairs, lambda e: F.concat(quote(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null")))), ","), F.lit("}")
    )


def build_object(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def build_array(*items: Column) -> Column:
    """JSON array of items of mixed types."""
    part = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"^\[(.*)\]$", 1), F.lit("null"))
    return F.concat(F.lit("["), F.concat_ws(",", *[part(c) for c in items]), F.lit("]"))


def strip_nulls(j: Column) -> Column:
    """Drop object fields with value null, at any depth; array nulls stay."""
    # a string literal is matched whole, so text inside it is never touched
    literal = r'"(?:[^"\\]|\\.)*+"'
    clean = F.to_json(F.parse_json(j))
    marked = F.regexp_replace(clean, f"({literal}):null(?=[,}}])", "\u0000")
    marked = F.regexp_replace(marked, "\u0000,", "")
    return F.regexp_replace(F.regexp_replace(marked, ",\u0000", ""), "\u0000", "")


def _names(j: Column) -> Column:
    """Keys of an object, or the strings of an array."""
    texts = F.filter(elements(j), lambda x: F.startswith(F.ltrim(x), F.lit('"')))
    return F.coalesce(keys(j), F.transform(texts, lambda x: F.get_json_object(F.concat(F.lit("["), x, F.lit("]")), "$[0]")))


def has_key(j: Column, key: str) -> Column:
    return F.array_contains(_names(j), key)


def has_any(j: Column, names: Sequence[str]) -> Column:
    return F.arrays_overlap(_names(j), F.array(*[F.lit(n) for n in names]))


def has_all(j: Column, names: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), _names(j))) == 0


def concat(a: Column, b: Column) -> Column:
    """Object union in which the right side wins."""
    x, y = entries(a), entries(b)
    return from_entries(F.map_concat(F.map_filter(x, lambda k, v: ~F.map_contains_key(y, k)), y))


def without_keys(j: Column, *names: str) -> Column:
    return from_entries(F.map_filter(entries(j), lambda k, v: ~k.isin(*names)))


def without_index(j: Column, i: int) -> Column:
    """Array without one element; a negative index counts from the end."""
    items = elements(j)
    at = F.lit(i) if i >= 0 else F.size(items) + i
    return F.concat(F.lit("["), F.array_join(F.filter(items, lambda x, k: k != at), ","), F.lit("]"))


def _is(j: Column, opening: str) -> Column:
    return F.startswith(F.ltrim(j), F.lit(opening))


def _place(items: Column, step: str) -> Column | None:
    """Position, from 0, that a path step names in an array; None if it is no integer."""
    if not re.fullmatch(r"[+-]?[0-9]+", step):
        return None
    i = int(step)
    return F.lit(i) if i >= 0 else F.size(items) + i


def _child(j: Column, step: str) -> Column:
    """Field or element a path step leads to; NULL if there is none."""
    items = elements(j)
    at = _place(items, step)
    field = F.when(_is(j, "{"), F.element_at(entries(j), F.lit(step)))
    return field if at is None else F.when(_is(j, "["), F.get(items, at)).otherwise(field)


def _array_text(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def set_path(j: Column, path: Sequence[str], value: Column, create: bool = True) -> Column:
    """The value at a path of keys and array positions replaced, or added when ``create``.

    Negative positions count from the end; one past either end adds there. A path that leads nowhere changes nothing.
    """
    head, rest = path[0], list(path[1:])
    fresh = set_path(_child(j, head), rest, value, create) if rest else value
    add = create and not rest
    fields = entries(j)
    changed = from_entries(F.map_concat(F.map_filter(fields, lambda k, v: k != head), F.create_map(F.lit(head), fresh)))
    out = F.when(_is(j, "{") & (F.lit(add) | F.map_contains_key(fields, F.lit(head))), changed)
    items = elements(j)
    at = _place(items, head)
    if at is not None:
        inside = _is(j, "[") & (at >= 0) & (at < F.size(items))
        out = out.when(inside, _array_text(F.transform(items, lambda x, k: F.when(k == at, fresh).otherwise(x))))
        if add:
            one = F.array(fresh)
            out = out.when(_is(j, "["), _array_text(F.when(at < 0, F.concat(one, items)).otherwise(F.concat(items, one))))
    return out.otherwise(j)


def insert_path(j: Column, path: Sequence[str], value: Column) -> Column:
    """Add a new key, or an element before a position; a key that exists is left as it is."""
    head, rest = path[0], list(path[1:])
    if rest:
        inner = _child(j, head)
        return F.when(inner.isNull(), j).otherwise(set_path(j, [head], insert_path(inner, rest, value), False))
    out = F.when(_is(j, "{"), F.when(F.map_contains_key(entries(j), F.lit(head)), j).otherwise(set_path(j, [head], value)))
    items = elements(j)
    at = _place(items, head)
    if at is not None:
        before, after = F.filter(items, lambda x, k: k < at), F.filter(items, lambda x, k: k >= at)
        out = out.when(_is(j, "["), _array_text(F.concat(before, F.array(value), after)))
    return out.otherwise(j)


def delete_path(j: Column, path: Sequence[str]) -> Column:
    head, rest = path[0], list(path[1:])
    if rest:
        inner = _child(j, head)
        return F.when(inner.isNull(), j).otherwise(set_path(j, [head], delete_path(inner, rest), False))
    out = F.when(_is(j, "{"), without_keys(j, head))
    if re.fullmatch(r"[+-]?[0-9]+", head):
        out = out.when(_is(j, "["), without_index(j, int(head)))
    return out.otherwise(j)


def canonical(j: Column) -> Column:
    """Text with object keys sorted at every level: equal values have equal text."""
    return F.to_json(F.parse_json(j))


def _holds(v: Column, pattern, top: bool) -> Column:
    missing = F.lit(False)
    if isinstance(pattern, dict):
        test = F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), missing)
        for key, sub in pattern.items():
            test = test & _holds(F.try_variant_get(v, path_of([key]), "variant"), sub, False)
        return test
    items = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(pattern, list):
        test = items.isNotNull()
        for sub in pattern:
            test = test & F.coalesce(F.exists(items, lambda x: _holds(x, sub, False)), missing)
        return test
    if pattern is None:
        same = F.is_variant_null(v)
    elif isinstance(pattern, bool):
        same = F.try_variant_get(v, "$", "boolean") == pattern
        same = same & (F.schema_of_variant(v) == "BOOLEAN")
    elif isinstance(pattern, (int, float)):
        same = (F.try_variant_get(v, "$", "double") == float(pattern)) & ~F.schema_of_variant(v).isin("STRING", "BOOLEAN")
    else:
        same = (F.try_variant_get(v, "$", "string") == pattern) & (F.schema_of_variant(v) == "STRING")
    same = F.coalesce(same, missing)
    if top:  # an array holds a bare scalar
        same = same | F.coalesce(F.exists(items, lambda x: _holds(x, pattern, False)), missing)
    return same


def contains(j: Column, pattern: str) -> Column:
    """Is every key and element of the JSON text ``pattern`` found in ``j``?

    The pattern is read once on the driver and becomes a plain predicate.
    """
    return _holds(F.parse_json(j), json.loads(pattern), True)


@F.pandas_udf(T.BooleanType())
def _contains_json(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else held_in(_read(x), _read(y), True) for x, y in zip(a, b)], dtype="boolean")


def contains_json(a: Column, b: Column) -> Column:
    """``a @> b`` for two JSON texts of any shape: each key of an object with a value that holds the other's, each
    element of an array in some element; at the top an array also holds a plain value. Texts that are no JSON raise."""
    return _contains_json(a, b)


@F.pandas_udf(T.ArrayType(T.StringType()))
def leaves(j: pd.Series) -> pd.Series:
    """Plain values of a JSON text with their path of keys, without the places in arrays; distinct."""
    return pd.Series([None if x is None else sorted(set(_leaves(_read(x), ""))) for x in j])


def _read(text: str):
    # numbers as exact decimals, so that 1, 1.0 and 10e-1 are equal and long ones keep their digits
    return json.loads(text, parse_int=decimal.Decimal, parse_float=decimal.Decimal)


def held_in(a, b, top: bool = False) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and held_in(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        if not isinstance(a, list):
            return False
        # plain elements by lookup, the others one by one
        plain = {(type(x), x) for x in a if not isinstance(x, (dict, list))}
        return all(any(held_in(y, x) for y in a if isinstance(y, (dict, list))) if isinstance(x, (dict, list)) else (type(x), x) in plain for x in b)
    if top and isinstance(a, list):
        return any(type(x) is type(b) and x == b for x in a)
    return type(a) is type(b) and a == b


def _leaves(x, path: str):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from _leaves(v, path + json.dumps(k) + ":")
    elif isinstance(x, list):
        for v in x:
            yield from _leaves(v, path)
    else:
        # equal decimals are written alike
        yield path + (str(x.normalize()) if isinstance(x, decimal.Decimal) and x else "0" if isinstance(x, decimal.Decimal) else json.dumps(x))


def pretty(j: Column) -> Column:
    return F.to_json(F.parse_json(j), {"pretty": "true"})
