"""List and mapping helpers.  Each works on Spark columns and, given plain values, on Python lists and dicts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_non_string_iterable(value: Any) -> bool:
    """Lists, tuples, sets, mappings and generators, but no strings."""
    return isinstance(value, Iterable) and not isinstance(value, str | bytes)


def _ordered(values: Iterable) -> list:
    out: list = []
    for v in values:
        if v not in out:
            out.append(v)
    return out


def _or_empty(array: Column, like: Column) -> Column:
    """A null array as an empty one of the same type."""
    return F.coalesce(array, F.filter(like, lambda _: F.lit(False)))


def array_unique(values: Any) -> Any:
    """Distinct items in the order of their first appearance."""
    return F.array_distinct(values) if isinstance(values, Column) else _ordered(values)


def array_union(*arrays: Any) -> Any:
    """Distinct items of all arrays in order.  Plain values that are no lists are passed over, as null columns are."""
    if arrays and isinstance(arrays[0], Column):
        out = arrays[0]
        for a in arrays[1:]:
            out = F.coalesce(F.array_union(out, a), out, a)
        return F.array_distinct(out)
    return _ordered(v for a in arrays if is_non_string_iterable(a) for v in a)


def array_intersection(first: Any, *rest: Any) -> Any:
    """Distinct items of the first array that all others hold; others that are no lists (null columns) do not count."""
    if isinstance(first, Column):
        out = F.array_distinct(first)
        for a in rest:
            out = F.when(a.isNull(), out).otherwise(F.array_intersect(out, a))
        return out
    if not is_non_string_iterable(first):
        return []
    others = [list(a) for a in rest if is_non_string_iterable(a)]
    return [v for v in _ordered(first) if all(v in a for a in others)]


def array_difference(first: Any, *rest: Any) -> Any:
    """Distinct items of the first array that none of the others holds."""
    if isinstance(first, Column):
        out = F.array_distinct(first)
        for a in rest:
            out = F.array_except(out, _or_empty(a, first))
        return out
    if not is_non_string_iterable(first):
        return []
    others = [list(a) for a in rest if is_non_string_iterable(a)]
    return [v for v in _ordered(first) if not any(v in a for a in others)]


def get_ignore_case(mapping: Any, key: Any, default: Any = None) -> Any:
    """The value of the exact key, else of the first key equal but for case, else the default."""
    if isinstance(mapping, Column):
        key, default = (x if isinstance(x, Column) else F.lit(x) for x in (key, default))
        near = F.map_values(F.map_filter(mapping, lambda k, _: F.lower(k) == F.lower(key)))
        return F.when(F.map_contains_key(mapping, key), F.try_element_at(mapping, key)).when(F.size(near) > 0, F.get(near, F.lit(0))).otherwise(default)
    if not isinstance(mapping, Mapping):
        return default
    if key in mapping:
        return mapping[key]
    if isinstance(key, str):
        for k, v in mapping.items():
            if isinstance(k, str) and k.lower() == key.lower():
                return v
    return default


def has_keys(mapping: Any, *keys: Any) -> Any:
    """Whether a mapping has every key; null values count as present, anything but a mapping has none."""
    if isinstance(mapping, Column):
        found = F.lit(True)
        for k in keys:
            found = found & F.map_contains_key(mapping, k if isinstance(k, Column) else F.lit(k))
        return F.coalesce(found, F.lit(False))
    return isinstance(mapping, Mapping) and all(k in mapping for k in keys)


def join_strings(value: Any) -> Any:
    """A list as one string with `, ` between; anything else unchanged."""
    if isinstance(value, Column):
        return F.array_join(value, ", ")
    return ", ".join(str(v) for v in value) if is_non_string_iterable(value) else value


def unjoin_strings(value: Any) -> Any:
    """A string as a list of itself; anything else unchanged."""
    if isinstance(value, Column):
        return F.array(value)
    return [value] if isinstance(value, str) else value
