"""The language's primitives as Spark columns.

Where Spark's built-in differs (padding zips, real division, errors on duplicate keys,
nulls for missing keys) the column is built so that the language's meaning holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(a: Column, b: Column) -> Column:
    """Real division with 0 for a zero divisor."""
    return F.when(b == 0, F.lit(0)).otherwise(a / F.when(b != 0, b))


def int_divide(a: Column, b: Column) -> Column:
    """Division that truncates toward zero, 0 for a zero divisor."""
    return F.when(b == 0, F.lit(0)).otherwise(F.call_function("div", a, F.when(b != 0, b)))


def zip_lists(a: Column, b: Column) -> Column:
    """Pairs up to the end of the shorter list."""
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.struct(x.alias("_0"), y.alias("_1")))


def head(xs: Column) -> Column:
    """The first element; null for an empty list."""
    return F.try_element_at(xs, F.lit(1))


def tail(xs: Column) -> Column:
    """All but the first element; empty for an empty list."""
    return F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0)))


def update_map(m: Column, k: Column, v: Column) -> Column:
    return concat_map(m, F.create_map(k, v))


def concat_map(a: Column, b: Column) -> Column:
    """All keys of both; where both have one, the second's value."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def merge_with(f: Callable, a: Column, b: Column) -> Column:
    """All keys of both; where both have one, the values combined."""
    return F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(f(x, y)))


def map_values(f: Callable, m: Column) -> Column:
    """``f(key, present, value) -> (keep, value)`` on every entry."""
    changed = F.transform_values(m, lambda k, v: F.struct(*[c.alias(n) for n, c in zip("kv", f(k, F.lit(True), v))]))
    return F.transform_values(F.map_filter(changed, lambda k, kv: kv["k"]), lambda k, kv: kv["v"])


def outer_join_lists(a: Column, b: Column, absent: Column) -> Column:
    """Pairs by place up to the end of the longer list."""
    return F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(x, absent).alias("_0"), F.coalesce(y, absent).alias("_1")))


def outer_join_maps(a: Column, b: Column, absent: Column) -> Column:
    return F.map_zip_with(a, b, lambda k, x, y: F.struct(F.coalesce(x, absent).alias("_0"), F.coalesce(y, absent).alias("_1")))


def foldl(f: Callable, zero: Column, xs: Column) -> Column:
    return F.aggregate(xs, zero, f)


HIGHER_ORDER = {
    "map": lambda f, xs: F.transform(xs, f),
    "filter": lambda f, xs: F.filter(xs, f),
    "filter_set": lambda f, xs: F.filter(xs, f),
    "map_set": lambda f, xs: F.array_distinct(F.transform(xs, f)),
    "filter_values": lambda f, m: F.map_filter(m, lambda k, v: f(v)),
}

FIRST_ORDER = {
    "zip": zip_lists, "head": head, "tail": tail, "id": lambda x: x, "max": F.greatest, "min": F.least, "abs": F.abs,
    "set_add": lambda v, s: F.array_union(s, F.array(v)), "union": F.array_union, "intersection": F.array_intersect,
    "is_set_empty": lambda s: F.size(s) == 0, "update_map": update_map, "contains_key": lambda m, k: F.map_contains_key(m, k),
    "concat_map": concat_map, "outer_join": lambda a, b: outer_join_lists(a, b, F.lit(0).cast("bigint")), "length": lambda x: F.length(x), "size": lambda x: F.size(x),
}
