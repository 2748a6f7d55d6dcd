"""Row expressions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import primitives as P
from ..lang.ast import as_call, Bin, Cons, Expr, Get, Ite, Lam, Lit, MapGet, MapSet, Nil, Tup, Un, Var


class NotNative(Exception):
    """The expression has no column form."""


def to_column(e: Expr, env: dict[str, Column], division=P.divide) -> Column:
    """``env`` maps free names to columns.  Infinities are null, which min and max skip.

    Lists, sets and maps are arrays and maps, tuples structs with fields ``_0``, ``_1`` and
    so on.  ``division`` is real, or ``int_divide``.
    """
    go = lambda x: to_column(x, env, division)

    def function(f: Expr, n: int):
        """A lambda of ``n`` parameters on columns."""
        names = []
        for _ in range(n):
            if not isinstance(f, Lam):
                raise NotNative("a function that isn't a lambda")
            names.append(f.param)
            f = f.body
        bind = lambda *xs: to_column(f, {**env, **dict(zip(names, xs))}, division)
        return (lambda x: bind(x)) if n == 1 else (lambda x, y: bind(x, y))

    if isinstance(e, Lit):
        return F.lit(e.value)
    if isinstance(e, Var):
        if e.name in env:
            return env[e.name]
        if e.name in ("_mn", "_mx"):
            return F.lit(None)
        raise NotNative(f"no column for {e.name}")
    if isinstance(e, Un):
        return ~go(e.e) if e.op == "not" else -go(e.e)
    if isinstance(e, Ite):
        return F.when(go(e.c), go(e.a)).otherwise(go(e.b))
    if isinstance(e, Bin):
        a, b = go(e.a), go(e.b)
        return {
            "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: division(a, b), "<": lambda: a < b, ">": lambda: a > b,
            "=": lambda: a == b, "&&": lambda: a & b, "||": lambda: a | b, "++": lambda: F.concat(a, b),
        }[e.op]()
    if isinstance(e, Tup):
        return F.struct(*[go(x).alias(f"_{i}") for i, x in enumerate(e.items)])
    if isinstance(e, Get):
        return go(e.e)[f"_{e.i}"]
    if isinstance(e, Cons):
        items: list[Column] = []
        while isinstance(e, Cons):
            items.append(go(e.head))
            e = e.tail
        return F.array(*items) if isinstance(e, Nil) else F.concat(F.array(*items), go(e))
    if isinstance(e, MapSet):
        return P.update_map(go(e.m), go(e.k), go(e.v))
    if isinstance(e, MapGet):
        return F.coalesce(F.element_at(go(e.m), go(e.k)), F.lit(0))
    c = as_call(e)
    if c:
        name, args = c
        if name in P.HIGHER_ORDER:
            return P.HIGHER_ORDER[name](function(args[0], 1), go(args[1]))
        if name == "foldl":
            zero = go(args[1])
            if isinstance(args[1], Lit) and type(args[1].value) is int:
                zero = zero.cast("bigint")
            return P.foldl(function(args[0], 2), zero, go(args[2]))
        if name == "filter_map":
            return F.map_filter(go(args[1]), function(args[0], 2))
        if name == "map_values":
            change = function(args[0], 2)
            return P.map_values(lambda k, present, v: (lambda s: (s["_0"], s["_1"]))(change(k, F.struct(present.alias("_0"), v.alias("_1")))), go(args[1]))
        if name == "merge_with":
            return P.merge_with(function(args[0], 2), go(args[1]), go(args[2]))
        if name in P.FIRST_ORDER:
            return P.FIRST_ORDER[name](*map(go, args))
    raise NotNative(f"no column form of {e}")
