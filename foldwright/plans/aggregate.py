"""A fold over grouped rows as a Spark plan.

The derivation picks the plan.  Leaves with a built-in form (sums, extremes, flags, sets,
rows by order or key, lists) become one ``groupBy().agg()`` with partial and final stages.
Map and vector leaves are exploded and aggregated by (keys, entry), so a state never has
to fit in one task; they come as rows, and are folded into one map or array a group only
on request.  Leaves whose value depends on how far others have come (a sum frozen by a
sentinel, a running sum kept at some rows) first take one window value a group, by the
same partitioning.  What remains is folded in order (``ordered``), or by the derived merge
over partial states in Python (``runtime``).
"""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lang.ast import Cons, Fold, Lit, Nil, Ty
from ..synth.derive import derive_merge, Derivation, Shape
from .columns import to_column

_SQL = {"bool": "boolean", "str": "string"}
_ROWS = {"elementwise"}


def row_names(t: Ty, columns: Any, name: str = "x") -> dict[str, Column]:
    """Names of a row's leaves with their columns, from columns nested like the row type."""
    if t.kind != "tuple":
        return {name: columns}
    out = {}
    for i, (a, c) in enumerate(zip(t.args, columns, strict=True)):
        out |= row_names(a, c, f"{name}.{i}")
    return out


class Aggregate:
    """``fold`` over ``keys`` with rows given by ``row``, in the order of ``order``.

    ``row``: a column, or columns nested like the row type.  ``order``: a column that is
    unique inside a group; needed only by leaves that depend on order.  ``number``: the
    SQL type of numbers in collections and zeros.
    """

    def __init__(self, fold: Fold, keys: dict[str, Column], row: Any, order: Column | None = None, number: str = "bigint"):
        self.fold, self.keys, self.order, self.number = fold, keys, order, number
        self.env = row_names(fold.row, row)

    @cached_property
    def derivation(self) -> Derivation:
        return derive_merge(self.fold)

    # ------------------------------------------------------------ pieces

    @staticmethod
    def column_name(s: Shape) -> str:
        return "s" + "".join(f"_{i}" for i in s.leaf.path)

    def is_rows(self, s: Shape) -> bool:
        return s.kind in _ROWS or s.kind.startswith("map_") or s.kind == "each"

    def _col(self, e, env=None) -> Column:
        return to_column(e, env or self.env)

    def _zero(self, s: Shape, c: Column) -> Column:
        """The aggregate, or the fold's zero where no row counted; infinite zeros stay null."""
        zero = s.leaf.init
        if zero in (float("inf"), float("-inf")):
            return c
        return F.coalesce(c, F.lit(zero))

    def native(self, s: Shape, env: dict | None = None) -> Column:
        """The built-in aggregate of a scalar, set or list leaf."""
        env = env or self.env
        e = self._col(s.e, env) if s.e is not None and s.kind not in ("append", "keep") else None
        cond = self._col(s.cond, env) if s.cond is not None else None
        guarded = lambda c: F.when(cond, c) if cond is not None else c
        zero = s.leaf.init
        k = s.kind
        if k == "keep":
            return F.max(F.lit(zero))
        if k in ("sum", "cell_sum"):
            if isinstance(s.e, Lit):
                total = F.count(F.lit(1)) * s.e.value
            else:
                total = F.coalesce(F.sum(e), F.lit(0))
            return total + F.lit(zero) if zero else total
        if k in ("max", "min"):
            c = F.max(guarded(e)) if k == "max" else F.min(guarded(e))
            if zero in (float("inf"), float("-inf")):
                return c
            return (F.greatest if k == "max" else F.least)(F.lit(zero), c)
        if k in ("or", "and"):
            return self._zero(s, (F.bool_or if k == "or" else F.bool_and)(e))
        if k == "set_add":
            return F.array_sort(F.collect_set(guarded(e)))
        if k == "set_union":
            return F.array_sort(F.array_distinct(F.flatten(F.collect_set(guarded(e)))))
        if k in ("append", "prepend"):
            one = isinstance(s.e, Cons) and s.e.tail == Nil() if k == "append" else True
            value = self._col(s.e.head if k == "append" and one else s.e, env)
            item = F.struct(self.order.alias("o"), value.alias("v"))
            rows = F.transform(F.array_sort(F.collect_list(guarded(item))), lambda x: x["v"])
            return F.reverse(rows) if k == "prepend" else rows if one else F.flatten(rows)
        if k == "last":
            return self._zero(s, F.max_by(e, self.order))
        if k == "last_if":
            return self._zero(s, F.max_by(e, F.when(cond, self.order)))
        if k == "first":
            return self._zero(s, F.min_by(e, F.when(cond, self.order)))
        if k == "arg_max":
            return self._zero(s, F.max_by(e, F.struct(self._col(s.key, env), -self.order)))
        if k == "arg_min":
            return self._zero(s, F.min_by(e, F.struct(self._col(s.key, env), self.order)))
        if k == "freeze_sum":
            stop = F.col("__stop")
            return F.coalesce(F.sum(F.when(stop.isNull() | (self.order < stop), e)), F.lit(0))
        if k == "prefix_sum_at":
            return F.coalesce(F.sum(F.when(self.order <= F.col("__last"), e)), F.lit(0))
        raise ValueError(f"{k} has no built-in form")

    def prepared(self, df: DataFrame) -> DataFrame:
        """``df`` with a group-wide value for the leaves that need one."""
        wanted = {}
        for s in self.derivation.shapes:
            if s.kind == "freeze_sum":
                wanted["__stop"] = F.min(F.when(self._col(s.cond), self.order))
            if s.kind == "prefix_sum_at":
                wanted["__last"] = F.max(F.when(self._col(s.cond), self.order))
        if not self.keys:  # one value for all: no task gets every row
            return df.withColumns({n: df.agg(c.alias(n)).scalar() for n, c in wanted.items()})
        w = Window.partitionBy(*self.keys.values())
        return df.withColumns({n: c.over(w) for n, c in wanted.items()})

    # ------------------------------------------------------------ plans

    def scalars(self, df: DataFrame, counted: frozenset[str] = frozenset()) -> DataFrame:
        """keys and one column for every leaf that isn't a map or vector.

        Of the sets named in ``counted`` only the number of members comes, by a distinct count over
        (keys, member), so that no task holds a whole set.
        """
        shapes = [s for s in self.derivation.shapes if not self.is_rows(s)]
        if any(s.kind in ("unknown", "enumerated") for s in shapes):
            return self.ordered(df)
        def column(s: Shape) -> Column:
            if self.column_name(s) not in counted:
                return self.native(s)
            if s.kind != "set_add" or s.leaf.init:
                raise ValueError(f"{self.column_name(s)} is no set that rows are added to")
            member = self._col(s.e)
            return F.count_distinct(F.when(self._col(s.cond), member) if s.cond is not None else member)

        aggs = [column(s).alias(self.column_name(s)) for s in shapes]
        return self.prepared(df).groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(*aggs)

    def over(self, window) -> dict[str, Column]:
        """The leaves as window functions, for frames that begin with the group and end at the current row.

        Raises for leaves that have no such form: maps, vectors, and what is folded in order.
        """
        out = {}
        for s in self.derivation.shapes:
            name, zero, k = self.column_name(s), s.leaf.init, s.kind
            e = self._col(s.e) if s.e is not None and k not in ("append", "prepend", "keep") else None
            cond = self._col(s.cond) if s.cond is not None else None
            guarded = F.when(cond, e) if cond is not None and e is not None else e
            if k == "sum":
                c = F.coalesce(F.sum(F.lit(s.e.value) if isinstance(s.e, Lit) else e).over(window), F.lit(0))
                c = c + F.lit(zero) if zero else c
                out[name] = c.cast("bigint") if isinstance(s.e, Lit) else c
            elif k in ("max", "min"):
                c = (F.max if k == "max" else F.min)(guarded).over(window)
                out[name] = c if zero in (float("inf"), float("-inf")) else (F.greatest if k == "max" else F.least)(F.lit(zero), c)
            elif k in ("or", "and"):
                out[name] = F.coalesce((F.bool_or if k == "or" else F.bool_and)(e).over(window), F.lit(zero))
            elif k == "keep":
                out[name] = F.lit(zero)
            elif k == "last":
                out[name] = self._zero(s, F.last(e).over(window))
            elif k == "last_if":
                out[name] = self._zero(s, F.last(F.when(cond, F.struct(e.alias("v"))), ignorenulls=True).over(window)["v"])
            elif k == "first":
                taken = F.struct(e.alias("v"))
                out[name] = self._zero(s, F.first(F.when(cond, taken) if cond is not None else taken, ignorenulls=True).over(window)["v"])
            elif k in ("arg_max", "arg_min"):
                rank = F.struct(self._col(s.key), -self.order if k == "arg_max" else self.order)
                out[name] = self._zero(s, (F.max_by if k == "arg_max" else F.min_by)(e, rank).over(window))
            elif k == "set_add":
                out[name] = F.array_sort(F.collect_set(guarded).over(window))
            elif k == "set_union":
                out[name] = F.array_sort(F.array_distinct(F.flatten(F.collect_list(guarded).over(window))))
            else:
                raise ValueError(f"{name}: {k} has no form as a window function")
        return out

    def entries(self, df: DataFrame, path: tuple = ()) -> DataFrame:
        """keys, ``k`` (map key, or place from 0) and the aggregate of every entry of one leaf."""
        if "k" in self.keys:
            raise ValueError("k names the entry's key; give the group another name")
        s = next(s for s in self.derivation.shapes if s.leaf.path == path)
        keys = [c.alias(k) for k, c in self.keys.items()]
        order = self.order if self.order is not None else F.lit(0)
        if s.kind == "elementwise":
            element = s.leaf.ty.args[0]
            out = df.select(*keys, order.alias("__o"), F.posexplode(self._col(s.e)).alias("k", "__y"))
            out = out.where(F.col("k") < len(s.leaf.init))  # pairing ends with the shorter list
            y = F.col("__y")
            env = {f"y{''.join('.' + str(i) for i in p)}": _field(y, p) for p in _paths(element)}
            cell = Aggregate(self.fold, {}, F.lit(0), F.col("__o"), self.number) if self.fold.row.kind != "tuple" else self
            aggs = [cell.native(i, env).alias("v" + "".join(f"_{j}" for j in i.leaf.path)) for i in s.inner]
            return out.groupBy(*self.keys, "k").agg(*aggs)
        place = F.lit(0)
        env = self.env
        if s.kind == "each":
            y = F.col("__y")
            df = df.select(*df.columns, F.posexplode(self._col(s.e)).alias("__place", "__y"))
            element = "_0" in (df.schema["__y"].dataType.fieldNames() if hasattr(df.schema["__y"].dataType, "fieldNames") else [])
            names = df.schema["__y"].dataType.fieldNames() if element or hasattr(df.schema["__y"].dataType, "fieldNames") else []
            env = {**env, "y": y, **{f"y.{i}": y[n] for i, n in enumerate(names)}}
            place, s = F.col("__place"), s.inner[0]
        if s.kind in ("map_put_all", "map_first_all"):
            out = df.select(*keys, order.alias("__o"), place.alias("__p"), F.explode(self._col(s.e, env)).alias("k", "__v"))
        else:
            out = df.select(*keys, order.alias("__o"), place.alias("__p"), self._col(s.key, env).alias("k"), self._col(s.e, env).alias("__v"))
        at = F.struct("__o", "__p")
        agg = {"map_sum": lambda: F.sum("__v"), "map_max": lambda: F.max("__v"), "map_min": lambda: F.min("__v"), "map_put": lambda: F.max_by("__v", at), "map_put_all": lambda: F.max_by("__v", at), "map_first": lambda: F.min_by("__v", at), "map_first_all": lambda: F.min_by("__v", at)}[s.kind]()
        return out.groupBy(*self.keys, "k").agg(agg.alias("v"))

    def collected(self, df: DataFrame, path: tuple = ()) -> DataFrame:
        """keys and ``s``: the leaf as one map or array a group, for groups known to be small."""
        rows = self.entries(df, path)
        values = [c for c in rows.columns if c == "v" or c.startswith("v_")]
        value = F.col("v") if values == ["v"] else F.struct(*values)
        s = next(s for s in self.derivation.shapes if s.leaf.path == path)
        if s.kind == "elementwise":
            built = F.transform(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))), lambda x: x["v"])
        else:
            built = F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", value.alias("v")))))
        return rows.groupBy(*self.keys).agg(built.alias("s"))

    def ordered(self, df: DataFrame) -> DataFrame:
        """Any scalar state, by folding each group's rows in order; a group's rows must fit in one task."""
        from ..synth.state import plan_state

        leaves = plan_state(self.fold)
        sql = lambda t: _SQL.get(t.kind, self.number)
        names = {leaf.name: f"f{i}" for i, leaf in enumerate(leaves)}
        row = {n: f"c{i}" for i, n in enumerate(self.env)}
        item = F.struct(self.order.alias("o"), *[c.alias(row[n]) for n, c in self.env.items()])
        zero = F.struct(*[F.lit(None if leaf.init in (float("inf"), float("-inf")) else leaf.init).cast(sql(leaf.ty)).alias(names[leaf.name]) for leaf in leaves])

        def step(s, x):
            env = {n: s[f] for n, f in names.items()} | {n: x[c] for n, c in row.items()}
            return F.struct(*[to_column(leaf.update, env).cast(sql(leaf.ty)).alias(names[leaf.name]) for leaf in leaves])

        folded = F.aggregate(F.array_sort(F.collect_list(item)), zero, step).alias("__s")
        out = df.groupBy(*[c.alias(k) for k, c in self.keys.items()]).agg(folded)
        return out.select(*self.keys, *[F.col("__s")[names[leaf.name]].alias("s" + "".join(f"_{i}" for i in leaf.path)) for leaf in leaves])


def _paths(t: Ty, path: tuple = ()) -> list[tuple]:
    return [path] if t.kind != "tuple" else [p for i, a in enumerate(t.args) for p in _paths(a, (*path, i))]


def _field(c: Column, path: tuple) -> Column:
    for i in path:
        c = c[f"_{i}"]
    return c
