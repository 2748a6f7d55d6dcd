"""Folds written as Python classes.

    class Bids(Aggregator):
        state = "(num, num)"
        row = "num"
        def zero(self):
            return (0, 0)
        def reduce(self, s, x):
            return (s[0] + x, s[1] + 1)

``reduce`` is called once with symbols; ``when``, ``maximum``, ``minimum`` and the
collection helpers stand for what Python can't overload.
"""

from __future__ import annotations

from ..lang.ast import Bin, call, Cons, Expr, Fold, Get, Ite, Lam, Lit, MapGet, MapSet, Nil, Tup, Ty, Un, Var
from ..lang.parser import _Reader


def _type(text: str) -> Ty:
    return _Reader(text).type()


class Symbol:
    """A value that records what is done with it."""

    __hash__ = None

    def __init__(self, e: Expr, ty: Ty | None = None):
        self.e, self.ty = e, ty

    def __bool__(self):
        raise TypeError("conditions are written with when(condition, then, otherwise)")

    def __getitem__(self, i):
        if isinstance(i, int) and (self.ty is None or self.ty.kind == "tuple"):
            return Symbol(Get(self.e, i), self.ty.args[i] if self.ty else None)
        return Symbol(MapGet(self.e, lift(i)), self.ty.args[1] if self.ty else None)

    def put(self, k, v) -> Symbol:
        return Symbol(MapSet(self.e, lift(k), lift(v)), self.ty)

    def add(self, v) -> Symbol:
        return Symbol(call("set_add", lift(v), self.e), self.ty)

    def append(self, v) -> Symbol:
        return Symbol(Bin("++", self.e, Cons(lift(v), Nil())), self.ty)


def _operator(op: str, flip: bool = False, negate: bool = False):
    def go(self, other):
        a, b = self.e, lift(other)
        out: Expr = Bin(op, *((b, a) if flip else (a, b)))
        return Symbol(Un("not", out) if negate else out)

    return go


for _name, _op in (("add", "+"), ("sub", "-"), ("mul", "*"), ("truediv", "/")):
    setattr(Symbol, f"__{_name}__", _operator(_op))
    setattr(Symbol, f"__r{_name}__", _operator(_op, flip=True))
for _name, _op, _not in (("lt", "<", False), ("gt", ">", False), ("le", ">", True), ("ge", "<", True), ("eq", "=", False), ("ne", "=", True), ("and", "&&", False), ("or", "||", False)):
    setattr(Symbol, f"__{_name}__", _operator(_op, negate=_not))
Symbol.__invert__ = lambda self: Symbol(Un("not", self.e))
Symbol.__neg__ = lambda self: Symbol(Un("-", self.e))


def lift(v) -> Expr:
    """An expression from a symbol, number, text, flag, tuple, list, or empty set or dict."""
    if isinstance(v, Symbol):
        return v.e
    if isinstance(v, tuple):
        return Tup(tuple(map(lift, v)))
    if isinstance(v, list):
        out: Expr = Nil()
        for x in reversed(v):
            out = Cons(lift(x), out)
        return out
    if isinstance(v, (dict, set, frozenset)):
        if v:
            raise TypeError("only empty sets and maps are literals")
        return Var("empty_map" if isinstance(v, dict) else "empty_set")
    if v in (float("inf"), float("-inf")):
        return Var("_mx" if v > 0 else "_mn")
    return Lit(v)


def when(condition, then, otherwise) -> Symbol:
    return Symbol(Ite(lift(condition), lift(then), lift(otherwise)))


def maximum(a, b) -> Symbol:
    return Symbol(call("max", lift(a), lift(b)))


def minimum(a, b) -> Symbol:
    return Symbol(call("min", lift(a), lift(b)))


class Aggregator:
    """Base of fold classes; ``fold()`` gives the fold."""

    state: str
    row: str

    def zero(self):
        raise NotImplementedError

    def reduce(self, s, x):
        raise NotImplementedError

    def fold(self) -> Fold:
        st, rt = _type(self.state), _type(self.row)
        step = lift(self.reduce(Symbol(Var("s"), st), Symbol(Var("x"), rt)))
        return Fold(Lam("s", st, Lam("x", rt, step)), lift(self.zero()), type(self).__name__)
