"""Types and expressions of folds, their JSON form and their printed form."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from typing import Any

# ------------------------------------------------------------------ types


@dataclass(frozen=True)
class Ty:
    """kind: num, bool, str, list, set, map, tuple, fn or var; args: its parts."""

    kind: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.kind == "tuple":
            return f"({', '.join(map(str, self.args))})"
        if self.kind == "fn":
            return f"({self.args[0]} -> {self.args[1]})"
        if self.kind == "var":
            return f"'{self.args[0]}"
        return f"{self.kind}[{', '.join(map(str, self.args))}]" if self.args else self.kind


NUM, BOOL, STR = Ty("num"), Ty("bool"), Ty("str")


def list_of(t: Ty) -> Ty:
    return Ty("list", (t,))


def set_of(t: Ty) -> Ty:
    return Ty("set", (t,))


def map_of(k: Ty, v: Ty) -> Ty:
    return Ty("map", (k, v))


def tuple_of(*ts: Ty) -> Ty:
    return Ty("tuple", ts)


def fn(*ts: Ty) -> Ty:
    return ts[0] if len(ts) == 1 else Ty("fn", (ts[0], fn(*ts[1:])))


# ------------------------------------------------------------------ expressions


class Expr:
    """Base of all nodes; ``children`` and ``rebuild`` give generic traversal."""

    def children(self) -> tuple[Expr, ...]:
        out: list[Expr] = []
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, Expr):
                out.append(v)
            elif isinstance(v, tuple) and v and isinstance(v[0], Expr):
                out += v
        return tuple(out)

    def map_children(self, f) -> Expr:
        new = {}
        for d in fields(self):
            v = getattr(self, d.name)
            if isinstance(v, Expr):
                new[d.name] = f(v)
            elif isinstance(v, tuple) and v and isinstance(v[0], Expr):
                new[d.name] = tuple(map(f, v))
        return replace(self, **new) if new else self

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children())

    def __str__(self) -> str:
        return show(self)


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Un(Expr):
    op: str
    e: Expr


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    a: Expr
    b: Expr


@dataclass(frozen=True)
class Ite(Expr):
    c: Expr
    a: Expr
    b: Expr


@dataclass(frozen=True)
class App(Expr):
    f: Expr
    x: Expr


@dataclass(frozen=True)
class Lam(Expr):
    param: str
    ty: Ty | None
    body: Expr


@dataclass(frozen=True)
class Let(Expr):
    name: str
    e: Expr
    body: Expr


@dataclass(frozen=True)
class Nil(Expr):
    pass


@dataclass(frozen=True)
class Cons(Expr):
    head: Expr
    tail: Expr


@dataclass(frozen=True)
class Tup(Expr):
    items: tuple


@dataclass(frozen=True)
class Get(Expr):
    e: Expr
    i: int


@dataclass(frozen=True)
class MapSet(Expr):
    m: Expr
    k: Expr
    v: Expr


@dataclass(frozen=True)
class MapGet(Expr):
    m: Expr
    k: Expr


def call(name: str, *args: Expr) -> Expr:
    out: Expr = Var(name)
    for a in args:
        out = App(out, a)
    return out


def as_call(e: Expr) -> tuple[str, list[Expr]] | None:
    """(name, arguments) of a curried application of a named function."""
    args: list[Expr] = []
    while isinstance(e, App):
        args.insert(0, e.x)
        e = e.f
    return (e.name, args) if isinstance(e, Var) and args else None


def free(e: Expr) -> set[str]:
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Lam):
        return free(e.body) - {e.param}
    if isinstance(e, Let):
        return free(e.e) | (free(e.body) - {e.name})
    return set().union(*map(free, e.children()))


_fresh = [0]


def substitute(e: Expr, name: str, by: Expr) -> Expr:
    """``e`` with ``by`` for the free variable; binders that would capture are renamed."""
    if isinstance(e, Var):
        return by if e.name == name else e
    if isinstance(e, (Lam, Let)):
        bound = e.param if isinstance(e, Lam) else e.name
        if isinstance(e, Let):
            e = replace(e, e=substitute(e.e, name, by))
        if bound == name:
            return e
        if bound in free(by):
            _fresh[0] += 1
            new = f"{bound}_{_fresh[0]}"
            body = substitute(e.body, bound, Var(new))
            e = replace(e, body=body, **({"param": new} if isinstance(e, Lam) else {"name": new}))
        return replace(e, body=substitute(e.body, name, by))
    return e.map_children(lambda c: substitute(c, name, by))


def rename(e: Expr, names: dict[str, str]) -> Expr:
    """All variables at once by their new names; for names that no binder has."""
    if isinstance(e, Var):
        return Var(names.get(e.name, e.name))
    return e.map_children(lambda c: rename(c, names))


@dataclass(frozen=True)
class Fold:
    """A user-defined aggregate: ``acc`` is state -> row -> state, ``init`` its zero."""

    acc: Expr
    init: Expr
    name: str = "fold"

    @property
    def state(self) -> Ty:
        return self.acc.ty

    @property
    def row(self) -> Ty:
        return self.acc.body.ty


# ------------------------------------------------------------------ printing

_LEVEL = {"||": 1, "&&": 2, "=": 3, "<": 4, ">": 4, "++": 5, "+": 6, "-": 6, "*": 7, "/": 7}


def show(e: Expr, level: int = 0) -> str:
    if isinstance(e, Lit):
        if isinstance(e.value, bool):
            return str(e.value).lower()
        return '"' + e.value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(e.value, str) else str(e.value)
    if isinstance(e, Var):
        return e.name
    if isinstance(e, Un):
        return ("!" if e.op == "not" else "-") + show(e.e, 9)
    if isinstance(e, Bin):
        own = _LEVEL[e.op]
        out = f"{show(e.a, own)} {e.op} {show(e.b, own + 1)}"
        return f"({out})" if own < level else out
    if isinstance(e, Ite):
        out = f"if {show(e.c)} then {show(e.a)} else {show(e.b)}"
        return f"({out})" if level else out
    if isinstance(e, App):
        c = as_call(e)
        if c:
            return f"{c[0]}({', '.join(map(show, c[1]))})"
        return f"({show(e.f)})({show(e.x)})"
    if isinstance(e, Lam):
        out = f"({e.param}{': ' + str(e.ty) if e.ty else ''}) -> {show(e.body)}"
        return f"({out})" if level else out
    if isinstance(e, Let):
        out = f"let {e.name} = {show(e.e)} in {show(e.body)}"
        return f"({out})" if level else out
    if isinstance(e, Nil):
        return "nil"
    if isinstance(e, Cons):
        return f"({show(e.head, 6)} :: {show(e.tail, 5)})"
    if isinstance(e, Tup):
        return f"({', '.join(map(show, e.items))}{',' if len(e.items) == 1 else ''})"
    if isinstance(e, Get):
        return f"{show(e.e, 9)}._{e.i}"
    if isinstance(e, MapSet):
        return f"{show(e.m, 9)}[{show(e.k)} <- {show(e.v)}]"
    return f"{show(e.m, 9)}[{show(e.k)}]"


# ------------------------------------------------------------------ JSON


def type_from_json(d: dict) -> Ty:
    kind = d["type"]
    if kind in ("Num", "Bool", "Str"):
        return Ty(kind.lower())
    if kind in ("List", "Set"):
        return Ty(kind.lower(), (type_from_json(d["elm"]),))
    if kind == "Map":
        return map_of(type_from_json(d["key"]), type_from_json(d["value"]))
    if kind == "Tuple":
        return tuple_of(*map(type_from_json, d["elms"]))
    raise ValueError(f"unknown type {kind}")


def type_to_json(t: Ty) -> dict:
    if t.kind in ("list", "set"):
        return {"type": t.kind.title(), "elm": type_to_json(t.args[0])}
    if t.kind == "map":
        return {"type": "Map", "key": type_to_json(t.args[0]), "value": type_to_json(t.args[1])}
    if t.kind == "tuple":
        return {"type": "Tuple", "elms": [type_to_json(a) for a in t.args]}
    return {"type": t.kind.title()}


#: JSON tag -> (class, JSON field per class field); literals and lambdas are handled apart.
_FORMS: dict[str, tuple[type, tuple[str, ...]]] = {
    "Var": (Var, ("name",)), "UnaryOp": (Un, ("op", "expr")), "BinOp": (Bin, ("op", "left", "right")),
    "Ite": (Ite, ("cond", "then_expr", "else_expr")), "App": (App, ("func", "arg")), "Let": (Let, ("name", "expr", "body")),
    "Nil": (Nil, ()), "Cons": (Cons, ("head", "tail")), "Tuple": (Tup, ("values",)), "TupleAccess": (Get, ("tuple_expr", "index")),
    "MapAssign": (MapSet, ("map", "key", "value")), "MapAccess": (MapGet, ("map", "key")),
}


def from_json(d: dict) -> Expr:
    tag = d["type"]
    if tag in ("Num", "Bool", "Str"):
        return Lit(d["value"])
    if tag == "Lambda":
        return Lam(d["param"], type_from_json(d["param_type"]) if d.get("param_type") else None, from_json(d["body"]))
    if tag not in _FORMS:
        raise ValueError(f"unknown expression {tag}")
    cls, names = _FORMS[tag]
    args = [d[n] for n in names]
    return cls(*[from_json(a) if isinstance(a, dict) else tuple(map(from_json, a)) if isinstance(a, list) else a for a in args])


def to_json(e: Expr) -> dict:
    if isinstance(e, Lit):
        return {"type": "Bool" if isinstance(e.value, bool) else "Str" if isinstance(e.value, str) else "Num", "value": e.value}
    if isinstance(e, Lam):
        return {"type": "Lambda", "param": e.param, "param_type": type_to_json(e.ty) if e.ty else None, "body": to_json(e.body)}
    tag, (_, names) = next((t, c) for t, c in _FORMS.items() if c[0] is type(e))
    values = [getattr(e, f.name) for f in fields(e)]
    return {"type": tag} | {n: to_json(v) if isinstance(v, Expr) else [to_json(x) for x in v] if isinstance(v, tuple) else v for n, v in zip(names, values)}
