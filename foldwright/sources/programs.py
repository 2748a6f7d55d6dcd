"""Fold programs as JSON files: ``{"acc": .., "init": ..}`` with a tagged tree each."""

from __future__ import annotations

import json

from ..lang.ast import Expr, Fold, from_json, Ite, to_json, Ty


def read_program(text: str, name: str = "fold") -> Fold:
    d = json.loads(text)
    return Fold(from_json(d["acc"]), from_json(d["init"]), name)


def write_program(f: Fold) -> str:
    return json.dumps({"acc": to_json(f.acc), "init": to_json(f.init)})


def _types(t: Ty):
    yield t
    for a in t.args:
        if isinstance(a, Ty):
            yield from _types(a)


def _has(e: Expr, *kinds) -> bool:
    return isinstance(e, kinds) or any(_has(c, *kinds) for c in e.children())


def statistics(f: Fold) -> dict[str, bool]:
    """What the state and the step are made of."""
    inside = list(_types(f.state))
    collections = [t for t in inside if t.kind in ("list", "set", "map")]
    nested = any(u.kind in ("list", "set", "map") for t in collections for a in t.args for u in _types(a))
    return {"has_tuple": any(t.kind == "tuple" for t in inside), "has_collection": bool(collections), "has_nested_collection": nested, "has_conditional": _has(f.acc, Ite)}



