"""Folds from the textbook whose states are too small to be merged."""

from __future__ import annotations

from ..lang.ast import Fold
from ..lang.parser import fold

_SOURCES = {
    "maximum_tail_sum": ("(s: num) -> (x: num) -> max(s + x, 0)", "0"),
    "maximum_prefix_sum": ("(s: (num, num)) -> (x: num) -> (s._0 + x, max(s._1, s._0 + x))", "(0, 0)"),
    "maximum_segment_sum": ("(s: (num, num)) -> (x: num) -> let t = max(s._0 + x, 0) in (t, max(s._1, t))", "(0, 0)"),
    "decimal_number": ("(s: num) -> (d: num) -> s * 10 + d", "0"),
    "balanced_parentheses": ("(s: (num, bool)) -> (x: bool) -> let n = if x then s._0 + 1 else s._0 - 1 in (n, s._1 && n >= 0)", "(0, true)"),
    "zeros_then_ones": ("(s: (bool, bool)) -> (x: bool) -> (s._0 || x, s._1 && (x || !s._0))", "(false, true)"),
    "blocks_of_ones": ("(s: (num, bool)) -> (x: bool) -> (if x && !s._1 then s._0 + 1 else s._0, x)", "(0, false)"),
    "line_of_sight": ("(s: (num, num)) -> (x: num) -> (max(s._0, x), if x > s._0 then s._1 + 1 else s._1)", "(0, 0)"),
    "zero_after_one": ("(s: (bool, bool)) -> (x: bool) -> (s._0 || x, s._1 || (s._0 && !x))", "(false, false)"),
    "longest_block": ("(s: (num, num)) -> (x: bool) -> let n = if x then s._0 + 1 else 0 in (n, max(s._1, n))", "(0, 0)"),
}

CLASSICS: dict[str, Fold] = {n: fold(a, z, n) for n, (a, z) in _SOURCES.items()}
