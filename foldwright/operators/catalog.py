"""Fifty aggregates as folds: a step and a zero, nothing else.

Numbers keep the type of their column; the comments give the finishing step, which is
part of the queries.
"""

from __future__ import annotations

from ..lang.ast import Fold
from ..lang.parser import fold

_ZEROS = {n: "[" + ", ".join(["0"] * n) + "]" for n in (5, 10, 64)}
_TOPS = "[" + ", ".join(["_mx"] * 64) + "]"
_BUCKETS = "[" + ", ".join(["(nil, 0, 0)"] * 4) + "]"

_SOURCES: dict[str, tuple[str, str]] = {
    # counts by key, with the total; the finish takes the two largest shares
    "area_click": ("(s: (map[str, num], num)) -> (city: str) -> (s._0[city <- s._0[city] + 1], s._1 + 1)", "(empty_map, 0)"),
    "average": ("(s: (str, num, num, num, num)) -> (bus: (str, num)) -> (bus._0, s._1 + bus._1, min(s._2, bus._1), max(s._3, bus._1), s._4 + 1)", '("", 0, _mx, _mn, 0)'),
    "avg_temperature": ("(s: (str, num, num)) -> (x: (str, num)) -> (x._0, s._1 + x._1, s._2 + 1)", '("", 0, 0)'),
    # latest time and stimulus, speed and count, and the segment, direction and vehicle of the last row
    "avg_vehicle_speed": (
        "(s: (num, num, num, num, num, num, num)) -> (x: (num, num, num, num, num, num)) ->"
        " (max(s._0, x._3), max(s._1, x._4), s._2 + 1, s._3 + x._5, x._0, x._1, x._2)",
        "(0, 0, 0, 0, 0, 0, 0)",
    ),
    "bloom_filter": ("(s: (num, str, set[num])) -> (x: (num, str, num)) -> (x._0, x._1, set_add(x._2, s._2))", '(0, "", empty_set)'),
    "car_cloud_count": ("(s: (num, num, num, num)) -> (x: (num, num, num, num, num)) -> (x._0, s._1 + 1, max(s._2, x._3), max(s._3, x._4))", "(0, 0, _mn, _mn)"),
    "city_ratio": ("(s: map[str, num]) -> (city: str) -> s[city <- s[city] + 1]", "empty_map"),
    # the first known user, events seen, events up to the last checkout, departments
    "clickstream": (
        "(s: (num, num, num, set[str])) -> (x: (num, str, str)) -> let n = if x._1 != \"N/A\" then s._1 + 1 else s._1 in"
        ' (if s._0 = 0 then x._0 else s._0, n, if x._2 = "order_checkout" then n else s._2, if x._1 != "N/A" then set_add(x._1, s._3) else s._3)',
        "(0, 0, 0, empty_set)",
    ),
    "combine_maps": ("(s: map[num, num]) -> (m: map[num, num]) -> concat_map(s, m)", "empty_map"),
    "count_latest": ("(s: (num, str, num, num)) -> (x: (num, num)) -> (s._0 + 1, s._1, max(s._2, x._0), max(s._3, x._1))", '(0, "", _mn, _mn)'),
    "counter": ("(s: map[num, num]) -> (x: num) -> s[x <- s[x] + 1]", "empty_map"),
    "ensemble_by_key": ("(s: (list[num], num)) -> (x: list[num]) -> (map((p) -> p._0 + p._1, zip(s._0, x)), s._1 + 1)", f"({_ZEROS[64]}, 0)"),
    "longest_string": ("(s: str) -> (x: str) -> if length(x) > length(s) then x else s", '""'),
    # price and time of the last row inside a time window
    "ohlc": ("(s: (num, (num, num))) -> (x: (str, num, num, num, num, num, num, num, num)) -> if x._5 < x._8 && x._6 < x._8 then (x._7, (x._1, x._2)) else s", "(0, (0, 0))"),
    "order_input_price": ("(s: (str, num, num)) -> (x: (str, num)) -> (x._0, s._1 + x._1, s._2 + 1)", '("", 0, 0)'),
    # counts and sums of three kinds of payment
    "payments": (
        "(s: (num, num, num, num, num, num, num)) -> (x: (num, num)) -> (s._0, "
        + ", ".join(f"s._{k + 1} + (if x._0 = {k} then 1 else 0)" for k in range(3)) + ", "
        + ", ".join(f"s._{k + 4} + (if x._0 = {k} then x._1 else 0)" for k in range(3)) + ")",
        "(0, 0, 0, 0, 0, 0, 0)",
    ),
    "prediction": ("(s: num) -> (x: (num, num)) -> if x._1 > 0 then s + x._0 else s - x._0", "0"),
    "regression_slope": (
        "(s: (num, num, num, num, num)) -> (x: (num, num)) -> let m = (x._0 - 2000) * 12 + 1 in (s._0 + m, s._1 + x._1, s._2 + m * x._1, s._3 + m * m, s._4 + 1)",
        "(0, 0, 0, 0, 0)",
    ),
    "stock_ticker": ("(s: (str, num, num)) -> (x: (str, num, num)) -> (x._0, s._1 + x._1, s._2 + 1)", '("", 0, 0)'),
    "transaction_summary": (
        "(s: (bool, str, num, num, num)) -> (t: ((str, num), bool)) -> (true, t._0._0, s._2 + (if t._1 then 1 else 0), s._3 + (if t._1 then 0 else 1), s._4 + abs(t._0._1))",
        '(false, "", 0, 0, 0)',
    ),
    "concat_distinct": ("(s: set[num]) -> (x: num) -> set_add(x, s)", "empty_set"),
    # count and sum of reciprocals, frozen by a zero
    "harmonic_mean": ("(s: (num, num, bool)) -> (x: num) -> if x = 0 || s._2 then (s._0, s._1, true) else (s._0 + 1, s._1 + 1 / x, s._2)", "(0, 0, false)"),
    # rows, changes of the hour, and the calendar fields of this row and the one before
    "hourly_avg": (
        "(s: (num, num, num, num, num, num, num, num, num, num, num, num)) -> (x: (num, num, num, num, num)) ->"
        " let py = if s._7 = 0 then s._2 else s._3 in let pm = if s._7 = 0 then s._4 else s._5 in let pw = if s._7 = 0 then s._6 else s._7 in"
        " let pd = if s._7 = 0 then s._8 else s._9 in let ph = if s._7 = 0 then s._10 else s._11 in"
        " let changed = x._0 != py || x._1 != pm || x._2 != pw || x._3 != pd || x._4 != ph in"
        " (s._0 + 1, if changed then s._1 + 1 else s._1, py, x._0, pm, x._1, pw, x._2, pd, x._3, ph, x._4)",
        "(0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)",
    ),
    "distinct_users": ("(s: (num, num, set[num])) -> (x: (num, num, num)) -> (x._0, x._1, set_add(x._2, s._2))", "(0, 0, empty_set)"),
    "row_with_max_age": ("(s: (num, str, str, num, num)) -> (x: (num, str, str, num, num)) -> if x._4 > s._4 then x else s", '(0, "", "", 0, _mn)'),
    "min_pooling": ("(s: list[num]) -> (x: list[num]) -> map((p) -> min(p._0, p._1), zip(s, x))", _TOPS),
    "accidents": (
        "(s: (set[num], num, num, num, num, num, num, num)) -> (x: (num, num, num, num, num, num, num, num, bool, num, str)) ->"
        " (set_add(x._1, s._0), max(s._1, x._0), max(s._2, x._9), x._3, x._4, x._5, x._6, x._7)",
        "(empty_set, _mn, _mn, 0, 0, 0, 0, 0)",
    ),
    "local_stats": ("(s: (num, num, num, num, num)) -> (x: num) -> (s._0 + 1, min(s._1, x), max(s._2, x), s._3 + x, s._4 + x * x)", "(0, _mx, _mn, 0, 0)"),
    "duration_avg": ("(s: ((num, num), num)) -> (x: (num, num)) -> ((s._0._0 + x._0, s._0._1 + x._1), s._1 + 1)", "((0, 0), 0)"),
    "median": ("(s: list[num]) -> (x: num) -> x :: s", "nil"),
    "outliers": ("(s: (num, num)) -> (x: num) -> (s._0 + 1, if x > 100 then s._1 + 1 else s._1)", "(0, 0)"),
    "point_attribution": ("(s: num) -> (x: num) -> s + (if x < 3 then x else 3)", "0"),
    "bid_stats": ("(s: (num, num, num, num, num)) -> (bid: num) -> (s._0 + bid, s._1 + 1, min(s._2, bid), max(s._3, bid), s._4 + bid * bid)", "(0, 0, _mx, _mn, 0)"),
    # per bucket, all readings and the last time and value
    "raster": ("(s: list[(list[num], num, num)]) -> (x: list[(list[num], num, num)]) -> map((p) -> (p._0._0 ++ p._1._0, p._1._1, p._1._2), zip(s, x))", _BUCKETS),
    "large_sales": ("(s: num) -> (v: num) -> if v > 500 then s + v else s", "0"),
    "regional_sales": ("(s: num) -> (x: (num, num)) -> let west = x._1 >= 10 && x._1 <= 19 in if west && x._0 > 1000 || !west && x._0 > 400 then s + x._0 else s", "0"),
    "moving_average": ("(s: ((num, num, num), num)) -> (x: (num, num, num)) -> ((min(s._0._0, x._0), max(s._0._1, x._1), s._0._2 + x._2), s._1 + 1)", "((_mx, _mn, 0), 0)"),
    "visit_stats": ("(s: (num, set[num])) -> (u: num) -> (s._0 + 1, set_add(u, s._1))", "(0, empty_set)"),
    "motion": (
        "(s: (list[num], list[num], list[num], list[num], num, num, str)) -> (x: (num, num, num, num, num, str)) ->"
        " (s._0 ++ [x._0], s._1 ++ [x._1], s._2 ++ [x._2], s._3 ++ [x._3], max(s._4, x._3), max(s._5, x._4), x._5)",
        '(nil, nil, nil, nil, -1, 0, "")',
    ),
    "map_first": ("(s: map[str, num]) -> (m: map[str, num]) -> concat_map(filter_values((v) -> v != 0, m), s)", "empty_map"),
    "row_first": ("(s: map[num, (num, num)]) -> (xs: list[(num, num)]) -> foldl((m) -> (x) -> if contains_key(m, x._0) then m else m[x._0 <- x], s, xs)", "empty_map"),
    "collect_lists": ("(s: (list[num], list[num], list[num])) -> (x: (num, num, num)) -> (s._0 ++ [x._0], s._1 ++ [x._1], s._2 ++ [x._2])", "(nil, nil, nil)"),
    "telemetry": ("(s: (str, str, str, str, str, num, num)) -> (x: (str, str, str, str, str, num, num)) -> (x._0, x._1, x._2, x._3, x._4, max(x._5, s._5), max(x._6, s._6))", '("", "", "", "", "", 0, 0)'),
    "term_frequency": ("(s: map[num, num]) -> (xs: list[(num, num)]) -> foldl((m) -> (x) -> m[x._0 <- m[x._0] + x._1], s, xs)", "empty_map"),
    "cheapest_row": ("(s: (num, num, num, num, num, num, num)) -> (x: (num, num, num, num, num, num, num)) -> if x._0 < s._0 then x else s", "(_mx, 0, 0, 0, 0, 0, 0)"),
    "union_sketch": ("(s: set[num]) -> (x: set[num]) -> union(s, x)", "empty_set"),
    "session": ("(s: (num, num)) -> (x: num) -> (s._0 + 1, if x != 0 then s._1 + 1 else s._1)", "(0, 0)"),
    "vector_sum": ("(s: (list[num], num)) -> (x: list[num]) -> (map((p) -> p._0 + p._1, zip(s._0, x)), s._1 + 1)", f"({_ZEROS[5]}, 0)"),
    "vehicle_stats": ('(s: (str, num, num, num)) -> (x: (str, num)) -> (if s._0 = "" then x._0 else s._0, if s._1 = 0 then x._1 else s._1, x._1, if s._3 = 0 then 1 else s._3 + 1)', '("", 0, 0, 0)'),
    "weighted_centroid": ("(s: (num, num, num)) -> (x: (num, num, num)) -> (s._0 + x._0 * x._2, s._1 + x._1 * x._2, s._2 + x._2)", "(0, 0, 0)"),
}

CATALOG: dict[str, Fold] = {name: fold(acc, init, name) for name, (acc, init) in _SOURCES.items()}
