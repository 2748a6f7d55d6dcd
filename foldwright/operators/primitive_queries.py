"""One query for every expression form and primitive of the language, through the compiler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.primitives import int_divide
from ..lang.parser import parse
from ..lang.simplify import simplify
from ..plans.columns import to_column
from ..sources.tables import table
from .queries import C, ORACLES, QUERIES, register



def compiled(text: str, env: dict[str, Column], division=int_divide) -> Column:
    return to_column(simplify(parse(text)), env, division)


# ------------------------------------------------------------------ scalars, on customer

_SCALAR_ENV = lambda: {"a": C("c_nationkey").cast("bigint"), "b": C("c_custkey") % 7 - 3, "s": C("c_mktsegment"), "n": C("c_name")}
_SCALAR_SQL = "(SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS a, c_custkey % 7 - 3 AS b, c_mktsegment AS s, c_name AS n FROM customer)"


def scalar(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), compiled(text, _SCALAR_ENV()).alias("v"))

    register(name, f"SELECT id, {sql} AS v FROM {_SCALAR_SQL}")(run)


_TRUNC = "CASE WHEN b = 0 THEN 0 ELSE a // b END"
_DIV = "CASE WHEN b = 0 THEN 0 ELSE CAST(trunc(CAST(a AS DOUBLE) / b) AS BIGINT) END"
scalar("e01_literals", 'if true then "x" else "y"', "'x'")
scalar("e02_variable", "a", "a")
scalar("e03_unary", "if !(a > 10) then -b else b", "CASE WHEN NOT a > 10 THEN -b ELSE b END")
scalar("e04_arithmetic", "a * b + a - b", "a * b + a - b")
scalar("e05_div", "a / b", _DIV)
scalar("e06_compare", "a > b && b < 2", "a > b AND b < 2")
scalar("e07_equal", 'a = b || s = "BUILDING"', "a = b OR s = 'BUILDING'")
scalar("e08_and_or", "(a > 5 && b > 0) || !(a < 20)", "(a > 5 AND b > 0) OR NOT a < 20")
scalar("e09_concat", 's ++ "-" ++ n', "concat(s, '-', n)")
scalar("e10_ite", "if a > 12 then a else if b > 0 then b else 0", "CASE WHEN a > 12 THEN a WHEN b > 0 THEN b ELSE 0 END")
scalar("e11_application", "((f: num) -> (g: num) -> f * 2 + g)(a, b)", "a * 2 + b")
scalar("e12_lambda", "((f: num) -> f + b)(a)", "a + b")
scalar("e13_let", "let c = a + b in let d = c * c in d - c", "(a + b) * (a + b) - (a + b)")
scalar("e15_tuple", "(a, (b, s))._1._0", "b")
scalar("e16_projection", "(a + 1, b)._0 + (a, b * 2)._1", "a + 1 + b * 2")
scalar("p05b_length_text", "length(n)", "length(n)")
scalar("p08_id", "id(a) + id(b)", "a + b")
scalar("p09_max", "max(a, b)", "greatest(a, b)")
scalar("p10_min", "min(a, b)", "least(a, b)")
scalar("p11_abs", "abs(b)", "abs(b)")
scalar("p25_constants", "if true && !false then a else b", "a")

# ------------------------------------------------------------------ lists and sets, on events by user

_LISTS_SQL = "(SELECT user_id AS g, list(CAST(round(value * 100) AS BIGINT) % 11 - 5 ORDER BY event_id) AS xs, coalesce(list(event_id % 7 ORDER BY event_id) FILTER (WHERE event_id % 2 = 0), []) AS ys FROM events GROUP BY user_id)"


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.struct("event_id", (F.round(C("value") * 100).cast("bigint") % 11 - 5).alias("x"), (C("event_id") % 7).alias("y"))
    rows = table(spark, sf_dir, "events").groupBy(C("user_id").alias("g")).agg(F.array_sort(F.collect_list(pair)).alias("e"))
    return rows.select("g", F.transform("e", lambda p: p["x"]).alias("xs"), F.transform(F.filter("e", lambda p: p["event_id"] % 2 == 0), lambda p: p["y"]).alias("ys"))


def listed(name: str, text: str, sql: str, as_list: bool = True, as_set: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        longs = F.array().cast("array<bigint>")
        env = {"xs": C("xs"), "ys": C("ys"), "us": F.array_distinct("xs"), "vs": F.array_distinct("ys"), "empty_set": longs}
        v = compiled(text, env)
        v = F.array_sort(v) if as_set else v
        return _lists(spark, sf_dir).select("g", (F.array_join(v, ",") if as_list else v).alias("v"))

    sql = f"list_sort({sql})" if as_set else sql
    register(name, f"SELECT g, {f'array_to_string({sql}, chr(44))' if as_list else sql} AS v FROM {_LISTS_SQL}")(run)


_PAIRS = "list_transform(range(1, least(len(xs), len(ys)) + 1), lambda i: xs[i] * 10 + ys[i])"
listed("e14_cons", "1 :: 2 :: xs", "list_concat([1, 2], xs)")
listed("p01_foldl", "foldl((acc) -> (x) -> acc + x * x, 0, xs)", "CAST(list_sum(list_transform(xs, lambda x: x * x)) AS BIGINT)", as_list=False)
listed("p02_map", "map((x) -> x * 2 + 1, xs)", "list_transform(xs, lambda x: x * 2 + 1)")
listed("p03_filter", "filter((x) -> x > 0, xs)", "list_filter(xs, lambda x: x > 0)")
listed("p04_zip", "map((p) -> p._0 * 10 + p._1, zip(xs, ys))", _PAIRS)
listed("p05_length", "foldl((n) -> (x) -> n + 1, 0, xs)", "len(xs)", as_list=False)
listed("p06_head", "head(xs)", "xs[1]", as_list=False)
listed("p07_tail", "tail(xs)", "list_slice(xs, 2, len(xs))")
listed("p12_empty_set", "empty_set", "CAST([] AS BIGINT[])")
listed("p13_set_add", "set_add(99, us)", "list_concat(list_distinct(xs), [99])", as_set=True)
listed("p14_union", "union(us, vs)", "list_distinct(list_concat(xs, ys))", as_set=True)
listed("p15_intersection", "intersection(us, vs)", "list_distinct(list_filter(xs, lambda x: list_contains(ys, x)))", as_set=True)
listed("p16_map_set", "map_set((x) -> x / 2, us)", "list_distinct(list_transform(xs, lambda x: CAST(trunc(x / 2.0) AS BIGINT)))", as_set=True)
listed("p17_filter_set", "filter_set((x) -> x < 0, us)", "list_distinct(list_filter(xs, lambda x: x < 0))", as_set=True)
listed("p18_is_set_empty", "is_set_empty(filter_set((x) -> x > 4, us))", "len(list_filter(xs, lambda x: x > 4)) = 0", as_list=False)
listed("p26_infinities", "foldl((a) -> (x) -> max(a, x), -5, xs)", "list_max(xs)", as_list=False)
listed("p27_outer_join", "map((p) -> p._0 * 10 + p._1, outer_join(xs, ys))", "list_transform(range(1, greatest(len(xs), len(ys)) + 1), lambda i: coalesce(xs[i], 0) * 10 + coalesce(ys[i], 0))")

# ------------------------------------------------------------------ maps, on event types by user

_MAPS_SQL = """WITH e AS (SELECT user_id AS g, event_type AS k, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 3 = 0) AS b FROM events GROUP BY 1, 2)
SELECT u.g, coalesce(string_agg(k || '=' || CAST(v AS VARCHAR), ',' ORDER BY k), '') AS v FROM (SELECT DISTINCT user_id AS g FROM events) u LEFT JOIN ({rows}) r ON u.g = r.g GROUP BY u.g"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """m: counts of even ids by type, w: of ids divisible by three; types without rows have no key."""
    counts = table(spark, sf_dir, "events").groupBy(C("user_id").alias("g"), C("event_type").alias("k")).agg(F.count_if(C("event_id") % 2 == 0).alias("a"), F.count_if(C("event_id") % 3 == 0).alias("b"))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(C(c) > 0, F.struct("k", C(c).alias("v"))))))
    return counts.groupBy("g").agg(entries("a").alias("m"), entries("b").alias("w"))


def mapped(name: str, text: str, rows: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = {"m": C("m"), "w": C("w"), "empty_map": F.create_map().cast("map<string,bigint>")}
        v = F.array_sort(F.map_entries(compiled(text, env)))
        return _maps(spark, sf_dir).select("g", F.array_join(F.transform(v, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("v"))

    register(name, _MAPS_SQL.format(rows=rows))(run)


_CLICK = "SELECT g, k, a AS v FROM e WHERE a > 0 AND k <> 'click' UNION ALL SELECT DISTINCT g, 'click', {v} FROM e"
mapped("e17_map_assign", 'm["click" <- 7]', _CLICK.format(v="7"))
mapped("e18_map_access", 'm["click" <- m["click"] + 100]', "SELECT g, k, a AS v FROM e WHERE a > 0 AND k <> 'click' UNION ALL SELECT g, 'click', CAST(sum(CASE WHEN k = 'click' THEN a ELSE 0 END) AS BIGINT) + 100 FROM e GROUP BY g")
mapped("p19_empty_map", 'concat_map(empty_map, m)', "SELECT g, k, a AS v FROM e WHERE a > 0")
mapped("p20_update_map", 'update_map(m, "click", 9)', _CLICK.format(v="9"))
mapped("p21_contains_key", 'if contains_key(m, "view") then m else w', "SELECT g, k, CASE WHEN h THEN a ELSE b END AS v FROM (SELECT *, bool_or(k = 'view' AND a > 0) OVER (PARTITION BY g) AS h FROM e) WHERE CASE WHEN h THEN a ELSE b END > 0")
mapped("p22_map_values", '(map_values((k) -> (x) -> (x._1 > 5, x._1 * 2), m))', "SELECT g, k, a * 2 AS v FROM e WHERE a > 5")
mapped("p23_filter_values", "filter_values((v) -> v > 6, m)", "SELECT g, k, a AS v FROM e WHERE a > 6")
mapped("p24_concat_map", "concat_map(m, w)", "SELECT g, k, CASE WHEN b > 0 THEN b ELSE a END AS v FROM e WHERE a > 0 OR b > 0")
mapped("p27b_outer_join_maps", "merge_with((x) -> (y) -> x + y, m, w)", "SELECT g, k, a + b AS v FROM e WHERE a > 0 OR b > 0")
mapped("p28_filter_map", '(filter_map((k) -> (v) -> v > 6 || k = "view", m))', "SELECT g, k, a AS v FROM e WHERE a > 0 AND (a > 6 OR k = 'view')")

__all__ = ["QUERIES", "ORACLES"]
