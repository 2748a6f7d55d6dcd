"""One query for every aggregate of the catalogue, with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.aggregate import Aggregate
from ..sources.tables import table
from .catalog import CATALOG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def C(name: str) -> Column:
    return F.col(name)


def cents(name: str) -> Column:
    return F.round(C(name) * 100).cast("bigint")


_CENTS = "CAST(round({} * 100) AS BIGINT)"
E_CENTS, O_CENTS, A_CENTS = _CENTS.format("value"), _CENTS.format("o_totalprice"), _CENTS.format("c_acctbal")


def long(e: str | Column) -> Column:
    return (C(e) if isinstance(e, str) else e).cast("bigint")


def register(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def grouped(name: str, fold: str, source: str, keys: Callable, row: Callable, order: Callable, out: dict[str, str], oracle: str, number: str = "bigint") -> None:
    """A query whose state is all columns: keys, and ``out`` as expressions over the state.

    Columns are made when the query runs, as they need a session.  A set of which only the size is asked is counted.
    """
    sizes = {n: m[1] for n, e in out.items() if (m := re.fullmatch(r"cast\(size\((s[_0-9]*)\) as bigint\)", e))}
    rest = " ".join(e for n, e in out.items() if n not in sizes)
    sizes = {n: s for n, s in sizes.items() if not re.search(rf"\b{s}\b", rest)}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        states = Aggregate(CATALOG[fold], by := keys(), row(), order(), number).scalars(table(spark, sf_dir, source), frozenset(sizes.values()))
        return states.select(*by, *[C(sizes[n]).alias(n) if n in sizes else F.expr(e).alias(n) for n, e in out.items()])

    run.__doc__ = f"{fold} over {source}"
    register(name, oracle)(run)


def EVENT_TYPE():
    return {"g": C("event_type")}


def USER():
    return {"g": C("user_id")}


def EID():
    return C("event_id")


def V():
    return cents("value")


# ------------------------------------------------------------------ built-in states


grouped("u02_averageaggregate", "average", "events", lambda: EVENT_TYPE(), lambda: (C("user_id").cast("string"), V()), lambda: EID(),
        {"line": "s_0", "total": "s_1", "lo": "s_2", "hi": "s_3", "n": "s_4", "mean": "round(s_1 / s_4, 6)"},
        f"SELECT event_type AS g, CAST(max_by(user_id, event_id) AS VARCHAR) AS line, CAST(sum({E_CENTS}) AS BIGINT) AS total, min({E_CENTS}) AS lo, max({E_CENTS}) AS hi, count(*) AS n, round(sum({E_CENTS}) / count(*), 6) AS mean FROM events GROUP BY event_type")

grouped("u03_avgtemperatureaggregatefunction", "avg_temperature", "events", lambda: USER(), lambda: (C("event_type"), V()), lambda: EID(),
        {"id": "s_0", "mean": "round(s_1 / s_2, 6)"},
        f"SELECT user_id AS g, max_by(event_type, event_id) AS id, round(sum({E_CENTS}) / count(*), 6) AS mean FROM events GROUP BY user_id")

grouped("u04_avgvsaggregategl", "avg_vehicle_speed", "events", lambda: EVENT_TYPE(), lambda: (C("user_id") % 10, C("user_id") % 2, C("user_id"), F.unix_micros(C("ts").cast("timestamp")), EID(), V()), lambda: EID(),
        {"latest": "s_0", "stimulus": "s_1", "speed": "round(s_3 / s_2, 6)", "place": "concat_ws(':', s_4, s_5, s_6)"},
        f"SELECT event_type AS g, max(epoch_us(ts)) AS latest, max(event_id) AS stimulus, round(sum({E_CENTS}) / count(*), 6) AS speed, max_by(concat_ws(':', CAST(user_id % 10 AS VARCHAR), CAST(user_id % 2 AS VARCHAR), CAST(user_id AS VARCHAR)), event_id) AS place FROM events GROUP BY event_type")

grouped("u05_bloomfilteraggregationfunction", "bloom_filter", "events", lambda: EVENT_TYPE(), lambda: (EID(), C("event_type"), C("user_id")), lambda: EID(),
        {"last_id": "s_0", "last_type": "s_1", "users": "cast(size(s_2) as bigint)"},
        "SELECT event_type AS g, max(event_id) AS last_id, event_type AS last_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")

grouped("u06_carcloudcountgl", "car_cloud_count", "events", lambda: USER(), lambda: (C("user_id"), V(), V(), EID(), F.unix_micros(C("ts").cast("timestamp"))), lambda: EID(),
        {"car": "s_0", "n": "s_1", "stimulus": "s_2", "latest": "s_3"},
        "SELECT user_id AS g, user_id AS car, count(*) AS n, max(event_id) AS stimulus, max(epoch_us(ts)) AS latest FROM events GROUP BY user_id")

grouped("u08_clickstreamaggregate", "clickstream", "events", lambda: USER(), lambda: (C("user_id"), F.when(C("event_type") == "error", "N/A").otherwise(C("event_type")), F.when(C("event_type") == "purchase", "order_checkout").otherwise(C("event_type"))), lambda: EID(),
        {"first_user": "s_0", "n": "s_1", "at_checkout": "s_2", "departments": "array_join(s_3, ',')"},
        """WITH e AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events)
SELECT user_id AS g, user_id AS first_user, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n, CAST(coalesce(max(CASE WHEN event_type = 'purchase' THEN run END), 0) AS BIGINT) AS at_checkout,
coalesce(string_agg(DISTINCT CASE WHEN event_type <> 'error' THEN event_type END, ',' ORDER BY CASE WHEN event_type <> 'error' THEN event_type END), '') AS departments FROM e GROUP BY user_id""")

grouped("u10_countaggregatefunction", "count_latest", "events", lambda: EVENT_TYPE(), lambda: (F.unix_micros(C("ts").cast("timestamp")), EID()), lambda: None,
        {"n": "s_0", "label": "s_1", "latest": "s_2", "stimulus": "s_3"},
        "SELECT event_type AS g, count(*) AS n, '' AS label, max(epoch_us(ts)) AS latest, max(event_id) AS stimulus FROM events GROUP BY event_type")

grouped("u13_ex_7_udaf", "longest_string", "part", lambda: {"g": C("p_brand")}, lambda: C("p_name"), lambda: C("p_partkey"), {"longest": "s"},
        "SELECT g, longest FROM (SELECT p_brand AS g, p_name AS longest, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS rn FROM part) WHERE rn = 1")


def _ohlc():
    return (C("event_type"), EID(), F.unix_micros(C("ts").cast("timestamp")), V(), V(), F.hour("ts").cast("bigint"), F.minute("ts").cast("bigint") % 12, V(), F.lit(12))


grouped("u14_ohlcaggregator", "ohlc", "events", lambda: USER(), lambda: _ohlc(), lambda: EID(),
        {"price": "s_0", "tick": "s_1_0", "tick_ts": "s_1_1"},
        f"SELECT user_id AS g, coalesce(max_by({E_CENTS}, event_id) FILTER (WHERE hour(ts) < 12), 0) AS price, coalesce(max(event_id) FILTER (WHERE hour(ts) < 12), 0) AS tick, coalesce(max_by(epoch_us(ts), event_id) FILTER (WHERE hour(ts) < 12), 0) AS tick_ts FROM events GROUP BY user_id")

grouped("u15_orderinputpriceaggregatefunction", "order_input_price", "orders", lambda: {"g": C("o_custkey")}, lambda: (C("o_orderpriority"), cents("o_totalprice")), lambda: C("o_orderkey"),
        {"name": "s_0", "mean": "round(s_1 / s_2, 6)", "n": "s_2"},
        f"SELECT o_custkey AS g, max_by(o_orderpriority, o_orderkey) AS name, round(sum({O_CENTS}) / count(*), 6) AS mean, count(*) AS n FROM orders GROUP BY o_custkey")


def _status():
    return F.when(C("o_orderstatus") == "O", 0).when(C("o_orderstatus") == "F", 1).otherwise(2)


_is = {0: "o_orderstatus = 'O'", 1: "o_orderstatus = 'F'", 2: "o_orderstatus NOT IN ('O', 'F')"}
grouped("u16_paymentsaggregatefunction", "payments", "orders", lambda: {"g": C("o_custkey") % 50}, lambda: (_status(), cents("o_totalprice")), lambda: None,
        {f"n{k}": f"s_{k + 1}" for k in range(3)} | {f"v{k}": f"s_{k + 4}" for k in range(3)},
        "SELECT o_custkey % 50 AS g, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS n{k}, CAST(coalesce(sum({O_CENTS}) FILTER (WHERE {c}), 0) AS BIGINT) AS v{k}" for k, c in _is.items()) + " FROM orders GROUP BY o_custkey % 50")

grouped("u17_prediction", "prediction", "events", lambda: EVENT_TYPE(), lambda: (V(), C("value") - 50), lambda: None, {"gain": "s"},
        f"SELECT event_type AS g, CAST(sum(CASE WHEN value - 50 > 0 THEN {E_CENTS} ELSE -{E_CENTS} END) AS BIGINT) AS gain FROM events GROUP BY event_type")

_wide = "cast({} as decimal(19, 0))".format  # products of sums outgrow a bigint
grouped("u18_regslope", "regression_slope", "orders", lambda: {"g": C("o_orderstatus")}, lambda: (F.year("o_orderdate").cast("bigint"), C("o_custkey")), lambda: None,
        {"n": "s_4", "slope": f"round(cast({_wide('s_4')} * {_wide('s_2')} - {_wide('s_0')} * {_wide('s_1')} as double) / cast({_wide('s_4')} * {_wide('s_3')} - {_wide('s_0')} * {_wide('s_0')} as double), 6)"},
        "SELECT g, count(*) AS n, round(CAST(count(*) * sum(m * p) - sum(m) * sum(p) AS DOUBLE) / CAST(count(*) * sum(m * m) - sum(m) * sum(m) AS DOUBLE), 6) AS slope FROM (SELECT o_orderstatus AS g, (year(o_orderdate) - 2000) * 12 + 1 AS m, o_custkey AS p FROM orders) GROUP BY g")

grouped("u19_streamingstockticker", "stock_ticker", "events", lambda: USER(), lambda: (C("event_type"), V(), V()), lambda: EID(), {"ticker": "s_0", "mean": "round(s_1 / s_2, 6)"},
        f"SELECT user_id AS g, max_by(event_type, event_id) AS ticker, round(sum({E_CENTS}) / count(*), 6) AS mean FROM events GROUP BY user_id")

grouped("u20_transactionsummaryaggregator", "transaction_summary", "customer", lambda: {"g": C("c_nationkey")}, lambda: ((C("c_name"), cents("c_acctbal")), C("c_acctbal") > 0), lambda: C("c_custkey"),
        {"processed": "s_0", "item": "s_1", "ok": "s_2", "failed": "s_3", "volume": "s_4"},
        f"SELECT c_nationkey AS g, true AS processed, max_by(c_name, c_custkey) AS item, count(*) FILTER (WHERE c_acctbal > 0) AS ok, count(*) FILTER (WHERE NOT c_acctbal > 0) AS failed, CAST(sum(abs({A_CENTS})) AS BIGINT) AS volume FROM customer GROUP BY c_nationkey")

grouped("u21_groupconcatdistinctudaf", "concat_distinct", "customer", lambda: {"g": C("c_nationkey")}, lambda: C("c_mktsegment"), lambda: None, {"segments": "array_join(s, ',')"},
        "SELECT c_nationkey AS g, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")

_harmonic = {"mean": "CASE WHEN s_2 THEN 0D ELSE round(s_0 / s_1, 4) END"}
grouped("u22_harmonicmeanudaf", "harmonic_mean", "orders", lambda: {"g": C("o_orderpriority")}, lambda: C("o_totalprice"), lambda: C("o_orderkey"), _harmonic,
        "SELECT o_orderpriority AS g, CASE WHEN bool_or(o_totalprice = 0) THEN 0.0 ELSE round(count(*) / sum(1.0 / o_totalprice), 4) END AS mean FROM orders GROUP BY o_orderpriority", "double")
grouped("u22b_harmonicmean_with_zeros", "harmonic_mean", "events", lambda: USER(), lambda: (C("user_id") + EID()) % 7, lambda: EID(), {"before_zero": "s_0", "has_zero": "s_2"},
        "WITH z AS (SELECT user_id, event_id, (user_id + event_id) % 7 AS x, min(CASE WHEN (user_id + event_id) % 7 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events) SELECT user_id AS g, count(*) FILTER (WHERE stop IS NULL OR event_id < stop) AS before_zero, bool_or(x = 0) AS has_zero FROM z GROUP BY user_id")


def _calendar():
    return tuple(f("ts").cast("bigint") for f in (F.year, F.month, F.weekofyear, F.dayofweek, F.hour))


grouped("u24_hyperloglogaggregationfunction", "distinct_users", "events", lambda: EVENT_TYPE(), lambda: (EID(), V(), C("user_id")), lambda: EID(), {"last_id": "s_0", "last_value": "s_1", "users": "cast(size(s_2) as bigint)"},
        f"SELECT event_type AS g, max(event_id) AS last_id, max_by({E_CENTS}, event_id) AS last_value, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")

grouped("u25_keeprowwithmaxage", "row_with_max_age", "customer", lambda: {"g": C("c_nationkey")}, lambda: (C("c_custkey"), C("c_name"), C("c_mktsegment"), long("c_nationkey"), cents("c_acctbal")), lambda: C("c_custkey"),
        {"id": "s_0", "name": "s_1", "segment": "s_2", "age": "s_4"},
        f"SELECT g, id, name, segment, age FROM (SELECT c_nationkey AS g, c_custkey AS id, c_name AS name, c_mktsegment AS segment, {A_CENTS} AS age, row_number() OVER (PARTITION BY c_nationkey ORDER BY {A_CENTS} DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")

grouped("u27_linearroadaccidentaggregate", "accidents", "events", lambda: EVENT_TYPE(), lambda: (F.unix_micros(C("ts").cast("timestamp")), C("user_id"), V(), C("user_id") % 3, C("user_id") % 5, C("user_id") % 7, C("user_id") % 11, V(), C("value") > 0, EID(), C("event_type")), lambda: EID(),
        {"vehicles": "cast(size(s_0) as bigint)", "latest": "s_1", "stimulus": "s_2", "place": "concat_ws(':', s_3, s_4, s_5, s_6)", "last_value": "s_7"},
        f"SELECT event_type AS g, count(DISTINCT user_id) AS vehicles, max(epoch_us(ts)) AS latest, max(event_id) AS stimulus, max_by(concat_ws(':', CAST(user_id % 3 AS VARCHAR), CAST(user_id % 5 AS VARCHAR), CAST(user_id % 7 AS VARCHAR), CAST(user_id % 11 AS VARCHAR)), event_id) AS place, max_by({E_CENTS}, event_id) AS last_value FROM events GROUP BY event_type")

grouped("u28_localstatsaggregate", "local_stats", "lineitem", lambda: {"g": C("l_returnflag")}, lambda: long("l_quantity"), lambda: None,
        {"n": "s_0", "lo": "s_1", "hi": "s_2", "mean": "round(s_3 / s_0, 6)", "variance": "round(s_4 / s_0 - (s_3 / s_0) * (s_3 / s_0), 4)"},
        "SELECT l_returnflag AS g, count(*) AS n, min(CAST(l_quantity AS BIGINT)) AS lo, max(CAST(l_quantity AS BIGINT)) AS hi, round(avg(CAST(l_quantity AS BIGINT)), 6) AS mean, round(var_pop(CAST(l_quantity AS BIGINT)), 4) AS variance FROM lineitem GROUP BY l_returnflag")

grouped("u29_durationavg", "duration_avg", "events", lambda: EVENT_TYPE(), lambda: (F.month("ts").cast("bigint"), V()), lambda: None, {"months": "s_0_0 div s_1", "micros": "s_0_1 div s_1", "n": "s_1"},
        f"SELECT event_type AS g, CAST(sum(month(ts)) // count(*) AS BIGINT) AS months, CAST(sum({E_CENTS}) // count(*) AS BIGINT) AS micros, count(*) AS n FROM events GROUP BY event_type")


@register("u30_median", "SELECT CAST(year(l_shipdate) AS BIGINT) AS g, median(l_quantity) AS mid FROM lineitem GROUP BY 1")
def u30_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact median by the built-in percentile; the list state is only kept by ``median_list``."""
    return table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("g")).agg(F.median("l_quantity").alias("mid"))


@register("u30b_median_list", "SELECT user_id AS g, median(value) AS mid FROM events GROUP BY user_id")
def u30b_median_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold's own state, a list of all values, for small groups."""
    rows = Aggregate(CATALOG["median"], USER(), C("value"), EID(), "double").scalars(table(spark, sf_dir, "events"))
    s, n = F.array_sort("s"), F.size("s")
    return rows.select("g", ((F.element_at(s, F.expr("(size(s) + 1) div 2").cast("int")) + F.element_at(s, F.expr("size(s) div 2 + 1").cast("int"))) / 2).alias("mid"))


grouped("u31_outliersonoutliersdetectaggregatefunction", "outliers", "events", lambda: EVENT_TYPE(), lambda: C("value"), lambda: None, {"n": "s_0", "outliers": "s_1"},
        "SELECT event_type AS g, count(*) AS n, count(*) FILTER (WHERE value > 100) AS outliers FROM events GROUP BY event_type")

grouped("u32_pointattributionscalaudaf", "point_attribution", "lineitem", lambda: {"g": C("l_orderkey") % 100}, lambda: long("l_quantity"), lambda: None, {"points": "s"},
        "SELECT l_orderkey % 100 AS g, CAST(sum(least(CAST(l_quantity AS BIGINT), 3)) AS BIGINT) AS points FROM lineitem GROUP BY 1")


def _bid():
    return cents("o_totalprice").cast("decimal(18,0)")


grouped("u33_qw", "bid_stats", "orders", lambda: {"g": C("o_orderpriority")}, lambda: _bid(), lambda: None,
        {"n": "s_1", "lo": "cast(s_2 as bigint)", "hi": "cast(s_3 as bigint)", "total": "cast(s_0 as bigint)", "mean": "round(cast(s_0 as double) / s_1, 4)",
         "stddev": "round(sqrt(cast(s_4 as double) / s_1 - (cast(s_0 as double) / s_1) * (cast(s_0 as double) / s_1)), 2)"},
        f"SELECT o_orderpriority AS g, count(*) AS n, min({O_CENTS}) AS lo, max({O_CENTS}) AS hi, CAST(sum({O_CENTS}) AS BIGINT) AS total, round(avg({O_CENTS}), 4) AS mean, round(stddev_pop({O_CENTS}), 2) AS stddev FROM orders GROUP BY o_orderpriority")

grouped("u35_udaf", "large_sales", "orders", lambda: {"g": C("o_orderpriority")}, lambda: long(F.floor("o_totalprice")), lambda: None, {"sales": "s"},
        "SELECT o_orderpriority AS g, CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)) FILTER (WHERE floor(o_totalprice) > 500), 0) AS BIGINT) AS sales FROM orders GROUP BY 1")

grouped("u37_smaaggregation", "moving_average", "events", lambda: USER(), lambda: (F.unix_micros(C("ts").cast("timestamp")), F.unix_micros(C("ts").cast("timestamp")), V()), lambda: None,
        {"started": "s_0_0", "ended": "s_0_1", "mean": "s_0_2 div s_1"},
        f"SELECT user_id AS g, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS ended, CAST(sum({E_CENTS}) // count(*) AS BIGINT) AS mean FROM events GROUP BY user_id")

grouped("u38_statsaggregatefunction", "visit_stats", "events", lambda: EVENT_TYPE(), lambda: C("user_id"), lambda: None, {"n": "s_0", "users": "cast(size(s_1) as bigint)"},
        "SELECT event_type AS g, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")

grouped("u42_collectlist", "collect_lists", "events", lambda: USER(), lambda: (EID(), V(), C("user_id")), lambda: EID(), {"ids": "array_join(slice(s_0, 1, 20), ',')", "vals": "array_join(slice(s_1, 1, 20), ',')"},
        f"SELECT user_id AS g, array_to_string(list_slice(list(event_id ORDER BY event_id), 1, 20), ',') AS ids, array_to_string(list_slice(list({E_CENTS} ORDER BY event_id), 1, 20), ',') AS vals FROM events GROUP BY user_id")

grouped("u43_telemetryprocessor", "telemetry", "events", lambda: USER(), lambda: (C("event_type"), C("props"), C("event_type"), C("props"), C("event_type"), V(), -V()), lambda: EID(),
        {"kind": "s_0", "props": "s_1", "hi": "s_5", "low": "s_6"},
        f"SELECT user_id AS g, max_by(event_type, event_id) AS kind, max_by(props, event_id) AS props, greatest(0, max({E_CENTS})) AS hi, greatest(0, max(-{E_CENTS})) AS low FROM events GROUP BY user_id")


def _order():
    return (cents("o_totalprice"), C("o_orderkey"), C("o_custkey"), F.year("o_orderdate").cast("bigint"), F.month("o_orderdate").cast("bigint"), C("o_orderkey") % 7, C("o_custkey") % 7)


grouped("u45_topudaf", "cheapest_row", "orders", lambda: {"g": C("o_orderpriority")}, lambda: _order(), lambda: C("o_orderkey"), {"price": "s_0", "orderkey": "s_1", "custkey": "s_2", "y": "s_3", "m": "s_4"},
        f"SELECT g, price, orderkey, custkey, y, m FROM (SELECT o_orderpriority AS g, {O_CENTS} AS price, o_orderkey AS orderkey, o_custkey AS custkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {O_CENTS}, o_orderkey) AS rn FROM orders) WHERE rn = 1")

grouped("u47_usersessionaggregates", "session", "events", lambda: USER(), lambda: F.when(C("event_type") == "purchase", 1).otherwise(0), lambda: None, {"n": "s_0", "checkouts": "s_1", "pct": "s_1 * 100 div s_0"},
        "SELECT user_id AS g, count(*) AS n, count(*) FILTER (WHERE event_type = 'purchase') AS checkouts, count(*) FILTER (WHERE event_type = 'purchase') * 100 // count(*) AS pct FROM events GROUP BY user_id")

grouped("u49_vehiclestatisticsaggregator", "vehicle_stats", "events", lambda: USER(), lambda: (F.when(C("event_type") == "error", "").otherwise(C("event_type")), EID() % 5), lambda: EID(),
        {"kind": "s_0", "started": "s_1", "ended": "s_2", "n": "s_3"},
        "SELECT user_id AS g, coalesce(min_by(event_type, event_id) FILTER (WHERE event_type <> 'error'), '') AS kind, coalesce(min_by(event_id % 5, event_id) FILTER (WHERE event_id % 5 <> 0), 0) AS started, max_by(event_id % 5, event_id) AS ended, count(*) AS n FROM events GROUP BY user_id")


def _w():
    return long("l_linenumber") + 1


grouped("u50_weightedcentroid", "weighted_centroid", "lineitem", lambda: {"g": C("l_returnflag")}, lambda: (long("l_quantity"), long("l_linenumber"), _w()), lambda: None, {"x": "round(s_0 / s_2, 6)", "y": "round(s_1 / s_2, 6)"},
        "SELECT l_returnflag AS g, round(sum(CAST(l_quantity AS BIGINT) * (1 + l_linenumber)) / sum(1 + l_linenumber), 6) AS x, round(sum(l_linenumber * (1 + l_linenumber)) / sum(1 + l_linenumber), 6) AS y FROM lineitem GROUP BY l_returnflag")


# ------------------------------------------------------------------ joins, ordered states, maps and vectors


@register("u36_udaf2", "SELECT c_mktsegment AS g, CAST(coalesce(sum(v) FILTER (WHERE (c_nationkey BETWEEN 10 AND 19 AND v > 1000) OR (c_nationkey NOT BETWEEN 10 AND 19 AND v > 400)), 0) AS BIGINT) AS sales FROM (SELECT c_mktsegment, c_nationkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def u36_udaf2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional sales by customer segment; the planner picks the join."""
    joined = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), C("o_custkey") == C("c_custkey"))
    return Aggregate(CATALOG["regional_sales"], {"g": C("c_mktsegment")}, (long(F.floor("o_totalprice")), long("c_nationkey"))).scalars(joined).select("g", C("s").alias("sales"))


@register("u23_hourlyavg", """WITH p AS (SELECT user_id, event_id, year(ts) y, month(ts) m, date_part('week', ts) w, date_part('dow', ts) + 1 d, hour(ts) h FROM events),
q AS (SELECT *, lag(y) OVER o ly, lag(m) OVER o lm, lag(w) OVER o lw, lag(d) OVER o ld, lag(h) OVER o lh FROM p WINDOW o AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id AS g, count(*) AS n, 1 + count(*) FILTER (WHERE ly IS NULL OR ly <> y OR lm <> m OR lw <> w OR ld <> d OR lh <> h) AS hours FROM q GROUP BY user_id""")
def u23_hourlyavg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not mergeable as written: the change flag compares neighbours, which is a lag over the order.

    The zero's calendar fields are all 0, so the first row counts as a change.
    """
    now = F.struct(*[c.alias(n) for n, c in zip("ymwdh", _calendar())])
    rows = table(spark, sf_dir, "events").select(C("user_id").alias("g"), "event_id", now.alias("now"))
    before = F.lag("now").over(Window.partitionBy("g").orderBy("event_id"))
    changed = rows.select("g", F.when(before.isNull() | (before != C("now")), 1).otherwise(0).alias("changed"))
    return changed.groupBy("g").agg(F.count("*").alias("n"), (F.sum("changed") + 1).alias("hours"))


@register("u23b_hourlyavg_ordered", ORACLES["u23_hourlyavg"])
def u23b_hourlyavg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the ordered fold, which takes any step as it is."""
    rows = Aggregate(CATALOG["hourly_avg"], USER(), _calendar(), EID()).ordered(table(spark, sf_dir, "events"))
    return rows.select("g", C("s_0").alias("n"), C("s_1").alias("hours"))


def _top_two(entries: DataFrame) -> DataFrame:
    by_g = Window.partitionBy("g")
    ranked = entries.withColumn("total", F.sum("v").over(by_g)).withColumn("place", F.row_number().over(by_g.orderBy(F.desc("v"), "k")))
    return ranked.where("place <= 2").select("g", C("k").alias("city"), C("v").alias("n"), "total", long("place").alias("place"), F.round(C("v") * 100 / C("total"), 4).alias("share"))


_TOP_TWO = "WITH e AS (SELECT {g} AS g, {k} AS k, count(*) AS v FROM {t} GROUP BY 1, 2), r AS (SELECT *, CAST(sum(v) OVER (PARTITION BY g) AS BIGINT) AS total, row_number() OVER (PARTITION BY g ORDER BY v DESC, k) AS place FROM e) SELECT g, k AS city, v AS n, total, place, round(v * 100 / total, 4) AS share FROM r WHERE place <= 2"


@register("u01_areaclickudaf", _TOP_TWO.format(g="c_nationkey", k="c_mktsegment", t="customer"))
def u01_areaclickudaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_two(Aggregate(CATALOG["area_click"], {"g": C("c_nationkey")}, C("c_mktsegment")).entries(table(spark, sf_dir, "customer"), (0,)))


@register("u07_cityratioudaf", _TOP_TWO.format(g="o_orderstatus", k="o_orderpriority", t="orders"))
def u07_cityratioudaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top_two(Aggregate(CATALOG["city_ratio"], {"g": C("o_orderstatus")}, C("o_orderpriority")).entries(table(spark, sf_dir, "orders")))


@register("u09_combinemaps", f"SELECT user_id % 10 AS g, event_type AS k, max_by({E_CENTS}, event_id) AS v FROM events GROUP BY 1, 2")
def u09_combinemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right map wins: per key, the value of the last row."""
    return Aggregate(CATALOG["combine_maps"], {"g": C("user_id") % 10}, F.create_map("event_type", V()), EID()).entries(table(spark, sf_dir, "events"))


@register("u11_counter", "SELECT event_type AS g, user_id AS k, count(*) AS v FROM events GROUP BY 1, 2")
def u11_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Aggregate(CATALOG["counter"], EVENT_TYPE(), C("user_id")).entries(table(spark, sf_dir, "events"))


def _VEC():
    return F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("bigint"))


_UNNEST = "SELECT label AS g, generate_subscripts(embedding, 1) - 1 AS k, CAST(round(CAST(unnest(embedding) AS DOUBLE) * 10000) AS BIGINT) AS x FROM embeddings"


def _vector(fold: str, rows: str, oracle: str):
    @register(rows, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = () if fold == "min_pooling" else (0,)
        entries = Aggregate(CATALOG[fold], {"g": C("label")}, _VEC()).entries(table(spark, sf_dir, "embeddings"), path)
        return entries.select("g", long("k").alias("k"), "v")


_vector("ensemble_by_key", "u12_ensemblebykey", f"SELECT g, CAST(k AS BIGINT) AS k, CAST(sum(x) AS BIGINT) AS v FROM ({_UNNEST}) GROUP BY 1, 2")
_vector("min_pooling", "u26_minpooling", f"SELECT g, CAST(k AS BIGINT) AS k, min(x) AS v FROM ({_UNNEST}) GROUP BY 1, 2")
_vector("vector_sum", "u48_vectorsumudaf", f"SELECT g, CAST(k AS BIGINT) AS k, CAST(sum(x) AS BIGINT) AS v FROM ({_UNNEST}) WHERE k < 5 GROUP BY 1, 2")


@register("u34_rasterfunction", """WITH b AS (SELECT label AS g, vec_id, unnest([0, 1, 2, 3]) AS k FROM embeddings)
SELECT g, CAST(k AS BIGINT) AS k, array_to_string(list_slice(list(vec_id * 4 + k ORDER BY vec_id), 1, 10), ',') AS readings, count(*) AS n, max(vec_id) AS last_time, max_by(vec_id % 17, vec_id) AS last_value FROM b GROUP BY 1, 2""")
def u34_rasterfunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bucket, the readings in order and the time and value of the last row."""
    bucket = lambda k: F.struct(F.array(C("vec_id") * 4 + k).alias("_0"), C("vec_id").alias("_1"), (C("vec_id") % 17).alias("_2"))
    agg = Aggregate(CATALOG["raster"], {"g": C("label")}, F.array(*[bucket(k) for k in range(4)]), C("vec_id"))
    rows = agg.entries(table(spark, sf_dir, "embeddings"))
    return rows.select("g", long("k").alias("k"), F.array_join(F.slice("v_0", 1, 10), ",").alias("readings"), F.size("v_0").cast("bigint").alias("n"), C("v_1").alias("last_time"), C("v_2").alias("last_value"))


@register("u34b_raster_whole", """WITH b AS (SELECT label AS g, vec_id, unnest([0, 1, 2, 3]) AS k FROM embeddings)
SELECT g, CAST(k AS BIGINT) AS k, array_to_string(list(vec_id * 4 + k ORDER BY vec_id), ',') AS readings, count(*) AS n, max(vec_id) AS last_time, max_by(vec_id % 17, vec_id) AS last_value FROM b GROUP BY 1, 2""")
def u34b_raster_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As u34, with every reading of the list."""
    bucket = lambda k: F.struct(F.array(C("vec_id") * 4 + k).alias("_0"), C("vec_id").alias("_1"), (C("vec_id") % 17).alias("_2"))
    agg = Aggregate(CATALOG["raster"], {"g": C("label")}, F.array(*[bucket(k) for k in range(4)]), C("vec_id"))
    rows = agg.entries(table(spark, sf_dir, "embeddings"))
    return rows.select("g", long("k").alias("k"), F.array_join("v_0", ",").alias("readings"), F.size("v_0").cast("bigint").alias("n"), C("v_1").alias("last_time"), C("v_2").alias("last_value"))


@register("u39_statsmotionlinearregression", "SELECT user_id AS g, count(*) AS n, round(coalesce(regr_slope(value, event_id), 0), 6) AS slope, max(event_id) AS stimulus, max_by(event_type, event_id) AS last_key FROM events GROUP BY user_id")
def u39_statsmotionlinearregression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four lists only feed a regression, whose five sums are built in."""
    out = table(spark, sf_dir, "events").groupBy(C("user_id").alias("g")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.regr_slope("value", "event_id"), F.lit(0.0)), 6).alias("slope"), F.max("event_id").alias("stimulus"), F.max_by("event_type", "event_id").alias("last_key"))
    return out


@register("u39b_motion_lists", f"SELECT user_id AS g, array_to_string(list_slice(list({E_CENTS} ORDER BY event_id), 1, 10), ',') AS xs, greatest(-1, max(event_id)) AS hi, max_by(event_type, event_id) AS last_key FROM events GROUP BY user_id")
def u39b_motion_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold's own state."""
    rows = Aggregate(CATALOG["motion"], USER(), (V(), V(), V(), EID(), EID(), C("event_type")), EID()).scalars(table(spark, sf_dir, "events"))
    return rows.select("g", F.array_join(F.slice("s_0", 1, 10), ",").alias("xs"), C("s_4").alias("hi"), C("s_6").alias("last_key"))


@register("u39c_motion_whole", f"""SELECT user_id AS g, array_to_string(list({E_CENTS} ORDER BY event_id), ',') AS xs, array_to_string(list({E_CENTS} * 2 + event_id % 3 ORDER BY event_id), ',') AS ys,
array_to_string(list(event_id % 7 ORDER BY event_id), ',') AS zs, array_to_string(list(event_id * 3 ORDER BY event_id), ',') AS times, greatest(-1, max(event_id * 3)) AS time, greatest(0, max(event_id % 11)) AS stimulus, max_by(event_type, event_id) AS last_key FROM events GROUP BY user_id""")
def u39c_motion_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold's own state: four whole lists, two maxima and the last key."""
    row = (V(), V() * 2 + EID() % 3, EID() % 7, EID() * 3, EID() % 11, C("event_type"))
    rows = Aggregate(CATALOG["motion"], USER(), row, EID()).scalars(table(spark, sf_dir, "events"))
    lists = [F.array_join(f"s_{i}", ",").alias(n) for i, n in enumerate(("xs", "ys", "zs", "times"))]
    return rows.select("g", *lists, C("s_4").alias("time"), C("s_5").alias("stimulus"), C("s_6").alias("last_key"))


#: Minutes since 2024-01-01, and three axes, in both dialects.
_MOTION = "SELECT user_id, event_id, event_type, CAST(floor(epoch(ts) / 60) AS BIGINT) - 28401120 AS t, value AS x, value * (1 + event_id % 3) AS y, value * (1 + event_id % 5) AS z FROM events"


def _axis(a: str) -> str:
    slope = f"coalesce(regr_slope({a}, t), 0)"
    return f"round(avg({a}), 6) AS mean_{a}, round({slope}, 6) AS slope_{a}, round(avg({a}) - {slope} * avg(t), 6) AS intercept_{a}"


@register("u39d_motion_regressions", f"SELECT user_id AS g, {', '.join(_axis(a) for a in 'xyz')}, max_by(event_type, event_id) AS last_key, max(t) AS time, max(event_id) AS stimulus FROM ({_MOTION}) GROUP BY user_id")
def u39d_motion_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole finish: mean, slope and intercept of three axes over time, key, time and stimulus.

    Without a spread of times the slope is 0 (the division by zero of the language).
    """
    time = F.floor(F.unix_timestamp("ts") / 60) - 28401120
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", long(time).alias("t"), C("value").alias("x"), (C("value") * (1 + EID() % 3)).alias("y"), (C("value") * (1 + EID() % 5)).alias("z"))
    slope = lambda a: F.coalesce(F.regr_slope(a, "t"), F.lit(0.0))
    axes = [c for a in "xyz" for c in (F.round(F.avg(a), 6).alias(f"mean_{a}"), F.round(slope(a), 6).alias(f"slope_{a}"), F.round(F.avg(a) - slope(a) * F.avg("t"), 6).alias(f"intercept_{a}"))]
    return rows.groupBy(C("user_id").alias("g")).agg(*axes, F.max_by("event_type", "event_id").alias("last_key"), F.max("t").alias("time"), F.max("event_id").alias("stimulus"))


@register("u40_aggmapfirst", "SELECT user_id % 10 AS g, event_type AS k, min_by(user_id % 7, event_id) AS v FROM events WHERE user_id % 7 <> 0 GROUP BY 1, 2")
def u40_aggmapfirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The left map wins; zeros are dropped first.  Rows of a later map don't replace a key."""
    return Aggregate(CATALOG["map_first"], {"g": C("user_id") % 10}, F.create_map("event_type", C("user_id") % 7), EID()).entries(table(spark, sf_dir, "events"))


@register("u41_aggrowfirst", f"SELECT o_orderstatus AS g, o_custkey % 20 AS k, min_by({O_CENTS}, o_orderkey) AS price, min(o_orderkey) AS orderkey FROM orders GROUP BY 1, 2")
def u41_aggrowfirst(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct((C("o_custkey") % 20).alias("_0"), F.struct(cents("o_totalprice").alias("price"), C("o_orderkey")).alias("_1"))
    rows = Aggregate(CATALOG["row_first"], {"g": C("o_orderstatus")}, F.array(row), C("o_orderkey")).entries(table(spark, sf_dir, "orders"))
    return rows.select("g", "k", C("v._1.price").alias("price"), C("v._1.o_orderkey").alias("orderkey"))


@register("u44_termfrequencyaccumulator", r"SELECT lang AS g, k, count(*) AS v FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS k FROM documents) GROUP BY 1, 2")
def u44_termfrequencyaccumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold over lists is the fold over their elements: explode, then sum by (language, term)."""
    terms = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda t: F.struct(t.alias("_0"), F.lit(1).cast("bigint").alias("_1")))
    return Aggregate(CATALOG["term_frequency"], {"g": C("lang")}, terms).entries(table(spark, sf_dir, "documents"))


@register("u46_unionsketchudaf", "SELECT event_type AS g, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def u46_unionsketchudaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of users by day, united by event type; the exact twin of the sketch."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.collect_set("user_id").alias("users"))
    return Aggregate(CATALOG["union_sketch"], EVENT_TYPE(), C("users")).scalars(days).select("g", F.size("s").cast("bigint").alias("users"))


@register("u46b_sketch_union")
def u46b_sketch_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by mergeable HLL sketches of fixed size; approximate."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.hll_sketch_agg("user_id").alias("sketch"))
    return days.groupBy(C("event_type").alias("g")).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users"))
