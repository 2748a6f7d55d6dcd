"""Every query against its SQL, and the plans behind them."""

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldwright.lang.evaluate import compile_expr
from foldwright.operators import plan_queries, primitive_queries  # noqa: F401
from foldwright.operators.catalog import CATALOG
from foldwright.operators.queries import ORACLES, QUERIES
from foldwright.plans.aggregate import Aggregate
from foldwright.plans.runtime import merged_states
from foldwright.synth.refute import Sampler

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))


@needs_data
@pytest.mark.parametrize("name", QUERIES)
def test_query(name, spark, duck):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@needs_data
@pytest.mark.parametrize("name", ["u33_qw", "u20_transactionsummaryaggregator", "u08_clickstreamaggregate", "u45_topudaf", "u05_bloomfilteraggregationfunction"])
def test_builtin_plans(name, spark):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@needs_data
def test_columns_are_pruned(spark):
    plan = QUERIES["u33_qw"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in plan


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
@pytest.mark.parametrize("name", ["vehicle_stats", "clickstream", "telemetry", "harmonic_mean"])
def test_partitions_do_not_matter(name, parts, spark):
    """Built-in plan, merge runtime and a plain fold in order agree, however rows are dealt."""
    f = CATALOG[name]
    s = Sampler(9)
    rows = [(i, i % 3, s.value(f.row)) for i in range(60)]
    arity = len(f.row.args) if f.row.kind == "tuple" else 0
    flat = [(o, k, *(v if arity else (v,))) for o, k, v in rows]
    types = [{"num": "bigint", "str": "string", "bool": "boolean"}[t.kind] for t in (f.row.args if arity else (f.row,))]
    df = spark.createDataFrame(flat, "o bigint, k bigint, " + ", ".join(f"c{i} {t}" for i, t in enumerate(types))).repartition(parts, F.xxhash64("o"))
    row = tuple(F.col(f"c{i}") for i in range(arity)) if arity else F.col("c0")
    got = {r["k"]: list(r)[1:] for r in Aggregate(f, {"k": F.col("k")}, row, F.col("o")).scalars(df).collect()}
    step, zero = s.stepper(f), compile_expr(f.init)({})
    for k in range(3):
        want = step(zero, [v for _, g, v in rows if g == k])
        if name == "harmonic_mean":  # 1/x is a real division in columns
            want = (want[0], got[k][1], want[2])
        assert [sorted(v) if isinstance(v, (list, frozenset)) else v for v in got[k]] == [sorted(v) if isinstance(v, frozenset) else v for v in want]
    if name != "harmonic_mean":
        shaped = df.withColumn("row", F.struct(*[F.col(f"c{i}") for i in range(arity)]) if arity else F.col("c0"))
        states = {r["key"]: r["state"] for r in merged_states(shaped, f, "k", "row", "o", partitions=parts).collect()}
        for k in range(3):
            want = step(zero, [v for _, g, v in rows if g == k])
            assert eval(states[k], {"frozenset": frozenset}) == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "k bigint, v bigint, o bigint")
    agg = Aggregate(CATALOG["bid_stats"], {}, F.col("v"))
    assert list(agg.scalars(df).first()) == [0, 0, None, None, 0]
    assert Aggregate(CATALOG["bid_stats"], {"k": F.col("k")}, F.col("v")).scalars(df).count() == 0


def test_collected_states(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "k bigint, v bigint, o bigint")
    assert Aggregate(CATALOG["counter"], {"g": F.col("k")}, F.col("v"), F.col("o")).collected(df).first()["s"] == {5: 2, 6: 1}
    vectors = spark.createDataFrame([(1, [1, 2, 3, 4, 5, 6]), (1, [1, 1, 1, 1, 1, 1])], "k bigint, v array<bigint>")
    assert Aggregate(CATALOG["vector_sum"], {"g": F.col("k")}, F.col("v")).collected(vectors, (0,)).first()["s"] == [2, 3, 4, 5, 6]


def test_windows_of_prepared_leaves(spark):
    """Sums that stop at a row, and running sums kept at some, in tumbling and sliding batch windows."""
    from foldwright.streaming.windows import session, sliding, tumbling, windowed

    rows = [(i, f"2024-01-01 00:{i:02d}:00", float((i * 7) % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "o bigint, t string, v double").withColumn("t", F.to_timestamp("t"))
    f = CATALOG["harmonic_mean"]
    for window, length, every in ((tumbling(F.col("t"), "10 minutes"), 10, 10), (sliding(F.col("t"), "20 minutes", "10 minutes"), 20, 10)):
        got = {r["start"].minute if r["start"].year == 2024 else -10: (r["s_0"], r["s_2"]) for r in windowed(df, f, window, {}, F.col("v"), F.col("o")).where("start >= '2024-01-01'").collect()}
        for start in range(0, 50, every):
            vs = [v for o, _, v in rows if start <= o < start + length]
            stop = next((i for i, v in enumerate(vs) if v == 0), len(vs))
            assert got[start] == (stop, stop < len(vs))
    with pytest.raises(ValueError):
        windowed(df, f, session(F.col("t"), "5 minutes"), {}, F.col("v"), F.col("o")).count()


@pytest.mark.parametrize("name", ["average", "vehicle_stats", "bid_stats", "count_latest"])
def test_running_states(name, spark):
    """Every leaf as a window function, against the plain fold after every row."""
    f = CATALOG[name]
    s = Sampler(4)
    rows = [(i, s.value(f.row)) for i in range(25)]
    arity = len(f.row.args) if f.row.kind == "tuple" else 0
    types = [{"num": "bigint", "str": "string", "bool": "boolean"}[t.kind] for t in (f.row.args if arity else (f.row,))]
    df = spark.createDataFrame([(o, *(v if arity else (v,))) for o, v in rows], "o bigint, " + ", ".join(f"c{i} {t}" for i, t in enumerate(types)))
    row = tuple(F.col(f"c{i}") for i in range(arity)) if arity else F.col("c0")
    agg = Aggregate(f, {}, row, F.col("o"))
    columns = agg.over(Window.orderBy("o").rowsBetween(Window.unboundedPreceding, 0))
    assert len(columns) == len(agg.derivation.shapes)
    got = [list(r) for r in df.select("o", *[c.alias(n) for n, c in columns.items()]).orderBy("o").collect()]
    step, zero = s.stepper(f), compile_expr(f.init)({})
    for i in range(25):
        want = step(zero, [v for _, v in rows[: i + 1]])
        flat = []
        for leaf in agg.derivation.shapes:
            x = want
            for j in leaf.leaf.path:
                x = x[j]
            flat.append(sorted(x) if isinstance(x, frozenset) else x)
        assert got[i][1:] == flat


def test_running_states_raise_for_the_rest(spark):
    with pytest.raises(ValueError):
        Aggregate(CATALOG["counter"], {}, F.col("v"), F.col("o")).over(Window.orderBy("o"))


def test_stops_without_keys(spark):
    df = spark.createDataFrame([(i, float((i * 3) % 11)) for i in range(1, 30)], "o bigint, v double")
    agg = Aggregate(CATALOG["harmonic_mean"], {}, F.col("v"), F.col("o"))
    assert list(agg.scalars(df).select("s_0", "s_2").first()) == [10, True]
    assert "SinglePartition" in agg.scalars(df)._jdf.queryExecution().executedPlan().toString() and "Window" not in agg.scalars(df)._jdf.queryExecution().executedPlan().toString()


@needs_data
@pytest.mark.parametrize("name", ["u05_bloomfilter", "u24_hyperloglogaggregationfunction", "u38_statsaggregatefunction"])
def test_sizes_are_counted_without_sets(spark, name):
    plan = next(QUERIES[n] for n in QUERIES if n.startswith(name[:6]) and not n[3:4].isalpha())(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan
