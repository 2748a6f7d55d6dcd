"""Queries about plans: windows, running frames, rollups, streams, runtimes and merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.aggregate import Aggregate
from ..plans.runtime import merged_states
from ..sources.tables import table
from ..streaming.windows import session, sliding, tumbling, windowed
from ..synth.classics import CLASSICS
from ..synth.derive import derive_merge
from ..synth.refute import refute
from .catalog import CATALOG
from .queries import C, E_CENTS, cents, ORACLES, QUERIES, register

_STATS = {"n": "s_1", "total": "s_0", "lo": "s_2", "hi": "s_3"}
_AGG = f"count(*) AS n, CAST(sum({E_CENTS}) AS BIGINT) AS total, min({E_CENTS}) AS lo, max({E_CENTS}) AS hi"


def _stats(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *[C(v).alias(k) for k, v in _STATS.items()])


@register("stream_tumbling", f"SELECT CAST(epoch_us(date_trunc('day', ts)) AS BIGINT) AS day, event_type AS g, {_AGG} FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily statistics by a tumbling window over a file stream, run to its end."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob, as a stream reads folders and the table may be one file
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = windowed(stream.withColumn("ts", C("ts").cast("timestamp")), CATALOG["bid_stats"], tumbling(C("ts"), "1 day"), {"g": C("event_type")}, cents("value").cast("decimal(18,0)"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    place = f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"
    # each batch replaces the table; nothing is held by the driver
    query = rows.writeStream.outputMode("complete").foreachBatch(lambda part, _: part.write.mode("overwrite").parquet(place)).option("checkpointLocation", place + "-state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(rows.schema).parquet(place)
    return done.select(F.unix_micros("start").alias("day"), "g", C("s_1").alias("n"), C("s_0").cast("bigint").alias("total"), C("s_2").cast("bigint").alias("lo"), C("s_3").cast("bigint").alias("hi"))


@register("window_sliding", f"""SELECT CAST(epoch_us(d) AS BIGINT) AS start_us, event_type AS g, {_AGG} FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY 1, 2""")
def window_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-day windows every day."""
    df = table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    rows = windowed(df, CATALOG["bid_stats"], sliding(C("ts"), "2 days", "1 day"), {"g": C("event_type")}, cents("value"))
    return _stats(rows.withColumn("start_us", F.unix_micros("start")), "start_us", "g")


@register("window_session", f"""WITH p AS (SELECT user_id, ts, value, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events),
q AS (SELECT *, sum(CASE WHEN b IS NULL OR ts > b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM p)
SELECT CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, user_id AS g, {_AGG} FROM q GROUP BY user_id, s""")
def window_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end after six hours without an event."""
    df = table(spark, sf_dir, "events").withColumn("ts", C("ts").cast("timestamp"))
    rows = windowed(df, CATALOG["bid_stats"], session(C("ts"), "6 hours"), {"g": C("user_id")}, cents("value"))
    return _stats(rows.withColumn("start_us", F.unix_micros("start")), "start_us", "g")


@register("win_running", f"SELECT event_id AS id, count(*) OVER w AS n, CAST(sum({E_CENTS}) OVER w AS BIGINT) AS total, min({E_CENTS}) OVER w AS lo, max({E_CENTS}) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def win_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold's state after every row, as window functions over one frame."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    state = Aggregate(CATALOG["bid_stats"], {}, cents("value")).over(w)
    return table(spark, sf_dir, "events").select(C("event_id").alias("id"), *[state[v].alias(k) for k, v in _STATS.items()])


@register("rollup_stats", f"SELECT coalesce(event_type, 'all') AS g, coalesce(user_id % 5, -1) AS h, {_AGG} FROM events GROUP BY ROLLUP (event_type, user_id % 5)")
def rollup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold under grouping sets."""
    agg = Aggregate(CATALOG["bid_stats"], {}, cents("value"))
    aggs = [agg.native(s).alias(agg.column_name(s)) for s in agg.derivation.shapes]
    rows = table(spark, sf_dir, "events").withColumn("m", C("user_id") % 5).rollup("event_type", "m").agg(*aggs)
    return _stats(rows.select(F.coalesce("event_type", F.lit("all")).alias("g"), F.coalesce("m", F.lit(-1)).alias("h"), "*"), "g", "h")


@register("global_stats", f"SELECT {_AGG} FROM events")
def global_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No keys: one row, also over no rows."""
    return _stats(Aggregate(CATALOG["bid_stats"], {}, cents("value")).scalars(table(spark, sf_dir, "events")))


@register("part_invariance", ORACLES["u20_transactionsummaryaggregator"])
def part_invariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-sensitive fold over rows dealt out anew: the order key, not the partitions, decides."""
    df = table(spark, sf_dir, "customer").repartition(7, F.xxhash64("c_name"))
    agg = Aggregate(CATALOG["transaction_summary"], {"g": C("c_nationkey")}, ((C("c_name"), cents("c_acctbal")), C("c_acctbal") > 0), C("c_custkey"))
    return agg.scalars(df).select("g", C("s_0").alias("processed"), C("s_1").alias("item"), C("s_2").alias("ok"), C("s_3").alias("failed"), C("s_4").alias("volume"))


@register("w03_batched", "SELECT user_id AS g, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS v, event_type AS k FROM events GROUP BY 1, 3")
def w03_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold inside a fold's step is the fold over all elements."""
    n = F.when(C("event_id") % 3 == 0, 2).otherwise(1)
    xs = F.transform(F.array_repeat(C("event_type"), n), lambda t: F.struct(t.alias("_0"), F.lit(1).cast("bigint").alias("_1")))
    return Aggregate(CATALOG["term_frequency"], {"g": C("user_id")}, xs).entries(table(spark, sf_dir, "events")).select("g", "k", "v")


@register("tier_c_runtime", "SELECT event_type AS g, '(' || CAST(count(*) AS VARCHAR) || ', ' || CAST(count(*) FILTER (WHERE user_id <> 0) AS VARCHAR) || ')' AS state FROM events GROUP BY 1")
def tier_c_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived merge on partial states, in Python: for folds that no built-in covers."""
    return merged_states(table(spark, sf_dir, "events"), CATALOG["session"], "event_type", "user_id", "event_id").select(C("key").alias("g"), "state")


@register("m_merge_report")
def m_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, merge and plan of every aggregate of the catalogue."""
    rows = []
    for name, f in CATALOG.items():
        d = derive_merge(f)
        rows.append((name, d.status, str(d), [s.kind for s in d.shapes]))
    return spark.createDataFrame(rows, "name string, status string, merge string, kinds array<string>")


#: Which aggregates of the catalogue merge as written is known beforehand; all others do.
_OTHERS = {"clickstream": "lifted", "ohlc": "lifted", "telemetry": "lifted", "hourly_avg": "ordered", "raster": "ordered"}
_STATUS = ", ".join(f"('{n}', '{_OTHERS.get(n, 'merged')}')" for n in CATALOG)


@register("m_merge_status", f"SELECT name, status FROM (VALUES {_STATUS}) AS t(name, status)")
def m_merge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How every aggregate of the catalogue is evaluated."""
    return spark.createDataFrame([(n, derive_merge(f).status) for n, f in CATALOG.items()], "name string, status string")


#: The one of the textbook folds whose state is enough on rows that can occur.
_MERGEABLE = "maximum_prefix_sum"
_VERDICTS = ", ".join(f"('{n}', {str(n != _MERGEABLE).lower()})" for n in CLASSICS)


@register("x_verdicts", f"SELECT name, refuted FROM (VALUES {_VERDICTS}) AS t(name, refuted)")
def x_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each textbook fold is refuted."""
    return spark.createDataFrame([(n, refute(f, cases=4000) is not None) for n, f in CLASSICS.items()], "name string, refuted boolean")


@register("x_classics")
def x_classics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on folds that are known not to merge."""
    return spark.createDataFrame([(n, r.rule if (r := refute(f)) else None) for n, f in CLASSICS.items()], "name string, refuted_by string")


__all__ = ["QUERIES", "ORACLES"]
