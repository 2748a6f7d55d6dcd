"""The same folds in windows of event time, on a batch or a stream.

A window is one more grouping key, so a fold's built-in leaves run in tumbling, sliding
and session windows with the engine's own partial states, late rows being dropped by the
watermark.  Leaves that need a group-wide value first are for batches only, and not for
sessions, whose bounds aren't known row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Fold
from ..plans.aggregate import Aggregate

#: Leaves that a streaming aggregation can hold.
STREAMABLE = {"sum", "max", "min", "or", "and", "keep", "last", "last_if", "first", "arg_max", "arg_min", "set_add", "set_union", "append", "prepend"}


def tumbling(time: Column, length: str) -> Column:
    return F.window(time, length)


def sliding(time: Column, length: str, every: str) -> Column:
    return F.window(time, length, every)


def session(time: Column, gap: str) -> Column:
    return F.session_window(time, gap)


def windowed(df: DataFrame, fold: Fold, window: Column, keys: dict[str, Column], row, order: Column | None = None, late: tuple[str, str] | None = None) -> DataFrame:
    """start, end, keys and the fold's leaves.  ``late``: time column and how long to wait for late rows."""
    agg = Aggregate(fold, keys, row, order)
    kinds = {s.kind for s in agg.derivation.shapes}
    if df.isStreaming and kinds - STREAMABLE:
        raise ValueError(f"{fold.name} can't run on a stream: {sorted(kinds - STREAMABLE)}")
    if late:
        df = df.withWatermark(*late)
    if kinds & {"freeze_sum", "prefix_sum_at"}:  # these need a value of the whole window first
        if "session_window" in str(window):
            raise ValueError(f"{fold.name} can't run in sessions: their bounds aren't known row by row")
        df = df.withColumn("__w", window)
        agg = Aggregate(fold, {"__w": F.col("__w"), **keys}, row, order)
        df, window = agg.prepared(df), F.col("__w")
    aggs = [agg.native(s).alias(agg.column_name(s)) for s in agg.derivation.shapes]
    out = df.groupBy(window.alias("w"), *[c.alias(k) for k, c in keys.items()]).agg(*aggs)
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[agg.column_name(s) for s in agg.derivation.shapes])
