"""Shared by the vector searches: reading vectors, blocks of bounded size, merging lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of data, and of queries, that one task holds at once.
DATA_BLOCK, QUERY_BLOCK = 8192, 1024


def usable(table: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) and at, the number of a row, of those without null or non-finite components; to be written before it is used."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad).withColumn("at", F.monotonically_increasing_id())


def is_query(vec_id: Column) -> Column:
    return F.pmod(vec_id, F.lit(100)) == 0


def matrix(column, width: int) -> np.ndarray:
    """An Arrow list column as a matrix; shorter vectors are filled with zeros."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for i, (a, n) in enumerate(zip(starts, sizes)):
        out[i, :n] = flat[a : a + n]
    return out


def best(found: DataFrame, k: int, descending: bool) -> DataFrame:
    """The k best of each query row (at) over all blocks, ranked from 1, ties to the smaller vec_id."""
    order = F.desc("score") if descending else F.asc("score")
    rank = F.row_number().over(Window.partitionBy("at").orderBy(order, "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= cut)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))][:k]
