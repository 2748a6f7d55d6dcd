"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, materialize

#: Tasks over which the neighbours of one node are spread.
SALTS = 32


def _with_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` and m, the least v of each u: by parts of a node's neighbours, then over the parts."""
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = salted.groupBy("u", "s").agg(F.min("v").alias("m"))
    parts = parts.withColumn("m", F.min("m").over(Window.partitionBy("u")))
    return salted.join(parts, ["u", "s"]).drop("s")


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, label): every node of ``edges(u, v)`` with the smallest node it can reach.

    Alternates large-star and small-star steps: each node hands its larger (smaller)
    neighbours to its least neighbour, until only stars are left.  The number of
    rounds grows with the logarithm of the graph; each round is written to the
    shared checkpoint folder, and the one before is removed.  A node's neighbours are
    dealt over ``SALTS`` tasks.  Null ends and loops are dropped.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    pairs = materialize(pairs.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct(), tag)
    state = None
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = _with_least(large)
        older, pairs = pairs, materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
            .unionAll(small.select("u", F.col("m").alias("v"))).distinct(), tag)
        drop_table(older)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(pairs.select(F.col("v"), F.col("v")).distinct())
