"""Contiguous shards of near-equal bytes by global prefix sums.

Documents are put in the order of (doc_id, text checksum, size).  A range
partitioning makes every partition one stretch of that order; each partition's
totals give the offset of the next ones, so the global prefix sum of a row is its
partition's offset plus a sum inside the partition.  Cutting the prefix sums at
equal targets gives contiguous shards.  Only one row of totals per partition and
one per shard reach the driver.

Null texts have size 1, null ids come first, repeated rows lie next to each other
and may fall on either side of a cut.  A very long text is one row, so a shard may be off
its target by it.  No rows give no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Rows that one range partition should hold at least; partitions grow in number with the input.
ROWS_PER_PARTITION = 20_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one more), text_crc32; no text goes further."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + F.lit(1)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) for every row.

    A row goes to the shard in which the middle of its bytes lies, so a shard is
    off its target by less than one document.
    """
    spark = docs.sparkSession
    # the input partition splits long stretches of fully equal rows, which are interchangeable
    base = materialize(sized(docs).withColumn("part", F.spark_partition_id()), "shard-sizes")
    rows = base.count()
    if not rows:
        return _shaped(base, F.lit(0), F.lit(0))
    n_parts = max(2, min(rows // ROWS_PER_PARTITION + 1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["doc_id", "text_crc32", "size", "part"]
    ranged = base.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("stretch", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "shard-stretches")
    totals = sorted(ranged.groupBy("stretch").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect())
    total = sum(t["bytes"] for t in totals)
    offsets, so_far, count = [], 0, 0
    for t in totals:
        offsets.append((t["stretch"], so_far, count))
        so_far, count = so_far + t["bytes"], count + t["n"]
    offset = spark.createDataFrame(offsets, "stretch int, bytes_before long, rows_before long")
    inside = Window.partitionBy("stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.join(F.broadcast(offset), "stretch")  # a row per range partition
        .withColumn("upto", F.col("bytes_before") + F.sum("size").over(inside))
        .withColumn("rank", F.col("rows_before") + F.count("*").over(inside) - 1)
    )
    middle = F.col("upto") * 2 - F.col("size")
    placed = placed.withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(2 * total))).cast("int"))
    placed = materialize(placed.select("doc_id", "size", "text_crc32", "shard", "rank"), "shard-placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    starts = F.array(*[F.lit(int(first.get(s, 0))).cast("long") for s in range(n_shards)])
    return _shaped(placed, F.col("shard"), F.col("rank") - F.get(starts, F.col("shard")))


def _shaped(df: DataFrame, shard, slot) -> DataFrame:
    return df.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
        shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8) -> DataFrame:
    """Write the documents as ``path/shard=k/`` folders, each in the order of its slots; returns the placement.

    Equal rows, of which some may lie before a cut and some behind it, are numbered on both sides and matched
    by number, so the files hold what the placement says.
    """
    placed = materialize(shard_by_bytes(docs, n_shards), "shard-written")
    equal = ["doc_id", "size", "text_crc32"]
    numbered = lambda df, *order: df.withColumn("copy", F.row_number().over(Window.partitionBy(*equal).orderBy(*order)))
    sizes = [F.col("doc_id").cast("long"), (F.octet_length(F.coalesce(F.col("text"), F.lit("")).cast("binary")) + 1).cast("long"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))]
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(n) for n, c in zip(equal, sizes)], F.col("text").alias("own"))
    a, b = numbered(rows, "own"), numbered(placed, "shard", "slot").select(*[F.col(c).alias("p_" + c) for c in (*equal, "copy")], "shard", "slot")
    same = (a["copy"] == b["p_copy"]) & a["size"].eqNullSafe(b["p_size"]) & a["doc_id"].eqNullSafe(b["p_doc_id"]) & (a["text_crc32"] == b["p_text_crc32"])
    out = a.join(b, same).select("row.*", "shard", "slot")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out.repartitionByRange(max(n_shards, parts), "shard", "slot").sortWithinPartitions("shard", "slot").drop("slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return placed
