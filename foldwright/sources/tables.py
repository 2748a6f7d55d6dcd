"""Tables by name in a folder, in any format that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, format: str = "parquet") -> DataFrame:
    return spark.read.format(format).load(f"{folder}/{name}.{format}")


def write_table(df: DataFrame, folder: str, name: str, format: str = "parquet", mode: str = "overwrite") -> str:
    path = f"{folder}/{name}.{format}"
    df.write.format(format).mode(mode).save(path)
    return path
