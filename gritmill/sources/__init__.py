"""Readers and writers of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder; columns and filters are pushed into the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under an explicit schema; damaged lines become rows of nulls."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def overwrite_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces only the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
