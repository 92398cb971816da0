"""Parquet tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """The table, dealt over all cores where its files give fewer partitions than there are; large tables stay as they
    are read, without a shuffle."""
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
