"""The test tables, one Parquet file or folder each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """A scan over all cores: where it has fewer partitions than there are cores its rows are dealt out, else it stays as it is.

    Filters and the choice of columns still reach the scan. Only for tables as read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A table; ``heavy`` if much is to be done with each row."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy else df
