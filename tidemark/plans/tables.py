"""Reading the tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    naive = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(naive) if naive else df


def spread(df: DataFrame) -> DataFrame:
    """A table that is one scan partition (at most spark.sql.files.maxPartitionBytes, or one row group) in as many as the
    cluster has cores, for work that costs far more than moving so little. Any larger table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= 1 < cores else df
