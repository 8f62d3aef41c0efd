"""Scans of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SMALL = 64 << 20


def spread(df: DataFrame, small: int = SMALL) -> DataFrame:
    """Deal a small table to all cores: one with a single row group would be read, and all that follows
    computed, by one task. Larger tables have enough splits of their own and are left as they are."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < small else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
