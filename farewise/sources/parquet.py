"""Parquet scan and sink for trip tables and stage outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def read_trips_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columnar scan; a projection here reaches the reader as ReadSchema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, num_partitions: int | None = None,
                  partition_by: Sequence[str] | None = None, mode: str = "overwrite") -> str:
    """Write a stage output (this is also how lineage is cut between stages).

    ``num_partitions`` repartitions round-robin first (file count control);
    ``partition_by`` lays out directories for partition pruning.
    """
    if num_partitions:
        df = df.repartition(num_partitions)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path
