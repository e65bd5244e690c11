"""Report sink: one sorted CSV part file with a header, and its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY_DECIMAL = "decimal(18,2)"


def write_report_csv(df: DataFrame, path: str, money_cols: tuple[str, ...] = ()) -> str:
    """Write a (small, sorted) report as a single CSV file.

    ``coalesce(1)`` keeps the sort order of the final stage. Money columns can
    be written as DECIMAL(18,2) so they never appear in scientific notation.
    """
    for c in money_cols:
        df = df.withColumn(c, F.col(c).cast(MONEY_DECIMAL))
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)
