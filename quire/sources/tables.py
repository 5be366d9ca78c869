"""Readers for the parquet tables. Column pruning and filters are left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; local timestamps become UTC instants so watermarks accept them."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    for f in df.schema.fields:
        if isinstance(f.dataType, TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")
