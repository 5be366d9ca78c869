"""What several operators of this subpackage need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import ship

WHITE = " \t\n\x0b\f\r"  # U+0020 and U+0009 to U+000D
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows below which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 400_000
#: A key with more than this share of all rows is heavy, so there are fewer than 1 / share of them.
HEAVY_SHARE = 1e-4


#: Rows that go to a Python worker together: whole texts, so fewer than Spark's own 10,000.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Give the workers this package and batches of a size that texts allow."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def n_words(c: Column) -> Column:
    """Words of a text; 0 for a null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def small(df: DataFrame, rows: int) -> DataFrame:
    """A side to broadcast if its counted rows are few, else left to the planner."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join of many rows with one row per key, whatever share of the rows a key has.

    ``right[count]`` is how many of the ``total`` rows on the left have the key.
    Keys with more than HEAVY_SHARE of them are fewer than 1 / HEAVY_SHARE, which bounds
    the broadcast; any other key's rows are a small part of a shuffled join.
    """
    most = int(total * HEAVY_SHARE) + 1
    heavy, light = right.filter(F.col(count) > most), right.filter(F.col(count) <= most)
    return left.join(F.broadcast(heavy), on).unionByName(left.join(light.hint("merge"), on))
