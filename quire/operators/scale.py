"""Ordered work on groups of any size.

A window over one key puts that key's rows in one task. So the order is cut into slices
of a fixed width (an hour, so many positions): rows are ordered within their slice, one
small row per slice is ordered within the group, and what the slices before bring is
joined on. The plan is the same at every size, and a row far off makes one slice more.

Both readings of the rows are of a written table, so what lies below is worked out once
however many of these steps follow each other; a table as it was read (``cheap``) needs none. Group and slice are one struct, which is never null and
holds null groups too: the join on it and the window over it share one shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import written

#: Slice widths: an hour of milliseconds, and positions in a sequence.
HOUR = 3_600_000
POSITIONS = 65_536


def _sliced(df: DataFrame, group: list[str], place: Column, width: int, value: Column, cheap: bool) -> DataFrame:
    """The rows with their slice of their group (``_slice``) and a value; written once, unless reading them again is cheap."""
    slice_of = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.floor(place / width).alias("slice"))
    rows = df.withColumns({"_slice": slice_of, "_value": value})
    return rows if cheap else written(rows, "slices")


def _over_slices(group: list[str]):
    """Slices of a group in order."""
    return Window.partitionBy(*[F.col(f"_slice.g{i}") for i in range(len(group))]).orderBy("_slice.slice")


def _running(df: DataFrame, group: list[str], place: Column, order: list[str], value: Column, name: str, width: int,
             fold: Callable, both: Callable, with_row: bool, cheap: bool) -> DataFrame:
    """`fold` (an aggregate) of `value` over the rows of a group up to each row, or before it; `both` combines two results."""
    rows = _sliced(df, group, place, width, value, cheap)
    inner = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_row else -1)
    outer = _over_slices(group).rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("_slice").agg(fold("_value").alias("_fold")).withColumn("_earlier", fold("_fold").over(outer)).drop("_fold")
    local = rows.join(earlier, "_slice").withColumn("_local", fold("_value").over(inner))
    return local.withColumn(name, both(F.col("_earlier"), F.col("_local"))).drop("_slice", "_value", "_local", "_earlier")


def running_total(df: DataFrame, group: list[str], place: Column, order: list[str], amount: Column, name: str, width: int = HOUR, cheap: bool = False) -> DataFrame:
    """Sum of `amount` up to and with each row. `order` must begin with `place`, which is numeric."""
    return _running(df, group, place, order, amount, name, width, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + b, True, cheap)


def numbered(df: DataFrame, group: list[str], place: Column, order: list[str], name: str, width: int = POSITIONS, cheap: bool = False) -> DataFrame:
    """row_number within groups."""
    return running_total(df, group, place, order, F.lit(1), name, width, cheap)


def greatest_before(df: DataFrame, group: list[str], place: Column, order: list[str], value: Column, name: str, width: int = HOUR, cheap: bool = False) -> DataFrame:
    """The greatest `value` of the rows before each row; null for the first."""
    return _running(df, group, place, order, value, name, width, F.max, F.greatest, False, cheap)


def previous(df: DataFrame, group: list[str], place: Column, order: list[str], value: str, name: str, width: int = HOUR, cheap: bool = False) -> DataFrame:
    """lag(value); the value is never null."""
    rows = _sliced(df, group, place, width, F.col(value), cheap)
    last = rows.groupBy("_slice").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(_over_slices(group))).drop("_last")
    local = rows.join(carried, "_slice").withColumn("_lag", F.lag("_value").over(Window.partitionBy("_slice").orderBy(*order)))
    return local.withColumn(name, F.coalesce("_lag", "_carried")).drop("_slice", "_value", "_lag", "_carried")


#: Rows below which a side may be broadcast once it has been counted.
BROADCAST_ROWS = 400_000


def small(written: DataFrame) -> DataFrame:
    """A written side, counted: to broadcast if its rows are few, else left to the planner."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written
