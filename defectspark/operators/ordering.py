"""Total order of a table as a stored position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectspark.session import stored

_PLACE_BITS = 33


def ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in the order of ``keys`` over tasks and in them; rows that tie spread over tasks too, by a number of the row."""
    spread = df.withColumn("__no", F.monotonically_increasing_id())
    return spread.repartitionByRange(*keys, "__no").sortWithinPartitions(*keys, "__no").drop("__no")


def with_position(df: DataFrame, keys: Sequence[str], position: str = "position") -> DataFrame:
    """Adds the row's place, from 0, in the order of ``keys``; nulls first, rows that tie in any order.

    Rows are ranged, sorted where they land and stored; the count of every task gives the next one's
    start. One count per task is all that meets in one place.
    """
    rows = stored(ranged(df, keys).withColumn("__id", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("__task", F.shiftright("__id", _PLACE_BITS))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("__task").agg(F.count("*").alias("__n"))
    starts = counts.select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return rows.join(starts, "__task").withColumn(position, F.col("__start") + place).drop("__id", "__task", "__start")
