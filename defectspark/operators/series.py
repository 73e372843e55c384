"""Logged series per run: trends, downsampling, throughput, order and finiteness.

Steps are ranked through the bucketed rank, so one long run is never sorted in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectspark.operators.ranking import Balanced, Bucket, exact_rank, join_groups, with_pieces


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Bucket) -> DataFrame:
    """Adds ``step`` (from 1) and ``n_values``."""
    return exact_rank(df, group, order, bucket, "step", "n_values")


def loss_trend(series: DataFrame, group: Sequence[str], value: str, first: int = 5, last: int = 5) -> DataFrame:
    """Means of the first and last values, value count, and count of non-finite values."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return series.groupBy(*group).agg(
        F.max("n_values").alias("n_values"),
        F.count_if(bad).alias("n_bad"),
        F.avg(F.when(F.col("step") <= first, v)).alias("first_mean"),
        F.avg(F.when(F.col("step") > F.col("n_values") - last, v)).alias("last_mean"),
    )


def downsampled(series: DataFrame, group: Sequence[str], value: str, size: int = 8) -> DataFrame:
    """Means over runs of ``size`` steps; the last run may be short."""
    update = (F.floor((F.col("step") - 1) / size) + 1).cast("long")
    return series.groupBy(*group, update.alias("update")).agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_steps")
    )


def throughput(series: DataFrame, group: Sequence[str], ts: str) -> DataFrame:
    """Steps per second since the first row of the run; null at the first instant."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    started = series.groupBy(*group).agg(F.min(micros).alias("__start"))
    seconds = (micros - F.col("__start")) / F.lit(1e6)
    return join_groups(series, started, group).select(
        *series.columns, (F.col("step") / F.nullif(seconds, F.lit(0.0))).alias("per_second")
    )


def broken_steps(df: DataFrame, group: Sequence[str], step: str, values: Sequence[str], ts: str) -> DataFrame:
    """Rows with a non-finite value, or logged after a later step.

    Rows of one time count in the order of their steps. A run is cut into pieces of time that hold
    few rows each, however many fall into one hour; inside a piece, steps are checked against their
    running maximum, which starts from the maximum of all earlier pieces.
    """
    bad = F.lit(False)
    for name in values:
        v = F.col(name)
        bad = bad | v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    cut, piece = with_pieces(df, group, Balanced.over_time(F.col(ts), F.col(step)))
    peaks = cut.groupBy(*piece).agg(F.max(step).alias("__peak"))
    past = Window.partitionBy(piece[0]).orderBy(piece[1]).rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.select(*piece, F.max("__peak").over(past).alias("__carry"))
    inside = Window.partitionBy(*piece).orderBy(ts, step).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("__carry", F.max(step).over(inside))
    rule = F.when(bad, "non-finite value").when(F.col(step) <= seen, "step out of order")
    checked = cut.join(carried, piece).withColumn("rule", rule)
    return checked.where("rule IS NOT NULL").select(*group, step, "rule")
