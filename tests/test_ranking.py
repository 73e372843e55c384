"""Balanced buckets: bounded size in narrow bands, hot hours and ties, and results equal to the plain window."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from defectspark.operators import ranking as K
from defectspark.operators import series as S


def sizes(df, *keys, **cut):
    return sizes_of(df, K.Balanced(*keys, **cut))


def sizes_of(df, bucket):
    pieces, names = K.with_pieces(df, ["g"], bucket)
    return [r["count"] for r in pieces.groupBy(*names).count().collect()]


def test_a_narrow_band_falls_into_many_buckets(spark):
    df = spark.range(200_000).select(F.lit("a").alias("g"), (1e6 + F.col("id") / 1000.0).alias("v"))
    got = sizes(df, F.col("v"))
    assert len(got) > 500 and max(got) <= 4096 and sum(got) == 200_000


def test_one_hot_hour_spreads(spark):
    start = F.lit("2026-01-01 10:00:00").cast("timestamp")
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.timestamp_micros(F.unix_micros(start) + F.col("id") * 7).alias("ts"), "id")
    assert max(sizes_of(df, K.Balanced.over_time(F.col("ts")))) <= 4096
    # All at one instant: the next key cuts.
    assert max(sizes_of(df.withColumn("ts", start), K.Balanced.over_time(F.col("ts"), F.col("id")))) <= 4096


def test_equal_rows_stay_together(spark):
    df = spark.range(20_000).select(F.lit(1).alias("g"), F.lit(2.5).alias("v"))
    assert sizes(df, F.col("v")) == [20_000]


@pytest.mark.parametrize("seed", [1, 2])
def test_ranks_equal_the_plain_window(spark, seed):
    draw = random.Random(seed)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308]
    rows = [(draw.choice(["a", "b", None]), draw.choice([draw.choice(odd), 1e9 + draw.random(), draw.gauss(0, 1), float(draw.randrange(3))]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    order = [F.col("v"), F.col("i")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)).cast("long"))
    want = {r.i: r.r for r in plain.collect()}
    cut = K.Balanced(F.col("v"), F.col("i"), least=7, width=4)
    got = K.exact_rank(df, ["g"], order, cut, "r")
    assert {r.i: r.r for r in got.collect()} == want
    assert max(sizes(df, F.col("v"), F.col("i"), least=7, width=4)) <= 7


def test_percentiles_in_a_narrow_band(spark):
    values = [1e6 + i / 64 for i in range(10_001)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    row = K.exact_percentiles(df, ["g"], "v", {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}).first()
    assert (row.p0, row.p25, row.p50, row.p99, row.p100) == (values[0], values[2500], values[5000], values[9900], values[-1])


def test_steps_in_one_hour(spark):
    draw = random.Random(4)
    rows = [("r", draw.randrange(400), draw.randrange(5000)) for _ in range(9000)]
    df = spark.createDataFrame(rows, "g string, s long, step long").select("g", F.timestamp_seconds("s").alias("ts"), "step", F.lit(1.0).alias("loss"))
    got = sorted(r.step for r in S.broken_steps(df, ["g"], "step", ["loss"], "ts").collect())
    seen, want = -1, []
    for _, step in sorted((s, step) for _, s, step in rows):
        want += [step] if step <= seen else []
        seen = max(seen, step)
    assert got == sorted(want)
