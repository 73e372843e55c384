"""Exact ranks, running counts and percentiles that survive hot groups.

A window over one huge group runs in one task. These operators split every group
into order-preserving buckets, count the buckets (map-side combined), turn the
counts into offsets, and sort only inside ``(group, bucket)``. The bucket is a
pure function of the row, so both passes agree without a checkpoint. Results
equal the plain window.

Buckets of numbers come from ``Balanced``: logarithmic steps are counted, and steps that hold too
many rows are cut into cells between their own smallest and largest value, again and again, and by
the next key where values tie. However narrow the band of values, no bucket stays large.

Group columns travel as one struct: two structs with null fields are equal, so rows with
a null group stay, which a join on the plain columns would drop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_GROUP, _BUCKET, _BEFORE, _SIZE, _N = "__group", "__bucket", "__before", "__size", "__n"


def hash_order(seed: int | str, *keys: Column) -> Column:
    """Seeded pseudo-random order key: the SHA-256 of ``seed|key|...``."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def hash_bucket(order_key: Column, digits: int = 4) -> Column:
    """Leading hex digits of a hash key: uniform and order preserving."""
    return F.substring(order_key, 1, digits)


def value_bucket(value: Column, per_octave: int = 1024) -> Column:
    """Order-preserving bucket of a double: logarithmic steps, no data scan; infinities and NaN have their own."""
    value = value.cast("double")
    high = F.isnan(value) | (value == float("inf"))
    low = value == float("-inf")
    size = F.when(high | low | (value == 0), 1.0).otherwise(F.abs(value))
    octave = F.floor(F.log2(size))
    step = octave * per_octave + F.floor((size / F.pow(F.lit(2.0), octave) - 1) * per_octave)
    # 1100 octaves keep every positive step above zero, so signs do not mix.
    positive = step + 1100 * per_octave
    return (
        F.when(F.isnan(value), F.lit(2 << 40))
        .when(high, F.lit(1 << 40))
        .when(low, F.lit(-(1 << 40)))
        .when(value == 0, F.lit(0).cast("long"))
        .when(value > 0, positive.cast("long"))
        .otherwise(-positive.cast("long"))
    )


def step_bucket(value: Column, width: int = 65536) -> Column:
    """Fixed-width bucket of an integer position."""
    return F.floor(value / F.lit(width)).cast("long")


class Balanced:
    """Order-preserving buckets of bounded size for rows ordered by numeric keys.

    A bucket is a path: the logarithmic step of the first key, then the cells it was cut into. A
    bucket is cut while it holds more than ``least`` rows and more than one ``parts``-th of all, so a
    round cuts fewer than ``parts`` buckets and only their bounds travel, through the driver and by
    broadcast. Keys are compared as doubles; rows that tie on all of them stay together.
    ``per_octave`` is the number of steps to a doubling of the first key.
    """

    def __init__(self, *keys: Column, parts: int = 20_000, least: int = 4096, width: int = 1024, per_octave: int = 1024) -> None:
        self.keys, self.parts, self.least, self.width, self.per_octave = keys, parts, least, width, per_octave

    @classmethod
    def over_time(cls, ts: Column, *keys: Column) -> Balanced:
        """Buckets along a time: first steps of about half an hour in this century, then cut as needed."""
        return cls(F.unix_micros(ts.cast("timestamp")), *keys, per_octave=1 << 20)

    def add(self, base: DataFrame) -> DataFrame:
        """``base``, which has its group struct, with the bucket column."""
        names = [f"__key{i}" for i in range(len(self.keys))]
        keyed = base.withColumns({n: k.cast("double") for n, k in zip(names, self.keys)})
        keyed = keyed.withColumn(_BUCKET, F.array(value_bucket(F.col(names[0]), self.per_octave)))
        most = max(self.least, keyed.count() // self.parts)
        while True:
            cells = self._full(keyed, names, most)
            if cells is None:
                return keyed.drop(*names)
            key = F.get(F.array(*names), F.col("__no"))
            place = F.floor((key - F.col("__low")) / (F.col("__high") - F.col("__low")) * self.width)
            cell = F.when(F.col("__steps"), value_bucket(key)).otherwise(F.least(place, F.lit(self.width - 1).cast("long")))
            path = F.when(F.col("__no").isNotNull(), F.concat(_BUCKET, F.array(cell))).otherwise(F.col(_BUCKET))
            columns = keyed.columns
            keyed = keyed.join(F.broadcast(cells), [_GROUP, _BUCKET], "left").withColumn(_BUCKET, path).select(*columns)

    def _full(self, keyed: DataFrame, names: Sequence[str], most: int) -> DataFrame | None:
        """Buckets to cut: by which key, between which bounds, and whether by logarithmic steps first."""
        counts = keyed.groupBy(_GROUP, _BUCKET).agg(
            F.count(F.lit(1)).alias(_N),
            *[F.min(n).alias(f"{n}_low") for n in names], *[F.max(n).alias(f"{n}_high") for n in names],
        )
        steps = lambda n: value_bucket(F.col(f"{n}_low")) < value_bucket(F.col(f"{n}_high"))
        first = F.coalesce(*[F.when(F.col(f"{n}_low") < F.col(f"{n}_high"), i) for i, n in enumerate(names)])
        pick = lambda values: F.get(F.array(*values), F.col("__no"))
        full = counts.where(F.col(_N) > most).withColumn("__no", first).where("__no IS NOT NULL").select(
            _GROUP, _BUCKET, "__no", pick([F.col(f"{n}_low") for n in names]).alias("__low"),
            pick([F.col(f"{n}_high") for n in names]).alias("__high"), pick([steps(n) for n in names]).alias("__steps"),
        )
        rows = full.collect()
        return keyed.sparkSession.createDataFrame(rows, full.schema) if rows else None


Bucket = Column | Balanced


def _bucketed(base: DataFrame, bucket: Bucket) -> DataFrame:
    return bucket.add(base) if isinstance(bucket, Balanced) else base.withColumn(_BUCKET, bucket)


def with_pieces(df: DataFrame, group: Sequence[str], bucket: Bucket) -> tuple[DataFrame, list[str]]:
    """``df`` cut into order-preserving pieces, and the names of the columns that tell pieces apart: the group and its piece."""
    return _bucketed(df.withColumn(_GROUP, F.struct(*group)), bucket), [_GROUP, _BUCKET]


def sampled_bucket(df: DataFrame, key: Column, buckets: int = 64, per_bucket: int = 16) -> Column:
    """Order-preserving bucket for any orderable key, from a hash-chosen sample.

    Only ``buckets * per_bucket`` keys reach the driver, whatever the table size.
    """
    sample = (
        df.select(key.alias("k")).where(F.col("k").isNotNull())
        .orderBy(F.xxhash64("k"), "k").limit(buckets * per_bucket).collect()
    )
    bounds = sorted(row["k"] for row in sample)[per_bucket - 1 :: per_bucket]
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(cuts, lambda cut: cut < key))


def join_groups(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Inner join on group columns that keeps null groups; ``right`` adds its other columns."""
    key = F.struct(*group)
    table = right.select(key.alias(_GROUP), *[c for c in right.columns if c not in group])
    return left.withColumn(_GROUP, key).join(table, _GROUP).drop(_GROUP)


def _offsets(counts: DataFrame, sums: Sequence[str], descending: bool) -> DataFrame:
    """Per (group, bucket): the sums over all earlier buckets and over the group."""
    order = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    earlier = Window.partitionBy(_GROUP).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(_GROUP)
    return counts.select(
        _GROUP,
        _BUCKET,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"{_BEFORE}_{s}") for s in sums],
        *[F.sum(s).over(whole).alias(f"{_SIZE}_{s}") for s in sums],
    )


def exact_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    bucket: Bucket,
    rank: str = "rank_no",
    size: str | None = None,
    keep: int | None = None,
) -> DataFrame:
    """``row_number`` within each group, without sorting a group in one task.

    ``order`` must be a total order that ``bucket`` respects. ``size`` adds the group
    size. ``keep`` drops buckets that start past that rank before rows are moved.
    """
    base = _bucketed(df.withColumn(_GROUP, F.struct(*group)), bucket)
    counts = base.groupBy(_GROUP, _BUCKET).agg(F.count(F.lit(1)).alias(_N))
    offsets = _offsets(counts, [_N], descending=False)
    if keep is not None:
        offsets = offsets.where(F.col(f"{_BEFORE}_{_N}") < keep)
    inside = Window.partitionBy(_GROUP, _BUCKET).orderBy(*order)
    ranked = base.join(offsets, [_GROUP, _BUCKET]).withColumn(
        rank, (F.row_number().over(inside) + F.col(f"{_BEFORE}_{_N}")).cast("long")
    )
    if keep is not None:
        ranked = ranked.where(F.col(rank) <= keep)
    if size is not None:
        ranked = ranked.withColumn(size, F.col(f"{_SIZE}_{_N}"))
    return ranked.drop(_GROUP, _BUCKET, f"{_BEFORE}_{_N}", f"{_SIZE}_{_N}")


def running_sums(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    sums: dict[str, Column],
    bucket: Bucket,
    descending: bool = False,
) -> DataFrame:
    """One row per (group, value) with its sums, sums before it, and group totals.

    Adds ``<name>``, ``<name>_before`` and ``<name>_total`` for each entry. Equal
    values are merged first, so ties and repeated values never pile up.
    """
    names = list(sums)
    merged = df.groupBy(F.struct(*group).alias(_GROUP), value).agg(*[c.alias(n) for n, c in sums.items()])
    merged = _bucketed(merged, bucket)
    counts = merged.groupBy(_GROUP, _BUCKET).agg(*[F.sum(n).alias(n) for n in names])
    offsets = _offsets(counts, names, descending)
    order = F.col(value).desc() if descending else F.col(value).asc()
    earlier = (
        Window.partitionBy(_GROUP, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = merged.join(offsets, [_GROUP, _BUCKET])
    return joined.select(
        *[F.col(f"{_GROUP}.{g}").alias(g) for g in group],
        value,
        *names,
        *[
            (F.coalesce(F.sum(n).over(earlier), F.lit(0)) + F.col(f"{_BEFORE}_{n}")).alias(f"{n}_before")
            for n in names
        ],
        *[F.col(f"{_SIZE}_{n}").alias(f"{n}_total") for n in names],
    )


def exact_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    points: dict[str, float],
    bucket: Bucket | None = None,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, one row per group."""
    for p in points.values():
        if not 0.0 <= p <= 1.0:
            raise ValueError("percentile points must lie in [0, 1]")
    chosen = bucket if bucket is not None else Balanced(F.col(value))
    runs = running_sums(
        df.where(F.col(value).isNotNull()), group, value, {_N: F.count(F.lit(1))}, chosen
    )
    first, last = F.col(f"{_N}_before"), F.col(f"{_N}_before") + F.col(_N) - 1
    aggregates = []
    for name, p in points.items():
        spot = F.lit(float(p)) * (F.col(f"{_N}_total") - 1)
        for side, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (first <= index) & (index <= last)
            aggregates.append(F.max(F.when(hit, F.col(value))).alias(f"__{side}_{name}"))
        aggregates.append(F.max(spot - F.floor(spot)).alias(f"__w_{name}"))
    table = runs.groupBy(*group).agg(*aggregates)
    return table.select(
        *group,
        *[
            (
                F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__w_{n}")
            ).cast("double").alias(n)
            for n in points
        ],
    )
