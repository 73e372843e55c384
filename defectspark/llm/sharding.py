"""Hilbert-curve sharding: order documents by several metadata dimensions at once, cut runs.

Each dimension is quantised to ``2**bits`` cells by the running counts of its values, so that a
bit halves the rows also where a dimension has few values. The cells of a row become one index on a
Hilbert curve, rows are ranked exactly by (index, id), and the ranking is cut into runs whose counts
differ by one at most. A run covers a small box of the dimensions, so minimum and maximum
statistics prune on all of them. Only thin rows move; a hot cell is split by the id, which is part
of the sort key.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.boosting import bin_index, quantile_cuts
from defectspark.llm.common import global_rank, store
from defectspark.operators.ranking import running_sums, sampled_bucket


_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _numeric(df: DataFrame, name: str) -> Column | None:
    """A dimension as a number, if its type has one."""
    kind = dict(df.dtypes)[name]
    if kind in _NUMBERS or kind.startswith("decimal"):
        return F.col(name).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(name).cast("timestamp").cast("double")
    return None


def _spread(counts: Sequence[int], bits: int) -> list[int]:
    """A cell for each of the ordered bins: where its middle row stands among all, on ``2**bits`` cells."""
    total, before, out = max(sum(counts), 1), 0, []
    for n in counts:
        out.append(min(int((2 * before + n) * (1 << bits) // (2 * total)), (1 << bits) - 1))
        before += n
    return out


def _number_cells(df: DataFrame, value: Column, bits: int) -> Column:
    """Cells of a number: quantile bins over all rows, spread by their counts over the whole range."""
    named = df.select(value.alias("__v"))
    cuts = quantile_cuts(named, ["__v"], 1 << bits)["__v"]
    found = {r["b"]: r["count"] for r in named.where("__v IS NOT NULL").groupBy(bin_index(F.col("__v"), cuts).alias("b")).count().collect()}
    cells = _spread([found.get(b, 0) for b in range(len(cuts) + 1)], bits)
    return F.get(F.array(*[F.lit(c) for c in cells]), bin_index(value, cuts))


def _text_cells(df: DataFrame, name: str, bits: int) -> Column:
    """Cells of an ordered text: exact running counts of its distinct values; only the first value of each cell reaches the driver."""
    text = df.select(F.col(name).cast("string").alias("v")).where("v IS NOT NULL")
    values = text.groupBy("v").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    runs = running_sums(values, ["g"], "v", {"n": F.sum("n")}, sampled_bucket(values, F.col("v")))
    size = F.lit(1 << bits)
    cell = F.expr("(2 * n_before + n)") * size / (2 * F.col("n_total"))
    firsts = runs.groupBy(F.floor(cell).cast("int").alias("cell")).agg(F.min("v").alias("v")).orderBy("v").collect()
    if not firsts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*[F.lit(r["v"]) for r in firsts]), lambda first: first <= F.col(name).cast("string")))
    return F.get(F.array(*[F.lit(r["cell"]) for r in firsts]), F.greatest(below - 1, F.lit(0)))


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points, one row per point.

    Walks from the highest bit down: the bits of a level select an orthant, its number in
    reflected Gray order is appended, and the remaining bits are turned into that orthant's frame.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            set_here = (x[d] >> level) & 1 == 1
            swap = np.where(set_here, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(set_here, x[0] ^ low, x[0] ^ swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            index = (index << 1) | ((x[d] >> level) & 1)
    return index


def with_curve(df: DataFrame, dims: Sequence[str], bits: int, index: str = "curve") -> DataFrame:
    """Add the curve index of ``dims``. A null dimension takes the lowest cell; without rows nothing is fitted."""

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    cells = []
    for name in dims:
        number = _numeric(df, name)
        cell = _text_cells(df, name, bits) if number is None else _number_cells(df, number, bits)
        cells.append(F.when(F.col(name).isNull(), 0).otherwise(cell).cast("int"))
    return df.withColumn(index, curve(*cells))


def hilbert_shards(df: DataFrame, dims: Sequence[str], ties: Sequence[str], shards: int, bits: int = 5) -> DataFrame:
    """Add ``curve``, ``shard`` and ``slot`` (place in the shard, gapless from 0); counts differ by one at most.

    ``ties`` orders rows of one cell. Rows that agree on all of it are interchangeable and share
    neighbouring slots. Null ids and null dimensions sort first; an empty table stays empty.
    """
    rows = with_curve(store(df, "shard-rows"), dims, bits)
    ranked = global_rank(rows, ["curve", *ties], "__rank", "shard-ranks")
    total = ranked.agg(F.count("*")).first()[0]
    # Shard s starts at floor(s * total / shards); integer division keeps it exact.
    shard = F.expr(f"(((__rank + 1) * {shards}L + {max(total, 1)}L - 1) div {max(total, 1)}L) - 1")
    first = F.expr(f"(shard * {total}L) div {shards}L")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("__rank") - first).drop("__rank")


def write_shards(df: DataFrame, path: str, dims: Sequence[str], ties: Sequence[str], shards: int, bits: int = 5,
                 rows_per_file: int = 1_000_000) -> None:
    """Write whole rows as one folder per shard, sorted along the curve inside each file."""
    placed = hilbert_shards(df, dims, ties, shards, bits)
    (
        placed.withColumn("__part", F.floor(F.col("slot") / rows_per_file))
        .repartition("shard", "__part").sortWithinPartitions("shard", "slot").drop("__part")
        .write.partitionBy("shard").parquet(path)
    )
