"""Exact nearest neighbours in a memory bank: queries stay where they are, the bank passes by in waves.

A few bank rows per group are pivots. Every bank row belongs to its nearest pivot, and the rows of a
pivot are cut into blocks that know how far they reach from it. Blocks are dealt into waves of
bounded bytes. A wave is broadcast; every task runs its queries against it and keeps the ``k``
smallest distances so far. The triangle inequality between query, pivot and block rules out blocks
that cannot hold a nearer row, before their rows are looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.operators.ranking import exact_rank, hash_bucket, hash_order, join_groups
from defectspark.session import stored

PIVOTS = 16
WAVE_BYTES = 48 << 20


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def pivot_blocks(bank: DataFrame, group: Sequence[str], vector: str, pivots: int = PIVOTS, block_rows: int = 2048) -> DataFrame:
    """Bank rows (``group``, ``x``) with ``pivot`` (its vector), ``away`` (the distance to it) and ``block``, unique in the group."""
    names = list(group)
    rows = bank.select(*names, F.col(vector).cast("array<double>").alias("x")).where("x IS NOT NULL")
    ranked = rows.withColumn("__h", hash_order(7, F.xxhash64("x")))
    first = exact_rank(ranked, names, [F.col("__h")], hash_bucket(F.col("__h")), "__r", keep=pivots)
    table = first.groupBy(*names).agg(F.collect_list("x").alias("__pivots"))

    @F.pandas_udf("struct<no:int,away:double>")
    def nearest(x: pd.Series, centres: pd.Series) -> pd.DataFrame:
        out = []
        for v, c in zip(x, centres):
            d = np.sqrt(((np.stack(c) - v) ** 2).sum(1))
            no = int(d.argmin())
            out.append((no, d[no]))
        return pd.DataFrame(out, columns=["no", "away"])

    near = join_groups(rows, table, names).withColumn("__n", nearest("x", "__pivots"))
    placed = stored(near.select(*names, "x", F.get("__pivots", F.col("__n.no")).alias("pivot"), F.col("__n.no").alias("no"), F.col("__n.away").alias("away")), "bank-pivots")
    sizes = placed.groupBy(*names, "no").agg(F.ceil(F.count("*") / F.lit(float(block_rows))).alias("__blocks"))
    cut = join_groups(placed, sizes, [*names, "no"])
    part = F.pmod(F.xxhash64("x", "away"), "__blocks")
    return cut.select(*names, "x", "pivot", "away", F.struct("no", part.alias("part")).alias("block"))


class Bank:
    """One wave: per group its blocks as (pivot, reach, rows)."""

    def __init__(self, rows: list, names: Sequence[str]) -> None:
        parts: dict[tuple, dict[tuple, list]] = {}
        for r in rows:
            parts.setdefault(tuple(r[n] for n in names), {}).setdefault(tuple(r["block"]), []).append(r)
        self.groups = {
            g: [(np.array(b[0]["pivot"]), max(r["away"] for r in b), np.array([r["x"] for r in b])) for b in blocks.values()]
            for g, blocks in parts.items()
        }

    def improve(self, g: tuple, q: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The ``k`` smallest distances of each query, given those so far (infinite where there are none yet)."""
        k = best.shape[1]
        blocks = self.groups.get(g, [])
        to_pivot = [np.sqrt(((q - p) ** 2).sum(1)) for p, _, _ in blocks]
        for i in sorted(range(len(blocks)), key=lambda i: float(np.median(to_pivot[i]))):
            _, reach, x = blocks[i]
            may = np.flatnonzero(to_pivot[i] - reach <= best[:, -1] * (1 + 1e-9) + 1e-9)
            if may.size:
                d = np.sqrt(_squares(q[may], x))
                both = np.concatenate([best[may], np.sort(np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)], axis=1)
                best[may] = np.sort(both, axis=1)[:, :k]
        return best


def _improved(wave: Bank, names: list[str], k: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*[batch.column(n).to_pylist() for n in names])):
                groups.setdefault(g, []).append(i)
            x = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            best = batch.column("__best").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), k).copy()
            for g, rows in groups.items():
                best[rows] = wave.improve(g, x[rows], best[rows])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, k, dtype=np.int32)), pa.array(best.ravel()))
            yield batch.set_column(batch.schema.get_field_index("__best"), "__best", lists)

    return work


def nearest_neighbours(
    queries: DataFrame, bank: DataFrame, group: Sequence[str], key: str, vector: str, k: int = 9, wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """The ``k`` smallest distances from each query to its group's bank: ``group``, ``key``, ``distance``, ``rank_no``.

    A group without a bank gives no rows; one with fewer than ``k`` rows gives as many as it has.
    Rows with a null vector take no part.
    """
    names = list(group)
    placed = stored(pivot_blocks(bank, names, vector), "bank-blocks")
    total, width = placed.agg(F.count("*"), F.max(F.size("x"))).first()
    # A row weighs its vector and its pivot's; waves are filled by hash, so they stay near the bound.
    waves = max(-(-int(total) * 2 * 8 * int(width or 1) // wave_bytes), 1)
    dealt = placed.withColumn("__wave", F.pmod(F.xxhash64(*names, "block"), F.lit(waves)))
    if waves > 1:
        dealt = stored(dealt.repartition("__wave"), "bank-waves")
    start = F.array_repeat(F.lit(float("inf")), k)
    found = queries.select(*names, key, F.col(vector).cast("array<double>").alias("__x"), start.alias("__best")).where("__x IS NOT NULL")
    for wave in range(waves):
        rows = dealt.where(F.col("__wave") == wave).select(*names, "block", "pivot", "away", "x").collect()
        found = found.mapInArrow(_improved(Bank(rows, names), names, k), found.schema)
        if wave + 1 < waves:
            found = stored(found, "neighbours")
    listed = found.select(*names, key, F.posexplode("__best").alias("rank_no", "distance"))
    return listed.where(F.col("distance") < float("inf")).select(*names, key, "distance", (F.col("rank_no") + 1).alias("rank_no"))
