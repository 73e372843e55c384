"""Greedy k-centre selection without holding a group in one task.

The state table has every vector with its squared distance to the nearest centre. Groups are dealt out in
hash blocks; in a round every block proposes its few farthest rows. What greedy would pick next is read
off a group's proposals alone, for as long as no row that was not proposed can come first. So one
round gives many picks, and the picks are those of plain greedy. Their vectors, few by a bound in bytes,
are then broadcast and taken into the state table, which is stored anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectspark.operators.ranking import join_groups
from defectspark.session import stored

BLOCK_ROWS = 65_536
PROPOSED_BYTES = 32 << 20
ROUND_BYTES = 32 << 20


def _squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = x - centre
    return (d * d).sum(1)


def next_picks(keys: list, x: np.ndarray, away: np.ndarray, wanted: int, limits: list[tuple]) -> list[int]:
    """Rows that greedy picks next among proposals, farthest first and ties to the smaller key.

    ``limits`` has the distance and key of the last proposal of every block that may hold more rows:
    the picking ends where such a row could come first.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, x, away = [keys[i] for i in order], x[order], away[order].copy()
    picks: list[int] = []
    while len(picks) < wanted:
        best = int(away.argmax())
        if away[best] < 0 or (picks and any((-d, k) < (-away[best], keys[best]) for d, k in limits)):
            break
        picks.append(best)
        away = np.minimum(away, _squares(x, x[best]))
        away[best] = -1.0
    return [order[i] for i in picks]


def _take_in(names: list[str], centres: dict[tuple, tuple[list, np.ndarray]]) -> Callable:
    """Updates distances by the new centres of a row's group; a row that became a centre is marked by -1."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) == 0:
                continue
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(*[batch.column(n).to_pylist() for n in names])):
                groups.setdefault(g, []).append(i)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            away = batch.column("away").to_numpy(zero_copy_only=False).copy()
            keys = batch.column("k").to_pylist()
            for g, rows in groups.items():
                if g not in centres:
                    continue
                taken, vectors = centres[g]
                mine, near = x[rows], away[rows]
                for c in vectors:
                    near = np.minimum(near, _squares(mine, c))
                known = set(taken)
                near[[keys[i] in known for i in rows]] = -1.0
                away[rows] = near
            spot = batch.schema.get_field_index("away")
            yield batch.set_column(spot, "away", pa.array(away))

    return work


def coreset(df: DataFrame, group: Sequence[str], key: str, vector: str, ratio: float = 0.01) -> DataFrame:
    """Keys that cover each group: ``ceil(ratio * rows)`` greedy picks from its smallest key on, as ``group``, ``key`` and ``pick`` from 0.

    Equal to plain greedy on the whole group. Keys must be unique in a group and vectors of one
    length; rows with a null key or vector take no part.
    """
    if not 0 < ratio <= 1:
        raise ValueError("ratio must lie in (0, 1]")
    names = list(group)
    rows = df.select(*names, F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).where("k IS NOT NULL AND x IS NOT NULL")
    sizes = rows.groupBy(*names).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"))
    sizes = stored(sizes, "coreset-sizes")
    width = sizes.agg(F.max("width")).first()[0] or 1
    offers, round_rows = max(PROPOSED_BYTES // (8 * width), 1), max(ROUND_BYTES // (8 * width), 1)
    blocks = F.ceil(F.col("n") / F.lit(float(BLOCK_ROWS)))
    # All blocks of a group together propose a bounded number of rows, each block one at least.
    shape = sizes.select(*names, blocks.alias("blocks"), F.greatest(F.floor(F.lit(offers) / blocks), F.lit(1)).alias("most"))
    dealt = join_groups(rows, shape, names).withColumn("block", F.pmod(F.xxhash64("k"), "blocks"))
    state = stored(dealt.select(*names, "block", "most", "k", "x", F.lit(float("inf")).alias("away")), "coreset-state")
    wanted = F.greatest(F.ceil(F.col("n") * F.lit(float(ratio))), F.lit(1)).cast("long")
    left = sizes.select(*names, wanted.alias("left"), F.lit(0).cast("long").alias("at"))
    own = [state.schema[n] for n in names]
    pick_type = T.StructType([*own, state.schema["k"], state.schema["x"], T.StructField("pick", T.LongType())])
    farthest = Window.partitionBy(*names, "block").orderBy(F.col("away").desc(), "k")
    found: DataFrame | None = None
    while True:
        # Groups beyond the bound of a round wait for a later one.
        active = stored(left.where("left > 0").orderBy(*names).limit(round_rows), "coreset-open")
        count = active.count()
        if count == 0:
            break
        share = round_rows // count
        offered = state.withColumn("no", F.row_number().over(farthest)).where("no <= most AND away >= 0")

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            last = pdf[pdf["no"] == pdf["most"]]
            limits = list(zip(last["away"].tolist(), last["k"].tolist()))
            x = np.stack(pdf["x"].to_list())
            goal = min(int(pdf["left"].iloc[0]), share)
            at = next_picks(pdf["k"].tolist(), x, pdf["away"].to_numpy(float), goal, limits)
            out = pdf.iloc[at][[*names, "k", "x"]].copy()
            out["pick"] = int(pdf["at"].iloc[0]) + np.arange(len(at))
            return out

        chosen = stored(join_groups(offered, active, names).groupBy(*names).applyInPandas(choose, pick_type), "coreset-picks")
        found = chosen.drop("x") if found is None else found.unionByName(chosen.drop("x"))
        centres: dict[tuple, tuple[list, list]] = {}
        for row in chosen.collect():
            taken = centres.setdefault(tuple(row[n] for n in names), ([], []))
            taken[0].append(row["k"])
            taken[1].append(row["x"])
        new = {g: (keys, np.array(x)) for g, (keys, x) in centres.items()}
        state = stored(state.mapInArrow(_take_in(names, new), state.schema), "coreset-state")
        moved = chosen.groupBy(*names).agg(F.count("*").alias("moved"))
        fresh = join_groups(active, moved, names).select(*names, (F.col("left") - F.col("moved")).alias("left"), (F.col("at") + F.col("moved")).alias("at"))
        done = F.struct(*names)
        rest = left.withColumn("__g", done).join(active.select(done.alias("__g")), "__g", "left_anti").drop("__g")
        left = stored(rest.unionByName(fresh), "coreset-left")
    empty = df.sparkSession.createDataFrame([], T.StructType([f for f in pick_type if f.name != "x"]))
    return (empty if found is None else found).withColumnRenamed("k", key)
