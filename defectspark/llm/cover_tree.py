"""Hard negatives by exact inner-product search in cover trees.

Candidates are augmented by one coordinate that gives all of them the norm of the longest, so that a
large inner product with an anchor is a small distance. All rows are cut into cells around centres
(the top level of the tree), cells into blocks of bounded size, and every block becomes one cover
tree: a node's centre is a row, its covering radius shrinks by ``SHRINK`` per level, and all rows
below lie inside it. A distance to a centre and the radius bound every inner product below a node
from both sides. Anchors, in chunks, meet the blocks of the cells whose bounds they can use; a
best-first descent skips nodes outside the wanted window or below what is already found, and checks
the rows of the leaves by exact integer products. Each meeting keeps the first few rows, which are
merged per anchor.

Defined cases: a row takes no part without an id, a label, a vector, or with a component that is null
or not finite. Rows that repeat an id count once: the smallest by label and vector. Shorter vectors
are filled up with zeros. Ties go to the smaller id. An empty table gives no rows. Products are exact
while the squared norms stay below ``2**53``; a table with longer vectors is refused.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectspark.llm.common import store

SHRINK = 1.3
LEAF = 32
SCALE = 256


def clean_rows(df: DataFrame, key: str, label: str | Column, vector: str) -> DataFrame:
    """(``id``, ``label``, ``x``): rows that take part, with components ``floor(256 * x)`` as whole numbers."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    whole = F.transform(vector, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long"))
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.when(finite, whole).alias("x"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    return rows.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x")


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.sqrt(np.maximum(longest - (x * x).sum(1), 0))


def _far_first(x: np.ndarray, wanted: int, radius: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Rows in greedy far-first order until ``wanted``, or until all lie within ``radius`` of one; each row's nearest pick and its distance."""
    picks, nearest = [0], np.zeros(len(x), np.int64)
    away = np.sqrt(((x - x[0]) ** 2).sum(1))
    while len(picks) < wanted and away.max() > radius:
        far = int(away.argmax())
        d = np.sqrt(((x - x[far]) ** 2).sum(1))
        closer = d < away
        nearest[closer], away[closer] = len(picks), d[closer]
        picks.append(far)
    return picks, nearest, away


class CoverTree:
    """Nodes over the rows of one block.

    A node has the rows checked there; some of them are centres of its children, with the child's
    number and covering radius. All rows below a child lie within that radius of its centre, and the
    radius is at most the parent's divided by ``SHRINK``.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, longest: float, nodes: list | None = None) -> None:
        self.ids, self.labels, self.x, self.longest = ids, labels, x.astype(float), longest
        self.nodes: list = nodes or []
        if nodes is None:
            full = np.concatenate([self.x, _augmented(self.x, longest)[:, None]], 1)
            self._build(full, np.arange(len(x)), float(np.sqrt(((full - full[0]) ** 2).sum(1)).max()))

    def parts(self) -> tuple:
        """What ``CoverTree(*parts)`` needs to come back, with whole numbers kept short."""
        small = np.int32 if len(self.x) == 0 or np.abs(self.x).max() < 2**31 else np.int64
        return self.ids, self.labels, self.x.astype(small), self.longest, self.nodes

    def _build(self, full: np.ndarray, rows: np.ndarray, radius: float) -> int:
        at, none = len(self.nodes), np.zeros(0, np.int64)
        self.nodes.append((rows, none, none, np.zeros(0)))
        if len(rows) <= LEAF or radius <= 0:
            return at
        centres, nearest, away = _far_first(full[rows], len(rows), radius / SHRINK)
        below = np.ones(len(rows), bool)
        below[centres] = False
        spots = np.unique(nearest[below])
        parts = [below & (nearest == i) for i in spots]
        radii = [float(away[mine].max()) for mine in parts]
        children = [self._build(full, rows[mine], reach) for mine, reach in zip(parts, radii)]
        self.nodes[at] = (rows[centres], np.array(children, np.int64), spots, np.array(radii))
        return at

    def search(self, q: np.ndarray, wants: list[Want]) -> int:
        """Offers every row that some want can use, best nodes first; returns the number of rows checked."""
        norm = float((q * q).sum())
        slack = 1e-9 * (self.longest + norm) + 1e-6
        heap = [(-np.inf, -np.inf, 0)]
        checked = 0
        while heap:
            most, least, node = heapq.heappop(heap)
            usable = [w for w in wants if w.may(-most, least)]
            if not usable:
                continue
            rows, children, spots, radii = self.nodes[node]
            scores = self.x[rows] @ q
            checked += len(rows)
            for w in usable:
                w.offer(scores, self.ids[rows], self.labels[rows])
            distance = np.sqrt(np.maximum(norm + self.longest - 2 * scores[spots], 0))
            high = (norm + self.longest - np.maximum(distance - radii, 0) ** 2) / 2 + slack
            low = (norm + self.longest - (distance + radii) ** 2) / 2 - slack
            for item in zip((-high).tolist(), low.tolist(), children.tolist()):
                heapq.heappush(heap, item)
        return checked


class Want:
    """The first ``k`` rows by score and id with ``low <= score <= high`` and a label equal, or unequal, to one."""

    def __init__(self, k: int, label: int, same: bool, low: float, high: float, other_than: int) -> None:
        self.k, self.label, self.same, self.low, self.high, self.other_than = k, label, same, low, high, other_than
        self.found: list[tuple[float, int]] = []

    def may(self, most: float, least: float) -> bool:
        return most >= self.low and least <= self.high

    def offer(self, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        fits = (scores >= self.low) & (scores <= self.high) & ((labels == self.label) == self.same) & (ids != self.other_than)
        if not fits.any():
            return
        scores, ids = scores[fits], ids[fits]
        order = np.lexsort((ids, -scores))[:self.k]
        self.found = sorted(self.found + list(zip((-scores[order]).tolist(), ids[order].tolist())))[:self.k]
        if len(self.found) == self.k:
            self.low = max(self.low, -self.found[-1][0])


class Index:
    """The stored cover trees of a table, the centres and radii of their cells, and a few rows at hand."""

    def __init__(self, rows: DataFrame, cells: int = 64, sample: int = 2048, block_rows: int = 8192) -> None:
        """``sample`` bounds the rows that the driver sees: centres are picked from them, every row is indexed."""
        facts = rows.agg(F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v))).first()
        self.width, self.longest = max(facts[0] or 0, 1), float(facts[1] or 0.0)
        if self.longest >= 2.0**53:
            raise ValueError("vectors are too long for exact products; scale them down")
        width, longest = self.width, self.longest
        few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        self.few = (np.array([r.id for r in few], np.int64), np.array([r.label for r in few], np.int64), _matrix([r.x for r in few], width))
        full = np.concatenate([self.few[2], _augmented(self.few[2], longest)[:, None]], 1)
        centres = full[_far_first(full, min(cells, len(full)))[0]] if len(full) else np.zeros((1, width + 1))

        @F.pandas_udf("struct<cell:int,away:double>")
        def cell_of(vectors: pd.Series) -> pd.DataFrame:
            x = _matrix(vectors.to_list(), width)
            x = np.concatenate([x, _augmented(x, longest)[:, None]], 1)
            square = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
            cell = square.argmin(1)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(1))
            return pd.DataFrame({"cell": cell.astype(np.int32), "away": away})

        placed = store(rows.withColumn("c", cell_of("x")).select("id", "label", "x", "c.cell", "c.away"), "cover-cells")
        shape = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"))
        self.cells = [(r.cell, centres[r.cell], r.radius) for r in shape.orderBy("cell").collect()]
        blocks = shape.select("cell", F.ceil(F.col("n") / F.lit(float(block_rows))).alias("blocks"))
        blocked = placed.join(F.broadcast(blocks), "cell").select("id", "label", "x", "cell", F.pmod(F.xxhash64("id"), "blocks").alias("block"))

        def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id")
            tree = CoverTree(pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64), _matrix(pdf["x"].to_list(), width), longest)
            return pd.DataFrame({"cell": [key[0]], "block": [key[1]], "tree": [pickle.dumps(tree.parts())]})

        trees = blocked.groupBy("cell", "block").applyInPandas(build, "cell int, block long, tree binary")
        self.trees = store(trees, "cover-trees")

    def search(self, asks: DataFrame, k: int, same: bool, chunk_rows: int = 4096) -> DataFrame:
        """The first ``k`` rows of every want of every anchor.

        ``asks`` has ``id``, ``label``, ``x`` and ``wants``, an array of (``name``, ``low``, ``high``).
        Returns ``id``, ``name``, ``found_id``, ``score``, ``rank``.
        """
        width, longest, few, cells = self.width, self.longest, self.few, self.cells
        chunks = asks.agg(F.ceil(F.count("*") / F.lit(float(chunk_rows)))).first()[0] or 1

        def wants_of(row) -> tuple[np.ndarray, list[Want]]:
            return _matrix([row.x], width)[0], [Want(k, row.label, same, w["low"], w["high"], row.id) for w in row.wants]

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Cells that some want of the anchor can use, with the lower ends raised by the rows at hand."""
            centres = np.array([c for _, c, _ in cells])
            radii = np.array([r for _, _, r in cells])
            names = np.array([n for n, _, _ in cells])
            for pdf in batches:
                out = []
                for row in pdf.itertuples(index=False):
                    q, wants = wants_of(row)
                    for w in wants:
                        w.offer(few[2] @ q, few[0], few[1])
                    norm = float((q * q).sum())
                    slack = 1e-9 * (longest + norm) + 1e-6
                    away = np.sqrt(((np.append(q, 0.0) - centres) ** 2).sum(1))
                    most = (norm + longest - np.maximum(away - radii, 0) ** 2) / 2 + slack
                    lows = (norm + longest - (away + radii) ** 2) / 2 - slack
                    use = np.zeros(len(names), bool)
                    for w in wants:
                        use |= (most >= w.low) & (lows <= w.high)
                    asked = [{"name": a["name"], "low": w.low, "high": a["high"]} for a, w in zip(row.wants, wants)]
                    out.append((row.id, row.label, row.x, asked, names[use].tolist(), row.chunk))
                yield pd.DataFrame(out, columns=["id", "label", "x", "wants", "cells", "chunk"])

        chunked = asks.select("id", "label", "x", "wants", F.pmod(F.xxhash64("id"), F.lit(chunks)).alias("chunk"))
        wants_type = "array<struct<name:long,low:double,high:double>>"
        routed = store(chunked.mapInPandas(route, f"id long, label long, x array<long>, wants {wants_type}, cells array<int>, chunk long"), "cover-routes")
        visits = routed.select("id", "label", "x", "wants", "chunk", F.explode("cells").alias("cell"))
        needed = visits.select("cell", "chunk").distinct()
        trees = self.trees.join(needed, "cell")
        blocks = self.trees.select("cell", "block")
        visits = visits.join(blocks, "cell")

        def meet(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(held):
                tree = CoverTree(*pickle.loads(held["tree"].iloc[0]))
                for row in asked.itertuples(index=False):
                    q, wants = wants_of(row)
                    tree.search(q, wants)
                    for a, w in zip(row.wants, wants):
                        out += [(row.id, a["name"], found, int(-score)) for score, found in w.found]
            return pd.DataFrame(out, columns=["id", "name", "found_id", "score"])

        keys = ["cell", "block", "chunk"]
        visits = visits.toDF(*[f"v_{c}" if c in keys else c for c in visits.columns])
        found = visits.groupBy(*[f"v_{c}" for c in keys]).cogroup(trees.groupBy(*keys)).applyInPandas(meet, "id long, name long, found_id long, score long")
        found = store(found, "cover-found")
        order = Window.partitionBy("id", "name").orderBy(F.col("score").desc(), "found_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), **index) -> DataFrame:
    """Per anchor and positive, the first rows of another label that score between ``least`` of the positive's score and the score.

    ``rows`` come from ``clean_rows``. ``least`` is a fraction of whole numbers, so bounds are exact.
    Returns ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    rows = store(rows, "cover-rows")
    found = Index(rows, **index)
    anchors = rows.where(is_anchor)
    no_bounds = F.array(F.struct(F.lit(0).cast("long").alias("name"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    same = found.search(anchors.withColumn("wants", no_bounds), positives, True)
    same = store(same.select("id", F.col("found_id").alias("name"), F.col("score").alias("top")), "cover-positives")
    # Scores are whole numbers, so the window's lower end is the next whole number above its fraction.
    low = F.ceil(F.col("top") * F.lit(least[0]) / F.lit(float(least[1])))
    bounds = same.groupBy("id").agg(F.collect_list(F.struct("name", low.cast("double").alias("low"), F.col("top").cast("double").alias("high"))).alias("wants"))
    asked = store(anchors.join(bounds, "id"), "cover-asked")
    other = found.search(asked, negatives, False)
    fits = (least[0] * F.col("positive_score") <= least[1] * F.col("negative_score")) & (F.col("negative_score") <= F.col("positive_score"))
    return (
        other.join(same, ["id", "name"])
        .select(
            F.col("id").alias("anchor_id"), F.col("name").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.col("found_id").alias("negative_id"), F.col("top").alias("positive_score"), F.col("score").alias("negative_score"),
        )
        .where(fits)
    )
