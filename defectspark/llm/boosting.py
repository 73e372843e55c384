"""Gradient boosted trees and isotonic calibration fitted by DataFrame aggregation.

Training rows are first counted per combination of feature bins. Every tree level is one
aggregation to (leaf, feature, bin) sums, of which at most ``leaves * features * bins`` rows
reach the driver. A fitted model is a plain column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.common import store

Read = Callable[[str], Column]


@dataclass
class Boosted:
    """Margin = ``base`` + the values of the leaves that a row reaches; a left branch means ``x <= cut``."""

    base: float = 0.0
    trees: list[dict] = field(default_factory=list)

    def margin(self, read: Read = F.col) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _reach(tree, lambda leaf: F.lit(leaf["value"]), lambda n: read(n["feature"]) <= F.lit(n["cut"]))
        return total


def _reach(node: dict, leaf: Callable[[dict], Column], left: Callable[[dict], Column]) -> Column:
    if "feature" not in node:
        return leaf(node)
    return F.when(left(node), _reach(node["left"], leaf, left)).otherwise(_reach(node["right"], leaf, left))


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int, more: Sequence[float] = ()) -> dict[str, list[float]]:
    """Up to ``bins - 1`` cut points per feature from approximate quantiles over all rows, and at the ``more`` shares."""
    shares = [*(i / bins for i in range(1, bins)), *more]
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 2000).alias(f) for f in features]).first()
    return {f: sorted(set(row[f] or [])) for f in features}


def bin_index(value: Column, cuts: Sequence[float]) -> Column:
    """How many cuts lie below the value."""
    index = F.lit(0)
    for cut in cuts:
        index = index + (value > F.lit(float(cut))).cast("int")
    return index


def _best(sums: dict, features: Sequence[str], cuts: dict, l2: float, least: float) -> dict | None:
    """The split of one leaf with the largest gain; the first feature and lowest cut win ties."""
    best, gain = None, 1e-6
    for i, name in enumerate(features):
        bins = [sums.get((i, b), (0.0, 0.0)) for b in range(len(cuts[name]) + 1)]
        g, h = sum(x[0] for x in bins), sum(x[1] for x in bins)
        left_g = left_h = 0.0
        for b in range(len(bins) - 1):
            left_g, left_h = left_g + bins[b][0], left_h + bins[b][1]
            right_g, right_h = g - left_g, h - left_h
            if left_h < least or right_h < least:
                continue
            now = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - g**2 / (h + l2)
            if now > gain + 1e-9:
                gain, best = now, {"feature": name, "bin": b, "cut": float(cuts[name][b]),
                                   "left": {"value": left_g / (left_h + l2)}, "right": {"value": right_g / (right_h + l2)}}
    return best


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 12, depth: int = 3,
                bins: int = 16, rate: float = 0.5, l2: float = 1.0, least: float = 1.0) -> Boosted:
    """Fit logistic boosted trees on all rows of ``df`` (features: no nulls; label: 0 or 1).

    Without rows the model is even odds; with one class only it is that class's smoothed odds.
    """
    cuts = quantile_cuts(df, features, bins, (0.9, 0.92, 0.94, 0.96, 0.98))  # features that are mostly 0 differ in the tail
    binned = df.select(*[bin_index(F.col(f).cast("double"), cuts[f]).alias(f) for f in features], F.col(label).alias("__y"))
    table = store(binned.groupBy(*features).agg(F.count("*").alias("__n"), F.sum("__y").cast("double").alias("__pos")), "boosting")
    totals = table.agg(F.sum("__n"), F.sum("__pos")).first()
    n, pos = float(totals[0] or 0), float(totals[1] or 0)
    model = Boosted(math.log((pos + 0.5) / (n - pos + 0.5)))
    if pos == 0 or pos == n:
        return model
    by_bin = lambda node: F.col(node["feature"]) <= F.lit(node["bin"])
    margin = F.lit(model.base)
    for _ in range(rounds):
        tree: dict = {"value": 0.0, "id": 0}
        for _ in range(depth):
            leaf_id = _reach(tree, lambda x: F.lit(x.get("id", -1)), by_bin)
            p = 1 / (1 + F.exp(-F.col("__m")))
            sums = (
                table.withColumn("__m", margin).withColumn("__leaf", leaf_id).where("__leaf >= 0")
                .select("__leaf", (F.col("__pos") - F.col("__n") * p).alias("__g"), (F.col("__n") * p * (1 - p)).alias("__h"),
                        F.posexplode(F.array(*features)).alias("__f", "__b"))
                .groupBy("__leaf", "__f", "__b").agg(F.sum("__g"), F.sum("__h")).collect()
            )
            by_leaf: dict[int, dict] = {}
            for r in sums:
                by_leaf.setdefault(r[0], {})[(r[1], r[2])] = (r[3], r[4])
            grown, fresh = 0, 0
            for leaf in _leaves(tree):
                found = _best(by_leaf.get(leaf.pop("id", -1), {}), features, cuts, l2, least)
                if found:
                    grown += 1
                    for side in ("left", "right"):
                        found[side]["id"] = fresh
                        fresh += 1
                    leaf.pop("value")
                    leaf.update(found)
            if not grown:
                break
        if "feature" not in tree:
            break
        for leaf in _leaves(tree):
            leaf.pop("id", None)
            leaf["value"] = rate * leaf["value"]
        model.trees.append(tree)
        margin = margin + _reach(tree, lambda x: F.lit(x["value"]), by_bin)
    return model


def _leaves(node: dict) -> list[dict]:
    return [node] if "feature" not in node else _leaves(node["left"]) + _leaves(node["right"])


def fit_isotonic(df: DataFrame, margin: Column, label: str, step: float = 0.1, reach: float = 12.0) -> list[tuple[float, float]]:
    """Pooled adjacent violators over margin cells of width ``step``: (margin, probability), both ascending.

    At most ``2 * reach / step + 1`` counts reach the driver.
    """
    cell = F.round(F.least(F.greatest(margin, F.lit(-reach)), F.lit(reach)) / step).cast("int")
    rows = df.groupBy(cell.alias("__cell")).agg(F.count("*"), F.sum(label)).orderBy("__cell").collect()
    blocks: list[list[float]] = []
    for c, n, pos in rows:
        blocks.append([c * step * n, float(n), float(pos)])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [(at / n, (pos + 0.01) / (n + 0.02)) for at, n, pos in blocks]


def calibrated(points: Sequence[tuple[float, float]], margin: Column) -> Column:
    """Probability of a margin: linear between the fitted points, level beyond them; 0.5 without points."""
    if not points:
        return F.lit(0.5)
    value = F.lit(points[-1][1])
    for (a, p), (b, q) in reversed(list(zip(points, points[1:], strict=False))):
        line = F.lit(p) + (margin - F.lit(a)) * F.lit((q - p) / max(b - a, 1e-9))
        value = F.when(margin < F.lit(b), line).otherwise(value)
    return F.when(margin <= F.lit(points[0][0]), F.lit(points[0][1])).otherwise(value)
