"""Annotation shapes to run rows, computed inside the row that holds the shape.

Vertices are cut to whole pixels first. A polygon covers its even-odd interior with
inclusive ends plus its outline; a two-point shape is a line three pixels wide.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.operators.fill import folded_runs, ring_runs, union_of_packed
from defectspark.operators.masks import compute_once

POINTS_TYPE = "array<struct<x:double,y:double>>"


def points_from_flat(flat: Column) -> Column:
    """Points of ``[x, y, x, y, ...]``; fewer than six numbers give no points."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(flat) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(flat, 2 * i).alias("x"), F.get(flat, 2 * i + 1).alias("y")),
    )
    return F.when(F.size(flat) >= 6, pairs).otherwise(F.array().cast(POINTS_TYPE))


def points_from_nested(nested: Column) -> Column:
    usable = F.filter(nested, lambda p: F.size(p) >= 2)
    return F.transform(usable, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))


def _whole_points(points: Column) -> Column:
    return F.transform(
        points,
        lambda p: F.struct(
            p["x"].cast("long").cast("double").alias("x"), p["y"].cast("long").cast("double").alias("y")
        ),
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def _thick_line(points: Column, half: float = 1.0) -> Column:
    """Corners of the band around a two-point line, three pixels wide by default."""
    a, b = F.get(points, 0), F.get(points, 1)
    corner = lambda p, n, s: F.struct((p["x"] + s * n["x"]).alias("x"), (p["y"] + s * n["y"]).alias("y"))
    step = F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y"))

    def across(d: Column, length: Column) -> Column:
        side = lambda along: F.when(length > 0, F.round(along / length * half)).otherwise(F.lit(0.0))
        return F.struct(side(-d["y"]).alias("x"), side(d["x"]).alias("y"))

    normal = _once(step, lambda d: _once(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"]), lambda length: across(d, length)))
    return _once(normal, lambda n: F.array(corner(a, n, 1), corner(b, n, 1), corner(b, n, -1), corner(a, n, -1)))


def shape_ring(shape_type: Column, points: Column) -> Column:
    """Ring of whole-pixel vertices that covers a shape; null with too few points."""
    return _once(_whole_points(points), lambda whole: _ring_of(shape_type, whole))


def _ring_of(shape_type: Column, whole: Column) -> Column:
    count = F.size(whole)
    a, b = F.get(whole, 0), F.get(whole, 1)
    corner = lambda x, y: F.struct(x(a["x"], b["x"]).alias("x"), y(a["y"], b["y"]).alias("y"))
    box = F.array(
        corner(F.least, F.least), corner(F.greatest, F.least),
        corner(F.greatest, F.greatest), corner(F.least, F.greatest),
    )
    return (
        F.when(shape_type == "rectangle", F.when(count >= 2, box))
        .when(count >= 3, whole)
        .when(shape_type.isin("polygon", "linestrip") & (count == 2), _thick_line(whole))
    )


def _ringed(shapes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shapes with their ring, dealt out by image; a rebalanced exchange also splits an image that has too many."""
    ring = shape_ring(F.col("shape_type"), F.col("points"))
    return compute_once(shapes.hint("rebalance", *[F.col(k) for k in keys]), ring.alias("__ring"))


def shape_rows(shapes: DataFrame, keys: Sequence[str] = ("image_id", "shape_no"), outline: bool = True) -> DataFrame:
    """Every shape with its ``runs`` as an array; a null array for shapes with too few points.

    Needs ``shape_type``, ``points``, ``height`` and ``width``.
    """
    runs = ring_runs(F.col("__ring"), F.col("height"), F.col("width"), outline)
    return _ringed(shapes, keys).where("__ring IS NOT NULL").select(*keys, runs.alias("runs"))


def shape_runs(shapes: DataFrame, keys: Sequence[str] = ("image_id", "shape_no"), outline: bool = True) -> DataFrame:
    """Run rows of each shape; shapes with too few points for their type give none."""
    return shape_rows(shapes, keys, outline).select(*keys, F.inline("runs"))


def shape_bands(shapes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Union of all shapes of an image: ``band`` of lines and its disjoint ``runs`` as an array.

    Shapes meet by image as vertices and are united in the task that fills them. Only what is left of
    them, one packed list per image, band and task, is exchanged by image and band and united again.
    """
    parts = folded_runs(_ringed(shapes, keys), keys, "__ring").groupBy(*keys, "band").agg(F.collect_list("runs").alias("__parts"))
    return parts.select(*keys, "band", union_of_packed(F.col("band"), F.col("__parts")).alias("runs"))


def shape_masks(shapes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Union of all shapes of an image as merged run rows."""
    return shape_bands(shapes, keys).select(*keys, F.inline("runs"))
