"""Per-row geometry: regions, severity, crop windows, token counts."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from defectspark.functions.rounding import clamp, half_even

# 3x3 region names in reading order, severity names.
REGION_NAMES = [
    "upper-left quadrant", "top edge", "upper-right quadrant",
    "left edge", "centre", "right edge",
    "lower-left quadrant", "bottom edge", "lower-right quadrant",
]
SEVERITY_NAMES = ["none", "minor", "moderate", "severe"]


def region_name(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    column = F.least(F.floor(F.lit(3.0) * cx / width), F.lit(2)).cast("int")
    row = F.least(F.floor(F.lit(3.0) * cy / height), F.lit(2)).cast("int")
    names = F.array(*[F.lit(name) for name in REGION_NAMES])
    return F.element_at(names, row * 3 + column + 1)


def check_cutoffs(minor: float, moderate: float) -> None:
    if not 0.0 <= minor <= moderate <= 100.0:
        raise ValueError("severity cutoffs must satisfy 0 <= minor <= moderate <= 100")


def severity_level(
    area_pct: Column,
    defect_type: Column,
    cutoffs: tuple[float, float] = (1.0, 5.0),
    overrides: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> Column:
    """``none`` for an empty mask, else the level of the first cutoff above the area.

    ``overrides`` may replace either cutoff for single defect types.
    """
    check_cutoffs(*cutoffs)
    minor, moderate = F.lit(float(cutoffs[0])), F.lit(float(cutoffs[1]))
    for name, (low, high) in (overrides or {}).items():
        low = cutoffs[0] if low is None else low
        high = cutoffs[1] if high is None else high
        check_cutoffs(low, high)
        minor = F.when(defect_type == name, F.lit(float(low))).otherwise(minor)
        moderate = F.when(defect_type == name, F.lit(float(high))).otherwise(moderate)
    return (
        F.when(area_pct <= 0, "none")
        .when(area_pct < minor, "minor")
        .when(area_pct < moderate, "moderate")
        .otherwise("severe")
    )


def crop_window(
    size: int,
    width: Column,
    height: Column,
    x_min: Column,
    y_min: Column,
    x_max: Column,
    y_max: Column,
    mean_x: Column,
    mean_y: Column,
) -> Column:
    """Crop struct ``(crop_x, crop_y, crop_w, crop_h, resized, drop_reason)``.

    A defect that fits gets a fixed square at its pixel mean; a larger one gets
    the containing square closest to that mean; otherwise a drop reason is set.
    """
    if size <= 0:
        raise ValueError("crop size must be positive")
    box_w, box_h = x_max - x_min + 1, y_max - y_min + 1
    fits = (box_w <= size) & (box_h <= size)
    square = F.when(fits, F.lit(size).cast("long")).otherwise(F.greatest(box_w, box_h).cast("long"))
    reason = (
        F.when(x_min.isNull(), "empty_mask")
        .when(fits & ((width < size) | (height < size)), "frame_too_small")
        .when(~fits & ((square > width) | (square > height)), "unfittable_square")
    )

    def start(mean: Column, low: Column, high: Column, frame: Column) -> Column:
        free_low, free_high = F.lit(0).cast("long"), (frame - square).cast("long")
        box_low = F.greatest(free_low, (high - square + 1).cast("long"))
        box_high = F.least(low.cast("long"), free_high)
        wanted = half_even(mean - square / F.lit(2.0))
        return F.when(fits, clamp(wanted, free_low, free_high)).otherwise(
            clamp(wanted, box_low, box_high)
        )

    keep = reason.isNull()
    return F.struct(
        F.when(keep, start(mean_x, x_min, x_max, width)).alias("crop_x"),
        F.when(keep, start(mean_y, y_min, y_max, height)).alias("crop_y"),
        F.when(keep, square).alias("crop_w"),
        F.when(keep, square).alias("crop_h"),
        F.when(keep, ~fits).alias("resized"),
        reason.alias("drop_reason"),
    )


def relocated_start(
    start: Column, length: Column, source: Column, target: Column
) -> Column:
    """Keep a window's relative centre on a frame of another size, clamped inside."""
    centre = half_even((start + length / F.lit(2.0)) / source * target)
    half = F.floor(length / F.lit(2)).cast("long")
    return F.greatest(
        F.lit(0).cast("long"), F.least(centre - half, (target - length).cast("long"))
    )


def vision_tokens(
    width: Column,
    height: Column,
    patch: int = 14,
    merge: int = 2,
    min_pixels: int = 200704,
    max_pixels: int = 3211264,
) -> Column:
    """Merged patch count of an image after the public pixel-budget resize rule.

    Sides go to the nearest multiple of ``patch * merge`` (ties to even); a frame
    over or under the pixel budget is scaled by the square root of the ratio,
    rounded down or up to a multiple.
    """
    unit = patch * merge
    w, h = width.cast("double"), height.cast("double")
    w0 = F.bround(w / unit, 0) * unit
    h0 = F.bround(h / unit, 0) * unit
    area = w0 * h0
    shrink = F.sqrt(w * h / F.lit(float(max_pixels)))
    grow = F.sqrt(F.lit(float(min_pixels)) / (w * h))

    def side(raw: Column, rounded: Column) -> Column:
        return (
            F.when(
                area > max_pixels,
                F.greatest(F.lit(float(unit)), F.floor(raw / shrink / unit) * unit),
            )
            .when(area < min_pixels, F.ceil(raw * grow / unit) * unit)
            .otherwise(rounded)
        )

    return ((side(h, h0) / unit) * (side(w, w0) / unit)).cast("long")


def feasible_rectangle_heights(
    box_w: Column, box_h: Column, width: Column, height: Column,
    min_scale: float = 1.2, max_scale: float = 4.0,
) -> Column:
    """Array of ``(w, h_min, h_max)`` rectangles that contain the box within area bounds."""
    if not 1.0 <= min_scale <= max_scale or math.isnan(min_scale + max_scale):
        raise ValueError("area scales must satisfy 1 <= min <= max")
    box_area = box_w * box_h
    low = F.ceil(F.lit(float(min_scale)) * box_area)
    high = F.least((width * height).cast("long"), F.floor(F.lit(float(max_scale)) * box_area))
    options = F.transform(
        F.sequence(box_w.cast("long"), width.cast("long")),
        lambda w: F.struct(
            w.alias("w"),
            F.greatest(box_h.cast("long"), F.ceil(low / w)).alias("h_min"),
            F.least(height.cast("long"), F.floor(high / w)).alias("h_max"),
        ),
    )
    return F.filter(options, lambda o: o["h_min"] <= o["h_max"])
