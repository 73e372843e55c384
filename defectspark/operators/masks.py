"""Run-length masks: one row per image with an array of runs, or one row per run.

A *mask row* is ``(image_id, height, width, runs array<struct<y,x0,x1>>)``; all
row-wise operators below work on it without a shuffle. A *run row* is
``(image_id, y, x0, x1)`` with both ends included.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectspark.functions.geometry import (
    crop_window, feasible_rectangle_heights, region_name, relocated_start, severity_level,
)
from defectspark.operators.components import largest_component
from defectspark.operators.fill import union_of


def _run(y: Column, x0: Column, x1: Column) -> Column:
    return F.struct(y.cast("int").alias("y"), x0.cast("int").alias("x0"), x1.cast("int").alias("x1"))


def _whole(low: Column, high: Column) -> Column:
    """``sequence`` that is empty, not descending, when ``high < low``."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


# --- forms -----------------------------------------------------------------------


def masks_from_arrays(
    df: DataFrame, values: str, height: int, width: int, is_on: Callable[[Column], Column]
) -> DataFrame:
    """Mask rows from a row-major pixel array column (replaces it by ``runs``)."""
    flags = F.transform(F.col(values), is_on)
    wide = df.withColumn("__on", flags)

    def edge(step: int, border: int) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.lit(height * width - 1)),
            lambda i: F.get("__on", i)
            & ((i % width == border) | ~F.coalesce(F.get("__on", i + step), F.lit(False))),
        )

    pairs = F.arrays_zip(edge(-1, 0).alias("s"), edge(1, width - 1).alias("e"))
    runs = F.transform(
        pairs, lambda p: _run(F.floor(p["s"] / width), p["s"] % width, p["e"] % width)
    )
    return (
        wide.withColumn("runs", runs)
        .withColumn("height", F.lit(height))
        .withColumn("width", F.lit(width))
        .drop("__on", values)
    )


def explode_runs(masks: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return masks.select(*keys, F.inline("runs"))


def collect_masks(runs: DataFrame, images: DataFrame) -> DataFrame:
    """Mask rows from run rows; images without runs keep an empty array.

    The per-image list is bounded by the raster: at most ``height * width / 2`` runs.
    """
    lists = runs.groupBy("image_id").agg(
        F.array_sort(F.collect_list(_run(F.col("y"), F.col("x0"), F.col("x1")))).alias("runs")
    )
    empty = F.array().cast("array<struct<y:int,x0:int,x1:int>>")
    return images.join(lists, "image_id", "left").withColumn("runs", F.coalesce("runs", empty))


def merge_runs(runs: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Union of overlapping or adjacent runs per (image, row): gaps and islands.

    Keyed by line, so even a single huge image is spread over its lines. Runs that start at one
    column are merged first, in each task before they move: a window never holds more rows than the
    image is wide, however many shapes overlap.
    """
    line = [*keys, "y"]
    starts = runs.groupBy(*line, "x0").agg(F.max("x1").alias("x1"))
    by_start = Window.partitionBy(*line).orderBy("x0")
    reach = F.max("x1").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    end = F.max("x1").over(by_start.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    opened = starts.select(*line, "x0", reach.alias("__reach"), end.alias("__end"))
    opened = opened.where(F.col("__reach").isNull() | (F.col("x0") > F.col("__reach") + 1))
    # What an island's start has behind it is where the island before it ended.
    return opened.select(
        *line, "x0", F.coalesce(F.lead("__reach").over(by_start), "__end").alias("x1")
    )


# --- measures --------------------------------------------------------------------


def compute_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Adds columns that are computed once per row, however often they are used later.

    The optimizer copies expressions into filters and later projections; it does not copy
    them across a generator, here a one-element ``inline``.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def with_extent(masks: DataFrame) -> DataFrame:
    """Adds area, bounding extent and pixel means; extents are null for an empty mask."""
    none, zero = F.lit(None).cast("int"), F.lit(0).cast("long")
    start = F.struct(
        zero.alias("area"), none.alias("x_min"), none.alias("y_min"), none.alias("x_max"), none.alias("y_max"),
        zero.alias("twice_x"), zero.alias("sum_y"),
    )

    def add(acc: Column, r: Column) -> Column:
        length = (r["x1"] - r["x0"] + 1).cast("long")
        return F.struct(
            (acc["area"] + length).alias("area"),
            F.least(acc["x_min"], r["x0"]).alias("x_min"),
            F.least(acc["y_min"], r["y"]).alias("y_min"),
            F.greatest(acc["x_max"], r["x1"]).alias("x_max"),
            F.greatest(acc["y_max"], r["y"]).alias("y_max"),
            (acc["twice_x"] + (r["x0"] + r["x1"]) * length).alias("twice_x"),
            (acc["sum_y"] + r["y"] * length).alias("sum_y"),
        )

    summed = compute_once(masks, F.aggregate("runs", start, add).alias("__e"))
    area = F.nullif("__e.area", zero)
    measured = ["area", "x_min", "y_min", "x_max", "y_max"]
    return summed.select(
        *[c for c in masks.columns if c not in [*measured, "mean_x", "mean_y"]],
        *[F.col(f"__e.{c}").alias(c) for c in measured],
        (F.col("__e.twice_x") / 2.0 / area).alias("mean_x"),
        (F.col("__e.sum_y") / area).alias("mean_y"),
    )


def ground_masks(
    masks: DataFrame,
    defect_type: str = "defect_type",
    cutoffs: tuple[float, float] = (1.0, 5.0),
    overrides: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """Grounded facts per image: presence, box, largest-part centroid, area, region, severity.

    The box spans all parts; the centroid belongs to the largest 8-connected part. An
    empty mask gives null geometry, zero area and level ``none``.
    """
    wide = with_extent(masks).withColumn("__part", largest_component(F.col("runs")))
    share = 100.0 * F.col("area") / (F.col("height").cast("long") * F.col("width"))
    wide = wide.withColumn("area_pct", F.least(F.greatest(share, F.lit(0.0)), F.lit(100.0)))
    present = F.col("area") > 0
    box = F.array(
        "x_min", "y_min", F.col("x_max") - F.col("x_min") + 1, F.col("y_max") - F.col("y_min") + 1
    )
    keep = [c for c in masks.columns if c != "runs"]
    return wide.select(
        *keep,
        present.alias("defect_present"),
        F.when(present, box).alias("bounding_box"),
        F.when(present, F.array("__part.cx", "__part.cy")).alias("centroid"),
        F.col("area_pct"),
        F.when(
            present,
            region_name(F.col("__part.cx"), F.col("__part.cy"), F.col("width"), F.col("height")),
        ).alias("region"),
        severity_level(F.col("area_pct"), F.col(defect_type), cutoffs, overrides).alias("severity_level"),
    )


def with_crop(masks: DataFrame, size: int) -> DataFrame:
    """Adds the crop struct: a square at the mean of *all* pixels, or a drop reason."""
    wide = with_extent(masks)
    window = crop_window(
        size, *[F.col(c) for c in ("width", "height", "x_min", "y_min", "x_max", "y_max", "mean_x", "mean_y")]
    )
    return compute_once(wide, window.alias("crop")).select(*masks.columns, "crop")


def crop_eligibility(cropped: DataFrame, group: str) -> DataFrame:
    """Usable and excluded crops per class, by reason."""
    reason = F.col("crop.drop_reason")
    return cropped.groupBy(group).agg(
        F.count(F.lit(1)).alias("total_pairs"),
        F.count_if(reason.isNull()).alias("usable_pairs"),
        F.count_if(reason == "unfittable_square").alias("excluded_unfittable_square"),
        F.count_if(reason == "empty_mask").alias("excluded_empty_mask"),
        F.count_if(reason == "frame_too_small").alias("excluded_frame_too_small"),
        F.count_if(reason.isNotNull()).alias("crop_exclusion_count"),
    )


# --- row-wise transforms -----------------------------------------------------------


def shift_runs(runs: Column, dx: Column, dy: Column) -> Column:
    return F.transform(runs, lambda r: _run(r["y"] + dy, r["x0"] + dx, r["x1"] + dx))


def clip_runs(runs: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Runs inside a window, still in frame coordinates."""
    cut = F.transform(
        runs, lambda r: _run(r["y"], F.greatest(r["x0"], x), F.least(r["x1"], x + w - 1))
    )
    return F.filter(cut, lambda r: (r["x0"] <= r["x1"]) & (r["y"] >= y) & (r["y"] < y + h))


def resize_runs(runs: Column, w: Column, h: Column, new_w: Column, new_h: Column) -> Column:
    """Nearest-neighbour resize; target pixel ``i`` reads source ``floor((i + 0.5) * s)``."""

    def first(position: Column, source: Column, target: Column) -> Column:
        doubled = position.cast("long") * 2 * target - source
        return F.ceil(doubled / (source.cast("long") * 2)).cast("long")

    def stretched(r: Column) -> Column:
        x0 = first(r["x0"], w, new_w)
        x1 = first(r["x1"] + 1, w, new_w) - 1
        rows = _whole(first(r["y"], h, new_h), first(r["y"] + 1, h, new_h) - 1)
        return F.filter(
            F.transform(rows, lambda y: _run(y, x0, x1)), lambda out: out["x0"] <= out["x1"]
        )

    return F.flatten(F.transform(runs, stretched))


def crop_masks(cropped: DataFrame, size: int) -> DataFrame:
    """Masks cut to their crop window, resized to ``size`` when the square was larger."""
    crop = F.col("crop")
    kept = cropped.where(crop["drop_reason"].isNull())
    cut = clip_runs(F.col("runs"), crop["crop_x"], crop["crop_y"], crop["crop_w"], crop["crop_h"])
    local = shift_runs(cut, -crop["crop_x"], -crop["crop_y"])
    side = F.lit(size)
    scaled = resize_runs(F.col("__local"), crop["crop_w"], crop["crop_h"], side, side)
    return (
        compute_once(kept, local.alias("__local"))
        .withColumn("runs", F.when(crop["resized"], scaled).otherwise(F.col("__local")))
        .withColumn("height", side)
        .withColumn("width", side)
        .drop("__local")
    )


def place_crop(masks: DataFrame, full_w: Column, full_h: Column, crop: Column) -> DataFrame:
    """A crop-sized mask resized to its window and put on the full frame."""
    scaled = resize_runs(F.col("runs"), F.col("width"), F.col("height"), crop["crop_w"], crop["crop_h"])
    return (
        masks.withColumn("runs", shift_runs(scaled, crop["crop_x"], crop["crop_y"]))
        .withColumn("width", full_w.cast("int"))
        .withColumn("height", full_h.cast("int"))
    )


def relocate_crop(df: DataFrame, crop: Column, src_w: Column, src_h: Column, dst_w: Column, dst_h: Column) -> DataFrame:
    """Crop origin on a clean frame of another size, plus whether the window fits at all."""
    return df.withColumns(
        {
            "target_x": relocated_start(crop["crop_x"], crop["crop_w"], src_w, dst_w),
            "target_y": relocated_start(crop["crop_y"], crop["crop_h"], src_h, dst_h),
            "fits": (crop["crop_w"] <= dst_w) & (crop["crop_h"] <= dst_h),
        }
    )


def transplant_masks(
    masks: DataFrame, target_w: Column, target_h: Column, x: Column | None = None, y: Column | None = None
) -> DataFrame:
    """Move each tight mask so its box starts at ``(x, y)``; its own corner by default.

    Adds ``violation``: ``empty``, ``negative``, ``out_of_bounds`` or null; a violating
    row keeps no runs.
    """
    wide = with_extent(masks)
    to_x = F.col("x_min") if x is None else x
    to_y = F.col("y_min") if y is None else y
    box_w = F.col("x_max") - F.col("x_min") + 1
    box_h = F.col("y_max") - F.col("y_min") + 1
    violation = (
        F.when(F.col("area") == 0, "empty")
        .when((to_x < 0) | (to_y < 0), "negative")
        .when((to_x + box_w > target_w) | (to_y + box_h > target_h), "out_of_bounds")
    )
    moved = shift_runs(F.col("runs"), to_x - F.col("x_min"), to_y - F.col("y_min"))
    empty = F.array().cast("array<struct<y:int,x0:int,x1:int>>")
    keep = [c for c in masks.columns if c not in ("runs", "width", "height")]
    return wide.withColumn("violation", violation).select(
        *keep,
        target_h.cast("int").alias("height"),
        target_w.cast("int").alias("width"),
        F.when(F.col("violation").isNull(), moved).otherwise(empty).alias("runs"),
        "violation",
    )


def dilate_masks(masks: DataFrame, radius: int, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Run rows of each mask grown by a square of ``radius``, clipped to the frame and united in the mask's own row."""
    if radius < 0:
        raise ValueError("dilation radius must not be negative")
    grown = F.flatten(
        F.transform(
            "runs",
            lambda r: F.transform(
                F.sequence(
                    F.greatest(r["y"] - radius, F.lit(0)), F.least(r["y"] + radius, F.col("height") - 1)
                ),
                lambda y: _run(
                    y,
                    F.greatest(r["x0"] - radius, F.lit(0)),
                    F.least(r["x1"] + radius, F.col("width") - 1),
                ),
            ),
        )
    )
    # Behind a boundary: Spark does not run a Python function on nested lambdas in place.
    rows = compute_once(masks, F.array(grown).alias("__grown"))
    return rows.select(*keys, union_of(F.col("__grown")).alias("__runs")).select(*keys, F.inline("__runs"))


def pool_masks(masks: DataFrame, grid_w: int, grid_h: int) -> DataFrame:
    """Adds ``cells``: grid cells that any mask pixel touches (small defects survive)."""

    def span(low: Column, high: Column, cells: int, frame: Column) -> Column:
        first = F.floor(low.cast("long") * cells / frame)
        last = F.ceil((high + 1).cast("long") * cells / frame) - 1
        return F.sequence(first, F.least(last, F.lit(cells - 1).cast("long")))

    cells = F.flatten(
        F.transform(
            "runs",
            lambda r: F.flatten(
                F.transform(
                    span(r["y"], r["y"], grid_h, F.col("height")),
                    lambda gy: F.transform(
                        span(r["x0"], r["x1"], grid_w, F.col("width")),
                        lambda gx: F.struct(gy.cast("int").alias("gy"), gx.cast("int").alias("gx")),
                    ),
                )
            ),
        )
    )
    return masks.withColumn("cells", F.array_distinct(cells))


def object_rectangles(
    masks: DataFrame, key: str = "image_id", seed: int = 42, min_scale: float = 1.2, max_scale: float = 4.0
) -> DataFrame:
    """A seeded rectangle that holds the defect, its area within bounds of the box area.

    ``outcome`` is ``ok``, ``fallback`` (the frame cannot hold the minimum area),
    ``infeasible`` (area bounds admit no integer rectangle) or ``empty``.
    """
    wide = with_extent(masks)
    box_w = F.col("x_max") - F.col("x_min") + 1
    box_h = F.col("y_max") - F.col("y_min") + 1
    wide = wide.withColumns({"__bw": box_w.cast("long"), "__bh": box_h.cast("long")})
    options = feasible_rectangle_heights(
        F.col("__bw"), F.col("__bh"), F.col("width"), F.col("height"), min_scale, max_scale
    )
    wide = compute_once(wide, F.when(F.col("area") > 0, options).alias("__options"))

    def pick(label: str, low: Column, high: Column) -> Column:
        text = F.sha2(F.concat_ws("|", F.lit(f"{seed}|{label}"), F.col(key).cast("string")), 256)
        draw = F.conv(F.substring(text, 1, 12), 16, 10).cast("long")
        return low + draw % (high - low + 1)

    count = F.size("__options")
    wide = wide.withColumn(
        "__choice",
        F.when(
            count > 0,
            F.element_at("__options", pick("width", F.lit(1).cast("long"), count.cast("long")).cast("int")),
        ),
    )
    wide = wide.withColumn("rect_w", F.col("__choice.w")).withColumn(
        "rect_h", pick("height", F.col("__choice.h_min"), F.col("__choice.h_max"))
    )

    def origin(label: str, low: Column, high: Column, side: Column, frame: Column) -> Column:
        first = F.greatest(F.lit(0).cast("long"), (high + 1 - side).cast("long"))
        last = F.least(low.cast("long"), (frame - side).cast("long"))
        return pick(label, first, last)

    feasible = F.col("width").cast("long") * F.col("height") / (F.col("__bw") * F.col("__bh"))
    outcome = (
        F.when(F.col("area") == 0, "empty")
        .when(count > 0, "ok")
        .when(feasible < min_scale, "fallback")
        .otherwise("infeasible")
    )
    return wide.select(
        *[c for c in masks.columns if c != "area"],
        F.col("area"),
        F.col("__bw").alias("box_w"),
        F.col("__bh").alias("box_h"),
        count.alias("n_widths"),
        outcome.alias("outcome"),
        F.when(
            count > 0, origin("x", F.col("x_min"), F.col("x_max"), F.col("rect_w"), F.col("width"))
        ).alias("rect_x"),
        F.when(
            count > 0, origin("y", F.col("y_min"), F.col("y_max"), F.col("rect_h"), F.col("height"))
        ).alias("rect_y"),
        "rect_w",
        "rect_h",
    )


# --- pixels under a mask -------------------------------------------------------------


def scanlines(df: DataFrame, keys: Sequence[str], height: int, width: int, **pixels: str) -> DataFrame:
    """One row per image line: ``pixels`` names output columns for row-major array columns."""
    lines = F.transform(
        F.sequence(F.lit(0), F.lit(height - 1)),
        lambda y: F.struct(
            y.alias("y"),
            *[F.slice(F.col(src), y * width + 1, F.lit(width)).alias(out) for out, src in pixels.items()],
        ),
    )
    return df.select(*keys, F.inline(lines))


def composite_lines(
    lines: DataFrame, runs: DataFrame, inside: str, outside: str, out: str = "pixels",
    keys: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Scanlines that take ``inside`` under the mask and ``outside`` elsewhere, both of the line's length.

    Adds the result and ``spans``, the disjoint mask runs of the line in order (at most half its
    width). A line is put together from slices, so its cost is linear in the width.
    """
    line = [*keys, "y"]
    before = Window.partitionBy(*line).orderBy("x0", "x1").rowsBetween(Window.unboundedPreceding, -1)
    first = F.greatest(F.col("x0"), F.max("x1").over(before) + 1, F.lit(0))
    apart = runs.withColumn("x0", first).where("x0 <= x1")
    spans = apart.groupBy(*line).agg(F.array_sort(F.collect_list(F.struct("x0", "x1"))).alias("spans"))
    joined = lines.join(spans, line, "left")
    return joined.withColumn(out, _laid(F.col(inside), F.col(outside)))


def _laid(inside: Column, outside: Column) -> Column:
    """``inside`` over the ordered disjoint ``spans``, ``outside`` between them, slice by slice."""
    spans = F.coalesce(F.col("spans"), F.array().cast("array<struct<x0:int,x1:int>>"))
    after = lambda i: F.coalesce(F.get(spans, i - 1)["x1"] + 1, F.lit(0))
    cut = lambda pixels, start, end: F.slice(pixels, start + 1, F.greatest(end - start, F.lit(0)))
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(cut(outside, after(i), s["x0"]), cut(inside, s["x0"], s["x1"] + 1)),
    )
    return F.concat(F.flatten(pieces), cut(outside, after(F.size(spans)), F.size(outside)))


def composite_violations(lines: DataFrame, result: str, clean: str, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Images with pixels outside the mask where ``result`` differs from ``clean``."""
    wrong = F.filter(
        F.zip_with(result, _laid(F.col(result), F.col(clean)), lambda a, b: ~a.eqNullSafe(b)),
        lambda bad: bad,
    )
    return (
        lines.groupBy(*keys)
        .agg(F.sum(F.size(wrong)).alias("changed_outside"))
        .where("changed_outside > 0")
    )
