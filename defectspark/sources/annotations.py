"""Annotation documents: per-image layouts and COCO documents, read as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.functions.text import base_name, file_stem, part_name
from defectspark.operators.fill import ring_union
from defectspark.operators.masks import compute_once
from defectspark.operators.polygons import POINTS_TYPE, points_from_flat, points_from_nested, shape_ring
from defectspark.sources.json_elements import read_elements


def read_json_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per JSON file below ``root``: path and text (scan is recursive)."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def parse_documents(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``doc`` (variant, null when malformed) and ``error``."""
    return df.withColumn("doc", F.try_parse_json(text)).withColumn(
        "error", F.when(F.col("doc").isNull(), "malformed JSON")
    )


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def parsed_points(v: Column) -> Column:
    """Nested ``[[x, y], ...]`` or flat ``[x, y, ...]`` variant to points."""
    nested = _get(v, "$", "array<array<double>>")
    flat = _get(v, "$", "array<double>")
    # A list of the other kind reads as a list of nulls, so the first element decides.
    return (
        F.when(F.get(nested, 0).isNotNull(), points_from_nested(nested))
        .when(F.get(flat, 0).isNotNull(), points_from_flat(flat))
        .otherwise(F.array().cast(POINTS_TYPE))
    )


def extract_shapes(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Shapes of every document: ``shape_no, shape_type, label, points``.

    A bare list is one polygon; otherwise the first of ``shapes``, ``objects`` (both
    lists) and ``regions`` (map or list) that is present decides the layout.
    """
    layout, entries = _layout_and_entries()
    rows = docs.select(*keys, layout.alias("layout"), F.posexplode(entries).alias("shape_no", "entry"))
    entry = F.col("entry")
    shape_type, label, points = _shape_of(F.col("layout"), entry)
    return rows.select(
        *keys, "layout", "shape_no", shape_type.alias("shape_type"),
        F.coalesce(label, F.lit("defect")).alias("label"),
        F.coalesce(points, F.array().cast(POINTS_TYPE)).alias("points"),
    )


def document_masks(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Mask rows straight from parsed documents with ``height`` and ``width``.

    All shapes of a document are united in its own row, so nothing is shuffled.
    """
    layout, entries = _layout_and_entries()
    listed = docs.withColumn("__layout", layout).withColumn("__entries", entries)

    def ring(entry: Column) -> Column:
        shape_type, _, points = _shape_of(F.col("__layout"), entry)
        return shape_ring(shape_type, points)

    rings = F.filter(F.transform("__entries", ring), lambda r: r.isNotNull())
    rings = F.coalesce(rings, F.array().cast(f"array<{POINTS_TYPE}>"))
    # Behind a boundary: Spark does not run a Python function on nested lambdas in place.
    ringed = compute_once(listed, rings.alias("__rings"))
    runs = ring_union(F.col("__rings"), F.col("height"), F.col("width"))
    return ringed.select(*keys, "height", "width", runs.alias("runs"))


def _layout_and_entries() -> tuple[Column, Column]:
    doc = F.col("doc")
    bare = _get(doc, "$", "array<variant>")
    shapes = _get(doc, "$.shapes", "array<variant>")
    objects = _get(doc, "$.objects", "array<variant>")
    regions = F.coalesce(
        _get(doc, "$.regions", "array<variant>"),
        F.map_values(_get(doc, "$.regions", "map<string,variant>")),
    )
    layout = (
        F.when(bare.isNotNull(), "list")
        .when(shapes.isNotNull(), "shapes")
        .when(objects.isNotNull(), "objects")
        .when(regions.isNotNull(), "regions")
    )
    entries = F.when(bare.isNotNull(), F.array(doc)).otherwise(F.coalesce(shapes, objects, regions))
    return layout, entries


def _shape_of(layout: Column, entry: Column) -> tuple[Column, Column, Column]:
    """Shape type, label and points of one entry of a layout."""
    text = lambda path: _get(entry, path, "string")
    raw = lambda path: _get(entry, path, "variant")
    region_type = F.coalesce(text("$.shape_attributes.name"), F.lit("polygon"))
    region_points = F.zip_with(
        _get(entry, "$.shape_attributes.all_points_x", "array<double>"),
        _get(entry, "$.shape_attributes.all_points_y", "array<double>"),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    paired = F.filter(region_points, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    is_ = lambda name: layout == name
    shape_type = (
        F.when(is_("list"), "polygon")
        .when(is_("regions"), region_type)
        .otherwise(F.coalesce(text("$.shape_type"), F.lit("polygon")))
    )
    label = (
        F.when(is_("list"), F.lit(None).cast("string"))
        .when(is_("shapes"), text("$.label"))
        .when(is_("objects"), F.coalesce(text("$.label"), text("$.class")))
        .otherwise(text("$.region_attributes.label"))
    )
    points = (
        F.when(is_("list"), parsed_points(entry))
        .when(is_("shapes"), parsed_points(raw("$.points")))
        .when(
            is_("objects"),
            parsed_points(F.coalesce(raw("$.polygon"), raw("$.points"), raw("$.segmentation"))),
        )
        .when(region_type == "polygon", paired)
        .otherwise(parsed_points(raw("$.points")))
    )
    return shape_type, label, points


def document_frame_size(docs: DataFrame, images: DataFrame | None = None, default: int = 256) -> DataFrame:
    """Adds ``height`` and ``width``: first non-zero document key, image size, default.

    ``images`` holds ``stem, image_height, image_width``, and where known ``folder`` and
    ``path``. Images of one stem (and folder, where both sides have it) count as the first by
    path, else the smallest, so no document is repeated. As both
    sides must be known together, a half-given size falls back to the image as well.
    """
    doc = F.col("doc")

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(_get(doc, f"$.{n}", "int"), F.lit(0)) for n in names])

    out = docs.withColumn("__h", first("imageHeight", "height", "image_height")).withColumn(
        "__w", first("imageWidth", "width", "image_width")
    )
    image_h = image_w = F.lit(None).cast("int")
    if images is not None:
        place = [c for c in ("folder", "stem") if c in images.columns and c in docs.columns]
        order = [c for c in ("path", "image_height", "image_width") if c in images.columns]
        size = F.struct("image_height", "image_width")
        sized = images.groupBy(*place).agg(F.min_by(size, F.struct(*order)).alias("__size")).select(*place, "__size.*")
        out = out.join(sized, place, "left")
        image_h, image_w = F.col("image_height"), F.col("image_width")
    known = F.col("__h").isNotNull() & F.col("__w").isNotNull()
    return (
        out.withColumn("height", F.when(known, F.col("__h")).otherwise(F.coalesce(image_h, F.lit(default))))
        .withColumn("width", F.when(known, F.col("__w")).otherwise(F.coalesce(image_w, F.lit(default))))
        .drop("__h", "__w", "image_height", "image_width")
    )


def json_structure(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Top-level audit: kind, keys, image and annotation counts, list length."""
    doc = F.col("doc")
    fields = _get(doc, "$", "map<string,variant>")
    items = _get(doc, "$", "array<variant>")
    return docs.select(
        *keys,
        F.when(fields.isNotNull(), "object").when(items.isNotNull(), "list").otherwise("other").alias("kind"),
        F.array_join(F.array_sort(F.map_keys(fields)), ";").alias("key_names"),
        F.coalesce(F.array_size(_get(doc, "$.images", "array<variant>")), F.lit(0)).cast("long").alias("n_images"),
        F.coalesce(F.array_size(_get(doc, "$.annotations", "array<variant>")), F.lit(0)).cast("long").alias("n_annotations"),
        F.array_size(items).cast("long").alias("n_items"),
    )


# --- COCO documents ----------------------------------------------------------------


def read_coco_documents(spark: SparkSession, root: str) -> DataFrame:
    """Master COCO files only: fold files carry ``train`` or ``val`` in their stem."""
    docs = read_json_documents(spark, root)
    stem = file_stem(base_name(F.col("path")))
    master = docs.withColumn("stem", stem).where(~F.lower("stem").rlike("train|val"))
    return parse_documents(master.withColumn("part", part_name(F.col("stem"))))


def _annotation_fields(e: Column) -> list[Column]:
    return [
        _get(e, "$.image_id", "bigint").alias("image_id"),
        _get(e, "$.category_id", "bigint").alias("category_id"),
        F.coalesce(_get(e, "$.ignore", "int"), F.lit(0)).alias("ignore"),
        _get(e, "$.segmentation", "array<double>").alias("flat"),
        _get(e, "$.segmentation", "array<array<double>>").alias("nested"),
        _get(e, "$.bbox", "array<double>").alias("bbox"),
    ]


def coco_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image, annotation and category rows of parsed COCO documents."""
    doc = F.col("doc")

    def rows(path: str, kind: str) -> DataFrame:
        items = _get(doc, path, "array<variant>")
        return docs.select("part", F.explode(items).alias("e")).select(
            "part", F.try_variant_get("e", "$", kind).alias("r"), "e"
        )

    images = rows("$.images", "struct<id:bigint,file_name:string,height:int,width:int>").select(
        "part", F.col("r.id").alias("image_id"), "r.file_name", "r.height", "r.width"
    )
    categories = rows("$.categories", "struct<id:bigint,name:string>").select(
        "part", F.col("r.id").alias("category_id"), F.col("r.name").alias("category_name")
    )
    annotations = docs.select(
        "part", F.posexplode(_get(doc, "$.annotations", "array<variant>")).alias("ann_no", "e")
    ).select("part", "ann_no", *_annotation_fields(F.col("e")))
    return images, annotations, categories


def read_coco_elements(spark: SparkSession, root: str) -> DataFrame:
    """Elements of the master COCO files below ``root`` as ``part, section, e``; each is parsed once, by whichever task has it."""
    found = read_elements(spark, root)
    master = found.withColumn("stem", file_stem(base_name(F.col("path")))).where(~F.lower("stem").rlike("train|val"))
    wanted = master.where(F.col("section").isin("images", "annotations", "categories"))
    return wanted.select(part_name(F.col("stem")).alias("part"), "section", "element", F.try_parse_json("element").alias("e"))


def coco_element_tables(elements: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``coco_tables`` from elements; an annotation's number is its id, else a hash of its text."""
    e = F.col("e")

    def rows(section: str, kind: str) -> DataFrame:
        return elements.where(F.col("section") == section).select("part", F.try_variant_get("e", "$", kind).alias("r"))

    images = rows("images", "struct<id:bigint,file_name:string,height:int,width:int>").select(
        "part", F.col("r.id").alias("image_id"), "r.file_name", "r.height", "r.width"
    )
    categories = rows("categories", "struct<id:bigint,name:string>").select(
        "part", F.col("r.id").alias("category_id"), F.col("r.name").alias("category_name")
    )
    number = F.coalesce(_get(e, "$.id", "bigint"), F.xxhash64("element"))
    annotations = elements.where("section = 'annotations'").select("part", number.alias("ann_no"), *_annotation_fields(e))
    return images, annotations, categories


def annotation_polygons(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """One row per polygon: flat list, list of polygons, else the box; ignored rows dropped."""
    box = F.col("bbox")
    corner = lambda i, j: (
        F.get(box, 0) + i * F.get(box, 2),
        F.get(box, 1) + j * F.get(box, 3),
    )
    box_ring = F.array(*[v for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)) for v in corner(i, j)])
    rings = (
        F.when(F.get("flat", 0).isNotNull(), F.array("flat"))
        .when(F.get("nested", 0).isNotNull(), F.col("nested"))
        .when(F.size(box) == 4, F.array(box_ring))
    )
    used = annotations.where(F.col("ignore") != 1).select(
        *keys, F.posexplode(rings).alias("ring_no", "ring")
    )
    return used.select(
        *keys, "ring_no", F.lit("polygon").alias("shape_type"), points_from_flat(F.col("ring")).alias("points")
    )
