"""Raw lake to split manifest: inventory, audit, rename, route, masks, samples, splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.functions import text as X
from defectspark.operators import lake as L
from defectspark.operators.splits import truncated_split
from defectspark.sources.annotations import document_frame_size, document_masks, extract_shapes, parse_documents, read_json_documents
from defectspark.sources.images import probe_images, read_images
from defectspark.sources.inventory import qualified, read_inventory


@dataclass(frozen=True)
class LakeOptions:
    dataset: str
    seed: int = 42
    val_fraction: float = 0.1
    listing_depth: int = 1
    compat_substring: bool = False


def audited_files(spark: SparkSession, root: str, options: LakeOptions) -> DataFrame:
    """Every file with its size and, for images, what the decoder says about it."""
    files = read_inventory(spark, root, options.listing_depth).withColumn("dataset", F.lit(options.dataset))
    probed = probe_images(read_images(spark, root))
    return files.join(probed.withColumn("path", X.relative_path(F.col("path"), qualified(spark, root))), "path", "left")


def lake_documents(spark: SparkSession, root: str) -> DataFrame:
    """Annotation documents of a lake as ``path`` (below the root), ``folder``, ``stem`` and ``text``."""
    path = X.relative_path(F.col("path"), qualified(spark, root))
    return read_json_documents(spark, root).withColumn("path", path).withColumns(
        {"folder": X.folder_of(F.col("path")), "stem": X.file_stem(X.base_name(F.col("path")))}
    )


def image_frames(files: DataFrame) -> DataFrame:
    """Frames of the readable images of ``audited_files``, for documents of their folder and stem that state none."""
    return files.where("readable").select(
        "path", X.folder_of(F.col("path")).alias("folder"), X.file_stem(X.base_name(F.col("path"))).alias("stem"),
        F.col("height").alias("image_height"), F.col("width").alias("image_width"),
    )


def routed_files(files: DataFrame, options: LakeOptions) -> DataFrame:
    """Renamed and routed files; rows with a null ``dst_path`` are left behind."""
    plan = L.rename_plan(files).withColumnsRenamed({"path": "raw_path", "new_path": "path"})
    return L.route_inspection_files(plan, options.compat_substring)


def annotation_masks(documents: DataFrame, images: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mask rows per document, and the shapes behind the mask manifest.

    ``documents`` has ``path, stem, text``; ``images`` has ``stem, image_height,
    image_width`` for documents that do not state their frame. Where both have ``folder``, an image
    counts for the documents beside it only.
    """
    sized = document_frame_size(parse_documents(documents), images)
    return document_masks(sized, ["path"]), extract_shapes(sized, ["path", "height", "width"])


def split_samples(processed: DataFrame, options: LakeOptions) -> DataFrame:
    """Train, validation and test samples with mask paths from the processed inventory."""
    samples = L.samples_from_inventory(processed)
    normals = samples.where("source_split = 'train'")
    train = truncated_split(normals, ["category"], "image_path", options.seed, options.val_fraction, minimum=1)
    tests = samples.where("source_split = 'test'").withColumns(
        {"split": F.lit("test"), "empties_rest": F.lit(False)}
    )
    found = L.find_masks(
        tests.withColumns({"dataset_dir": F.lit(""), "category_dir": F.col("category")}),
        processed.unionByName(processed.withColumn("path", F.concat(F.lit("/"), "path"))),
    ).drop("dataset_dir", "category_dir")
    masked = found.withColumn("mask_path", F.when(F.col("is_anomalous"), F.ltrim("mask_path", F.lit("/"))))
    return masked.unionByName(train.withColumn("mask_path", F.lit(None).cast("string"))).drop("source_split")
