"""Raw-lake hygiene: issues, renames, routing plans, counts and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectspark.functions import text as X


_ROWS_PER_TASK = 250_000
_FEW_CATEGORIES = 100_000
_SALTS = 16


def mask_manifest(
    images: DataFrame, annotations: DataFrame, categories: DataFrame, keys: Sequence[str], partitions: int | None = None
) -> DataFrame:
    """One row per image: sorted distinct category names, region counts, defect flag.

    Ignored annotations count as regions but add no name; images without annotations
    stay, as normals. Unnamed categories appear as ``cat_<id>``.

    Images and annotations meet by image in ``partitions`` parts; by default they are counted, so that a task
    holds as much of a large table as of a small one. A table of categories that is not small is joined
    over copies of it, as a few categories hold most annotations.
    """
    n = partitions or max(images.count(), annotations.count()) // _ROWS_PER_TASK + 1
    on_category = [c for c in categories.columns if c != "category_name"]
    used = F.coalesce(F.col("ignore"), F.lit(0)) != 1
    # A hot image is reduced to its few categories before they are named and listed.
    own = [c for c in on_category if c not in keys]
    counted = annotations.repartition(n, *keys).groupBy(*keys, *own).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(used).alias("n_used")
    )
    if categories.limit(_FEW_CATEGORIES + 1).count() <= _FEW_CATEGORIES:
        joined = counted.join(F.broadcast(categories), on_category, "left")
    else:
        copies = categories.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = counted.withColumn("__salt", F.pmod(F.xxhash64(*keys), F.lit(_SALTS)).cast("int"))
        sides = [side.repartition(n, *on_category, "__salt") for side in (salted, copies)]
        joined = sides[0].join(sides[1], [*on_category, "__salt"], "left").repartition(n, *keys)
    name = F.coalesce("category_name", F.concat(F.lit("cat_"), F.col("category_id").cast("string")))
    names = F.collect_list(F.when(F.col("n_used") > 0, name))
    per_image = joined.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(names)).alias("defect_categories"),
        F.sum("n").alias("num_defect_regions"),
        F.sum("n_used").alias("num_used_regions"),
    )
    joined = images.repartition(n, *keys).join(per_image, list(keys), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        *images.columns,
        F.coalesce("num_defect_regions", zero).alias("num_defect_regions"),
        F.coalesce("num_used_regions", zero).alias("num_used_regions"),
        (F.coalesce("num_defect_regions", zero) > 0).alias("is_defective"),
        F.coalesce("defect_categories", F.array().cast("array<string>")).alias("defect_categories"),
    )


# --- audit ---------------------------------------------------------------------------------
# File rows are ``dataset, path, size_bytes`` and, after the image probe, ``width, height,
# mode, readable``. ``path`` is relative to the lake root, with ``/`` separators.


def file_parts(files: DataFrame) -> DataFrame:
    """Adds ``parts`` (folders and name), ``name``, ``stem``, ``ext``."""
    name = X.base_name(F.col("path"))
    return files.withColumns(
        {
            "parts": F.split("path", "/"), "name": name,
            "stem": X.file_stem(name), "ext": F.lower(X.file_extension(name)),
        }
    )


def file_issues(files: DataFrame) -> DataFrame:
    """``(dataset, path, issue)``: non-ASCII path; zero bytes (ends the checks); unreadable image."""
    empty = F.col("size_bytes") == 0
    broken = ~empty & X.is_image_name(X.base_name(F.col("path"))) & ~F.coalesce("readable", F.lit(False))
    found = F.array_compact(
        F.array(
            F.when(X.has_non_ascii(F.col("path")), F.lit("non-ascii path")),
            F.when(empty, F.lit("zero-byte file")),
            F.when(broken, F.lit("corrupted")),
        )
    )
    return files.select("dataset", "path", F.explode(found).alias("issue"))


def audit_totals(files: DataFrame) -> DataFrame:
    image = (F.col("size_bytes") > 0) & X.is_image_name(X.base_name(F.col("path")))
    return files.groupBy("dataset").agg(
        F.count_if(image).alias("total_images"),
        F.count_if(X.has_non_ascii(F.col("path"))).alias("non_ascii_paths"),
        F.count_if(image & ~F.coalesce("readable", F.lit(False))).alias("corrupted_files"),
        F.count_if(F.col("size_bytes") == 0).alias("zero_byte_files"),
    )


def image_histogram(files: DataFrame, value: Column) -> DataFrame:
    """Counts of one image property (size or mode) per dataset, readable images only."""
    usable = (F.col("size_bytes") > 0) & X.is_image_name(X.base_name(F.col("path"))) & F.col("readable")
    return files.where(usable).groupBy("dataset", value.alias("value")).agg(F.count(F.lit(1)).alias("n_images"))


def nested_histogram(histogram: DataFrame) -> DataFrame:
    """One map per dataset from ``image_histogram`` (as many entries as distinct values)."""
    return histogram.groupBy("dataset").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n_images")))).alias("counts")
    )


def first_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], count: int) -> DataFrame:
    """The first ``count`` rows per group: a short report, pruned before the shuffle."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("place", F.row_number().over(window)).where(F.col("place") <= count)


def first_matching(df: DataFrame, group: Sequence[str], condition: Column, order: Sequence[Column]) -> DataFrame:
    """The first row per group that meets a condition."""
    rest = [c for c in df.columns if c not in group]
    first = df.where(condition).groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return first.select(*group, "__row.*")


# --- rename and routing plans ----------------------------------------------------------------


def rename_plan(files: DataFrame) -> DataFrame:
    """Translated folders and stable ASCII file names: ``path -> new_path``."""
    parts = F.split("path", "/")
    folders = X.translate_folders(F.slice(parts, F.lit(1), F.size(parts) - 1))
    renamed = F.concat(folders, F.array(X.ascii_file_name(F.element_at(parts, -1))))
    return files.withColumn("new_path", F.array_join(renamed, "/"))


def unmapped_folders(files: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    folders = X.translate_folders(F.slice(parts, F.lit(1), F.size(parts) - 1))
    return files.select(F.explode(folders).alias("folder")).where(X.has_non_ascii(F.col("folder"))).distinct()


def collisions(plan: DataFrame, target: str) -> DataFrame:
    """Targets that several sources would write, with the count."""
    return plan.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_sources")).where("n_sources > 1")


def without_junk(files: DataFrame, folders: Sequence[str] = X.JUNK_FOLDERS) -> DataFrame:
    return files.where(~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(f) for f in folders])))


def _lifted(parts: Column) -> tuple[Column, Column]:
    """Category and the parts below it; the lifted top folder is skipped."""
    lifted = (F.get(parts, 0) == X.LIFTED_FOLDER) & (F.size(parts) > 1)
    category = F.when(lifted, F.get(parts, 1)).otherwise(F.get(parts, 0))
    below = F.when(lifted, F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(
        F.slice(parts, F.lit(2), F.size(parts) - 1)
    )
    return category, below


def mask_targets(documents: DataFrame) -> DataFrame:
    """Category and mask path of annotation documents, their sub-folders kept."""
    category, below = _lifted(F.split("path", "/"))
    staged = documents.withColumn("category", category).withColumn("__below", below)
    name = F.element_at("__below", -1)
    stem = X.strip_image_suffix(X.file_stem(name))
    folders = F.slice("__below", F.lit(1), F.size("__below") - 1)
    target = F.array_join(
        F.concat(F.array("category", F.lit("ground_truth")), folders, F.array(F.concat(stem, F.lit(".png")))), "/"
    )
    return staged.withColumn("mask_path", target).drop("__below")


def route_inspection_files(files: DataFrame, compat_substring: bool = False) -> DataFrame:
    """Route per file: normal images to train, defect images to test, documents to ground truth.

    Folder names carry ``OK`` or ``NG`` as a word; ``compat_substring`` looks for the letters
    anywhere in the folder path instead, which also finds them inside other words. Files
    that match no rule get a null ``dst_path``.
    """
    parts = F.split("path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    category = F.when(
        F.get(folders, 0) == X.LIFTED_FOLDER, F.get(folders, 1)
    ).otherwise(F.get(folders, 0))
    name = F.lower(F.element_at(parts, -1))
    where = F.upper(F.array_join(folders, "/"))

    def holds(word: str) -> Column:
        return where.contains(word) if compat_substring else where.rlike(f"(^|[^A-Z]){word}([^A-Z]|$)")

    image = name.rlike(r"\.(bmp|png|jpg|jpeg)$")
    usable = ~name.startswith(".") & ~name.isin(".db", ".txt") & category.isNotNull()
    route = (
        F.when(~usable, None)
        .when(holds("OK"), F.when(image, "train/good"))
        .when(holds("NG") & image, F.concat(F.lit("test/"), category))
        .when(holds("NG") & name.endswith(".json"), F.concat(F.lit("ground_truth/"), category))
    )
    return without_junk(files).withColumn("category", category).withColumn("route", route).withColumn(
        "dst_path", F.concat_ws("/", F.when(route.isNotNull(), category), route, F.when(route.isNotNull(), F.element_at(parts, -1)))
    ).withColumn("dst_path", F.nullif("dst_path", F.lit("")))


def route_board_files(files: DataFrame, prefix: str = "annotations_") -> DataFrame:
    """Boards keep images under test; their ``annotations_`` folders feed ground truth."""
    parts = F.split("path", "/")
    board, name = F.get(parts, 0), F.element_at(parts, -1)
    marked = board.contains(prefix)
    target = F.when(
        marked, F.concat_ws("/", F.replace(board, F.lit(prefix), F.lit("")), F.lit("ground_truth/defects"), name)
    ).otherwise(F.concat_ws("/", board, F.lit("test/defects"), name))
    usable = (F.size(parts) > 1) & ~name.startswith(".")
    return without_junk(files, ["__MACOSX"]).where(usable).withColumn("dst_path", target)


def route_known_categories(files: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Files of known categories, dotfiles dropped, paths unchanged."""
    category = F.get(F.split("path", "/"), 0)
    keep = category.isin(list(categories)) & ~X.base_name(F.col("path")).startswith(".")
    return files.where(keep).withColumn("dst_path", F.col("path"))


# --- counts ---------------------------------------------------------------------------------------


def role_counts(files: DataFrame) -> DataFrame:
    """Train/test/ground-truth counts per dataset, categories, empty files and a pass flag.

    ``path`` starts with the category folder. Empty files count only as corrupt.
    """
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    has = lambda n: F.array_contains(folders, n)
    full = F.col("size_bytes") > 0
    train = has("train") & has("good")
    per_category = files.groupBy("dataset", F.get(F.split("path", "/"), 0).alias("category")).agg(
        F.count_if(full & train).alias("train_good"),
        F.count_if(full & ~train & has("test")).alias("test_images"),
        F.count_if(full & ~train & ~has("test") & has("ground_truth")).alias("ground_truth"),
        F.count_if(~full).alias("corrupt"),
    )
    totals = [F.sum(c).alias(c) for c in ("train_good", "test_images", "ground_truth", "corrupt")]
    return per_category.groupBy("dataset").agg(F.count(F.lit(1)).alias("categories"), *totals).withColumn(
        "passed", F.col("corrupt") == 0
    )


def dataset_counts(files: DataFrame, suffixes: Sequence[str] = (".png", ".jpg", ".jpeg", ".bmp", ".json")) -> DataFrame:
    """Data files per dataset, junk folders excluded."""
    wanted = F.lower(X.file_extension(X.base_name(F.col("path")))).isin(list(suffixes))
    return without_junk(files).where(wanted).groupBy("dataset").agg(F.count(F.lit(1)).alias("n_files"))


def count_differences(raw: DataFrame, processed: DataFrame, key: str = "dataset") -> DataFrame:
    zero = F.lit(0).cast("long")
    joined = raw.withColumnRenamed("n_files", "raw").join(
        processed.withColumnRenamed("n_files", "processed"), key, "full_outer"
    )
    a, b = F.coalesce("raw", zero), F.coalesce("processed", zero)
    return joined.select(key, a.alias("raw"), b.alias("processed"), (a - b).alias("difference"))


def split_stats(samples: DataFrame, keys: Sequence[str] = ("category", "split")) -> DataFrame:
    """Totals per category and split; ``by_class`` maps label to count."""
    by_label = samples.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("is_anomalous")).alias("normal")
    )
    return by_label.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.sum("normal").alias("normal"),
        (F.sum("n") - F.sum("normal")).alias("anomalous"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("by_class"),
    )


def dataset_totals(samples: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Train, validation and test totals per dataset with a grand-total row (null dataset)."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return samples.rollup(dataset).agg(F.count_distinct("category").alias("num_categories"), *counts)


def conversion_summary(converted: DataFrame, part: str = "part") -> DataFrame:
    """Images, defective, normal, written and skipped per part, plus a total row (null part)."""
    return converted.rollup(part).agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(F.col("has_frame") & F.col("is_defective")).alias("defective_images"),
        F.count_if(F.col("has_frame") & ~F.col("is_defective")).alias("normal_images"),
        F.count_if(F.col("has_frame")).alias("masks_written"),
        F.count_if(~F.col("has_frame")).alias("skipped_missing_source"),
    )


def full_test_check(entries: DataFrame, group: Sequence[str], area: str = "mask_area") -> DataFrame:
    """Normal and anomalous counts and the largest mask value (1 when any pixel is set)."""
    return entries.groupBy(*group).agg(
        F.count_if(~F.col("is_anomalous")).alias("total_normal"),
        F.count_if(F.col("is_anomalous")).alias("total_anomalous"),
        F.max(F.when(F.coalesce(F.col(area), F.lit(0)) > 0, 1.0).otherwise(0.0)).alias("max_mask_value"),
    )


# --- masks and images by name ---------------------------------------------------------------------


def find_masks(images: DataFrame, inventory: DataFrame) -> DataFrame:
    """The first existing of seven mask places per image, as ``mask_path`` (null when none).

    Images have ``image_path, dataset_dir, category_dir, label``; ``inventory`` has ``path``.
    """
    stem = X.file_stem(X.base_name(F.col("image_path")))
    near, far = F.concat("category_dir", F.lit("/ground_truth")), F.concat("dataset_dir", F.lit("/ground_truth"))
    label = F.col("label")
    # Places in order of preference.
    places = F.array(
        F.concat_ws("/", near, label, F.concat(stem, F.lit(".png"))),
        F.concat_ws("/", near, label, F.concat(stem, F.lit("_mask.png"))),
        F.concat_ws("/", near, F.lit("defects"), F.concat(stem, F.lit(".png"))),
        F.concat_ws("/", near, F.concat(stem, F.lit(".png"))),
        F.concat_ws("/", far, F.lit("defects"), F.concat(stem, F.lit(".png"))),
        F.concat_ws("/", far, label, F.concat(stem, F.lit(".png"))),
        F.concat_ws("/", far, F.concat(stem, F.lit(".png"))),
    )
    tried = images.select("image_path", F.posexplode(places).alias("place", "mask_path"))
    known = inventory.select(F.col("path").alias("mask_path")).distinct()
    best = tried.join(known, "mask_path").groupBy("image_path").agg(F.min_by("mask_path", "place").alias("mask_path"))
    return images.join(best, "image_path", "left")


def route_masks(masks: DataFrame, images: DataFrame) -> DataFrame:
    """Send each flat mask to the image with its stem, else with its normalised stem.

    ``masks`` and ``images`` have ``path``; images also ``category``. Of several images with
    one stem the last path wins. Masks without an image are orphans (null ``dst_path``).
    """
    named = images.withColumn("image_stem", X.file_stem(X.base_name(F.col("path"))))
    spot = F.struct("category", "image_stem")
    exact = named.groupBy(F.col("image_stem").alias("stem")).agg(F.max_by(spot, "path").alias("exact"))
    loose = named.groupBy(X.normalized_stem(F.col("image_stem")).alias("norm")).agg(F.max_by(spot, "path").alias("loose"))
    stem = X.file_stem(X.base_name(F.col("path")))
    plan = masks.withColumn("stem", stem).withColumn("norm", X.normalized_stem(stem))
    joined = plan.join(exact, "stem", "left").join(loose, "norm", "left").withColumn("hit", F.coalesce("exact", "loose"))
    target = F.concat_ws("/", "hit.category", F.lit("ground_truth"), "hit.category", F.concat("hit.image_stem", F.lit(".png")))
    return joined.select(
        *masks.columns, F.col("hit.category").alias("category"), F.when(F.col("hit").isNotNull(), target).alias("dst_path")
    )


def routing_summary(plan: DataFrame, inventory: DataFrame) -> DataFrame:
    """Masks per category: total, already in place, to copy."""
    present = inventory.select(F.col("path").alias("dst_path")).distinct().withColumn("__there", F.lit(True))
    joined = plan.where(F.col("dst_path").isNotNull()).join(present, "dst_path", "left")
    return joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("total_masks"),
        F.count_if(F.col("__there")).alias("already_present"),
        F.count_if(F.col("__there").isNull()).alias("to_copy"),
    )


def keep_one_mask(masks: DataFrame, tests: DataFrame, strip_marks: bool = False, skip_good: bool = False) -> DataFrame:
    """Adds ``action``: ``keep`` the first mask per (category, test stem), ``delete`` the rest.

    ``strip_marks`` removes ``_mask`` and ``mask_`` from mask stems; ``skip_good`` leaves out
    test files below a ``good`` folder.
    """
    stem = X.file_stem(X.base_name(F.col("path")))
    clean = F.replace(F.replace(stem, F.lit("_mask"), F.lit("")), F.lit("mask_"), F.lit("")) if strip_marks else stem
    usable = tests.where(~F.array_contains(F.split("path", "/"), "good")) if skip_good else tests
    stems = usable.select("category", stem.alias("stem")).distinct()
    named = masks.withColumn("stem", clean)
    first = named.join(stems, ["category", "stem"], "left_semi").groupBy("category", "stem").agg(F.min("path").alias("path"))
    chosen = first.select("category", "path", F.lit("keep").alias("action"))
    return masks.join(chosen, ["category", "path"], "left").withColumn("action", F.coalesce("action", F.lit("delete")))


def pair_by_position(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """n-th of one sorted list with n-th of the other, cut at the shorter: ``left, right``."""
    from defectspark.operators.ranking import exact_rank, sampled_bucket

    def ranked(df: DataFrame, name: str) -> DataFrame:
        single = df.select(F.lit(1).alias("__all"), F.col(key).alias(name))
        return exact_rank(single, ["__all"], [F.col(name)], sampled_bucket(single, F.col(name)), "position").drop("__all")

    return ranked(left, "left").join(ranked(right, "right"), "position")


def attach_defect_types(samples: DataFrame, lookup: DataFrame) -> DataFrame:
    """Adds ``defect_types`` by image file name (``lookup``: ``image_filename, defect_types``)."""
    named = samples.withColumn("image_filename", X.base_name(F.col("image_path")))
    return named.join(lookup, "image_filename", "left").drop("image_filename")


def with_stems(files: DataFrame, stems: Sequence[str]) -> DataFrame:
    return files.where(X.file_stem(X.base_name(F.col("path"))).isin(list(stems)))


def flat_masks(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(r"^ground_truth/defects/[^/]+\.png$"))


def category_test_images(files: DataFrame) -> DataFrame:
    """Test images per category without ``good`` and without the dataset-level masks."""
    parts = F.split("path", "/")
    keep = (
        (F.size(parts) == 4) & (F.get(parts, 0) != "ground_truth") & (F.get(parts, 1) == "test")
        & (F.get(parts, 2) != "good") & F.lower("path").rlike(r"\.(bmp|jpg|jpeg|png)$")
    )
    return files.where(keep).withColumn("category", F.get(parts, 0))


def test_defect_folders(files: DataFrame) -> DataFrame:
    """Distinct defect folders under ``<category>/test``, ``good`` excluded."""
    parts = F.split("path", "/")
    inside = (F.size(parts) >= 4) & (F.get(parts, 1) == "test") & (F.lower(F.get(parts, 2)) != "good")
    return files.where(inside).select(F.get(parts, 0).alias("category"), F.get(parts, 2).alias("folder")).distinct()


def mask_layout(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per category: its root, the mask folder relative to it or to its dataset, and the level.

    The root is three levels above the first train image. The first test row with an
    existing mask decides the level; without one, files below ``<root>/ground_truth`` do.
    """
    up = lambda p, n: F.array_join(F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - n), "/")
    roots = samples.where("split = 'train'").groupBy("category").agg(F.min("image_path").alias("p")).select(
        "category", up(F.col("p"), 3).alias("root")
    )
    known = inventory.select(F.col("path").alias("mask_path")).distinct()
    first = (
        samples.where("split = 'test'").join(known, "mask_path", "left_semi").groupBy("category")
        .agg(F.min_by("mask_path", "image_path").alias("mask"))
    )
    below = inventory.select(F.regexp_extract("path", "^(.*?)/ground_truth/", 1).alias("root")).where("root <> ''").distinct()
    joined = roots.join(first, "category", "left").join(below.withColumn("__has", F.lit(True)), "root", "left")
    dataset = up(F.col("root"), 1)
    inside = F.col("mask").startswith(F.concat("root", F.lit("/")))
    beside = F.col("mask").startswith(F.concat(dataset, F.lit("/")))
    rest = lambda base: F.expr(f"substring(mask, length({base}) + 2)")
    folder = (
        F.when(inside, F.get(F.split(rest("root"), "/"), 0))
        .when(beside, F.regexp_replace(rest("regexp_replace(root, '/[^/]*$', '')"), "/[^/]*$", ""))
        .when(F.col("__has"), "ground_truth")
    )
    level = F.when(inside, "category").when(beside, "dataset").when(F.col("__has"), "category").otherwise("none")
    return joined.select("category", "root", folder.alias("mask_dir"), level.alias("level"))


# --- corpus selection ----------------------------------------------------------------------------------


def corpus_selection(samples: DataFrame, inventory: DataFrame) -> DataFrame:
    """Anomalous samples of every split with ``skip_reason`` (null for selected rows)."""
    known = inventory.select(F.col("path").alias("mask_path")).distinct().withColumn("__there", F.lit(True))
    joined = samples.where("is_anomalous").join(known, "mask_path", "left")
    reason = F.when(F.coalesce("mask_path", F.lit("")) == "", F.lit("null mask_path")).when(
        F.col("__there").isNull(), F.concat(F.lit("missing mask file: "), "mask_path")
    )
    return joined.withColumn("skip_reason", reason).drop("__there")


def outside_root(df: DataFrame, paths: Sequence[str], root: str, keys: Sequence[str]) -> DataFrame:
    """``(keys, path)`` for paths that do not lie below ``root``."""
    bad = F.filter(F.array(*paths), lambda p: p.isNotNull() & ~X.is_under(p, root))
    return df.select(*keys, F.explode(bad).alias("path"))


def samples_from_inventory(files: DataFrame) -> DataFrame:
    """Sample rows from processed paths ``<category>/train|test/<label>/.../<image>``."""
    parts = F.split("path", "/")
    keep = (
        X.is_image_name(X.base_name(F.col("path"))) & ~F.get(parts, 0).isin(X.EXCLUDED_CATEGORY_FOLDERS)
        & (((F.get(parts, 1) == "train") & (F.get(parts, 2) == "good")) | (F.get(parts, 1) == "test")) & (F.size(parts) >= 4)
    )
    label = F.get(parts, 2)
    return files.where(keep).select(
        "dataset", F.get(parts, 0).alias("category"), F.get(parts, 1).alias("source_split"),
        F.col("path").alias("image_path"), label.alias("label"), (label != "good").alias("is_anomalous"),
    )
