"""Fidelity tables, report corpora, mask and split manifests, and result files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectspark.operators.validate import FIDELITY_FIELDS, fidelity_rules, require_none, violations
from defectspark.sources.versions import drop_versions, latest_version, path_exists, version_folder

FIDELITY_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in FIDELITY_FIELDS[:2]]
    + [T.StructField(n, T.LongType()) for n in FIDELITY_FIELDS[2:5]]
    + [T.StructField(n, T.DoubleType()) for n in FIDELITY_FIELDS[5:]]
)
_ENTRY = (
    "struct<image_path:string,label:string,is_anomalous:boolean,mask_path:string,defect_types:array<string>>"
)
_MANIFEST = (
    "map<string,struct<dataset_name:string,created_at:string,seed:bigint,split_strategy:string,"
    f"val_fraction:double,splits:map<string,array<{_ENTRY}>>>>"
)


# --- fidelity table -----------------------------------------------------------------------


def read_fidelity(spark: SparkSession, path: str) -> DataFrame:
    """The fidelity CSV; its header must match exactly. A missing file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], FIDELITY_SCHEMA)
    reader = spark.read.option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST")
    return reader.schema(FIDELITY_SCHEMA).csv(path)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same keys.

    ``order`` decides between rows of ``new`` that share a key (last one wins); without it
    the keys of ``new`` must be unique.
    """
    if order:
        rest = [c for c in new.columns if c not in keys]
        newest = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        new = newest.select(*keys, "__row.*")
    kept = old.join(new.select(*keys), list(keys), "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns))


def write_fidelity(rows: DataFrame, path: str, version: str) -> str:
    """Validate and write a new version folder below ``path``; readers switch to it whole."""
    require_none(violations(rows, ["dataset", "class"], fidelity_rules()))
    target = f"{path.rstrip('/')}/version={version}"
    rows.select(*FIDELITY_FIELDS).orderBy("dataset", "class").write.mode("errorifexists").option(
        "header", "true"
    ).csv(target)
    return target


# --- masks, splits, corpora ---------------------------------------------------------------------


def read_mask_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Image name to defect types; rows without types are dropped."""
    schema = (
        "part string, image_filename string, mask_filename string, is_defective boolean, "
        "defect_categories string, num_defect_regions int"
    )
    rows = spark.read.option("header", "true").schema(schema).csv(path)
    return rows.where("coalesce(defect_categories, '') <> ''").select(
        "image_filename", F.split("defect_categories", ";").alias("defect_types")
    )


def write_mask_manifest(manifest: DataFrame, path: str) -> None:
    """CSV with the names joined by ``;`` (the array form stays in the table)."""
    flat = manifest.withColumn("defect_categories", F.array_join("defect_categories", ";"))
    flat.write.mode("overwrite").option("header", "true").csv(path)


def read_split_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Nested split documents as one row per sample: one document per file, or per line."""
    text = spark.read.text(path, wholetext=not lines)
    categories = text.select(F.explode(F.from_json("value", _MANIFEST)).alias("category", "m"))
    splits = categories.select(
        F.col("m.dataset_name").alias("dataset"), "category", F.explode("m.splits").alias("split", "entries")
    )
    return splits.select("dataset", "category", "split", F.inline("entries"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples partitioned by dataset, category and split, so one category prunes the scan."""
    samples.write.mode("overwrite").partitionBy("dataset", "category", "split").parquet(path)


def export_split_manifest(samples: DataFrame, path: str, seed: int, val_fraction: float, parts: int = 16) -> None:
    """Nested JSON lines: every category in up to ``parts`` documents, dealt by the hash of the path.

    The form does not depend on the size of a category; one part is one document each. Each
    document carries its own counts as ``stats``. ``read_split_manifest(lines=True)`` puts the
    documents together again. Samples without ``defect_types`` get null ones.
    """
    keys = ["dataset", "category", "__part"]
    if "defect_types" not in samples.columns:
        samples = samples.withColumn("defect_types", F.lit(None).cast("array<string>"))
    dealt = samples.withColumn("__part", F.pmod(F.xxhash64("image_path"), F.lit(parts)))
    entry = F.struct("image_path", "label", "is_anomalous", "mask_path", "defect_types")
    per_split = dealt.groupBy(*keys, "split").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"),
        F.struct(F.count(F.lit(1)).alias("total"), F.count_if("is_anomalous").alias("anomalous")).alias("counts"),
    )
    documents = per_split.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("split", "entries"))).alias("splits"),
        F.map_from_entries(F.collect_list(F.struct("split", "counts"))).alias("stats"),
    )
    body = F.struct(
        F.col("dataset").alias("dataset_name"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lit(seed).alias("seed"), F.lit("val_normals_only").alias("split_strategy"),
        F.lit(val_fraction).alias("val_fraction"), "splits", "stats",
    )
    lines = documents.select(F.to_json(F.create_map("category", body), {"ignoreNullFields": "false"}))
    lines.write.mode("overwrite").text(path)


def write_corpus(members: DataFrame, grounding: DataFrame, reports: DataFrame, path: str) -> None:
    """Grounding and report JSON by split, and the membership table, below ``path``."""
    by_uid = members.select("uid", "split")
    for name, rows in (("grounding", grounding), ("reports", reports)):
        tagged = rows.join(by_uid, "uid")
        tagged.write.mode("overwrite").partitionBy("split").option("ignoreNullFields", "false").json(f"{path}/{name}")
    members.write.mode("overwrite").partitionBy("split").parquet(f"{path}/membership")


# --- results and candidates -----------------------------------------------------------------------


def write_accepted(candidates: DataFrame, path: str, keys: Sequence[str] = ("dataset", "class")) -> int:
    """Accepted candidates replace their class; rejected ones disappear with it. Returns the version written.

    A class of the batch without an accepted row has no rows any more. The new rows are written first,
    then a manifest that says for every class which version holds it; readers switch with the manifest,
    so a failure in between loses nothing. Keys must be strings.
    """
    spark, names = candidates.sparkSession, list(keys)
    before = latest_version(spark, path, "manifest")
    version = 0 if before is None else before + 1
    accepted = candidates.where("accepted")
    accepted.write.mode("overwrite").partitionBy(*names).parquet(version_folder(path, "data", version))
    current = accepted.select(*names).distinct().withColumn("version", F.lit(version).cast("long"))
    kept = {version}
    if before is not None:
        old = _accepted_manifest(spark, path, names, before)
        kept |= {r[0] for r in old.select("version").distinct().collect()}
        current = old.join(candidates.select(*names).distinct(), names, "left_anti").unionByName(current)
    current.write.mode("overwrite").parquet(version_folder(path, "manifest", version))
    drop_versions(spark, path, "data", kept)
    drop_versions(spark, path, "manifest", {version} | ({before} if before is not None else set()))
    return version


def _accepted_manifest(spark: SparkSession, path: str, names: Sequence[str], version: int) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in names) + ", version long"
    return spark.read.schema(schema).parquet(version_folder(path, "manifest", version))


def read_accepted(spark: SparkSession, path: str, keys: Sequence[str] = ("dataset", "class")) -> DataFrame | None:
    """Accepted candidates of the newest version; none before the first."""
    newest, names = latest_version(spark, path, "manifest"), list(keys)
    if newest is None:
        return None
    rows = spark.read.option("inferSchema", "false").parquet(f"{path.rstrip('/')}/data")
    return rows.join(_accepted_manifest(spark, path, names, newest), [*names, "version"]).drop("version")


def candidate_metadata(
    plan: DataFrame, dataset: Column, mode: str, checkpoint: Column, token: Column, steps: int, guidance: float
) -> DataFrame:
    """The fifteen metadata fields of each planned candidate, not yet scored."""
    from defectspark.functions.text import candidate_uid, posix_path

    return plan.select(
        candidate_uid(F.col("class"), F.col("index"), F.col("seed")).alias("uid"),
        dataset.alias("dataset"), "class",
        posix_path(F.col("clean_path")).alias("source_clean_image"),
        posix_path(F.col("mask_path")).alias("source_mask"),
        F.lit(mode).alias("generation_mode"),
        F.array(F.col("crop_x").cast("int"), F.col("crop_y").cast("int")).alias("crop_offset"),
        F.array(*[F.col(c).cast("int") for c in ("crop_x", "crop_y", "crop_w", "crop_h")]).alias("crop_bbox"),
        posix_path(checkpoint).alias("lora_checkpoint"), token.alias("token"), F.col("seed").cast("int").alias("seed"),
        F.lit(int(steps)).alias("num_inference_steps"), F.lit(float(guidance)).alias("guidance_scale"),
        F.lit(0.0).alias("lpips_score"), F.lit(False).alias("lfs_passed"),
    )


def configuration_rows(spark: SparkSession, datasets: dict[str, dict]) -> tuple[DataFrame, DataFrame]:
    """Class rows ``dataset, class, excluded`` and template rows from plain mappings.

    Each dataset maps to ``{"classes": {class: {type: (description, action, reason)}},
    "excluded_classes": [...]}``. Configurations are small and read on the driver.
    """
    for name, config in datasets.items():
        unknown = set(config.get("excluded_classes", [])) - set(config["classes"])
        if not config["classes"]:
            raise ValueError(f"{name}: no classes configured")
        if unknown:
            raise ValueError(f"{name}: excluded classes are not configured: {sorted(unknown)}")
    classes = [
        (name, cls, cls in config.get("excluded_classes", []))
        for name, config in datasets.items() for cls in config["classes"]
    ]
    templates = [
        (name, cls, kind, *texts)
        for name, config in datasets.items()
        for cls, kinds in config["classes"].items() for kind, texts in kinds.items()
    ]
    return (
        spark.createDataFrame(classes, "dataset string, class string, excluded boolean"),
        spark.createDataFrame(
            templates,
            "dataset string, class string, defect_type string, description_template string, action string, reason_template string",
        ),
    )

