"""Files written to the shared folder and read back: manifests, splits, corpora, tables, inventories."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectspark.catalog.corpus import members_view
from defectspark.catalog.masks import FACTS
from defectspark.catalog.registry import query, table
from defectspark.catalog.views import SAMPLES, sample_view
from defectspark.operators import reports as R
from defectspark.session import shared_folder
from defectspark.sources import reports as IO
from defectspark.sources.inventory import read_inventory


@query(
    "mask_manifest_round_trip",
    """SELECT p_partkey || '.png' AS image_filename, regexp_replace(p_type, ' ', ';', 'g') AS defect_types FROM part WHERE p_size > 10""",
)
def _manifest_trip(spark, sf_dir):
    """Manifest rows as CSV and back; images without defects drop out."""
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("part"), name.alias("image_filename"), name.alias("mask_filename"), (F.col("p_size") > 10).alias("is_defective"),
        F.when(F.col("p_size") > 10, F.split("p_type", " ")).otherwise(F.array().cast("array<string>")).alias("defect_categories"),
        F.lit(1).alias("num_defect_regions"),
    )
    path = shared_folder(spark, "mask-manifest")
    IO.write_mask_manifest(rows, path)
    return IO.read_mask_manifest(spark, path).select("image_filename", F.array_join("defect_types", ";").alias("defect_types"))


SPLIT = "CASE WHEN n_chars % 10 = 0 THEN 'val' WHEN n_chars % 10 > 7 THEN 'test' ELSE 'train' END"


def split_rows(spark, sf_dir):
    return sample_view(spark, sf_dir).select(
        F.lit("docs").alias("dataset"), F.col("class").alias("category"), F.expr(SPLIT).alias("split"), "image_path",
        F.col("defect_type").alias("label"), F.col("is_toxic").alias("is_anomalous"), "mask_path", F.array("defect_type").alias("defect_types"),
    )


@query(
    "split_manifest_round_trip",
    f"""WITH {SAMPLES} SELECT 'docs' AS dataset, class AS category, {SPLIT} AS split, image_path, defect_type AS label, is_toxic AS is_anomalous, mask_path, defect_type AS types FROM smp""",
)
def _split_trip(spark, sf_dir):
    """Samples as nested JSON documents and back."""
    path = shared_folder(spark, "split-manifest")
    IO.export_split_manifest(split_rows(spark, sf_dir), path, 42, 0.1)
    back = IO.read_split_manifest(spark, path, lines=True)
    return back.withColumn("types", F.array_join("defect_types", ";")).drop("defect_types")


@query(
    "samples_round_trip",
    f"""WITH {SAMPLES} SELECT class AS category, {SPLIT} AS split, count(*) AS n_samples, count(mask_path) AS n_masks, sum(length(image_path))::BIGINT AS path_chars FROM smp GROUP BY ALL""",
)
def _samples_trip(spark, sf_dir):
    """Samples partitioned by data set, category and split, counted from the files."""
    path = shared_folder(spark, "samples")
    IO.write_samples(split_rows(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("category", "split").agg(
        F.count("*").alias("n_samples"), F.count("mask_path").alias("n_masks"), F.sum(F.length("image_path")).alias("path_chars")
    )


@query(
    "corpus_round_trip",
    FACTS + """ SELECT 'u' || image_id AS uid, CASE WHEN image_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, round(area_pct, 4) AS area_pct,
       region, severity_level, defect_present FROM facts""",
)
def _corpus_trip(spark, sf_dir):
    """Grounding and report JSON by split and the membership table, joined again from the files."""
    members = members_view(spark, sf_dir).withColumn("split", F.when(F.col("image_id") % 5 == 0, "test").otherwise("train"))
    path = shared_folder(spark, "corpus")
    grounding = R.grounding_rows(members, F.lit("vectors"))
    IO.write_corpus(members.select("uid", "class", "defect_type", "image_path", "mask_path", "split"), grounding, members.select("uid", "report"), path)
    facts = spark.read.schema(grounding.schema).json(f"{path}/grounding")
    reports = spark.read.schema(members.select("uid", "report").schema).json(f"{path}/reports")
    records = R.training_records(spark.read.parquet(f"{path}/membership"), facts, reports)
    g = F.col("grounding")
    return records.select("uid", "split", F.round(g["area_pct"], 4).alias("area_pct"), g["region"].alias("region"), g["severity_level"].alias("severity_level"), F.col("report.defect_present").alias("defect_present"))


@query(
    "fidelity_round_trip",
    """SELECT 'ds' || s_nationkey AS dataset, 'c' || s_suppkey AS class, 100 + s_suppkey AS n_real, 22 AS n_synth, 0 AS crop_exclusion_count,
         s_suppkey / 4.0::DOUBLE AS FID, s_suppkey / 1024.0::DOUBLE AS KID, 0.5::DOUBLE AS LPIPS_diversity, 0.75::DOUBLE AS lfs_acceptance,
         row_number() OVER (ORDER BY 'ds' || s_nationkey, 'c' || s_suppkey) - 1 AS place FROM supplier""",
)
def _fidelity_trip(spark, sf_dir):
    """Fidelity rows as CSV and back, with the place of every row in the written order."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("ds"), F.col("s_nationkey").cast("string")).alias("dataset"), F.concat(F.lit("c"), key.cast("string")).alias("class"),
        (100 + key).cast("long").alias("n_real"), F.lit(22).cast("long").alias("n_synth"), F.lit(0).cast("long").alias("crop_exclusion_count"),
        (key / 4.0).alias("FID"), (key / 1024.0).alias("KID"), F.lit(0.5).alias("LPIPS_diversity"), F.lit(0.75).alias("lfs_acceptance"),
    )
    written = IO.write_fidelity(rows, shared_folder(spark, "fidelity"), "1")
    back = IO.read_fidelity(spark, written).select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    # Files are numbered in the order they hold, and lines of a file are read in order.
    starts = back.groupBy("file").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    earlier = starts.alias("e").join(starts.alias("f"), F.col("e.file") < F.col("f.file"), "right").groupBy(F.col("f.file").alias("file"), F.col("f.first").alias("first")).agg(F.coalesce(F.sum("e.n"), F.lit(0)).alias("before"))
    return back.join(earlier, "file").withColumn("place", F.col("before") + F.col("line") - F.col("first")).drop("file", "line", "first", "before")


@query(
    "accepted_round_trip",
    """SELECT o_orderkey, o_orderstatus AS dataset, o_orderpriority AS class FROM orders
       WHERE (o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 3 = 0) OR (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') AND o_orderkey % 2 = 0)""",
)
def _accepted_trip(spark, sf_dir):
    """Three batches of candidates: all classes, two classes again, one class without an accepted row."""
    path = shared_folder(spark, "accepted")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("class"))
    key, cls = F.col("o_orderkey"), F.col("class")
    IO.write_accepted(orders.withColumn("accepted", key % 2 == 0), path)
    IO.write_accepted(orders.where(cls.isin("1-URGENT", "2-HIGH")).withColumn("accepted", key % 3 == 0), path)
    IO.write_accepted(orders.where(cls == "5-LOW").withColumn("accepted", F.lit(False)), path)
    return IO.read_accepted(spark, path).select("o_orderkey", "dataset", "class")


@query(
    "configured_classes",
    """SELECT r_name AS dataset, n_name AS class, n_nationkey % 4 = 0 AS excluded, count(*) AS n_types
       FROM nation JOIN region ON n_regionkey = r_regionkey JOIN (SELECT unnest(['dent', 'scratch']) AS t) ON true GROUP BY ALL""",
)
def _configured(spark, sf_dir):
    """A configuration of the 25 given nations as class and template rows."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    config: dict = {}
    for row in nations.select("r_name", "n_name", "n_nationkey").collect():
        part = config.setdefault(row.r_name, {"classes": {}, "excluded_classes": []})
        part["classes"][row.n_name] = {kind: (f"{kind} on {row.n_name}", "inspect", f"{kind} found") for kind in ("dent", "scratch")}
        part["excluded_classes"] += [row.n_name] if row.n_nationkey % 4 == 0 else []
    classes, templates = IO.configuration_rows(spark, config)
    counts = templates.groupBy("dataset", "class").agg(F.count("*").alias("n_types"))
    return classes.join(counts, ["dataset", "class"])


@query(
    "file_inventory",
    """SELECT 'kind=' || event_type AS folder, sum(length(props) + 1)::BIGINT AS bytes, 1 AS n_files FROM events GROUP BY 1""",
)
def _inventory(spark, sf_dir):
    """Text files of the given events, one to a folder, found and sized by the inventory source."""
    path = shared_folder(spark, "inventory")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), F.col("props").alias("value"))
    rows.repartition("kind").write.partitionBy("kind").text(path)
    found = read_inventory(spark, path, depth=1).where(F.col("path").endswith(".txt"))
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder")).agg(F.sum("size_bytes").alias("bytes"), F.count("*").cast("int").alias("n_files"))
