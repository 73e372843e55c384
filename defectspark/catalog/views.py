"""Stand-ins: the given tables read as masks, shapes, samples, candidates and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.catalog.registry import table
from defectspark.operators.masks import masks_from_arrays

SIDE = 8
ON = 0.15

# Pixels, runs and image rows of the embedding rasters (8 x 8, on above 0.15).
PX = """
vals AS (SELECT vec_id AS image_id, label, CAST(unnest(embedding) AS DOUBLE) AS v,
                generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
px AS (SELECT image_id, label, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x FROM vals WHERE v > 0.15),
img AS (SELECT vec_id AS image_id, label, 8 AS h, 8 AS w FROM embeddings)"""
RUNS = (
    PX
    + """,
isl AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM px),
runs AS (SELECT image_id, y, min(x) AS x0, max(x) AS x1 FROM isl GROUP BY image_id, y, g)"""
)
BOX = (
    PX
    + """,
box AS (SELECT img.image_id, img.label, h, w, count(x) AS area, min(x) AS x_min, max(x) AS x_max,
               min(y) AS y_min, max(y) AS y_max, avg(x) AS mean_x, avg(y) AS mean_y
        FROM img LEFT JOIN px USING (image_id) GROUP BY ALL)"""
)


def mask_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask rows ``image_id, class, defect_type, runs, height, width``."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.concat(F.lit("class_"), F.col("label")).alias("class"),
        F.concat(F.lit("type_"), F.col("label")).alias("defect_type"),
        "embedding",
    )
    return masks_from_arrays(vectors, "embedding", SIDE, SIDE, lambda v: v.cast("double") > ON)


# One three-point shape per order line on a 64 x 64 frame.
TRI = """
tri AS (SELECT DISTINCT l_orderkey AS image_id, l_returnflag AS form, l_linestatus = 'F' AND l_linenumber = 1 AS ignored,
               concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT),
                         CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT)) AS shape_no,
               CAST(l_partkey % 64 AS DOUBLE) AS u1, CAST(l_suppkey % 64 AS DOUBLE) AS v1,
               CAST(trunc(l_quantity) AS DOUBLE) AS u2, round(l_discount * 100) * 6 AS v2,
               CAST(l_linenumber * 8 AS DOUBLE) AS u3, round(l_tax * 100) * 7 AS v3 FROM lineitem)"""


def shape_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-point polygons, one per order line; the shape number spells out the geometry."""
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"),
        F.concat_ws(
            "-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"),
            F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"),
        ).alias("shape_no"),
        F.lit("polygon").alias("shape_type"),
        F.array(
            point(F.col("l_partkey") % 64, F.col("l_suppkey") % 64),
            point(F.col("l_quantity").cast("long"), F.round(F.col("l_discount") * 100) * 6),
            point(F.col("l_linenumber") * 8, F.round(F.col("l_tax") * 100) * 7),
        ).alias("points"),
        F.lit(64).alias("height"),
        F.lit(64).alias("width"),
        F.col("l_returnflag").alias("label"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 1).otherwise(0).alias("ignore"),
    )


# Inspection samples: class = source, defect type = lang, anomalous when toxic, a mask
# when labelled; documents without a label are normals.
SAMPLES = """
smp AS (SELECT d.doc_id, d.source AS class, d.lang AS defect_type, d.n_chars,
               'data/processed/' || d.source || '/test/' || d.lang || '/' || d.doc_id || '.png' AS image_path,
               CASE WHEN l.doc_id IS NOT NULL
                    THEN 'data/processed/' || d.source || '/ground_truth/' || d.lang || '/' || d.doc_id || '.png'
               END AS mask_path,
               coalesce(l.toxic = 1, false) AS is_toxic, l.quality
        FROM documents d LEFT JOIN labels l USING (doc_id))"""


def sample_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labels.withColumn("labelled", F.lit(True)), "doc_id", "left")
    root = F.lit("data/processed/")
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    return joined.select(
        "doc_id",
        F.col("source").alias("class"),
        F.col("lang").alias("defect_type"),
        "n_chars",
        F.concat(root, F.concat_ws("/", "source", F.lit("test"), "lang", file)).alias("image_path"),
        F.when(
            F.col("labelled"),
            F.concat(root, F.concat_ws("/", "source", F.lit("ground_truth"), "lang", file)),
        ).alias("mask_path"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_toxic"),
        "quality",
    )
