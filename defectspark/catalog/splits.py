"""Split, budget, pair and candidate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.catalog.registry import query, table
from defectspark.catalog.views import SAMPLES, sample_view
from defectspark.functions import text as X
from defectspark.operators import ranking as K
from defectspark.operators import splits as S
from defectspark.operators import validate as V
from defectspark.operators.ordering import with_position

UID = """
uids AS (SELECT *, rtrim(ltrim(regexp_replace(lower(class), '[^a-z0-9]+', '-', 'g'), '-'), '-') || '-'
             || rtrim(ltrim(regexp_replace(lower(defect_type), '[^a-z0-9]+', '-', 'g'), '-'), '-') || '-'
             || sha256('lake|' || class || '|' || defect_type || '|' || image_path)[1:12] AS uid FROM smp)"""


def with_uid(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "uid", X.sample_uid(F.lit("lake"), F.col("class"), F.col("defect_type"), F.col("image_path"))
    )


@query("sample_uids", f"WITH {SAMPLES}, {UID} SELECT doc_id, uid FROM uids")
def _uids(spark, sf_dir):
    return with_uid(sample_view(spark, sf_dir)).select("doc_id", "uid")


SPLIT = """
ordered AS (SELECT *, row_number() OVER (PARTITION BY class, defect_type ORDER BY sha256('42|' || uid), uid) AS r,
                   count(*) OVER (PARTITION BY class, defect_type) AS n FROM uids),
split AS (SELECT *, CASE WHEN n > 1 AND r <= least(greatest(round(n::DECIMAL(20,0) * 0.2::DECIMAL(3,1), 0), 1), n - 1)
                    THEN 'test' ELSE 'train' END AS split FROM ordered)"""


def split_view(spark, sf_dir: str) -> DataFrame:
    return S.stratified_split(with_uid(sample_view(spark, sf_dir)), ["class", "defect_type"], "uid")


@query("stratified_split", f"WITH {SAMPLES}, {UID}, {SPLIT} SELECT uid, class, defect_type, split FROM split")
def _split(spark, sf_dir):
    return split_view(spark, sf_dir).select("uid", "class", "defect_type", "split")


@query(
    "stratum_test_counts",
    f"""WITH {SAMPLES}, {UID}, {SPLIT} SELECT class, defect_type, count(*) AS n, count(*) FILTER (WHERE split = 'test') AS n_test
        FROM split GROUP BY class, defect_type""",
)
def _test_counts(spark, sf_dir):
    """Counts only: strata sizes to test counts, no ranking needed."""
    from defectspark.functions.rounding import clamp, half_up_product

    n = F.col("n")
    sizes = sample_view(spark, sf_dir).groupBy("class", "defect_type").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn(
        "n_test",
        F.when(n <= 1, F.lit(0)).otherwise(clamp(half_up_product(n, 0.2), F.lit(1), n - 1)).cast("long"),
    )


DEV = """
train AS (SELECT * FROM split WHERE split = 'train'),
dev0 AS (SELECT uid, class, defect_type, row_number() OVER (PARTITION BY class, defect_type ORDER BY sha256('7|' || uid), uid) AS r,
               count(*) OVER (PARTITION BY class, defect_type) AS n FROM train),
dev AS (SELECT uid, class, defect_type, CASE WHEN n > 1 AND r <= least(greatest(floor(n * 0.1::DOUBLE + 0.5), 1), n - 1)
               THEN 'validation' ELSE 'train' END AS part FROM dev0)"""


def dev_view(spark, sf_dir: str) -> DataFrame:
    train = split_view(spark, sf_dir).where("split = 'train'")
    return S.stratified_split(
        train, ["class", "defect_type"], "uid", seed=7, fraction=0.1, rounding="float",
        names=("validation", "train"), column="part",
    )


@query("development_split", f"WITH {SAMPLES}, {UID}, {SPLIT}, {DEV} SELECT uid, part FROM dev")
def _dev(spark, sf_dir):
    return dev_view(spark, sf_dir).select("uid", "part")


@query(
    "split_partition_errors",
    f"""WITH {SAMPLES}, {UID}, {SPLIT}, {DEV} SELECT uid, 'in no part' AS rule FROM dev WHERE part = 'validation' AND class = 'src3'
        UNION ALL SELECT uid, 'in more than one part' FROM dev WHERE part = 'train' AND class = 'src5'""",
)
def _partition(spark, sf_dir):
    """One class left out of validation and one put in both parts: exactly those are found."""
    dev = dev_view(spark, sf_dir)
    validation = dev.where("part = 'validation' AND class <> 'src3'")
    extra = dev.where("part = 'train' AND class = 'src5'")
    return S.partition_errors(dev, [dev.where("part = 'train'"), validation, extra], "uid")


@query(
    "normal_train_val_split",
    """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS r,
                 count(*) OVER (PARTITION BY source) AS n FROM documents)
       SELECT doc_id, source AS category, CASE WHEN r <= greatest(1, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split,
              greatest(1, floor(n * 0.1::DOUBLE)) >= n AS empties_rest FROM o""",
)
def _train_val(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    return S.truncated_split(docs, ["category"], "doc_id", minimum=1)


@query(
    "normal_train_test_split",
    """WITH o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) AS r,
                 count(*) OVER (PARTITION BY source) AS n FROM documents)
       SELECT doc_id, source AS category, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM o""",
)
def _train_test(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    return S.truncated_split(
        docs, ["category"], "doc_id", fraction=0.8, names=("train", "test")
    ).drop("empties_rest")


@query(
    "nested_budgets",
    f"""WITH {SAMPLES}, {UID}, o AS (SELECT uid, class, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || uid), uid) AS r,
                                     count(*) OVER (PARTITION BY class) AS n FROM uids WHERE mask_path IS NOT NULL)
        SELECT b AS budget, uid, class, r AS pair_rank, greatest(b - n, 0) AS shortfall FROM o, (SELECT unnest([5, 10, 20]) AS b) x WHERE r <= b""",
)
def _budgets(spark, sf_dir):
    pairs = with_uid(sample_view(spark, sf_dir)).where("mask_path IS NOT NULL").select("uid", "class")
    return S.nested_budgets(pairs, ["class"], "uid", [5, 10, 20]).select("budget", "uid", "class", "pair_rank", "shortfall")


@query(
    "eligible_pairs",
    f"""WITH {SAMPLES}, {UID}, o AS (SELECT uid, class, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || uid), uid) AS r
         FROM uids WHERE mask_path IS NOT NULL AND n_chars >= 300) SELECT uid, class, r AS pair_rank FROM o WHERE r <= 7""",
)
def _eligible(spark, sf_dir):
    pairs = with_uid(sample_view(spark, sf_dir)).where("mask_path IS NOT NULL")
    return S.eligible_pairs(pairs, ["class"], "uid", F.col("n_chars") >= 300, 7).select("uid", "class", "pair_rank")


@query(
    "spaced_picks",
    """WITH o AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) - 1 AS i,
                 count(*) OVER (PARTITION BY lang) AS n FROM documents),
       k AS (SELECT unnest(range(8)) AS pick_no)
       SELECT lang, pick_no, doc_id, n_chars FROM o JOIN k ON i = round_even(pick_no * (n - 1) / 7.0::DOUBLE, 0)::BIGINT WHERE n >= 8""",
)
def _spaced(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    order = [F.col("n_chars"), F.col("doc_id")]
    # Many documents may share a length, so the bucket goes on with the key.
    bucket = F.struct("n_chars", K.step_bucket(F.col("doc_id")).alias("step"))
    return S.spaced_picks(docs, ["lang"], order, bucket, 8)


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _duplicates(spark, sf_dir):
    return V.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "synthetic_path_leaks",
    """WITH p AS (SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'outputs\\Synthetic_v2\\' ELSE 'data/synthetic/' END || page_id || '.png' AS image_path FROM pages)
       SELECT page_id, 'root' AS rule FROM p WHERE regexp_matches(lower(replace(image_path, '\\', '/')), '^outputs/synthetic[^/]*(/|$)')
       UNION ALL SELECT page_id, 'name' FROM p""",
)
def _leaks(spark, sf_dir):
    base = F.when(F.col("url").startswith("https"), "outputs\\Synthetic_v2\\").otherwise("data/synthetic/")
    rows = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(base, F.col("page_id").cast("string"), F.lit(".png")).alias("image_path")
    )
    root = S.synthetic_root_leaks(rows, ["image_path"], ["page_id"]).select("page_id", F.lit("root").alias("rule"))
    name = S.synthetic_name_leaks(rows, "image_path", ["page_id"], ["c2", "synthetic"])
    return root.unionByName(name.select("page_id", F.lit("name").alias("rule")))


@query(
    "eligible_classes",
    "SELECT DISTINCT source AS class FROM documents WHERE source NOT IN (SELECT d.source FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 1)",
)
def _classes(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    excluded = samples.where(F.col("is_toxic") & (F.col("quality") == 1)).select("class").distinct()
    return S.eligible_classes(samples.select("class").distinct(), excluded, ["class"])


FRAMES = """
frm AS (SELECT *, 64 + n_chars % 7 AS ih, 64 + n_chars % 5 AS iw, 64 + n_chars % 7 AS mh,
               64 + n_chars % 5 + CASE WHEN n_chars % 11 = 0 THEN 1 ELSE 0 END AS mw, n_chars % 13 AS area FROM smp)"""


def frame_views(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Image and mask sizes derived from the text length; some disagree, some are empty."""
    n = F.col("n_chars")
    images = samples.select(
        F.col("image_path").alias("path"), (64 + n % 7).alias("height"), (64 + n % 5).alias("width")
    )
    masks = samples.where("mask_path IS NOT NULL").select(
        F.col("mask_path").alias("path"), (64 + n % 7).alias("height"),
        (64 + n % 5 + F.when(n % 11 == 0, 1).otherwise(0)).alias("width"), (n % 13).alias("area"),
    )
    return images, masks


@query(
    "defect_samples",
    f"WITH {SAMPLES}, {FRAMES} SELECT image_path, mask_path FROM frm WHERE is_toxic AND mask_path IS NOT NULL AND mw = iw AND area > 0",
)
def _defects(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    staged = samples.withColumns({"split": F.lit("test"), "is_anomalous": F.col("is_toxic")})
    return S.defect_samples(staged, *frame_views(samples)).select("image_path", "mask_path")


@query(
    "size_mismatches",
    f"WITH {SAMPLES}, {FRAMES} SELECT image_path, mask_path FROM frm WHERE is_toxic AND mask_path IS NOT NULL AND mw <> iw",
)
def _mismatches(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    staged = samples.withColumns({"split": F.lit("test"), "is_anomalous": F.col("is_toxic")})
    return S.size_mismatches(staged, *frame_views(samples))


@query(
    "clean_training_images",
    f"WITH {SAMPLES}, {UID}, {SPLIT} SELECT image_path, class FROM split WHERE split = 'train' AND NOT is_toxic",
)
def _clean(spark, sf_dir):
    split = split_view(spark, sf_dir).withColumn("is_anomalous", F.col("is_toxic"))
    return S.clean_training_images(split).select("image_path", "class")


@query(
    "planned_candidates",
    f"""WITH {SAMPLES}, {UID},
     p AS (SELECT uid, class, mask_path, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || uid), uid) - 1 AS r,
                  count(*) OVER (PARTITION BY class) AS n FROM uids WHERE mask_path IS NOT NULL),
     c AS (SELECT uid AS clean_uid, class, image_path AS clean_path, row_number() OVER (PARTITION BY class ORDER BY sha256('42|' || uid), uid) - 1 AS r,
                  count(*) OVER (PARTITION BY class) AS n FROM uids WHERE mask_path IS NULL),
     i AS (SELECT unnest(range(30)) AS idx)
     SELECT p.class || '-' || lpad(idx::VARCHAR, 4, '0') || '-s' || lpad((idx + 42)::VARCHAR, 8, '0') AS candidate_uid,
            p.class, idx::INT AS index, p.mask_path AS source_mask, c.clean_path AS source_clean_image, (idx + 42)::INT AS seed
     FROM i JOIN p ON p.r = idx % p.n JOIN c ON c.class = p.class AND c.r = idx % c.n""",
)
def _plan(spark, sf_dir):
    samples = with_uid(sample_view(spark, sf_dir))
    pairs = S.budget_pairs(samples.where("mask_path IS NOT NULL").select("uid", "class", "mask_path"), ["class"], "uid", 30)
    cleans = S.budget_pairs(
        samples.where("mask_path IS NULL").select("uid", "class", F.col("image_path").alias("clean_path")), ["class"], "uid", 30
    )
    plan = S.plan_candidates(
        pairs.select("class", "pair_rank", "n_pairs", "mask_path"),
        cleans.select("class", F.col("pair_rank").alias("clean_rank"), F.col("n_pairs").alias("n_cleans"), "clean_path"),
        samples.select("class").distinct(), 30, 42,
    )
    return plan.select(
        X.candidate_uid(F.col("class"), F.col("index"), F.col("seed")).alias("candidate_uid"),
        "class", "index", F.col("mask_path").alias("source_mask"),
        F.col("clean_path").alias("source_clean_image"), "seed",
    )


@query(
    "accept_until_target",
    """WITH a AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_size >= 10)
       SELECT p_partkey, p_brand FROM a WHERE r <= 22""",
)
def _accept(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("accepted", F.col("p_size") >= 10)
    return S.accept_until(parts, ["p_brand"], "p_partkey", "accepted", 22).select("p_partkey", "p_brand")


@query(
    "canonical_order",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_type, p_partkey) - 1 AS position FROM part""",
)
def _canonical_order(spark, sf_dir):
    """The place of every sample in the order of class, defect type and id."""
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("defect_type"), "p_partkey")
    return with_position(parts, ["class", "defect_type", "p_partkey"]).select("p_partkey", "position")
