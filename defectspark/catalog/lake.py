"""Lake hygiene, routing, split-manifest and corpus queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectspark.catalog.registry import query, table
from defectspark.catalog.views import SAMPLES, sample_view
from defectspark.functions import text as X
from defectspark.operators import lake as L
from defectspark.operators import validate as V

# One lake file per document; these expressions read the same in Spark SQL and DuckDB.
TOP = """CASE WHEN source IN ('src1', 'src2') THEN 'Serious defect/cat_' || lang WHEN source = 'src3' THEN '__MACOSX/x'
  WHEN source = 'src4' THEN 'pseudo_broken_solder' WHEN source = 'src5' THEN 'defect_samples/y' WHEN source = 'src6' THEN '画线'
  WHEN source = 'src7' THEN '未知' ELSE 'cat_' || source END"""
MID = "CASE n_chars % 4 WHEN 0 THEN 'train_NG_labeled' WHEN 1 THEN 'test_OK' WHEN 2 THEN '2.OK集' ELSE 'other' END"
EXT = "CASE n_chars % 5 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' WHEN 2 THEN '.bmp' WHEN 3 THEN '.json' ELSE '.txt' END"
NAME = f"CASE WHEN n_chars % 7 = 0 THEN '图' ELSE 'im' END || CAST(doc_id AS STRING) || {EXT}"
FILE_COLUMNS = [
    "doc_id", "'set_' || lang AS dataset", f"{TOP} || '/' || {MID} || '/' || {NAME} AS path",
    "CASE WHEN n_chars % 10 = 0 THEN 0 ELSE n_chars END AS size_bytes", "n_chars % 9 <> 0 AS readable",
    "100 + n_chars % 3 AS width", "80 + n_chars % 2 AS height", "CASE WHEN lang = 'en' THEN 'RGB' ELSE 'L' END AS mode",
]
FILES = "files AS (SELECT " + ", ".join(FILE_COLUMNS) + ", source, lang, n_chars FROM documents)"
IS_IMAGE = r"regexp_matches(lower(path), '\.(png|jpg|jpeg|bmp|tiff|tif)$')"
NON_ASCII = r"regexp_matches(path, '[^\x00-\x7F]')"


def file_view(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(*FILE_COLUMNS)


@query(
    "file_issues",
    f"""WITH {FILES} SELECT dataset, path, 'non-ascii path' AS issue FROM files WHERE {NON_ASCII}
        UNION ALL SELECT dataset, path, 'zero-byte file' FROM files WHERE size_bytes = 0
        UNION ALL SELECT dataset, path, 'corrupted' FROM files WHERE size_bytes > 0 AND {IS_IMAGE} AND NOT readable""",
)
def _issues(spark, sf_dir):
    return L.file_issues(file_view(spark, sf_dir))


@query(
    "audit_totals",
    f"""WITH {FILES} SELECT dataset, count(*) FILTER (WHERE size_bytes > 0 AND {IS_IMAGE}) AS total_images, count(*) FILTER (WHERE {NON_ASCII}) AS non_ascii_paths,
        count(*) FILTER (WHERE size_bytes > 0 AND {IS_IMAGE} AND NOT readable) AS corrupted_files, count(*) FILTER (WHERE size_bytes = 0) AS zero_byte_files
        FROM files GROUP BY dataset""",
)
def _totals(spark, sf_dir):
    return L.audit_totals(file_view(spark, sf_dir))


@query(
    "image_size_histogram",
    f"""WITH {FILES} SELECT dataset, '(' || width || ', ' || height || ')' AS value, count(*) AS n_images FROM files
        WHERE size_bytes > 0 AND {IS_IMAGE} AND readable GROUP BY ALL""",
)
def _sizes(spark, sf_dir):
    return L.image_histogram(file_view(spark, sf_dir), F.format_string("(%d, %d)", "width", "height"))


@query(
    "image_mode_histogram",
    f"WITH {FILES} SELECT dataset, mode || ':' || count(*) AS modes FROM files WHERE size_bytes > 0 AND {IS_IMAGE} AND readable GROUP BY dataset, mode",
)
def _modes(spark, sf_dir):
    nested = L.nested_histogram(L.image_histogram(file_view(spark, sf_dir), F.col("mode")))
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return nested.select("dataset", text.alias("modes"))


@query(
    "first_issues",
    f"""WITH {FILES}, i AS (SELECT dataset, path, 'zero-byte file' AS issue FROM files WHERE size_bytes = 0
           UNION ALL SELECT dataset, path, 'non-ascii path' FROM files WHERE {NON_ASCII}
           UNION ALL SELECT dataset, path, 'corrupted' FROM files WHERE size_bytes > 0 AND {IS_IMAGE} AND NOT readable)
        SELECT dataset, path, issue, row_number() OVER (PARTITION BY dataset ORDER BY encode(path), issue) AS place FROM i QUALIFY place <= 10""",
)
def _first_issues(spark, sf_dir):
    """A report of the first ten issues per dataset."""
    issues = L.file_issues(file_view(spark, sf_dir))
    return L.first_per_group(issues, ["dataset"], [F.col("path"), F.col("issue")], 10)


@query(
    "first_matching",
    f"""WITH {FILES} SELECT dataset, arg_min(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM files WHERE size_bytes > 0 AND NOT readable GROUP BY dataset""",
)
def _first_matching(spark, sf_dir):
    files = table(spark, sf_dir, "documents").selectExpr(*FILE_COLUMNS, "n_chars")
    found = L.first_matching(files, ["dataset"], (F.col("size_bytes") > 0) & ~F.col("readable"), [F.col("n_chars"), F.col("doc_id")])
    return found.select("dataset", "doc_id")


NEW_PATH = f"""CASE WHEN source IN ('src1', 'src2') THEN 'Serious defect/cat_' || lang WHEN source = 'src3' THEN '__MACOSX/x' WHEN source = 'src4' THEN 'pseudo_broken_solder'
  WHEN source = 'src5' THEN 'defect_samples/y' WHEN source = 'src6' THEN 'drawn_line' WHEN source = 'src7' THEN '未知' ELSE 'cat_' || source END
  || '/' || CASE n_chars % 4 WHEN 0 THEN 'train_NG_labeled' WHEN 1 THEN 'test_OK' WHEN 2 THEN 'test_OK' ELSE 'other' END || '/' ||
  CASE WHEN n_chars % 7 = 0 THEN 'img_' || sha256({NAME})[1:8] || {EXT} ELSE {NAME} END"""


@query("rename_plan", f"WITH {FILES} SELECT doc_id, {NEW_PATH} AS new_path FROM files")
def _rename(spark, sf_dir):
    return L.rename_plan(file_view(spark, sf_dir)).select("doc_id", "new_path")


@query("unmapped_folders", f"WITH {FILES} SELECT DISTINCT '未知' AS folder FROM files WHERE source = 'src7'")
def _unmapped(spark, sf_dir):
    return L.unmapped_folders(file_view(spark, sf_dir))


ROUTED = f"""
clean AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN 'cat_' || lang WHEN source = 'src4' THEN 'pseudo_broken_solder' WHEN source = 'src6' THEN '画线' WHEN source = 'src7' THEN '未知' ELSE 'cat_' || source END AS category,
            {NAME} AS name, n_chars % 4 AS m, n_chars % 5 IN (0, 1, 2) AS image, n_chars % 5 = 3 AS doc FROM files WHERE source NOT IN ('src3', 'src5'))"""


@query(
    "routed_files",
    f"""WITH {FILES}, {ROUTED} SELECT doc_id, category, CASE WHEN m IN (1, 2) AND image THEN category || '/train/good/' || name
          WHEN m = 0 AND image THEN category || '/test/' || category || '/' || name WHEN m = 0 AND doc THEN category || '/ground_truth/' || category || '/' || name END AS dst_path FROM clean""",
)
def _routed(spark, sf_dir):
    return L.route_inspection_files(file_view(spark, sf_dir)).select("doc_id", "category", "dst_path")


@query(
    "routed_files_substring",
    f"""WITH {FILES}, {ROUTED} SELECT doc_id, category, CASE WHEN (m IN (1, 2) OR source = 'src4') AND image THEN category || '/train/good/' || name
          WHEN source = 'src4' THEN NULL WHEN m = 0 AND image THEN category || '/test/' || category || '/' || name WHEN m = 0 AND doc THEN category || '/ground_truth/' || category || '/' || name END AS dst_path FROM clean""",
)
def _routed_compat(spark, sf_dir):
    """The letter search also hits words that merely contain the letters."""
    return L.route_inspection_files(file_view(spark, sf_dir), compat_substring=True).select("doc_id", "category", "dst_path")


@query(
    "route_collisions",
    f"""SELECT source || '/' || (n_chars % 50) || '.png' AS dst_path, count(*) AS n_sources FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _collisions(spark, sf_dir):
    plan = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.concat((F.col("n_chars") % 50).cast("string"), F.lit(".png"))).alias("dst_path")
    )
    return L.collisions(plan, "dst_path")


@query(
    "routed_boards",
    f"""SELECT page_id, CASE WHEN url LIKE 'https%' THEN 'lb' || length(html) % 3 || '/ground_truth/defects/' ELSE 'lb' || length(html) % 3 || '/test/defects/' END || page_id || '.png' AS dst_path
        FROM pages WHERE length(html) % 13 <> 0""",
)
def _boards(spark, sf_dir):
    board = F.concat(F.lit("lb"), (F.length("html") % 3).cast("string"))
    name = F.concat(F.when(F.length("html") % 13 == 0, "._").otherwise(""), F.col("page_id").cast("string"), F.lit(".png"))
    folder = F.when(F.col("url").startswith("https"), F.concat(F.lit("annotations_"), board)).otherwise(board)
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", folder, name).alias("path"))
    return L.route_board_files(pages).select("page_id", "dst_path")


@query("known_categories", "SELECT p_partkey, split_part(p_name, ' ', 1) || '/train/' || p_partkey AS dst_path FROM part WHERE split_part(p_name, ' ', 1) IN ('small', 'red')")
def _known(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat_ws("/", F.substring_index("p_name", " ", 1), F.lit("train"), F.col("p_partkey").cast("string")).alias("path")
    )
    return L.route_known_categories(parts, ["small", "red"]).select("p_partkey", "dst_path")


@query(
    "mask_targets",
    f"""WITH {FILES}, d AS (SELECT *, CASE WHEN source IN ('src1', 'src2') THEN 'cat_' || lang ELSE split_part(path, '/', 1) END AS category FROM files)
        SELECT doc_id, category, category || '/ground_truth/' || CASE WHEN source IN ('src3', 'src5') THEN split_part(path, '/', 2) || '/' ELSE '' END || {MID} || '/' ||
        CASE WHEN n_chars % 7 = 0 THEN '图' ELSE 'im' END || doc_id || '.png' AS mask_path FROM d""",
)
def _mask_targets(spark, sf_dir):
    docs = file_view(spark, sf_dir).withColumn("path", F.concat("path", F.when(F.lower("path").rlike("(png|jpg|bmp)$"), ".json").otherwise("")))
    return L.mask_targets(docs).select("doc_id", "category", "mask_path")


@query(
    "role_counts",
    f"""WITH {FILES}, {ROUTED}, p AS (SELECT dataset, size_bytes, category, CASE m WHEN 1 THEN 'train' WHEN 2 THEN 'test' WHEN 0 THEN 'ground_truth' ELSE 'other' END AS role FROM clean)
        SELECT dataset, count(DISTINCT category) AS categories, count(*) FILTER (WHERE size_bytes > 0 AND role = 'train') AS train_good, count(*) FILTER (WHERE size_bytes > 0 AND role = 'test') AS test_images,
          count(*) FILTER (WHERE size_bytes > 0 AND role = 'ground_truth') AS ground_truth, count(*) FILTER (WHERE size_bytes = 0) AS corrupt, count(*) FILTER (WHERE size_bytes = 0) = 0 AS passed FROM p GROUP BY dataset""",
)
def _roles(spark, sf_dir):
    role = F.expr("CASE n_chars % 4 WHEN 1 THEN 'train/good' WHEN 2 THEN 'test/bad' WHEN 0 THEN 'ground_truth/bad' ELSE 'other/x' END")
    files = L.route_inspection_files(table(spark, sf_dir, "documents").selectExpr(*FILE_COLUMNS, "n_chars"))
    return L.role_counts(files.withColumn("path", F.concat_ws("/", "category", role, X.base_name(F.col("path")))))


@query(
    "dataset_count_differences",
    f"""WITH {FILES}, r AS (SELECT dataset, count(*) AS n FROM files WHERE source NOT IN ('src3', 'src5') AND n_chars % 5 <> 4 GROUP BY 1),
        p AS (SELECT dataset, count(*) AS n FROM files WHERE source NOT IN ('src3', 'src5') AND n_chars % 5 <> 4 AND n_chars % 4 <> 3 AND lang <> 'fr' GROUP BY 1)
        SELECT dataset, coalesce(r.n, 0) AS raw, coalesce(p.n, 0) AS processed, coalesce(r.n, 0) - coalesce(p.n, 0) AS difference FROM r FULL JOIN p USING (dataset)""",
)
def _differences(spark, sf_dir):
    raw = file_view(spark, sf_dir)
    processed = raw.where(~F.col("path").contains("/other/") & (F.col("dataset") != "set_fr"))
    return L.count_differences(L.dataset_counts(raw), L.dataset_counts(processed))


# --- samples ---------------------------------------------------------------------------------------

STAGED = """
st AS (SELECT *, class AS category, CASE WHEN mask_path IS NULL THEN 'train' WHEN quality = 1 THEN 'val' ELSE 'test' END AS split,
              CASE WHEN is_toxic THEN defect_type ELSE 'good' END AS label, is_toxic AS is_anomalous FROM smp)"""


def staged_view(spark, sf_dir):
    anomalous = F.col("is_toxic")
    return sample_view(spark, sf_dir).withColumns(
        {
            "category": F.col("class"),
            "split": F.when(F.col("mask_path").isNull(), "train").when(F.col("quality") == 1, "val").otherwise("test"),
            "label": F.when(anomalous, F.col("defect_type")).otherwise("good"),
            "is_anomalous": anomalous,
        }
    )


@query(
    "split_stats",
    f"""WITH {SAMPLES}, {STAGED}, c AS (SELECT category, split, label, count(*) AS n, count(*) FILTER (WHERE NOT is_anomalous) AS normal FROM st GROUP BY ALL)
        SELECT category, split, sum(n)::BIGINT AS total, sum(normal)::BIGINT AS normal, (sum(n) - sum(normal))::BIGINT AS anomalous, string_agg(label || '=' || n, ',' ORDER BY label) AS by_class FROM c GROUP BY ALL""",
)
def _stats(spark, sf_dir):
    text = F.array_join(F.transform(F.map_entries("by_class"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return L.split_stats(staged_view(spark, sf_dir)).withColumn("by_class", text)


@query(
    "dataset_split_totals",
    f"""WITH {SAMPLES}, {STAGED} SELECT defect_type AS dataset, count(DISTINCT category) AS num_categories, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
        count(*) FILTER (WHERE split = 'test') AS test FROM st GROUP BY ROLLUP (defect_type)""",
)
def _split_totals(spark, sf_dir):
    return L.dataset_totals(staged_view(spark, sf_dir).withColumn("dataset", F.col("defect_type")))


@query(
    "conversion_summary",
    f"""WITH {SAMPLES} SELECT class AS part, count(*) AS total_images, count(*) FILTER (WHERE n_chars % 6 <> 0 AND is_toxic) AS defective_images, count(*) FILTER (WHERE n_chars % 6 <> 0 AND NOT is_toxic) AS normal_images,
        count(*) FILTER (WHERE n_chars % 6 <> 0) AS masks_written, count(*) FILTER (WHERE n_chars % 6 = 0) AS skipped_missing_source FROM smp GROUP BY ROLLUP (class)""",
)
def _conversion(spark, sf_dir):
    rows = sample_view(spark, sf_dir).select(F.col("class").alias("part"), (F.col("n_chars") % 6 != 0).alias("has_frame"), F.col("is_toxic").alias("is_defective"))
    return L.conversion_summary(rows)


@query(
    "full_test_check",
    f"""WITH {SAMPLES} SELECT class, count(*) FILTER (WHERE NOT is_toxic) AS total_normal, count(*) FILTER (WHERE is_toxic) AS total_anomalous,
        max(CASE WHEN is_toxic AND n_chars % 3 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS max_mask_value FROM smp WHERE mask_path IS NOT NULL GROUP BY class""",
)
def _test_check(spark, sf_dir):
    return test_check_view(spark, sf_dir)


def test_check_view(spark, sf_dir):
    entries = sample_view(spark, sf_dir).where("mask_path IS NOT NULL").select(
        "class", F.col("is_toxic").alias("is_anomalous"), F.when(F.col("is_toxic") & (F.col("n_chars") % 3 == 0), F.col("n_chars") + 1).alias("mask_area")
    )
    return L.full_test_check(entries, ["class"])


@query(
    "dataset_health",
    f"""WITH {SAMPLES}, t AS (SELECT class, count(*) FILTER (WHERE NOT is_toxic) AS n, count(*) FILTER (WHERE is_toxic) AS a, count(*) FILTER (WHERE is_toxic AND n_chars % 3 = 0) AS m
          FROM smp WHERE mask_path IS NOT NULL GROUP BY class)
        SELECT class, 'no anomalous images' AS rule FROM t WHERE a = 0 UNION ALL SELECT class, 'no normal images' FROM t WHERE n = 0 UNION ALL SELECT class, 'all masks are zero' FROM t WHERE a > 0 AND m = 0""",
)
def _health(spark, sf_dir):
    return V.violations(test_check_view(spark, sf_dir), ["class"], V.health_rules())


# Masks lie in one of seven places, or nowhere, by text length.
PLACES = """
img AS (SELECT doc_id, source, lang, n_chars, 'p/' || source AS cat, 'p' AS ds FROM documents),
inv AS (SELECT doc_id, CASE n_chars % 8 WHEN 0 THEN cat || '/ground_truth/' || lang || '/' || doc_id || '.png' WHEN 1 THEN cat || '/ground_truth/' || lang || '/' || doc_id || '_mask.png'
   WHEN 2 THEN cat || '/ground_truth/defects/' || doc_id || '.png' WHEN 3 THEN cat || '/ground_truth/' || doc_id || '.png' WHEN 4 THEN ds || '/ground_truth/defects/' || doc_id || '.png'
   WHEN 5 THEN ds || '/ground_truth/' || lang || '/' || doc_id || '.png' WHEN 6 THEN ds || '/ground_truth/' || doc_id || '.png' END AS path FROM img)"""


@query("found_masks", f"WITH {PLACES} SELECT doc_id, path AS mask_path FROM inv")
def _found(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang AS label", "n_chars", "'p/' || source AS category_dir", "'p' AS dataset_dir",
        "'p/' || source || '/test/' || lang || '/' || CAST(doc_id AS STRING) || '.bmp' AS image_path",
    )
    number = "CAST(doc_id AS STRING)"
    places = docs.selectExpr(
        f"""CASE n_chars % 8 WHEN 0 THEN category_dir || '/ground_truth/' || label || '/' || {number} || '.png' WHEN 1 THEN category_dir || '/ground_truth/' || label || '/' || {number} || '_mask.png'
        WHEN 2 THEN category_dir || '/ground_truth/defects/' || {number} || '.png' WHEN 3 THEN category_dir || '/ground_truth/' || {number} || '.png' WHEN 4 THEN dataset_dir || '/ground_truth/defects/' || {number} || '.png'
        WHEN 5 THEN dataset_dir || '/ground_truth/' || label || '/' || {number} || '.png' WHEN 6 THEN dataset_dir || '/ground_truth/' || {number} || '.png' END AS path"""
    ).where("path IS NOT NULL")
    return L.find_masks(docs, places).select("doc_id", "mask_path")


def flat_views(spark, sf_dir):
    """Flat masks named by document; images named with or without a camera suffix."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    masks = docs.select("doc_id", F.concat(F.lit("ground_truth/defects/s"), number, F.when(F.col("n_chars") % 3 == 0, "_gt").otherwise(""), F.lit(".png")).alias("path"))
    images = docs.where("n_chars % 4 <> 0").select(
        F.col("source").alias("category"),
        F.concat_ws("/", "source", F.lit("test"), "lang", F.concat(F.lit("s"), number, F.when(F.col("n_chars") % 2 == 0, "_leftImg8bit").otherwise(""), F.lit(".bmp"))).alias("path"),
    )
    return masks, images


FLAT = """
fl AS (SELECT doc_id, source, n_chars % 4 <> 0 AS has, 's' || doc_id || CASE WHEN n_chars % 2 = 0 THEN '_leftImg8bit' ELSE '' END AS stem, n_chars FROM documents),
rt AS (SELECT doc_id, n_chars, CASE WHEN has THEN source END AS category, CASE WHEN has THEN source || '/ground_truth/' || source || '/' || stem || '.png' END AS dst_path FROM fl)"""


@query("routed_masks", f"WITH {FLAT} SELECT doc_id, category, dst_path FROM rt")
def _routed_masks(spark, sf_dir):
    return L.route_masks(*flat_views(spark, sf_dir)).select("doc_id", "category", "dst_path")


@query(
    "routing_summary",
    f"""WITH {FLAT} SELECT category, count(*) AS total_masks, count(*) FILTER (WHERE n_chars % 5 = 0) AS already_present, count(*) FILTER (WHERE n_chars % 5 <> 0) AS to_copy
        FROM rt WHERE category IS NOT NULL GROUP BY category""",
)
def _routing_summary(spark, sf_dir):
    plan = L.route_masks(*flat_views(spark, sf_dir))
    lengths = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    present = plan.join(lengths, "doc_id").where("n_chars % 5 = 0 AND dst_path IS NOT NULL").select(F.col("dst_path").alias("path"))
    return L.routing_summary(plan, present)


@query(
    "kept_masks",
    """WITH m AS (SELECT o_orderkey, o_orderpriority AS category, 'gt/' || o_orderkey || '/' || 'mask_' || o_custkey || '.png' AS path, o_custkey AS stem FROM orders),
       t AS (SELECT DISTINCT o_orderpriority AS category, o_custkey AS stem FROM orders WHERE o_orderstatus = 'F'),
       k AS (SELECT category, stem, min(path COLLATE "C") AS path FROM m JOIN t USING (category, stem) GROUP BY ALL)
       SELECT o_orderkey, CASE WHEN k.path IS NOT NULL THEN 'keep' ELSE 'delete' END AS action FROM m LEFT JOIN k USING (category, path)""".replace(' COLLATE "C"', ""),
)
def _kept(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    masks = orders.select(
        "o_orderkey", F.col("o_orderpriority").alias("category"),
        F.format_string("gt/%d/mask_%d.png", "o_orderkey", "o_custkey").alias("path"),
    )
    tests = orders.select(
        F.col("o_orderpriority").alias("category"),
        F.concat(F.when(F.col("o_orderstatus") == "F", "test/bad/").otherwise("test/good/"), F.col("o_custkey").cast("string"), F.lit(".png")).alias("path"),
    )
    return L.keep_one_mask(masks, tests, strip_marks=True, skip_good=True).select("o_orderkey", "action")


@query(
    "positional_pairs",
    """WITH b AS (SELECT 'img_' || md5(url) || '.bmp' AS f FROM pages), j AS (SELECT 'img_' || md5(html || page_id) || '.json' AS f FROM pages WHERE url LIKE 'https%'),
       x AS (SELECT f AS "left", row_number() OVER (ORDER BY f) AS position FROM b), y AS (SELECT f AS "right", row_number() OVER (ORDER BY f) AS position FROM j)
       SELECT position, "left", "right" FROM x JOIN y USING (position)""",
)
def _positional(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    bitmaps = pages.select(F.concat(F.lit("img_"), F.md5("url"), F.lit(".bmp")).alias("path"))
    documents = pages.where(F.col("url").startswith("https")).select(
        F.concat(F.lit("img_"), F.md5(F.concat("html", F.col("page_id").cast("string"))), F.lit(".json")).alias("path")
    )
    return L.pair_by_position(bitmaps, documents)


@query(
    "attached_defect_types",
    f"""WITH {SAMPLES} SELECT image_path, CASE WHEN is_toxic THEN defect_type || ';' || class END AS types FROM smp""",
)
def _attached(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    lookup = samples.where("is_toxic").select(X.base_name(F.col("image_path")).alias("image_filename"), F.array("defect_type", "class").alias("defect_types"))
    return L.attach_defect_types(samples, lookup).select("image_path", F.array_join("defect_types", ";").alias("types"))


@query("named_stems", "SELECT o_orderkey FROM orders WHERE o_custkey IN (7, 77, 97, 101)")
def _stems(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a/b/"), F.col("o_custkey").cast("string"), F.lit(".json")).alias("path"))
    return L.with_stems(files, ["7", "77", "97", "101"]).select("o_orderkey")


@query(
    "inventory_filters",
    """SELECT page_id, CASE WHEN length(url) % 4 = 0 THEN 'flat mask' WHEN length(url) % 4 = 1 THEN 'test image' END AS kind FROM pages WHERE length(url) % 4 IN (0, 1)""",
)
def _inventory_filters(spark, sf_dir):
    number = F.col("page_id").cast("string")
    path = (
        F.when(F.length("url") % 4 == 0, F.concat(F.lit("ground_truth/defects/"), number, F.lit(".png")))
        .when(F.length("url") % 4 == 1, F.concat(F.lit("cat/test/bad/"), number, F.lit(".BMP")))
        .when(F.length("url") % 4 == 2, F.concat(F.lit("cat/test/good/"), number, F.lit(".png")))
        .otherwise(F.concat(F.lit("cat/test/bad/"), number, F.lit(".txt")))
    )
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    masks = L.flat_masks(files).select("page_id", F.lit("flat mask").alias("kind"))
    return masks.unionByName(L.category_test_images(files).select("page_id", F.lit("test image").alias("kind")))


@query("test_defect_folders", "SELECT DISTINCT source AS category, lang AS folder FROM documents WHERE lang <> 'en'")
def _folders(spark, sf_dir):
    lang = F.when(F.col("lang") == "en", "Good").otherwise(F.col("lang"))
    files = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lit("test"), lang, F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias("path"))
    return L.test_defect_folders(files)


@query(
    "mask_layouts",
    f"""WITH {SAMPLES} SELECT class AS category, 'data/processed/' || class AS root, CASE WHEN class LIKE 'src1%' THEN 'ground_truth' WHEN class IN ('src2', 'src3') THEN 'ground_truth/defects' END AS mask_dir,
        CASE WHEN class LIKE 'src1%' THEN 'category' WHEN class IN ('src2', 'src3') THEN 'dataset' ELSE 'none' END AS level FROM smp WHERE mask_path IS NULL GROUP BY class""",
)
def _layouts(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    dataset_level = F.col("class").isin("src2", "src3")
    number = F.concat(F.col("doc_id").cast("string"), F.lit(".png"))
    staged = samples.select(
        F.col("class").alias("category"), F.when(F.col("mask_path").isNull(), "train").otherwise("test").alias("split"),
        F.concat_ws("/", F.lit("data/processed"), "class", F.lit("x/good"), number).alias("image_path"),
        F.when(dataset_level & F.col("mask_path").isNotNull(), F.concat(F.lit("data/processed/ground_truth/defects/"), number)).otherwise(F.col("mask_path")).alias("mask_path"),
    )
    inventory = staged.where(F.col("category").startswith("src1") | F.col("category").isin("src2", "src3")).where("mask_path IS NOT NULL").select(F.col("mask_path").alias("path"))
    return L.mask_layout(staged, inventory)


# --- corpus ------------------------------------------------------------------------------------------

SELECTION = """
sel AS (SELECT doc_id, uid, class, defect_type, image_path, mask_path, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE mask_path END AS mp, n_chars FROM uids WHERE is_toxic)"""


def selection_view(spark, sf_dir):
    from defectspark.catalog.splits import with_uid

    samples = with_uid(sample_view(spark, sf_dir)).withColumn("is_anomalous", F.col("is_toxic"))
    staged = samples.withColumn("mask_path", F.when(F.col("n_chars") % 3 != 0, F.col("mask_path")))
    inventory = samples.where("n_chars % 5 <> 0 AND mask_path IS NOT NULL").select(F.col("mask_path").alias("path"))
    return L.corpus_selection(staged, inventory)


@query(
    "corpus_selection",
    f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'null mask_path' WHEN n_chars % 5 = 0 THEN 'missing mask file: ' || mask_path END AS skip_reason FROM smp WHERE is_toxic""",
)
def _selection(spark, sf_dir):
    return selection_view(spark, sf_dir).select("doc_id", "skip_reason")


@query(
    "corpus_counts",
    f"""WITH {SAMPLES}, s AS (SELECT CASE WHEN n_chars % 3 = 0 OR n_chars % 5 = 0 THEN 'skipped' ELSE 'selected' END AS outcome FROM smp WHERE is_toxic) SELECT outcome, count(*) AS n FROM s GROUP BY ROLLUP (outcome)""",
)
def _counts(spark, sf_dir):
    outcome = F.when(F.col("skip_reason").isNull(), "selected").otherwise("skipped")
    return selection_view(spark, sf_dir).withColumn("outcome", outcome).rollup("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(
    "paths_outside_root",
    f"""WITH {SAMPLES} SELECT doc_id, 'data/processed/../' || class AS path FROM smp WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, 'data/raw/' || doc_id FROM smp WHERE n_chars % 5 = 0""",
)
def _outside(spark, sf_dir):
    samples = sample_view(spark, sf_dir).select(
        "doc_id", F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("data/processed/../"), "class")).otherwise(F.col("image_path")).alias("image_path"),
        F.when(F.col("n_chars") % 5 == 0, F.concat(F.lit("data/raw/"), F.col("doc_id").cast("string"))).otherwise(F.col("mask_path")).alias("mask_path"),
    )
    return L.outside_root(samples, ["image_path", "mask_path"], "data/processed", ["doc_id"])


@query("missing_files", f"WITH {SAMPLES} SELECT doc_id FROM smp WHERE mask_path IS NOT NULL AND n_chars % 5 = 0")
def _missing(spark, sf_dir):
    samples = sample_view(spark, sf_dir).where("mask_path IS NOT NULL")
    inventory = samples.where("n_chars % 5 <> 0").select(F.col("mask_path").alias("path"))
    return V.missing_files(samples, inventory, "mask_path").select("doc_id")


@query(
    "samples_from_inventory",
    """SELECT source AS category, CASE WHEN n_chars % 3 = 0 THEN 'train' ELSE 'test' END AS source_split, CASE WHEN n_chars % 3 <> 2 THEN 'good' ELSE lang END AS label,
         n_chars % 3 = 2 AS is_anomalous, doc_id FROM documents WHERE source NOT IN ('src9') AND n_chars % 5 IN (0, 1, 2)""",
)
def _inventory_samples(spark, sf_dir):
    label = F.when(F.col("n_chars") % 3 == 0, "train/good").when(F.col("n_chars") % 3 == 1, "test/good").otherwise(F.concat(F.lit("test/"), "lang"))
    category = F.when(F.col("source") == "src9", "ground_truth").otherwise(F.col("source"))
    name = F.concat(F.col("doc_id").cast("string"), F.expr(EXT))
    files = table(spark, sf_dir, "documents").select(F.lit("d").alias("dataset"), F.concat_ws("/", category, label, name).alias("path"))
    return L.samples_from_inventory(files).select(
        "category", "source_split", "label", "is_anomalous", X.file_stem(X.base_name(F.col("image_path"))).cast("long").alias("doc_id")
    )


@query(
    "normalized_stems",
    """SELECT o_orderkey, 'f' || o_custkey AS stem FROM orders""",
)
def _norm(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in X.STEM_SUFFIXES]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    tail = F.when(F.col("o_orderkey") % 2 == 0, ".PNG").otherwise("")
    stems = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("f"), F.col("o_custkey").cast("string"), suffix, tail).alias("s"))
    return stems.select("o_orderkey", X.normalized_stem(F.col("s")).alias("stem"))


@query("part_names", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lb' || p_size ELSE 'annotations_' || p_size END AS part FROM part")
def _parts(spark, sf_dir):
    stem = F.concat(F.lit("annotations_"), F.when(F.col("p_size") % 2 == 0, "lb").otherwise(""), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", X.part_name(stem).alias("part"))
