"""Mask, geometry and report queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.catalog.registry import query, table
from defectspark.catalog.views import BOX, PX, RUNS, TRI, mask_view, shape_view
from defectspark.operators import masks as M
from defectspark.operators import polygons as P
from defectspark.operators import reports as R
from defectspark.operators import validate as V
from defectspark.sources import annotations as A

# --- comparison helpers ---------------------------------------------------------------


def moments(df: DataFrame, *keys: str) -> DataFrame:
    """Area and coordinate sums of mask rows: equal sums mean equal pixels in practice."""
    total = lambda f: F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + f(r))
    length = lambda r: (r["x1"] - r["x0"] + 1).cast("long")
    twice = lambda r: (r["x0"] + r["x1"]) * length(r)
    return df.select(
        *keys,
        total(length).alias("area"),
        F.floor(total(twice) / 2).alias("sum_x"),
        total(lambda r: r["y"] * length(r)).alias("sum_y"),
        F.floor(total(lambda r: r["y"] * twice(r)) / 2).alias("sum_xy"),
    )


def run_moments(runs: DataFrame, *keys: str) -> DataFrame:
    length = (F.col("x1") - F.col("x0") + 1).cast("long")
    twice = (F.col("x0") + F.col("x1")) * length
    return runs.groupBy(*keys).agg(
        F.sum(length).alias("area"),
        F.floor(F.sum(twice) / 2).alias("sum_x"),
        F.sum(F.col("y") * length).alias("sum_y"),
        F.floor(F.sum(F.col("y") * twice) / 2).alias("sum_xy"),
    )


MOMENTS = """count(x) AS area, coalesce(sum(x), 0)::BIGINT AS sum_x, coalesce(sum(y), 0)::BIGINT AS sum_y,
       coalesce(sum(x * y), 0)::BIGINT AS sum_xy"""


def flat_facts(df: DataFrame, *keys: str) -> DataFrame:
    box = F.col("bounding_box")
    return df.select(
        *keys,
        "defect_present",
        *[F.get(box, i).cast("long").alias(n) for i, n in enumerate(["box_x", "box_y", "box_w", "box_h"])],
        F.round(F.get("centroid", 0), 6).alias("centroid_x"),
        F.round(F.get("centroid", 1), 6).alias("centroid_y"),
        F.round("area_pct", 6).alias("area_pct"),
        "region",
        "severity_level",
    )


# --- grounding -------------------------------------------------------------------------

FACTS = (
    "WITH RECURSIVE "
    + PX
    + """,
reach(image_id, y, x, root) AS (
  SELECT image_id, y, x, y * 8 + x FROM px
  UNION
  SELECT p.image_id, p.y, p.x, r.root FROM reach r JOIN px p
    ON p.image_id = r.image_id AND abs(p.y - r.y) <= 1 AND abs(p.x - r.x) <= 1),
lab AS (SELECT image_id, y, x, min(root) AS root FROM reach GROUP BY ALL),
part AS (SELECT image_id, root, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM lab GROUP BY image_id, root
         QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, root) = 1),
ext AS (SELECT img.image_id, img.label, count(x) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1
        FROM img LEFT JOIN px USING (image_id) GROUP BY ALL),
facts AS (SELECT ext.image_id, 'class_' || ext.label AS class, 'type_' || ext.label AS defect_type,
       area > 0 AS defect_present, x0 AS box_x, y0 AS box_y, x1 - x0 + 1 AS box_w, y1 - y0 + 1 AS box_h,
       round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y, round(100.0::DOUBLE * area / 64, 6) AS area_pct,
       CASE WHEN area > 0 THEN ['upper-left quadrant', 'top edge', 'upper-right quadrant', 'left edge', 'centre', 'right edge',
        'lower-left quadrant', 'bottom edge', 'lower-right quadrant'][
          3 * least(floor(3 * cy / 8), 2)::INT + least(floor(3 * cx / 8), 2)::INT + 1] END AS region,
       CASE WHEN area = 0 THEN 'none' WHEN 100.0 * area / 64 < CASE WHEN ext.label = 3 THEN 8 ELSE 5 END THEN 'minor'
            WHEN 100.0 * area / 64 < CASE WHEN ext.label = 7 THEN 11 ELSE 10 END THEN 'moderate' ELSE 'severe' END AS severity_level
     FROM ext LEFT JOIN part USING (image_id))"""
)
CUTOFFS = (5.0, 10.0)
OVERRIDES = {"type_3": (8.0, None), "type_7": (None, 11.0)}


def facts_view(spark, sf_dir: str) -> DataFrame:
    return M.ground_masks(mask_view(spark, sf_dir), "defect_type", CUTOFFS, OVERRIDES)


@query("grounded_facts", FACTS + " SELECT * EXCLUDE (class, defect_type) FROM facts")
def _grounded(spark, sf_dir):
    return flat_facts(facts_view(spark, sf_dir), "image_id")


@query("grounded_facts_from_runs", FACTS + " SELECT * EXCLUDE (class, defect_type) FROM facts")
def _grounded_runs(spark, sf_dir):
    """The same facts from run rows: one shuffle, keyed by image."""
    masks = mask_view(spark, sf_dir)
    images = masks.select("image_id", "defect_type", "height", "width")
    rebuilt = M.collect_masks(M.explode_runs(masks), images)
    return flat_facts(M.ground_masks(rebuilt, "defect_type", CUTOFFS, OVERRIDES), "image_id")


DESCRIPTION = "{class_name} shows {defect_type}: {region}, {affected_area_pct:.2f}% covered."
RATIONALE = "Graded {severity_level}: {defect_type} covers {affected_area_pct:.2f}%."
CONFIDENCE = "Sample text; check by eye."
REASON = "Inspect the {region} to verify the {severity_level} {defect_type}."


def template_view(spark, sf_dir: str) -> DataFrame:
    """One template per (class, defect type) found in the vectors."""
    labels = table(spark, sf_dir, "embeddings").select("label").distinct()
    return labels.select(
        F.concat(F.lit("class_"), "label").alias("class"),
        F.concat(F.lit("type_"), "label").alias("defect_type"),
        F.lit(DESCRIPTION).alias("description_template"),
        F.lit("inspect").alias("action"),
        F.lit(REASON).alias("reason_template"),
    )


def reports_view(spark, sf_dir: str) -> DataFrame:
    return R.full_reports(facts_view(spark, sf_dir), template_view(spark, sf_dir), RATIONALE, CONFIDENCE)


# Percentages of 64 pixels have at most six binary digits; ties go to the even digit.
PCT = "printf('%.2f', round_even(area_pct, 2))"


@query(
    "defect_reports",
    FACTS
    + f""" SELECT image_id, defect_type, defect_present, coalesce(region, 'None') AS region, severity_level,
   class || ' shows ' || defect_type || ': ' || coalesce(region, 'None') || ', ' || {PCT} || '% covered.' AS description,
   'Graded ' || severity_level || ': ' || defect_type || ' covers ' || {PCT} || '%.' AS rationale,
   'inspect' AS action, 'Inspect the ' || coalesce(region, 'None') || ' to verify the ' || severity_level || ' ' || defect_type || '.' AS reason,
   0 AS n_violations FROM facts""",
)
def _reports(spark, sf_dir):
    """Flagship: masks to facts to validated report rows, without a shuffle of masks."""
    rules = {**V.report_rules(), **V.empty_text_rules(), **V.action_rule()}
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )
    r = F.col("report")
    return reports_view(spark, sf_dir).select(
        "image_id",
        r["defect_type"].alias("defect_type"),
        r["defect_present"].alias("defect_present"),
        F.coalesce(r["location"]["region"], F.lit("None")).alias("region"),
        r["severity"]["level"].alias("severity_level"),
        r["description"].alias("description"),
        r["severity"]["rationale"].alias("rationale"),
        r["recommended_action"]["action"].alias("action"),
        r["recommended_action"]["reason"].alias("reason"),
        F.size(broken).alias("n_violations"),
    )


@query(
    "skeleton_reports",
    FACTS + " SELECT image_id, defect_type, severity_level, 'inspect' AS action, '' AS description FROM facts",
)
def _skeleton(spark, sf_dir):
    r = F.col("report")
    return R.skeleton_reports(facts_view(spark, sf_dir)).select(
        "image_id",
        r["defect_type"].alias("defect_type"),
        r["severity"]["level"].alias("severity_level"),
        r["recommended_action"]["action"].alias("action"),
        r["description"].alias("description"),
    )


@query(
    "report_violations",
    FACTS
    + """ SELECT image_id, unnest(list_filter([
      CASE WHEN NOT defect_present AND region IS NULL THEN 'no defect needs level none' END,
      CASE WHEN defect_present AND severity_level = 'minor' THEN 'region enum' END,
      CASE WHEN defect_present AND box_w = 8 THEN 'bounding_box minimum' END], lambda v: v IS NOT NULL)) AS rule FROM facts""",
)
def _report_violations(spark, sf_dir):
    """Broken on purpose: wrong level on empty masks, unknown region, negative box."""
    r = F.col("report")
    minor = r["defect_present"] & (r["severity"]["level"] == "minor")
    wide = r["defect_present"] & (F.get(r["location"]["bounding_box"], 2) == 8)
    broken = r.withField(
        "severity.level", F.when(~r["defect_present"], "severe").otherwise(r["severity"]["level"])
    )
    broken = broken.withField(
        "location.region", F.when(minor, "nowhere").otherwise(r["location"]["region"])
    )
    broken = broken.withField(
        "location.bounding_box",
        F.when(wide, F.array(F.lit(-1), F.lit(0), F.lit(8), F.lit(1))).otherwise(r["location"]["bounding_box"]),
    )
    return V.violations(
        reports_view(spark, sf_dir).withColumn("report", broken), ["image_id"], V.report_rules()
    )


# --- runs and shapes --------------------------------------------------------------------


@query("raster_runs", "WITH " + RUNS + " SELECT image_id, y, x0, x1 FROM runs")
def _raster_runs(spark, sf_dir):
    return M.explode_runs(mask_view(spark, sf_dir))


# Interior by even-odd crossings and outline by nearest line, over any table of edges.
FILL = """
lines AS (SELECT e.*, unnest(range(greatest(least(ya, yb), 0)::BIGINT, least(greatest(ya, yb), h - 1)::BIGINT + 1)) AS y FROM edges e),
cuts AS (SELECT image_id, shape_no, y, xa + (y - ya) * (xb - xa) / (yb - ya) AS cx FROM lines
         WHERE least(ya, yb) <= y AND y < greatest(ya, yb)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, shape_no, y ORDER BY cx) AS k,
                  lead(cx) OVER (PARTITION BY image_id, shape_no, y ORDER BY cx) AS nx FROM cuts),
inside AS (SELECT image_id, shape_no, y, ceil(cx) AS x0, floor(nx) AS x1 FROM ranked WHERE k % 2 = 1),
spans AS (SELECT image_id, shape_no, y,
    CASE WHEN ya = yb THEN xa ELSE xa + (greatest(y - 0.5, least(ya, yb)) - ya) * (xb - xa) / (yb - ya) END AS p,
    CASE WHEN ya = yb THEN xb ELSE xa + (least(y + 0.5, greatest(ya, yb)) - ya) * (xb - xa) / (yb - ya) END AS q FROM lines),
border AS (SELECT image_id, shape_no, y, floor(least(p, q) + 0.5) AS x0, floor(greatest(p, q) + 0.5) AS x1 FROM spans)"""
TRI_EDGES = (
    TRI
    + """,
edges AS (SELECT image_id, shape_no, 64 AS h, u1 AS xa, v1 AS ya, u2 AS xb, v2 AS yb FROM tri
  UNION ALL SELECT image_id, shape_no, 64, u2, v2, u3, v3 FROM tri
  UNION ALL SELECT image_id, shape_no, 64, u3, v3, u1, v1 FROM tri)"""
)
PIXELS = """
cover AS (SELECT DISTINCT {keys}, y, unnest(range(greatest(x0, 0)::BIGINT, least(x1, {w} - 1)::BIGINT + 1)) AS x
          FROM ({src}) WHERE x0 <= x1)"""


@query(
    "polygon_interior",
    f"WITH {TRI_EDGES}, {FILL}, "
    + PIXELS.format(keys="image_id, shape_no", w=64, src="SELECT * FROM inside")
    + f" SELECT image_id, shape_no, {MOMENTS} FROM cover GROUP BY ALL",
)
def _polygon_interior(spark, sf_dir):
    return run_moments(P.shape_runs(shape_view(spark, sf_dir), outline=False), "image_id", "shape_no")


@query(
    "shape_masks",
    f"WITH {TRI_EDGES}, {FILL}, "
    + PIXELS.format(keys="image_id", w=64, src="SELECT * FROM inside UNION ALL SELECT * FROM border")
    + f" SELECT image_id, {MOMENTS} FROM cover GROUP BY ALL",
)
def _shape_masks(spark, sf_dir):
    """Polygon fill plus outline, then the union of all shapes of an image."""
    return run_moments(P.shape_masks(shape_view(spark, sf_dir)), "image_id")


@query(
    "rectangle_shapes",
    f"WITH {TRI}, "
    + PIXELS.format(
        keys="image_id, shape_no",
        w=64,
        src="""SELECT image_id, shape_no, unnest(range(least(v1, v2)::BIGINT, greatest(v1, v2)::BIGINT + 1)) AS y,
               least(u1, u2) AS x0, greatest(u1, u2) AS x1 FROM tri""",
    )
    + f" SELECT image_id, shape_no, {MOMENTS} FROM cover GROUP BY ALL",
)
def _rectangles(spark, sf_dir):
    shapes = shape_view(spark, sf_dir).withColumn("shape_type", F.lit("rectangle"))
    return run_moments(P.shape_runs(shapes), "image_id", "shape_no")


BAND = """
seg AS (SELECT image_id, shape_no, u1, v1, u2, v2, sqrt((u2-u1)*(u2-u1) + (v2-v1)*(v2-v1)) AS n FROM tri),
nrm AS (SELECT *, CASE WHEN n > 0 THEN round(-(v2-v1) / n) ELSE 0 END AS nx, CASE WHEN n > 0 THEN round((u2-u1) / n) ELSE 0 END AS ny FROM seg),
edges AS (SELECT image_id, shape_no, 64 AS h, u1+nx AS xa, v1+ny AS ya, u2+nx AS xb, v2+ny AS yb FROM nrm
  UNION ALL SELECT image_id, shape_no, 64, u2+nx, v2+ny, u2-nx, v2-ny FROM nrm
  UNION ALL SELECT image_id, shape_no, 64, u2-nx, v2-ny, u1-nx, v1-ny FROM nrm
  UNION ALL SELECT image_id, shape_no, 64, u1-nx, v1-ny, u1+nx, v1+ny FROM nrm)"""


@query(
    "line_shapes",
    f"WITH {TRI}, {BAND}, {FILL}, "
    + PIXELS.format(keys="image_id, shape_no", w=64, src="SELECT * FROM inside UNION ALL SELECT * FROM border")
    + f" SELECT image_id, shape_no, {MOMENTS} FROM cover GROUP BY ALL",
)
def _lines(spark, sf_dir):
    shapes = shape_view(spark, sf_dir).withColumn("points", F.slice("points", 1, 2))
    return run_moments(P.shape_runs(shapes), "image_id", "shape_no")


def _json_point(k: Column, dx: int, dy: int) -> Column:
    return F.concat(F.lit("["), (k + dx).cast("string"), F.lit(","), (k + dy).cast("string"), F.lit("]"))


@query(
    "annotation_layouts",
    """WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    SELECT event_id, CASE event_type WHEN 'click' THEN 'shapes' WHEN 'error' THEN 'objects' WHEN 'purchase' THEN 'regions'
             WHEN 'signup' THEN 'list' ELSE 'regions' END AS layout,
       CASE event_type WHEN 'click' THEN 'rectangle' WHEN 'view' THEN 'circle' ELSE 'polygon' END AS shape_type,
       CASE event_type WHEN 'error' THEN 'dent' WHEN 'purchase' THEN 'scratch' WHEN 'click' THEN 'chip' ELSE 'defect' END AS label,
       CASE event_type WHEN 'click' THEN 2 WHEN 'view' THEN 1 WHEN 'error' THEN 3 ELSE 3 END AS n_points,
       CAST(CASE event_type WHEN 'click' THEN 2*k + 4 WHEN 'view' THEN k WHEN 'error' THEN 3*k + 6 ELSE 3*k + 6 END AS DOUBLE) AS sum_x,
       CASE WHEN event_type = 'click' AND k > 0 THEN k ELSE 256 END AS height
    FROM e""",
)
def _layouts(spark, sf_dir):
    """All annotation layouts, nested and flat points, from documents built of event props."""
    k = F.get_json_object("props", "$.k").cast("long")
    pts = lambda *d: F.concat(F.lit("["), F.concat_ws(",", *[_json_point(k, x, y) for x, y in d]), F.lit("]"))
    num = lambda d: (k + d).cast("string")
    text = (
        F.when(
            F.col("event_type") == "click",
            F.concat(
                F.lit('{"shapes":[{"shape_type":"rectangle","label":"chip","points":'), pts((0, 0), (4, 9)),
                F.lit('}],"imageHeight":'), num(0), F.lit(',"imageWidth":77}'),
            ),
        )
        .when(
            F.col("event_type") == "error",
            F.concat(
                F.lit('{"objects":[{"class":"dent","polygon":['),
                F.concat_ws(",", num(0), num(1), num(2), num(3), num(4), num(5)), F.lit("]}]}"),
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                F.lit('{"regions":{"0":{"shape_attributes":{"name":"polygon","all_points_x":['),
                F.concat_ws(",", num(0), num(2), num(4)), F.lit('],"all_points_y":[1,2,3]},"region_attributes":{"label":"scratch"}}}}'),
            ),
        )
        .when(F.col("event_type") == "signup", pts((0, 0), (2, 2), (4, 1)))
        .otherwise(
            F.concat(F.lit('{"regions":[{"shape_attributes":{"name":"circle"},"points":'), pts((0, 3)), F.lit("}]}"))
        )
    )
    docs = A.parse_documents(
        table(spark, sf_dir, "events").select("event_id", "event_type", text.alias("text"))
    )
    sized = A.document_frame_size(docs)
    shapes = A.extract_shapes(sized, ["event_id", "height"])
    return shapes.select(
        "event_id", "layout", "shape_type", "label",
        F.size("points").alias("n_points"),
        F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["x"]).alias("sum_x"),
        "height",
    )


@query(
    "json_structure",
    """SELECT event_type, 'object' AS kind, 'k' AS key_names, count(*) AS n_docs, 0 AS n_images, 0 AS n_annotations
       FROM events GROUP BY event_type""",
)
def _json_structure(spark, sf_dir):
    docs = A.parse_documents(table(spark, sf_dir, "events"), "props")
    return (
        A.json_structure(docs, ["event_type"]).groupBy("event_type", "kind", "key_names")
        .agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("n_images").alias("n_images"),
            F.sum("n_annotations").alias("n_annotations"),
        )
    )


# Three COCO-like annotation forms per order line: flat ring, list of rings, box only.
def coco_view(spark, sf_dir: str) -> DataFrame:
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    a, b = F.get("points", 0), F.get("points", 1)
    return shape_view(spark, sf_dir).select(
        "image_id", "shape_no", "label", "height", "width", "ignore",
        F.when(F.col("label") == "A", flat).alias("flat"),
        F.when(F.col("label") == "N", F.array(flat)).alias("nested"),
        F.array(
            F.least(a["x"], b["x"]), F.least(a["y"], b["y"]),
            F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]),
        ).alias("bbox"),
    )


@query(
    "coco_masks",
    f"""WITH {TRI}, use AS (SELECT * FROM tri WHERE NOT ignored),
    edges AS (SELECT image_id, shape_no, 64 AS h, u1 AS xa, v1 AS ya, u2 AS xb, v2 AS yb FROM use WHERE form <> 'R'
      UNION ALL SELECT image_id, shape_no, 64, u2, v2, u3, v3 FROM use WHERE form <> 'R'
      UNION ALL SELECT image_id, shape_no, 64, u3, v3, u1, v1 FROM use WHERE form <> 'R'
      UNION ALL SELECT image_id, shape_no, 64, least(u1,u2), least(v1,v2), greatest(u1,u2), least(v1,v2) FROM use WHERE form = 'R'
      UNION ALL SELECT image_id, shape_no, 64, greatest(u1,u2), least(v1,v2), greatest(u1,u2), greatest(v1,v2) FROM use WHERE form = 'R'
      UNION ALL SELECT image_id, shape_no, 64, greatest(u1,u2), greatest(v1,v2), least(u1,u2), greatest(v1,v2) FROM use WHERE form = 'R'
      UNION ALL SELECT image_id, shape_no, 64, least(u1,u2), greatest(v1,v2), least(u1,u2), least(v1,v2) FROM use WHERE form = 'R'),
    {FILL}, """
    + PIXELS.format(keys="image_id", w=64, src="SELECT * FROM inside UNION ALL SELECT * FROM border")
    + f" SELECT image_id, {MOMENTS} FROM cover GROUP BY ALL",
)
def _coco_masks(spark, sf_dir):
    """Segmentation as flat list or rings, box when absent, ignored annotations dropped."""
    keys = ["image_id", "shape_no", "height", "width"]
    polygons = A.annotation_polygons(coco_view(spark, sf_dir), keys)
    return run_moments(P.shape_masks(polygons), "image_id")


@query(
    "mask_manifest",
    """SELECT o.o_orderkey AS image_id, count(l.l_orderkey) > 0 AS is_defective,
         coalesce(string_agg(DISTINCT CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'cat_N' END, ';'
             ORDER BY CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE 'cat_N' END)
           FILTER (WHERE NOT (l_linestatus = 'F' AND l_linenumber = 1)), '') AS defect_categories,
         count(l.l_orderkey) AS num_defect_regions,
         count(l.l_orderkey) FILTER (WHERE NOT (l_linestatus = 'F' AND l_linenumber = 1)) AS num_used_regions
       FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""",
)
def _manifest(spark, sf_dir):
    from defectspark.operators.lake import mask_manifest

    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    lines = table(spark, sf_dir, "lineitem")
    annotations = lines.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_returnflag").alias("category_id"),
        F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 1), 1).otherwise(0).alias("ignore"),
    )
    # Two of the three categories have a name.
    flag = F.col("l_returnflag")
    names = lines.where(flag != "N").select(flag.alias("category_id"), F.when(flag == "A", "accepted").otherwise("returned").alias("category_name")).distinct()
    return mask_manifest(images, annotations, names, ["image_id"]).select(
        "image_id", "is_defective", F.array_join("defect_categories", ";").alias("defect_categories"),
        "num_defect_regions", "num_used_regions",
    )


# --- crops and moves ---------------------------------------------------------------------

CROP = (
    BOX
    + """,
fit AS (SELECT *, x_max - x_min + 1 AS bw, y_max - y_min + 1 AS bh,
               x_max - x_min + 1 <= {s} AND y_max - y_min + 1 <= {s} AS fits FROM box),
sq AS (SELECT *, CASE WHEN fits THEN {s} ELSE greatest(bw, bh) END AS side FROM fit),
crop AS (SELECT *, CASE WHEN area = 0 THEN 'empty_mask' WHEN fits AND (w < {s} OR h < {s}) THEN 'frame_too_small'
                WHEN NOT fits AND (side > w OR side > h) THEN 'unfittable_square' END AS reason,
  CASE WHEN fits THEN greatest(0, least(round_even(mean_x - {s} / 2.0, 0)::BIGINT, w - {s}))
       ELSE greatest(greatest(0, x_max - side + 1), least(round_even(mean_x - side / 2.0, 0)::BIGINT, least(x_min, w - side))) END AS crop_x,
  CASE WHEN fits THEN greatest(0, least(round_even(mean_y - {s} / 2.0, 0)::BIGINT, h - {s}))
       ELSE greatest(greatest(0, y_max - side + 1), least(round_even(mean_y - side / 2.0, 0)::BIGINT, least(y_min, h - side))) END AS crop_y
  FROM sq)"""
)


@query(
    "crop_windows",
    "WITH " + CROP.format(s=4)
    + """ SELECT image_id, crop_x, crop_y, CASE WHEN reason IS NULL THEN side END AS crop_w,
          CASE WHEN reason IS NULL THEN NOT fits END AS resized, reason AS drop_reason
          FROM (SELECT * REPLACE (CASE WHEN reason IS NULL THEN crop_x END AS crop_x, CASE WHEN reason IS NULL THEN crop_y END AS crop_y) FROM crop)""",
)
def _crops(spark, sf_dir):
    return M.with_crop(mask_view(spark, sf_dir), 4).select(
        "image_id", "crop.crop_x", "crop.crop_y", "crop.crop_w", "crop.resized", "crop.drop_reason"
    )


@query(
    "crop_eligibility",
    "WITH " + CROP.format(s=9)
    + """ SELECT 'class_' || label AS class, count(*) AS total_pairs, count(*) FILTER (WHERE reason IS NULL) AS usable_pairs,
          count(*) FILTER (WHERE reason = 'unfittable_square') AS excluded_unfittable_square,
          count(*) FILTER (WHERE reason = 'empty_mask') AS excluded_empty_mask,
          count(*) FILTER (WHERE reason = 'frame_too_small') AS excluded_frame_too_small,
          count(reason) AS crop_exclusion_count FROM crop GROUP BY ALL""",
)
def _eligibility(spark, sf_dir):
    return M.crop_eligibility(M.with_crop(mask_view(spark, sf_dir), 9), "class")


GRID = "SELECT unnest(range({n})) AS {c}"
CROPPED = """
tgt AS (SELECT c.image_id, gx, gy,
          CASE WHEN fits THEN crop_x + gx ELSE crop_x + floor((gx + 0.5) * side / 4.0)::BIGINT END AS x,
          CASE WHEN fits THEN crop_y + gy ELSE crop_y + floor((gy + 0.5) * side / 4.0)::BIGINT END AS y
        FROM crop c, (SELECT unnest(range(4)) AS gx) a, (SELECT unnest(range(4)) AS gy) b WHERE reason IS NULL),
cut AS (SELECT t.image_id, t.gx AS x, t.gy AS y FROM tgt t JOIN px p USING (image_id, x, y))"""


@query(
    "cropped_masks",
    "WITH " + CROP.format(s=4) + "," + CROPPED
    + f""" SELECT c.image_id, {MOMENTS} FROM (SELECT image_id FROM crop WHERE reason IS NULL) c
           LEFT JOIN cut USING (image_id) GROUP BY ALL""",
)
def _cropped(spark, sf_dir):
    return moments(M.crop_masks(M.with_crop(mask_view(spark, sf_dir), 4), 4), "image_id")


@query(
    "placed_crop_masks",
    "WITH " + CROP.format(s=4) + "," + CROPPED
    + f""", full_px AS (SELECT c.image_id, crop_x + gx AS x, crop_y + gy AS y FROM crop c, (SELECT unnest(range(8)) AS gx) a, (SELECT unnest(range(8)) AS gy) b
            JOIN cut k ON k.image_id = c.image_id AND k.x = floor((gx + 0.5) * 4.0 / side)::BIGINT AND k.y = floor((gy + 0.5) * 4.0 / side)::BIGINT
            WHERE reason IS NULL AND gx < side AND gy < side)
       SELECT c.image_id, {MOMENTS} FROM (SELECT image_id FROM crop WHERE reason IS NULL) c LEFT JOIN full_px USING (image_id) GROUP BY ALL""",
)
def _placed(spark, sf_dir):
    cropped = M.crop_masks(M.with_crop(mask_view(spark, sf_dir), 4), 4)
    return moments(M.place_crop(cropped, F.lit(8), F.lit(8), F.col("crop")), "image_id")


@query(
    "relocated_crops",
    "WITH " + CROP.format(s=4)
    + """ SELECT image_id, greatest(0, least(round_even((crop_x + side / 2.0) / 8.0 * 13, 0)::BIGINT - side // 2, 13 - side)) AS target_x,
           greatest(0, least(round_even((crop_y + side / 2.0) / 8.0 * 11, 0)::BIGINT - side // 2, 11 - side)) AS target_y,
           side <= 13 AND side <= 11 AS fits FROM crop WHERE reason IS NULL""",
)
def _relocated(spark, sf_dir):
    cropped = M.with_crop(mask_view(spark, sf_dir), 4).where("crop.drop_reason IS NULL")
    moved = M.relocate_crop(cropped, F.col("crop"), F.lit(8), F.lit(8), F.lit(13), F.lit(11))
    return moved.select("image_id", "target_x", "target_y", "fits")


@query(
    "transplanted_masks",
    "WITH " + BOX
    + f""", v AS (SELECT *, CASE WHEN area = 0 THEN 'empty' WHEN label - 1 < 0 THEN 'negative'
             WHEN label - 1 + x_max - x_min + 1 > 12 OR 2 + y_max - y_min + 1 > 10 THEN 'out_of_bounds' END AS violation FROM box),
        mv AS (SELECT p.image_id, p.x - x_min + v.label - 1 AS x, p.y - y_min + 2 AS y FROM px p JOIN v USING (image_id) WHERE violation IS NULL)
        SELECT v.image_id, violation, {MOMENTS} FROM v LEFT JOIN mv USING (image_id) GROUP BY ALL""",
)
def _transplanted(spark, sf_dir):
    masks = mask_view(spark, sf_dir)
    x = F.substring_index("class", "_", -1).cast("int") - 1
    return moments(M.transplant_masks(masks, F.lit(12), F.lit(10), x, F.lit(2)), "image_id", "violation")


@query(
    "dilated_masks",
    "WITH " + PX
    + f""", grown AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM px,
             (SELECT unnest(range(-2, 3)) AS dx) a, (SELECT unnest(range(-2, 3)) AS dy) b
             WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)
       SELECT image_id, {MOMENTS} FROM grown GROUP BY ALL""",
)
def _dilated(spark, sf_dir):
    return run_moments(M.dilate_masks(mask_view(spark, sf_dir), 2), "image_id")


@query(
    "pooled_masks",
    "WITH " + PX
    + """, cells AS (SELECT DISTINCT image_id, gy, gx FROM px, (SELECT unnest(range(3)) AS gx) a, (SELECT unnest(range(3)) AS gy) b
           WHERE x BETWEEN floor(gx * 8 / 3.0) AND ceil((gx + 1) * 8 / 3.0) - 1 AND y BETWEEN floor(gy * 8 / 3.0) AND ceil((gy + 1) * 8 / 3.0) - 1)
        SELECT image_id, gy, gx FROM cells""",
)
def _pooled(spark, sf_dir):
    return M.pool_masks(mask_view(spark, sf_dir), 3, 3).select("image_id", F.inline("cells"))


@query(
    "resized_masks",
    "WITH " + PX
    + f""", tgt AS (SELECT p.image_id, gx AS x, gy AS y FROM px p, (SELECT unnest(range(13)) AS gx) a, (SELECT unnest(range(5)) AS gy) b
            WHERE p.x = floor((gx + 0.5) * 8 / 13.0) AND p.y = floor((gy + 0.5) * 8 / 5.0))
       SELECT i.image_id, {MOMENTS} FROM img i LEFT JOIN tgt USING (image_id) GROUP BY ALL""",
)
def _resized(spark, sf_dir):
    masks = mask_view(spark, sf_dir)
    runs = M.resize_runs(F.col("runs"), F.col("width"), F.col("height"), F.lit(13), F.lit(5))
    return moments(masks.withColumn("runs", runs), "image_id")


@query(
    "object_rectangles",
    "WITH " + BOX
    + """, b AS (SELECT *, x_max - x_min + 1 AS bw, y_max - y_min + 1 AS bh FROM box),
        o AS (SELECT b.image_id, rw FROM b, (SELECT unnest(range(1, 9)) AS rw) r WHERE area > 0 AND rw >= bw
              AND greatest(bh, ceil(ceil(1.2::DOUBLE * bw * bh) / rw)) <= least(8, floor(least(64, floor(4.0::DOUBLE * bw * bh)) / rw)))
        SELECT b.image_id, CASE WHEN area > 0 THEN count(rw) END AS n_widths,
           CASE WHEN area = 0 THEN 'empty' WHEN count(rw) > 0 THEN 'ok' WHEN 64.0 / (bw * bh) < 1.2 THEN 'fallback' ELSE 'infeasible' END AS outcome,
           CASE WHEN count(rw) > 0 THEN true END AS holds_defect
        FROM b LEFT JOIN o USING (image_id) GROUP BY b.image_id, area, bw, bh""",
)
def _rects(spark, sf_dir):
    """Feasible widths and outcome; the seeded rectangle must hold the defect within bounds."""
    rects = M.object_rectangles(M.with_extent(mask_view(spark, sf_dir)).drop("area", "mean_x", "mean_y"))
    area = F.col("rect_w") * F.col("rect_h")
    box = F.col("box_w") * F.col("box_h")
    holds = (
        (F.col("rect_x") <= F.col("x_min")) & (F.col("rect_y") <= F.col("y_min"))
        & (F.col("rect_x") + F.col("rect_w") > F.col("x_max")) & (F.col("rect_y") + F.col("rect_h") > F.col("y_max"))
        & (F.col("rect_x") >= 0) & (F.col("rect_x") + F.col("rect_w") <= 8) & (F.col("rect_y") + F.col("rect_h") <= 8)
        & (area >= 1.2 * box) & (area <= 4.0 * box)
    )
    return rects.select(
        "image_id", F.when(F.col("outcome") != "empty", F.col("n_widths")).alias("n_widths"), "outcome",
        F.when(F.col("outcome") == "ok", holds).alias("holds_defect"),
    )


def composite_view(spark, sf_dir: str) -> DataFrame:
    """Scanlines: the vector under its mask, its reverse elsewhere."""
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("image_id"), "embedding", F.reverse("embedding").alias("clean")
    )
    lines = M.scanlines(vectors, ["image_id"], 8, 8, generated="embedding", clean="clean")
    return M.composite_lines(lines, M.explode_runs(mask_view(spark, sf_dir)), "generated", "clean")


@query(
    "composite_pixels",
    """WITH e AS (SELECT vec_id AS image_id, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b,
                 generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
       SELECT image_id, i // 8 AS y, round(sum((CASE WHEN a > 0.15 THEN a ELSE b END) * (i % 8 + 1)), 5) AS weighted FROM e GROUP BY ALL""",
)
def _composite(spark, sf_dir):
    weighted = F.aggregate(
        F.transform("pixels", lambda p, x: p.cast("double") * (x + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return composite_view(spark, sf_dir).select("image_id", "y", F.round(weighted, 5).alias("weighted"))


@query(
    "composite_invariant",
    """WITH e AS (SELECT vec_id AS image_id, unnest(embedding) AS a, unnest(list_reverse(embedding)) AS b FROM embeddings)
       SELECT 'composite' AS pixels, image_id, 0 AS changed_outside FROM e WHERE false
       UNION ALL
       SELECT 'generated', image_id, count(*) FROM e WHERE NOT a::DOUBLE > 0.15 AND a <> b GROUP BY image_id HAVING count(*) > 0""",
)
def _invariant(spark, sf_dir):
    """No violations for the composite; the plain generated pixels violate it."""
    lines = composite_view(spark, sf_dir)
    good = M.composite_violations(lines, "pixels", "clean").withColumn("pixels", F.lit("composite"))
    bad = M.composite_violations(lines, "generated", "clean").withColumn("pixels", F.lit("generated"))
    return good.unionByName(bad)
