"""Corpus, prompt, record and upsert queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectspark.catalog.masks import CROP, FACTS, PCT, facts_view, reports_view, template_view
from defectspark.catalog.registry import query, table
from defectspark.catalog.views import mask_view
from defectspark.operators import masks as M
from defectspark.operators import metrics as N
from defectspark.operators import reports as R
from defectspark.operators import splits as S
from defectspark.operators import validate as V
from defectspark.sources import reports as IO

# Members: one per image, uid from its key; grounding rows drift on purpose for some.


def members_view(spark, sf_dir):
    number = F.col("image_id").cast("string")
    return reports_view(spark, sf_dir).withColumns(
        {
            "uid": F.concat(F.lit("u"), number), "dataset": F.lit("vectors"),
            "image_path": F.concat(F.lit("img/"), number, F.lit(".png")),
            "mask_path": F.concat(F.lit("gt/"), number, F.lit(".png")),
        }
    )


def records_view(spark, sf_dir):
    """Training records whose grounding disagrees in known ways."""
    members = members_view(spark, sf_dir)
    grounding = R.grounding_rows(members, F.lit("vectors"))
    drifted = grounding.withColumns(
        {
            "area_pct": F.when(F.col("area_pct") > 15, F.col("area_pct") + 1).otherwise(F.col("area_pct")),
            "region": F.when(F.col("severity_level") == "minor", F.lit("centre")).otherwise(F.col("region")),
            "image_path": F.when(F.col("severity_level") == "none", F.lit("img/other.png")).otherwise(F.concat(F.lit("./"), F.col("image_path"))),
            "dataset": F.when(F.col("severity_level") == "moderate", F.lit("elsewhere")).otherwise(F.col("dataset")),
        }
    )
    number = F.col("image_id")
    images = members.where(number % 5 > 0).select(
        F.concat(F.lit("img\\"), number.cast("string"), F.lit(".png")).alias("path"), (number * 3 + 40).alias("width"), (number * 29 + 40).alias("height")
    )
    return R.training_records(R.member_rows(members), drifted, members, images)


@query("grounding_rows", FACTS + " SELECT 'u' || image_id AS uid, class, 'img/' || image_id || '.png' AS image_path, box_x, centroid_y, area_pct, region, severity_level FROM facts")
def _grounding(spark, sf_dir):
    rows = R.grounding_rows(members_view(spark, sf_dir), F.lit("vectors"))
    return rows.select(
        "uid", "class", "image_path", F.get("bounding_box", 0).cast("long").alias("box_x"), F.round(F.get("centroid", 1), 6).alias("centroid_y"),
        F.round("area_pct", 6).alias("area_pct"), "region", "severity_level",
    )


@query(
    "record_disagreements",
    FACTS
    + """ SELECT 'u' || image_id AS uid, 'area differs from the facts' AS rule FROM facts WHERE area_pct > 15
       UNION ALL SELECT 'u' || image_id, 'region differs from the facts' FROM facts WHERE severity_level = 'minor' AND region <> 'centre'
       UNION ALL SELECT 'u' || image_id, 'image path mismatch' FROM facts WHERE severity_level = 'none'
       UNION ALL SELECT 'u' || image_id, 'dataset mismatch' FROM facts WHERE severity_level = 'moderate'""",
)
def _disagreements(spark, sf_dir):
    return V.violations(records_view(spark, sf_dir), ["uid"], V.agreement_rules(F.lit("vectors")))


@query(
    "record_image_sizes",
    """WITH s AS (SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN vec_id * 3 + 40 END AS w, CASE WHEN vec_id % 5 > 0 THEN vec_id * 29 + 40 END AS h FROM embeddings),
       r AS (SELECT *, round_even(w / 28.0::DOUBLE, 0) * 28 AS w0, round_even(h / 28.0::DOUBLE, 0) * 28 AS h0 FROM s),
       b AS (SELECT *, sqrt(w * h / 3211264.0::DOUBLE) AS shrink, sqrt(200704.0::DOUBLE / (w * h)) AS grow FROM r)
       SELECT 'u' || vec_id AS uid, w AS image_width, h AS image_height,
         CASE WHEN w0 * h0 > 3211264 THEN greatest(1, floor(w / shrink / 28)) * greatest(1, floor(h / shrink / 28))
          WHEN w0 * h0 < 200704 THEN ceil(w * grow / 28) * ceil(h * grow / 28) ELSE w0 * h0 / 784 END::BIGINT AS vision_tokens FROM b""",
)
def _record_sizes(spark, sf_dir):
    """Frame and vision tokens of every training record; every fifth image is missing."""
    return records_view(spark, sf_dir).select("uid", "image_width", "image_height", "vision_tokens")


@query(
    "missing_artefacts",
    FACTS
    + """ SELECT 'u' || image_id AS uid, 'grounding' AS missing FROM facts WHERE severity_level = 'severe'
       UNION ALL SELECT 'u' || image_id, 'report' FROM facts WHERE NOT defect_present""",
)
def _missing(spark, sf_dir):
    members = members_view(spark, sf_dir)
    grounding = R.grounding_rows(members, F.lit("vectors")).where("severity_level <> 'severe'")
    return R.missing_artefacts(R.member_rows(members), grounding, members.where("defect_present"))


@query(
    "template_errors",
    FACTS
    + """ SELECT image_id, CASE WHEN class = 'class_9' THEN 'unknown class' WHEN class = 'class_8' THEN 'defect type not configured for class' ELSE 'defect type outside vocabulary' END AS rule
       FROM facts WHERE class IN ('class_7', 'class_8', 'class_9')""",
)
def _template_errors(spark, sf_dir):
    templates = template_view(spark, sf_dir).where("class <> 'class_9'").withColumn(
        "defect_type", F.when(F.col("class") == "class_8", "other").otherwise(F.col("defect_type"))
    )
    vocabulary = templates.where("class <> 'class_7'").select("defect_type")
    return R.template_errors(facts_view(spark, sf_dir), templates, vocabulary, ["image_id"])


@query("unknown_defect_types", FACTS + " SELECT image_id FROM facts WHERE defect_type NOT IN ('type_1', 'type_2', 'type_5')")
def _unknown_types(spark, sf_dir):
    vocabulary = template_view(spark, sf_dir).where("defect_type IN ('type_1', 'type_2', 'type_5')").select("defect_type")
    return V.outside_vocabulary(facts_view(spark, sf_dir), vocabulary, ["defect_type"]).select("image_id")


@query(
    "defect_vocabulary",
    "SELECT source AS dataset, string_agg(DISTINCT lang, ';' ORDER BY lang) AS words FROM documents GROUP BY source",
)
def _vocabulary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("lang").alias("defect_type"))
    return R.defect_vocabulary(rows).select("dataset", F.array_join("words", ";").alias("words"))


SYSTEM = "Describe the defect as one JSON object."
ASK = "Vocabulary and facts follow."
WORDS = "Known types: "
KNOWN = "Measured: "
NOTE = "Only the action inspect is supported."


def prompts_view(spark, sf_dir):
    members = R.prompt_facts(members_view(spark, sf_dir)).withColumn("answer", R.report_json(F.col("report")))
    templates = template_view(spark, sf_dir).select(F.lit("vectors").alias("dataset"), "defect_type")
    return R.prompt_messages(members, R.defect_vocabulary(templates), SYSTEM, ASK, NOTE, WORDS, KNOWN, target="answer")


# Only values with a plain decimal form occur here, so both sides print numbers alike.
@query(
    "report_prompts",
    FACTS
    + f""", v AS (SELECT '["' || string_agg(DISTINCT 'type_' || label, '","' ORDER BY 'type_' || label) || '"]' AS words FROM embeddings)
      SELECT image_id, 'system,user,assistant' AS roles, '{SYSTEM}' || chr(10) || '{ASK}' || chr(10) || '{WORDS}' || words || chr(10) || '{KNOWN}' AS head,
        '"defect_present":' || defect_present || ',"region":' || coalesce('"' || region || '"', 'null') || ',"severity_level":"' || severity_level || '"' AS facts FROM facts, v""",
)
def _prompts(spark, sf_dir):
    text = R.prompt_text(F.col("messages"))
    return prompts_view(spark, sf_dir).select(
        "image_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.regexp_extract(text, rf"(?s)^(.*?{KNOWN})", 1).alias("head"),
        F.concat(F.regexp_extract(text, '("defect_present":[a-z]+,)', 1), F.regexp_extract(text, '("region":.*?,"severity_level":"[a-z]+")', 1)).alias("facts"),
    )


@query(
    "report_json",
    FACTS
    + f""" SELECT image_id, '"defect_present":' || defect_present || ',"defect_type":"' || defect_type || '","description":"' || class || ' shows ' || defect_type || ': '
      || coalesce(region, 'None') || ', ' || {PCT} || '% covered.","location":{{"bounding_box":' || coalesce('[' || box_x || ',' || box_y || ',' || box_w || ',' || box_h || ']', 'null') || ',' AS part FROM facts""",
)
def _json(spark, sf_dir):
    text = R.report_json(F.col("report"))
    return reports_view(spark, sf_dir).select(
        "image_id", F.regexp_extract(text, r'("defect_present":.*"location":\{"bounding_box":(?:null|\[[^\]]*\]),)', 1).alias("part")
    )


@query(
    "prompt_leaks",
    FACTS
    + """ SELECT 'u' || image_id AS uid, 'uid' AS leaked FROM facts WHERE severity_level = 'minor'
       UNION ALL SELECT 'u' || image_id, 'file name' FROM facts WHERE severity_level = 'moderate'
       UNION ALL SELECT 'u' || image_id, '"image_path"' FROM facts WHERE severity_level = 'severe'""",
)
def _prompt_leaks(spark, sf_dir):
    """Bookkeeping values slipped into prompts on purpose, by severity."""
    level = F.col("severity_level")
    spill = (
        F.when(level == "minor", F.concat(F.lit(" "), "uid", F.lit(" "))).when(level == "moderate", F.concat(F.lit(" "), F.substring_index("image_path", "/", -1)))
        .when(level == "severe", F.lit('"image_path"')).otherwise("")
    )
    prompts = prompts_view(spark, sf_dir).withColumn("prompt", F.concat(R.prompt_text(F.col("messages")), spill))
    return R.prompt_leaks(prompts, "prompt", ["uid", "image_path", "mask_path"], ["uid"])


@query(
    "contract_hashes",
    "SELECT conv_id, turn, sha256('{\"role\":\"' || role || '\",\"turn\":' || turn || '}') AS digest FROM conversations",
)
def _hashes(spark, sf_dir):
    text = R.compact_json(F.struct("role", "turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.contract_hash(text).alias("digest"))


@F.pandas_udf(T.StringType())
def _shout(text: pd.Series) -> pd.Series:
    return text.str.upper()


@query(
    "enriched_descriptions",
    FACTS
    + f""" SELECT image_id, upper(class || ' shows ' || defect_type || ': ' || coalesce(region, 'None') || ', ' || {PCT} || '% covered.') AS description,
        0 AS n_violations FROM facts""",
)
def _enriched(spark, sf_dir):
    enriched = R.enrich_descriptions(reports_view(spark, sf_dir), _shout, enabled=True)
    broken = [F.when(bad, 1).otherwise(0) for bad in V.enrichment_rules().values()]
    return enriched.select("image_id", F.col("report.description").alias("description"), (broken[0] + broken[1]).alias("n_violations"))


@F.pandas_udf(T.DoubleType())
def _peak_gap(generated: pd.Series, clean: pd.Series, mask: pd.Series) -> pd.Series:
    return pd.Series([float(max(g)) - float(max(c)) + 0.0 * len(m) for g, c, m in zip(generated, clean, mask)])


@query("custom_scores", "SELECT vec_id, round(list_max(embedding)::DOUBLE - list_max(list_slice(embedding, 1, 8))::DOUBLE, 6) AS score FROM embeddings")
def _custom(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("generated"), F.slice("embedding", 1, 8).alias("clean"), F.transform("embedding", lambda v: v > 0).alias("mask")
    )
    return N.score_candidates(vectors, _peak_gap).select("vec_id", F.round("score", 6).alias("score"))


@F.pandas_udf(T.IntegerType())
def _word_count(text: pd.Series) -> pd.Series:
    return text.str.findall("[A-Za-z0-9]+").str.len().astype("int32")


@query("token_lengths", "SELECT conv_id, turn, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::INT AS n_tokens FROM conversations")
def _token_lengths(spark, sf_dir):
    """Sequence lengths through a pluggable tokeniser; a word count stands in for it."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", _word_count("text").alias("n_tokens"))


@query(
    "unknown_report_keys",
    """SELECT event_id, '$.severity.' || event_type AS unknown_key FROM events WHERE event_type <> 'view' UNION ALL SELECT event_id, '$.k' FROM events""",
)
def _unknown_keys(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "level").otherwise(F.col("event_type"))
    text = F.concat(F.lit('{"severity":{"'), kind, F.lit('":1},'), F.expr("substring(props, 2)"))
    docs = table(spark, sf_dir, "events").select("event_id", F.try_parse_json(text).alias("doc"))
    return V.unknown_report_keys(docs, "doc", ["event_id"])


@query(
    "upserted_rows",
    """WITH old AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS price FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
       new AS (SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL)
       SELECT * FROM new UNION ALL SELECT * FROM old WHERE (o_custkey, o_orderpriority) NOT IN (SELECT (o_custkey, o_orderpriority) FROM new)""",
)
def _upserted(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    old = orders.where("o_orderstatus = 'F'").groupBy(*keys).agg(F.max("o_totalprice").alias("price"))
    new = orders.where("o_orderstatus <> 'F'").select(*keys, F.col("o_totalprice").alias("price"), "o_orderkey")
    return IO.upsert(old, new, keys, ["o_orderkey"])


@query(
    "candidate_metadata",
    "WITH " + CROP.format(s=4)
    + """ SELECT 'class-' || label || '-' || lpad((image_id % 10000)::VARCHAR, 4, '0') || '-s' || lpad((image_id % 10000 + 42)::VARCHAR, 8, '0') AS uid, 'patch' AS generation_mode,
          'clean/a.png' AS source_clean_image, CASE WHEN reason IS NULL THEN crop_x END AS crop_x, 15 AS n_fields FROM crop""",
)
def _metadata(spark, sf_dir):
    cropped = M.with_crop(mask_view(spark, sf_dir), 4)
    plan = cropped.select(
        "image_id", "class", (F.col("image_id") % 10000).cast("int").alias("index"), (F.col("image_id") % 10000 + 42).cast("int").alias("seed"),
        F.lit("clean\\a.png").alias("clean_path"), F.lit("gt/a.png").alias("mask_path"), "crop.crop_x", "crop.crop_y", "crop.crop_w", "crop.crop_h",
    )
    records = IO.candidate_metadata(plan, F.lit("vectors"), "patch", F.lit("ckpt/a"), F.lit("<a>"), 50, 7.5)
    exact = not any(V.key_set_differences(records.columns).values())
    return records.select(
        "uid", "generation_mode", "source_clean_image", F.col("crop_bbox")[0].cast("long").alias("crop_x"),
        F.lit(len(records.columns) if exact else -1).alias("n_fields"),
    )


@query(
    "class_scope",
    "SELECT DISTINCT source AS dataset, lang AS class FROM documents WHERE NOT (source = 'src1' AND lang = 'en')",
)
def _scope(spark, sf_dir):
    configured = table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("lang").alias("class")).distinct()
    excluded = configured.where("dataset = 'src1' AND class = 'en'")
    return S.eligible_classes(configured, excluded, ["dataset", "class"])
