"""Facts to nested report rows, their text fields, prompts and read-back joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.functions.geometry import vision_tokens
from defectspark.functions.rounding import fixed_text
from defectspark.functions.text import base_name, compact_json, fill_template, posix_path

# Field names that readers of the records expect.
FACT_FIELDS = ["defect_present", "bounding_box", "centroid", "area_pct", "region", "severity_level"]
MEMBER_FIELDS = ["uid", "class", "defect_type", "image_path", "mask_path"]


def skeleton_reports(facts: DataFrame, defect_type: str = "defect_type") -> DataFrame:
    """Adds ``report``: a nested struct with facts filled in and text fields empty."""
    missing = [f for f in FACT_FIELDS if f not in facts.columns]
    if missing:
        raise ValueError(f"grounding facts are missing fields: {missing}")
    blank = F.lit("")
    return facts.withColumn(
        "report",
        F.struct(
            F.col("defect_present"),
            F.col(defect_type).alias("defect_type"),
            F.struct("region", "bounding_box", "centroid").alias("location"),
            F.struct(
                F.col("severity_level").alias("level"),
                F.col("area_pct").alias("affected_area_pct"),
                blank.alias("rationale"),
            ).alias("severity"),
            blank.alias("description"),
            F.struct(F.lit("inspect").alias("action"), blank.alias("reason")).alias("recommended_action"),
            blank.alias("confidence"),
        ),
    )


def full_reports(facts: DataFrame, templates: DataFrame, rationale: str, confidence: str) -> DataFrame:
    """Skeleton reports with text rendered from the (class, defect type) template.

    ``rationale`` and ``confidence`` are templates with the same fields, one for all rows.

    ``templates`` has ``class, defect_type, description_template, action,
    reason_template``, unique by its keys. Rows without a template are left out here and
    listed by ``template_errors``.
    """
    joined = skeleton_reports(facts).join(templates, ["class", "defect_type"])
    text = lambda c: F.coalesce(c, F.lit("None"))
    fields = {
        "class_name": F.col("class"),
        "defect_type": F.col("defect_type"),
        "region": text(F.col("region")),
        "affected_area_pct": fixed_text(F.col("area_pct"), 2),
        "severity_level": F.col("severity_level"),
    }
    report = F.col("report")
    report = report.withField("description", fill_template(F.col("description_template"), fields))
    report = report.withField("severity.rationale", fill_template(F.lit(rationale), fields))
    report = report.withField("confidence", fill_template(F.lit(confidence), fields))
    report = report.withField(
        "recommended_action",
        F.struct(F.col("action"), fill_template(F.col("reason_template"), fields).alias("reason")),
    )
    return joined.withColumn("report", report).drop("description_template", "reason_template", "action")


def template_errors(
    members: DataFrame, templates: DataFrame, vocabulary: DataFrame, keys: list[str]
) -> DataFrame:
    """``(keys, rule)`` for members whose class, defect type or vocabulary entry is unknown."""
    known = templates.groupBy("class").agg(F.lit(True).alias("__class"))
    pairs = templates.groupBy("class", "defect_type").agg(F.lit(True).alias("__pair"))
    words = vocabulary.groupBy("defect_type").agg(F.lit(True).alias("__word"))
    joined = (
        members.join(known, "class", "left").join(pairs, ["class", "defect_type"], "left")
        .join(words, "defect_type", "left")
    )
    rule = (
        F.when(F.col("__class").isNull(), "unknown class")
        .when(F.col("__pair").isNull(), "defect type not configured for class")
        .when(F.col("__word").isNull(), "defect type outside vocabulary")
    )
    return joined.select(*keys, rule.alias("rule")).where("rule IS NOT NULL")


def member_rows(samples: DataFrame) -> DataFrame:
    return samples.select(*MEMBER_FIELDS)


def grounding_rows(members: DataFrame, dataset: Column) -> DataFrame:
    """Grounding records of members that carry a ``report``."""
    report = F.col("report")
    return members.select(
        "uid",
        dataset.alias("dataset"),
        "class",
        "image_path",
        "mask_path",
        report["location"]["bounding_box"].alias("bounding_box"),
        report["location"]["centroid"].alias("centroid"),
        report["severity"]["affected_area_pct"].alias("area_pct"),
        report["location"]["region"].alias("region"),
        report["severity"]["level"].alias("severity_level"),
    )


def training_records(members: DataFrame, grounding: DataFrame, reports: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Members with both artefacts by uid, as ``grounding`` and ``report`` structs.

    ``images`` (``path``, ``width``, ``height``; one row per path) adds ``image_width``,
    ``image_height`` and ``vision_tokens``, null for an image that is not there or not readable.
    """
    facts = grounding.select("uid", F.struct(*grounding.columns).alias("grounding"))
    records = members.join(facts, "uid").join(reports.select("uid", "report"), "uid")
    if images is None:
        return records
    sized = images.select(
        posix_path(F.col("path")).alias("__image"), F.col("width").alias("image_width"), F.col("height").alias("image_height"),
        vision_tokens(F.col("width"), F.col("height")).alias("vision_tokens"),
    )
    return records.withColumn("__image", posix_path(F.col("image_path"))).join(sized, "__image", "left").drop("__image")


def missing_artefacts(members: DataFrame, grounding: DataFrame, reports: DataFrame) -> DataFrame:
    facts = members.join(grounding, "uid", "left_anti").select("uid", F.lit("grounding").alias("missing"))
    texts = members.join(reports, "uid", "left_anti").select("uid", F.lit("report").alias("missing"))
    return facts.unionByName(texts)


def report_json(report: Column) -> Column:
    """Compact report text with keys in sorted order at every level."""
    location, severity, action = report["location"], report["severity"], report["recommended_action"]
    return compact_json(
        F.struct(
            report["confidence"].alias("confidence"),
            report["defect_present"].alias("defect_present"),
            report["defect_type"].alias("defect_type"),
            report["description"].alias("description"),
            F.struct(
                location["bounding_box"].alias("bounding_box"),
                location["centroid"].alias("centroid"),
                location["region"].alias("region"),
            ).alias("location"),
            F.struct(action["action"].alias("action"), action["reason"].alias("reason")).alias("recommended_action"),
            F.struct(
                severity["affected_area_pct"].alias("affected_area_pct"),
                severity["level"].alias("level"),
                severity["rationale"].alias("rationale"),
            ).alias("severity"),
        )
    )


def prompt_facts(df: DataFrame) -> DataFrame:
    """Adds ``facts``: the six facts a prompt may show, keys in sorted order."""
    return df.withColumn(
        "facts",
        F.struct(
            F.col("area_pct").alias("affected_area_pct"), "bounding_box", "centroid",
            "defect_present", "region", "severity_level",
        ),
    )


def prompt_messages(
    df: DataFrame,
    vocabulary: DataFrame,
    system: str,
    instruction: str,
    note: str,
    words_label: str,
    facts_label: str,
    image: str = "image_path",
    target: str | None = None,
) -> DataFrame:
    """Adds ``messages``: chat turns from the vocabulary, the facts and an optional target.

    ``words_label`` and ``facts_label`` stand before the two. ``vocabulary`` has ``dataset`` and a sorted ``words`` array, one row per dataset.
    """
    kind = "struct<type:string,text:string,image:string>"
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("string").alias("image")).cast(kind)
    turn = lambda role, *parts: F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))
    picture = F.struct(
        F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.col(image).alias("image")
    ).cast(kind)
    body = F.concat_ws(
        "\n",
        F.lit(instruction.strip()),
        F.concat(F.lit(words_label), compact_json(F.col("words"))),
        F.concat(F.lit(facts_label), compact_json(F.col("facts"))),
        F.lit(note.strip()),
    )
    turns = [turn("system", text(F.lit(system.strip()))), turn("user", picture, text(body))]
    if target is not None:
        turns.append(turn("assistant", text(F.col(target))))
    return df.join(vocabulary, "dataset").withColumn("messages", F.array(*turns)).drop("words")


def prompt_text(messages: Column) -> Column:
    """All text of the turns before the answer, one line per part."""
    asked = F.filter(messages, lambda m: m["role"] != "assistant")
    return F.array_join(F.flatten(F.transform(asked, lambda m: m["content"]["text"])), "\n")


def defect_vocabulary(templates: DataFrame, by: str = "dataset") -> DataFrame:
    """Sorted distinct defect types per dataset (bounded by the configured types)."""
    words = templates.select(by, "defect_type").distinct()
    return words.groupBy(by).agg(F.array_sort(F.collect_list("defect_type")).alias("words"))


def enrich_descriptions(df: DataFrame, rephrase: Callable[[Column], Column] | None, enabled: bool = False) -> DataFrame:
    """Replace only ``report.description`` through a pandas UDF; a copy when disabled."""
    if not enabled:
        return df
    if rephrase is None:
        raise ValueError("enabled enrichment needs a rephrase function")
    new_text = rephrase(F.col("report.description"))
    return df.withColumn("original_report", F.col("report")).withColumn(
        "report", F.col("report").withField("description", new_text)
    )


def prompt_leaks(df: DataFrame, prompt: str, forbidden: list[str], keys: list[str]) -> DataFrame:
    """``(keys, leaked)`` where the prompt shows a bookkeeping value or key name."""
    # Key names that must not appear in a prompt.
    names = ['"uid"', '"image_path"', '"mask_path"', '"class"', "class_name"]
    values = [F.struct(F.lit(c).alias("what"), F.col(c).alias("text")) for c in forbidden]
    if "image_path" in forbidden:
        values.append(F.struct(F.lit("file name").alias("what"), base_name(F.col("image_path")).alias("text")))
    marks = [F.struct(F.lit(n).alias("what"), F.lit(n).alias("text")) for n in names]
    hits = F.filter(
        F.array(*values, *marks),
        lambda v: (F.length(v["text"]) > 0) & F.contains(F.col(prompt), v["text"]),
    )
    return df.select(*keys, F.explode(hits).alias("hit")).select(*keys, F.col("hit.what").alias("leaked"))


def contract_hash(text: Column) -> Column:
    """SHA-256 of a compact JSON text."""
    return F.sha2(text, 256)
