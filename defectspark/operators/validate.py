"""Rules that return a violations table ``(keys..., rule)``; ``require_none`` raises on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.functions.geometry import REGION_NAMES, SEVERITY_NAMES
from defectspark.functions.text import posix_path

# Allowed actions and the exact key sets of two records.
ACTIONS = ["inspect", "rework", "scrap", "monitor"]
CANDIDATE_FIELDS = [
    "uid", "dataset", "class", "source_clean_image", "source_mask", "generation_mode", "crop_offset",
    "crop_bbox", "lora_checkpoint", "token", "seed", "num_inference_steps", "guidance_scale",
    "lpips_score", "lfs_passed",
]
FIDELITY_FIELDS = [
    "dataset", "class", "n_real", "n_synth", "crop_exclusion_count", "FID", "KID", "LPIPS_diversity",
    "lfs_acceptance",
]


class ViolationError(ValueError):
    """Raised by ``require_none`` with the first few violations."""


def violations(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row per broken rule. A rule is a predicate that is true when it is broken."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()])
    )
    # The list is a column of its own: exploding an expression over every field of one
    # struct loses rows in Spark 4.1 (nested column pruning below a generator).
    listed = df.select(*keys, broken.alias("__broken"))
    return listed.select(*keys, F.explode("__broken").alias("rule"))


def require_none(found: DataFrame, sample: int = 5) -> None:
    rows = found.limit(sample).collect()
    if rows:
        raise ViolationError("; ".join(str(r.asDict()) for r in rows))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def report_rules(vocabulary: Sequence[str] | None = None) -> dict[str, Column]:
    """Schema constraints of a nested ``report`` and its conditional nulls."""
    r = F.col("report")
    location, severity, action = r["location"], r["severity"], r["recommended_action"]
    box, centroid, present = location["bounding_box"], location["centroid"], r["defect_present"]
    area, level = severity["affected_area_pct"], severity["level"]
    gone = ~present
    rules = {
        "defect_present required": present.isNull(),
        "defect_type required": r["defect_type"].isNull(),
        "region enum": location["region"].isNotNull() & ~location["region"].isin(REGION_NAMES),
        "bounding_box length": box.isNotNull() & (F.size(box) != 4),
        "bounding_box minimum": (F.get(box, 0) < 0) | (F.get(box, 1) < 0) | (F.get(box, 2) < 1) | (F.get(box, 3) < 1),
        "centroid length": centroid.isNotNull() & (F.size(centroid) != 2),
        "centroid minimum": (F.get(centroid, 0) < 0) | (F.get(centroid, 1) < 0),
        "level enum": level.isNull() | ~level.isin(SEVERITY_NAMES),
        "area bounds": area.isNull() | F.isnan(area) | (area < 0) | (area > 100),
        "rationale required": severity["rationale"].isNull(),
        "description required": r["description"].isNull(),
        "action enum": action["action"].isNull() | ~action["action"].isin(ACTIONS),
        "reason required": action["reason"].isNull(),
        "confidence required": r["confidence"].isNull(),
        "no defect needs null region": gone & location["region"].isNotNull(),
        "no defect needs null box": gone & box.isNotNull(),
        "no defect needs null centroid": gone & centroid.isNotNull(),
        "no defect needs level none": gone & (level != "none"),
        "no defect needs zero area": gone & (area != 0),
        "defect needs region": present & location["region"].isNull(),
        "defect needs box": present & box.isNull(),
        "defect needs centroid": present & centroid.isNull(),
        "defect needs a level": present & (level == "none"),
    }
    if vocabulary is not None:
        rules["defect_type enum"] = ~r["defect_type"].isin(list(vocabulary))
    return rules


def unknown_report_keys(df: DataFrame, document: str, keys: Sequence[str]) -> DataFrame:
    """Keys of a report variant that the schema does not allow, top level and nested."""
    # Allowed keys per level.
    allowed = {
        "$": ["defect_present", "defect_type", "location", "severity", "description", "recommended_action", "confidence"],
        "$.location": ["region", "bounding_box", "centroid"],
        "$.severity": ["level", "affected_area_pct", "rationale"],
        "$.recommended_action": ["action", "reason"],
    }
    found = []
    for path, names in allowed.items():
        present = F.map_keys(F.try_variant_get(F.col(document), path, "map<string,variant>"))
        extra = F.array_except(present, F.array(*[F.lit(n) for n in names]))
        prefix = F.lit(path + ".")
        found.append(_prefixed(F.coalesce(extra, F.array().cast("array<string>")), prefix))
    return df.select(*keys, F.explode(F.flatten(F.array(*found))).alias("unknown_key"))


def _prefixed(names: Column, prefix: Column) -> Column:
    return F.transform(names, lambda name: F.concat(prefix, name))


def agreement_rules(dataset: Column | None = None) -> dict[str, Column]:
    """Grounding against report, and both against the membership row; with ``dataset``, the grounding's data set against it too."""
    g, r = F.col("grounding"), F.col("report")
    differ = lambda a, b: ~a.eqNullSafe(b)
    owned = {} if dataset is None else {"dataset mismatch": differ(g["dataset"], dataset)}
    return owned | {
        "box differs from the facts": differ(g["bounding_box"], r["location"]["bounding_box"]),
        "centroid differs from the facts": differ(g["centroid"], r["location"]["centroid"]),
        "region differs from the facts": differ(g["region"], r["location"]["region"]),
        "area differs from the facts": differ(g["area_pct"], r["severity"]["affected_area_pct"]),
        "severity differs from the facts": differ(g["severity_level"], r["severity"]["level"]),
        "uid mismatch": differ(g["uid"], F.col("uid")),
        "image path mismatch": differ(posix_path(g["image_path"]), posix_path(F.col("image_path"))),
        "mask path mismatch": differ(posix_path(g["mask_path"]), posix_path(F.col("mask_path"))),
        "defect type mismatch": differ(r["defect_type"], F.col("defect_type")),
        "action is not inspect": differ(r["recommended_action"]["action"], F.lit("inspect")),
    }


def action_rule() -> dict[str, Column]:
    return {"action is not inspect": ~F.col("report.recommended_action.action").eqNullSafe(F.lit("inspect"))}


def empty_text_rules() -> dict[str, Column]:
    """Rendered template fields must not be blank."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    r = F.col("report")
    return {
        "empty description": blank(r["description"]),
        "empty rationale": blank(r["severity"]["rationale"]),
        "empty reason": blank(r["recommended_action"]["reason"]),
        "empty confidence": blank(r["confidence"]),
    }


def fidelity_rules() -> dict[str, Column]:
    rate = F.col("lfs_acceptance")
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    values = ["FID", "KID", "LPIPS_diversity", "lfs_acceptance"]
    bad_value = ~_finite(F.col(values[0]))
    for v in values[1:]:
        bad_value = bad_value | ~_finite(F.col(v))
    return {
        "empty key": blank("dataset") | blank("class"),
        "invalid counts": (F.col("n_real") < 2) | (F.col("n_synth") < 2) | (F.col("crop_exclusion_count") < 0),
        "non-finite metric": bad_value,
        "acceptance outside [0,1]": (rate < 0) | (rate > 1),
    }


def acceptance_rules(low: float, high: float, target: int | None = None) -> dict[str, Column]:
    rules = {"acceptance rate outside range": (F.col("acceptance_rate") < low) | (F.col("acceptance_rate") > high)}
    if target is not None:
        rules["accepted below target"] = F.col("accepted") < target
    return rules


def health_rules() -> dict[str, Column]:
    """Full-test health: both classes present, anomalous masks not all zero."""
    return {
        "no anomalous images": F.col("total_anomalous") == 0,
        "no normal images": F.col("total_normal") == 0,
        "all masks are zero": (F.col("total_anomalous") > 0) & (F.col("max_mask_value") == 0),
    }


def length_rules(length: str, maximum: int) -> dict[str, Column]:
    return {"sequence too long": F.col(length) > maximum}


def loss_rules(minimum: int = 20) -> dict[str, Column]:
    """A loss series must be long enough, finite, and end lower than it began."""
    return {
        "too few values": F.col("n_values") < minimum,
        "non-finite loss": F.col("n_bad") > 0,
        "loss did not fall": ~(F.col("last_mean") < F.col("first_mean")),
    }


def enrichment_rules() -> dict[str, Column]:
    old, new = F.col("original_report"), F.col("report")
    return {
        "another field changed": ~new.dropFields("description").eqNullSafe(old.dropFields("description")),
        "empty description": F.trim(F.coalesce(new["description"], F.lit(""))) == "",
    }


def missing_files(refs: DataFrame, inventory: DataFrame, path: str) -> DataFrame:
    """Referenced paths that the inventory lacks."""
    return refs.join(inventory.select(F.col("path").alias(path)), path, "left_anti")


def outside_vocabulary(df: DataFrame, vocabulary: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(vocabulary, list(on), "left_anti")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def key_set_differences(columns: Sequence[str], expected: Sequence[str] = CANDIDATE_FIELDS) -> dict[str, list[str]]:
    """Exact key-set check of a record schema."""
    return {
        "missing": [c for c in expected if c not in columns],
        "unexpected": [c for c in columns if c not in expected],
    }
