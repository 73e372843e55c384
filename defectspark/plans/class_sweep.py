"""Class sweep over all classes at once: pairs, candidates, score filter, fidelity rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.functions.geometry import relocated_start
from defectspark.operators import metrics as N
from defectspark.operators import splits as S
from defectspark.operators.validate import acceptance_rules, violations


@dataclass(frozen=True)
class SweepOptions:
    candidates: int = 30
    percentile: float = 25.0
    rate_low: float = 0.30
    rate_high: float = 0.90
    accepted_target: int | None = None
    seed: int = 42


def candidate_plan(cropped: DataFrame, cleans: DataFrame, options: SweepOptions) -> DataFrame:
    """Candidates with their crop moved to the chosen clean frame.

    ``cropped`` has ``class, uid, mask_path, width, height, crop``; ``cleans`` has ``class,
    clean_path, clean_w, clean_h``. Only the first ``candidates`` of each are ever used.
    """
    usable = cropped.where("crop.drop_reason IS NULL")
    pairs = S.budget_pairs(usable, ["class"], "uid", options.candidates, options.seed).drop("shortfall")
    frames = S.budget_pairs(cleans, ["class"], "clean_path", options.candidates, options.seed).drop("shortfall")
    frames = frames.withColumnsRenamed({"pair_rank": "clean_rank", "n_pairs": "n_cleans"})
    plan = S.plan_candidates(pairs, frames, cropped.select("class").distinct(), options.candidates, options.seed)
    crop = F.col("crop")
    return plan.withColumns(
        {
            "crop_x": relocated_start(crop["crop_x"], crop["crop_w"], F.col("width"), F.col("clean_w")),
            "crop_y": relocated_start(crop["crop_y"], crop["crop_h"], F.col("height"), F.col("clean_h")),
            "crop_w": crop["crop_w"],
            "crop_h": crop["crop_h"],
            "fits": (crop["crop_w"] <= F.col("clean_w")) & (crop["crop_h"] <= F.col("clean_h")),
        }
    ).drop("crop")


def accepted_candidates(scored: DataFrame, options: SweepOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept candidates, the summary per class, and the classes outside the rate band.

    ``scored`` has ``class, index, score``.
    """
    filtered = N.percentile_filter(scored, ["class"], percentile=options.percentile)
    summary = N.acceptance_summary(filtered, ["class"])
    gate = violations(
        summary, ["class"], acceptance_rules(options.rate_low, options.rate_high, options.accepted_target)
    )
    kept = S.accept_until(filtered, ["class"], "index", "accepted", options.accepted_target)
    return kept, summary, gate
