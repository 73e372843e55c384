"""Report corpus: select samples, split them, ground their masks, render and check reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.functions.text import posix_path, sample_uid
from defectspark.operators import lake as L
from defectspark.operators import reports as R
from defectspark.operators import splits as S
from defectspark.operators import validate as V
from defectspark.operators.masks import ground_masks


@dataclass(frozen=True)
class CorpusOptions:
    dataset: str
    root: str
    rationale: str
    confidence: str
    seed: int = 42
    test_fraction: float = 0.2
    cutoffs: tuple[float, float] = (1.0, 5.0)
    overrides: dict = field(default_factory=dict)


def select_members(samples: DataFrame, inventory: DataFrame, options: CorpusOptions) -> tuple[DataFrame, DataFrame]:
    """Members with uid and split, and the skipped samples with their reasons."""
    marked = L.corpus_selection(samples, inventory)
    cls, kind = F.col("category"), F.col("label")
    path = posix_path(F.col("image_path"))
    members = marked.where("skip_reason IS NULL").select(
        sample_uid(F.lit(options.dataset), cls, kind, path).alias("uid"), cls.alias("class"), kind.alias("defect_type"),
        path.alias("image_path"), posix_path(F.col("mask_path")).alias("mask_path"),
    )
    split = S.stratified_split(members, ["class", "defect_type"], "uid", options.seed, options.test_fraction)
    return split, marked.where("skip_reason IS NOT NULL").select("category", "image_path", "skip_reason")


def corpus_reports(members: DataFrame, masks: DataFrame, templates: DataFrame, options: CorpusOptions) -> DataFrame:
    """Members with facts and a full report; ``masks`` has ``mask_path, height, width, runs``."""
    facts = ground_masks(members.join(masks, "mask_path"), "defect_type", options.cutoffs, options.overrides)
    return R.full_reports(facts, templates, options.rationale, options.confidence)


def corpus_violations(reports: DataFrame, members: DataFrame, inventory: DataFrame, options: CorpusOptions) -> DataFrame:
    """Every broken rule of the corpus as ``(uid, rule)``."""
    rules = {**V.report_rules(), **V.empty_text_rules(), **V.action_rule()}
    named = lambda df, rule: df.select("uid", F.lit(rule).alias("rule"))
    return (
        V.violations(reports, ["uid"], rules)
        .unionByName(named(L.outside_root(members, ["image_path", "mask_path"], options.root, ["uid"]), "outside root"))
        .unionByName(named(S.synthetic_root_leaks(members, ["image_path", "mask_path"], ["uid"]), "synthetic path"))
        .unionByName(named(V.duplicate_keys(members, ["uid"]), "duplicate uid"))
        .unionByName(named(V.missing_files(members, inventory, "image_path"), "missing image"))
    )
