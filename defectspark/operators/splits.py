"""Deterministic splits, nested budgets and ordered picks.

Members are ordered by a seeded hash instead of a shuffled list: the outcome does not
depend on input order, prefixes are nested, and no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.functions.rounding import clamp, floor_half_up, half_even, half_up_product
from defectspark.functions.text import posix_path
from defectspark.operators.ranking import exact_rank, hash_bucket, hash_order, step_bucket

_ORDER, _RANK, _SIZE = "__order", "__rank", "__size"


def _hash_ranked(
    df: DataFrame, group: Sequence[str], key: str, seed: int | str, keep: int | None = None
) -> DataFrame:
    ordered = df.withColumn(_ORDER, hash_order(seed, F.col(key)))
    return exact_rank(
        ordered, group, [F.col(_ORDER), F.col(key)], hash_bucket(F.col(_ORDER)), _RANK, _SIZE, keep
    ).drop(_ORDER)


def stratified_split(
    df: DataFrame,
    strata: Sequence[str],
    key: str,
    seed: int = 42,
    fraction: float = 0.2,
    rounding: str = "decimal",
    names: tuple[str, str] = ("test", "train"),
    column: str = "split",
) -> DataFrame:
    """Send a share of every stratum to the first name, the rest to the second.

    The share is the rounded product clamped to ``[1, n - 1]``; singletons stay in the
    second. ``rounding`` is ``decimal`` (half up) or ``float`` (``floor(x + 0.5)``).
    """
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    n = F.col(_SIZE)
    share = half_up_product(n, fraction) if rounding == "decimal" else floor_half_up(n * F.lit(float(fraction)))
    count = F.when(n <= 1, F.lit(0)).otherwise(clamp(share, F.lit(1), n - 1))
    ranked = _hash_ranked(df, strata, key, seed)
    return ranked.withColumn(
        column, F.when(F.col(_RANK) <= count, names[0]).otherwise(names[1])
    ).drop(_RANK, _SIZE)


def truncated_split(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    seed: int = 42,
    fraction: float = 0.1,
    minimum: int = 0,
    names: tuple[str, str] = ("val", "train"),
    column: str = "split",
) -> DataFrame:
    """Send ``max(minimum, int(n * fraction))`` members of each group to the first name.

    With ``minimum=1`` a group of one goes wholly to the first name; ``empties_rest``
    flags such groups.
    """
    n = F.col(_SIZE)
    count = F.greatest(F.lit(minimum).cast("long"), F.floor(n * F.lit(float(fraction))).cast("long"))
    ranked = _hash_ranked(df, group, key, seed)
    return (
        ranked.withColumn(column, F.when(F.col(_RANK) <= count, names[0]).otherwise(names[1]))
        .withColumn("empties_rest", count >= n)
        .drop(_RANK, _SIZE)
    )


def ranked_pairs(df: DataFrame, group: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """Adds ``pair_rank`` (1-based, seeded order) and ``n_pairs``."""
    return _hash_ranked(df, group, key, seed).withColumnsRenamed({_RANK: "pair_rank", _SIZE: "n_pairs"})


def budget_pairs(df: DataFrame, group: Sequence[str], key: str, budget: int | str, seed: int = 42) -> DataFrame:
    """The first ``budget`` pairs of each group; smaller budgets are prefixes of larger ones.

    Adds ``shortfall`` where the group holds fewer pairs than asked. ``all`` keeps all.
    """
    if budget == "all":
        return ranked_pairs(df, group, key, seed).withColumn("shortfall", F.lit(0).cast("long"))
    if isinstance(budget, bool) or not isinstance(budget, int) or budget <= 0:
        raise ValueError("budget must be a positive integer or 'all'")
    ranked = _hash_ranked(df, group, key, seed, keep=budget)
    return ranked.withColumnsRenamed({_RANK: "pair_rank", _SIZE: "n_pairs"}).withColumn(
        "shortfall", F.greatest(F.lit(budget) - F.col("n_pairs"), F.lit(0).cast("long"))
    )


def nested_budgets(df: DataFrame, group: Sequence[str], key: str, budgets: Sequence[int], seed: int = 42) -> DataFrame:
    """All budgets from one ranking: a row per (budget, pair), each budget a prefix of the next."""
    ranked = budget_pairs(df, group, key, max(budgets), seed).drop("shortfall")
    sizes = F.filter(F.array(*[F.lit(int(b)) for b in budgets]), lambda b: F.col("pair_rank") <= b)
    return ranked.withColumn("budget", F.explode(sizes)).withColumn(
        "shortfall", F.greatest(F.col("budget") - F.col("n_pairs"), F.lit(0).cast("long"))
    )


def eligible_pairs(
    df: DataFrame, group: Sequence[str], key: str, eligible: Column, budget: int, seed: int = 42
) -> DataFrame:
    """Pairs that pass ``eligible`` in the seeded order, until the budget is full."""
    return budget_pairs(df.where(eligible), group, key, budget, seed)


def spaced_picks(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], bucket: Column, count: int
) -> DataFrame:
    """``count`` members evenly spaced over an order, first and last included.

    Position ``i * (n - 1) / (count - 1)`` rounds half to even. ``pick_no`` starts at 0.
    """
    if count < 2:
        raise ValueError("count must be at least 2")
    ranked = exact_rank(df, group, order, bucket, _RANK, _SIZE)
    wanted = F.array(
        *[half_even(F.lit(i) * (F.col(_SIZE) - 1) / F.lit(float(count - 1))) for i in range(count)]
    )
    return (
        ranked.withColumn("pick_no", F.array_position(wanted, F.col(_RANK) - 1) - 1)
        .where((F.col("pick_no") >= 0) & (F.col(_SIZE) >= count))
        .drop(_RANK, _SIZE)
    )


def partition_errors(whole: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Keys in more than one part, in no part, or not in the whole: empty when exact."""
    marks = [whole.select(key, F.lit(1).alias("w"), F.lit(0).alias("p"))]
    marks += [part.select(key, F.lit(0).alias("w"), F.lit(1).alias("p")) for part in parts]
    union = marks[0]
    for mark in marks[1:]:
        union = union.unionByName(mark)
    totals = union.groupBy(key).agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
    rule = (
        F.when(F.col("w") > 1, "duplicate key")
        .when(F.col("p") > 1, "in more than one part")
        .when(F.col("p") == 0, "in no part")
        .when(F.col("w") == 0, "not in the input")
    )
    return totals.select(key, rule.alias("rule")).where("rule IS NOT NULL")


def synthetic_root_leaks(df: DataFrame, paths: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Rows whose path lies below ``outputs/synthetic*`` (case-insensitive)."""
    return _path_leaks(df, paths, keys, lambda p: F.lower(p).rlike(r"^outputs/synthetic[^/]*(/|$)"))


def synthetic_name_leaks(df: DataFrame, path: str, keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """Rows whose path contains one of ``marks`` anywhere (case-insensitive)."""
    pattern = "|".join(marks)
    return _path_leaks(df, [path], keys, lambda p: F.lower(p).rlike(pattern))


def _path_leaks(df, paths, keys, test) -> DataFrame:
    hits = F.filter(F.array(*[posix_path(F.col(p)) for p in paths]), test)
    return df.select(*keys, F.explode(hits).alias("path"))


# --- training pairs and candidate plans -------------------------------------------------


def clean_training_images(samples: DataFrame) -> DataFrame:
    return samples.where((F.col("split") == "train") & ~F.col("is_anomalous"))


def defect_samples(samples: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    """Anomalous test samples whose mask exists, is not empty and matches the image size.

    ``images`` and ``masks`` hold ``path, height, width``; masks also ``area``. Size
    mismatches are listed by ``size_mismatches``.
    """
    joined = _with_frames(samples, images, masks)
    same = (F.col("image_h") == F.col("mask_h")) & (F.col("image_w") == F.col("mask_w"))
    return joined.where(same & (F.col("mask_area") > 0)).select(*samples.columns)


def size_mismatches(samples: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    joined = _with_frames(samples, images, masks)
    differ = (F.col("image_h") != F.col("mask_h")) | (F.col("image_w") != F.col("mask_w"))
    return joined.where(differ).select("image_path", "mask_path")


def _with_frames(samples: DataFrame, images: DataFrame, masks: DataFrame) -> DataFrame:
    chosen = samples.where(
        (F.col("split") == "test") & F.col("is_anomalous") & F.col("mask_path").isNotNull()
    )
    frames = images.select(
        F.col("path").alias("image_path"), F.col("height").alias("image_h"), F.col("width").alias("image_w")
    )
    rasters = masks.select(
        F.col("path").alias("mask_path"), F.col("height").alias("mask_h"),
        F.col("width").alias("mask_w"), F.col("area").alias("mask_area"),
    )
    return chosen.join(frames, "image_path").join(rasters, "mask_path")


def eligible_classes(configured: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    return configured.join(excluded, list(keys), "left_anti")


def plan_candidates(pairs: DataFrame, cleans: DataFrame, classes: DataFrame, count: int, seed: int) -> DataFrame:
    """Candidate ``i`` of a class takes pair ``i mod n`` and clean image ``i mod m``.

    ``pairs`` has ``class, pair_rank, n_pairs, ...`` and ``cleans`` has ``class,
    clean_rank, n_cleans, clean_path``, both ranked from 1; a class needs at most
    ``count`` of each, so callers may pass budgeted ranks with whole-group sizes.
    """
    sizes = pairs.groupBy("class").agg(F.max("n_pairs").alias("n_pairs")).join(
        cleans.groupBy("class").agg(F.max("n_cleans").alias("n_cleans")), "class"
    )
    slots = (
        classes.join(sizes, "class")
        .withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .withColumn("pair_rank", F.col("index") % F.col("n_pairs") + 1)
        .withColumn("clean_rank", F.col("index") % F.col("n_cleans") + 1)
        .withColumn("seed", F.col("index") + seed)
        .drop("n_pairs", "n_cleans")
    )
    return slots.join(pairs.drop("n_pairs"), ["class", "pair_rank"]).join(
        cleans.drop("n_cleans"), ["class", "clean_rank"]
    )


def accept_until(df: DataFrame, group: Sequence[str], order: str, accepted: str, target: int | None) -> DataFrame:
    """Accepted rows in candidate order until ``target`` per group is reached."""
    passed = df.where(F.col(accepted))
    if target is None:
        return passed
    ranked = exact_rank(passed, group, [F.col(order)], step_bucket(F.col(order)), _RANK, keep=target)
    return ranked.drop(_RANK)
