"""Per-category results: readiness, means, section tables and sweep outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.functions.rounding import fixed_text, lenient_fixed_text
from defectspark.functions.text import normalized_header

METRICS = ["image_AUROC", "image_F1Score", "pixel_AUROC", "pixel_F1Score"]
# Accepted header spellings after normalisation.
ALIASES = {
    "image_AUROC": ["image_auroc", "imageauroc", "image_auc"],
    "image_F1Score": ["image_f1score", "imagef1score", "image_f1", "imagef1"],
    "pixel_AUROC": ["pixel_auroc", "pixelauroc", "pixel_auc"],
    "pixel_F1Score": ["pixel_f1score", "pixelf1score", "pixel_f1", "pixelf1"],
}


def unify_headers(
    df: DataFrame, aliases: Mapping[str, Sequence[str]] = ALIASES, keep: Sequence[str] = ()
) -> DataFrame:
    """``category`` and the four metrics as text, whatever the header spelling.

    ``keep`` names columns to carry along. Blank categories and ``MEAN`` rows are dropped.
    """
    by_name = {normalized_header(c): c for c in df.columns}
    if "category" not in by_name:
        raise ValueError("results need a category column")

    def pick(names: Sequence[str]) -> Column:
        for name in names:
            if name in by_name:
                return F.col(f"`{by_name[name]}`").cast("string")
        return F.lit(None).cast("string")

    category = F.trim(F.col(f"`{by_name['category']}`"))
    return df.select(
        *keep, category.alias("category"), *[pick(names).alias(metric) for metric, names in aliases.items()]
    ).where((F.col("category") != "") & (F.upper("category") != "MEAN"))


def with_mean(df: DataFrame, group: Sequence[str], category: str, values: Sequence[str], mean: str = "MEAN") -> DataFrame:
    """Rows plus a mean row per group; nulls do not count, repeated runs do."""
    means = df.groupBy(*group).agg(*[F.avg(v).alias(v) for v in values])
    return df.select(*group, category, *values).unionByName(
        means.withColumn(category, F.lit(mean)).select(*group, category, *values)
    )


def latest_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is last in ``order``."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return newest.select(*keys, "__row.*").select(*df.columns)


def section_table(df: DataFrame, dataset: str, category: str, values: Sequence[str], digits: int = 4) -> DataFrame:
    """Text table: rows in case-insensitive order, then a mean, per dataset, with dividers.

    ``values`` are text and may be blank or unparsable (``N/A``). Sort by ``section,
    place, sort_name`` to print; divider rows are blank and follow all but the last dataset.
    """
    detail = df.select(
        F.col(dataset).alias("section"), F.lit(0).alias("place"), F.lower(category).alias("sort_name"),
        F.col(dataset).alias("dataset"), F.col(category).alias("category"),
        *[lenient_fixed_text(F.col(v), digits).alias(v) for v in values],
    )
    means = df.groupBy(dataset).agg(*[F.avg(F.trim(v).try_cast("double")).alias(v) for v in values])
    mean_rows = means.select(
        F.col(dataset).alias("section"), F.lit(1).alias("place"), F.lit("").alias("sort_name"),
        F.col(dataset).alias("dataset"), F.lit("MEAN").alias("category"),
        *[F.coalesce(fixed_text(F.col(v), digits), F.lit("N/A")).alias(v) for v in values],
    )
    last = df.agg(F.max(dataset)).scalar()
    dividers = means.where(F.col(dataset) < last).select(
        F.col(dataset).alias("section"), F.lit(2).alias("place"), F.lit("").alias("sort_name"),
        F.lit("").alias("dataset"), F.lit("").alias("category"), *[F.lit("").alias(v) for v in values],
    )
    return detail.unionByName(mean_rows).unionByName(dividers)


def readiness(stats: DataFrame, skip: Mapping[str, str] | None = None, low_sample: int = 20) -> DataFrame:
    """``ok``, ``reason`` and ``low_sample`` per category.

    ``stats`` has ``category, in_manifest, train_total, test_anomalous, test_normal``.
    """
    reason = F.lit(None).cast("string")
    for name, why in (skip or {}).items():
        reason = F.coalesce(reason, F.when(F.col("category") == name, F.lit(why)))
    rule = (
        F.when(reason.isNotNull(), reason)
        .when(~F.col("in_manifest"), "not in the manifest")
        .when(F.col("train_total") == 0, "nothing to train on")
        .when(F.col("test_anomalous") == 0, "no anomalous test image")
        .when(F.col("test_normal") == 0, "no normal test image")
        .otherwise("ok")
    )
    return stats.withColumn("reason", rule).withColumn("ok", F.col("reason") == "ok").withColumn(
        "low_sample", F.col("ok") & (F.col("train_total") < low_sample)
    )


def sweep_outcome(ready: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts by outcome and reason: successful, skipped, failed, pending."""
    done = results.groupBy("category").agg(F.lit(True).alias("__done"))
    failed = failures.groupBy("category").agg(F.max("error").alias("__error"))
    joined = ready.join(done, "category", "left").join(failed, "category", "left")
    status = (
        F.when(~F.col("ok"), "skipped").when(F.col("__done"), "successful")
        .when(F.col("__error").isNotNull(), "failed").otherwise("pending")
    )
    why = F.when(~F.col("ok"), F.col("reason")).when(status == "failed", F.col("__error")).otherwise("")
    return joined.groupBy(status.alias("status"), why.alias("why")).agg(F.count(F.lit(1)).alias("n_categories"))


def run_table(metrics: DataFrame, params: DataFrame, wanted: Mapping[str, Sequence[str]], category_key: str = "category") -> DataFrame:
    """One row per run: its category and, per column, the first metric name that exists.

    A metric logged at several steps counts with its last step. ``metrics`` has ``run_id,
    step, key, value``; ``params`` has ``run_id, key, value``.
    """
    names = [n for options in wanted.values() for n in options]
    last = metrics.where(F.col("key").isin(names)).groupBy("run_id", "key").agg(
        F.max_by("value", "step").alias("value")
    )
    columns = [
        F.coalesce(*[F.max(F.when(F.col("key") == n, F.col("value"))) for n in options]).alias(name)
        for name, options in wanted.items()
    ]
    categories = params.where(F.col("key") == category_key).select("run_id", F.col("value").alias("category"))
    return last.groupBy("run_id").agg(*columns).join(categories, "run_id")


def key_set_mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one of two record sets has."""
    a = left.select(*keys).distinct().withColumn("__a", F.lit(True))
    b = right.select(*keys).distinct().withColumn("__b", F.lit(True))
    joined = a.join(b, list(keys), "full_outer")
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right")
    return joined.select(*keys, side.alias("only_in")).where("only_in IS NOT NULL")


def resume_plan(scope: DataFrame, artefacts: DataFrame, keys: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """``reuse`` for classes that have every artefact kind, else ``train``."""
    complete = (
        artefacts.where(F.col("kind").isin(list(kinds))).select(*keys, "kind").distinct()
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(kinds))
    )
    return scope.join(complete, list(keys), "left").select(
        *scope.columns, F.when(F.col("__n").isNotNull(), "reuse").otherwise("train").alias("action")
    )


def length_summary(df: DataFrame, group: Sequence[str], length: str, target: str, tokens: str) -> DataFrame:
    """Sequence-length extremes and exact median, 95th and 99th percentiles per group."""
    from defectspark.operators.ranking import exact_percentiles, join_groups

    points = {"median_length": 0.5, "p95_length": 0.95, "p99_length": 0.99}
    quantiles = exact_percentiles(df, group, length, points)
    extremes = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("examples"),
        F.min(length).alias("min_length"), F.max(length).alias("max_length"),
        F.min(target).alias("min_target"), F.max(target).alias("max_target"),
        F.max(tokens).alias("max_tokens"),
    )
    return join_groups(extremes, quantiles, group)


def table_fingerprint(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free content fingerprint per group: row count and summed row hashes.

    Adds hashes instead of listing them, so a group of any size stays one small row. In a row's
    text every value carries its length, and a null is told apart, so no two rows share a text.
    """
    value = lambda v: F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    text = F.concat(*[value(F.col(c).cast("string")) for c in columns])
    digest = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(digest).cast("string").alias("fingerprint"))
