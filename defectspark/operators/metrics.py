"""Score metrics, percentile filters and distances between sets of feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectspark.operators.ranking import Balanced, exact_percentiles, exact_rank, hash_bucket, hash_order, join_groups, running_sums

# --- detection scores ---------------------------------------------------------------


def threshold_metrics(
    df: DataFrame, group: Sequence[str], score: str, label: str, weight: str | None = None
) -> DataFrame:
    """AUROC (rank sum, ties averaged) and the best F1 over all thresholds per group.

    Both come from one pass over distinct scores, so pixel tables with billions of equal
    scores shrink before they move. A group with one class only gives null AUROC.
    """
    count = F.lit(1).cast("long") if weight is None else F.col(weight)
    on = F.col(label)
    scored = running_sums(
        df.where(F.col(score).isNotNull()), group, score,
        {"pos": F.sum(F.when(on, count).otherwise(0)), "neg": F.sum(F.when(on, 0).otherwise(count))},
        Balanced(F.col(score)),
    )
    total_pos, total_neg = F.col("pos_total").cast("double"), F.col("neg_total").cast("double")
    below = F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / F.lit(2.0))
    tp = F.col("pos_total") - F.col("pos_before")
    predicted = tp + F.col("neg_total") - F.col("neg_before")
    f1 = F.lit(2.0) * tp / (predicted + F.col("pos_total"))
    return scored.groupBy(*group).agg(
        (F.sum(below) / F.nullif(F.max(total_pos * total_neg), F.lit(0.0))).alias("auroc"),
        F.max(F.when(F.col("pos_total") > 0, f1)).alias("f1"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
    )


def sigma_thresholds(df: DataFrame, group: Sequence[str], score: str, sigmas: float = 3.0) -> DataFrame:
    """Mean plus ``sigmas`` sample deviations of normal scores."""
    return df.groupBy(*group).agg(
        (F.avg(score) + F.lit(float(sigmas)) * F.stddev_samp(score)).alias("threshold")
    )


# --- candidate filter ----------------------------------------------------------------


def masked_distance(generated: Column, clean: Column, mask: Column) -> Column:
    """Default score: mean squared difference after both are zeroed outside the mask."""
    squares = F.transform(
        F.arrays_zip(generated.alias("a"), clean.alias("b"), mask.alias("m")),
        lambda p: F.when(p["m"], F.pow(p["a"].cast("double") - p["b"].cast("double"), 2)).otherwise(0.0),
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v) / F.size(generated)


def score_candidates(
    df: DataFrame,
    scorer: Callable[[Column, Column, Column], Column] = masked_distance,
    columns: tuple[str, str, str] = ("generated", "clean", "mask"),
) -> DataFrame:
    """Adds ``score``; ``scorer`` may be a pandas UDF over the three columns."""
    return df.withColumn("score", scorer(*[F.col(c) for c in columns]))


def percentile_filter(df: DataFrame, group: Sequence[str], score: str = "score", percentile: float = 25.0) -> DataFrame:
    """Adds the exact per-group ``threshold`` and ``accepted`` (score at or above it)."""
    if not 0.0 <= percentile <= 100.0:
        raise ValueError("percentile must lie in [0, 100]")
    cuts = exact_percentiles(df, group, score, {"threshold": percentile / 100.0})
    return join_groups(df, cuts, group).withColumn("accepted", F.col(score) >= F.col("threshold"))


def nonfinite_scores(df: DataFrame, keys: Sequence[str], score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.where(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf"))).select(*keys)


def acceptance_summary(filtered: DataFrame, group: Sequence[str], score: str = "score") -> DataFrame:
    hit = F.col("accepted").cast("int")
    return filtered.groupBy(*group).agg(
        F.count(F.lit(1)).alias("candidates"),
        F.sum(hit).alias("accepted"),
        F.sum(1 - hit).alias("rejected"),
        F.avg(hit).alias("acceptance_rate"),
        F.avg(score).alias("mean_score"),
        F.max("threshold").alias("threshold"),
    )


# --- sums over vectors ----------------------------------------------------------------

_OPEN_BYTES = 64 << 20


def vector_sums(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Per group and vector position: count, sum and sum of squares (map-side combined)."""
    long = df.select(*group, F.posexplode(vector).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    return long.groupBy(*group, "i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")
    )


def mean_pairwise_distance(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Mean squared Euclidean distance over all unordered pairs of a group.

    ``sum |a - b|^2`` over pairs equals ``n * sum |x|^2 - |sum x|^2``, so no pair is
    formed and the work is linear. Perceptual distances that compare weighted, normalised
    features by squared difference have this form. Groups below two items give null.
    """
    sums = vector_sums(df, group, vector)
    return sums.groupBy(*group).agg(F.max("n").alias("n"), F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("t")).select(
        *group,
        "n",
        F.when(
            F.col("n") > 1, F.lit(2.0) * F.col("t") / (F.col("n").cast("double") * (F.col("n") - 1))
        ).alias("diversity"),
    )


def _partial_sums(df: DataFrame, group: Sequence[str], vector: str, cubic: bool) -> DataFrame:
    """Summed products of vector entries per group: rows ``(group, i, j, v)``.

    ``j = 0`` holds the sum of ``x_i`` and ``1..d`` of ``x_i x_j``. The cubic form keeps
    each unordered product once, scaled by the root of its multiplicity so that inner
    products need no weights: ``1..d-i`` for pairs, the rest for triples. ``i = -1`` holds
    the count and the kernel diagonal. Every task adds up its own rows, arrays travel
    keyed by ``i``, and the JVM adds the entries.
    """
    names = list(group)

    def symmetric(part: np.ndarray) -> list[np.ndarray]:
        out = []
        for i in range(part.shape[1]):
            tail = part[:, i:]
            j, k = np.triu_indices(tail.shape[1])
            pairs = tail.T @ part[:, i] * np.sqrt(np.where(np.arange(tail.shape[1]) == 0, 1.0, 2.0))
            times = np.where((j == 0) & (k == 0), 1.0, np.where((j == 0) | (j == k), 3.0, 6.0))
            triples = ((tail * part[:, [i]]).T @ tail)[j, k] * np.sqrt(times)
            out.append(np.concatenate([[part[:, i].sum()], pairs, triples]))
        return out

    def rows(key: tuple, acc: list) -> dict:
        count, diagonal, total = acc
        body = [np.array([count, diagonal])] + list(total)
        return {"key": [list(key)] * len(body), "i": list(range(-1, len(body) - 1)), "a": body}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_sums: dict[tuple, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, acc in open_sums.items():
                part = rows(key, acc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part["key"], pa.list_(pa.string())),
                        pa.array(part["i"], pa.int32()),
                        pa.array([r.tolist() for r in part["a"]], pa.list_(pa.float64())),
                    ],
                    ["key", "i", "a"],
                )
            open_sums.clear()

        for batch in batches:
            lists = batch.column("__x")
            if len(lists) == 0:
                continue
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
            d = x.shape[1]
            members: dict[tuple, list[int]] = {}
            for at, key in enumerate(zip(*[batch.column(n).to_pylist() for n in names])):
                members.setdefault(key, []).append(at)
            for key, index in members.items():
                part = x[index]
                total = symmetric(part) if cubic else list(np.concatenate([part.sum(0)[:, None], part.T @ part], 1))
                diagonal = float((((part * part).sum(1) / d + 1.0) ** 3).sum())
                acc = open_sums.setdefault(key, [0, 0.0, None])
                acc[0] += len(index)
                acc[1] += diagonal
                acc[2] = total if acc[2] is None else [u + v for u, v in zip(acc[2], total)]
                if len(open_sums) * sum(8 * len(a) for a in total) > _OPEN_BYTES:
                    yield from flush()
        yield from flush()

    narrow = df.select(*[F.col(n).cast("string") for n in names], F.col(vector).cast("array<double>").alias("__x")).where("__x IS NOT NULL")
    partial = narrow.mapInArrow(fold, "key array<string>, i int, a array<double>")
    keyed = partial.select(*[F.get("key", k).cast(df.schema[n].dataType).alias(n) for k, n in enumerate(names)], "i", "a")
    spread_rows = keyed.repartition(*names, "i").select(*names, "i", F.posexplode("a").alias("j", "v"))
    return spread_rows.groupBy(*names, "i", "j").agg(F.sum("v").alias("v"))


def _two_sets(sums: DataFrame, group: Sequence[str], side: str, first: str, second: str) -> DataFrame:
    pick = lambda name: F.sum(F.when(F.col(side) == name, F.col("v")))
    return sums.groupBy(*group, "i", "j").agg(pick(first).alias("a"), pick(second).alias("b"))


def kernel_distance(
    df: DataFrame, group: Sequence[str], side: str, vector: str, first: str, second: str, dim: int
) -> DataFrame:
    """Unbiased kernel distance of two whole sets, kernel ``(x.y / d + 1)^3``, without pairs.

    The cubic kernel is a polynomial in ``x.y``, so its sum over all pairs is an inner
    product of summed products. Linear in rows and cubic in ``dim``; for long vectors use
    ``kernel_distance_subsets``.
    """
    if dim > 128:
        raise ValueError("whole-set kernel sums need dim <= 128; use kernel_distance_subsets")
    table = _two_sets(_partial_sums(df, [*group, side], vector, True), group, side, first, second)
    weight = (
        F.when(F.col("i") < 0, 0.0).when(F.col("j") == 0, 3.0 / dim)
        .when(F.col("j") <= dim - F.col("i"), 3.0 / dim**2).otherwise(1.0 / dim**3)
    )
    entry = lambda name, j: F.max(F.when((F.col("i") == -1) & (F.col("j") == j), F.col(name)))
    wide = table.groupBy(*group).agg(
        *[F.sum(weight * F.col(x) * F.col(y)).alias(x + y) for x, y in (("a", "a"), ("b", "b"), ("a", "b"))],
        entry("a", 0).alias("na"), entry("b", 0).alias("nb"), entry("a", 1).alias("da"), entry("b", 1).alias("db"),
    )
    inside = lambda s, n, diag: (F.col(s) + F.col(n) * F.col(n) - F.col(diag)) / (F.col(n) * (F.col(n) - 1))
    cross = (F.col("ab") + F.col("na") * F.col("nb")) / (F.col("na") * F.col("nb"))
    enough = (F.col("na") > 1) & (F.col("nb") > 1)
    return wide.select(
        *group,
        F.col("na").cast("long").alias("n_first"),
        F.col("nb").cast("long").alias("n_second"),
        F.when(enough, inside("aa", "na", "da") + inside("bb", "nb", "db") - 2 * cross).alias("kid"),
    )


def kernel_distance_subsets(
    df: DataFrame, group: Sequence[str], side: str, key: str, vector: str, first: str, second: str,
    subsets: int = 100, max_size: int = 1000, seed: int = 42,
) -> DataFrame:
    """Mean kernel distance over ``subsets`` seeded draws of ``min(n_first, n_second, max_size)``.

    A draw takes the first keys in the order of the SHA-256 of seed, draw and key. Only ``(subset, key)`` pairs that can still be drawn are ranked; each task then holds
    at most ``2 * max_size`` vectors.
    """
    names = [*group, side]
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    smallest = sizes.groupBy(*group).agg(F.least(F.min("n"), F.lit(max_size)).alias("m"), F.count(F.lit(1)).alias("k"))
    limits = join_groups(sizes, smallest.where("k = 2 AND m > 1").drop("k"), group)
    draws = (
        join_groups(df.select(*names, key), limits, names)
        .withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))))
        .withColumn("h", hash_order(seed, F.col("subset"), F.col(key)))
    )
    drawn = exact_rank(draws, [*names, "subset"], [F.col("h")], hash_bucket(F.col("h")), "r", keep=max_size)
    chosen = drawn.where(F.col("r") <= F.col("m")).select(key, "subset").join(
        df.select(*names, key, F.col(vector).cast("array<double>").alias("x")), key
    )
    schema = T.StructType(
        [df.schema[n] for n in group] + [T.StructField("subset", T.IntegerType()), T.StructField("kid", T.DoubleType())]
    )

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.stack(pdf.loc[pdf[side] == first, "x"].to_list())
        b = np.stack(pdf.loc[pdf[side] == second, "x"].to_list())
        d, m = a.shape[1], len(a)
        k = lambda u, v: (u @ v.T / d + 1.0) ** 3
        kaa, kbb = k(a, a), k(b, b)
        inside = (kaa.sum() - np.trace(kaa) + kbb.sum() - np.trace(kbb)) / (m * (m - 1))
        row = {n: [pdf[n].iloc[0]] for n in [*group, "subset"]}
        return pd.DataFrame({**row, "kid": [inside - 2 * k(a, b).mean()]})

    per_subset = chosen.groupBy(*group, "subset").applyInPandas(distance, schema)
    return per_subset.groupBy(*group).agg(F.avg("kid").alias("kid"), F.count(F.lit(1)).alias("subsets"))


def set_moments(df: DataFrame, group: Sequence[str], vector: str) -> DataFrame:
    """Mean and covariance of each group's vectors from summed products: ``i``, ``j`` (from 0, ``i <= j``), ``n``, ``mean_i``, ``covariance``.

    A task holds the summed products of as many groups as a bound in bytes allows. Partial sums
    travel by group and line of the table, so no task needs a whole table.
    """
    names = list(group)
    sums = _partial_sums(df, names, vector, False)
    cells = sums.where("i >= 0 AND j > 0").select(*names, "i", (F.col("j") - 1).alias("j"), "v").where("i <= j")
    heads = sums.where("i >= 0 AND j = 0").select(*names, "i", F.col("v").alias("s"))
    counts = sums.where("i = -1 AND j = 0").select(*names, F.col("v").cast("long").alias("n"))
    joined = join_groups(join_groups(cells, heads.withColumnRenamed("s", "si"), [*names, "i"]), heads.select(*names, F.col("i").alias("j"), F.col("s").alias("sj")), [*names, "j"])
    n = F.col("n")
    covariance = (F.col("v") - F.col("si") * F.col("sj") / n) / F.nullif(n - 1, F.lit(0))
    return join_groups(joined, counts, names).select(*names, "i", "j", "n", (F.col("si") / n).alias("mean_i"), covariance.alias("covariance"))


def frechet_distance(
    df: DataFrame, group: Sequence[str], side: str, vector: str, first: str, second: str
) -> DataFrame:
    """Fréchet distance of two sets per group from means and covariances.

    Sums of products are added in Spark; only the ``d x d`` tables of one group meet in a
    task for the matrix square root. A set below two rows gives null.
    """
    table = _two_sets(_partial_sums(df, [*group, side], vector, False), group, side, first, second)
    names = list(group)
    schema = T.StructType([df.schema[n] for n in names]).add("n_first", "long").add("n_second", "long").add("fid", "double")

    def root(m: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(m)
        return (vectors * np.sqrt(np.clip(values, 0, None))) @ vectors.T

    def distance(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["i"] < 0].set_index("j")
        body = pdf[pdf["i"] >= 0]
        d = int(body["i"].max()) + 1
        row = {n: [pdf[n].iloc[0]] for n in names}
        counts, means, covs = [], [], []
        for name in ("a", "b"):
            n = head.loc[0, name]
            n = 0 if np.isnan(n) else int(n)
            counts.append(n)
            full = np.zeros((d, d + 1))
            full[body["i"], body["j"]] = np.nan_to_num(body[name])
            mean = full[:, 0] / max(n, 1)
            means.append(mean)
            covs.append((full[:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1))
        value = None
        if min(counts) > 1:
            half = root(covs[0])
            cross = np.sqrt(np.clip(np.linalg.eigvalsh(half @ covs[1] @ half), 0, None)).sum()
            value = float(((means[0] - means[1]) ** 2).sum() + np.trace(covs[0]) + np.trace(covs[1]) - 2 * cross)
        return pd.DataFrame({**row, "n_first": [counts[0]], "n_second": [counts[1]], "fid": [value]})

    return table.groupBy(*names).applyInPandas(distance, schema)


# --- memory bank ------------------------------------------------------------------------


def anomaly_scores(neighbours: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nearest distance and mean of the kept distances per query."""
    return neighbours.groupBy(*keys).agg(
        F.min("distance").alias("nearest"), F.avg("distance").alias("mean_distance"),
        F.count(F.lit(1)).alias("n_neighbours"),
    )


# --- summaries over classes ----------------------------------------------------------------


def quality_flags(
    rows: DataFrame, kid: str, rate: str, accepted: str, low: float, high: float, candidates: int,
    multiplier: float = 1.5,
) -> DataFrame:
    """Adds the Tukey fence over all rows and the flag text per row (``OK`` without flags)."""
    least = int(np.ceil(low * candidates))
    quartiles = exact_percentiles(
        rows.select(F.lit(1).alias("__all"), kid), ["__all"], kid, {"q1": 0.25, "q3": 0.75}
    )
    spread = F.col("q3") - F.col("q1")
    fence = quartiles.select(
        F.struct(
            (F.col("q1") - multiplier * spread).alias("low"), (F.col("q3") + multiplier * spread).alias("high")
        )
    )
    # Flag names that report readers expect.
    flags = F.array_compact(
        F.array(
            F.when((F.col(rate) < low) | (F.col(rate) > high), "LFS_OUTSIDE_EXPECTED_BAND"),
            F.when(F.col(accepted) < least, "LOW_ACCEPTED_COUNT"),
            F.when((F.col(kid) < F.col("fence_low")) | (F.col(kid) > F.col("fence_high")), "KID_OUTLIER"),
        )
    )
    fenced = rows.withColumn("__fence", fence.scalar()).withColumns(
        {"fence_low": F.col("__fence.low"), "fence_high": F.col("__fence.high")}
    )
    return fenced.withColumn(
        "flags", F.when(F.size(flags) == 0, "OK").otherwise(F.array_join(flags, ","))
    ).drop("__fence")


def fidelity_rows(
    real: DataFrame, synthetic: DataFrame, acceptance: DataFrame, exclusions: DataFrame,
    keys: Sequence[str], vector: str, item: str, whole_sets_dim: int | None = None,
) -> DataFrame:
    """One fidelity row per class from feature vectors, acceptance rates and crop exclusions.

    The kernel distance is the mean over seeded subsets; ``whole_sets_dim``, the vectors'
    length, asks for the distance of the whole sets instead.
    """
    both = real.select(*keys, item, vector, F.lit("real").alias("__side")).unionByName(
        synthetic.select(*keys, item, vector, F.lit("synthetic").alias("__side"))
    )
    fid = frechet_distance(both, keys, "__side", vector, "real", "synthetic")
    if whole_sets_dim is not None:
        kid = kernel_distance(both, keys, "__side", vector, "real", "synthetic", whole_sets_dim).select(*keys, "kid")
    else:
        kid = kernel_distance_subsets(both, keys, "__side", item, vector, "real", "synthetic").select(*keys, "kid")
    diversity = mean_pairwise_distance(synthetic, keys, vector).select(*keys, "diversity")
    names = list(keys)
    joined = fid
    for other in (kid, diversity, acceptance, exclusions):
        joined = join_groups(joined, other, names)
    return joined.select(
        *names,
        F.col("n_first").alias("n_real"), F.col("n_second").alias("n_synth"), "crop_exclusion_count",
        F.col("fid").alias("FID"), F.col("kid").alias("KID"),
        F.col("diversity").alias("LPIPS_diversity"), F.col("acceptance_rate").alias("lfs_acceptance"),
    )
