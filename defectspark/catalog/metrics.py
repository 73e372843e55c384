"""Score, filter and vector-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectspark.catalog.masks import CROP
from defectspark.catalog.registry import query, table
from defectspark.operators import metrics as M
from defectspark.operators import ranking as K
from defectspark.operators import validate as V
from defectspark.operators.coreset import coreset
from defectspark.operators.neighbours import nearest_neighbours

EVENT_SCORES = "SELECT 'cat_' || user_id % 15 AS category, event_type = 'error' AS label, value AS score FROM events"


def score_view(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("cat_"), F.col("user_id") % 15).alias("category"),
        (F.col("event_type") == "error").alias("label"), F.col("value").alias("score"), "event_id", "event_type",
    )


def metric_sql(source: str) -> str:
    return f"""WITH s AS ({source}), r AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY score) +
        (count(*) OVER (PARTITION BY category, score) - 1) / 2.0::DOUBLE AS rk,
        sum(label::INT) OVER (PARTITION BY category ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
        count(*) OVER (PARTITION BY category ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS predicted,
        sum(label::INT) OVER (PARTITION BY category) AS p, count(*) OVER (PARTITION BY category) AS n FROM s)
      SELECT category, round((sum(rk) FILTER (WHERE label) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE) / nullif(any_value(p) * (any_value(n) - any_value(p)), 0), 6) AS auroc,
        round(max(2.0::DOUBLE * tp / (predicted + p)), 6) AS f1, any_value(p)::BIGINT AS n_pos, (any_value(n) - any_value(p))::BIGINT AS n_neg
      FROM r GROUP BY category"""


def rounded(df):
    return df.withColumn("auroc", F.round("auroc", 6)).withColumn("f1", F.round("f1", 6))


@query("image_auroc_f1", metric_sql(EVENT_SCORES))
def _auroc(spark, sf_dir):
    return rounded(M.threshold_metrics(score_view(spark, sf_dir), ["category"], "score", "label"))


@query(
    "pixel_auroc_f1",
    metric_sql(
        """SELECT 'class_' || label AS category, v::DOUBLE AS score, w::DOUBLE > 0.15 AS label FROM
           (SELECT label, unnest(embedding) AS v, unnest(list_reverse(embedding)) AS w FROM embeddings)"""
    ),
)
def _pixel_auroc(spark, sf_dir):
    pixels = table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("class_"), "label").alias("category"),
        F.inline(
            F.transform(
                F.arrays_zip(F.col("embedding").alias("v"), F.reverse("embedding").alias("w")),
                lambda p: F.struct(p["v"].cast("double").alias("score"), (p["w"].cast("double") > 0.15).alias("label")),
            )
        ),
    )
    return rounded(M.threshold_metrics(pixels, ["category"], "score", "label"))


@query(
    "sigma_thresholds",
    "SELECT 'cat_' || user_id % 15 AS category, round(avg(value) + 3 * stddev_samp(value), 6) AS threshold FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def _sigma(spark, sf_dir):
    normals = score_view(spark, sf_dir).where(~F.col("label"))
    return M.sigma_thresholds(normals, ["category"], "score").withColumn("threshold", F.round("threshold", 6))


FILTER = """
f AS (SELECT p_partkey, p_brand, p_retailprice AS score, quantile_cont(p_retailprice, 0.25) OVER (PARTITION BY p_brand) AS threshold FROM part)"""


def filtered_view(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("score"))
    return M.percentile_filter(parts, ["p_brand"])


@query("percentile_filter", f"WITH {FILTER} SELECT p_partkey, round(threshold, 6) AS threshold, score >= threshold AS accepted FROM f")
def _filter(spark, sf_dir):
    return filtered_view(spark, sf_dir).select("p_partkey", F.round("threshold", 6).alias("threshold"), "accepted")


SUMMARY = """
acc AS (SELECT p_brand, count(*) AS candidates, sum((score >= threshold)::INT)::BIGINT AS accepted, avg((score >= threshold)::INT) AS acceptance_rate,
         avg(score) AS mean_score, any_value(threshold) AS threshold FROM f GROUP BY p_brand)"""


@query(
    "acceptance_summary",
    f"""WITH {FILTER}, {SUMMARY} SELECT p_brand, candidates, accepted, candidates - accepted AS rejected, round(acceptance_rate, 6) AS acceptance_rate,
        round(mean_score / 7, 6) AS mean_score, round(threshold, 6) AS threshold FROM acc""",
)
def _summary(spark, sf_dir):
    s = M.acceptance_summary(filtered_view(spark, sf_dir), ["p_brand"])
    return s.select(
        "p_brand", "candidates", "accepted", "rejected",
        F.round(F.col("mean_score") / 7, 6).alias("mean_score"),
        *[F.round(c, 6).alias(c) for c in ("acceptance_rate", "threshold")],
    )


@query(
    "acceptance_gate",
    f"""WITH {FILTER}, {SUMMARY} SELECT p_brand, 'acceptance rate outside range' AS rule FROM acc WHERE acceptance_rate > 0.75
        UNION ALL SELECT p_brand, 'accepted below target' FROM acc WHERE accepted < 60""",
)
def _gate(spark, sf_dir):
    s = M.acceptance_summary(filtered_view(spark, sf_dir), ["p_brand"])
    return V.violations(s, ["p_brand"], V.acceptance_rules(0.3, 0.75, 60))


@query(
    "score_percentiles",
    """SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95
       FROM events GROUP BY event_type""",
)
def _percentiles(spark, sf_dir):
    p = K.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


@query(
    "masked_distances",
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS b FROM embeddings)
       SELECT vec_id, round(sum(CASE WHEN a > 0.15 THEN (a - b) * (a - b) ELSE 0 END) / 64, 6) AS score FROM e GROUP BY vec_id""",
)
def _masked(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").alias("generated"), F.reverse("embedding").alias("clean"),
        F.transform("embedding", lambda v: v.cast("double") > 0.15).alias("mask"),
    )
    return M.score_candidates(vectors).select("vec_id", F.round("score", 6).alias("score"))


# --- vector sets: class = label, side by the sign of the first entry ---------------------------

SIDES = "v AS (SELECT vec_id, 'class_' || label AS class, CASE WHEN embedding[1] >= 0 THEN 'real' ELSE 'synthetic' END AS side, embedding::DOUBLE[] AS x FROM embeddings)"


def side_view(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.concat(F.lit("class_"), "label").alias("class"),
        F.when(F.get("embedding", 0) >= 0, "real").otherwise("synthetic").alias("side"), "embedding",
    )


@query(
    "pairwise_diversity",
    f"""WITH {SIDES} SELECT a.class, round(avg(list_distance(a.x, b.x) ** 2), 6) AS diversity FROM v a JOIN v b ON a.class = b.class AND a.vec_id < b.vec_id
        GROUP BY a.class""",
)
def _diversity(spark, sf_dir):
    d = M.mean_pairwise_distance(side_view(spark, sf_dir), ["class"], "embedding")
    return d.where("n > 1").select("class", F.round("diversity", 6).alias("diversity"))


@query(
    "kernel_distance",
    f"""WITH {SIDES}, k AS (SELECT a.class, a.side AS s, b.side AS t, a.vec_id = b.vec_id AS same, (list_dot_product(a.x, b.x) / 64 + 1) ** 3 AS k
          FROM v a JOIN v b ON a.class = b.class),
        n AS (SELECT class, count(*) FILTER (WHERE side = 'real') AS n_first, count(*) FILTER (WHERE side = 'synthetic') AS n_second FROM v GROUP BY class)
        SELECT class, n_first, n_second, round(CASE WHEN n_first > 1 AND n_second > 1 THEN
          sum(k) FILTER (WHERE s = 'real' AND t = 'real' AND NOT same) / (n_first * (n_first - 1)::DOUBLE)
          + sum(k) FILTER (WHERE s = 'synthetic' AND t = 'synthetic' AND NOT same) / (n_second * (n_second - 1)::DOUBLE)
          - 2 * sum(k) FILTER (WHERE s = 'real' AND t = 'synthetic') / (n_first * n_second::DOUBLE) END, 6) AS kid
        FROM k JOIN n USING (class) GROUP BY class, n_first, n_second""",
)
def _kid(spark, sf_dir):
    return M.kernel_distance(side_view(spark, sf_dir), ["class"], "side", "embedding", "real", "synthetic", 64).select(
        "class", "n_first", "n_second", F.round("kid", 6).alias("kid")
    )


@query(
    "kernel_distance_subsets",
    f"""WITH {SIDES}, n AS (SELECT class, side, count(*) AS n FROM v GROUP BY ALL),
        m AS (SELECT class, least(min(n), 1000) AS m FROM n GROUP BY class HAVING count(*) = 2 AND min(n) > 1),
        drawn AS (SELECT class, side, subset, x, vec_id FROM (
          SELECT v.*, m, subset, row_number() OVER (PARTITION BY class, side, subset ORDER BY sha256('42|' || subset || '|' || vec_id)) AS r
          FROM v JOIN m USING (class), (SELECT unnest(range(20)) AS subset)) WHERE r <= m),
        k AS (SELECT class, a.subset, a.side AS s, b.side AS t, sum((list_dot_product(a.x, b.x) / 64 + 1) ** 3) AS k
          FROM drawn a JOIN drawn b USING (class, subset) WHERE a.side <> b.side OR a.vec_id <> b.vec_id GROUP BY ALL),
        d AS (SELECT class, subset, sum(k) FILTER (WHERE s = t) / (m * (m - 1)::DOUBLE) - sum(k) FILTER (WHERE s <> t) / (m * m::DOUBLE) AS kid
          FROM k JOIN m USING (class) GROUP BY class, subset, m)
        SELECT class, round(avg(kid), 6) AS kid, count(*) AS subsets FROM d GROUP BY class""",
)
def _kid_subsets(spark, sf_dir):
    found = M.kernel_distance_subsets(
        side_view(spark, sf_dir), ["class"], "side", "vec_id", "embedding", "real", "synthetic", subsets=20
    )
    return found.select("class", F.round("kid", 6).alias("kid"), "subsets")


@query(
    "set_moments",
    f"""WITH {SIDES}, p AS (SELECT class, side, i, unnest(range(i, 64)) AS j, x FROM (SELECT *, unnest(range(64)) AS i FROM v))
        SELECT class, side, i::INT AS i, j::INT AS j, count(*) AS n, round(avg(x[i + 1]), 6) AS mean_i, round(covar_samp(x[i + 1], x[j + 1]), 6) AS covariance
        FROM p GROUP BY ALL""",
)
def _moments(spark, sf_dir):
    found = M.set_moments(side_view(spark, sf_dir), ["class", "side"], "embedding")
    return found.select("class", "side", "i", "j", "n", F.round("mean_i", 6).alias("mean_i"), F.round("covariance", 6).alias("covariance"))


@query("frechet_distance")
def _fid(spark, sf_dir):
    return M.frechet_distance(side_view(spark, sf_dir), ["class"], "side", "embedding", "real", "synthetic")


@query(
    "coreset",
    f"""WITH RECURSIVE {SIDES}, s AS (SELECT class, min(vec_id) AS first, ceil(count(*) * 0.1)::BIGINT AS wanted FROM v GROUP BY class),
        g(class, pick, vec_id, wanted, ids, cs) AS (
          SELECT s.class, 0::BIGINT, s.first, s.wanted, [s.first], [v.x] FROM s JOIN v ON v.vec_id = s.first
          UNION ALL
          SELECT class, pick + 1, top.vec_id, wanted, list_append(ids, top.vec_id), list_append(cs, top.x)
          FROM (SELECT g.class, g.pick, g.wanted, g.ids, g.cs,
                  arg_max({{'vec_id': v.vec_id, 'x': v.x}}, {{'d': list_min(list_transform(g.cs, lambda c: list_distance(c, v.x))), 'k': -v.vec_id}}) AS top
                FROM g JOIN v ON v.class = g.class AND NOT list_contains(g.ids, v.vec_id) WHERE g.pick + 1 < g.wanted GROUP BY ALL))
        SELECT class, vec_id, pick FROM g""",
)
def _coreset(spark, sf_dir):
    return coreset(side_view(spark, sf_dir), ["class"], "vec_id", "embedding", ratio=0.1)


@query(
    "nearest_neighbours",
    f"""WITH {SIDES}, d AS (SELECT a.class, a.vec_id, list_distance(a.x, b.x) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.x, b.x)) AS rank_no
          FROM v a JOIN v b ON a.class = b.class AND a.side = 'synthetic' AND b.side = 'real')
        SELECT class, vec_id, round(min(distance), 6) AS nearest, round(avg(distance), 6) AS mean_distance, count(*) AS n_neighbours FROM d WHERE rank_no <= 9 GROUP BY ALL""",
)
def _knn(spark, sf_dir):
    vectors = side_view(spark, sf_dir)
    found = nearest_neighbours(
        vectors.where("side = 'synthetic'"), vectors.where("side = 'real'"), ["class"], "vec_id", "embedding"
    )
    scores = M.anomaly_scores(found, ["class", "vec_id"])
    return scores.select(
        "class", "vec_id", F.round("nearest", 6).alias("nearest"), F.round("mean_distance", 6).alias("mean_distance"), "n_neighbours"
    )


@query(
    "image_scores_max",
    f"""WITH {SIDES}, d AS (SELECT a.class, a.vec_id, min(list_distance(a.x, b.x)) AS nearest
          FROM v a JOIN v b ON a.class = b.class AND a.side = 'synthetic' AND b.side = 'real' GROUP BY ALL)
        SELECT class, round(max(nearest), 6) AS image_score FROM d GROUP BY class""",
)
def _image_scores(spark, sf_dir):
    """Image score: the largest nearest-neighbour distance over the image's patches."""
    vectors = side_view(spark, sf_dir)
    found = nearest_neighbours(
        vectors.where("side = 'synthetic'"), vectors.where("side = 'real'"), ["class"], "vec_id", "embedding", k=1
    )
    return found.groupBy("class").agg(F.round(F.max("distance"), 6).alias("image_score"))


def fidelity_view(spark, sf_dir):
    from defectspark.catalog.views import mask_view
    from defectspark.operators.masks import crop_eligibility, with_crop

    vectors = side_view(spark, sf_dir)
    acceptance = (
        M.acceptance_summary(
            M.percentile_filter(vectors.select("class", "vec_id", F.get("embedding", 1).cast("double").alias("score")), ["class"]), ["class"]
        ).select("class", "acceptance_rate")
    )
    exclusions = crop_eligibility(with_crop(mask_view(spark, sf_dir), 9), "class").select("class", "crop_exclusion_count")
    return M.fidelity_rows(
        vectors.where("side = 'real'"), vectors.where("side = 'synthetic'"), acceptance, exclusions, ["class"], "embedding", "vec_id", whole_sets_dim=64
    )


@query("fidelity_rows")
def _fidelity(spark, sf_dir):
    return fidelity_view(spark, sf_dir)


@query(
    "fidelity_table",
    f"""WITH {SIDES}, k AS (SELECT a.class, a.side AS s, b.side AS t, sum((list_dot_product(a.x, b.x) / 64 + 1) ** 3) FILTER (WHERE a.vec_id <> b.vec_id) AS k
          FROM v a JOIN v b ON a.class = b.class GROUP BY ALL),
        n AS (SELECT class, count(*) FILTER (WHERE side = 'real') AS n_real, count(*) FILTER (WHERE side = 'synthetic') AS n_synth FROM v GROUP BY class),
        kid AS (SELECT class, sum(k) FILTER (WHERE s = 'real' AND t = 'real') / (n_real * (n_real - 1)::DOUBLE)
            + sum(k) FILTER (WHERE s = 'synthetic' AND t = 'synthetic') / (n_synth * (n_synth - 1)::DOUBLE)
            - 2 * sum(k) FILTER (WHERE s = 'real' AND t = 'synthetic') / (n_real * n_synth::DOUBLE) AS kid FROM k JOIN n USING (class) GROUP BY class, n_real, n_synth),
        lpips AS (SELECT a.class, avg(list_distance(a.x, b.x) ** 2) AS d FROM v a JOIN v b ON a.class = b.class AND a.side = 'synthetic' AND b.side = 'synthetic' AND a.vec_id < b.vec_id GROUP BY a.class),
        cut AS (SELECT class, quantile_cont(x[2], 0.25) AS t FROM v GROUP BY class),
        rate AS (SELECT class, avg((x[2] >= t)::INT) AS r FROM v JOIN cut USING (class) GROUP BY class),
        {CROP.format(s=9)}, lost AS (SELECT 'class_' || label AS class, count(reason) AS crop_exclusion_count FROM crop GROUP BY ALL)
        SELECT class, n_real, n_synth, crop_exclusion_count, round(kid, 6) AS KID, round(d, 6) AS LPIPS_diversity, round(r, 6) AS lfs_acceptance
        FROM n JOIN kid USING (class) JOIN lpips USING (class) JOIN rate USING (class) JOIN lost USING (class)""",
)
def _fidelity_table(spark, sf_dir):
    """Every column of the fidelity rows that SQL can state; the matrix root of the remaining one has no SQL form."""
    rounded_to = [F.round(c, 6).alias(c) for c in ("KID", "LPIPS_diversity", "lfs_acceptance")]
    return fidelity_view(spark, sf_dir).select("class", "n_real", "n_synth", "crop_exclusion_count", *rounded_to)


@query(
    "quality_flags",
    """WITH r AS (SELECT l_suppkey, avg(l_extendedprice) AS kid, avg(l_discount) * 10 AS rate, count(*) AS accepted FROM lineitem GROUP BY 1),
       q AS (SELECT quantile_cont(kid, 0.25) AS q1, quantile_cont(kid, 0.75) AS q3 FROM r)
       SELECT l_suppkey, CASE WHEN f = '' THEN 'OK' ELSE f END AS flags, round(q1 - 0.5 * (q3 - q1), 6) AS fence_low, round(q3 + 0.5 * (q3 - q1), 6) AS fence_high
       FROM (SELECT r.*, q.*, concat_ws(',', CASE WHEN rate < 0.48 OR rate > 0.52 THEN 'LFS_OUTSIDE_EXPECTED_BAND' END,
          CASE WHEN accepted < 581 THEN 'LOW_ACCEPTED_COUNT' END,
          CASE WHEN kid < q1 - 0.5 * (q3 - q1) OR kid > q3 + 0.5 * (q3 - q1) THEN 'KID_OUTLIER' END) AS f FROM r, q)""",
)
def _flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.avg("l_extendedprice").alias("kid"), (F.avg("l_discount") * 10).alias("rate"), F.count(F.lit(1)).alias("accepted")
    )
    flagged = M.quality_flags(rows, "kid", "rate", "accepted", 0.48, 0.52, 1210, multiplier=0.5)
    return flagged.select(
        "l_suppkey", "flags", F.round("fence_low", 6).alias("fence_low"), F.round("fence_high", 6).alias("fence_high")
    )
