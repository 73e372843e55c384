"""Series, result-table and sweep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectspark.catalog.registry import query, table
from defectspark.catalog.views import sample_view
from defectspark.functions import geometry as G
from defectspark.functions import text as X
from defectspark.functions.rounding import lenient_fixed_text
from defectspark.operators import ranking as K
from defectspark.operators import results as R
from defectspark.operators import series as S
from defectspark.operators import validate as V

SERIES = """
ser AS (SELECT event_type, ts, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
               count(*) OVER (PARTITION BY event_type) AS n_values FROM events)"""


def series_view(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    return S.numbered(events, ["event_type"], [F.col("ts"), F.col("event_id")], K.Balanced.over_time(F.col("ts"), F.col("event_id")))


@query(
    "loss_trend",
    f"""WITH {SERIES} SELECT event_type, any_value(n_values) AS n_values, 0 AS n_bad, round(avg(value) FILTER (WHERE step <= 5), 6) AS first_mean,
        round(avg(value) FILTER (WHERE step > n_values - 5), 6) AS last_mean FROM ser GROUP BY event_type""",
)
def _trend(spark, sf_dir):
    t = S.loss_trend(series_view(spark, sf_dir), ["event_type"], "value")
    return t.select("event_type", "n_values", "n_bad", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


@query(
    "loss_gate",
    f"""WITH {SERIES}, t AS (SELECT event_type, avg(value) FILTER (WHERE step <= 5) AS f, avg(value) FILTER (WHERE step > n_values - 5) AS l FROM ser GROUP BY event_type)
        SELECT event_type, 'loss did not fall' AS rule FROM t WHERE NOT l < f""",
)
def _gate(spark, sf_dir):
    return V.violations(S.loss_trend(series_view(spark, sf_dir), ["event_type"], "value"), ["event_type"], V.loss_rules())


@query(
    "downsampled_series",
    f'WITH {SERIES} SELECT event_type, (step - 1) // 8 + 1 AS "update", round(avg(value), 5) AS mean_value, count(*) AS n_steps FROM ser GROUP BY ALL',
)
def _down(spark, sf_dir):
    d = S.downsampled(series_view(spark, sf_dir), ["event_type"], "value")
    return d.withColumn("mean_value", F.round("mean_value", 5))


@query(
    "running_throughput",
    f"""WITH {SERIES} SELECT event_id, round(step / nullif((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type)) / 1e6::DOUBLE, 0), 6) AS per_second FROM ser""",
)
def _throughput(spark, sf_dir):
    t = S.throughput(series_view(spark, sf_dir), ["event_type"], "ts")
    return t.select("event_id", F.round("per_second", 6).alias("per_second"))


@query(
    "broken_steps",
    """WITH o AS (SELECT event_type, event_id, value, max(CASE WHEN value > 60 THEN event_id - 40 ELSE event_id END) OVER (PARTITION BY event_type ORDER BY ts
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, CASE WHEN value > 60 THEN event_id - 40 ELSE event_id END AS step FROM events)
       SELECT event_type, step, CASE WHEN value < 0.5 THEN 'non-finite value' ELSE 'step out of order' END AS rule FROM o WHERE value < 0.5 OR step <= seen""",
)
def _broken(spark, sf_dir):
    """Large values logged 40 steps too low, small values turned into not-a-number."""
    v = F.col("value")
    events = table(spark, sf_dir, "events").select(
        "event_type", "ts", F.when(v > 60, F.col("event_id") - 40).otherwise(F.col("event_id")).alias("step"),
        F.when(v < 0.5, F.lit(float("nan"))).otherwise(v).alias("loss"),
    )
    return S.broken_steps(events, ["event_type"], "step", ["loss"], "ts")


# --- result tables: dataset = order status, category = order priority ----------------------

RES = """
res AS (SELECT l_returnflag AS dataset, ' Supplier ' || l_suppkey AS category,
               CASE WHEN l_suppkey % 9 = 0 THEN '' WHEN l_suppkey % 11 = 0 THEN 'n/a' ELSE (floor(sum(l_quantity)) / 8)::VARCHAR END AS image_auc,
               (floor(avg(l_linenumber) * 4) / 4)::VARCHAR AS f1, min(l_discount)::VARCHAR AS pixel FROM lineitem GROUP BY l_returnflag, l_suppkey)"""


def result_view(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        (F.floor(F.sum("l_quantity")) / 8).alias("q"), (F.floor(F.avg("l_linenumber") * 4) / 4).alias("f")
    )
    key = F.col("l_suppkey")
    return lines.select(
        F.col("l_returnflag").alias("dataset"), F.concat(F.lit(" Supplier "), key.cast("string")).alias("Category "),
        F.when(key % 9 == 0, "").when(key % 11 == 0, "n/a").otherwise(F.col("q").cast("string")).alias("Image_AUC"),
        F.col("f").cast("string").alias("image F1"),
    )


def unified_view(spark, sf_dir):
    return R.unify_headers(result_view(spark, sf_dir), keep=["dataset"])


@query(
    "unified_headers",
    f"WITH {RES} SELECT dataset, trim(category) AS category, try_cast(image_auc AS DOUBLE) AS image_AUROC, try_cast(f1 AS DOUBLE) AS image_F1Score, NULL::DOUBLE AS pixel_AUROC FROM res",
)
def _unified(spark, sf_dir):
    return unified_view(spark, sf_dir).select(
        "dataset", "category", *[F.col(c).try_cast("double").alias(c) for c in ("image_AUROC", "image_F1Score", "pixel_AUROC")]
    )


FMT = "CASE WHEN try_cast({c} AS DOUBLE) IS NULL THEN 'N/A' ELSE printf('%.4f', round_even(try_cast({c} AS DOUBLE), 4)) END"


@query(
    "section_table",
    f"""WITH {RES} SELECT dataset AS section, 0 AS place, lower(trim(category)) AS sort_name, dataset, trim(category) AS category,
          {FMT.format(c='image_auc')} AS image_AUROC, {FMT.format(c='f1')} AS image_F1Score, 'N/A' AS pixel_AUROC, 'N/A' AS pixel_F1Score FROM res
        UNION ALL SELECT dataset, 1, '', dataset, 'MEAN', printf('%.4f', round_even(avg(try_cast(image_auc AS DOUBLE)), 4)), printf('%.4f', round_even(avg(try_cast(f1 AS DOUBLE)), 4)), 'N/A', 'N/A' FROM res GROUP BY dataset
        UNION ALL SELECT DISTINCT dataset, 2, '', '', '', '', '', '', '' FROM res WHERE dataset < (SELECT max(dataset) FROM res)""",
)
def _sections(spark, sf_dir):
    return R.section_table(unified_view(spark, sf_dir), "dataset", "category", R.METRICS)


@query(
    "results_with_mean",
    f"""WITH {RES} SELECT dataset, trim(category) AS category, try_cast(image_auc AS DOUBLE) AS auroc FROM res
        UNION ALL SELECT dataset, 'MEAN', round(avg(try_cast(image_auc AS DOUBLE)), 6) FROM res GROUP BY dataset""",
)
def _means(spark, sf_dir):
    rows = unified_view(spark, sf_dir).select("dataset", "category", F.col("image_AUROC").try_cast("double").alias("auroc"))
    return R.with_mean(rows, ["dataset"], "category", ["auroc"]).withColumn("auroc", F.round("auroc", 6))


@query(
    "lenient_numbers",
    f"WITH {RES} SELECT dataset, trim(category) AS category, {FMT.format(c='image_auc')} AS shown FROM res",
)
def _lenient(spark, sf_dir):
    return unified_view(spark, sf_dir).select("dataset", "category", lenient_fixed_text(F.coalesce("image_AUROC", F.lit(""))).alias("shown"))


@query(
    "latest_runs",
    """SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS o_totalprice, max((o_orderdate, o_orderkey))[2] AS o_orderkey
       FROM orders GROUP BY ALL""",
)
def _latest(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey", "o_totalprice")
    newest = R.latest_runs(orders, ["o_custkey", "o_orderpriority"], ["o_orderdate", "o_orderkey"])
    return newest.drop("o_orderdate")


@query(
    "category_readiness",
    """WITH s AS (SELECT d.source AS category, count(*) FILTER (WHERE l.doc_id IS NULL) AS train_total, count(*) FILTER (WHERE toxic = 1) AS test_anomalous,
          count(*) FILTER (WHERE toxic = 0) AS test_normal FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1)
       SELECT category, CASE WHEN category = 'src4' THEN 'held back' WHEN train_total = 0 THEN 'nothing to train on' WHEN test_anomalous = 0 THEN 'no anomalous test image'
          WHEN test_normal = 0 THEN 'no normal test image' ELSE 'ok' END AS reason,
          category <> 'src4' AND train_total > 0 AND test_anomalous > 0 AND test_normal > 0 AND train_total < 30 AS low_sample FROM s""",
)
def _readiness(spark, sf_dir):
    return ready_view(spark, sf_dir).select("category", "reason", "low_sample")


def ready_view(spark, sf_dir):
    stats = sample_view(spark, sf_dir).groupBy(F.col("class").alias("category")).agg(
        F.count_if(F.col("mask_path").isNull()).alias("train_total"),
        F.count_if(F.col("is_toxic")).alias("test_anomalous"),
        F.count_if(F.col("mask_path").isNotNull() & ~F.col("is_toxic")).alias("test_normal"),
    ).withColumn("in_manifest", F.lit(True))
    return R.readiness(stats, {"src4": "held back"}, low_sample=30)


@query(
    "sweep_outcome",
    """WITH s AS (SELECT d.source AS category, count(*) FILTER (WHERE l.doc_id IS NULL) AS train_total, count(*) FILTER (WHERE toxic = 1) AS a,
          count(*) FILTER (WHERE toxic = 0) AS n, count(*) FILTER (WHERE lang = 'fr') AS fr, count(*) FILTER (WHERE lang = 'de' AND toxic = 1) AS de
          FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1),
       r AS (SELECT *, CASE WHEN category = 'src4' THEN 'held back' WHEN train_total = 0 THEN 'nothing to train on' WHEN a = 0 THEN 'no anomalous test image'
          WHEN n = 0 THEN 'no normal test image' ELSE 'ok' END AS reason FROM s),
       t AS (SELECT CASE WHEN reason <> 'ok' THEN 'skipped' WHEN fr > 8 THEN 'successful' WHEN de > 0 THEN 'failed' ELSE 'pending' END AS status, reason FROM r)
       SELECT status, CASE status WHEN 'skipped' THEN reason WHEN 'failed' THEN 'out of memory' ELSE '' END AS why, count(*) AS n_categories FROM t GROUP BY ALL""",
)
def _outcome(spark, sf_dir):
    samples = sample_view(spark, sf_dir)
    done = samples.groupBy(F.col("class").alias("category")).agg(F.count_if(F.col("defect_type") == "fr").alias("fr")).where("fr > 8")
    failed = samples.where((F.col("defect_type") == "de") & F.col("is_toxic")).select(F.col("class").alias("category"), F.lit("out of memory").alias("error"))
    return R.sweep_outcome(ready_view(spark, sf_dir), done, failed)


@query(
    "run_table",
    """WITH p AS (SELECT user_id AS run_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS c, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'view') AS v,
          arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'purchase') AS t FROM events GROUP BY 1)
       SELECT run_id, 'category_' || run_id AS category, coalesce(c, v) AS auroc, t AS seconds FROM p WHERE c IS NOT NULL OR v IS NOT NULL OR t IS NOT NULL""",
)
def _runs(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    logged = events.select(F.col("user_id").alias("run_id"), F.struct("ts", "event_id").alias("step"), F.col("event_type").alias("key"), "value")
    params = events.select(F.col("user_id").alias("run_id")).distinct().select(
        "run_id", F.lit("category").alias("key"), F.concat(F.lit("category_"), F.col("run_id").cast("string")).alias("value")
    )
    return R.run_table(logged, params, {"auroc": ["click", "view"], "seconds": ["purchase"]})


@query(
    "key_set_mismatches",
    """WITH a AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_type <> 'SMALL'), b AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_type <> 'ECONOMY')
       SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def _mismatch(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return R.key_set_mismatches(parts.where("p_type <> 'SMALL'"), parts.where("p_type <> 'ECONOMY'"), ["p_brand", "p_size"])


@query(
    "resume_plan",
    """SELECT c_custkey, CASE WHEN (SELECT count(DISTINCT o_orderstatus) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus IN ('F', 'O')) = 2 THEN 'reuse' ELSE 'train' END AS action FROM customer""",
)
def _resume(spark, sf_dir):
    scope = table(spark, sf_dir, "customer").select("c_custkey")
    artefacts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("kind"))
    return R.resume_plan(scope, artefacts, ["c_custkey"], ["F", "O"])


WORDS = "len(regexp_extract_all(text, '[A-Za-z0-9]+'))"


@query(
    "length_summary",
    f"""WITH s AS (SELECT role, {WORDS} AS n, length(text) AS c, turn FROM conversations)
        SELECT role, count(*) AS examples, min(n) AS min_length, max(n) AS max_length, min(c) AS min_target, max(c) AS max_target, max(turn) AS max_tokens,
          round(quantile_cont(n, 0.5), 6) AS median_length, round(quantile_cont(n, 0.95), 6) AS p95_length, round(quantile_cont(n, 0.99), 6) AS p99_length FROM s GROUP BY role""",
)
def _lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "role", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("n"), F.length("text").alias("c"), "turn"
    )
    s = R.length_summary(rows, ["role"], "n", "c", "turn")
    return s.select(*[c for c in s.columns if not c.endswith("length") or c.startswith("m") and c != "median_length"],
                    *[F.round(c, 6).alias(c) for c in ("median_length", "p95_length", "p99_length")])


@query(
    "longest_examples",
    f"SELECT conv_id, turn, {WORDS} AS n FROM conversations ORDER BY n DESC, conv_id DESC, turn DESC LIMIT 5",
)
def _longest(spark, sf_dir):
    """A top-k report: the five longest sequences, ties by key descending."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("n")
    )
    return rows.orderBy(F.desc("n"), F.desc("conv_id"), F.desc("turn")).limit(5)


@query(
    "too_long_sequences",
    f"SELECT conv_id, turn, 'sequence too long' AS rule FROM conversations WHERE {WORDS} > 60",
)
def _too_long(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), 0)).alias("n")
    )
    return V.violations(rows, ["conv_id", "turn"], V.length_rules("n", 60))


@query(
    "table_fingerprint",
    """SELECT o_orderpriority, count(*) AS n_rows, sum(('0x' || sha256(coalesce(length(o_orderkey::VARCHAR) || ':' || o_orderkey, '-') || coalesce(length(o_custkey::VARCHAR) || ':' || o_custkey, '-') || coalesce(length(o_orderstatus) || ':' || o_orderstatus, '-'))[1:15])::UBIGINT)::VARCHAR AS fingerprint
       FROM (SELECT o_orderpriority, o_orderkey, o_orderstatus, CASE WHEN o_custkey % 7 > 0 THEN o_custkey END AS o_custkey FROM orders) GROUP BY 1""",
)
def _fingerprint(spark, sf_dir):
    """Every seventh customer is unknown."""
    orders = table(spark, sf_dir, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")))
    return R.table_fingerprint(orders, ["o_orderpriority"], ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(
    "vision_tokens",
    """WITH s AS (SELECT l_orderkey, l_partkey * 3 + 40 AS w, l_suppkey * 29 + 40 AS h FROM lineitem),
       r AS (SELECT *, round_even(w / 28.0::DOUBLE, 0) * 28 AS w0, round_even(h / 28.0::DOUBLE, 0) * 28 AS h0 FROM s),
       b AS (SELECT *, sqrt(w * h / 3211264.0::DOUBLE) AS shrink, sqrt(200704.0::DOUBLE / (w * h)) AS grow FROM r)
       SELECT l_orderkey, sum(CASE WHEN w0 * h0 > 3211264 THEN greatest(1, floor(w / shrink / 28)) * greatest(1, floor(h / shrink / 28))
          WHEN w0 * h0 < 200704 THEN ceil(w * grow / 28) * ceil(h * grow / 28) ELSE w0 * h0 / 784 END)::BIGINT AS tokens FROM b GROUP BY l_orderkey""",
)
def _tokens(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") * 3 + 40).alias("w"), (F.col("l_suppkey") * 29 + 40).alias("h"))
    return lines.groupBy("l_orderkey").agg(F.sum(G.vision_tokens(F.col("w"), F.col("h"))).alias("tokens"))


@query(
    "class_slugs",
    """SELECT p_partkey, nullif(rtrim(ltrim(regexp_replace(lower(regexp_replace(p_size || '. ' || p_name || ' / ' || p_brand, '^[0-9]+[._ -]*', '')), '[^a-z0-9]+', '-', 'g'), '-'), '-'), '') AS slug,
         replace(replace(p_name || ' mean/' || p_type, '/', '_'), ' ', '_') AS metric FROM part""",
)
def _slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        X.class_slug(F.concat(F.col("p_size").cast("string"), F.lit(". "), "p_name", F.lit(" / "), "p_brand")).alias("slug"),
        X.metric_key(F.concat("p_name", F.lit(" mean/"), "p_type")).alias("metric"),
    )


@query(
    "fidelity_violations",
    """WITH r AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS n_real, count(*) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 49) AS n_synth,
          avg(l_discount) * 20.5 AS rate FROM lineitem GROUP BY 1)
       SELECT l_suppkey, 'invalid counts' AS rule FROM r WHERE n_real < 2 OR n_synth < 5 - 3
       UNION ALL SELECT l_suppkey, 'acceptance outside [0,1]' FROM r WHERE rate > 1 OR rate < 0
       UNION ALL SELECT l_suppkey, 'non-finite metric' FROM r WHERE l_suppkey < 7""",
)
def _fidelity_rules(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("n_real"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 49)).alias("n_synth"),
        (F.avg("l_discount") * 20.5).alias("lfs_acceptance"),
    )
    rows = rows.select(
        "l_suppkey", F.lit("ds").alias("dataset"), F.lit("c").alias("class"), "n_real", "n_synth", F.lit(0).alias("crop_exclusion_count"),
        F.when(F.col("l_suppkey") < 7, F.lit(float("inf"))).otherwise(1.0).alias("FID"), F.lit(0.1).alias("KID"),
        F.lit(0.2).alias("LPIPS_diversity"), "lfs_acceptance",
    )
    return V.violations(rows, ["l_suppkey"], V.fidelity_rules())
