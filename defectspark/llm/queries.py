"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.catalog.registry import table
from defectspark.llm import (
    collinear,
    cover_tree,
    decision_lists,
    decontamination,
    jaccard_join,
    language_id,
    packing,
    periodic_runs,
    pii,
    pitman_yor,
    reply_trees,
    sharding,
    toxicity,
)
from defectspark.llm.common import fold, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = 40


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def one_label(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One label per id, so that repeated label rows cannot multiply documents: the largest; ids without one drop out."""
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & F.col(name).isNotNull())
    return labels.groupBy("doc_id").agg(F.max(name).alias(name))


def label_sample(spark: SparkSession, sf_dir: str, name: str, rows: int = 12_000) -> DataFrame:
    """About ``rows`` labels, taken by the hash of the id, to fit a classifier on; so few that they are broadcast."""
    labels = one_label(spark, sf_dir, name)
    share = rows / max(labels.count(), 1)
    spot = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(name)), F.lit(1 << 30)) / float(1 << 30)
    return F.broadcast(labels.where(spot < share))


@query("op1_hilbert_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards of equal count along a Hilbert curve over language, source and length.

    A null text has no bytes: size 16, checksum 0. Null ids sort first in their cell.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(_utf8(F.col("text"))).cast("long") + 16).alias("size"), F.crc32(_utf8(F.col("text"))).alias("text_crc32"),
    )
    placed = sharding.hilbert_shards(docs, ["lang", "source", "n_chars"], ["doc_id", "size", "text_crc32"], SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


@query("op2_pii_boosting")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every text; a null text counts as empty.

    Base spans and candidates are stored once, thin, for learning and for the result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = store(pii.with_spans(docs).select("doc_id", "__pii"), "pii-spans")
    model = pii.fit(found, fold(F.col("doc_id"), 4) == 0)
    spans = F.col("__pii")
    return found.select(
        "doc_id", *[F.size(spans["base"][k]).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(pii.span_text(pii.all_spans(spans)), 256).alias("base_sha256"),
        pii.span_text(pii.all_spans(spans, model)).alias("spans"),
    )


@query("op3_quality_lists")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every text and the verdict of the learned list.

    Statistics are stored once, thin, and serve both learning and the verdict. A null text has no
    words and fails the base.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    thin = ["doc_id", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *decision_lists.FEATURES]
    stats = store(decision_lists.text_statistics(docs).select(*thin), "quality-stats")
    rules = decision_lists.learn(stats.join(one_label(spark, sf_dir, "quality"), "doc_id"), "quality", fold(F.col("doc_id"), 3) == 0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & rules.keeps()).alias("kept"), rules.rule().alias("rule"),
    )


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.ToxicityModel:
    """Fitted on labelled rows outside the held-out fifth; another fold of them calibrates."""
    doc_id = F.col("doc_id")
    labelled = docs.select("doc_id", "text").where(fold(doc_id, 5) != 0).join(label_sample(spark, sf_dir, "toxic"), "doc_id")
    return toxicity.fit(labelled, "toxic", fold(doc_id, 5) == 4)


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text. The features of all texts are stored once, for fitting and scoring."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    doc_id = F.col("doc_id")
    labels = label_sample(spark, sf_dir, "toxic")
    train = docs.where(~fold(doc_id, 5).isin(0, 4)).join(labels, "doc_id")
    lexicon = toxicity.learn_lexicon(train, "text", "toxic")
    rows = store(toxicity.with_features(docs, lexicon).select("doc_id", "__f"), "toxicity-features")
    model = toxicity.fit_on_features(rows.where(fold(doc_id, 5) != 0).join(labels, "doc_id"), lexicon, "toxic", fold(doc_id, 5) == 4)
    scored = rows.select("doc_id", (fold(doc_id, 5) == 0).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NORMAL = rf"coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


@query(
    "op6_decontamination",
    f"""
    WITH items AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0),
    windows AS (
      SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
    docs AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
    places AS (
      SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
    found AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (n, g)),
    hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
    listed AS (
      SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside any occurrence of a 10-word test window."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"), 10)
    n_hit = F.aggregate(F.arrays_zip("hits.starts", "hits.ends"), F.lit(0).cast("long"), lambda s, x: s + x["ends"] - x["starts"])
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


@query("op7_language")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    counts = language_id.learn(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = language_id.identify(docs.select("doc_id", "text"), counts)
    return found.select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"),
    )


@query("op8_pattern_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 tokens."""
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_text_links")


@query("op5_pitman_yor")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text, learned outside the held-out tenth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor.score(docs, fold(F.col("doc_id"), 10) != 0)


@query("op10_collinear_passages")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document that other documents repeat."""
    found = collinear.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_dup = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    text = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return found.select("doc_id", "n_words", n_dup.alias("n_dup_words"), text.alias("spans"), "copies")


# The escapes of reply_trees, as lengths.
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"


@query(
    "op13_reply_trees",
    f"""
    WITH said AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    whole AS (
      SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
        sum(14 + length({_ESCAPED.format('role')}) + length(role) - length(replace(role, ':', '')) + length({_ESCAPED.format('text')})) AS formatted_chars
      FROM said GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars,
      sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
    FROM whole
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted as the one path of its reply tree; digests are read back from the output."""
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    threads = reply_trees.thread_messages(rows, "conv_id", "turn", "role", "text")
    done = reply_trees.format_paths(threads, "conv_id", "node", "parent", "role", "text")
    said = reply_trees.read_back(F.col("formatted"))
    learned = reply_trees.learned_text(F.col("formatted"), F.col("turns"))
    digest = F.array_join(F.transform(said, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op12_cover_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, searched among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = cover_tree.clean_rows(vectors, "vec_id", moved, "embedding")
    return cover_tree.hard_negatives(rows, F.col("id") % 100 == 0)


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, a tenth of which are given a periodic tail first, and the text without their repeats."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), change=periodic_runs.planted)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )
