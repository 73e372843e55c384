"""Every stage of the corpus pipeline against a plain version over its own input, and the edge cases."""

import re
from collections import defaultdict

import pytest
from test_pairs_and_packing import base_spans, check_packing

import corpus_pipeline
from defectspark.llm import packing, queries
from defectspark.llm.common import store

SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(text, n):
    w = words(text)
    size = min(n, len(w))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()


def stage_outputs(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(store(stage(spark, out[-1], folder), f"test-{name}"))
    return out


@pytest.fixture(scope="module")
def outputs(spark):
    return stage_outputs(spark, SF)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_order_and_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for df in outputs[1:-1]:
        assert df.dtypes == outputs[0].dtypes
    for before, after in zip(outputs[:3], outputs[1:4], strict=True):
        assert after.exceptAll(before).count() == 0


def test_toxicity_stage(spark, outputs):
    before, after = texts_of(outputs[0]), texts_of(outputs[1])
    predicted = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op4_toxicity"](spark, SF).collect()}
    assert set(after) == {k for k in before if not predicted[k]}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [k for k in before if labels.get(k) == 0]
    toxic = [k for k in before if labels.get(k) == 1]
    assert sum(k not in after for k in clean) <= 0.01 * len(clean)
    assert sum(k not in after for k in toxic) >= 0.8 * len(toxic)


def test_near_duplicate_stage(outputs):
    before, after = texts_of(outputs[1]), texts_of(outputs[2])
    sets = {k: windows(t, 5) for k, t in before.items()}
    holders, root = defaultdict(list), {k: k for k in before}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k in sorted(before):
        shared = defaultdict(int)
        for s in sets[k]:
            for o in holders[s]:
                shared[o] += 1
            holders[s].append(k)
        linked = [o for o, n in shared.items() if n >= 0.8 * (len(sets[k]) + len(sets[o]) - n)]
        if not sets[k] and before[k] is not None:
            linked = [o for o in before if o < k and before[o] == before[k]]
        for o in linked:
            a, b = sorted((find(k), find(o)))
            root[b] = a
    assert set(after) == {k for k in before if find(k) == k}
    assert len(after) < len(before)


def test_decontamination_stage(spark, outputs):
    before, after = texts_of(outputs[2]), texts_of(outputs[3])
    found = set().union(*[windows(r["text"], 10) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    sizes = {len(w) for w in found}
    hit = {k for k, t in before.items() if any(windows(t, n) & found for n in sizes if len(words(t)) >= n)}
    assert hit and set(after) == set(before) - hit


def test_personal_data_stage(outputs):
    before, after = texts_of(outputs[3]), texts_of(outputs[4])
    assert set(after) == set(before)
    masked = 0
    for k, text in before.items():
        spans = base_spans(text)
        if any(spans.values()):
            masked += 1
            assert not any(base_spans(after[k]).values())
            assert all(f"[{kind.upper()}]" in after[k] for kind, at in spans.items() if at and kind != "card")
        elif text is None or not re.search("[0-9@]|[(\\[]at[)\\]]", text):
            assert after[k] == text
    assert masked
    assert all(r["n_chars"] == len(r["text"]) for r in outputs[4].where("text is not null").collect())


def test_packing_stage(outputs):
    from tokenizers import Tokenizer

    texts = list(texts_of(outputs[4]).items())
    sequences, tokens = check_packing(outputs[5].collect(), texts, Tokenizer.from_file(packing.tokenizer_path()))
    assert sequences <= -(-tokens // 2048) + 2


def test_edges(spark, tiny, none):
    """Null, empty, long and repeated texts pass all stages; empty tables give an empty result."""
    got = stage_outputs(spark, tiny)
    assert got[1].exceptAll(got[0]).count() == 0 and got[-2].columns == got[0].columns
    assert {r[0] for r in got[-1].select("doc_id").collect()} == {r[0] for r in got[-2].select("doc_id").collect()}
    empty = corpus_pipeline.run(spark, none)
    assert empty.count() == 0 and empty.columns == got[-1].columns


def test_tiny_rows_leave_every_stage(spark, tiny):
    """No label falls into the calibration fold, and still only the repeated and the contaminated rows go."""
    got = [sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect()) for df in stage_outputs(spark, tiny)]
    ids = lambda *keys: [(False, k) for k in keys]
    assert got[0] == got[1] == [*ids(1, 2, 3, 4, 4, 5, 6, 7), (True, 0)]
    assert got[2] == [*ids(1, 2, 3, 4, 5, 6, 7), (True, 0)]
    assert got[3] == got[4] == ids(1, 2, 3, 5, 7)
    assert sorted(set(got[5])) == ids(1, 2, 3, 5, 7)


@pytest.mark.parametrize("labels", [[], [(k, None) for k in range(40)], [(k, 1) for k in range(40)], "outside"])
def test_labels_that_allow_no_calibration(spark, tmp_path, labels):
    """Without usable calibration labels clean texts stay; with trees and no calibration rows toxic ones still go."""
    from pyspark.sql import functions as F

    from defectspark.llm.common import fold

    folder = str(tmp_path)
    texts = [(k, f"you are an idiot moron {k}" if k % 2 else f"a fine day in town {k}") for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    docs.write.parquet(f"{folder}/documents.parquet")
    if labels == "outside":
        docs.where(fold(F.col("doc_id"), 5) != 4).select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(f"{folder}/labels.parquet")
        want = {k for k, _ in texts if k % 2 == 0}
    else:
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
        want = {k for k, _ in texts}
    assert set(texts_of(corpus_pipeline.drop_toxic(spark, docs, folder))) == want
    assert {r["doc_id"] for r in queries.QUERIES["op4_toxicity"](spark, folder).where("predicted = 0").collect()} == want
