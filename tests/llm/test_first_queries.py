"""Sharding, quality lists, toxicity, decontamination and language against brute force and edge cases."""

import hashlib
import os
import re
import tempfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from defectspark.llm import decision_lists, decontamination, language_id, queries, sharding, toxicity
from defectspark.llm.boosting import fit_boosted, fit_isotonic

SF = "/root/testdata/sf0.001"
EDGE_ROWS = 9
NAMES = ["op1_hilbert_shards", "op3_quality_lists", "op4_toxicity", "op6_decontamination", "op7_language"]


@pytest.mark.parametrize("name", NAMES)
def test_edges(spark, tiny, none, name):
    rows = queries.QUERIES[name](spark, tiny).collect()
    assert len(rows) == EDGE_ROWS
    assert queries.QUERIES[name](spark, none).collect() == []


def documents(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def check_rows_law(rows, texts):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(40)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert r["grown_shard"] is None and r["law"] == "rows"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards(spark, tiny):
    rows = queries.QUERIES["op1_hilbert_shards"](spark, SF).collect()
    texts = documents(spark, SF)
    assert len(rows) == len(texts)
    check_rows_law(rows, texts)
    ordered = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert ordered == sorted(ordered)
    check_rows_law([r for r in queries.QUERIES["op1_hilbert_shards"](spark, tiny).collect()], documents(spark, tiny))


def test_shards_prune_on_every_dimension(spark):
    """A language lies in few of the 40 shards, and so does a source or a length; sorted by length alone, all languages lie in most."""
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source", "n_chars").collect()}
    shard = {r["doc_id"]: r["shard"] for r in queries.QUERIES["op1_hilbert_shards"](spark, folder).collect()}
    by_length = {k: i * 40 // len(docs) for i, k in enumerate(sorted(docs, key=lambda k: (docs[k]["n_chars"], k)))}
    held = lambda place, of, value: len({place[k] for k, r in docs.items() if r[of] == value})
    for lang in ("de", "es", "fr"):
        assert held(shard, "lang", lang) <= 14 and held(by_length, "lang", lang) >= 30, lang
    assert held(shard, "lang", "en") <= 32
    assert max(held(shard, "source", s) for s in {r["source"] for r in docs.values()}) <= 18
    ends = {}
    for k, s in shard.items():
        n = docs[k]["n_chars"]
        low, high = ends.get(s, (n, n))
        ends[s] = (min(low, n), max(high, n))
    spans = [sum(low <= r["n_chars"] <= high for low, high in ends.values()) / 40 for r in docs.values()]
    assert np.mean(spans) <= 0.4


def test_cells_of_long_texts_with_one_beginning(spark):
    """Values that share a long prefix are told apart, and cells follow the counts."""
    values = [f"https://example.org/page/{i:03d}" for i in range(100)] + ["https://example.org/page/000"] * 300 + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v string").withColumn("c", sharding._text_cells(spark.createDataFrame([(v,) for v in values], "v string"), "v", 3))
    cells = {r["v"]: r["c"] for r in rows.where("v IS NOT NULL").distinct().collect()}
    order = [cells[v] for v in sorted(cells)]
    assert order == sorted(order) and order[0] == 3 and set(order[1:]) == {6, 7}


def test_shard_boxes_prune(spark):
    """Curve neighbours touch in one dimension, and written shards hold all rows."""
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(axis=1).max() == 1
    path = tempfile.mkdtemp(prefix="run-") + "/shards"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, path, ["lang", "source", "n_chars"], ["doc_id"], 8)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and set(docs.columns) <= set(back.columns)
    assert len([f for f in os.listdir(path) if f.startswith("shard=")]) == 8


def statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


@pytest.mark.parametrize("which", ["sf", "tiny"])
def test_quality_base(spark, tiny, which):
    folder = SF if which == "sf" else tiny
    texts = documents(spark, folder)
    for r in queries.QUERIES["op3_quality_lists"](spark, folder).collect():
        want = statistics(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_list_finds_junk(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_quality_lists"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    long = [x for x in labels if not rows[x["doc_id"]]["base_failed"]]
    right = sum(rows[x["doc_id"]]["kept"] == bool(x["quality"]) for x in long)
    assert right >= 0.97 * len(long)


def test_decision_list_recovers_rule(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4000).select(
        (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"), "id",
    ).withColumn("good", (~((F.col("a") > 60) & (F.col("b") <= 30))).cast("int"))
    found = decision_lists.learn(rows, "good", F.col("id") % 3 == 0, ["a", "b"], bins=100)
    wrong = rows.where(found.keeps() != (F.col("good") == 1)).count()
    assert wrong <= 60 and found.rules
    assert decision_lists.learn(rows.where("good = 1"), "good", F.lit(True), ["a", "b"]).rules == []


def auc(pairs):
    order = sorted(pairs)
    ranks, i = {}, 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ranks[order[i][0]] = (i + j + 1) / 2
        i = j
    pos = [ranks[s] for s, y in pairs if y]
    return (sum(pos) - len(pos) * (len(pos) + 1) / 2) / (len(pos) * (len(pairs) - len(pos)))


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"  # sf0.01 has eight toxic held-out rows, too few to measure
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_toxicity"](spark, folder).collect()}
    labels = [x for x in spark.read.parquet(f"{folder}/labels.parquet").collect() if x["toxic"] is not None]
    for r in rows.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(rows[x["doc_id"]]["score"], x["toxic"]) for x in labels if rows[x["doc_id"]]["held_out"]]
    assert auc(held) > 0.97


def test_toxicity_by_language(spark):
    """All labelled documents. Of Spanish, with fewest labels, half are found (README)."""
    folder = "/root/testdata/sf0.1"
    labels = {x["doc_id"]: x["toxic"] for x in spark.read.parquet(f"{folder}/labels.parquet").collect() if x["toxic"] is not None}
    langs = {x["doc_id"]: x["lang"] for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    hits = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op4_toxicity"](spark, folder).collect()}
    recall = lambda keys: sum(hits[k] for k in keys) / len(keys)
    toxic = [k for k, t in labels.items() if t == 1]
    assert recall(toxic) >= 0.85 and recall([k for k, t in labels.items() if t == 0]) <= 0.01
    for lang, least in (("en", 0.85), ("de", 0.85), ("fr", 0.85), ("es", 0.5)):
        assert recall([k for k in toxic if langs[k] == lang]) >= least, lang


def test_toxicity_features():
    plain = toxicity._features("You are an idiot. Fine day", frozenset(["idiot"]))
    assert dict(zip(toxicity.FEATURES, plain, strict=True))["near_you"] > 0
    masked = dict(zip(toxicity.FEATURES, toxicity._features("an 1d10t here", frozenset(["idiot"])), strict=True))
    assert masked["obfuscated"] == 1 and toxicity._features(None, frozenset()) == (0.0,) * len(toxicity.FEATURES)


def test_boosting_and_isotonic(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select((F.col("id") % 71).cast("double").alias("a"), (F.col("id") % 53).cast("double").alias("b"))
    rows = rows.withColumn("y", ((F.col("a") > 40) != (F.col("b") > 25)).cast("int"))
    model = fit_boosted(rows, ["a", "b"], "y", rounds=8, depth=3, bins=100)  # cuts fine enough to hold the two thresholds
    assert rows.where((model.margin() > 0).cast("int") == F.col("y")).count() > 4900
    points = fit_isotonic(rows, model.margin(), "y")
    assert points == sorted(points) and [p for _, p in points] == sorted(p for _, p in points)
    assert fit_boosted(rows.where("y = 0"), ["a", "b"], "y").trees == []


def contaminated(texts, items, n=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for key, text in texts:
        words, inside, found = low(text), set(), set()
        for item, passage in items:
            w = low(passage)
            k = min(n, len(w))
            want = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if k else set()
            for i in range(len(words) - k + 1) if k else ():
                if tuple(words[i:i + k]) in want:
                    inside.update(range(i, i + k))
                    found |= {str(item)} if item is not None else set()
        ids = ",".join(sorted(found))
        out.append((key, len(words), len(inside), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(inside)))
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [64 << 20, 2000])
def test_decontamination(spark, tiny, block_bytes, monkeypatch):
    full = decontamination.contamination
    monkeypatch.setattr(decontamination, "contamination", lambda d, b, n: full(d, b, n, block_bytes=block_bytes))
    for folder in (SF, tiny):
        items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
        texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
        got = queries.QUERIES["op6_decontamination"](spark, folder).collect()
        assert Counter(map(tuple, got)) == contaminated(texts, items)


def test_remove_spans_and_documents(spark):
    docs = spark.createDataFrame([(1, "Keep THIS, but drop me now. Yes"), (2, None), (3, "clean")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "drop me now")], "item_id int, text string")
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, items).collect()}
    assert cut == {1: "Keep THIS, but . Yes", 2: None, 3: "clean"}
    assert [r["doc_id"] for r in decontamination.remove_documents(docs, items).orderBy("doc_id").collect()] == [2, 3]


def test_language_held_out(spark, tiny):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op7_language"](spark, folder).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in queries.QUERIES["op7_language"](spark, tiny).collect():
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3)) and 0 <= r["score"] <= 1


def test_unseen_words_fall_back(spark):
    counts = [("a", 0, "known", 5), ("b", 0, "other", 5), ("a", 1, "q", 9), ("b", 1, "z", 9), ("b", 2, "zz", 3)]
    scorer = language_id._Scorer(counts)
    assert scorer.predict("qqq")[0] == "a" and scorer.predict("zzz")[0] == "b" and scorer.predict("other")[0] == "b"
    assert scorer.predict("12 !") == ("und", 0.0)


def test_language_against_plain_scoring(spark):
    """Counting and scoring again with plain dictionaries, word by word."""
    import math

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.where("doc_id % 3 > 0")
    counts = language_id.learn(train)
    words, grams, total = Counter(), Counter(), Counter()
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    for r in train.where("lang IS NOT NULL AND text IS NOT NULL").collect():
        for w in letters(r["text"]):
            words[r["lang"], w] += 1
            for size in range(1, 5):
                padded = w if size == 1 else f"_{w}_"
                for i in range(len(padded) - size + 1):
                    grams[r["lang"], size, padded[i:i + size]] += 1
    kept = {(lang, 0, w): n for (lang, w), n in words.items() if n >= 2} | {k: n for k, n in grams.items() if n >= 2}
    assert {(lang, size, e): n for lang, size, e, n in counts} == kept
    langs = sorted({k[0] for k in kept})
    for (lang, size, _), n in kept.items():
        total[lang, size] += n
    known = {(size, e) for _, size, e in kept}
    score = lambda lang, size, e: math.log((kept.get((lang, size, e), 0) + 0.5) / (1 + total[lang, size]))

    def plain(word):
        if (0, word) in known:
            return [score(lang, 0, word) for lang in langs]
        padded, hits = f"_{word}_", []
        for i in range(len(padded) - 1):
            for size in (4, 3, 2, 1):
                part = padded[i:i + size]
                if len(part) == size and (size, part) in known:
                    hits.append([score(lang, size, part) for lang in langs])
                    break
        return [sum(h[j] for h in hits) / len(hits) for j in range(len(langs))] if hits else [0.0] * len(langs)

    for r in language_id.identify(docs.select("doc_id", "text"), counts).collect():
        sums = [sum(x) for x in zip(*map(plain, letters(r["text"])))] or None
        if sums is None:
            assert tuple(r["language"]) == ("und", 0.0)
        else:
            best = max(sums)
            assert r["language"]["lang"] == langs[sums.index(best)] or sorted(sums)[-2] > best - 1e-6
            assert r["language"]["score"] == pytest.approx(1 / sum(math.exp(s - best) for s in sums), abs=1e-6)
