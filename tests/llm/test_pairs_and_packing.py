"""Personal data, packing and the Jaccard join against brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from defectspark.llm import common, jaccard_join, packing, pii, queries
from defectspark.llm.common import fold
from defectspark.llm.components import components

SF = "/root/testdata/sf0.001"


def table_texts(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(c) * (2 if i % 2 else 1)))) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return {k: [m.span() for m in re.finditer(p, text or "") if holds(k, m.group())] for k, p in PATTERNS.items()}


NASTY = [
    "a@b.c_d@e.f x.@y..z _a@b-.c-d. é@é.com ünï+me@host.example.org.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.255.0300 0.0.0.0 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5500005555555559 41 11",
    "+1 (586) 555-8430 +12 34 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +44.20.7946.0958) +",
    "😀 mail x@y.zz 😀 4111111111111111 😀+1 212 555 0000",
    "7" * 20000 + " " + "a" * 30000 + "@", "1.2.3.4 " * 400, None, "",
]


def test_pii_base_and_redaction(spark):
    rows = spark.createDataFrame(list(enumerate(NASTY)), "doc_id int, text string")
    found = pii.with_spans(rows)
    spans = found.select("doc_id", pii.span_text(pii.all_spans(found["__pii"])).alias("s")).collect()
    for key, got in spans:
        want = [f"{k}:{a}:{b}" for k, at in base_spans(NASTY[key]).items() for a, b in at]
        assert got == ",".join(want), key
    model = pii.fit(found, fold(found["doc_id"], 2) == 0)
    texts = {r["doc_id"]: r["text"] for r in pii.redact(rows, model).collect()}
    assert texts[7] is None and texts[8] == ""
    assert texts[6].count("[IP]") == 400 and "@" not in texts[4] and texts[4].startswith("😀 mail [EMAIL] 😀")


def test_pii_query(spark, tiny):
    for folder in ("/root/testdata/sf0.01", tiny):
        texts = defaultdict(list)
        for k, t in table_texts(spark, folder):
            texts[k].append(t)
        for r in queries.QUERIES["op2_pii_boosting"](spark, folder).collect():
            want = base_spans(texts[r["doc_id"]][0])
            joined = [f"{k}:{a}:{b}" for k, at in want.items() for a, b in at]
            assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(len(want[k]) for k in pii.KINDS)
            assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
            assert set(joined) <= set(r["spans"].split(",") if r["spans"] else [])


def test_pii_model_adds_what_looks_alike(spark):
    """Cards that fail the checksum look like the others; plain long numbers inside words do not."""
    draw = np.random.RandomState(5)

    def card():
        head = "4" + "".join(map(str, draw.randint(0, 10, 14)))
        return next(head + str(d) for d in range(10) if holds("card", head + str(d)))

    good = [(i, f"pay with card 4{i:03d} please {card()} or mail me@host.example.org") for i in range(300)]
    plain = [(i, f"order no{i:016d}x shipped") for i in range(300, 600)]
    odd = [(1000, "use card 4111111111111112 now"), (1001, "order no4111111111111112x shipped")]
    rows = spark.createDataFrame(good + plain + odd, "doc_id int, text string")
    found = pii.with_spans(rows)
    model = pii.fit(found, fold(found["doc_id"], 4) == 0)
    out = {r[0]: r[1] for r in found.where("doc_id >= 1000").select("doc_id", pii.span_text(pii.all_spans(found["__pii"], model))).collect()}
    assert out == {1000: "card:9:25", 1001: ""}


def test_tokens_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    texts = [t for _, t in table_texts(spark, SF)] + [
        "It's I'LL don't 'sun ''s !'s x'S 12a3é ß×÷ÿ <|endoftext|> a<|startoftext|>b", "é   x\x1cy 　 日本語 Ünï İstanbul ΟΔΟΣ", "", " \n ",
    ]
    texts += [f"a{chr(c)}b {chr(c)} c{chr(c)}" for c in [*range(1, 0x250), 0x1680, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600]]
    encoder = packing.ChunkEncoder(packing.tokenizer_path())
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    for some in (slice(None), slice(None), slice(0, 50), slice(100, None)):
        ids, ends = encoder.encode(pa.array(texts)[some])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[some]
    for text, ids in zip(texts, want):
        assert encoder.encode(pa.array([text]))[0].tolist() == ids


def check_packing(rows, texts, tokenizer):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for key, text in texts:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want[key] += [(k, k * 2048, len(ids[i:i + 8192]) // 4, zlib.crc32(ids[i:i + 8192])) for k, i in enumerate(range(0, len(ids), 8192))]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_seq), sum(r["length"] for r in rows)


def test_packing_query(spark, tiny, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    for folder in (SF, tiny):
        used, total = check_packing(queries.QUERIES["op8_pattern_packing"](spark, folder).collect(), table_texts(spark, folder), plain)
        assert used <= -(-total // 2048) + 2
    assert queries.QUERIES["op8_pattern_packing"](spark, none).collect() == []


def test_plan_is_tight_and_complete():
    draw = np.random.RandomState(3)
    for scale in (1, 50, 100_000):
        counts = np.zeros(257, np.int64)
        counts[1:] = draw.poisson(scale, 256) * (np.arange(1, 257) < 200)
        plan = packing.plan_packing(counts, 256)
        assert plan.left.sum() == 0
        total = int((counts * np.arange(257)).sum())
        assert plan.sequences <= 1.01 * total / 256 + 2
    patterns = packing.patterns_for(8, np.ones(9))
    assert sorted(map(tuple, patterns.tolist()))[:2] == [(0, 1, 7), (0, 2, 6)] and (patterns.sum(axis=1) == 8).all()
    repeats = packing.fit_repeats(np.array([[0, 2, 6], [0, 4, 4]]), np.array([0, 0, 5, 0, 8, 0, 5, 0, 0.0]))
    assert np.allclose(repeats, [5, 4], atol=1e-3)


def test_sequences_carry_ids(spark):
    docs = spark.createDataFrame([(1, "hello there"), (2, "x"), (3, None)], "doc_id int, text string")
    cut = packing.pieces(docs, packing.tokenizer_path(), 16, with_ids=True)
    rows = packing.sequences(packing.pack(cut, ["doc_id", "piece"], 16)).collect()
    assert sum(len(r["ids"]) for r in rows) == 4 * sum(r["length"] for r in cut.collect())


def classes(texts, threshold=0.8, n=5):
    shingler = jaccard_join.Shingler(n)
    sets = [(set(shingler(t).tolist()), t) for _, t in texts]
    near = [[] for _ in sets]
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            b, t = sets[j]
            if (s is not None and s == t) or (a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)) and len(a & b) >= threshold * len(a | b)):
                near[i].append(j)
                near[j].append(i)
    label = {}
    for i in range(len(sets)):
        if i not in label:
            stack, group = [i], {i}
            while stack:
                for k in near[stack.pop()]:
                    if k not in group:
                        group.add(k)
                        stack.append(k)
            ids = [texts[k][0] for k in group if texts[k][0] is not None]
            label |= dict.fromkeys(group, min(ids) if ids else None)
    return Counter((texts[i][0], label[i], len(near[i])) for i in range(len(sets)))


@pytest.mark.parametrize("which", ["sf0.01", "tiny"])
def test_jaccard_query(spark, tiny, which):
    folder = tiny if which == "tiny" else f"/root/testdata/{which}"
    rows = queries.QUERIES["op9_jaccard_join"](spark, folder).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == classes(table_texts(spark, folder))


def test_jaccard_blocks(spark):
    """A large group of near copies, dealt out as pairs of blocks, loses no link."""
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(90):
        copy = list(words)
        copy[(7 * i) % 120] = f"x{i % 40}"
        texts.append((i, " ".join(copy)))
    texts += [(100 + i, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = jaccard_join.near_duplicates(docs, block_rows=16, bucket_rows=16).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == classes(texts)
    assert sum(r["first"] for r in rows) == len({r["class_id"] for r in rows})
    assert jaccard_join.choose_bands(0.8, 0.9995) == (20, 5)


def test_keep_first(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    kept = jaccard_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, None, 5, 6, 7])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 60), (70, 71)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 50, 50: 50, 60: 50, 70: 70, 71: 70}
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_rows_of_one_key_meet_only_equal_texts(spark, monkeypatch):
    """With a null id in every row, each text of a cluster is cut into shingles once, and links stay right."""
    words = [f"w{i}" for i in range(60)]
    texts = [(None, " ".join([f"c{c}_{w}" for w in words[:-1]] + [f"t{c}_{v}"])) for c in range(20) for v in range(3)]
    texts += [(None, texts[0][1])] * 30 + [(None, " ".join(f"u{i}_{k}" for k in range(30))) for i in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cut, plain = [], jaccard_join.shingle_sets
    monkeypatch.setattr(jaccard_join, "shingle_sets", lambda rows, *rest: cut.append(rows.count()) or plain(rows, *rest))
    rows = jaccard_join.near_duplicates(docs).collect()
    assert cut == [60]
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows) == classes(texts)
    assert sum(r["first"] for r in rows) == 220


def test_text_steps_send_few_rows_at_a_time(spark):
    """A stored step may ask for small batches; the session's own size holds before and after, also where the step fails."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"

    @F.pandas_udf("int")
    def together(x: pd.Series) -> pd.Series:
        return pd.Series(len(x), index=x.index)

    @F.pandas_udf("int")
    def fails(x: pd.Series) -> pd.Series:
        raise ValueError("no")

    old, rows = spark.conf.get(size), spark.range(0, 3000, 1, 1)
    assert common.store(rows.select(together("id").alias("n")), "few", 500).agg(F.max("n")).first()[0] == 500
    assert common.store(rows.select(together("id").alias("n")), "all").agg(F.max("n")).first()[0] == min(int(old), 3000)
    with pytest.raises(Exception, match="no"):
        common.store(rows.select(fails("id")), "none", 500)
    assert spark.conf.get(size) == old


def test_workers_give_memory_back(spark):
    """After its last batch a packing task leaves little in its worker, which waits beside those of other stages."""
    draw = np.random.RandomState(3)
    texts = [" ".join(f"w{x:x}q" for x in draw.randint(0, 10**9, 400)) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)

    @F.pandas_udf("long")
    def held(x: pd.Series) -> pd.Series:
        with open("/proc/self/smaps_rollup") as f:
            return pd.Series(sum(int(line.split()[1]) for line in f if line.startswith("Anonymous:")) // 1024, index=x.index)

    rest = lambda: max(r[0] for r in spark.range(0, 64, 1, 16).select(held("id")).collect())
    before = rest()
    packing.pieces(docs, packing.tokenizer_path()).agg(F.sum("length")).collect()
    after = rest()
    assert after - before < 60, (before, after)
