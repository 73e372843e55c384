"""N-gram Jaccard join by MinHash banding.

Texts with the same shingle set are one node. Nodes meet where a band of their signatures agrees;
bands and rows are chosen for the target recall at the threshold. Inside a bucket, signatures
are compared with a wide margin, which leaves clusters of true near copies without the chance
meetings. Each cluster is then verified on full shingle sets. Buckets and clusters beyond a block
are dealt out as pairs of blocks, so no group meets in one task, and tasks emit a spanning forest
and link counts instead of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.common import TEXT_ROWS, give_back, store
from defectspark.llm.components import components
from defectspark.llm.decontamination import normal_words

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HELD_WORDS = 50_000


def choose_bands(threshold: float, recall: float, most_rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``most_rows`` rows that meet with probability ``recall`` at the threshold."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**most_rows)), most_rows


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct 64-bit hashes of ``n``-word shingles; a shorter text is one shingle, one without words none."""

    def __init__(self, n: int) -> None:
        self.n, self.held = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = normal_words(text)
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.held) > _HELD_WORDS:
            self.held = {}
        held = self.held
        for w in set(words).difference(held):
            held[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(held.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(hashes))
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * _MULTIPLIER + hashes[k:len(hashes) - n + 1 + k]
        return np.unique(_mixed(out))


def fingerprint(shingles: np.ndarray, text: str | None) -> tuple[int | None, int | None]:
    """128 bits of the set; of the text itself if it has no words; null for a null text."""
    if text is None:
        return None, None
    if not len(shingles):
        whole = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), seed=1)
        return tuple(np.frombuffer(whole, np.int64).tolist())
    both = np.array([shingles.sum(), _mixed(shingles ^ _MULTIPLIER).sum()], np.uint64)
    return tuple(both.view(np.int64).tolist())


class Signer:
    """MinHash values cut to 16 bits, and one 64-bit key per band of full values."""

    def __init__(self, bands: int, rows: int) -> None:
        draw = np.random.RandomState(7)
        size = bands * rows
        self.bands, self.rows = bands, rows
        self.a = draw.randint(0, 2**62, size).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.randint(0, 2**62, size).astype(np.uint64)

    def __call__(self, shingles: np.ndarray) -> tuple[bytes, list[int]]:
        low = np.full(len(self.a), np.iinfo(np.uint32).max, np.uint32)
        for i in range(0, len(shingles), 2048):
            values = (shingles[i:i + 2048, None] * self.a + self.b) >> np.uint64(32)
            low = np.minimum(low, values.min(axis=0).astype(np.uint32))
        key = np.arange(self.bands, dtype=np.uint64)
        for column in low.reshape(self.bands, self.rows).astype(np.uint64).T:
            key = key * _MULTIPLIER + column
        return (low & np.uint32(0xFFFF)).astype("<u2").tobytes(), _mixed(key).view(np.int64).tolist()


def signatures(docs: DataFrame, n: int, bands: int, rows: int, text: str, key: str) -> DataFrame:
    """Stored thin rows: row number, key, set size, fingerprint, signature, band keys."""

    @F.pandas_udf("struct<n:long,fp1:long,fp2:long,sig:binary,keys:array<long>>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler, signer = Shingler(n), Signer(bands, rows)
        for texts in batches:
            out = []
            for t in texts:
                s = shingler(t)
                out.append((len(s), *fingerprint(s, t), *(signer(s) if len(s) else (b"", []))))
            frame = pd.DataFrame(out, columns=["n", "fp1", "fp2", "sig", "keys"])
            del out
            yield frame.astype({"fp1": "Int64", "fp2": "Int64"})
            frame = texts = t = s = None  # gone before the next batch comes
        del shingler, signer
        give_back()

    signed = docs.select(F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("text_hash"), sign(F.col(text)).alias("s"))
    signed = signed.select("key", "text_hash", "s.*")
    rows_ = signed.withColumn("rid", F.monotonically_increasing_id())
    return store(rows_.withColumns({"fp1": F.coalesce("fp1", "rid"), "fp2": F.coalesce("fp2", F.lit(-1).cast("long"))}), "jaccard-signatures", TEXT_ROWS)


def in_blocks(rows: DataFrame, group: str, size: str, block_rows: int) -> DataFrame:
    """Deal each group out as pairs of blocks (``lo``, ``hi``); ``block`` is the row's own. Small groups are one block."""
    blocks = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    out = rows.withColumn("block", own).withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = out.withColumns({"lo": F.least("block", "__other"), "hi": F.greatest("block", "__other")}).drop("__other")
    return out.repartition(group, "lo", "hi").sortWithinPartitions(group, "lo", "hi", "rid")


def by_group(keys: list[str], work: Callable[[pd.DataFrame], list[tuple]], columns: list[str]):
    """For ``mapInPandas`` over sorted rows: call ``work`` once per run of equal keys, across batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            ids = batch[keys].to_numpy()
            edges = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
            out: list[tuple] = []
            if held and (held[0][keys].iloc[0].to_numpy() != ids[0]).any():
                out += work(pd.concat(held, ignore_index=True))
                held = []
            for a, b in zip(edges[:-2], edges[1:-1], strict=True):
                part = batch.iloc[a:b]
                if held:
                    part = pd.concat([*held, part], ignore_index=True)
                    held = []
                out += work(part)
            held.append(batch.iloc[edges[-2]:])
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(work(pd.concat(held, ignore_index=True)), columns=columns)
        held, batch = [], None
        give_back()

    return run


def candidate_edges(sigs: DataFrame, threshold: float, margin: float, block_rows: int) -> DataFrame:
    """Forest edges (a, b) between rows of ``sigs`` whose signatures agree within the margin in a shared bucket."""
    keyed = sigs.select("rid", F.explode("keys").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    met = keyed.join(shared, "bucket").join(sigs.select("rid", "n", "sig"), "rid")

    def work(rows: pd.DataFrame) -> list[tuple]:
        ids, n = rows["rid"].to_numpy(), rows["n"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), "<u2").reshape(len(rows), -1)
        least = (threshold - margin) * sig.shape[1]
        open_, edges = np.arange(len(ids)), []
        while len(open_):
            queue, open_ = [open_[0]], open_[1:]
            while queue and len(open_):
                i = queue.pop()
                fits = (n[open_] >= threshold * n[i]) & (n[i] >= threshold * n[open_]) & ((sig[open_] == sig[i]).sum(axis=1) >= least)
                new = open_[fits]
                edges += [(int(ids[i]), int(ids[j])) for j in new]
                queue += new.tolist()
                open_ = open_[~fits]
        return edges

    dealt = in_blocks(met, "bucket", "m", block_rows).select("bucket", "lo", "hi", "rid", "n", "sig")
    return dealt.mapInPandas(by_group(["bucket", "lo", "hi"], work, ["a", "b"]), "a long, b long")


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs at or above the threshold, from exact intersection sizes."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.float64)
    common = np.zeros((k, k))
    if k == 2:
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(k), sizes.astype(int))
        many = times[column] > 1
        row, column = row[many], (np.cumsum(times > 1) - 1)[column[many]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        width = 8192
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, [start, start + width])
            dense = np.zeros((k, width), np.float32)
            dense[row[a:b], column[a:b] - start] = 1
            common += dense @ dense.T
    linked = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
    np.fill_diagonal(linked, False)
    return linked


def verified(rows: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(rid, root, docs, texts) per row and pair of blocks: its root in the block's forest, linked documents and texts.

    ``rows``: cluster, m (its size), rid, copies, shingles (bytes). Rows of one ``rid`` count once.
    """

    def work(part: pd.DataFrame) -> list[tuple]:
        part = part.drop_duplicates("rid")
        ids, copies, block = part["rid"].to_numpy(), part["copies"].to_numpy(), part["block"].to_numpy()
        linked = _links([np.frombuffer(s, np.uint64) for s in part["shingles"]], threshold)
        if part["lo"].iloc[0] != part["hi"].iloc[0]:
            linked &= block[:, None] != block[None, :]
        root = np.full(len(ids), -1)
        for i in range(len(ids)):
            if root[i] < 0:
                stack, root[i] = [i], i
                while stack:
                    near = np.flatnonzero(linked[stack.pop()] & (root < 0))
                    root[near] = i
                    stack += near.tolist()
        docs, texts = linked @ copies, linked.sum(axis=1)
        return [(int(a), int(ids[r]), int(d), int(t)) for a, r, d, t in zip(ids, root, docs, texts, strict=True) if t]

    dealt = in_blocks(rows, "cluster", "m", block_rows).select("cluster", "lo", "hi", "block", "rid", "copies", "shingles")
    return dealt.mapInPandas(by_group(["cluster", "lo", "hi"], work, ["rid", "root", "docs", "texts"]), "rid long, root long, docs long, texts long")


def shingle_sets(docs: DataFrame, n: int, text: Column, out: str) -> DataFrame:
    """Add ``out``: struct(fp1, fp2, shingles) with the full sorted set as bytes."""

    @F.pandas_udf("struct<fp1:long,fp2:long,shingles:binary>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for texts in batches:
            sets = [(shingler(t), t) for t in texts]
            frame = pd.DataFrame([(*fingerprint(s, t), s.tobytes()) for s, t in sets], columns=["fp1", "fp2", "shingles"])
            del sets
            yield frame.astype({"fp1": "Int64", "fp2": "Int64"})
            frame = texts = None  # gone before the next batch comes
        del shingler
        give_back()

    return docs.withColumn(out, cut(text))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
                    recall: float = 0.9995, margin: float = 0.25, block_rows: int = 256, bucket_rows: int = 4096) -> DataFrame:
    """One row per document: ``key``, ``text_hash``, ``class_id``, ``n_links``, ``n_text_links``, ``first``.

    Documents are linked at a Jaccard similarity of ``threshold`` or more of their sets of
    ``n``-word shingles (small letters, marks dropped); classes are the connected components and
    ``class_id`` is the smallest key in them. ``n_links`` counts linked documents, copies
    included, ``n_text_links`` linked different sets. A text of fewer words is one shingle. Texts
    without words are linked only to equal texts, null texts to none. Null keys sort last. Exactly
    one row of a class is ``first``, also among repeated rows. An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    sigs = signatures(docs, n, bands, rows, text, key)
    groups = sigs.groupBy("fp1", "fp2").agg(F.min("rid").alias("rep"), F.count("*").alias("copies"))
    members = store(sigs.select("rid", "key", "text_hash", "n", "fp1", "fp2").join(groups, ["fp1", "fp2"]), "jaccard-members")
    reps = members.where("rid = rep").select("rid", "key", "text_hash", "fp1", "fp2", "copies", "n")
    nodes = sigs.join(reps.where("n > 0").select("rid"), "rid").select("rid", "n", "sig", "keys")
    near = components(candidate_edges(nodes, threshold, margin, bucket_rows), "jaccard-clusters")
    sizes = near.groupBy("label").agg(F.count("*").alias("m"))
    wanted = near.withColumnRenamed("node", "rid").join(sizes, "label").join(reps, "rid").select(
        F.col("label").alias("cluster"), "m", "rid", "copies", F.col("fp1").alias("w1"), F.col("fp2").alias("w2"),
        F.xxhash64("key").alias("__k"), F.col("text_hash").alias("__h"),
    )
    texts = docs.select(F.xxhash64(F.col(key)).alias("__k"), F.xxhash64(F.col(text)).alias("__h"), F.col(text).alias("__t")).where("__t is not null")
    met = texts.join(wanted, ["__k", "__h"]).dropDuplicates(["rid"])  # rows of one key meet only where their texts are equal
    sets = shingle_sets(met, n, F.col("__t"), "s").where("s.fp1 = w1 and s.fp2 = w2")
    links = store(verified(sets.select("cluster", "m", "rid", "copies", "s.shingles"), threshold, block_rows), "jaccard-links", TEXT_ROWS)
    labels = components(links.where("rid != root").select(F.col("rid").alias("a"), F.col("root").alias("b")), "jaccard-classes")
    counts = links.groupBy("rid").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    nodes_out = (
        reps.select("rid").join(labels.withColumnRenamed("node", "rid"), "rid", "left").join(counts, "rid", "left")
        .select(F.col("rid").alias("rep"), F.coalesce("label", "rid").alias("label"),
                F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    )
    full = store(members.join(nodes_out, "rep").select(
        "rid", "key", "text_hash", "label", (F.col("copies") - 1 + F.col("docs")).alias("n_links"), "n_text_links"), "jaccard-full")
    best = full.groupBy("label").agg(F.min(F.struct(F.col("key").isNull(), "key", "rid")).alias("best"))
    return full.join(best, "label").select(
        F.col("key").alias(key), "text_hash", F.col("best.key").alias("class_id"), "n_links", "n_text_links",
        (F.col("rid") == F.col("best.rid")).alias("first"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of every near-duplicate class, columns unchanged; rows with a null text all stay."""
    first = near_duplicates(docs, key, text, **settings).where("first").select(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"))
    known = docs.where(F.col(text).isNotNull()).withColumns({"__key": F.col(key), "__hash": F.xxhash64(F.col(text))})
    same = F.col("d.__key").eqNullSafe(F.col("f.__key")) & (F.col("d.__hash") == F.col("f.__hash"))
    kept = known.alias("d").join(first.alias("f"), same, "left_semi").dropDuplicates(["__key", "__hash"]).drop("__key", "__hash")
    return kept.unionByName(docs.where(F.col(text).isNull()))
