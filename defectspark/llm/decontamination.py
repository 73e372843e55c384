"""Benchmark decontamination: scan training words for the n-grams of test items.

The distinct test windows are held as a broadcast hash set. Its size is measured first; a test
set beyond ``block_bytes`` is cut into blocks by the hash of the window, and each document passes
all blocks in the same task, so no document is shuffled and every broadcast stays bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from defectspark.llm.common import give_back

# ASCII: capitals become small, digits and small letters stay, all else separates. Other bytes stay.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("starts", T.ArrayType(T.IntegerType())),
    T.StructField("ends", T.ArrayType(T.IntegerType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def normal_words(text: str | None) -> list[bytes]:
    """Small-letter words as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows_of(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (``window`` bytes, ``size``, ``items``); a short item is one window, an empty one none."""

    @F.pandas_udf("array<struct<window:binary,size:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for words in map(normal_words, texts):
            size = min(n, len(words))
            out.append([(b" ".join(words[i:i + size]), size) for i in range(len(words) - size + 1)] if size else [])
        return pd.Series(out)

    cuts = benchmark.select(F.col(item_id).cast("string").alias("item"), F.explode(cut(F.col(text))).alias("w"))
    return cuts.groupBy("w.window", "w.size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _scan(words: list[bytes], firsts: dict, index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    for i in [i for i, w in enumerate(words) if w in firsts]:
        for size in firsts[words[i]]:
            found = index.get(b" ".join(words[i:i + size])) if i + size <= len(words) else None
            if found is not None:
                items.update(found)
                spans.append((i, i + size))
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", hits: str = "hits",
                  block_bytes: int = 64 << 20) -> DataFrame:
    """Add ``hits``: word count, merged word spans [start, end) inside test windows, and ids of the items.

    Null and empty texts have no words and no hits. An item with a null id marks words but is not
    listed. Repeated rows are scanned each for itself. A column already called ``hits`` is replaced.
    """
    windows = windows_of(benchmark, n).cache()
    size = windows.agg(F.sum(F.length("window") + 120 + 24 * F.size("items"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    context = docs.sparkSession.sparkContext
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) if blocks > 1 else windows
        held = context.broadcast([(bytes(r[0]), r[1], list(r[2])) for r in part.toLocalIterator()])
        docs = docs.withColumn(hits, _scanner(held)(F.col(text), F.col(hits) if k else F.lit(None).cast(HITS)))
    windows.unpersist()
    return docs


def _scanner(held):
    @F.pandas_udf(HITS)
    def scan(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        index, firsts = {}, {}
        for window, size, items in held.value:
            index[window] = items
            firsts.setdefault(window.split(b" ", 1)[0], set()).add(size)
        for texts, earlier in batches:
            rows = []
            for text, starts, ends, items in zip(texts, earlier["starts"], earlier["ends"], earlier["items"], strict=True):
                words = normal_words(text)
                spans, found = _scan(words, firsts, index)
                if starts is not None:
                    spans += zip(starts, ends, strict=True)
                    found.update(items)
                rows.append((len(words), *_merged(spans), sorted(found)))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])
        del index, firsts
        give_back()

    return scan


@F.pandas_udf(T.StringType())
def without_spans(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """The texts without their hit words, from the first character of a span to the last."""
    out = []
    for text, a, b in zip(texts, starts, ends, strict=True):
        if text is not None and a is not None and len(a):
            at = [m.span() for m in _WORD.finditer(text)]
            for i, j in zip(reversed(a), reversed(b), strict=True):
                text = text[:at[i][0]] + text[at[j - 1][1]:]
        out.append(text)
    return pd.Series(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """The same rows and columns with test passages cut out of the texts."""
    found = contamination(docs, benchmark, n, text, "__hits")
    return found.withColumn(text, without_spans(F.col(text), "__hits.starts", "__hits.ends")).drop("__hits")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text") -> DataFrame:
    """The rows without a test passage, unchanged."""
    return contamination(docs, benchmark, n, text, "__hits").where(F.size("__hits.starts") == 0).drop("__hits")
