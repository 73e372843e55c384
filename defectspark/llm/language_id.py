"""Language identification with word-first backoff.

Known words are scored by their log frequency in each language. An unseen word falls back to
character n-grams: at each place the longest known n-gram counts, down to single characters.
Counts are taken in a bounded sample of labelled rows; entries seen once are not kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectspark.llm.common import store

UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_LONGEST = 4
_HELD_WORDS = 200_000
_FEW_LABELS = 10_000


def _grams(word: str, size: int) -> Iterator[str]:
    padded = f"_{word}_" if size > 1 else word
    return (padded[i:i + size] for i in range(len(padded) - size + 1))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words[lang].update(_LETTERS.findall(text.lower()))
        rows = []
        for lang, counts in words.items():
            grams: Counter = Counter()
            for word, n in counts.items():
                rows.append((lang, 0, word, n))
                for size in range(1, _LONGEST + 1):
                    for gram in _grams(word, size):
                        grams[(size, gram)] += n
            rows += [(lang, size, gram, n) for (size, gram), n in grams.items()]
        yield pd.DataFrame(rows, columns=["lang", "size", "entry", "n"])


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
          docs_per_lang: int = 3000, least: int = 2) -> list[tuple[str, int, str, int]]:
    """Counts (language, size, entry, n); size 0 is a word.

    Learns from about ``docs_per_lang`` labelled rows of each language, taken by a hash of the
    key so that no order matters, where they lie; every entry counted ``least`` times or more is kept.
    Rows without text or language teach nothing.
    """
    known = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    share = store(known.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("share")), "language-shares")
    # A few labels go to the rows; texts do not go to the labels.
    share = F.broadcast(share) if share.count() <= _FEW_LABELS else share
    spot = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = known.join(share, "lang").where(spot < F.col("share")).select("lang", "text")
    counts = sample.mapInPandas(_count, "lang string, size int, entry string, n long")
    kept = counts.groupBy("lang", "size", "entry").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return [tuple(r) for r in kept.orderBy("lang", "size", "entry").toLocalIterator()]


class _Scorer:
    """Log frequencies per language in one matrix; scores of unseen words are kept for a while."""

    def __init__(self, counts: list[tuple[str, int, str, int]]) -> None:
        self.langs = sorted({c[0] for c in counts})
        order = {x: i for i, x in enumerate(self.langs)}
        n: dict[tuple[int, str], np.ndarray] = {}
        totals = np.ones((_LONGEST + 1, len(self.langs)))
        for lang, size, entry, count in counts:
            n.setdefault((size, entry), np.zeros(len(self.langs)))[order[lang]] += count
            totals[size, order[lang]] += count
        self.words, self.grams = {}, {}
        for (size, entry), c in n.items():
            score = np.log((c + 0.5) / totals[size])
            if size:
                self.grams[entry if size > 1 else (entry,)] = score
            else:
                self.words[entry] = score
        self.floor = np.zeros(len(self.langs))
        self.index: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)))

    def _unseen(self, word: str) -> np.ndarray:
        padded, total, places = f"_{word}_", self.floor.copy(), 0
        for i in range(len(padded) - 1):
            for size in range(_LONGEST, 0, -1):
                part = padded[i:i + size]
                score = self.grams.get(part if size > 1 else (part,)) if len(part) == size else None
                if score is not None:
                    total += score
                    places += 1
                    break
        return total / places if places else self.floor

    def _place(self, word: str) -> int:
        at = len(self.index)
        if at == len(self.matrix):
            self.matrix = np.vstack([self.matrix, np.zeros_like(self.matrix)])
        known = self.words.get(word)
        self.matrix[at] = self._unseen(word) if known is None else known
        self.index[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = _LETTERS.findall(text.lower()) if text else []
        if not words or not self.langs:
            return UNKNOWN, 0.0
        if len(self.index) > _HELD_WORDS:
            self.index = {}
        get = self.index.get
        at = [get(w) for w in words]
        if None in at:
            at = [self._place(w) if (i := self.index.get(w)) is None else i for w in words]
        total = self.matrix[at].sum(axis=0)
        best = int(np.argmax(total))
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0.0)).sum())


def identify(docs: DataFrame, counts: list[tuple[str, int, str, int]], text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct(lang, score). Null texts and texts without a letter are ``und`` with score 0.

    The score is the posterior of the best language under equal priors; ties go to the first
    name. A model without counts answers ``und``. A column of that name is replaced. Repeated rows are
    answered each for itself, and ids are not looked at, so null ones do no harm. An empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("struct<lang:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(held.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])

    return docs.withColumn(out, predict(F.col(text)))
