"""Toxicity: boosted trees over dense text features, calibrated by isotonic regression.

The lexicon is learned: words, and stems of inflected words, that labelled toxic texts have far
more often than clean ones.
Features are its density, how close it stands to the second person, capitals, punctuation and
obfuscated spellings. Trees and calibration are fitted by aggregation over all labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.boosting import Boosted, calibrated, fit_boosted, fit_isotonic
from defectspark.llm.common import give_back, store

FEATURES = ["lex_rate", "lex_count", "lex_kinds", "near_you", "obfuscated", "upper_rate", "shout_rate", "mark_rate", "mask_rate"]
_SCHEMA = "struct<" + ",".join(f"{f}:double" for f in FEATURES) + ">"
_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"\S+")
# Pronouns and possessives that address the reader, in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su sus".split()
)
# Characters that stand for letters in disguised words.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_NEAR = 8
_STEMS = (5, 6, 7)
# The score of every text where nothing was learned: under one half, so that no text is rejected.
UNFITTED = 0.49


def _entries(word: str) -> list[str]:
    """The lexicon entries a word can match: itself, and its stems marked by a star."""
    return [word, *[word[:k] + "*" for k in _STEMS if len(word) > k]]


@dataclass
class ToxicityModel:
    lexicon: list[str]
    trees: Boosted
    points: list[tuple[float, float]]

    def score(self, features: str = "__f") -> Column:
        """The calibrated margin; without calibration points its plain odds; ``UNFITTED`` if no tree tells texts apart."""
        if not self.trees.trees:
            return F.lit(UNFITTED)
        margin = self.trees.margin(lambda f: F.col(f"{features}.{f}"))
        return calibrated(self.points, margin) if self.points else 1 / (1 + F.exp(-margin))


def _document_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per lexicon entry and label, summed over a batch."""
    for batch in batches:
        toxic, clean = Counter(), Counter()
        for text, label in zip(batch["text"], batch["label"], strict=True):
            (toxic if label else clean).update({e for w in set(_WORD.findall(text.lower())) for e in _entries(w)})
        rows = [(w, toxic[w], clean[w]) for w in toxic]
        rows += [(w, 0, n) for w, n in clean.items() if w not in toxic]
        yield pd.DataFrame(rows, columns=["word", "toxic", "clean"])


def learn_lexicon(labelled: DataFrame, text: str, label: str, false_share: float = 0.2) -> list[str]:
    """Words and stems that mark toxic documents.

    Their log odds against clean documents exceed 3, and they are the longest list, by how unlikely
    their one-sidedness is, in which a share of ``false_share`` at most is expected to be there by chance
    (Benjamini and Hochberg, with the Chernoff bound of the binomial tail). So an entry of a language
    with few labels is not asked to beat all entries of the others. The list is as large as the
    labelled rows make it; those are what the caller bounds.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).alias("label")).where("text is not null")
    totals = rows.agg(F.sum("label"), F.count("*")).first()
    toxic, clean = float(totals[0] or 0), float((totals[1] or 0) - (totals[0] or 0))
    if not toxic or not clean:
        return []
    words = rows.mapInPandas(_document_words, "word string, toxic long, clean long")
    sums = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t + c >= 3")
    sums = store(sums, "toxicity-words")
    tests = max(sums.count(), 1)
    odds = F.log((F.col("t") + 0.5) / (toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (clean - F.col("c") + 0.5))
    n, rate = F.col("t") + F.col("c"), toxic / (toxic + clean)
    surplus = lambda k, share: F.when(k > 0, k * F.log(k / n / share)).otherwise(0.0)
    unlikely = surplus(F.col("t"), rate) + surplus(F.col("c"), 1 - rate)
    marked = sums.where((F.col("t") >= 3) & (odds > 3)).select("word", unlikely.alias("u")).orderBy(F.desc("u"), "word").collect()
    passing = [i for i, r in enumerate(marked, 1) if -r["u"] <= math.log(false_share * i / tests)]
    return [r["word"] for r in marked[:max(passing, default=0)]]


def _features(text: str | None, lexicon: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    words = _WORD.findall(text.lower())
    n = max(len(words), 1)
    marked = {w for w in set(words) if any(e in lexicon for e in _entries(w))}
    at = [i for i, w in enumerate(words) if w in marked] if marked else []
    near = 0
    for i in at:
        near += any(w in SECOND_PERSON for w in words[max(0, i - _NEAR):i + _NEAR + 1])
    masked = hidden = 0
    for chunk in _CHUNK.findall(text):
        if chunk.isalpha():
            continue
        inner = chunk.strip(".,;:!?\"'()[]")
        if inner.isalpha() or not any(c.isalpha() for c in inner):
            continue
        masked += 1
        plain = inner.lower().translate(_LEET)
        hidden += plain in lexicon or re.sub(r"[^\w]|_", "", plain) in lexicon
    shouted = sum(1 for w in _WORD.findall(text) if len(w) > 1 and w.isupper()) if any(c.isupper() for c in text) else 0
    upper = sum(map(str.isupper, text))
    return (
        (len(at) + hidden) / n, float(len(at) + hidden), float(len({words[i] for i in at})), near / n, float(hidden),
        upper / max(len(text), 1), shouted / n, (text.count("!") + text.count("?")) / n, masked / n,
    )


def with_features(docs: DataFrame, lexicon: list[str], text: str = "text", out: str = "__f") -> DataFrame:
    """Add the struct of features; null counts as empty text, which has all zeros."""

    @F.arrow_udf(_SCHEMA)
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = frozenset(lexicon)
        for texts in batches:
            rows = np.array([_features(t.as_py(), words) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], FEATURES)
            texts = rows = None  # gone before the next batch comes
        give_back()

    return docs.withColumn(out, features(F.col(text)))


def fit_on_features(rows: DataFrame, lexicon: list[str], label: str, calibrate: Column, features: str = "__f") -> ToxicityModel:
    """Fit trees on the rows where ``calibrate`` is false and the isotonic map on the others, if these hold both classes."""
    flat = store(rows.select(*[F.col(f"{features}.{f}") for f in FEATURES], F.col(label).alias("__y"), calibrate.alias("__cal")), "toxicity-fit")
    trees = fit_boosted(flat.where("not __cal"), FEATURES, "__y", rounds=10, bins=8)
    held = flat.where("__cal")
    both = held.agg(F.countDistinct("__y")).first()[0] > 1
    return ToxicityModel(lexicon, trees, fit_isotonic(held, trees.margin(), "__y") if both else [])


def fit(labelled: DataFrame, label: str, calibrate: Column, text: str = "text") -> ToxicityModel:
    """Learn lexicon, trees and calibration from rows with a label; rows with null text count as empty.

    Without labelled rows, with one class only or where no feature splits the classes, every score is ``UNFITTED``.
    """
    lexicon = learn_lexicon(labelled.where(~calibrate), text, label)
    return fit_on_features(with_features(labelled, lexicon, text), lexicon, label, calibrate)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: probability that a text is toxic, 0 to 1. A column of that name is replaced."""
    rows = with_features(docs, model.lexicon, text)
    return rows.withColumn(out, model.score()).drop("__f")
