"""Quality rules: text statistics as column expressions, and decision lists learned from labels.

Sequential covering: a rule grows one threshold condition at a time by information gain on the
growing part of the labelled rows, is cut back to its best prefix on the pruning part, and the
rows it covers are set aside before the next rule. Each step is one aggregation to
(feature, bin) counts. The list is emitted as an ordered ``CASE WHEN``. Only built-in functions run.
Null texts have no words, repeated rows one result each, null ids are rows like others, and an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.boosting import bin_index, quantile_cuts

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
_SPLIT = r"[\x20\x09-\x0D]+"

FEATURES = ["n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate"]


def words_of(text: Column) -> Column:
    """Words between blanks; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_words(words: Column, n: int = 3) -> Column:
    """How many words lie in an ``n``-word window that occurs at least twice in the array.

    Windows are told apart by a 64-bit hash. Texts without a repeat, by far the most, only pay for
    one hash set; the others sort (hash, place) pairs, so the cost stays near linear.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - (n - 1)),
        lambda i: F.xxhash64(*[F.element_at(words, i + k) for k in range(n)]),
    )

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(rows: Column) -> Column:
            size = F.size(rows)
            same = F.filter(
                F.sequence(F.lit(1), size),
                lambda i: ((i > 1) & (F.element_at(rows, F.greatest(i - 1, F.lit(1)))["h"] == F.element_at(rows, i)["h"]))
                | ((i < size) & (F.element_at(rows, F.least(i + 1, size))["h"] == F.element_at(rows, i)["h"])),
            )
            starts = F.transform(same, lambda i: F.element_at(rows, i)["i"])
            return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda s: F.array(*[s + k for k in range(n)])))))

        return _let(placed, places)

    found = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= n, found).otherwise(F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """Bind ``value`` once for use in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and rates that the rules read. Null text: no words, all counts 0.

    Columns of the same names are replaced; other columns are kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__words", words_of(body)).withColumn("__lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    out = out.withColumns({
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
        "n_symbols": _count(body, SYMBOLS),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": repeated_words(F.col("__words")),
        "n_distinct": F.size(F.array_distinct("__words")).cast("long"),
        "n_upper": _count(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_marks": _count(body, "!?"),
        "n_digits": _count(body, "0123456789"),
    }).drop("__words", "__lines")
    return out.withColumns({
        "mean_word": share(F.col("word_chars"), F.col("n_words")),
        "symbol_rate": share(F.col("n_symbols"), F.col("n_words")),
        "dup_line_rate": share(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_rate": share(F.col("n_repeat_words"), F.col("n_words")),
        "upper_rate": share(F.col("n_upper"), F.col("word_chars")),
        "mark_rate": share(F.col("n_marks"), F.col("n_words")),
        "digit_rate": share(F.col("n_digits"), F.col("word_chars")),
        "distinct_rate": share(F.col("n_distinct"), F.col("n_words")),
    })


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float
    bin: int

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


@dataclass
class DecisionList:
    """Ordered rules that reject; a row that no rule takes is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """Number of the first rule that takes the row, 0 for none."""
        out = F.lit(0)
        for i in range(len(self.rules), 0, -1):
            out = F.when(_all(self.rules[i - 1]), F.lit(i)).otherwise(out)
        return out

    def keeps(self) -> Column:
        return self.rule() == 0

    def __str__(self) -> str:
        return "\n".join(" and ".join(map(str, r)) for r in self.rules)


def _all(conditions: Sequence[Condition], binned: bool = False) -> Column:
    test = F.lit(True)
    for c in conditions:
        left, right = (F.col(f"__b_{c.feature}"), F.lit(c.bin)) if binned else (F.col(c.feature), F.lit(c.cut))
        test = test & (left > right if c.above else left <= right)
    return test


def _grow(rows: DataFrame, features: Sequence[str], cuts: dict, most: int, enough: float) -> list[Condition]:
    conditions: list[Condition] = []
    for _ in range(most):
        table = (
            rows.where(_all(conditions, True))
            .select(F.posexplode(F.array(*[f"__b_{f}" for f in features])).alias("f", "b"), "__bad")
            .groupBy("f", "b").agg(F.sum("__bad").alias("p"), F.count("*").alias("n")).collect()
        )
        counts = {(r["f"], r["b"]): (r["p"], r["n"] - r["p"]) for r in table}
        p0 = sum(p for (f, _), (p, _) in counts.items() if f == 0)
        n0 = sum(n for (f, _), (_, n) in counts.items() if f == 0)
        if p0 == 0 or p0 / (p0 + n0) >= enough:
            break
        best, gain = None, 1e-9
        before = math.log2(p0 / (p0 + n0))
        for i, name in enumerate(features):
            low_p = low_n = 0
            for b, cut in enumerate(cuts[name]):
                p, n = counts.get((i, b), (0, 0))
                low_p, low_n = low_p + p, low_n + n
                for above, (tp, fp) in ((False, (low_p, low_n)), (True, (p0 - low_p, n0 - low_n))):
                    now = tp * (math.log2(tp / (tp + fp)) - before) if tp else 0.0
                    if now > gain + 1e-9:
                        best, gain = Condition(name, above, float(cut), b), now
        if best is None:
            break
        conditions.append(best)
    return conditions


def learn(rows: DataFrame, label: str, part: Column, features: Sequence[str] = FEATURES, bins: int = 32,
          max_rules: int = 10, max_conditions: int = 4, enough: float = 0.995, precision: float = 0.9, least: int = 2) -> DecisionList:
    """Learn rejecting rules for rows with ``label`` 0, all labelled rows counted.

    ``part`` is true for the pruning rows, the rest grow the rules. Rows with a null label are
    left out. A rule stays if it takes ``least`` bad rows and is right on ``precision`` of the
    pruning rows it takes. No labelled or no bad rows: an empty list, which keeps everything.
    """
    known = rows.where(F.col(label).isNotNull())
    cuts = quantile_cuts(known, features, bins)
    table = known.select(
        *[bin_index(F.col(f).cast("double"), cuts[f]).cast("tinyint").alias(f"__b_{f}") for f in features],
        (F.col(label) == 0).cast("int").alias("__bad"), part.alias("__prune"),
    ).persist()
    found = DecisionList()
    left = F.lit(True)
    for _ in range(max_rules):
        rest = table.where(left)
        rule = _grow(rest.where(~F.col("__prune")), features, cuts, max_conditions, enough)
        if not rule:
            break
        prefixes = [rule[:i] for i in range(1, len(rule) + 1)]
        sums = rest.where("__prune").agg(*[
            F.sum(F.when(_all(x, True), v).otherwise(0)) for x in prefixes for v in (F.col("__bad"), 1 - F.col("__bad"))
        ]).first()
        hits = [(sums[2 * i] or 0, sums[2 * i + 1] or 0) for i in range(len(prefixes))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in hits]
        at = worth.index(max(worth))
        p, n = hits[at]
        if p < least or p < precision * (p + n):
            break
        found.rules.append(prefixes[at])
        left = left & ~_all(prefixes[at], True)
    table.unpersist()
    return found
