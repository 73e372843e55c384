"""Personal data: loose generators propose spans, boosted trees decide, calibrated probabilities redact.

Strict rules give the base spans, which always stay. High-recall generators propose overlapping
candidates of each kind; their format and context are the features, and agreement with a base
span of the kind is the label to learn from, so the trees pick up what personal data looks like
without the checks (checksums, prefixes, ranges). Candidates above the threshold that touch no
base span are added. Only built-in functions run, and no text leaves its row. Repeated rows have one
result each, null ids are rows like others, null texts count as empty, and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from defectspark.llm.boosting import Boosted, calibrated, fit_boosted, fit_isotonic

KINDS = ("email", "ip", "card", "phone")

# Possessive forms and starts at the edge of a run find the same leftmost matches as the plain
# patterns, in linear time and without recursion on long runs.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

# Generators: pattern, cheap test that must hold in the text, kinds proposed.
GENERATORS = {
    "address": (r"[^\s@,;<>()\[\]]++\x20?(?:@|\(at\)|\[at\])\x20?[^\s@,;<>()\[\]]*[A-Za-z0-9]", r"@|\(at\)|\[at\]", ("email",)),
    "digits": (r"[+(]?(?<![0-9])[0-9](?:[\x20().\-/]{0,2}[0-9])++", r"[0-9]", ("card", "phone")),
    "dotted": (r"(?<![0-9])[0-9]++(?:\.[0-9]++)++", r"[0-9]\.[0-9]", ("ip",)),
}
_CUES = r"(?i)\b(?:call|phone|tel|fax|mobile|mail|contact|card|visa|account|address|host|server|ip)\b"

FEATURES = [
    "is_email", "is_ip", "is_card", "is_phone", "length", "digits", "groups", "longest_run", "plus", "parens", "dots", "ats",
    "letters", "left_joined", "right_joined", "cue", "few_kinds",
]
_BLOCK = 256
_SPAN = "array<struct<start:long,end:long,text:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums_before(sizes: Column) -> Column:
    """Exclusive prefix sums of an array, near linear: block totals first, then inside a block."""
    zero, add = F.lit(0).cast("long"), lambda s, x: s + x
    whole = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _BLOCK).cast("int")),
        lambda c: F.aggregate(F.slice(sizes, c * _BLOCK + 1, F.lit(_BLOCK)), zero, add),
    )
    before = _let(whole, lambda w: F.transform(w, lambda _, c: F.aggregate(F.slice(w, F.lit(1), c), zero, add)))

    def places(b: Column) -> Column:
        def one(_, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            return F.element_at(b, block + 1) + F.aggregate(F.slice(sizes, block * _BLOCK + 1, i - block * _BLOCK), zero, add)

        return F.transform(sizes, one)

    return _let(before, places)


def find_all(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost non-overlapping matches with code point places [start, end); none where ``hint`` is not found."""
    found = _let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: _let(
        F.split(text, pattern, -1),
        lambda rest: _let(
            F.zip_with(F.slice(rest, F.lit(1), F.size(m)), m, lambda a, b: (F.length(a) + F.length(b)).cast("long")),
            lambda sizes: F.when(F.size(m) > 0, F.transform(
                F.arrays_zip(m.alias("m"), F.slice(rest, F.lit(1), F.size(m)).alias("r"), _sums_before(sizes).alias("s")),
                lambda x: F.struct(
                    (x["s"] + F.length(x["r"])).alias("start"), (x["s"] + F.length(x["r"]) + F.length(x["m"])).alias("end"), x["m"].alias("text"),
                ),
            )),
        ),
    ))
    return F.coalesce(F.when(text.rlike(hint), found), F.array().cast(_SPAN))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: _let(
            c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))),
        F.lit(0), lambda s, d: s + d,
    )
    return total % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return text.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    low, high = (13, 19) if kind == "card" else (9, 15)
    within = F.length(_digits(text)).between(low, high)
    return F.when(within, _luhn(_digits(text))).otherwise(False) if kind == "card" else within


def with_spans(docs: DataFrame, text: str = "text", out: str = "__pii") -> DataFrame:
    """Add ``out``: struct of base spans by kind (``base``) and generated candidates (``found``) with 24 characters around."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.struct(*[
        F.filter(find_all(body, BASE[k], _HINT[k]), lambda s: _valid(k, s["text"])).alias(k) for k in KINDS
    ])
    around = lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"),
        F.substring(body, F.greatest(s["start"] - 23, F.lit(1)).cast("int"), F.least(s["start"], F.lit(24)).cast("int")).alias("left"),
        F.substring(body, (s["end"] + 1).cast("int"), F.lit(1)).alias("right"),
    )
    found = F.struct(*[F.transform(find_all(body, p, hint), around).alias(g) for g, (p, hint, _) in GENERATORS.items()])
    return docs.withColumn(out, F.struct(base.alias("base"), found.alias("found")))


def candidates(spans: Column) -> Column:
    """Array of candidates: kind, start, end, ``base`` (agrees with a base span of the kind) and the features."""

    def features(c: Column, kind: str) -> Column:
        t, digits = c["text"], _digits(c["text"])
        count = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
        values = {
            **{f"is_{k}": F.lit(float(k == kind)) for k in KINDS},
            "length": F.length(t), "digits": F.length(digits), "groups": F.size(F.split(t, "[^0-9]+")),
            "longest_run": F.array_max(F.transform(F.split(t, "[^0-9]+"), lambda x: F.length(x))),
            "plus": count("+"), "parens": count("()"), "dots": count("."), "ats": count("@"),
            "letters": F.length(F.regexp_replace(t, r"[^\p{L}]", "")),
            "left_joined": c["left"].rlike(r"[\p{L}0-9=_]$").cast("int"), "right_joined": c["right"].rlike(r"[\p{L}0-9=_]").cast("int"),
            "cue": c["left"].rlike(_CUES).cast("int"),
            "few_kinds": (F.size(F.array_distinct(F.split(digits, ""))) <= 2).cast("int"),
        }
        return [values[f].cast("double").alias(f) for f in FEATURES]

    def of(generator: str, kind: str) -> Column:
        mine = spans["base"][kind]
        return F.transform(spans["found"][generator], lambda c: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            F.exists(mine, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).cast("int").alias("base"), *features(c, kind),
        ))

    return F.concat(*[of(g, k) for g, (_, _, kinds) in GENERATORS.items() for k in kinds])


@dataclass
class PiiModel:
    trees: Boosted
    points: list[tuple[float, float]]
    threshold: float

    def probability(self, candidate: Column) -> Column:
        return calibrated(self.points, self.trees.margin(lambda f: candidate[f]))


def fit(rows: DataFrame, calibrate: Column, spans: str = "__pii", threshold: float = 0.9, rounds: int = 8) -> PiiModel:
    """Learn from the candidates of all rows; ``calibrate`` rows serve the isotonic map only.

    Without candidates every probability is even, which adds nothing at a threshold above one half.
    """
    flat = rows.select(calibrate.alias("__cal"), F.explode(candidates(F.col(spans))).alias("c")).select("__cal", "c.base", *[f"c.{f}" for f in FEATURES])
    trees = fit_boosted(flat.where("not __cal"), FEATURES, "base", rounds=rounds)
    return PiiModel(trees, fit_isotonic(flat.where("__cal"), trees.margin(), "base"), threshold)


def added(spans: Column, model: PiiModel) -> Column:
    """Candidates that the model adds: likely enough, clear of every base span, best of those that overlap."""
    touches = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter(candidates(spans), lambda c: ~F.greatest(F.lit(False), *[F.exists(spans["base"][k], lambda b: touches(c, b)) for k in KINDS]))
    scored = F.transform(free, lambda c: F.struct(
        (-model.probability(c)).alias("minus"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    likely = F.filter(scored, lambda c: c["minus"] <= -model.threshold)
    return _let(F.array_distinct(likely), lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: touches(o, c) & (o < c))))


def all_spans(spans: Column, model: PiiModel | None = None) -> Column:
    """Sorted array of (kind number, start, end): base spans and, with a model, the added ones."""
    parts = [F.transform(spans["base"][k], lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))) for i, k in enumerate(KINDS)]
    if model is not None:
        parts.append(F.transform(added(spans, model), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_sort(F.concat(*parts))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap are cut out together."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cut(rows: Column) -> Column:
        ends = F.transform(rows, lambda s: s["end"])

        def part(s: Column, i: Column) -> Column:
            return _let(F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), F.lit(0).cast("long")), lambda done: F.concat(
                F.substring(text, (done + 1).cast("int"), F.greatest(s["start"] - done, F.lit(0)).cast("int")),
                F.when(s["start"] >= done, F.element_at(names, s["kind"] + 1)).otherwise(""),
            ))

        tail = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
        return F.when(F.size(rows) == 0, text).otherwise(F.concat(F.array_join(F.transform(rows, part), ""), tail))

    by_start = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int"))
                            .otherwise(F.signum(a["kind"] - b["kind"]).cast("int")))
    return _let(by_start, cut)


def redact(docs: DataFrame, model: PiiModel, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced in the texts; null texts stay null."""
    found = with_spans(docs, text)
    return found.withColumn(text, redacted(F.col(text), all_spans(F.col("__pii"), model))).drop("__pii")
