"""Periodic runs of words: tiles per period octave, boundary Z-functions, stitched fragments.

A run is a longest stretch of words that repeats with a smallest period ``q`` and lasts at least
``max(24, 3 * q)`` words. Periods are dealt with by octaves. An octave's boundaries stand a step
apart, so close that every run of the octave holds a whole period, and a window, right of some
boundary; a tile holds the words around a few boundaries, and overlaps the next tile so that it can
be solved alone. At a boundary two Z-functions give, for every period of the octave at once, how far
the words go on with that period to the right and to the left. What a boundary sees is a fragment, cut
at the reach of its tile. Fragments are shuffled by document and period, and those that share a
whole period of words are stitched into one run.

A tile is sent on only where some boundary's window stands again one period of the octave later,
which every run shows; that is found for all boundaries of a document by comparing rolling hashes. Texts
without such a tile are finished at once, so tiles and texts travel only where words repeat.

Defined cases: a null or empty text has no words and no runs. A null id counts as an empty text where
it decides what is planted. Repeated rows have one row each in the result. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from defectspark.llm.common import store

LEAST, TIMES = 24, 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_BOUNDARIES = 16  # in a tile
_BATCH_BYTES = 8 << 20


def octaves(n: int) -> Iterator[tuple[int, int, int]]:
    """(first period, end of periods, step) for a text of ``n`` words; the first octaves share one, as runs have ``LEAST`` words."""
    low, high = 1, 8
    while low * TIMES <= n and n >= LEAST:
        yield low, high, max(low, 8)
        low, high = high, 2 * high


def planted(words: list[str], doc_id) -> list[str]:
    """The words with one tail made periodic, in the tenth of documents that the id's checksum names."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[:n - a]


def codes_of(words: list[str]) -> np.ndarray:
    """One whole number per distinct word."""
    held: dict[str, int] = {}
    return np.fromiter((held.setdefault(w, len(held)) for w in words), np.int32, len(words))


def candidates(codes: np.ndarray, low: int, high: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) pairs of an octave whose window of ``step`` words after the boundary stands again one period on.

    Windows are compared by a rolling hash, so chance pairs may be among them and none is missing.
    """
    n = len(codes)
    size = n - step + 1
    with np.errstate(over="ignore"):
        power = np.full(n, _BASE, np.uint64)
        power[:1] = 1
        power = np.cumprod(power, dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        # The hash of a window times the power of its start; the later of two is compared after the same scaling.
        windows = sums[step:] - sums[:size]
        at = np.arange(0, max(size - low, 0), step)
        periods = np.arange(low, min(high, n))
        later = at[:, None] + periods[None, :]
        inside = later < size
        equal = inside & (windows[at][:, None] * power[periods][None, :] == windows[np.minimum(later, size - 1)])
    row, column = np.nonzero(equal)
    return at[row], periods[column]


def tiles_of(codes: np.ndarray) -> list[tuple]:
    """(low, high, step, first word, boundaries, codes) for every tile with a candidate boundary."""
    out = []
    for low, high, step in octaves(len(codes)):
        at = np.unique(candidates(codes, low, high, step)[0])
        for part in np.unique(at // (step * _BOUNDARIES)):
            mine = at[at // (step * _BOUNDARIES) == part]
            first = max(int(mine[0]) - 2 * step, 0)
            out.append((low, high, step, first, mine.tolist(), codes[first:int(mine[-1]) + 4 * step + 1].astype("<i4").tobytes()))
    return out


def z_function(s: list[int]) -> list[int]:
    """For every place, how many items from there on equal the beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    if n:
        z[0] = n
    return z


def solve_tile(codes: np.ndarray, first: int, boundaries: list[int], low: int, high: int, step: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the fragments seen at a tile's boundaries, in words of the document.

    A fragment lasts two periods or more, and its period is the smallest: no proper divisor of it
    repeats the first period's words.
    """
    words, out = codes.tolist(), []
    for b in boundaries:
        at = b - first
        left, right = words[max(at - 2 * step, 0):at], words[at:at + 4 * step + 1]
        ahead = z_function(right)
        # Reversed: the left words, a mark, and everything up to the last period's start.
        span = right[:high - 1]
        behind = z_function(left[::-1] + [-1] + span[::-1] + left[::-1])
        for q in range(low, min(high, len(right))):
            go = ahead[q]
            back = min(behind[len(left) + 1 + len(span) - q], len(left)) if q <= len(span) else 0
            if go + back >= q and not any(q % p == 0 and ahead[p] >= q - p for p in range(1, q // 2 + 1)):
                out.append((q, b - back, b + q + go))
    return out


def merged(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one tile with those stitched that share a period of words; what is left travels."""
    out: list[tuple[int, int, int]] = []
    for q, start, end in sorted(fragments):
        if out and out[-1][0] == q and start + q <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((q, start, end))
    return out


def _by_bytes(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Record batches bounded by bytes, not by rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= _BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_TILE_FIELDS = ("low", "high", "step", "first", "boundaries", "codes")
_TILE = pa.struct(list(zip(_TILE_FIELDS, [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.binary()])))
_RUN = "struct<start:long,length:long,period:long>"
_TILE_SQL = "struct<low:long,high:long,step:long,first:long,boundaries:array<long>,codes:binary>"


def tiled(docs: DataFrame, key: str, text: str, change: Callable[[list[str], object], list[str]] | None = None) -> DataFrame:
    """Stored rows per document: ``key``, ``n_words``, ``plain`` (digest of all words), and, only where a tile has a candidate, ``words`` and ``tiles``.

    ``change`` may replace the words of a text, given its id.
    """
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("plain", pa.string()), ("words", pa.string()), ("tiles", pa.list_(_TILE))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        fields = _TILE_FIELDS
        for batch in batches:
            for key_value, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = _WORD.findall(value.as_py() or "")
                if change is not None:
                    words = change(words, key_value)
                tiles = tiles_of(codes_of(words)) if len(words) >= LEAST else []
                joined = " ".join(words)
                yield (
                    key_value, len(words), hashlib.sha256(joined.encode("utf-8", "surrogatepass")).hexdigest(),
                    joined if tiles else None, [dict(zip(fields, t)) for t in tiles],
                )

    def weight(row: tuple) -> int:
        return 200 + len(row[3] or "") + sum(len(t["codes"]) + 100 for t in row[4])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _by_bytes(rows(batches), schema, weight)

    found = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(work, f"key long, n_words long, plain string, words string, tiles array<{_TILE_SQL}>")
    # The digest tells documents of one id apart; equal rows give equal runs.
    return store(found.withColumn("doc", F.struct("key", "plain")), "periodic-tiles")


def fragments(tiles: DataFrame) -> DataFrame:
    """(``doc``, ``period``, ``start``, ``end``): what the boundaries of every tile see. Tiles are dealt out anew, as one long text can have many."""

    @F.pandas_udf("array<struct<period:long,start:long,end:long>>")
    def solve(frame: pd.DataFrame) -> pd.Series:
        out = []
        for t in frame.itertuples(index=False):
            found = solve_tile(np.frombuffer(t.codes, "<i4"), t.first, t.boundaries.tolist(), t.low, t.high, t.step)
            out.append([{"period": q, "start": a, "end": b} for q, a, b in merged(found)])
        return pd.Series(out)

    dealt = tiles.select("doc", F.explode("tiles").alias("t")).repartition("doc", "t.low", "t.first")
    return dealt.select("doc", F.explode(solve("t")).alias("f")).select("doc", "f.*")


def stitch(found: DataFrame) -> DataFrame:
    """(``doc``, ``start``, ``length``, ``period``) of every run: fragments of a document and period that share a whole period are one stretch."""
    ordered = Window.partitionBy("doc", "period").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") + F.col("period") > reach), 1).otherwise(0)
    marked = found.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    whole = marked.groupBy("doc", "period", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return whole.select("doc", "start", length.alias("length"), "period").where(length >= F.greatest(F.lit(LEAST), TIMES * F.col("period")))


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", change: Callable | None = None) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``runs`` (array of ``start``, ``length``, ``period`` by start, then period), ``best`` (the run with the greatest length over period, exact; ties to the smaller start, then period) and ``collapsed`` (digest of the words left when every run keeps its first period only)."""
    rows = tiled(docs, key, text, change)
    tiles = rows.where("words IS NOT NULL")
    runs = stitch(fragments(tiles)).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))

    @F.pandas_udf("struct<best:int,collapsed:string>")
    def collapse(words: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for line, runs_of in zip(words, found):
            kept = np.ones(line.count(" ") + 1, bool)
            best = 0
            for i, r in enumerate(runs_of):
                kept[r["start"] + r["period"]:r["start"] + r["length"]] = False
                top = runs_of[best]
                best = i if int(r["length"]) * int(top["period"]) > int(top["length"]) * int(r["period"]) else best
            left = " ".join([w for w, k in zip(line.split(" "), kept.tolist()) if k])
            out.append((best, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(out, columns=["best", "collapsed"])

    without = [
        "key", "n_words", F.array().cast(f"array<{_RUN}>").alias("runs"), F.lit(None).cast(_RUN).alias("best"), F.col("plain").alias("collapsed"),
    ]
    solved = tiles.select("doc", "key", "n_words", "plain", "words").join(runs, "doc", "left")
    some = solved.where("runs IS NOT NULL").withColumn("c", collapse("words", "runs"))
    some = some.select("key", "n_words", "runs", F.get("runs", F.col("c.best")).alias("best"), F.col("c.collapsed").alias("collapsed"))
    none = solved.where("runs IS NULL").select(*without).unionByName(rows.where("words IS NULL").select(*without))
    return some.unionByName(none).withColumnRenamed("key", key)
