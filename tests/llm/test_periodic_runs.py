"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np

from defectspark.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def plant(words, key):
    n, h = len(words), zlib.crc32(b"" if key is None else str(key).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def brute_runs(words):
    """Every stretch of every period, where the period is the smallest of the stretch."""
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x, out = np.array([index[w] for w in words], int), []
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[False], x[q:] == x[:-q], [False]]).astype(int)
        starts, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)
        for a, b in zip(starts, ends):
            length = int(b - a + q)
            part = x[a:a + q]
            smaller = any(q % p == 0 and (part[p:] == part[:-p]).all() for p in range(1, q))
            if length >= max(24, 3 * q) and not smaller:
                out.append((int(a), length, q))
    return sorted(out)


def expected(key, text):
    words = plant(re.findall(r"[^\x20\x09-\x0D]+", text or ""), key)
    runs = brute_runs(words)
    kept = [True] * len(words)
    for start, length, period in runs:
        for i in range(start + period, start + length):
            kept[i] = False
    best = (None,) * 4
    if runs:
        top = runs[0]
        for r in runs:
            top = r if r[1] * top[2] > top[1] * r[2] else top
        best = (*top, 1000 * top[1] // top[2])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (key, len(runs), *best, digest("".join("%d,%d,%d\n" % r for r in runs)), digest(" ".join(w for w, k in zip(words, kept) if k)))


def same(spark, folder):
    got = queries.QUERIES["op11_periodic_runs"](spark, folder).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_given_documents(spark):
    same(spark, SF)


def test_made_documents(spark, tmp_path):
    draw = random.Random(9)
    texts = []
    for period in [1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 31, 32, 33, 63, 64, 65, 100, 255, 256, 300]:
        unit = [str(draw.randrange(3)) if draw.random() < 0.5 else f"w{draw.randrange(40)}" for _ in range(period)]
        for times in (2.9, 3, 3.4, 8):
            body = (unit * 9)[:max(int(period * times), 23 + draw.randrange(3))] if period > 2 else unit * (25 + draw.randrange(90))
            head, tail = ([f"h{draw.randrange(50)}" for _ in range(draw.randrange(70))] for _ in range(2))
            texts.append(head + body + tail)
    # Runs inside runs, runs that overlap, runs over a small alphabet, edits inside a long run.
    texts += [(["a"] * 30 + ["b"]) * 6, ["a", "b"] * 40 + ["a"] * 30 + ["b", "a"] * 40, [draw.choice("ab") for _ in range(3000)], ["x"] * 5000]
    broken = ["p", "q", "r", "s", "t"] * 300
    for i in (200, 211, 700, 1499):
        broken[i] = "!"
    fib = ["a", "ab"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + fib[-2])
    texts += [broken, list(fib[-1]), list("abcabcabd" * 60), ["one"] * 23, ["one"] * 24, ["1", "2"] * 12]
    rows = [(i, draw.choice([" ", "\n", "\t \x0b", "\x0c\r"]).join(t)) for i, t in enumerate(texts)]
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "é ü x " * 40), (None, "x y z " * 30), (None, None), (7, "tail " * 100), (7, "tail " * 100)]
    df = spark.createDataFrame([(*r, "k", "d", "p") for r in rows], "doc_id long, text string, key string, doc string, period string")
    df.write.parquet(f"{tmp_path}/some/documents.parquet")
    same(spark, f"{tmp_path}/some")
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    same(spark, f"{tmp_path}/none")


def test_tiles_and_fragments_without_spark():
    """Tiles, solved alone and stitched here, give the same runs as the plain search."""
    draw = random.Random(2)
    for _ in range(150):
        n = draw.randrange(24, 400)
        words = [draw.choice("abc") for _ in range(n)]
        at, period = draw.randrange(n), draw.randrange(1, 60)
        for i in range(at + period, min(n, at + period * draw.randrange(3, 9))):
            words[i] = words[i - period]
        found = []
        for low, high, step, first, boundaries, codes in periodic_runs.tiles_of(periodic_runs.codes_of(words)):
            found += periodic_runs.solve_tile(np.frombuffer(codes, "<i4"), first, boundaries, low, high, step)
        runs = [(a, b - a, q) for q, a, b in periodic_runs.merged(found) if b - a >= max(24, 3 * q)]
        assert sorted(runs) == brute_runs(words)
