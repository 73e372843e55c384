"""Hard negatives from cover trees against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from defectspark.llm import cover_tree, queries
from defectspark.llm.cover_tree import CoverTree, Want

SCHEMA = "vec_id long, embedding array<double>, label int, x string, id string, cell string, wants string"


def brute(rows):
    """The contract's rule, with whole numbers only; ``rows`` of (vec_id, vector, label)."""
    kept = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        row = ((label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * v) for v in vector])
        kept[key] = min(kept.get(key, row), row)
    out = []
    for a, (label, x) in kept.items():
        if a % 100:
            continue
        score = {k: sum(p * q for p, q in zip(x, y)) for k, (_, y) in kept.items() if k != a}
        order = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in order if kept[k][0] == label][:5]:
            fits = [k for k in order if kept[k][0] != label and 80 * score[p] <= 100 * score[k] <= 100 * score[p]]
            out += [(a, p, i, k, score[p], score[k]) for i, k in enumerate(fits[:5], 1)]
    return sorted(out)


def test_query_against_brute_force(spark, tmp_path):
    draw = np.random.RandomState(3)
    centres = draw.normal(size=(6, 9))
    rows = [(i, (centres[i % 6] + 0.2 * draw.normal(size=9)).tolist(), int(draw.randint(10))) for i in range(900)]
    rows += [(1000 + i, [0.5] * 9, i % 3) for i in range(300)]  # ties everywhere
    rows += [(2000, [], 1), (2100, [1.0], 2), (2101, [1.0, -1.0], 3), (2102, None, 1), (None, [1.0] * 9, 1), (2103, [1.0] * 9, None)]
    rows += [(2200, [math.nan] * 9, 1), (2201, [math.inf] * 9, 1), (2202, [None] * 9, 1), (100, [9.0] * 9, 9), (200, rows[200][1], rows[200][2])]
    wide = [(*r, "a", "b", "c", "d") for r in rows]
    spark.createDataFrame(wide, SCHEMA).write.parquet(f"{tmp_path}/some/embeddings.parquet")
    got = queries.QUERIES["op12_cover_tree"](spark, f"{tmp_path}/some")
    assert sorted(map(tuple, got.collect())) == brute(rows)
    # Several cells, blocks and chunks give the same rows as one.
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    clean = cover_tree.clean_rows(spark.createDataFrame(wide, SCHEMA), "vec_id", moved, "embedding")
    cut = cover_tree.hard_negatives(clean, F.col("id") % 100 == 0, cells=5, sample=20, block_rows=50)
    assert sorted(map(tuple, cut.collect())) == brute(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.QUERIES["op12_cover_tree"](spark, f"{tmp_path}/none").collect() == []


def test_given_table_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, queries.QUERIES["op12_cover_tree"](spark, folder).collect())) == brute(rows)


def test_tree_covers_its_rows_and_skips_far_nodes():
    draw = np.random.RandomState(1)
    centres = 4000 * draw.normal(size=(40, 6))
    x = np.floor(centres[draw.randint(40, size=4000)] + 20 * draw.normal(size=(4000, 6)))
    ids, labels = np.arange(4000), draw.randint(3, size=4000)
    longest = float((x * x).sum(1).max())
    tree = CoverTree(ids, labels, x, longest)
    full = np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(1), 0))[:, None]], 1)

    def below(node):
        rows, children, _, _ = tree.nodes[node]
        return np.concatenate([rows] + [below(c) for c in children])

    assert sorted(below(0).tolist()) == list(range(4000))
    inner = 0
    for rows, children, spots, radii in tree.nodes:
        for child, spot, radius in zip(children, spots, radii):
            assert np.sqrt(((full[below(child)] - full[rows[spot]]) ** 2).sum(1)).max() <= radius + 1e-6
            inner += 1
    assert inner > 40
    checked = 0
    for a in range(0, 4000, 200):
        scores = x @ x[a]
        want = Want(5, labels[a], True, -np.inf, np.inf, a)
        checked += tree.search(x[a], [want])
        fits = sorted((-scores[i], i) for i in range(4000) if i != a and labels[i] == labels[a])[:5]
        assert want.found == [(float(s), i) for s, i in fits]
        low, high = sorted((scores[a] * 0.2, scores[a] * 0.3))
        band = Want(3, labels[a], False, low, high, a)
        tree.search(x[a], [band])
        fits = sorted((-scores[i], i) for i in range(4000) if labels[i] != labels[a] and low <= scores[i] <= high)[:3]
        assert band.found == [(float(s), i) for s, i in fits]
    assert checked < 20 * 4000 / 4
