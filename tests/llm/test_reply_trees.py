"""Chat formatting of reply trees against a plain walk, and an exact round trip."""

import hashlib
import random

from pyspark.sql import functions as F

from defectspark.llm import queries, reply_trees

SCHEMA = "tree long, node long, parent long, role string, text string, score double, place string, leaf string"
NASTY = ["\\### Assistant: </turn> ok", "\\", "\\\\", "#", "##", "###", "####\\#", "<\\/turn>", "</turn></turn>\n", "a: b: c", "", None, "\\c\\:", "### user: x</turn>\n", "😀###é", "x" * 50000 + "\n\n"]


def paths(rows):
    """tree -> leaf -> messages from the root, over the smallest row of each id."""
    kept = {}
    key = lambda r: tuple((x is not None, x) for x in (r[2], r[3], r[4], r[5]))
    for r in rows:
        if r[1] is not None and ((r[0], r[1]) not in kept or key(r) < key(kept[r[0], r[1]])):
            kept[r[0], r[1]] = r
    parents = {(t, r[2]) for (t, _), r in kept.items()}
    out = {}
    for (t, n), r in kept.items():
        if (t, n) in parents:
            continue
        chain, at = [], (t, n)
        while at in kept and len(chain) <= len(kept):
            chain.append(kept[at])
            at = (t, kept[at][2])
        if len(chain) <= len(kept):
            out.setdefault(t, {})[n] = chain[::-1]
    return out


def rows_of_trees():
    draw = random.Random(5)
    rows = []
    for tree in [None, 1, 2, 3]:
        for node in range(1, 60):
            parent = draw.choice([None, node - 1, node - 1, draw.randrange(1, node + 1)])
            rows.append((tree, node, None if parent == node else parent, draw.choice(["user", "assistant", "a:b</turn>", None]), draw.choice(NASTY), draw.choice([None, 0.5, 2.0, float("nan")]), "x", "y"))
    rows += [(4, n, n - 1, "assistant", str(n), 1.0, "x", "y") for n in range(1, 301)]
    rows += [(5, 1, 2, "user", "loop", 1.0, "x", "y"), (5, 2, 1, "user", "loop", 1.0, "x", "y"), (5, 3, 2, "user", "below the loop", 1.0, "x", "y")]
    rows += [(6, 1, 99, "user", "orphan", None, "x", "y"), (6, None, 1, "user", "no id", 1.0, "x", "y")]
    return rows + rows[10:20] + [(1, 7, None, "other", "second row of an id", 9.0, "x", "y")]


def test_paths_against_a_plain_walk(spark):
    rows = rows_of_trees()
    want = paths(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    done = reply_trees.format_paths(df, "tree", "node", "parent", "role", "text", "score")
    got = {}
    for r in done.select("*", reply_trees.read_back(F.col("formatted")).alias("said"), reply_trees.learned_text(F.col("formatted"), F.col("turns")).alias("learned")).collect():
        got.setdefault(r.tree, {})[r.path_rank] = r
    assert set(got) == set(want) and 5 not in got
    for tree, branches in want.items():
        points = lambda m: 0.0 if m[5] is None or m[5] != m[5] else m[5]
        ranked = sorted(branches, key=lambda leaf: (-sum(map(points, branches[leaf])) / len(branches[leaf]), leaf))
        assert sorted(got[tree]) == list(range(1, len(ranked) + 1))
        seen = set()
        for rank, leaf in enumerate(ranked, 1):
            r, chain = got[tree][rank], branches[leaf]
            assert [(x.role, x.text) for x in r.said] == [(m[3] or "", m[4] or "") for m in chain]
            fresh = [m for m in chain if m[3] == "assistant" and m[1] not in seen]
            assert r.learned == "".join(m[4] or "" for m in fresh)
            assert [t.loss for t in r.turns] == [m in fresh for m in chain]
            for spot, m in zip(r.turns, chain):
                body = r.formatted[spot.start:spot.end]
                assert body.replace("\\\\", "\0").replace("\\#", "#").replace("\\/", "/").replace("\0", "\\") == (m[4] or "")
            seen |= {m[1] for m in chain}


def test_best_branches_only(spark):
    df = spark.createDataFrame(rows_of_trees(), SCHEMA)
    every = {(r.tree, r.path_rank): r.formatted for r in reply_trees.format_paths(df, "tree", "node", "parent", "role", "text", "score").collect()}
    best = {(r.tree, r.path_rank): r.formatted for r in reply_trees.format_paths(df, "tree", "node", "parent", "role", "text", "score", best=2).collect()}
    assert best == {k: v for k, v in every.items() if k[1] <= 2}


def test_query_on_awkward_tables(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "###"), (None, 3, "assistant", "x"), (None, 1, "user", "y: </turn>"), (3, 5, "assistant", "\\")]
    for name, part in (("some", rows), ("none", [])):
        df = spark.createDataFrame(part, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("parent", F.lit("x"))
        df.write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        got = {r.conv_id: r for r in queries.QUERIES["op13_reply_trees"](spark, f"{tmp_path}/{name}").collect()}
        trap = "\\### Assistant: </turn> ok"
        want = {-7: [("user", trap), ("assistant", trap)]}
        for r in sorted(part, key=lambda r: tuple((x is not None, x) for x in r)):
            want.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
        assert set(got) == set(want)
        for key, turns in want.items():
            learned = "".join(t for role, t in turns if role == "assistant")
            digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
            assert (got[key].n_turns, got[key].turns_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)))
            assert (got[key].loss_chars, got[key].loss_sha256) == (len(learned), digest(learned))


def test_one_tree_with_most_leaves(spark):
    """A root with 20,000 answers of one score: ranks follow the ids, whatever type they have."""
    star = spark.range(1, 20_001).select(F.lit(1).cast("long").alias("tree"), "id", F.when(F.col("id") > 1, 1).alias("parent"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    nodes, leaves = reply_trees.reply_paths(star, "tree", "id", "parent", "role", "text")
    got = [tuple(r) for r in leaves.orderBy("path_rank").select("path_rank", "leaf").collect()]
    assert got == [(i, i + 1) for i in range(1, 20_000)] and nodes.count() == 20_000
    named = star.where("id <= 40").withColumn("id", F.concat(F.lit("m"), F.col("id").cast("string"))).withColumn("parent", F.concat(F.lit("m"), F.col("parent").cast("string")))
    done = reply_trees.format_paths(named, "tree", "id", "parent", "role", "text", best=3).orderBy("path_rank").collect()
    texts = [reply_trees_text(r.formatted) for r in done]
    assert texts == [["1", x[1:]] for x in sorted(f"m{i}" for i in range(2, 41))[:3]]


def reply_trees_text(formatted):
    return [turn.split(": ", 1)[1] for turn in formatted.split("</turn>\n") if turn]
