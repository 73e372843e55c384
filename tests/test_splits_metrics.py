import hashlib
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from defectspark.functions.rounding import half_even, half_up_product
from defectspark.operators import metrics as N
from defectspark.operators import ranking as K
from defectspark.operators.coreset import coreset
from defectspark.operators.neighbours import nearest_neighbours
from defectspark.operators import results as R
from defectspark.operators import series as S
from defectspark.operators import splits as P
from defectspark.operators import validate as V


def key(seed, uid):
    return hashlib.sha256(f"{seed}|{uid}".encode()).hexdigest()


def skewed(n=3000):
    """One stratum with a third of all rows, many small ones, one singleton."""
    random.seed(1)
    rows = [(f"u{i}", "hot" if i % 3 == 0 else f"c{random.randrange(40)}", "t", random.random()) for i in range(n)]
    rows.append(("solo", "only", "t", 0.5))
    random.shuffle(rows)
    return rows


def test_half_up_counts(spark):
    cases = [(1, 0.2, 0), (2, 0.2, 1), (5, 0.5, 3), (20, 0.2, 4), (63, 0.2, 13)]
    for n, f, want in cases:
        rows = spark.range(n).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit("c").alias("class"), F.lit("d").alias("defect_type"))
        got = P.stratified_split(rows, ["class", "defect_type"], "uid", fraction=f).where("split = 'test'").count()
        assert got == want
    expect = [int((Decimal(n) * Decimal("0.35")).quantize(Decimal(1), ROUND_HALF_UP)) for n in range(200)]
    assert [r[0] for r in spark.range(200).orderBy("id").select(half_up_product(F.col("id"), 0.35)).collect()] == expect


def test_banker_rounding(spark):
    values = [-2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 3.49, 3.51]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert [r[0] for r in df.select(half_even(F.col("v"))).collect()] == [round(v) for v in values]


def test_split_is_order_free_and_exact(spark):
    rows = skewed()
    frame = lambda data: spark.createDataFrame([r[:3] for r in data], "uid string, class string, defect_type string")
    one = {r["uid"]: r["split"] for r in P.stratified_split(frame(rows), ["class", "defect_type"], "uid").collect()}
    two = {r["uid"]: r["split"] for r in P.stratified_split(frame(rows[::-1]), ["class", "defect_type"], "uid").collect()}
    assert one == two and len(one) == len(rows) and one["solo"] == "train"
    groups = {}
    for uid, cls, *_ in rows:
        groups.setdefault(cls, []).append(uid)
    for uids in groups.values():
        n = len(uids)
        count = 0 if n <= 1 else min(max(int((Decimal(n) * Decimal("0.2")).quantize(Decimal(1), ROUND_HALF_UP)), 1), n - 1)
        chosen = sorted(uids, key=lambda u: key(42, u))[:count]
        assert {u for u in uids if one[u] == "test"} == set(chosen)


def test_budgets_are_nested(spark):
    df = spark.createDataFrame([r[:3] for r in skewed()], "uid string, class string, defect_type string")
    sets = [{r["uid"] for r in P.budget_pairs(df, ["class"], "uid", b).collect()} for b in (5, 10, 20, "all")]
    assert sets[0] < sets[1] < sets[2] < sets[3] and len(sets[3]) == 3001
    short = P.budget_pairs(df, ["class"], "uid", 5).where("class = 'only'").first()
    assert short["shortfall"] == 4
    for bad in (0, -1, True, "some"):
        with pytest.raises(ValueError):
            P.budget_pairs(df, ["class"], "uid", bad)


@pytest.mark.parametrize("descending", [False, True])
def test_exact_rank_and_running_sums(spark, descending):
    rng = np.random.default_rng(0)
    scores = np.concatenate([rng.normal(0, 1e-3, 300), rng.normal(0, 1e4, 300), np.zeros(20), rng.integers(-3, 3, 300)])
    rows = [(["a", "b"][i % 2], float(v)) for i, v in enumerate(scores)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = K.running_sums(df, ["g"], "v", {"n": F.count(F.lit(1))}, K.value_bucket(F.col("v")), descending).collect()
    for r in got:
        same = [v for g, v in rows if g == r["g"]]
        before = sum(v > r["v"] if descending else v < r["v"] for v in same)
        assert (r["n"], r["n_before"], r["n_total"]) == (same.count(r["v"]), before, len(same))


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "g string, score double").withColumn("id", F.monotonically_increasing_id())
    out = {r["score"]: (r["threshold"], r["accepted"]) for r in N.percentile_filter(df, ["g"], percentile=50).collect()}
    assert out == {1.0: (2.0, False), 3.0: (2.0, True), 2.0: (2.0, True)}
    assert P.stratified_split(df, ["g"], "id", fraction=0.5).count() == 3


def test_sampled_bucket_ranks_strings(spark):
    names = [f"{hashlib.md5(str(i).encode()).hexdigest()}" for i in range(4000)]
    df = spark.createDataFrame([("x", n) for n in names], "g string, name string")
    bucket = K.sampled_bucket(df, F.col("name"), buckets=8, per_bucket=4)
    got = {r["name"]: r["rank_no"] for r in K.exact_rank(df, ["g"], [F.col("name")], bucket).collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}


def test_percentile_filter_known_case(spark):
    df = spark.createDataFrame([("c", float(i)) for i in (1, 2, 3, 4)], "class string, score double")
    out = N.percentile_filter(df, ["class"])
    assert out.first()["threshold"] == 1.75
    summary = N.acceptance_summary(out, ["class"]).first()
    assert (summary["accepted"], summary["rejected"], summary["acceptance_rate"]) == (3, 1, 0.75)
    thirty = spark.createDataFrame([("c", float(i) ** 1.1) for i in range(30)], "class string, score double")
    assert N.acceptance_summary(N.percentile_filter(thirty, ["class"]), ["class"]).first()["accepted"] == 22


def test_percentiles_match_numpy(spark):
    rows = skewed()
    df = spark.createDataFrame([(r[1], r[3]) for r in rows], "g string, v double")
    got = {r["g"]: r for r in K.exact_percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.5, "c": 0.99}).collect()}
    for g, r in got.items():
        values = [x[3] for x in rows if x[1] == g]
        assert [r["a"], r["b"], r["c"]] == pytest.approx(np.percentile(values, [10, 50, 99]).tolist())


def test_scores_with_ties_and_single_class(spark):
    rng = np.random.default_rng(2)
    rows = [("m", float(s), bool(y)) for s, y in zip(rng.integers(0, 20, 500), rng.random(500) < 0.3)]
    rows += [("one", 1.0, True), ("one", 2.0, True)]
    got = {r["g"]: r for r in N.threshold_metrics(spark.createDataFrame(rows, "g string, s double, y boolean"), ["g"], "s", "y").collect()}
    pos = [s for g, s, y in rows if g == "m" and y]
    neg = [s for g, s, y in rows if g == "m" and not y]
    auroc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    best = max(2 * sum(p >= t for p in pos) / (sum(p >= t for p in pos + neg) + len(pos)) for t in set(pos + neg))
    assert got["m"]["auroc"] == pytest.approx(auroc) and got["m"]["f1"] == pytest.approx(best)
    assert got["one"]["auroc"] is None


def vectors(spark, n=160, d=5):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, d))
    side = ["real" if i % 3 else "synthetic" for i in range(n)]
    cls = ["a" if i % 5 else "b" for i in range(n)]
    df = spark.createDataFrame(
        [(i, c, s, v.tolist()) for i, (c, s, v) in enumerate(zip(cls, side, x))], "id long, class string, side string, x array<double>"
    )
    pick = lambda c, s: x[[i for i in range(n) if cls[i] == c and side[i] == s]]
    return df, pick


def kid_of(a, b):
    d = a.shape[1]
    k = lambda u, v: (u @ v.T / d + 1) ** 3
    inside = lambda m: (k(m, m).sum() - np.trace(k(m, m))) / (len(m) * (len(m) - 1))
    return inside(a) + inside(b) - 2 * k(a, b).mean()


def test_set_distances_match_numpy(spark):
    df, pick = vectors(spark)
    kid = {r["class"]: r["kid"] for r in N.kernel_distance(df, ["class"], "side", "x", "real", "synthetic", 5).collect()}
    fid = {r["class"]: r["fid"] for r in N.frechet_distance(df, ["class"], "side", "x", "real", "synthetic").collect()}
    for c in "ab":
        a, b = pick(c, "real"), pick(c, "synthetic")
        assert kid[c] == pytest.approx(kid_of(a, b))
        s1, s2 = np.cov(a.T), np.cov(b.T)
        roots = np.sqrt(np.linalg.eigvals(s1 @ s2).real.clip(0)).sum()
        want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(s1) + np.trace(s2) - 2 * roots
        assert fid[c] == pytest.approx(want)


def test_null_groups_stay(spark):
    df, _ = vectors(spark)
    nulled = df.withColumn("class", F.when(F.col("class") != "a", F.col("class")))
    for found, key in (
        (N.frechet_distance(nulled, ["class"], "side", "x", "real", "synthetic"), "fid"),
        (N.kernel_distance(nulled, ["class"], "side", "x", "real", "synthetic", 5), "kid"),
        (N.kernel_distance_subsets(nulled, ["class"], "side", "id", "x", "real", "synthetic", subsets=3, max_size=5), "kid"),
    ):
        got = {r["class"]: r[key] for r in found.collect()}
        assert set(got) == {None, "b"} and all(v is not None for v in got.values())
    assert {r["class"] for r in coreset(nulled, ["class"], "id", "x").collect()} == {None, "b"}
    halves = nulled.where("side = 'synthetic'"), nulled.where("side = 'real'")
    assert {r["class"] for r in nearest_neighbours(*halves, ["class"], "id", "x", k=2).collect()} == {None, "b"}


def test_buckets_order_every_double(spark):
    values = [float("-inf"), -1e300, -2.0, 0.0, 1e-300, 3.0, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    rows = df.withColumn("b", K.value_bucket(F.col("v"))).orderBy("i").collect()
    assert [r["b"] for r in rows] == sorted({r["b"] for r in rows})


def test_subset_kernel_distance(spark):
    df, pick = vectors(spark)
    # Equal sizes and a large limit: every draw is the whole smaller set.
    equal = df.where("class = 'b'")
    n = min(len(pick("b", "real")), len(pick("b", "synthetic")))
    out = N.kernel_distance_subsets(equal, ["class"], "side", "id", "x", "real", "synthetic", subsets=7, max_size=n).first()
    again = N.kernel_distance_subsets(equal.orderBy(F.desc("id")), ["class"], "side", "id", "x", "real", "synthetic", subsets=7, max_size=n).first()
    assert out["subsets"] == 7 and out["kid"] == pytest.approx(again["kid"]) and math.isfinite(out["kid"])


def test_diversity_equals_all_pairs(spark):
    df, pick = vectors(spark)
    got = {r["class"]: r["diversity"] for r in N.mean_pairwise_distance(df, ["class"], "x").collect()}
    for c in "ab":
        x = np.concatenate([pick(c, "real"), pick(c, "synthetic")])
        pairs = [((x[i] - x[j]) ** 2).sum() for i in range(len(x)) for j in range(i)]
        assert got[c] == pytest.approx(np.mean(pairs))


def plain_greedy(points, count):
    ids = sorted(points)
    chosen = [ids[0]]
    near = {i: ((points[i] - points[ids[0]]) ** 2).sum() for i in ids}
    while len(chosen) < count:
        far = max((i for i in ids if i not in chosen), key=lambda i: (near[i], -i))
        chosen.append(far)
        near = {i: min(near[i], ((points[i] - points[far]) ** 2).sum()) for i in ids}
    return chosen


@pytest.mark.parametrize("block_rows, proposed", [(65_536, 1 << 25), (11, 600), (40, 100_000)])
def test_coreset_equals_plain_greedy(spark, monkeypatch, block_rows, proposed):
    from defectspark.operators import coreset as C

    monkeypatch.setattr(C, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(C, "PROPOSED_BYTES", proposed)
    draw = np.random.default_rng(6)
    x = np.concatenate([draw.normal(size=(140, 3)), np.repeat(draw.integers(0, 2, (20, 3)), 2, 0)])
    rows = [(i, "a" if i % 3 else "b", v.tolist(), "q") for i, v in enumerate(x)] + [(500, None, [1.0, 2.0, 3.0], "q"), (501, "a", None, "q")]
    df = spark.createDataFrame(rows, "id long, class string, x array<double>, k string")
    got = sorted((str(r["class"]), r["pick"], r["id"]) for r in coreset(df, ["class"], "id", "x", ratio=0.2).collect())
    want = [("None", 0, 500)]
    for c in "ab":
        points = {i: np.array(v) for i, g, v, _ in rows if g == c and v is not None}
        want += [(c, n, i) for n, i in enumerate(plain_greedy(points, math.ceil(0.2 * len(points))))]
    assert got == sorted(want)
    assert coreset(df.limit(0), ["class"], "id", "x").collect() == []


@pytest.mark.parametrize("wave_bytes", [48 << 20, 4000])
def test_neighbours_with_pivots(spark, wave_bytes):
    df, pick = vectors(spark)
    extra = spark.createDataFrame([(900, "c", "synthetic", [0.0] * 5), (901, "a", "real", None), (902, "b", "synthetic", None)], df.schema)
    both = df.unionByName(extra).unionByName(df.where("side = 'real' AND id < 40"))  # some bank rows twice
    bank = [(r["class"], np.array(r["x"])) for r in both.where("side = 'real' AND x IS NOT NULL").collect()]
    queries = both.where("side = 'synthetic'")
    found = nearest_neighbours(queries, both.where("side = 'real'"), ["class"], "id", "x", k=4, wave_bytes=wave_bytes).collect()
    for r in queries.where("x IS NOT NULL").collect():
        want = sorted(np.sqrt(((b - np.array(r["x"])) ** 2).sum()) for c, b in bank if c == r["class"])[:4]
        got = sorted((f["rank_no"], f["distance"]) for f in found if f["id"] == r["id"])
        assert [d for _, d in got] == pytest.approx(want, abs=1e-6) and [n for n, _ in got] == list(range(1, len(want) + 1))
    assert not {900, 902} & {f["id"] for f in found}


def test_blocks_out_of_reach_are_not_read():
    from defectspark.operators.neighbours import Bank

    draw = np.random.default_rng(2)
    centres = 100 * draw.normal(size=(8, 4))
    rows = []
    for no, c in enumerate(centres):
        for v in c + draw.normal(size=(50, 4)):
            rows.append({"g": "a", "block": (no, 0), "pivot": c.tolist(), "away": float(np.sqrt(((v - c) ** 2).sum())), "x": v.tolist()})
    bank = Bank(rows, ["g"])
    q = centres + 0.1
    want = np.sort(np.sqrt((((q[:, None, :] - np.array([r["x"] for r in rows])[None]) ** 2).sum(2))), axis=1)[:, :3]
    first = bank.improve(("a",), q, np.full((8, 3), np.inf))
    assert first == pytest.approx(want, abs=1e-6)
    # With the answers at hand, a block is read for the queries near its pivot only.
    met = []
    for i, (pivot, reach, x) in enumerate(bank.groups[("a",)]):
        met.append(int((np.sqrt(((q - pivot) ** 2).sum(1)) - reach <= first[:, -1]).sum()))
    assert met == [1] * 8


def test_quality_flags_fence(spark):
    # Published kernel distances of 26 classes and the fence computed from them.
    kids = [
        0.057903484, 0.026430028, 0.010056690, 0.087823495, 0.030808164, 0.013328644, 0.116471671, 0.103112787, 0.024236422,
        0.001706220, 0.111349396, 0.014985562, 0.024948366, 0.133784488, 0.085990950, 0.015403443, 0.022404127, 0.026969777,
        0.022390369, 0.005034176, 0.052174415, 0.074526243, 0.061565224, 0.007293243, 0.023014201, 0.035139225,
    ]
    df = spark.createDataFrame([(f"c{i}", k, 22 / 30, 22) for i, k in enumerate(kids)], "class string, kid double, rate double, accepted int")
    out = N.quality_flags(df, "kid", "rate", "accepted", 0.30, 0.90, 30).collect()
    assert {r["flags"] for r in out} == {"OK"}
    assert out[0]["fence_low"] == pytest.approx(-0.064053546, abs=1e-8)
    assert out[0]["fence_high"] == pytest.approx(0.152489709, abs=1e-8)
    worse = N.quality_flags(df.withColumn("rate", F.lit(0.95)).withColumn("accepted", F.lit(8)), "kid", "rate", "accepted", 0.3, 0.9, 30)
    assert worse.first()["flags"] == "LFS_OUTSIDE_EXPECTED_BAND,LOW_ACCEPTED_COUNT"


def test_candidate_plan_wraps_around(spark):
    pairs = spark.createDataFrame([("c", i + 1, 3, f"m{i}") for i in range(3)], "class string, pair_rank long, n_pairs long, mask_path string")
    cleans = spark.createDataFrame([("c", i + 1, 2, f"k{i}") for i in range(2)], "class string, clean_rank long, n_cleans long, clean_path string")
    plan = P.plan_candidates(pairs, cleans, pairs.select("class").distinct(), 7, 42).orderBy("index").collect()
    assert [(r["mask_path"], r["clean_path"], r["seed"]) for r in plan] == [(f"m{i % 3}", f"k{i % 2}", 42 + i) for i in range(7)]


def test_spaced_picks(spark):
    df = spark.range(23).select(F.lit("g").alias("g"), "id")
    got = [r["id"] for r in P.spaced_picks(df, ["g"], [F.col("id")], K.step_bucket(F.col("id"), 4), 6).orderBy("pick_no").collect()]
    assert got == [round(i * 22 / 5) for i in range(6)]


def test_series_rules(spark):
    rows = [("r", i, float(30 - i)) for i in range(25)] + [("up", i, float(i)) for i in range(25)] + [("few", i, 9.0 - i) for i in range(6)]
    df = spark.createDataFrame(rows, "run string, t long, loss double")
    numbered = S.numbered(df, ["run"], [F.col("t")], K.step_bucket(F.col("t"), 4))
    broken = {(r["run"], r["rule"]) for r in V.violations(S.loss_trend(numbered, ["run"], "loss"), ["run"], V.loss_rules()).collect()}
    assert broken == {("up", "loss did not fall"), ("few", "too few values")}
    means = S.downsampled(numbered.where("run = 'r'"), ["run"], "loss").orderBy("update").collect()
    assert [r["n_steps"] for r in means] == [8, 8, 8, 1] and means[0]["mean_value"] == 26.5


def test_results_known_answers(spark):
    aurocs = [1.0000001192092896, 1.0, 0.9872564077377319, 0.9909089803695679, 0.9920634627342224, 0.9811911582946777, 1.0, 1.0,
              0.998065710067749, 0.9696641564369202, 0.9634920358657837, 1.0, 0.8888888955116272, 0.9950000047683716, 0.9766666293144226, 0.9666666984558105]
    df = spark.createDataFrame([("d", "bottle" if i < 2 else f"c{i}", v) for i, v in enumerate(aurocs)], "dataset string, category string, v double")
    mean = R.with_mean(df, ["dataset"], "category", ["v"]).where("category = 'MEAN'").first()["v"]
    assert mean == pytest.approx(0.9818665161728859, abs=1e-12)


def test_section_table_layout(spark):
    raw = spark.createDataFrame(
        [("B", "zeta", "0.5", ""), ("B", "Alpha", "x", "0.25"), ("A", "one", "1", None), ("A", "MEAN", "9", "9"), ("A", " ", "9", "9")],
        "dataset string, Category string, `image AUROC` string, pixel_auc string",
    )
    rows = R.unify_headers(raw.withColumnRenamed("image AUROC", "Image_AUROC"), keep=["dataset"])
    table = R.section_table(rows, "dataset", "category", ["image_AUROC", "pixel_AUROC"]).orderBy("section", "place", "sort_name").collect()
    shown = [(r["dataset"], r["category"], r["image_AUROC"], r["pixel_AUROC"]) for r in table]
    assert shown == [
        ("A", "one", "1.0000", "N/A"), ("A", "MEAN", "1.0000", "N/A"), ("", "", "", ""),
        ("B", "Alpha", "N/A", "0.2500"), ("B", "zeta", "0.5000", "N/A"), ("B", "MEAN", "0.5000", "0.2500"),
    ]
