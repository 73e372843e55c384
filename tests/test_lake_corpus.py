import json
import os

import pytest
from rasters import mask_df, png, raster
from pyspark.sql import functions as F

from defectspark.operators import lake as L
from defectspark.operators import reports as R
from defectspark.operators import validate as V
from defectspark.plans import class_sweep as W
from defectspark.plans import lake_to_samples as E
from defectspark.plans import report_corpus as C
from defectspark.sources import annotations as A
from defectspark.sources import images as I
from defectspark.sources import reports as IO
from defectspark.sources.inventory import read_inventory
from defectspark.streaming import incremental as T
from defectspark.streaming.keyed import KeyedTable


@pytest.fixture()
def lake(tmp_path):
    """A raw lake: empty, broken and non-ASCII files, junk, lifted and 'broken' folders."""
    root = tmp_path / "raw"
    for folder in ("2.金属异物/2.OK集", "2.金属异物/1.NG训练集-已标注", "__MACOSX/x", "Serious defect/pseudo_broken_solder/train_NG_labeled", "sub/deep/er"):
        (root / folder).mkdir(parents=True)
    png(root / "2.金属异物/2.OK集/a.png", [[1, 2], [3, 4]])
    png(root / "2.金属异物/2.OK集/图1.png", [[1, 2], [3, 4]])
    png(root / "2.金属异物/1.NG训练集-已标注/b.png", [[0, 255, 255]])
    (root / "2.金属异物/1.NG训练集-已标注/b.json").write_text(json.dumps({"shapes": [{"points": [[0, 0], [2, 0], [2, 1]], "label": "x"}], "imageHeight": 4, "imageWidth": 5}))
    (root / "2.金属异物/1.NG训练集-已标注/zero.png").write_bytes(b"")
    (root / "__MACOSX/x/._b.png").write_bytes(b"junk")
    png(root / "Serious defect/pseudo_broken_solder/train_NG_labeled/c.png", [[9]])
    png(root / "sub/deep/er/d.png", [[(1, 2, 3)]], colour=True)
    return str(root)


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_inventory_sees_every_file_once(spark, lake, depth):
    got = sorted(r["path"] for r in read_inventory(spark, lake, depth).collect())
    want = sorted(os.path.relpath(os.path.join(d, f), lake) for d, _, fs in os.walk(lake) for f in fs)
    assert got == want and any(p.endswith("zero.png") for p in got)
    kept = read_inventory(spark, lake, depth, skip=["__MACOSX"]).where("path LIKE '%MACOSX%'").count()
    assert kept == 0


def test_a_flat_folder_gives_several_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    for i in range(200):
        (tmp_path / f"f{i}.bin").write_bytes(b"x" * (i % 3))
    found = read_inventory(spark, str(tmp_path), 0, slices=4)
    shares = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) == 4 and sum(shares) == 200 and min(shares) > 20
    sizes = {r["path"]: r["size_bytes"] for r in read_inventory(spark, "file://" + str(tmp_path), 2).collect()}
    assert sizes == {f"f{i}.bin": i % 3 for i in range(200)}


def test_addresses_that_are_not_local(tmp_path):
    """The Arrow path, on the file system that any machine has."""
    from pyarrow import fs

    from defectspark.sources.inventory import entries

    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.png").write_bytes(b"12")
    (tmp_path / "empty.png").write_bytes(b"")
    store = (fs.LocalFileSystem(), str(tmp_path))
    top = {e.path: e.is_folder for e in entries("store://bucket/lake", "", store)}
    below = [e.row()[:2] for e in entries("store://bucket/lake", "a", store)]
    assert top == {"a": True, "empty.png": False} and below == [("a/x.png", 2)]


def test_documents_take_the_frame_of_the_image_beside_them(spark, tmp_path):
    for folder, size in (("one (x+y)", 3), ("two", 5)):
        (tmp_path / folder).mkdir()
        png(tmp_path / folder / "a.png", [[0] * size] * size)
        (tmp_path / folder / "a.json").write_text(json.dumps({"shapes": [{"points": [[0, 0], [9, 0], [9, 9], [0, 9]], "label": "x"}]}))
    files = E.audited_files(spark, str(tmp_path), E.LakeOptions("d"))
    masks, shapes = E.annotation_masks(E.lake_documents(spark, str(tmp_path)), E.image_frames(files))
    got = {r["path"]: (r["height"], r["width"], sum(x1 - x0 + 1 for _, x0, x1 in r["runs"])) for r in masks.collect()}
    assert got == {"one (x+y)/a.json": (3, 3, 9), "two/a.json": (5, 5, 25)} and shapes.count() == 2


def test_audit_rename_and_route(spark, lake):
    options = E.LakeOptions("d")
    files = E.audited_files(spark, lake, options)
    issues = {(r["path"].split("/")[-1], r["issue"]) for r in L.file_issues(files).collect()}
    assert ("zero.png", "zero-byte file") in issues and ("._b.png", "corrupted") in issues
    assert ("图1.png", "non-ascii path") in issues and ("c.png", "corrupted") not in issues
    totals = L.audit_totals(files).first()
    assert (totals["total_images"], totals["corrupted_files"], totals["zero_byte_files"]) == (6, 1, 1)
    modes = {r["value"]: r["n_images"] for r in L.image_histogram(files, F.col("mode")).collect()}
    assert modes == {"L": 4, "RGB": 1}

    routed = {r["raw_path"].split("/")[-1]: r["dst_path"] for r in E.routed_files(files, options).collect()}
    assert routed["a.png"] == "metal_foreign_body/train/good/a.png"
    assert routed["图1.png"].startswith("metal_foreign_body/train/good/img_") and routed["图1.png"].isascii()
    assert routed["b.png"] == "metal_foreign_body/test/metal_foreign_body/b.png"
    assert routed["b.json"] == "metal_foreign_body/ground_truth/metal_foreign_body/b.json"
    assert routed["c.png"] == "pseudo_broken_solder/test/pseudo_broken_solder/c.png"
    assert routed["d.png"] is None and "._b.png" not in routed
    compat = E.routed_files(files, E.LakeOptions("d", compat_substring=True))
    found = {r["raw_path"].split("/")[-1]: r["dst_path"] for r in compat.collect()}
    # The letters "OK" inside "broken" send the defect image to the normals.
    assert found["c.png"] == "pseudo_broken_solder/train/good/c.png"


def test_documents_to_masks(spark, lake):
    docs = A.read_json_documents(spark, lake).withColumn("stem", F.lit("b"))
    masks, shapes = E.annotation_masks(docs)
    assert [tuple(r) for r in masks.first()["runs"]] == [(0, 0, 2), (1, 1, 2)]
    assert shapes.first()["label"] == "x" and shapes.first()["height"] == 4


def test_document_masks_equal_shape_masks(spark):
    from defectspark.operators.masks import explode_runs
    from defectspark.operators.polygons import shape_masks

    texts = [
        '{"shapes":[{"points":[[1,1],[9,2],[4,9]]},{"points":[[0,0],[7,7]],"shape_type":"rectangle"},{"points":[[2,8],[11,3]]}]}',
        "[[0,0],[12,0],[12,10],[6,2],[0,10]]", '{"objects":[{"polygon":[3,3,9,3,9,9,3,9]},{"points":[[1,1]]}]}',
        '{"regions":{"a":{"shape_attributes":{"all_points_x":[1,5,9],"all_points_y":[2,11,4]}},"b":{"shape_attributes":{"name":"rect"},"points":[[1,2],[3,4]]}}}',
        '{"shapes":[]}', "{broken",
    ]
    docs = A.parse_documents(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).withColumns({"height": F.lit(12), "width": F.lit(13)})
    rows = lambda df: sorted((r["id"], r["y"], r["x0"], r["x1"]) for r in df.collect())
    direct = A.document_masks(docs, ["id"])
    assert direct.count() == 6
    assert rows(explode_runs(direct, ["id"])) == rows(shape_masks(A.extract_shapes(docs, ["id", "height", "width"]), ["id"]))


def test_mask_manifest_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p", "a.png", "a.png", True, ["x", "y"], 2), ("p", "b.png", "b.png", False, [], 0)], "part string, image_filename string, mask_filename string, is_defective boolean, defect_categories array<string>, num_defect_regions int")
    IO.write_mask_manifest(rows, str(tmp_path / "m"))
    assert [tuple(r) for r in IO.read_mask_manifest(spark, str(tmp_path / "m")).collect()] == [("a.png", ["x", "y"])]


def test_coco_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a.png", "height": 10, "width": 12}, {"id": 2, "file_name": "b.png"}, {"id": 3, "file_name": "c.png", "height": 4, "width": 4}],
        "categories": [{"id": 5, "name": "chip"}],
        "annotations": [
            {"image_id": 1, "category_id": 5, "segmentation": [1, 1, 4, 1, 4, 3, 1, 3]},
            {"image_id": 1, "category_id": 6, "segmentation": [[6, 6, 8, 6, 8, 8], [1, 1]]},
            {"image_id": 1, "category_id": 7, "bbox": [0, 9, 2, 0], "ignore": 0},
            {"image_id": 1, "category_id": 8, "segmentation": [], "ignore": 1, "bbox": [0, 0, 9, 9]},
            {"image_id": 1, "category_id": 9},
        ],
    }
    (tmp_path / "annotations_lb101.json").write_text(json.dumps(doc))
    (tmp_path / "lb101_train1.json").write_text(json.dumps(doc))
    images, annotations, categories = A.coco_tables(A.read_coco_documents(spark, str(tmp_path)))
    assert images.count() == 3 and {r["part"] for r in images.collect()} == {"lb101"}
    from defectspark.operators.polygons import shape_masks

    polygons = A.annotation_polygons(annotations.join(images.drop("file_name"), ["part", "image_id"]), ["image_id", "ann_no", "height", "width"])
    pixels = {(r["y"], x) for r in shape_masks(polygons).collect() for x in range(r["x0"], r["x1"] + 1)}
    block = {(y, x) for y in (1, 2, 3) for x in range(1, 5)}
    assert block <= pixels and {(9, 0), (9, 1), (9, 2)} <= pixels and (5, 5) not in pixels and (0, 0) not in pixels
    manifest = {r["image_id"]: r for r in L.mask_manifest(images, annotations, categories, ["part", "image_id"]).collect()}
    assert manifest[1]["defect_categories"] == ["cat_6", "cat_7", "cat_9", "chip"]
    assert (manifest[1]["num_defect_regions"], manifest[1]["num_used_regions"]) == (5, 4)
    assert manifest[3]["is_defective"] is False and manifest[3]["defect_categories"] == []


NASTY_TEXTS = ["}", "{", "a } b { c ] [", '\\" } \\\\', "é}ü", "]}],", "", "\\\\"]


@pytest.mark.parametrize("block", [40, 113, 128 << 20])
def test_json_elements_over_blocks(spark, tmp_path, block):
    """Documents cut at any place give the elements that a plain parser sees."""
    from defectspark.sources.json_elements import read_elements

    docs = {}
    for i in range(6):
        items = lambda n: [{"id": k, "name": NASTY_TEXTS[(i + k) % 8], "more": {"x": [1, {"y": "}"}], "z": {}}} for k in range(n)]
        docs[f"d{i}.json"] = {"info": {"a": {"b": "{"}, "c": [{"d": 1}]}, "images": items(i * 3), "none": [], "numbers": [[1, 2], [3]], "annotations": items(7) + [{}], "text": "}]"}
    for i, (name, doc) in enumerate(docs.items()):
        (tmp_path / name).write_text(json.dumps(doc, indent=2 if i % 2 else None, ensure_ascii=i % 3 > 0))
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1}]))
    (tmp_path / "empty.json").write_text("")
    sizes = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = read_elements(spark, str(tmp_path)).collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    got = {}
    for r in rows:
        got.setdefault((os.path.basename(r.path), r.section), []).append(json.dumps(json.loads(r.element), sort_keys=True))
    want = {(n, key): sorted(json.dumps(e, sort_keys=True) for e in doc[key]) for n, doc in docs.items() for key in ("images", "annotations") if doc[key]}
    assert {k: sorted(v) for k, v in got.items()} == want


def test_coco_elements_equal_coco_documents(spark, tmp_path):
    doc = {
        "images": [{"id": 1, "file_name": "a}.png", "height": 10, "width": 12}, {"id": 2, "file_name": "b.png"}], "categories": [{"id": 5, "name": "chip"}],
        "annotations": [{"id": 0, "image_id": 1, "category_id": 5, "segmentation": [1, 1, 4, 1, 4, 3, 1, 3]}, {"id": 1, "image_id": 1, "category_id": 6, "segmentation": [[6, 6, 8, 6, 8, 8]], "ignore": 1}, {"id": 2, "image_id": 2, "bbox": [0, 9, 2, 0]}],
    }
    (tmp_path / "annotations_lb101.json").write_text(json.dumps(doc))
    (tmp_path / "lb101_val1.json").write_text(json.dumps(doc))
    whole = A.coco_tables(A.read_coco_documents(spark, str(tmp_path)))
    parts = A.coco_element_tables(A.read_coco_elements(spark, str(tmp_path)))
    for a, b in zip(whole, parts):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_processed_lake_to_samples(spark, tmp_path):
    root = tmp_path / "processed"
    for folder in ("cat/train/good", "cat/test/good", "cat/test/dent", "cat/ground_truth/dent", "ground_truth/defects", "solo/train/good"):
        (root / folder).mkdir(parents=True)
    for i in range(20):
        (root / f"cat/train/good/n{i}.png").write_bytes(b"x")
    for name in ("cat/test/good/g.png", "cat/test/dent/d1.bmp", "cat/test/dent/d2.bmp", "cat/test/dent/d3.bmp", "cat/ground_truth/dent/d1_mask.png", "ground_truth/defects/d2.png", "solo/train/good/only.png"):
        (root / name).write_bytes(b"x")
    files = read_inventory(spark, str(root)).withColumn("dataset", F.lit("d"))
    samples = E.split_samples(files, E.LakeOptions("d"))
    rows = samples.collect()
    by_split = {s: [r for r in rows if r["split"] == s] for s in ("train", "val", "test")}
    assert len(by_split["val"]) == 2 + 1 and len(by_split["train"]) == 18 and len(by_split["test"]) == 4
    assert [r["empties_rest"] for r in by_split["val"] if r["category"] == "solo"] == [True]
    masks = {os.path.basename(r["image_path"]): r["mask_path"] for r in by_split["test"]}
    assert masks == {"g.png": None, "d1.bmp": "cat/ground_truth/dent/d1_mask.png", "d2.bmp": "ground_truth/defects/d2.png", "d3.bmp": None}
    path = str(tmp_path / "samples")
    IO.write_samples(samples.drop("empties_rest"), path)
    assert spark.read.parquet(path).where("category = 'cat'").count() == 24
    typed = samples.withColumn("defect_types", F.when(F.col("is_anomalous"), F.array(F.lit("dent"))))
    IO.export_split_manifest(typed, str(tmp_path / "nested"), 42, 0.1, parts=3)
    back = IO.read_split_manifest(spark, str(tmp_path / "nested"), lines=True)
    assert back.count() == len(rows) and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    assert back.where("defect_types[0] = 'dent'").count() == typed.where("is_anomalous").count()
    stats = spark.read.json(str(tmp_path / "nested")).select("cat.stats.test.*").where("total IS NOT NULL").agg(F.sum("total"), F.sum("anomalous")).first()
    assert tuple(stats) == (4, 3)


def test_report_corpus_end_to_end(spark, tmp_path):
    masks_dir = tmp_path / "gt"
    masks_dir.mkdir()
    sizes = {"a": 1, "b": 3, "c": 6, "d": 0}
    for name, size in sizes.items():
        png(masks_dir / f"{name}.png", [[255 if y < size and x < size else 0 for x in range(10)] for y in range(10)])
    rows = [("cat", "dent", True, f"data/{n}.png", f"gt/{n}.png") for n in sizes] + [("cat", "dent", True, "data/e.png", None), ("cat", "dent", True, "data/f.png", "gt/f.png"), ("cat", "good", False, "data/g.png", None)]
    samples = spark.createDataFrame(rows, "category string, label string, is_anomalous boolean, image_path string, mask_path string")
    inventory = spark.createDataFrame([(f"gt/{n}.png",) for n in sizes] + [(f"data/{n}.png",) for n in "abd"], "path string")
    options = C.CorpusOptions("lake", "data", "{severity_level} at {affected_area_pct:.2f}%", "sample")
    members, skipped = C.select_members(samples, inventory, options)
    assert {(r["image_path"], r["skip_reason"]) for r in skipped.collect()} == {("data/e.png", "null mask_path"), ("data/f.png", "missing mask file: gt/f.png")}
    split = {r["image_path"]: r["split"] for r in members.collect()}
    assert len(split) == 4 and list(split.values()).count("test") == 1
    masks = I.mask_rows(I.read_images(spark, str(masks_dir)), key=F.concat(F.lit("gt/"), F.substring_index("path", "/", -1))).withColumnRenamed("image_id", "mask_path")
    templates = spark.createDataFrame([("cat", "dent", "A dent in the {region}, {affected_area_pct:.2f}%.", "inspect", "Check the {severity_level} dent.")], "class string, defect_type string, description_template string, action string, reason_template string")
    reports = C.corpus_reports(members, masks, templates, options)
    texts = {r["image_path"]: r["report"]["description"] for r in reports.collect()}
    assert texts["data/b.png"] == "A dent in the upper-left quadrant, 9.00%." and texts["data/d.png"] == "A dent in the None, 0.00%."
    broken = {(r["uid"][:8], r["rule"]) for r in C.corpus_violations(reports, members, inventory, options).collect()}
    assert {rule for _, rule in broken} == {"outside root", "missing image"}
    IO.write_corpus(members, R.grounding_rows(reports, F.lit("lake")), reports.select("uid", "report"), str(tmp_path / "corpus"))
    records = R.training_records(
        spark.read.parquet(str(tmp_path / "corpus/membership")).drop("split"),
        R.grounding_rows(reports, F.lit("lake")), reports,
    )
    assert V.violations(records, ["uid"], V.agreement_rules()).count() == 0
    stored = spark.read.json(str(tmp_path / "corpus/reports"))
    assert stored.count() == 4 and stored.where("report.location.region IS NULL").count() == 1


def test_report_rules_reject_bad_reports(spark):
    df = mask_df(spark, {"e": raster(9, 9), "f": raster(9, 9, (1, 2, 1, 2))}).withColumn("defect_type", F.lit("a"))
    from defectspark.operators.masks import ground_masks

    skeleton = R.skeleton_reports(ground_masks(df))
    assert V.violations(skeleton, ["image_id"], V.report_rules()).count() == 0
    bad_empty = skeleton.where("image_id = 'e'").withColumn("report", F.col("report").withField("location.region", F.lit("none")))
    rules = {r["rule"] for r in V.violations(bad_empty, ["image_id"], V.report_rules()).collect()}
    assert rules == {"region enum", "no defect needs null region"}
    bad_full = skeleton.where("image_id = 'f'").withColumn("report", F.col("report").withField("location.region", F.lit(None).cast("string")))
    with pytest.raises(V.ViolationError):
        V.require_none(V.violations(bad_full, ["image_id"], V.report_rules()))
    with pytest.raises(ValueError):
        R.skeleton_reports(df)


def test_enrichment_hook(spark):
    df = spark.createDataFrame([(("x", "old"),)], "report struct<confidence:string,description:string>")
    assert R.enrich_descriptions(df, None).first() == df.first()
    with pytest.raises(ValueError):
        R.enrich_descriptions(df, None, enabled=True)
    new = R.enrich_descriptions(df, F.upper, enabled=True)
    assert new.first()["report"]["description"] == "OLD" and new.first()["report"]["confidence"] == "x"
    assert V.violations(new, [], V.enrichment_rules()).count() == 0
    blank = R.enrich_descriptions(df, lambda c: F.lit(" "), enabled=True)
    assert V.violations(blank, [], V.enrichment_rules()).first()["rule"] == "empty description"


def test_fidelity_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "fidelity")
    assert IO.read_fidelity(spark, path).count() == 0
    row = lambda ds, c, fid, n=22: (ds, c, 30, n, 1, fid, 0.1, 0.2, 0.7)
    first = spark.createDataFrame([row("d", "a", 1.0), row("d", "b", 2.0)], IO.FIDELITY_SCHEMA)
    one = IO.write_fidelity(first, path, "1")
    update = spark.createDataFrame([row("d", "b", 9.0), row("d", "c", 3.0)], IO.FIDELITY_SCHEMA)
    two = IO.write_fidelity(IO.upsert(IO.read_fidelity(spark, one), update, ["dataset", "class"]), path, "2")
    assert [(r["class"], r["FID"]) for r in IO.read_fidelity(spark, two).orderBy("class").collect()] == [("a", 1.0), ("b", 9.0), ("c", 3.0)]
    with pytest.raises(V.ViolationError):
        IO.write_fidelity(spark.createDataFrame([row("d", "a", float("nan"))], IO.FIDELITY_SCHEMA), path, "3")
    wrong = tmp_path / "wrong.csv"
    wrong.write_text("dataset,kind\nd,a\n")
    with pytest.raises(Exception):
        IO.read_fidelity(spark, str(wrong)).collect()


def test_class_sweep(spark):
    df = mask_df(spark, {f"m{i}": raster(20, 20, (i, i + 1, 3, 5)) for i in range(5)}).withColumnRenamed("image_id", "uid")
    from defectspark.operators.masks import with_crop

    cropped = with_crop(df.withColumns({"class": F.lit("c"), "mask_path": F.concat(F.lit("gt/"), "uid")}), 8)
    cleans = spark.createDataFrame([("c", f"k{i}", 30, 25) for i in range(3)], "class string, clean_path string, clean_w int, clean_h int")
    options = W.SweepOptions(candidates=30)
    plan = W.candidate_plan(cropped, cleans, options)
    rows = plan.collect()
    assert len(rows) == 30 and len({r["mask_path"] for r in rows}) == 5 and all(0 <= r["crop_x"] <= 22 and r["fits"] for r in rows)
    scored = plan.withColumn("score", F.col("index") * 1.5)
    kept, summary, gate = W.accepted_candidates(scored, options)
    assert kept.count() == 22 and gate.count() == 0 and summary.first()["acceptance_rate"] == pytest.approx(22 / 30)
    limited, _, short = W.accepted_candidates(scored, W.SweepOptions(accepted_target=25))
    assert limited.count() == 22 and short.first()["rule"] == "accepted below target"
    out = IO.candidate_metadata(plan, F.lit("d"), "patch", F.lit("c\\l"), F.lit("<t>"), 50, 7.5)
    assert V.key_set_differences(out.columns) == {"missing": [], "unexpected": []}


def test_accepted_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "kept")
    rows = lambda ok: spark.createDataFrame([("d", "a", "u1", True), ("d", "a", "u2", ok)], "dataset string, class string, uid string, accepted boolean")
    IO.write_accepted(rows(True), path)
    IO.write_accepted(spark.createDataFrame([("d", "b", "u3", True)], "dataset string, class string, uid string, accepted boolean"), path)
    IO.write_accepted(rows(False), path)
    assert sorted(r["uid"] for r in IO.read_accepted(spark, path).collect()) == ["u1", "u3"]
    IO.write_accepted(rows(False).withColumn("accepted", F.lit(False)), path)
    assert [r["uid"] for r in IO.read_accepted(spark, path).collect()] == ["u3"]
    # A batch that fails before its manifest is written leaves the table as it was.
    rows(True).where("accepted").write.partitionBy("dataset", "class").parquet(f"{path}/data/version=0000000009")
    assert [r["uid"] for r in IO.read_accepted(spark, path).collect()] == ["u3"] and IO.read_accepted(spark, str(tmp_path / "no")) is None


def test_images_of_one_stem_do_not_repeat_a_document(spark):
    docs = A.parse_documents(spark.createDataFrame([("p/x.json", "x", "{}"), ("q/y.json", "y", "{}")], "path string, stem string, text string"))
    images = spark.createDataFrame([("x", "b/x.png", 5, 6), ("x", "a/x.png", 7, 8)], "stem string, path string, image_height int, image_width int")
    sized = A.document_frame_size(docs, images).select("stem", "height", "width").orderBy("stem").collect()
    assert [tuple(r) for r in sized] == [("x", 7, 8), ("y", 256, 256)]


def test_streams_take_only_new_files(spark, tmp_path):
    source, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    os.makedirs(source)

    def put(name, label):
        with open(f"{source}/{name}.json", "w") as f:
            json.dump({"shapes": [{"points": [[0, 0], [3, 0], [3, 3]], "label": label}], "height": 8, "width": 8}, f)

    def run():
        query = T.append_new(T.stream_shapes(T.stream_documents(spark, source)).drop("points"), target, ckpt)
        query.awaitTermination()
        return sorted(r["label"] for r in spark.read.parquet(target).collect())

    put("a", "one")
    assert run() == ["one"] and run() == ["one"]
    put("b", "two")
    assert run() == ["one", "two"]


def test_streamed_upsert_keeps_the_last(spark, tmp_path):
    source, target, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    schema = "k string, v int, t int"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        table = KeyedTable(spark, target, ["k"], buckets=4)
        T.upsert_new(spark.readStream.schema(schema).parquet(source), table, ckpt, ["t"]).awaitTermination()
        return {r["k"]: r["v"] for r in table.read().collect()}

    assert run([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)]) == {"a": 2, "b": 5}
    assert run([("b", 6, 2), ("c", 7, 1)]) == {"a": 2, "b": 6, "c": 7}
    assert run([("b", 9, 1), ("c", 8, 1)]) == {"a": 2, "b": 6, "c": 8}


def test_an_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=8)
    assert table.read() is None
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t/data").rglob("*.parquet")}
    base = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("t"), F.lit("old").alias("v"))
    assert len(table.upsert(base, ["t"])) == 8
    first = files()
    assert len(first) == 8
    one = spark.createDataFrame([(7, 2, "new"), (7, 1, "late")], "k long, t int, v string")
    written = table.upsert(one, ["t"])
    second = files()
    assert len(written) == 1 and len(set(second) - set(first)) == 1 and all(second[p] == first[p] for p in first)
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 200 and rows.pop(7) == "new" and set(rows.values()) == {"old"}
    # A version written again after a failure replaces itself; data that no kept manifest names goes.
    assert table.merge(one.withColumn("v", F.lit("again")), ["t"], 1) == written and table.read().where("k = 7").first().v == "again"
    table.upsert(base.withColumn("t", F.lit(3)), ["t"])
    table.upsert(base.withColumn("t", F.lit(4)), ["t"])
    assert {p.parent.parent.name for p in files()} == {"version=0000000002", "version=0000000003"}
    assert table.upsert(one.limit(0), ["t"]) == [] and table.read().count() == 200
    none = spark.createDataFrame([(None, 1, "x"), (None, 2, "y")], "k long, t int, v string")
    table.upsert(none, ["t"])
    assert [r.v for r in table.read().where("k IS NULL").collect()] == ["y"]


def test_positions_spread_ties(spark):
    from defectspark.operators.ordering import ranged, with_position

    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"), "id")
    got = with_position(df, ["a", "b"])
    rows = [tuple(r) for r in got.orderBy("position").select("position", "a", "b").collect()]
    assert [r[0] for r in rows] == list(range(30_000))
    order = [((a is not None, a), b) for _, a, b in rows]
    assert order == sorted(order, key=lambda r: (r[0][0], r[0][1] or 0, r[1]))
    # A third of the rows tie on a null; several tasks share them.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = ranged(df, ["a"]).where("a IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 8000
    assert with_position(df.limit(0), ["a"]).collect() == []


def test_configuration_rows(spark):
    config = {"d": {"classes": {"a": {"x": ("text", "inspect", "why")}, "b": {}}, "excluded_classes": ["b"]}}
    classes, templates = IO.configuration_rows(spark, config)
    assert {(r["class"], r["excluded"]) for r in classes.collect()} == {("a", False), ("b", True)} and templates.count() == 1
    with pytest.raises(ValueError):
        IO.configuration_rows(spark, {"d": {"classes": {"a": {}}, "excluded_classes": ["z"]}})


def test_manifest_of_few_categories_spreads_by_image(spark, monkeypatch):
    """No step gathers all annotations of a category; a large category table gives the same rows."""
    images = spark.createDataFrame([(i,) for i in [*range(30), None]], "image_id long")
    rows = [(i % 25, ["a", "b", None][i % 3], int(i % 4 == 0)) for i in range(300)] + [(None, "a", 0)]
    annotations = spark.createDataFrame(rows, "image_id long, category_id string, ignore int")
    categories = spark.createDataFrame([("a", "dent"), ("c", "chip")], "category_id string, category_name string")
    found = L.mask_manifest(images, annotations, categories, ["image_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(category_id" not in plan
    got = sorted(map(repr, found.collect()))
    assert len(got) == 31 and "num_defect_regions=12" in got[0]
    for partitions in (1, 5):
        monkeypatch.setattr(L, "_FEW_CATEGORIES", 0)
        assert sorted(map(repr, L.mask_manifest(images, annotations, categories, ["image_id"], partitions).collect())) == got
