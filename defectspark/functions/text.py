"""Text, path and key rules as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image suffixes, junk folders, stem suffixes, lifted top folder.
IMAGE_SUFFIXES = [".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif"]
JUNK_FOLDERS = ["__MACOSX", "defect_samples"]
EXCLUDED_CATEGORY_FOLDERS = ["ground_truth", ".DS_Store", "__MACOSX", ".git", ".dvc"]
STEM_SUFFIXES = ["_leftImg8bit", "_rightImg8bit", "_gtFine_polygons", "_labelIds", "_mask", "_gt"]
LIFTED_FOLDER = "Serious defect"

# Folder-name translations.
FOLDER_NAMES = {
    "1.NG训练集-已标注": "train_NG_labeled",
    "2.NG测试集-已标注": "test_NG_labeled",
    "1.NG集-已标注": "train_NG_labeled",
    "2.OK集": "test_OK",
    "3.OK测试集": "test_OK",
    "3.缺陷示意": "defect_samples",
    "3.缺陷示例": "defect_samples",
    "4.缺陷示意": "defect_samples",
    "1.漏焊+断焊": "pseudo_broken_solder",
    "2.金属异物": "metal_foreign_body",
    "3.IRBASE": "ir_base",
    "4.B2B软板器材": "b2b_flex_pcb",
    "5.IC软板器材": "ic_flex_pcb",
    "6.板材缺失": "missing_plate",
    "7.露锡珠少胶": "solder_bead",
    "8.大面积脏污": "contamination",
    "大面积缺失": "large_area_missing",
    "阻尼器缺失": "damper_missing",
    "画线": "drawn_line",
    "算法框": "algo_box",
    "程序3 相机1 算法框30": "proc3_cam1_box30",
    **{f"算法框{i}": f"algo_box_{i}" for i in range(1, 13)},
}


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def file_extension(name: Column) -> Column:
    """Suffix with its dot; empty when there is none or the name is a dotfile."""
    return F.regexp_extract(name, r"^.+(\.[^./]+)$", 1)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^./]+$", "")


def is_image_name(name: Column) -> Column:
    return F.lower(file_extension(name)).isin(IMAGE_SUFFIXES)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder_of(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"^(?s)(.*)/[^/]*$", 1)


def posix_path(path: Column) -> Column:
    """Backslashes to slashes, single separators, no leading ``./``."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(slashed, "/+", "/"), r"^(\./)+", "")


def relative_path(path: Column, root: str) -> Column:
    """The part of a file's address below ``root``; both may be encoded, and local ones may have one or three slashes."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    single = F.replace(plain, F.lit("file:///"), F.lit("file:/"))
    base = root.replace("file:///", "file:/").rstrip("/") + "/"
    return F.when(single.startswith(base), F.substring(single, len(base) + 1, 1 << 30)).otherwise(single)


def is_under(path: Column, root: str) -> Column:
    """Lexical containment; any ``..`` component counts as outside."""
    clean = posix_path(path)
    return clean.startswith(root.rstrip("/") + "/") & ~clean.rlike(r"(^|/)\.\.(/|$)")


def strip_image_suffix(stem: Column) -> Column:
    """Drop a second image suffix left in a stem such as ``a.png`` of ``a.png.json``."""
    return F.regexp_replace(stem, r"(?i)(?<=.)\.(png|jpg|jpeg|bmp)$", "")


def normalized_stem(stem: Column) -> Column:
    """Stem without a second image suffix and without one camera/label suffix."""
    pattern = "(" + "|".join(STEM_SUFFIXES) + ")$"
    return F.regexp_replace(strip_image_suffix(stem), pattern, "")


def translate_folders(parts: Column, names: Mapping[str, str] = FOLDER_NAMES) -> Column:
    """Translate each path component by an exact-name table (a literal map)."""
    table = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    return F.transform(parts, lambda part: F.coalesce(F.try_element_at(table, part), part))


def ascii_file_name(name: Column) -> Column:
    """Stable ASCII name for a non-ASCII file: ``img_`` plus 8 hex digits of its hash."""
    digest = F.substring(F.sha2(name, 256), 1, 8)
    return F.when(
        has_non_ascii(name), F.concat(F.lit("img_"), digest, file_extension(name))
    ).otherwise(name)


def slug(text: Column, default: str = "item") -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.trim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def class_slug(name: Column, drop_numeric_prefix: bool = True) -> Column:
    """Slug used in token names; null when nothing is left (callers report it)."""
    text = F.regexp_replace(name, r"^\d+[._ -]*", "") if drop_numeric_prefix else name
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.nullif(F.trim(dashed, F.lit("-")), F.lit(""))


def sample_uid(dataset: Column, cls: Column, defect_type: Column, image_path: Column) -> Column:
    identity = F.concat_ws("|", dataset, cls, defect_type, image_path)
    digest = F.substring(F.sha2(identity, 256), 1, 12)
    return F.concat_ws("-", slug(cls), slug(defect_type), digest)


def candidate_uid(cls: Column, index: Column, seed: Column) -> Column:
    return F.format_string("%s-%04d-s%08d", slug(cls, "class"), index, seed)


def normalized_header(name: str) -> str:
    return name.lower().replace(" ", "").replace("-", "")


def metric_key(name: Column) -> Column:
    """Metric name usable as a column or log key."""
    return F.regexp_replace(name, "[/ ]", "_")


def part_name(stem: Column, prefix: str = "lb") -> Column:
    """First ``_`` token of a stem that starts with ``prefix``, else the stem."""
    tokens = F.filter(F.split(stem, "_"), lambda token: token.startswith(prefix))
    return F.coalesce(F.try_element_at(tokens, F.lit(1)), stem)


def fill_template(template: Column, fields: Mapping[str, Column]) -> Column:
    """Replace ``{name}`` markers; ``affected_area_pct`` is given with ``:.2f``."""
    text = template
    for name, value in fields.items():
        marker = "{" + name + (":.2f}" if name == "affected_area_pct" else "}")
        text = F.replace(text, F.lit(marker), value)
    return text


def compact_json(value: Column) -> Column:
    """Single-line JSON with nulls kept; give struct fields in sorted order."""
    return F.to_json(value, {"ignoreNullFields": "false"})
