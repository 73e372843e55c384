"""Small tables with every awkward case, and empty ones, for all text operators."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (4, "one two", None, "a", 7),
    (4, "one two", None, "a", 7),
    (None, "x y z x y z x y z", "en", None, 17),
    (5, "word " * 30000, "en", "a", 150000),
    (6, "ünï ñandú 123 !!! *** \n\nline\nline\n \nline", "es", "b", -1),
    (7, "same word\x0bsplit\x0chere", "fr", "b", 4),
]


@pytest.fixture(scope="session")
def tiny(spark, tmp_path_factory):
    """Tables with nulls, empty and long texts, repeated rows and extra columns with clashing names."""
    from pyspark.sql import functions as F

    folder = str(tmp_path_factory.mktemp("tiny"))
    docs = spark.createDataFrame(EDGE, DOCS)
    for name in ("shard", "hits", "score", "rid", "piece", "length", "start", "label", "words"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "x y z"), (10, "ONE two"), (2, None), (None, "line line"), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    spark.createDataFrame([], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder
