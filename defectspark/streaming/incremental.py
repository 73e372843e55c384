"""Convert only new files, append results as they arrive, upsert by key, resume.

Every function runs with ``availableNow``: it takes what is new since its checkpoint and
stops. A new checkpoint folder means "force": everything is read again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from defectspark.sources.annotations import document_frame_size, extract_shapes, parse_documents
from defectspark.streaming.keyed import KeyedTable


def stream_documents(spark: SparkSession, root: str, glob: str = "*.json", files_per_batch: int = 10000) -> DataFrame:
    """New annotation files below ``root`` as ``path, text``."""
    reader = (
        spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(files_per_batch))
    )
    return reader.load(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def stream_shapes(documents: DataFrame) -> DataFrame:
    """Shapes of new documents: a stateless plan, so each file is converted once."""
    return extract_shapes(document_frame_size(parse_documents(documents)), ["path", "height", "width"])


def append_new(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table; a restart continues after the last commit."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", target)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def upsert_new(stream: DataFrame, table: KeyedTable, checkpoint: str, order: Sequence[str]) -> StreamingQuery:
    """Upsert each micro-batch into a keyed table; the batch number is the version it writes.

    A batch reads and rewrites only the buckets of its keys, and a batch that is replayed after a
    failure writes the same version again.
    """
    return (
        stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, order, number))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def process_rest(
    scope: DataFrame, finished: DataFrame, keys: Sequence[str], work: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Run ``work`` on the keys that are not finished yet."""
    return work(scope.join(finished.select(*keys).distinct(), list(keys), "left_anti"))
