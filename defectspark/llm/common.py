"""Helpers shared by the text operators: stored steps, exact global ranks, fold rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from defectspark.session import shared_folder

_IN_TASK = (1 << 33) - 1
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Shuffle files go when the step that wrote them has ended: what it gave lies in its own files.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Whole texts sent to Python at a time: a batch is held by the executor and its worker at once.
TEXT_ROWS = 500


def store(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so that lost executors cost no rerun.

    ``batch_rows``: at most so many rows go to Python functions at a time in this step; the session's own setting comes back.
    """
    path, conf = shared_folder(df.sparkSession, name), df.sparkSession.conf
    held, kept = conf.get(_BATCH_ROWS), conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    if batch_rows and not 0 < int(held) <= batch_rows:
        conf.set(_BATCH_ROWS, batch_rows)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_BATCH_ROWS, held)
        conf.set(_CLEANUP, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame) -> None:
    """Remove the files of tables from ``store`` that no later step reads."""
    for df in stored:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: its Python worker waits for the next one beside other stages' workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def global_rank(df: DataFrame, keys: Sequence[str], rank: str, name: str) -> DataFrame:
    """Exact 0-based rank in the order of ``keys``; nothing but one count per task meets in one place.

    Rows are ranged by the keys and sorted where they land; the order inside a task comes with
    the row, and the counts of the tasks give the offsets. Rows that tie on all keys must be
    interchangeable, their order is free. The stored rows fix the ranks for all later reads.
    """
    ids, task, place = f"__{rank}_id", f"__{rank}_task", f"__{rank}_place"
    # A number of the row, not of its values, splits ties on all keys over tasks.
    numbered = df.withColumn(ids, F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*keys, ids).sortWithinPartitions(*keys, ids).drop(ids)
    rows = store(ranged.withColumn(ids, F.monotonically_increasing_id()), name)
    rows = rows.withColumn(task, F.shiftright(ids, 33)).withColumn(place, F.col(ids).bitwiseAND(F.lit(_IN_TASK)))
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(task).agg(F.count("*").alias("__n"))
        .select(task, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    return rows.join(offsets, task).withColumn(rank, F.col("__before") + F.col(place)).drop(ids, task, place, "__before")
