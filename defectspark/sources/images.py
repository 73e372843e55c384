"""Decoded images: properties for the audit and run-length masks for everything else."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RUN = T.StructType().add("y", T.IntegerType()).add("x0", T.IntegerType()).add("x1", T.IntegerType())
# OpenCV type codes of decoded images and their usual names.
MODES = {0: "L", 16: "RGB", 24: "RGBA"}


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """``path, height, width, channels, mode, data``; undecodable files keep ``mode = -1``."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return images.select(
        F.col("image.origin").alias("path"), "image.height", "image.width",
        F.col("image.nChannels").alias("channels"), F.col("image.mode").alias("mode"), "image.data",
    )


def probe_images(images: DataFrame) -> DataFrame:
    """Readable flag, size and mode name per image."""
    names = F.create_map(*[F.lit(v) for pair in MODES.items() for v in pair])
    readable = F.col("mode") >= 0
    return images.select(
        "path", readable.alias("readable"), F.when(readable, F.col("width")).alias("width"),
        F.when(readable, F.col("height")).alias("height"),
        F.when(readable, F.coalesce(F.try_element_at(names, F.col("mode")), F.lit("other"))).alias("mode"),
    )


def _decoded(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    blue, green, red = (pixels[:, :, k].astype(np.int64) for k in range(3))
    # Integer luminance weights of the ITU-R 601 grey conversion.
    return ((red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16).astype(np.uint8)


def _runs_of(grey: np.ndarray, adaptive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cut = 0 if adaptive and grey.size and grey.max() <= 1 else 127
    padded = np.zeros((grey.shape[0], grey.shape[1] + 2), np.int8)
    padded[:, 1:-1] = grey > cut
    step = np.diff(padded, axis=1)
    y, x0 = np.nonzero(step == 1)
    return y, x0, np.nonzero(step == -1)[1] - 1


def _binarise(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array, adaptive: bool) -> pa.Array:
    columns, counts = ([], [], []), [0]
    for raw, h, w, c in zip(data, height.to_pylist(), width.to_pylist(), channels.to_pylist()):
        found = 0
        if c and c > 0:
            runs = _runs_of(_decoded(raw.as_py(), h, w, c), adaptive)
            found = runs[0].size
            for column, values in zip(columns, runs):
                column.append(values.astype(np.int32))
        counts.append(found)
    flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int32), pa.int32()) for c in columns]
    return pa.ListArray.from_arrays(
        pa.array(np.cumsum(counts).astype(np.int32)), pa.StructArray.from_arrays(flat, ["y", "x0", "x1"])
    )


@F.arrow_udf(T.ArrayType(_RUN))
def _hard(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    return _binarise(data, height, width, channels, False)


@F.arrow_udf(T.ArrayType(_RUN))
def _adaptive(data: pa.Array, height: pa.Array, width: pa.Array, channels: pa.Array) -> pa.Array:
    return _binarise(data, height, width, channels, True)


def mask_rows(images: DataFrame, rule: str = "hard", key: Column | None = None) -> DataFrame:
    """Mask rows of decoded images; each raster becomes runs in the task that decoded it.

    ``hard`` keeps values above 127. ``adaptive`` keeps any positive value when no pixel
    exceeds 1. Colour images turn grey first; see ``colour_masks`` for the strict check.
    """
    if rule not in ("hard", "adaptive"):
        raise ValueError("rule must be 'hard' or 'adaptive'")
    # Marked so that a filter inferred from a later ``inline`` does not decode twice.
    to_runs = (_hard if rule == "hard" else _adaptive).asNondeterministic()
    return images.where("mode >= 0").select(
        (F.col("path") if key is None else key).alias("image_id"), "height", "width",
        to_runs("data", "height", "width", "channels").alias("runs"),
    )


def colour_masks(images: DataFrame) -> DataFrame:
    """Masks that are not single-channel: violations of the grounding contract."""
    return images.where((F.col("mode") >= 0) & (F.col("channels") != 1)).select("path", "channels")
