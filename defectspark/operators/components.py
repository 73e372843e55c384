"""Largest 8-connected component of run-length masks, labelled a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

_CENTROID = pa.struct([("cx", pa.float64()), ("cy", pa.float64()), ("size", pa.int64())])


def _touching(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, stride: int):
    """Index pairs of runs that touch, with rows as consecutive ``line`` numbers."""
    # Shifting x by one leaves room for the left neighbour of column zero.
    ends, starts = line * stride + x1 + 1, line * stride + x0 + 1
    low = np.searchsorted(ends, (line - 1) * stride + x0)
    high = np.searchsorted(starts, (line - 1) * stride + x1 + 2, side="right")
    count = np.maximum(high - low, 0)
    here = np.repeat(np.arange(line.size), count)
    skip = np.repeat(np.cumsum(count) - count, count)
    above = np.arange(count.sum()) - skip + np.repeat(low, count)
    beside = np.flatnonzero((line[1:] == line[:-1]) & (x0[1:] <= x1[:-1] + 1)) + 1
    return np.concatenate([here, beside]), np.concatenate([above, beside - 1])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each node, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_edges = ra != rb
        if not open_edges.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_edges], np.minimum(ra, rb)[open_edges])
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped


_CENTROID_TYPE = (
    T.StructType().add("cx", T.DoubleType()).add("cy", T.DoubleType()).add("size", T.LongType())
)


@arrow_udf(_CENTROID_TYPE)
def _largest(runs: pa.Array) -> pa.Array:
    lengths = runs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = runs.flatten()
    if len(flat) == 0:
        return pa.array([None] * len(runs), _CENTROID)
    y, x0, x1 = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("y", "x0", "x1"))
    row = np.repeat(np.arange(len(runs)), lengths)
    line = row * (int(y.max()) + 2) + y
    order = np.lexsort((x0, line))
    y, x0, x1, row, line = y[order], x0[order], x1[order], row[order], line[order]
    root = _roots(y.size, *_touching(line, x0, x1, int(x1.max()) + 4))

    width = x1 - x0 + 1
    size = np.bincount(root, width, y.size)
    sum_x = np.bincount(root, (x0 + x1) * width / 2.0, y.size)
    sum_y = np.bincount(root, (y * width).astype(float), y.size)
    top = np.unique(root)
    # Largest first; on equal size the component met first in reading order.
    ranked = top[np.lexsort((top, -size[top], row[top]))]
    images, first = np.unique(row[ranked], return_index=True)
    best = ranked[first]
    cx, cy, area = (np.zeros(len(runs)) for _ in range(3))
    cx[images], cy[images], area[images] = sum_x[best] / size[best], sum_y[best] / size[best], size[best]
    empty = lengths == 0
    return pa.StructArray.from_arrays(
        [pa.array(cx), pa.array(cy), pa.array(area.astype(np.int64))],
        fields=list(_CENTROID), mask=pa.array(empty),
    )


def largest_component(runs: Column) -> Column:
    """Struct ``(cx, cy, size)`` of the largest component; null for an empty mask.

    ``runs`` is the run array of one image, so the work is bounded by one raster and
    needs no shuffle when masks are stored one row per image.
    """
    return _largest(runs)
