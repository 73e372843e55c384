"""Elements of the top-level arrays of large JSON documents, read by many tasks.

A COCO document is one object with a few long arrays, often on one line and too large for one row.
Spark's text reader cuts files into blocks and blocks into records at every closing brace, in a stream
and at any size. A first pass takes from each block how it changes the state of a JSON reader, once as if it began inside a
string and once outside. The few states of a file's blocks are run through in order, which tells each block
how it really begins. A second pass then emits every element of an array as a row of its own, and
the pieces of an element that lies over blocks are put together. Elements are parsed once, as rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from defectspark.session import stored

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|["{}\[\]]', re.DOTALL)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
_OUT_ROWS = 2000


@dataclass
class Reader:
    """Where a reader stands: inside a string or not, how deep, in which array, and what it has of an open element.

    ``section`` is the key of the array at depth 2, empty outside such arrays, and null where the
    array began in an earlier block.
    """

    in_string: bool = False
    depth: int = 0
    section: str | None = ""
    is_open: bool = False
    open_text: list[str] = field(default_factory=list)

    def feed(self, record: str) -> Iterator[tuple[str | None, str]]:
        """(section, text) of the elements that end in the record."""
        at = 0
        if self.in_string:
            end = _REST_OF_STRING.match(record)
            if end is None:
                self.open_text += [record] if self.is_open else []
                return
            self.in_string, at = False, end.end()
        begin, key = 0, None
        for token in _TOKEN.finditer(record, at):
            mark = token.group()
            if mark == '"':  # the record ends inside a string
                self.in_string = True
                break
            if mark[0] == '"':
                key = mark[1:-1]
            elif mark in "{[":
                if self.depth == 1:
                    self.section = key if mark == "[" and key is not None else ""
                elif self.depth == 2 and mark == "{":
                    self.is_open, begin, self.open_text = True, token.start(), []
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == 2 and self.is_open:
                    self.is_open = False
                    if mark == "}":
                        yield self.section, "".join([*self.open_text, record[begin:token.end()]])
                elif self.depth == 1:
                    self.section = ""
        if self.is_open:
            self.open_text.append(record[begin:])


def _records(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(``path``, ``block``, ``record``): texts up to a closing brace, in order within a block."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("lineSep", "}")
    return reader.text(root).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("record")
    )


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Runs of records of one block of one file, over batches."""
    rows = ((p, b, r) for batch in batches for p, b, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()))
    row = next(rows, None)
    while row is not None:
        path, block = row[:2]

        def run() -> Iterator[str]:
            nonlocal row
            while row is not None and row[:2] == (path, block):
                yield row[2]
                row = next(rows, None)

        yield path, block, run()


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and beginning (outside or inside a string): the state at its end, with depths relative to its beginning."""
    for path, block, records in _by_block(batches):
        ends = [False, True]
        depth = [0, 0]
        for record in records:
            record += "}"
            for begin in (0, 1):
                at = 0
                if ends[begin]:
                    end = _REST_OF_STRING.match(record)
                    if end is None:
                        continue
                    ends[begin], at = False, end.end()
                for token in _TOKEN.finditer(record, at):
                    mark = token.group()
                    if mark == '"':
                        ends[begin] = True
                        break
                    depth[begin] += (mark in "{[") - (mark in "}]")
        yield pa.RecordBatch.from_pydict({
            "path": [path], "block": pa.array([block], pa.int64()), "ends": [ends], "depth": pa.array([depth], pa.list_(pa.int64())),
        })


def _beginnings(blocks: pd.DataFrame) -> pd.DataFrame:
    """How each block of one file begins: inside a string, and how deep."""
    in_string, depth, out = False, 0, []
    for b in blocks.sort_values("block").itertuples(index=False):
        out.append((b.path, b.block, in_string, depth))
        depth += int(b.depth[int(in_string)])
        in_string = bool(b.ends[int(in_string)])
    return pd.DataFrame(out, columns=["path", "block", "in_string", "at_depth"])


def read_elements(spark: SparkSession, root: str, glob: str = "*.json") -> DataFrame:
    """(``path``, ``section``, ``element``): the objects in the arrays that a document's top object holds, as JSON text, in no order.

    ``section`` is the array's key. Files of any size are shared by all tasks that their blocks give.
    """
    effects = _records(spark, root, glob).mapInArrow(_effects, "path string, block long, ends array<boolean>, depth array<long>")
    begins = effects.groupBy("path").applyInPandas(_beginnings, "path string, block long, in_string boolean, at_depth long")
    # One row per block of 128 MB: a file of a terabyte has some 8,000.
    starts = {(r.path, r.block): (r.in_string, r.at_depth) for r in begins.where("block > 0").collect()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()])]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["path", "block", "kind", "section", "element"])

        for path, block, records in _by_block(batches):
            in_string, depth = starts.get((path, block), (False, 0))
            reader = Reader(in_string, depth, None if depth > 1 else "", depth > 2)
            continued = depth > 2
            for record in records:
                for section, text in reader.feed(record + "}"):
                    held.append((path, block, "1 head" if continued else "whole", section, text))
                    continued = False
                    if len(held) >= _OUT_ROWS:
                        yield out()
                continued = continued and reader.is_open
            held.append((path, block, "section", reader.section, None))
            if reader.is_open:
                held.append((path, block, "2 through" if continued else "3 tail", reader.section, "".join(reader.open_text)))
            yield out()

    found = stored(_records(spark, root, glob).mapInArrow(emit, "path string, block long, kind string, section string, element string"), "json-elements")
    # The array that a block begins in is the one that the blocks before it ended in.
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    arrays = found.where("kind = 'section'").select("path", "block", F.last("section", ignorenulls=True).over(before).alias("__array"))
    named = found.where("kind <> 'section'").join(arrays, ["path", "block"]).withColumn("section", F.coalesce("section", "__array")).drop("__array")
    # Pieces of one element: a tail, whole blocks perhaps, and a head.
    so_far = Window.partitionBy("path").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    pieces = named.where("kind <> 'whole'").withColumn("no", F.count_if(F.col("kind") == "3 tail").over(so_far))
    joined = pieces.groupBy("path", "no").agg(
        F.max(F.when(F.col("kind") == "3 tail", F.col("section"))).alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "element"))), lambda p: p["element"]), "").alias("element"),
        F.count_if(F.col("kind") == "1 head").alias("heads"),
    ).where("heads > 0")
    whole = named.where("kind = 'whole'").select("path", "section", "element")
    return whole.unionByName(joined.select("path", "section", "element")).where("section <> ''")
