"""Large JSON arrays of objects, read by many tasks.

Spark cuts the file into byte ranges and each range into pieces that end with a brace. Whether a range begins inside a string, and how deep, follows
from the ranges before it: a first pass measures every range both ways, a running sum over the ranges (a row of numbers for each) gives where it begins,
and a second pass cuts out the objects. An object that lies on several ranges is put together from its fragments, of which a range has two at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veinwork.scratch import stage
from veinwork.ship import ship

_TOKEN = re.compile(r'\\.|["{}\[\]]', re.S)
WHOLE, MIDDLE, CLOSE, OPEN = range(4)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, start, value): the text between closing braces, in order within a range. No escape of JSON ends in a brace, so none is cut."""
    got = spark.read.text(path, lineSep="}")
    return got.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = zip(*(batch.column(c).to_pylist() for c in batch.schema.names))
    return groupby(rows, key=lambda r: r[:2])  # a range's rows come one after the other


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: whether it holds an odd number of quotes, and by how much the depth changes if it begins outside or inside a string."""
    key, odd, change = None, False, [0, 0]
    out: list[tuple] = []
    for batch in batches:
        for at, rows in _runs(batch):
            if at != key:
                if key is not None:
                    out.append((*key, odd, *change))
                key, odd, change = at, False, [0, 0]
            for _, _, value in rows:
                for t in _TOKEN.findall(value + "}"):
                    if t == '"':
                        odd = not odd
                    elif len(t) == 1:
                        change[odd] += 1 if t in "{[" else -1
    if key is not None:
        out.append((*key, odd, *change))
    names = ["path", "start", "odd", "outside", "inside"]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=names)


def _cut(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, n, held, begun = None, False, 0, 0, [], False

        def rest() -> list[tuple]:
            return [(*key, n, OPEN if begun else MIDDLE, "".join(held))] if held else []

        def flush(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["path", "start", "n", "kind", "value"])

        for batch in batches:
            out: list[tuple] = []
            for at, rows in _runs(batch):
                for _, _, value, was_inside, was_deep in rows:
                    if at != key:
                        out += rest()
                        key, inside, depth, n, held, begun = at, was_inside, was_deep, 0, [], False
                    text, first = value + "}", 0 if depth > level else None
                    for m in _TOKEN.finditer(text):
                        t = m.group()
                        if t == '"':
                            inside = not inside
                        elif len(t) == 2 or inside:
                            continue
                        elif t in "{[":
                            if t == "{" and depth == level:
                                first, begun = m.start(), True
                            depth += 1
                        else:
                            depth -= 1
                            if t == "}" and depth == level and first is not None:  # the piece's last character
                                held.append(text[first:])
                                out.append((*key, n, WHOLE if begun else CLOSE, "".join(held)))
                                n, held, begun, first = n + begun, [], False, None
                    if first is not None:
                        held.append(text[first:])
            if out:
                yield flush(out)
        if key is not None and held:
            yield flush(rest())

    return run


def read_objects(spark: SparkSession, path: str | list[str], level: int = 1) -> DataFrame:
    """(ord, path, value): the objects at a depth, as text, by their place in the files in order of path: 1 for those of an array, 2 for those of the one array in an object. Several arrays in a file, also one a line, are read as one.
    Other elements (numbers, strings, arrays) aren't read; an object that never ends is left out. An empty file gives no rows."""
    ship(spark)
    pieces = _pieces(spark, path)
    ranges = pieces.mapInArrow(_measured, "path string, start bigint, odd boolean, outside bigint, inside bigint")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    begins = ranges.withColumn("in_string", total(F.col("odd").cast("int")) % 2 == 1)
    begins = begins.withColumn("deep", total(F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))).select("path", "start", "in_string", "deep")
    # A row of numbers for each range of the file: some 100 bytes for 128 MB. The larger side stays in its order, which the cutting needs.
    parts = stage(pieces.join(F.broadcast(begins), ["path", "start"]).mapInArrow(_cut(level), "path string, start bigint, n bigint, kind int, value string"), "objects")
    whole = parts.where(F.col("kind") == WHOLE).select("path", "start", "n", "value")
    fragments = parts.where(F.col("kind") != WHOLE)
    so_far = Window.partitionBy("path").orderBy("start", "kind")  # at most two rows of numbers a range
    owner = F.last(F.when(F.col("kind") == OPEN, F.struct("start", "n")), ignorenulls=True).over(so_far)
    owners = fragments.select("path", "start", "kind", "n").withColumn("owner", owner).drop("n")
    joined = fragments.join(owners, ["path", "start", "kind"]).groupBy("path", "owner").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "value"))).alias("parts"))  # one object's
    joined = joined.where(F.exists("parts", lambda p: p["kind"] == CLOSE) & F.col("owner").isNotNull())
    rows = whole.union(joined.select("path", "owner.start", "owner.n", F.array_join(F.transform("parts", lambda p: p["value"]), "").alias("value")))
    every = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    first = rows.groupBy("path", "start").agg(F.count("*").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(every), F.lit(0)))
    return rows.join(first, ["path", "start"]).select((F.col("_first") + F.col("n")).alias("ord"), "path", "value")
