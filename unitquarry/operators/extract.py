"""Functions and call sites of JavaScript and TypeScript text, by lexical segmentation.

There is no compiler here.  Each file is read once by the linear pass in
``lexer``, where Spark put it: nothing is shuffled, and a file leaves one row
with its functions and calls.

Differences from a compiler, on purpose: lengths and offsets count code points;
the head of a method is never taken for a call; a function that its file does
not close ends with the file.  Files whose brackets do not close are still read
and are listed by ``rejected_sources``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .lexer import Outline, line_of, line_starts

# Texts that are cut into lines at a time.
SEGMENT_ROWS = 256

_FUNCTION = pa.struct([
    ("name", pa.string()), ("kind", pa.string()), ("class_name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()),
    ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("code", pa.string())])
_CALL = pa.struct([("name", pa.string()), ("receiver", pa.string()), ("at", pa.int32())])
_OUTLINE = """path string,
functions array<struct<name: string, kind: string, class_name: string, start_line: int, end_line: int, start_offset: int, end_offset: int, code: string>>,
calls array<struct<name: string, receiver: string, at: int>>, open_brackets int, lowest int"""


def outlines(sources: DataFrame) -> DataFrame:
    """``path, functions, calls, open_brackets, lowest``: one row per ``path, content`` row, read once.

    Elements of JSX are looked for in all files but those called ``.ts``,
    ``.mts`` or ``.cts``, where an angle after an operator is a type.
    """

    def outline(path: str | None, text: str) -> dict:
        read = Outline(text, not (path or "").endswith((".ts", ".mts", ".cts")))
        starts = line_starts(text)
        functions = [
            {"name": f.name, "kind": f.kind, "class_name": f.owner, "start_line": line_of(starts, f.start),
             "end_line": line_of(starts, max(f.start, f.end - 1)), "start_offset": f.start, "end_offset": f.end, "code": text[f.start:f.end]}
            for f in read.functions]
        calls = [{"name": name, "receiver": receiver, "at": at} for name, receiver, at in read.calls]
        return {"functions": functions, "calls": calls, "open": read.r.level, "lowest": read.r.lowest}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [outline(p, t or "") for p, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([f["functions"] for f in found], pa.list_(_FUNCTION)), pa.array([f["calls"] for f in found], pa.list_(_CALL)),
                     pa.array([f["open"] for f in found], pa.int32()), pa.array([f["lowest"] for f in found], pa.int32())],
                    ["path", "functions", "calls", "open_brackets", "lowest"])

    return sources.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, _OUTLINE)


def extract_functions(sources: DataFrame) -> DataFrame:
    """One row per function with a body in every ``path, content`` row.

    ``file_path, name, kind, class_name, start_line, end_line, start_offset,
    end_offset, code``: kind is function, arrow or method; ``code`` is exactly
    ``content[start_offset:end_offset]`` and starts at the first decorator or
    modifier.  Nested functions are rows of their own.
    """
    return outlines(sources).select(F.col("path").alias("file_path"), F.inline("functions"))


def _first_sites(calls: DataFrame, *keys: str) -> DataFrame:
    return calls.groupBy(*keys, "name", "receiver").agg(F.min("at").alias("at"))


def extract_calls(sources: DataFrame) -> DataFrame:
    """``path, name, receiver, at``: distinct calls per ``path, content`` row, first position kept.

    The receiver is ``this`` or the single name left of the dot; a longer
    chain, ``super`` or a call result gives none.
    """
    return _first_sites(outlines(sources).select("path", F.inline("calls")), "path")


class Extracted(NamedTuple):
    units: DataFrame
    calls: DataFrame


def unit_calls(units: DataFrame, key: str = "id") -> DataFrame:
    """``caller_id, name, receiver, at``: the calls in the code of every unit, nested functions included."""
    snippets = units.select(F.col(key).cast("string").alias("path"), F.col("code").alias("content"))
    return extract_calls(snippets).select(
        F.col("path").cast(units.schema[key].dataType).alias("caller_id"), "name", "receiver", "at")


def extract_units_and_calls(sources: DataFrame) -> Extracted:
    """Functions of every file, and their calls keyed by file and start offset; a call counts for all functions around it."""
    read = outlines(sources)
    inside = F.filter("calls", lambda c: (c["at"] >= F.col("f.start_offset")) & (c["at"] < F.col("f.end_offset")))
    calls = read.select("path", "calls", F.explode("functions").alias("f")).select(
        F.col("path").alias("file_path"), F.col("f.start_offset").alias("start_offset"), F.inline(inside))
    located = calls.withColumn("at", F.col("at") - F.col("start_offset"))
    return Extracted(read.select(F.col("path").alias("file_path"), F.inline("functions")), _first_sites(located, "file_path", "start_offset"))


def rejected_sources(sources: DataFrame) -> DataFrame:
    """``path, open_brackets, lowest``: files whose brackets do not close, or close too early."""
    return outlines(sources).select("path", "open_brackets", "lowest").filter("open_brackets <> 0 OR lowest < 0")


def segment_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line, start_offset, end_offset, code``: the lines of a text with their exact ranges.

    Offsets are running sums over the lines of one row, so nothing is shuffled.
    A null text has no lines, an empty one has one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT_ROWS):
                keys, texts = batch.slice(at, SEGMENT_ROWS).columns
                lines = pc.split_pattern(texts, "\n")
                count = pc.list_value_length(lines).fill_null(0).to_numpy(zero_copy_only=False)
                code = lines.flatten()
                of = np.repeat(np.arange(len(texts)), count)
                first = np.cumsum(count) - count
                size = pc.utf8_length(code).to_numpy().astype(np.int64)
                start = np.cumsum(size + 1) - (size + 1)
                start -= start[first[of]]
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(of)), pa.array((np.arange(len(of)) - first[of] + 1).astype(np.int32)),
                    pa.array(start.astype(np.int32)), pa.array((start + size).astype(np.int32)), code], ["key", "line", "start_offset", "end_offset", "code"])

    kind = T.StructType([
        T.StructField("key", df.schema[key].dataType), T.StructField("line", T.IntegerType()), T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()), T.StructField("code", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, kind).withColumnRenamed("key", key)
