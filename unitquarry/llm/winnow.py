"""Document fingerprints by winnowing.

Rolling hashes of all grams of ``k`` code points are cut into windows of ``w``
neighbouring grams; the smallest hash of every window is kept with its
position, the rightmost of equal ones.  Texts that share a run of
``w + k - 1`` code points share a mark, and no run under ``k`` gives one.

Null texts count as empty, an empty text has no marks, and a text shorter than
``k`` has one mark, the hash of all of it.  Long texts are hashed in blocks of
``BLOCK`` windows, with the marks that one pass would give.  Ids may be null or
repeat, further columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from unitquarry.llm.common import slices, written

GRAM, WINDOW = 16, 16
BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)

MARKS = "array<struct<hash:bigint,at:bigint>>"
EDITS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double")


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash modulo 2^64 of every run of ``k`` codes, its bits mixed.

    Hashes of runs of twice the length come from two of half the length, so
    all runs take a number of passes that grows with the logarithm of ``k``.
    """
    run, size, base = codes.astype(np.uint64) + np.uint64(1), 1, _BASE
    out, length = None, 0
    while k:
        if k & 1:
            if out is None:
                out = run
            else:
                tail = run[length:]
                out = out[: len(tail)] * np.uint64(base) + tail
            length += size
        k >>= 1
        if k:
            run = run[:-size] * np.uint64(base) + run[size:]
            size, base = 2 * size, base * base & 0xFFFFFFFFFFFFFFFF
    mixed = (out ^ (out >> np.uint64(32))) * _MIX
    return mixed ^ (mixed >> np.uint64(32))


def window_minima(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value of every window of ``w``, the rightmost of equal ones."""
    least, at, size = values, np.arange(len(values)), 1
    while size < w:
        step = min(size, w - size)
        right = least[step:] <= least[:-step]
        least = np.where(right, least[step:], least[:-step])
        at = np.where(right, at[step:], at[:-step])
        size += step
    return at


def marks(text: str, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the marks of a text, in reading order."""
    if not text:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    k = min(k, len(text))
    grams = len(text) - k + 1
    w = min(w, grams)
    found = []
    for start in range(0, grams - w + 1, BLOCK):
        stop = min(start + BLOCK, grams - w + 1)
        codes = np.frombuffer(text[start : stop + w + k - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        hashes = gram_hashes(codes, k)
        at = window_minima(hashes, w)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
        # The first window of a block may repeat the last mark of the one before.
        if found and found[-1][1][-1] == at[0] + start:
            at = at[1:]
        if len(at):
            found.append((hashes[at], at + start))
    return np.concatenate([h for h, _ in found]), np.concatenate([p for _, p in found])


def digest(found: tuple[np.ndarray, np.ndarray]) -> str:
    """One short string for all marks of a text, positions included."""
    return hashlib.sha256(found[0].astype("<u8").tobytes() + found[1].astype("<i8").tobytes()).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct hashes of two texts; 1 if neither has any."""
    a, b = np.unique(a), np.unique(b)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - shared
    return shared / every if every else 1.0


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """``doc_id, marks``: the marks (hash, at) of every text, row by row and without a shuffle."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))
        for batch in slices(batches, 64):
            found = [marks(t or "", k, w) for t in batch.column("text").to_pylist()]
            sizes = np.cumsum([0, *(len(h) for h, _ in found)])
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate([h for h, _ in found]).view(np.int64)), pa.array(np.concatenate([p for _, p in found]))],
                ["hash", "at"])
            listed = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), listed], ["doc_id", "marks"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(per_batch, f"doc_id bigint, marks {MARKS}")


def shared_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a_id, b_id, at_a, at_b``: where marks of ``a`` stand in ``b``.

    Both sides are of ``fingerprints`` with the same ``k`` and ``w``.  Every
    shared run of ``w + k - 1`` code points gives at least one row.
    """
    left = a.select(F.col("doc_id").alias("a_id"), F.inline("marks")).withColumnRenamed("at", "at_a")
    right = b.select(F.col("doc_id").alias("b_id"), F.inline("marks")).withColumnRenamed("at", "at_b")
    return left.join(right, "hash").drop("hash")


def _compare(doc_id: int | None, text: str, found: tuple, after: str, found_after: tuple, k: int, w: int) -> tuple:
    moved = len(text) // 3
    edited = text[: len(text) - moved] + after[:moved]
    found_edited = marks(edited, k, w)
    return (
        doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(found), digest(found_edited),
        likeness(found[0], found_edited[0]), likeness(found[0], found_after[0]))


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGED = pa.schema([*_RESULT, ("_part", pa.int64()), ("_edge", pa.string()), ("_text", pa.string())])


def _packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def compare_edited(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of its code points replaced by the
    first as many of the next document in descending ``doc_id`` (nulls last,
    equal ids by the text's hash and then the text; after the last row comes
    the first).  Texts are dealt by ranges of that order, once; a task reads
    its rows in order and holds two of them.  The row at the end of a range
    meets the first row of the range behind it in a second, small step with
    two rows for each range.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc()]
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").desc())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, out = TaskContext.get().partitionId(), None, []
        nothing = (None,) * (len(_RESULT) - 1)
        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = marks(text, k, w)
                if held is None:
                    out.append((doc_id, *nothing, part, "first", text))
                else:
                    out.append((*_compare(*held, text, found, k, w), None, None, None))
                held = doc_id, text, found
            yield _packed(out, _EDGED)
            out = []
        if held is not None:
            yield _packed([(held[0], *nothing, part, "last", held[1])], _EDGED)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            yield _packed([
                _compare(r["doc_id"], r["_text"], marks(r["_text"], k, w), r["_after"], marks(r["_after"], k, w), k, w)
                for r in batch.to_pylist()], _RESULT)

    done = written(placed.mapInArrow(inside, f"{EDITS}, _part bigint, _edge string, _text string"))
    first = done.filter(F.col("_edge") == "first").select(F.col("_part").alias("_to"), F.col("_text").alias("_after"))
    last = done.filter(F.col("_edge") == "last").select("doc_id", "_part", "_text")
    # One row for each range that has rows.
    every = Window.orderBy("_to")
    follows = first.select("_to").select(
        F.lag("_to").over(every).alias("_before"), "_to", F.max("_to").over(Window.partitionBy()).alias("_end")
    ).select(F.coalesce("_before", "_end").alias("_part"), "_to")
    ends = last.join(follows, "_part").join(first, "_to").select("doc_id", "_text", "_after")
    whole = done.filter(F.col("_edge").isNull()).select(_RESULT.names)
    return whole.unionByName(ends.mapInArrow(across, EDITS))
