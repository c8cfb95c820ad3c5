"""Packing by optimal length buckets.

A global histogram of lengths is built by one aggregate.  Dynamic programming
over it picks the bucket boundaries that minimise all padding.  Inside a
bucket, documents fill batches of a token budget.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from unitquarry.llm.common import words
from unitquarry.runtime import cut

SALT_ROWS = 4096


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], buckets: int) -> tuple[list[int], int]:
    """Boundaries of at most ``buckets`` buckets with the least padding, and that padding.

    ``lengths`` is ascending and without repeats, with the number of documents
    of each.  A bucket pads all its documents to its largest length.  With one
    bucket more, the least cost up to a length is the lowest of lines, one for
    each end of the bucket before, at that length: slopes fall and lengths
    rise, so a pass over the lengths finds it.  All numbers are exact.
    """
    n = len(lengths)
    if not n:
        return [], 0
    docs, tokens = [0], 0
    for length, count in zip(lengths, counts, strict=True):
        docs.append(docs[-1] + count)
        tokens += length * count
    best = [length * held for length, held in zip(lengths, docs[1:])]
    cuts = []
    for _ in range(min(buckets, n) - 1):
        fresh, start = list(best), [-1] * n
        # Lines (slope, value at 0, end before) that are the lowest somewhere, from the first one on that can still be.
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(1, n):
            slope, value = -docs[j], best[j - 1]
            while len(hull) - at > 1:
                (s1, v1, _), (s2, v2, _) = hull[-2], hull[-1]
                if (value - v1) * (s1 - s2) > (v2 - v1) * (s1 - slope):
                    break
                hull.pop()
            hull.append((slope, value, j - 1))
            x = lengths[j]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                at += 1
            cost = hull[at][0] * x + hull[at][1] + x * docs[j + 1]
            if cost < best[j]:
                fresh[j], start[j] = cost, hull[at][2]
        cuts.append(start)
        best = fresh
    ends, j = [n - 1], n - 1
    for start in reversed(cuts):
        # Without a start of its own, the same cost is reached with a bucket less.
        if start[j] >= 0:
            j = start[j]
            ends.append(j)
    return [lengths[e] for e in reversed(ends)], best[n - 1] - tokens


def pack_by_length(docs: DataFrame, buckets: int = 16, budget: int = 16_384) -> DataFrame:
    """Bucket, padded length, batch and slot of every row of ``docs`` (doc_id, n_tokens).

    A batch of a bucket holds ``budget // padded_length`` documents, at least
    one: a document above the budget is a batch of its own bucket's size.
    Null lengths count as 0; ids may be null or repeat (each row gets its own
    slot); an empty table gives no rows; further columns are ignored.  The
    batches of a bucket are numbered from 0, and only its last one may be short.
    The driver gets one row per distinct length: at most the root of twice the
    sum of all lengths.
    """
    rows = cut(docs.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    histogram = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow().sort_by("n_tokens")
    lengths, counts = histogram.column("n_tokens").to_numpy(), histogram.column("n").to_numpy()
    ends = optimal_boundaries(lengths.tolist(), counts.tolist(), buckets)[0] or [0]
    inside = np.bincount(np.searchsorted(ends, lengths), weights=counts, minlength=len(ends))
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends])
    room = F.array(*[F.lit(max(1, budget // max(e, 1))).cast("bigint") for e in ends])
    salts = F.array(*[F.lit(int(-(-n // SALT_ROWS)) or 1).cast("bigint") for n in inside])
    placed = (
        rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens"))))
        .withColumn("padded_length", F.get(bounds, F.col("bucket")))
        .withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.get(salts, F.col("bucket")))))
    # Salts are drawn from the numbers of the stored rows, so equal rows are spread like others.
    # Positions in a bucket: position within a salted part, after the parts before it.
    inner = F.row_number().over(Window.partitionBy("bucket", "_salt").orderBy("doc_id", "n_tokens")) - 1
    parts = placed.groupBy("bucket", "_salt").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(
        Window.partitionBy("bucket").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("bucket", "_salt", F.coalesce(before, F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_at")
    return (
        placed.withColumn("_at", inner).join(offsets, ["bucket", "_salt"])
        .withColumn("_room", F.get(room, F.col("bucket")))
        .select("doc_id", "n_tokens", "bucket", "padded_length",
                F.floor(position / F.col("_room")).cast("bigint").alias("batch"),
                F.pmod(position, F.col("_room")).cast("int").alias("slot")))


def pack_documents(docs: DataFrame, buckets: int = 16, budget: int = 16_384) -> DataFrame:
    """``pack_by_length`` over the words of ``text`` (null: none)."""
    return pack_by_length(docs.select("doc_id", words(F.col("text")).alias("n_tokens")), buckets, budget)
