"""Approximate nearest neighbours by collision-counting hashing.

Every block of vectors keeps one sorted array for each of ``PROJECTIONS``
random directions.  A query opens a window around its own projection in every
array and counts how often each vector falls inside.  Vectors that collide in
enough arrays are verified by their exact distance.  Then the windows grow to
the next radius (virtual rehashing: nothing is hashed anew, only the new ends
of the windows are counted) until the k-th best distance is within the radius:
from there on a nearer vector would have collided often enough, but for the
chance that the threshold allows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from unitquarry.llm.common import written
from unitquarry.llm.vectors import by_length, usable
from unitquarry.runtime import checkpoint_ready, top_k

PROJECTIONS = 64
# A window at radius R reaches WIDTH * R to both sides.
WIDTH = 1.0
GROWTH = 1.2
# Chance that a vector within the radius collides too seldom to be verified.
MISSED = 0.02
BLOCK_ROWS = 8192
# Queries that travel to the tasks at a time: at most 64 MB.
QUERY_BYTES = 64 << 20
SEED = 42


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, missed: float = MISSED) -> int:
    """Most collisions that a vector at the radius reaches with a chance of at least 1 - ``missed``."""
    p = math.erf(width / math.sqrt(2))
    tail = 0.0
    for hits in range(projections + 1):
        tail += math.comb(projections, hits) * p**hits * (1 - p) ** (projections - hits)
        if tail > missed:
            return hits
    return projections


def directions(d: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED + d).normal(size=(d, projections))


class Best:
    """The k nearest of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * queries
        self.far: list[np.ndarray] = [np.zeros(0)] * queries

    def add(self, q: int, ids: np.ndarray, far: np.ndarray) -> None:
        ids, far = np.concatenate([self.ids[q], ids]), np.concatenate([self.far[q], far])
        first = np.lexsort((ids, far))[: self.k]
        self.ids[q], self.far[q] = ids[first], far[first]

    def kth(self, q: int) -> float:
        return self.far[q][-1] if len(self.far[q]) == self.k else math.inf


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: Best, which: np.ndarray) -> None:
    """Look for all queries in one block of vectors; ``which`` are the queries' numbers in ``best``."""
    axes = directions(vectors.shape[1])
    placed, asked = vectors @ axes, queries @ axes
    order = np.argsort(placed, axis=0, kind="stable")
    arrays = np.ascontiguousarray(np.take_along_axis(placed, order, axis=0).T)
    order = np.ascontiguousarray(order.T)
    n, need = len(ids), threshold()
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    # Radius 0 finds copies; the last one covers every vector.
    most = norms.max() + np.sqrt(np.einsum("ij,ij->i", queries, queries)).max()
    radii, r = [0.0], float(np.median(norms)) / 4
    while r < most:
        radii.append(r)
        r *= GROWTH
    slack = 1e-9 * most * math.sqrt(vectors.shape[1])
    halves = [WIDTH * x + slack for x in radii]
    edges = np.empty((len(radii), 2, PROJECTIONS, len(queries)), dtype=np.int64)
    for j in range(PROJECTIONS):
        for i, half in enumerate(halves):
            edges[i, 0, j] = np.searchsorted(arrays[j], asked[:, j] - half, side="left")
            edges[i, 1, j] = np.searchsorted(arrays[j], asked[:, j] + half, side="right")
    for q in range(len(queries)):
        own = edges[:, :, :, q].tolist()
        low, high = [None] * PROJECTIONS, [None] * PROJECTIONS
        hits, verified = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        for (lows, highs), radius in zip(own, radii, strict=True):
            parts = []
            for j in range(PROJECTIONS):
                a, b = lows[j], highs[j]
                if low[j] is None:
                    if b > a:
                        parts.append(order[j, a:b])
                else:
                    if a < low[j]:
                        parts.append(order[j, a : low[j]])
                    if b > high[j]:
                        parts.append(order[j, high[j] : b])
                low[j], high[j] = a, b
            if parts:
                hits += np.bincount(np.concatenate(parts), minlength=n)
            fresh = np.flatnonzero((hits >= need) & ~verified)
            if len(fresh):
                verified[fresh] = True
                fresh = fresh[ids[fresh] != query_ids[q]]
                gap = vectors[fresh] - queries[q]
                best.add(which[q], ids[fresh], np.sqrt(np.einsum("ij,ij->i", gap, gap)))
            if best.kth(which[q]) <= radius:
                break
        else:
            rest = np.flatnonzero(~verified & (ids != query_ids[q]))
            gap = vectors[rest] - queries[q]
            best.add(which[q], ids[rest], np.sqrt(np.einsum("ij,ij->i", gap, gap)))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of ``vectors`` of every row of ``queries`` (both vec_id, embedding).

    Rows with the query's own vec_id are no candidates.  Vectors that are
    null, empty, zero or hold null or non-finite components take no part, nor
    do those without an id; vectors of different lengths do not meet.  A query
    that repeats with the same vector counts once, candidates that repeat count
    each; equal distances go to the smaller vec_id.  With fewer candidates
    than k all are returned; an empty table gives no rows.  Queries go to the
    rows in blocks of bounded bytes, one pass over the rows for each block.
    """
    spark = vectors.sparkSession

    def plain(df: DataFrame) -> DataFrame:
        fine = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
        return df.filter(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))

    rows = plain(vectors)
    asked = written(plain(queries).distinct().withColumn("_digest", F.xxhash64("vec_id", "embedding")))
    size = asked.agg(F.sum(F.size("embedding") * 8 + 32)).first()[0] or 0
    blocks = max(1, -(-2 * size // QUERY_BYTES))
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/nearest-{uuid.uuid4().hex}"
    schema = "query_id bigint, _digest bigint, vec_id bigint, score double"
    for number in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("_digest"), F.lit(blocks)) == number).orderBy("vec_id", "_digest").toArrow().combine_chunks()
        column = part.column("embedding").chunk(0) if part.num_rows else pa.array([], pa.list_(pa.float64()))
        sent = spark.sparkContext.broadcast((part.column("vec_id").to_numpy(), part.column("_digest").to_numpy(), by_length(column)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            query_ids, digests, wanted = sent.value
            best = Best(len(query_ids), k)
            for batch in batches:
                for d, (at, found) in by_length(batch.column(1)).items():
                    if d in wanted:
                        which, asked_vectors = wanted[d]
                        ids = batch.column(0).to_numpy()[at]
                        for i in range(0, len(ids), BLOCK_ROWS):
                            search_block(ids[i : i + BLOCK_ROWS], found[i : i + BLOCK_ROWS], query_ids[which], asked_vectors, best, which)
            count = np.fromiter(map(len, best.ids), dtype=np.int64, count=len(best.ids))
            if count.sum():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(query_ids, count)), pa.array(np.repeat(digests, count)), pa.array(np.concatenate(best.ids)),
                     pa.array(np.concatenate(best.far))], ["query_id", "_digest", "vec_id", "score"])

        found = rows.mapInArrow(run, schema).withColumn("_query", F.struct("query_id", "_digest"))
        top_k(found, "_query", [F.col("score"), F.col("vec_id")], k).select(
            "query_id", F.col("pos").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(folder)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score double").parquet(folder)
