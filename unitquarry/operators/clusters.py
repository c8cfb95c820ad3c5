"""Exact vector search that skips clusters of units.

Units are stored with the nearest of a few centres; a cluster knows its
centre and the distance of its farthest unit.  By the triangle inequality no
unit of a cluster has a larger product with a query than the centre's product
plus the radius times the query's length, so a cluster whose bound stays below
a query's ``k``-th score is not looked at for that query.  What is looked at is
scored as in ``search``, element by element, so ranks and ties are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import runtime
from .search import MIN_SCORE, SCORE_CELLS, _RANKED, _best, _matrix, _Ranker, check_k, query_blocks

# Centres: bounded, and small against the units of a large index.
CENTRES = 256

# Room for rounding in a bound.
SLACK = 1e-9


class Clusters(NamedTuple):
    """``rows``: id, embedding, cluster.  ``table``: cluster, centre, radius, units; one row per cluster."""

    rows: DataFrame
    table: DataFrame


def cluster_units(units: DataFrame, path: str | None = None, centres: int = CENTRES) -> Clusters:
    """Assign every unit with a vector to the nearest of ``centres`` units, drawn by a hash of their id.

    With a ``path`` the rows are written there in one folder per cluster, so
    that a search reads only the clusters that it looks at; without one they
    are checkpointed.
    """
    rows = units.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(centres).toPandas()
    middle = _matrix(drawn["embedding"]) if len(drawn) else np.zeros((0, 1))
    norms = (middle**2).sum(axis=1)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch["embedding"])
            if vectors.shape[1] != middle.shape[1]:
                raise ValueError(f"vectors of different lengths: {vectors.shape[1]} and {middle.shape[1]}")
            nearest = np.argmin(norms - 2 * vectors @ middle.T, axis=1)
            apart = np.sqrt(((vectors - middle[nearest]) ** 2).sum(axis=1))
            yield batch.assign(cluster=nearest.astype(np.int32), apart=apart)

    made = rows.mapInPandas(assign, "id bigint, embedding array<float>, cluster int, apart double")
    if path is None:
        made = runtime.cut(made)
    else:
        made.write.partitionBy("cluster").parquet(path)
        made = units.sparkSession.read.schema(made.schema).parquet(path)
    # A vector that is not finite bounds nothing: its cluster is always looked at.
    radius = F.max(F.when(F.isnan("apart"), float("inf")).otherwise(F.col("apart")))
    known = made.groupBy("cluster").agg(radius.alias("radius"), F.count("*").alias("units"))
    places = units.sparkSession.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(middle)], "cluster int, centre array<double>")
    return Clusters(made.select("id", "embedding", "cluster"), runtime.cut(known.join(F.broadcast(places), "cluster")))


def bounds(vectors: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bound of the products of every query with the units of every cluster."""
    with np.errstate(invalid="ignore"):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        above = vectors @ centres.T + lengths[:, None] * radii[None, :]
    above = above + SLACK * (1 + np.abs(above))
    return np.where(np.isnan(above), np.inf, above)


def _scan(rows: DataFrame, open_: np.ndarray, numbers: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame | None:
    """Best ``k`` per query and task among the (query, cluster) pairs of ``open_``; None if there are none."""
    looked = {int(numbers[c]): np.flatnonzero(open_[:, c]) for c in np.flatnonzero(open_.any(axis=0))}
    if not looked:
        return None

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranker = _Ranker(k, ids, vectors, False)
        for batch in batches:
            for cluster, part in batch.groupby("cluster"):
                only = looked[int(cluster)]
                step = max(1, SCORE_CELLS // len(only))
                for start in range(0, len(part), step):
                    piece = part.iloc[start:start + step]
                    ranker.add(piece["id"].to_numpy(), _matrix(piece["embedding"]), np.ones(len(piece), bool), None, only)
        yield ranker.frame()

    return rows.filter(F.col("cluster").isin(list(looked))).mapInPandas(rank, _RANKED)


def clustered_search(clusters: Clusters, queries: DataFrame, k: int = 5) -> DataFrame:
    """What ``semantic_search`` gives, from clusters: top ``k`` units per query, score over 0.1.

    Queries go out in blocks of a bounded size, one after the other; unit rows
    are never copied.  For each block the cluster with the nearest centre is
    scored first, then all whose bound reaches the score that a query has by
    then.
    """
    check_k(k)
    asked = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    spark = queries.sparkSession
    found = spark.createDataFrame([], _RANKED)
    table = clusters.table.toPandas()
    if k and len(table):
        numbers, centres = table["cluster"].to_numpy(), _matrix(table["centre"])
        for ids, vectors, alone in query_blocks(asked):
            above = bounds(vectors, centres, table["radius"].to_numpy())
            nearest = np.zeros(above.shape, bool)
            nearest[np.arange(len(ids)), np.argmax(np.nan_to_num(vectors @ centres.T, nan=-np.inf), axis=1)] = True
            first = _scan(clusters.rows, nearest & (above > MIN_SCORE), numbers, ids, vectors, k)
            if first is not None:
                first = runtime.cut(_best(first, k).select("query_id", "id", "score"))
                found = found.unionByName(first)
            least = least_scores(first, ids, k)
            rest = _scan(clusters.rows, (above >= least[:, None]) & ~nearest, numbers, ids, vectors, k)
            if rest is not None:
                # Settled block by block, so the driver holds one block of queries.
                found = found.unionByName(rest if alone else runtime.cut(rest))
    return _best(found, k)


def least_scores(found: DataFrame | None, ids: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th score of every query so far; the smallest that counts where there are fewer."""
    least = np.full(len(ids), np.nextafter(MIN_SCORE, 1))
    if found is not None:
        full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("s")).filter(F.col("n") >= k).toPandas()
        least[np.searchsorted(ids, full["query_id"].to_numpy(np.int64))] = full["s"].to_numpy()
    return least
