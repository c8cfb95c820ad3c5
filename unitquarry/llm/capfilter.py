"""Embedding near-duplicates by spherical-cap filters.

Filter directions come from a structured random product code: the space is
cut into blocks, each block has its own random code, and a direction is one
codeword per block.  List decoding finds all directions whose inner product
with a vector exceeds the height of the cap without trying them all.  Vectors
with a high cosine fall into many common caps: they are joined on label and
filter, and every pair that meets is verified by its cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from unitquarry.llm.common import attach, written
from unitquarry.llm.graph import components
from unitquarry.llm.vectors import by_length, usable
from unitquarry.runtime import cut

# Caps that a vector falls into on average, and at least: below that its cap is lowered.
CAPS, LEAST_CAPS = 64, 40
# Vectors that a cap holds on average.
HELD = 2.0
BLOCKS = 3
SEED = 7


class Caps:
    """Filter directions for vectors of length ``d``, as many as keep ``HELD`` of ``count`` vectors in each."""

    def __init__(self, d: int, count: int) -> None:
        self.blocks = min(BLOCKS, d)
        size = max(4, int(np.ceil((max(count, 64) * CAPS / HELD) ** (1 / self.blocks))))
        draw = np.random.default_rng(SEED + d)
        self.cuts = np.linspace(0, d, self.blocks + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts, self.cuts[1:], strict=False):
            code = draw.normal(size=(size, b - a))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) * np.sqrt((b - a) / d))
        self.size = size
        self.height = NormalDist().inv_cdf(1 - min(0.4, CAPS / size**self.blocks)) / np.sqrt(d)

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of every cap that holds one of the unit ``vectors``."""
        products = [vectors[:, a:b] @ c.T for a, b, c in zip(self.cuts, self.cuts[1:], self.codes, strict=False)]
        rows, found = [], []
        for i in range(len(vectors)):
            own, height = [p[i] for p in products], self.height
            hits = self._above(own, height)
            while len(hits) < min(LEAST_CAPS, self.size**self.blocks):
                height -= 0.1 * abs(self.height) + 1e-3
                hits = self._above(own, height)
            rows.append(np.full(len(hits), i))
            found.append(hits)
        return np.concatenate(rows), np.concatenate(found)

    def _above(self, own: list[np.ndarray], height: float) -> np.ndarray:
        """Numbers of the codeword tuples whose inner products sum to the height, block by block, dropping hopeless beginnings."""
        rest = [0.0] * len(own)
        for b in range(len(own) - 2, -1, -1):
            rest[b] = rest[b + 1] + own[b + 1].max()
        at = np.flatnonzero(own[0] >= height - rest[0])
        total = own[0][at]
        for b in range(1, len(own)):
            sums = total[:, None] + own[b]
            keep, word = np.nonzero(sums >= height - rest[b])
            at, total = at[keep] * self.size + word, sums[keep, word]
        return at


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns in double precision."""
    dot = f"aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, v) -> s + v)"

    def norm(c: str) -> str:
        return f"sqrt(aggregate({c}, 0D, (s, v) -> s + CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))"

    return F.expr(f"{dot} / ({norm(a)} * {norm(b)})")


def similar_pairs(classes: DataFrame, least: float, count: int) -> DataFrame:
    """(u, v), u < v: pairs of ``classes`` (cls, label, embedding; distinct vectors) of one label and length with at least that cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Caps] = {}
        for batch in batches:
            for d, (at, vectors) in by_length(batch.column(2)).items():
                caps = known.setdefault(d, Caps(d, count))
                for i in range(0, len(at), 2048):
                    part = vectors[i : i + 2048]
                    row, cap = caps.decode(part / np.linalg.norm(part, axis=1, keepdims=True))
                    of = at[i : i + 2048][row]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), pa.array(np.full(len(of), d, dtype=np.int32)),
                         pa.array(cap.astype(np.int64))], ["cls", "label", "length", "cap"])

    held = classes.select("cls", "label", "embedding").mapInArrow(run, "cls bigint, label bigint, length int, cap bigint")
    met = held.alias("x").join(held.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("x.cap") == F.col("y.cap"))
                               & (F.col("x.length") == F.col("y.length")) & (F.col("x.cls") < F.col("y.cls")))
    pairs = met.select(F.col("x.cls").alias("u"), F.col("y.cls").alias("v")).distinct()
    left, right = classes.select(F.col("cls").alias("u"), F.col("embedding").alias("_a")), classes.select(F.col("cls").alias("v"), F.col("embedding").alias("_b"))
    full = attach(attach(pairs, left, ["u"], "inner", "_a"), right, ["v"], "inner", "_b")
    return full.filter(cosine("_a", "_b") >= least).select("u", "v")


def near_duplicates(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Rows link if their labels are equal and their cosine is at least
    ``least``.  Rows without a label, and vectors that are null, empty, zero or
    hold null or non-finite components, link with nothing; vectors of different
    lengths do not meet.  Equal vectors of one label are one class and link
    with each other.  component_id is the smallest vec_id reachable (null ids
    come last and are never it, unless all are null).  An empty table gives no
    rows; further columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding",
        (F.col("label").isNotNull() & usable(F.col("embedding"))).alias("_fit"))
    fit = rows.filter("_fit")
    classes = written(
        fit.groupBy("label", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
        .withColumn("cls", F.monotonically_increasing_id()))
    pairs = cut(similar_pairs(classes, least, classes.count()))
    sizes = classes.select("cls", "n")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(sizes.withColumnRenamed("cls", "v"), "v").groupBy(F.col("u").alias("cls")).agg(F.sum("n").alias("_others"))
    roots = components(pairs).withColumnRenamed("node", "cls")
    placed = classes.join(linked, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    known = placed.join(heads, "root").select(
        "label", "embedding", (F.col("n") - 1 + F.coalesce("_others", F.lit(0))).alias("n_links"), "component_id")
    found = fit.select("vec_id", "label", "embedding").join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("_fit")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
