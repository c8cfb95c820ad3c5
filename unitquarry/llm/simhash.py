"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each a word of the perfect
[23, 12, 7] Golay code's space.  Words that differ in at most two bits share a
codeword among those near them (one codeword for a word within two bits of the
code, six for the others), and words that differ in at most one bit reach each
other's codeword by flipping a bit.  If fingerprints differ in at most four
bits, then by the pigeonhole principle either a segment is equal and another
differs in at most two bits, or two segments differ in exactly one bit each.
Both cases are equi-joins on composite keys; pairs are verified on all bits
inside the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from unitquarry.llm.common import slices
from unitquarry.llm.graph import components
from unitquarry.runtime import cut

MAX_BITS = 4
SHINGLE = 4
SEED = 42
# Generator polynomial of the code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
# Segments as (lowest bit, width) of the fingerprint.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _remainders(words: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words modulo the generator polynomial."""
    left = words.astype(np.int64)
    for bit in range(22, 10, -1):
        left = np.where((left >> bit) & 1, left ^ (GENERATOR << (bit - 11)), left)
    return left


def _leaders() -> np.ndarray:
    """The one error pattern of at most three bits for each of the 2,048 syndromes."""
    one = [1 << i for i in range(23)]
    two = [a | b for i, a in enumerate(one) for b in one[:i]]
    three = [a | b for a in two for b in one if b < (a & -a)]
    patterns = np.array([0, *one, *two, *three], dtype=np.int64)
    table = np.zeros(2048, dtype=np.int64)
    table[_remainders(patterns)] = patterns
    return table


LEADERS = _leaders()
_SINGLE = _remainders(np.array([1 << i for i in range(23)]))


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the 12 high bits) of the codeword within three bits of each word."""
    return (words ^ LEADERS[_remainders(words)]) >> 11


def _flipped() -> np.ndarray:
    """For each syndrome the error patterns that lead to the codewords found after flipping one bit.

    Row: up to six distinct patterns (the word's own leader first), padded by
    repeating the first.  A word within two bits of its codeword has one.
    """
    table = np.zeros((2048, 6), dtype=np.int64)
    for s in range(2048):
        own = int(LEADERS[s])
        found = [own]
        if bin(own).count("1") == 3:
            for i in range(23):
                way = int(LEADERS[s ^ int(_SINGLE[i])]) ^ (1 << i)
                if way not in found:
                    found.append(way)
        table[s] = (found + [own] * 6)[:6]
    return table


NEAR = _flipped()


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) codeword indices near each word and which of them are not repeats."""
    ways = NEAR[_remainders(words)]
    fresh = np.ones(ways.shape, dtype=bool)
    fresh[:, 1:] = ways[:, 1:] != ways[:, :1]
    return (words[:, None] ^ ways) >> 11, fresh


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a text; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
    ends = ends.tolist()
    draw = xxhash.xxh64_intdigest
    width = min(shingle, len(words))
    hashes = [draw(joined[a : b - 1], SEED) for a, b in zip(ends, ends[width:], strict=False)]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = np.array(hashes[at : at + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long), digest (hash of id and text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["doc_id", "fp", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text"), F.xxhash64("doc_id", "text").alias("digest"))
    return rows.mapInArrow(run, "doc_id bigint, fp bigint, digest bigint")


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    bits = prints.view(np.uint64)
    return [((bits >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]


def _emit(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    keys, prints = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints)], ["key", "fp"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 4096) -> Iterator[np.ndarray]:
    for batch in batches:
        whole = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(whole), rows):
            yield np.ascontiguousarray(whole[at : at + rows])


def _equal_and_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of an equal segment with each near codeword of another one."""
    for prints in _blocks(batches):
        cuts, parts = _segments(prints), []
        for b in range(3):
            index, fresh = near_indices(cuts[b])
            row, col = np.nonzero(fresh)
            for a in range(3):
                if a != b:
                    parts.append((((a * 3 + b) << 40) | (cuts[a][row] << 12) | index[row, col], prints[row]))
        yield _emit(parts)


_PAIRS = ((0, 1), (0, 2), (1, 2))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the codewords that two segments decode to."""
    for prints in _blocks(batches):
        own = [decode(c) for c in _segments(prints)]
        yield _emit([((n << 40) | (own[a] << 12) | own[b], prints) for n, (a, b) in enumerate(_PAIRS)])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of the codewords that two segments reach when a bit of each flips."""
    for prints in _blocks(batches):
        near, parts = [near_indices(c) for c in _segments(prints)], []
        for n, (a, b) in enumerate(_PAIRS):
            (ia, fa), (ib, fb) = near[a], near[b]
            row, i, j = np.nonzero(fa[:, :, None] & fb[:, None, :])
            parts.append(((n << 40) | (ia[row, i] << 12) | ib[row, j], prints[row]))
        yield _emit(parts)


def _differs(n: int) -> Column:
    low, width = SEGMENTS[n]
    mask = ((1 << width) - 1) << low
    return F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))


def linked_fingerprints(prints: DataFrame) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints (column fp) that differ in 1 to 4 bits, each once, u < v.

    The join condition holds the verification, and lets only the first key
    kind that fits a pair through, so its output is close to the links.
    """
    kind = "key bigint, fp bigint"
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_BITS
    e = [_differs(n) for n in range(3)]
    # The equal segment is the first one that is equal, the near one the first other within two bits.
    first, second = F.lit(None).cast("int"), F.lit(None).cast("int")
    for a in (2, 1, 0):
        first = F.when(e[a] == 0, a).otherwise(first)
    for a in (2, 1, 0):
        near_b = F.lit(None).cast("int")
        for b in (2, 1, 0):
            if b != a:
                near_b = F.when(e[b] <= 2, b).otherwise(near_b)
        second = F.when(first == a, near_b).otherwise(second)
    keyed = prints.mapInArrow(_equal_and_near, kind)
    equal = keyed.alias("x").join(
        keyed.alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near
        & (F.shiftright(F.col("x.key"), 40) == first * 3 + second))
    pair = F.when((e[0] == 1) & (e[1] == 1), 0).when((e[0] == 1) & (e[2] == 1), 1).when((e[1] == 1) & (e[2] == 1), 2)
    flipped = prints.mapInArrow(_reached, kind).alias("x").join(
        prints.mapInArrow(_own, kind).alias("y"),
        (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & near
        & (e[0] > 0) & (e[1] > 0) & (e[2] > 0) & (F.shiftright(F.col("x.key"), 40) == pair))
    found = equal.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")).unionByName(
        flipped.select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v")))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, digest, component_id, root of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id among the texts reachable over links
    of at most four bits, null only if all their ids are null; root is the
    component's smallest fingerprint.  Texts are
    whole, upper-case A-Z counts as lower case; null and empty texts and those
    of white space have fingerprint 0, which links like any other.  Rows may
    repeat; an empty table gives no rows; further columns are ignored.  Equal
    fingerprints are joined as one, so copies make no pairs.
    """
    rows = cut(fingerprints(docs, shingle))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(components(linked_fingerprints(classes.select("fp"))))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(heads, "root").select("fp", "component_id", "root")
    return rows.join(named, "fp").select("doc_id", "fp", "digest", "component_id", "root")


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, then the smallest digest.

    A null id comes after all others.  Columns are those of ``docs``.
    """
    found = near_duplicates(docs, shingle)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("digest").alias("g"))
    best = found.groupBy("root").agg(F.min(order).alias("o"))
    kept = cut(best.select(F.col("o.d").alias("_kept_doc"), F.col("o.g").alias("_kept_digest")))
    marked = docs.withColumn("_row_digest", F.xxhash64(docs["doc_id"], docs["text"]))
    same = marked["doc_id"].eqNullSafe(kept["_kept_doc"]) & (marked["_row_digest"] == kept["_kept_digest"])
    stays = marked.join(kept, same, "left_semi")
    # Rows that repeat an id and a text are the only ones left to choose from.
    again = cut(found.groupBy("doc_id", "digest").count().filter("count > 1").select(
        F.col("doc_id").alias("_again_doc"), F.col("digest").alias("_again_digest")))
    if again.isEmpty():
        return stays.drop("_row_digest")
    twice = stays["doc_id"].eqNullSafe(again["_again_doc"]) & (stays["_row_digest"] == again["_again_digest"])
    single = stays.join(again, twice, "left_anti")
    return single.unionByName(
        stays.join(again, twice, "left_semi").dropDuplicates(["doc_id", "_row_digest"])).drop("_row_digest")
