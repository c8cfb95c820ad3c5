"""Parts of prediction by partial matching (PPM): tries, word counts, training classes.

A byte-context trie holds, for every context of up to ``ORDER`` bytes, how
often each byte followed it.  A byte is coded in the longest known context;
if it never followed there, an escape (method D: every kind of follower gives
half a count to it) leads to the next shorter one, where the bytes that the longer
one could have coded are excluded.  ``ppm_text`` scores texts with these.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ORDER = 5
CLASSES = 8
# Words that every task knows by heart: the most frequent ones, at most so many.
HOT_WORDS = 1 << 17
HELD_WORDS = 300_000


def class_column(docs: DataFrame, by: str, most: int = CLASSES) -> tuple[Column, int]:
    """Class number of a row by the most frequent values of ``by``, and how many there are.

    Rarer values and null share the last class.
    """
    top = [r[0] for r in docs.filter(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.desc("count"), by).limit(most - 1).collect()]
    number = F.lit(len(top))
    for i, value in enumerate(top):
        number = F.when(F.col(by) == F.lit(value), i).otherwise(number)
    return number.cast("int"), len(top) + 1


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; the end of the text is the empty word."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(b"")
    return words


def word_counts(rows: DataFrame, classes: int) -> DataFrame:
    """word, n, n0.. : counts in all learning rows and by class, of every word of ``rows`` (text, cls; -1: not learning)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [Counter() for _ in range(classes + 1)]

        def flush():
            for cls, found in enumerate(held, -1):
                if found:
                    count = np.fromiter(found.values(), dtype=np.int64, count=len(found)) if cls >= 0 else np.zeros(len(found), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(found), pa.binary()), pa.array(np.full(len(found), cls, dtype=np.int32)), pa.array(count)],
                        ["word", "cls", "n"])
                    found.clear()

        for batch in batches:
            for text, cls in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[cls + 1].update(tokens(text.as_py()))
                if sum(map(len, held)) > HELD_WORDS:
                    yield from flush()
        yield from flush()

    found = rows.mapInArrow(run, "word binary, cls int, n bigint")
    by_class = [F.sum(F.when(F.col("cls") == m, F.col("n")).otherwise(0)).alias(f"n{m}") for m in range(classes)]
    return found.groupBy("word").agg(F.sum("n").alias("n"), *by_class)


def shorter(keys: np.ndarray, size: int) -> np.ndarray:
    """Keys with their contexts cut to ``size`` bytes (class bits stay)."""
    return (keys & ~((1 << 51) - 1)) | (size << 48) | (keys & ((1 << (8 * size + 8)) - 1))


def all_orders(gram: np.ndarray, n: np.ndarray, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Grams of every context length, from ``least`` on, from those of the longest contexts.

    With update exclusion: a byte counts in a shorter context once for each
    longer context it was seen in.
    """
    size = (gram >> 48) & 7
    keys, counts = [gram[size == ORDER]], [n[size == ORDER].astype(np.float64)]
    for s in range(ORDER - 1, least - 1, -1):
        up, kinds = np.unique(shorter(keys[-1], s), return_counts=True)
        keys.append(np.concatenate([up, gram[size == s]]))
        counts.append(np.concatenate([kinds, n[size == s]]).astype(np.float64))
    return np.concatenate(keys), np.concatenate(counts)


class Tries:
    """Sorted arrays of grams and contexts, with what coding needs of each."""

    def __init__(self, gram: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(gram)
        self.gram, self.n = gram[order], n[order].astype(np.float64)
        self.context, first = np.unique(self.gram >> 8, return_index=True)
        self.kinds = np.diff(np.append(first, len(self.gram))).astype(np.float64)
        self.total = np.add.reduceat(self.n, first) if len(first) else np.zeros(0)
        # What the next shorter context has left when everything that followed this one is excluded.
        size = (self.gram >> 48) & 7
        other = np.zeros(len(self.gram))
        for s in range(1, ORDER + 1):
            on = size == s
            other[on] = self.n[np.searchsorted(self.gram, shorter(self.gram[on], s - 1))]
        size = (self.context >> 40) & 7
        self.left_total, self.left_kinds = np.zeros(len(first)), np.zeros(len(first))
        excluded = np.add.reduceat(other, first) if len(first) else other
        for s in range(1, ORDER + 1):
            on = size == s
            up = np.searchsorted(self.context, shorter(self.context[on] << 8, s - 1) >> 8)
            self.left_total[on] = self.total[up] - excluded[on]
            self.left_kinds[on] = self.kinds[up] - self.kinds[on]

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> Tries:
        """From the arrays of another one; those travel to tasks without this module."""
        tries = cls.__new__(cls)
        tries.__dict__.update(arrays)
        return tries

    def log10(self, keys: np.ndarray, cls: int) -> np.ndarray:
        """log10 probability of the byte of each key after its context, in the trie of a class."""
        out = np.zeros(len(keys))
        left, came = np.arange(len(keys)), np.full(len(keys), -1)
        depth = (keys >> 48) & 7
        for size in range(ORDER, -1, -1):
            at = np.flatnonzero(depth[left] >= size)
            if not len(at) or not len(self.gram):
                continue
            want = shorter(keys[left[at]], size) | (cls << 51)
            node = np.minimum(np.searchsorted(self.context, want >> 8), len(self.context) - 1)
            known = self.context[node] == want >> 8
            at, want, node = at[known], want[known], node[known]
            child = came[at]
            kinds = np.where(child < 0, self.kinds[node], self.left_kinds[child])
            room = np.where(child < 0, self.total[node], self.left_total[child])
            gram = np.minimum(np.searchsorted(self.gram, want), len(self.gram) - 1)
            hit = self.gram[gram] == want
            out[left[at[hit]]] += np.log10((self.n[gram[hit]] - 0.5) / room[hit])
            miss = ~hit & (kinds > 0)
            out[left[at[miss]]] += np.log10(kinds[miss] / 2 / room[miss])
            came[at] = node
            rest = np.ones(len(left), dtype=bool)
            rest[at[hit]] = False
            left, came = left[rest], came[rest]
        # Bytes that no context of the class knows are equally likely.
        used = self.kinds[self.context == cls << 43]
        out[left] -= np.log10(256 - (used[0] if len(used) else 0))
        return out
def mixture(priors: list[float]) -> Column:
    """log10 probability under the mixture of classes from those under each of them (s0..)."""
    weighted = [F.col(f"s{m}") + F.lit(float(np.log10(p))) for m, p in enumerate(priors) if p > 0]
    best = F.greatest(*weighted) if len(weighted) > 1 else weighted[0]
    return best + F.log10(sum((F.pow(F.lit(10.0), w - best) for w in weighted[1:]), F.pow(F.lit(10.0), weighted[0] - best)))


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(buckets))
