"""Ranked lexical search with geometric blocks inside each posting list.

Documents are tokenised once into rows of (term, count) for the terms that the
items ask for; the numbers of documents and terms and the document
frequencies are counted over all rows.  A task then reads its rows in
segments.  Inside a segment, the posting list of a term is clustered by the
similarity of its documents' vectors, and every block of a list keeps the
coordinatewise maximum of its vectors.  A block is skipped for an item only if
the product of the item with that summary stays below the item's ``k``-th best
score so far, so the ranking is exact.  Lists are walked from the heaviest term
to the lightest: a document that holds a heavier term of the item was judged in
that term's list, so the summary counts only from the list's own term on.

Every task hands on ``k`` rows for each item.  Terms are bytes: every byte from
0x80 on belongs to a term, so the pattern's maximal matches are found in UTF-8.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from unitquarry.llm.common import slices, written

# Fixed characters: digits, letters and everything from 0x80 on belong to terms; A-Z become a-z.
_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

# Bytes of a text that are split at a time.
PIECE = 1 << 20

# Entries (item, term) that are sent to the tasks in one pass over the documents.
PASS_ENTRIES = 400_000

# Items and entries that share one weight matrix inside a task.
BLOCK_ITEMS, BLOCK_ENTRIES = 256, 16_384

# Cells of a segment's matrix, documents by terms, and documents of a block.
CELLS = 12_000_000
BLOCK_DOCS = 32

# Scored documents that wait before the best ones are picked anew.
WAITING = 4096

FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"
RANKED = "item_id bigint, item bigint, doc_id bigint, score bigint"


def term_counts(text: str | None) -> Counter:
    """How often each term occurs in the text; none in a null text."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TERMS)
    found, at = Counter(), 0
    while at < len(data):
        stop = len(data)
        if stop - at > PIECE:
            stop = data.rfind(b" ", at, at + PIECE)
            if stop < 0:
                stop = data.find(b" ", at + PIECE)
            stop = stop if stop >= 0 else len(data)
        found.update(data[at:stop].split())
        at = stop + 1
    return found


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, item, term, reps`` of every different row (item_id, text); ``item`` tells the rows apart."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, items, terms, reps = [], [], [], []
            for r in batch.to_pylist():
                found = term_counts(r["text"])
                ids += [r["item_id"]] * len(found)
                items += [r["item"]] * len(found)
                terms += found.keys()
                reps += found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(terms, pa.binary()), pa.array(reps, pa.int64())],
                ["item_id", "item", "term", "reps"])

    rows = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).distinct()
    return rows.select("item_id", F.xxhash64("item_id", "text").alias("item"), "text").mapInArrow(
        per_batch, "item_id bigint, item bigint, term binary, reps bigint")


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of every row: its number of terms, and its terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in slices(batches, 256):
            n, sizes, terms, tfs = [], [0], [], []
            for text in batch.column("text").to_pylist():
                found = term_counts(text)
                n.append(sum(found.values()))
                for term in found.keys() & number.keys():
                    terms.append(number[term])
                    tfs.append(found[term])
                sizes.append(len(terms))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(per_batch, FORWARD)


class _Items:
    """Some items with one weight matrix, and the best ``k`` documents of each so far.

    Rows of ``weights`` are terms from the heaviest to the lightest.
    """

    def __init__(self, items: list[tuple[int | None, int]], entries: list[tuple[int, int, int]], k: int):
        """``entries``: position of the item, number of the term by weight, weight times repeats."""
        self.items, self.k = items, k
        self.terms = np.unique([t for _, t, _ in entries]).astype(np.int64)
        # Sums of whole numbers are exact in doubles below 2^53, and in 64-bit integers beyond.
        largest = max(_totals(entries).values(), default=0) * 1_000_000
        self.kind = np.float64 if largest < 2**53 else np.int64
        self.weights = np.zeros((len(self.terms), len(items)), self.kind)
        for item, term, weight in entries:
            self.weights[np.searchsorted(self.terms, term), item] = weight
        self.best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]
        self.waiting: list[tuple] = []
        self.n_waiting = 0
        self.least = np.zeros(len(items), self.kind)
        self.scored = self.skipped = 0

    def _settle(self) -> None:
        """Keep the best ``k`` of each item, of those kept before and those that wait."""
        item, score, doc, null = (np.concatenate(x) for x in zip(self.best, *self.waiting))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((doc, null, -score, item))
        ranked = item[order]
        place = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        full = order[place == self.k - 1]
        self.least[item[full]] = score[full]
        order = order[place < self.k]
        self.best = [x[order] for x in (item, score, doc, null)]

    def _score(self, matrix, rows, items, wanted, seen, doc, null) -> None:
        """Score the wanted (row, item) pairs whole, those not seen before."""
        wanted = wanted & ~seen[np.ix_(rows, items)]
        used = wanted.any(axis=1)
        if not used.any():
            return
        rows, wanted = rows[used], wanted[used]
        columns = np.flatnonzero(self.weights[:, items].any(axis=1))
        values = matrix[np.ix_(rows, columns)] @ self.weights[np.ix_(columns, items)]
        seen[np.ix_(rows, items)] |= wanted
        at, to = np.nonzero(wanted)
        self.scored += len(at)
        found = values[at, to]
        good = (found > 0) & (found >= self.least[items[to]])
        if good.any():
            at, to = at[good], to[good]
            self.waiting.append((items[to], found[good].astype(np.int64), doc[rows[at]], null[rows[at]]))
            self.n_waiting += len(at)
            if self.n_waiting >= WAITING:
                self._settle()

    def add(self, matrix: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Search one segment: a row of contributions for each document."""
        n = len(matrix)
        seen = np.zeros((n, len(self.items)), bool)
        # Items without k documents so far score some rows first, so that the blocks have a score to stay below.
        bare = np.flatnonzero(self.least == 0)
        if len(bare):
            probe = np.arange(0, n, max(1, n // 256))
            self._score(matrix, probe, bare, np.ones((len(probe), len(bare)), bool), seen, doc, null)
            if self.waiting:
                self._settle()
        peak = matrix.max(axis=0, initial=0)
        rest = np.cumsum((self.weights * peak[:, None])[::-1], axis=0)[::-1]
        at, rows_of = np.nonzero(matrix.T)
        starts = np.searchsorted(at, np.arange(len(self.terms) + 1))
        for t in range(len(self.terms)):
            items = np.flatnonzero((self.weights[t] > 0) & (rest[t] > 0) & (rest[t] >= self.least))
            rows = rows_of[starts[t] : starts[t + 1]]
            if not len(items) or not len(rows):
                continue
            columns = t + np.flatnonzero(self.weights[t:, items].any(axis=1))
            vectors = matrix[np.ix_(rows, columns)]
            blocks = -(-len(rows) // BLOCK_DOCS)
            if blocks > 1:
                pivots = vectors[np.linspace(0, len(rows) - 1, blocks).astype(int)]
                length = np.sqrt((pivots.astype(np.float64) ** 2).sum(axis=1))
                label = np.argmax(vectors @ (pivots.T / np.maximum(length, 1)), axis=1)
                order = np.argsort(label, kind="stable")
                rows, vectors, label = rows[order], vectors[order], label[order]
                first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
            else:
                first = np.zeros(1, np.int64)
            summary = np.maximum.reduceat(vectors, first, axis=0)
            bound = summary @ self.weights[np.ix_(columns, items)]
            open_ = (bound > 0) & (bound >= self.least[items])
            self.skipped += open_.size - int(open_.sum())
            if open_.any():
                block = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
                self._score(matrix, rows, items, open_[block], seen, doc, null)

    def rows(self) -> pa.RecordBatch:
        if self.waiting:
            self._settle()
        item, score, doc, null = self.best
        ids = pa.array([self.items[i][0] for i in item], pa.int64())
        keys = pa.array([self.items[i][1] for i in item], pa.int64())
        return pa.RecordBatch.from_arrays([ids, keys, pa.array(doc, pa.int64(), mask=null), pa.array(score)], ["item_id", "item", "doc_id", "score"])


def _totals(entries: list[tuple[int, int, int]]) -> Counter:
    total = Counter()
    for item, _, weight in entries:
        total[item] += weight
    return total


def _searched(batches: Iterator[pa.RecordBatch], blocks: list[_Items], n_terms: int, n_docs: int, all_terms: int) -> list[_Items]:
    """Give every segment of the rows to every block of items."""
    places = []
    for block in blocks:
        place = np.full(n_terms, -1, np.int64)
        place[block.terms] = np.arange(len(block.terms))
        places.append(place)
    widest = max((len(b.terms) for b in blocks), default=1)
    for batch in slices(batches, max(1, CELLS // max(widest, 1))):
        n = batch.column("n").to_numpy().tolist()
        m = np.array([75 + 25 * x * n_docs // all_terms for x in n], np.int64)
        lists = batch.column("terms")
        rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        terms, tf = lists.flatten().to_numpy(), batch.column("tfs").flatten().to_numpy()
        values = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
        null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        doc = batch.column("doc_id").fill_null(0).to_numpy()
        for block, place in zip(blocks, places):
            column = place[terms]
            mine = column >= 0
            matrix = np.zeros((batch.num_rows, len(block.terms)), block.kind)
            matrix[rows[mine], column[mine]] = values[mine]
            block.add(matrix, doc, null)
    return blocks


def _one_pass(docs: DataFrame, entries: list, k: int) -> DataFrame | None:
    """The best ``k`` of every task for the items of ``entries``; None if no document has a term."""
    spark = docs.sparkSession
    vocabulary = {term: i for i, term in enumerate(sorted({bytes(r["term"]) for r in entries}))}
    rows = written(forward(docs, vocabulary))
    counts = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    if not counts["docs"]:
        return None
    n_docs, all_terms = counts["docs"], counts["terms"]
    found = rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()
    weight = {r["t"]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1))) for r in found}
    # Terms in no document or in nearly all add nothing to any score.
    order = sorted((t for t in weight if weight[t] > 0), key=lambda t: (-weight[t], t))
    rank = {t: i for i, t in enumerate(order)}
    rank_of = np.full(len(vocabulary), -1, np.int32)
    rank_of[order] = np.arange(len(order))

    by_item = defaultdict(list)
    for r in entries:
        term = vocabulary[bytes(r["term"])]
        if term in rank:
            by_item[r["item_id"], r["item"]].append((rank[term], weight[term] * r["reps"]))
    parts, size = [], 0
    for item, terms in by_item.items():
        if not parts or len(parts[-1]) >= BLOCK_ITEMS or size + len(terms) > BLOCK_ENTRIES:
            parts.append([])
            size = 0
        parts[-1].append((item, terms))
        size += len(terms)
    shared = spark.sparkContext.broadcast((parts, rank_of))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rank_of = shared.value
        blocks = [
            _Items([item for item, _ in part], [(i, t, w) for i, (_, terms) in enumerate(part) for t, w in terms], k) for part in parts]
        # Terms get their numbers by weight; those without a weight become the last number, which no block has.
        ranked = (
            pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n"), _renumbered(b.column("terms"), rank_of), b.column("tfs")], ["doc_id", "n", "terms", "tfs"])
            for b in batches)
        for block in _searched(ranked, blocks, len(rank_of) + 1, n_docs, all_terms):
            yield block.rows()

    return rows.mapInArrow(per_task, RANKED)


def _renumbered(lists: pa.Array, rank_of: np.ndarray) -> pa.Array:
    new = rank_of[lists.flatten().to_numpy()]
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(np.where(new < 0, len(rank_of), new).astype(np.int32)))


def search(docs: DataFrame, items: DataFrame, k: int = 20, pass_entries: int = PASS_ENTRIES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of every item.

    Rows of ``items`` with equal id and text are one item; rows with equal ids
    and other texts are answered each for itself.  Null and empty texts, and
    items without a term that scores, give no rows.  Documents with null or
    repeated ids take part as rows of their own; equal scores are ordered by
    ascending id, nulls last.  Further columns are ignored; an empty table on
    either side gives no rows.  Texts are read whole, in pieces of ``PIECE``
    bytes.  The items go to the tasks in passes of about ``pass_entries`` (item,
    term) pairs, or one item with more; each pass reads all documents.
    """
    if not isinstance(k, int) or isinstance(k, bool) or k < 1:
        raise ValueError(f"k must be a positive integer, got {k!r}")
    asked = written(item_terms(items))
    passes = -(-asked.count() // pass_entries)
    parts = []
    for i in range(passes):
        entries = asked.filter(F.pmod("item", F.lit(passes)) == i).collect()
        best = _one_pass(docs, entries, k) if entries else None
        if best is not None:
            parts.append(best)
    spark = docs.sparkSession
    every = spark.createDataFrame([], RANKED)
    for part in parts:
        every = every.unionByName(part)
    order = Window.partitionBy("item_id", "item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
