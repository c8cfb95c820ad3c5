"""Language-model scoring of whole texts by PPM: contexts run over all bytes.

The coder is that of ``ppm``, but a context is the ``ORDER`` bytes before a
byte wherever they are: it crosses spaces, and upper case and white space are
coded as written.  A text is begun by fixed symbols, so every context has full
length, and the price of a byte depends on its gram (context and byte) alone.

Grams are counted over whole texts.  The trie is a table of them, partitioned
by the last two bytes of the context: all contexts of two and more bytes that
coding meets on its way down have the same two, so a task prices its grams
with the rows it has; contexts of one byte and of none are sent to all (at
most 65,536 grams and 256 a class).  Nothing is left out of the trie, whatever
its size.  Every distinct gram is priced once, and a text adds up its grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from unitquarry.llm.common import slices, written
from unitquarry.llm.ppm import CLASSES, HOT_WORDS, ORDER, Tries, all_orders, class_column, mixture, shorter, word_counts

# Fixed symbols before and after a text; UTF-8 has no such bytes.
BEGIN, FINISH = 0xFE, 0xFF
PIECE = 1 << 20
HELD_GRAMS = 1 << 21
# Grams that every task knows by heart, the most frequent ones; the others are joined.
HOT_GRAMS = 1 << 20
BLOCK_GRAMS = 200_000
GRAM = (1 << 48) - 1
# Bits of a text's number in a batch.
OF = 14


def plain_bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def _running(parts: list[bytes], of: list[int]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    keys = data[ORDER:].copy()
    for back in range(1, ORDER + 1):
        keys |= data[ORDER - back : len(data) - back] << (8 * back)
    # Grams that reach from one part into the next are left out.
    use, starts = np.ones(len(keys), dtype=bool), np.cumsum(sizes)[:-1]
    for j in range(ORDER):
        use[starts + j - ORDER] = False
    return keys[use], np.repeat(np.array(of, dtype=np.int64), sizes - ORDER)


def text_grams(texts: list[bytes], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Gram of every byte of the texts and of their ends, with the number of its text, in arrays of about ``size``; long texts are read in parts."""
    parts, of, held = [], [], 0
    for i, text in enumerate(texts):
        coded = bytes((BEGIN,)) * ORDER + text + bytes((FINISH,))
        for at in range(0, len(coded) - ORDER, size):
            parts.append(coded[at : at + size + ORDER])
            of.append(i)
            held += len(parts[-1])
            if held >= size:
                yield _running(parts, of)
                parts, of, held = [], [], 0
    if parts:
        yield _running(parts, of)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(np.append(first, len(keys)))


def gram_counts(rows: DataFrame, classes: int) -> DataFrame:
    """(gram, n) of ``rows`` (text, cls): a gram packs class, context and byte; class ``classes`` is that of rows that are not learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            return unique, np.bincount(at, weights=np.concatenate(counts), minlength=len(unique)).astype(np.int64)

        def out(unique: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(unique), pa.array(n)], ["gram", "n"])

        for batch in slices(batches):
            cls = batch.column(1).to_numpy().astype(np.int64)
            for key, of in text_grams(plain_bytes(batch.column(0)), PIECE):
                unique, n = runs(key | (cls[of] << 48))
                keys.append(unique)
                counts.append(n)
                held += len(unique)
                if held > HELD_GRAMS:
                    unique, n = merged()
                    keys, counts, held = [unique], [n], len(unique)
                    if held > HELD_GRAMS // 2:
                        yield out(unique, n)
                        keys, counts, held = [], [], 0
        if keys:
            yield out(*merged())

    return rows.mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def short_orders(counted: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of contexts of one byte and of none, and their counts: the kinds of longer contexts that each was seen in."""
    cut = [(F.shiftright("gram", 48) * F.lit(1 << 48)).bitwiseOR(F.col("gram").bitwiseAND(F.lit((1 << bits) - 1))) for bits in (24, 16)]
    learned = counted.filter(F.shiftright("gram", 48) < classes)
    found = learned.select(cut[0].alias("gram")).distinct().groupBy(cut[1].alias("gram")).count().toArrow()
    gram = found.column("gram").to_numpy()
    one = ((gram >> 48) << 51) | (1 << 48) | (gram & GRAM)
    none, kinds = np.unique(shorter(one, 0), return_counts=True)
    return np.concatenate([one, none]), np.concatenate([found.column("count").to_numpy(), kinds]).astype(np.float64)


def prices(counted: DataFrame, classes: int) -> DataFrame:
    """gram, times, s0..: how often each distinct gram is there in all rows, and its log10 probability in the trie of each class."""
    short = counted.sparkSession.sparkContext.broadcast(short_orders(counted, classes))
    names = ["gram", "times", *[f"s{m}" for m in range(classes)]]

    def block(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cls, gram = key >> 48, key & GRAM
        on = cls < classes
        keys, counts = all_orders((cls[on] << 51) | (ORDER << 48) | gram[on], n[on], 2)
        tries = Tries(np.concatenate([keys, short.value[0]]), np.concatenate([counts, short.value[1]]))
        want, at = np.unique(gram, return_inverse=True)
        times = np.bincount(at, weights=n, minlength=len(want)).astype(np.int64)
        costs = [tries.log10(want | (ORDER << 48), m) for m in range(classes)]
        return pa.RecordBatch.from_arrays([pa.array(want), pa.array(times), *map(pa.array, costs)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come ordered by the last two bytes of the context; a block ends where these change.
        keys, counts, held = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), []
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(k) for k, _ in held) >= BLOCK_GRAMS:
                keys = np.concatenate([keys, *[k for k, _ in held]])
                counts = np.concatenate([counts, *[c for _, c in held]])
                held = []
                end = (keys >> 8) & 0xFFFF
                at = np.searchsorted(end, end[-1])
                if at:
                    yield block(keys[:at], counts[:at])
                    keys, counts = keys[at:], counts[at:]
        keys = np.concatenate([keys, *[k for k, _ in held]])
        if len(keys):
            yield block(keys, np.concatenate([counts, *[c for _, c in held]]))

    end = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    dealt = counted.withColumn("end", end).repartition("end").sortWithinPartitions("end").select("gram", "n")
    return dealt.mapInArrow(run, ", ".join(f"{c} {'bigint' if i < 2 else 'double'}" for i, c in enumerate(names)))


def hot_bound(priced: DataFrame, most: int) -> int:
    """Least power of two such that at most ``most`` grams are there so often."""
    bits = priced.groupBy(F.length(F.bin("times")).alias("bits")).count().orderBy(F.desc("bits")).collect()
    grown = 0
    for r in bits:
        grown += r["count"]
        if grown > most:
            return 1 << r["bits"]
    return 0


def score(docs: DataFrame, held_out: Column, by: str = "lang", most: int = CLASSES) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text, and ``by``, the training class).

    Learns from the rows for which ``held_out`` is not true, a trie for each of
    the ``most - 1`` most frequent classes and one for all others.  Returns doc_id,
    held_out, n_tokens, n_known, train_tokens, base_score, score: the sum of
    the add-one unigram log10 probabilities of the words (A-Z lower-cased, the
    end of a text is a word), and the log10 probability of all bytes of the
    text and its end under the PPM mixture.  A null text is an empty one; a
    null id or class is a value like any other; repeated rows are scored alike
    and each returned; nothing is returned for an empty table; texts may be of
    any length; further columns are ignored.  Without training rows all bytes
    are equally likely.
    """
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"), F.col(by).alias("by"))
    learning = plain.filter(~F.col("held"))
    number, classes = class_column(learning, "by", most)
    mixed = np.zeros(classes)
    for r in learning.groupBy(number.alias("cls")).count().collect():
        mixed[r["cls"]] = r["count"]
    if classes > 1 and not mixed[-1]:
        # No learning row is in the class of rarer values and nulls.
        classes, mixed = classes - 1, mixed[:-1]
    priors = [float(p) for p in (mixed / mixed.sum() if mixed.sum() else np.full(classes, 1 / classes))]

    words = written(word_counts(plain.select("text", F.when(F.col("held"), F.lit(-1)).otherwise(0).cast("int").alias("cls")), 1).select("word", "n"))
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n, space = total["n"] or 0, (total["n"] or 0) + total["v"] + 1
    known, base = F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("known"), F.log10((F.col("n") + 1) / F.lit(float(space))).alias("base")
    hottest = words.orderBy(F.desc("n"), "word").limit(HOT_WORDS).select("word", known, base).toArrow()

    counted = written(gram_counts(plain.select("text", F.when(F.col("held"), F.lit(classes)).otherwise(number).cast("int").alias("cls")), classes))
    priced = written(prices(counted, classes))
    least = hot_bound(priced, HOT_GRAMS)
    of_class = [f"s{m}" for m in range(classes)]
    grams = priced.filter(F.col("times") >= least).select("gram", *of_class).toArrow()
    order = np.argsort(grams.column("gram").to_numpy())
    hot = docs.sparkSession.sparkContext.broadcast((
        {w: i for i, w in enumerate(hottest.column("word").to_pylist())},
        np.stack([*[hottest.column(c).to_numpy() for c in ("known", "base")]], axis=1),
        grams.column("gram").to_numpy()[order], np.stack([grams.column(c).to_numpy()[order] for c in of_class])))
    columns = ["known", "base", *of_class]
    kinds = ", ".join(f"{c} double" for c in columns)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        by_heart, table, gram, cost = hot.value
        table = np.vstack([table, np.zeros((1, 2))])
        names = ["row", "doc_id", "held", "key", "times", "tokens", *columns]

        def out(rows, ids, held, key, times, length, sums):
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), ids, held, pa.array(key, pa.binary()), pa.array(times, pa.int64()), pa.array(length, pa.int64()),
                 *[pa.array(np.ascontiguousarray(sums[:, i])) for i in range(len(columns))]], names)

        def joined(rows, keys, times):
            for i in range(0, len(keys), 50_000):
                k = len(keys[i : i + 50_000])
                yield out(rows[i : i + k], pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), keys[i : i + k], times[i : i + k], [0] * k, np.zeros((k, len(columns))))

        for batch in slices(batches):
            texts = plain_bytes(batch.column(1))
            rows = (part << 33) + seen + np.arange(len(texts))
            seen += len(texts)
            sums, length, rare_row, rare, times = np.zeros((len(texts), len(columns))), [], [], [], []
            for i, text in enumerate(texts):
                found = [*text.lower().split(), b""]
                at = np.fromiter(map(by_heart.get, found, repeat(-1)), dtype=np.int64, count=len(found))
                sums[i, :2] = table[at].sum(axis=0)
                length.append(len(found))
                missing = Counter(found[j] for j in np.flatnonzero(at < 0))
                rare_row += [int(rows[i])] * len(missing)
                rare += missing.keys()
                times += missing.values()
            yield from joined(rare_row, rare, times)
            for key, of in text_grams(texts, PIECE):
                unique, count = runs((key << OF) | of)
                key, of = unique >> OF, unique & ((1 << OF) - 1)
                # Each distinct gram is looked up once; its texts follow one another.
                first = np.flatnonzero(np.diff(key, prepend=-1))
                several = np.diff(np.append(first, len(key)))
                at = np.minimum(np.searchsorted(gram, key[first]), max(0, len(gram) - 1))
                hit = gram[at] == key[first] if len(gram) else np.zeros(len(first), dtype=bool)
                at, hit = np.repeat(at[hit], several[hit]), np.repeat(hit, several)
                text, weight = of[hit], count[hit].astype(np.float64)
                for m in range(classes):
                    sums[:, 2 + m] += np.bincount(text, weights=weight * cost[m][at], minlength=len(texts))
                # No word begins with a blank.
                yield from joined(rows[of[~hit]], [b"  " + g.to_bytes(8, "big") for g in key[~hit].tolist()], count[~hit])
            # A key that is of this row alone, so that these rows do not meet in one task.
            yield out(rows, batch.column(0), batch.column(2), [b" " + r.to_bytes(8, "big") for r in rows.tolist()], [0] * len(texts), length, sums)

    parts = plain.select("doc_id", "text", "held").mapInArrow(
        add, f"row bigint, doc_id bigint, held boolean, key binary, times bigint, tokens bigint, {kinds}")
    rare_words = words.select(F.col("word").alias("key"), known, base, *[F.lit(0.0).alias(c) for c in of_class])
    packed = F.concat(F.lit(b"  "), F.unhex(F.lpad(F.hex("gram"), 16, "0"))).alias("key")
    rare_grams = priced.filter(F.col("times") < least).select(packed, F.lit(0.0).alias("known"), F.lit(0.0).alias("base"), *of_class)
    costs = rare_words.unionByName(rare_grams).select(*[F.col(c).alias(f"_{c}") for c in ["key", *columns]])
    joined = parts.join(costs, parts["key"] == costs["_key"], "left")
    sums = [F.sum(F.col(c) + F.col("times") * F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in columns]
    whole = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held_out"), F.sum("tokens").alias("n_tokens"), *sums)
    return whole.select(
        "doc_id", "held_out", "n_tokens", F.round("known").cast("bigint").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), mixture(priors).alias("score"))
