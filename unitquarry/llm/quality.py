"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is a position labelled good or bad.  A line's features
describe its bytes and words, and those of the lines around it.  Labels exist
for documents only: in training the lines of a document carry its label.  The
forward-backward marginals of the lines, weighted by their lengths, give the
document's share of good text, which a logistic curve fitted on training
documents turns into the probability of a good document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from unitquarry.llm.common import slices
from unitquarry.runtime import cut

# Labelled documents that the field is fitted on: at most so many, and of at most so many bytes each. Scoring has no bounds.
# The first of them in the order of their ids' hashes are taken whose lines together are at most SAMPLE_LINES.
SAMPLE_DOCS = 4000
SAMPLE_BYTES = 100_000
SAMPLE_LINES = 300_000
KINDS = 14
BASE = 23
NEIGHBOUR = 3 * BASE
FEATURES = NEIGHBOUR + 2
CHUNK_BYTES = 1 << 20
# What a line adds to a chunk's size; a chain of more than WALK_LINES lines is walked in pieces of PIECE_LINES.
LINE_BYTES = 64
WALK_LINES = 1 << 15
PIECE_LINES = 1 << 10


def _byte_kinds() -> np.ndarray:
    """Kind of each byte; the kinds are listed in order."""
    table = np.full(256, 12, dtype=np.int64)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", ".", ",;:", "!?", "|", "#$%&*", "'\"`",
              "()[]{}<>", "-_/\\+=~^@"]
    for kind, chars in enumerate(groups):
        for c in chars:
            table[ord(c)] = kind
    table[0x80:] = 13
    return table


def line_features(texts: list[bytes], repeated: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' bytes, and each text's number of lines (at least one).

    ``repeated`` tells of every line if its text had it before, where the texts are pieces of a longer one.
    """
    kinds = _byte_kinds()
    lines = [t.split(b"\n") for t in texts]
    count = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    flat = [line for some in lines for line in some]
    n = len(flat)
    size = np.fromiter(map(len, flat), dtype=np.int64, count=n)
    data = np.frombuffer(b"".join(flat), dtype=np.uint8)
    of = np.repeat(np.arange(n, dtype=np.int64), size)
    kind = kinds[data]
    share = np.bincount(of * KINDS + kind, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    starts = np.cumsum(size) - size
    # A word starts where a byte that is no blank follows a blank or the line's start.
    blank = np.concatenate([[True], kind[:-1] == 3])
    blank[starts[size > 0]] = True
    begins = blank & (kind != 3)
    words = np.bincount(of[begins], minlength=n).astype(np.float64)
    after = np.concatenate([kind[1:], [3]])
    after[starts[(size > 0) & (starts > 0)] - 1] = 3
    # Words that end in a symbol, in '!', or are one '|'.
    odd = np.bincount(of[(after == 3) & ((kind == 8) | (kind == 6) | (kind == 7))], minlength=n)
    ends = np.bincount(of[(after == 3) & (kind == 4)], minlength=n)
    short = np.zeros(n)
    at = np.flatnonzero(begins)
    if len(at):
        stop = np.flatnonzero((kind != 3) & (after == 3))
        length = stop - at + 1
        short = np.bincount(of[at[length <= 3]], minlength=n)
    seen, repeat = np.zeros(n), 0
    again, kept = np.zeros(n), np.ones(n)
    for some in lines:
        known: set[bytes] = set()
        for line in some:
            if repeated is None:
                if line and line in known:
                    seen[repeat] = 1.0
                known.add(line)
            found = line.split()
            if len(found) > 1:
                again[repeat] = sum(map(eq, found, islice(found, 1, None))) / (len(found) - 1)
                kept[repeat] = len(set(found)) / len(found)
            repeat += 1
    if repeated is not None:
        seen = repeated.astype(np.float64)
    of_bytes, of_words = np.maximum(size, 1)[:, None], np.maximum(words, 1)
    letters = np.maximum(share[:, 0] + share[:, 1] + share[:, 13], 1)
    base = np.column_stack([
        share / of_bytes, share[:, 1] / letters, odd / of_words, np.minimum(ends / of_words, 1), short / of_words,
        np.log1p(words) / 5, seen, again, kept, (size == 0).astype(np.float64)])
    first = np.zeros(n, dtype=bool)
    first[np.cumsum(count) - count] = True
    last = np.zeros(n, dtype=bool)
    last[np.cumsum(count) - 1] = True
    before, behind = np.roll(base, 1, axis=0), np.roll(base, -1, axis=0)
    before[first], behind[last] = 0.0, 0.0
    return np.column_stack([base, before, behind, first, last]), size, count


def marginals(scores: np.ndarray, moves: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once.

    ``scores`` (lines, 2) and ``moves`` (2, 2) are log potentials.  Returns the
    marginals of the lines, the expected transitions, and the sum of the log
    partition functions.  Chains advance together, longest first, so a step
    costs one vector operation over the chains that are that long.
    """
    order = np.argsort(-count, kind="stable")
    start = (np.cumsum(count) - count)[order]
    length = count[order]
    longest = int(length[0]) if len(length) else 0
    alive = np.searchsorted(-length, -np.arange(1, longest + 1), side="right")
    alpha, beta = np.array(scores), np.zeros(scores.shape)

    def mix(x: np.ndarray) -> np.ndarray:
        return np.logaddexp(x[..., 0], x[..., 1])

    for t in range(1, longest):
        at = start[: alive[t]] + t
        back = alpha[at - 1]
        for y in (0, 1):
            alpha[at, y] += np.logaddexp(back[:, 0] + moves[0, y], back[:, 1] + moves[1, y])
    for t in range(longest - 1, 0, -1):
        at = start[: alive[t]] + t
        ahead = scores[at] + beta[at]
        for y in (0, 1):
            beta[at - 1, y] = np.logaddexp(moves[y, 0] + ahead[:, 0], moves[y, 1] + ahead[:, 1])
    total = np.zeros(len(count))
    total[order] = mix(alpha[start + length - 1])
    whole = np.repeat(total, count)
    lines = np.exp(alpha + beta - whole[:, None])
    inner = np.ones(len(scores), dtype=bool)
    inner[np.cumsum(count) - count] = False
    to = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for x in (0, 1):
        for y in (0, 1):
            pair[x, y] = np.exp(alpha[to - 1, x] + moves[x, y] + scores[to, y] + beta[to, y] - whole[to]).sum()
    return lines, pair, float(total.sum())


def good_share(features: np.ndarray, size: np.ndarray, count: np.ndarray, weights: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' probability to be good; an empty line weighs as one byte."""
    lines, _, _ = marginals(features @ weights, moves, count)
    first = np.cumsum(count) - count
    weight = np.maximum(size, 1).astype(np.float64)
    return np.add.reduceat(lines[:, 1] * weight, first) / np.add.reduceat(weight, first)


def _transfers(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log weight of every pair of a label before a piece and a label of its last line; ``scores`` (pieces, lines, 2)."""
    out = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)[None].repeat(len(scores), axis=0)
    for t in range(scores.shape[1]):
        out = np.logaddexp(out[:, :, :1] + moves[0], out[:, :, 1:] + moves[1]) + scores[:, t, None, :]
    return out


def long_marginals(scores: np.ndarray, moves: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Marginals of one long chain, as (first line, marginals) of some lines after the other.

    The chain is cut into pieces.  The pieces' transfer weights give the
    messages that enter them from both sides; with these added to its first
    and last line, a piece is a chain of its own, and pieces advance together.
    """
    n, held = len(scores), WALK_LINES // PIECE_LINES
    whole = n // PIECE_LINES
    cuts = [*range(0, whole * PIECE_LINES, PIECE_LINES), *([whole * PIECE_LINES] if n % PIECE_LINES else [])]
    bodies = scores[: whole * PIECE_LINES].reshape(whole, PIECE_LINES, 2)
    # The first line of all has no move before it: its piece needs no weights on the way from it, only on the way to it.
    found = [_transfers(bodies[at : at + held], moves) for at in range(0, whole, held)]
    if n % PIECE_LINES:
        found.append(_transfers(scores[None, whole * PIECE_LINES :], moves))
    weights = np.concatenate(found)
    pieces = len(cuts)
    enter, leave = np.zeros((pieces, 2)), np.zeros((pieces, 2))
    first = _transfers(scores[None, 1 : min(n, PIECE_LINES)], moves)[0]
    ahead = np.logaddexp(scores[0, 0] + first[0], scores[0, 1] + first[1])
    for k in range(1, pieces):
        ahead = ahead - ahead.max()
        enter[k] = np.logaddexp(ahead[0] + moves[0], ahead[1] + moves[1])
        ahead = np.logaddexp(ahead[0] + weights[k, 0], ahead[1] + weights[k, 1])
    for k in range(pieces - 1, 0, -1):
        back = np.logaddexp(weights[k, :, 0] + leave[k, 0], weights[k, :, 1] + leave[k, 1])
        leave[k - 1] = back - back.max()
    for at in range(0, pieces, held):
        begin, end = cuts[at], cuts[at + held] if at + held < pieces else n
        count = np.diff([*cuts[at : at + held], end])
        own = np.array(scores[begin:end])
        starts = np.cumsum(count) - count
        own[starts] += enter[at : at + held]
        own[starts + count - 1] += leave[at : at + held]
        yield begin, marginals(own, moves, count)[0]


def long_share(text: bytes, weights: np.ndarray, moves: np.ndarray) -> float:
    """``good_share`` of one text of many lines, whose features are made for some lines at a time.

    Kept for all lines are where they end, a hash (which tells lines that
    the text had before) and two scores: 40 bytes a line.
    """
    ends = np.append(np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 10), len(text))
    starts = np.append(0, ends[:-1] + 1)
    n, step = len(ends), WALK_LINES
    hashes = np.empty(n, dtype=np.uint64)
    for at in range(0, n, step):
        some = text[starts[at] : ends[min(at + step, n) - 1]].split(b"\n")
        hashes[at : at + len(some)] = np.fromiter(map(xxhash.xxh3_64_intdigest, some), dtype=np.uint64, count=len(some))
    repeated = np.ones(n, dtype=bool)
    repeated[np.unique(hashes, return_index=True)[1]] = False
    repeated &= ends > starts
    del hashes
    scores = np.empty((n, 2))
    at = 0
    while at < n:
        # Some lines, fewer of long ones, with a neighbour on either side.
        to = min(n, at + step, max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK_BYTES, side="right"))))
        low, high = max(0, at - 1), min(n, to + 1)
        features, _, _ = line_features([text[starts[low] : ends[high - 1]]], repeated[low:high])
        features[at - low, NEIGHBOUR] = float(at == 0)
        features[to - 1 - low, NEIGHBOUR + 1] = float(to == n)
        scores[at:to] = _with_one(features[at - low : to - low]) @ weights
        at = to
    good = 0.0
    size = np.maximum(ends - starts, 1)
    for at, lines in long_marginals(scores, moves):
        good += float(lines[:, 1] @ size[at : at + len(lines)])
    return good / float(size.sum())


def fit(features: np.ndarray, size: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights by gradient ascent (Adam) on the likelihood of chains that carry their document's label."""
    mean = features.mean(axis=0, dtype=np.float64).astype(features.dtype)
    spread = features.std(axis=0, dtype=np.float64).astype(features.dtype) + np.float32(1e-6)
    x = _with_one((features - mean) / spread)
    weights, moves = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    # Documents weigh alike, however many lines they have, so rates are per line of a document.
    share = np.repeat(1.0 / count, count) / len(count)
    y = np.repeat(label, count)
    want = np.zeros((len(x), 2))
    want[np.arange(len(x)), y] = 1.0
    inner = np.ones(len(x), dtype=bool)
    inner[np.cumsum(count) - count] = False
    same = np.bincount(y[inner], minlength=2) / max(1, len(x))
    m, v = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, rounds + 1):
        lines, pair, _ = marginals(x @ weights, moves, count)
        slopes = [x.T @ ((want - lines) * share[:, None]) - ridge * weights, np.diag(same) - pair / max(1, len(x)) - ridge * moves]
        for i, (value, slope) in enumerate(zip((weights, moves), slopes, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * slope
            v[i] = 0.99 * v[i] + 0.01 * slope**2
            value += 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    # Back to plain features.
    plain = weights[:-1] / spread[:, None]
    model = {"weights": np.vstack([plain, weights[-1] - mean @ plain]), "moves": moves}
    model["curve"] = _calibrate(good_share(_with_one(features), size, count, model["weights"], moves), label)
    return model


def _with_one(features: np.ndarray) -> np.ndarray:
    return np.column_stack([features, np.ones(len(features), dtype=features.dtype)])


def _logit(share: np.ndarray) -> np.ndarray:
    held = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(held / (1 - held))


def _calibrate(share: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Slope and offset of the logistic curve from share of good text to label, by Newton's method."""
    x = np.column_stack([_logit(share), np.ones(len(share))])
    curve = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (label - p) - 0.1 * (curve - [1.0, 0.0])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), slope)
        curve = curve + step
        if np.abs(step).max() < 1e-9:
            break
    return np.array([max(curve[0], 0.05), curve[1]])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded bytes and lines together; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text) + LINE_BYTES * (text.count(b"\n") + 1)
        if held and held + size > CHUNK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, learns: Column, target: str = "quality", most: int = SAMPLE_DOCS) -> dict[str, np.ndarray]:
    """Model from at most ``most`` labelled documents, those whose ids have the smallest hashes.

    Texts over ``SAMPLE_BYTES`` are not learned from, and only the first
    documents whose lines together are at most ``SAMPLE_LINES``.

    ``labels`` has doc_id and ``target`` (0 or 1; others and null are left
    out); ids that are null, repeated among the documents or labelled both
    ways teach nothing.  Without both kinds of labels the model is constant.
    """
    told = labels.select("doc_id", F.col(target).alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    told = told.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").drop("_most")
    usable = docs.select("doc_id", "text").filter(learns & (F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES))
    lines = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    ids = usable.select("doc_id", lines.alias("lines")).join(told, "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("label").alias("label"), F.max("lines").alias("lines"))
    # At most ``most`` rows are in the window.
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = ids.filter("n = 1").orderBy(*order).limit(most)
    picked = cut(first.withColumn("held", F.sum("lines").over(Window.orderBy(*order))).filter(F.col("held") <= SAMPLE_LINES).select("doc_id", "label"))
    rows = usable.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").toArrow()
    if not rows.num_rows or len(set(rows.column("label").to_pylist())) < 2:
        only = float(rows.column("label")[0].as_py()) if rows.num_rows else 0.5
        return {"weights": np.zeros((FEATURES + 1, 2)), "moves": np.zeros((2, 2)), "curve": np.array([0.05, 4 * (only - 0.5)])}
    rows = rows.sort_by("doc_id")
    label = rows.column("label").to_numpy().astype(np.int64)
    texts = [b for part in rows.column("text").chunks for b in _bytes(part)]
    del rows
    parts = [line_features(texts[a:b]) for a, b in chunks(texts)]
    features = np.concatenate([x.astype(np.float32) for x, _, _ in parts])
    size, count = np.concatenate([s for _, s, _ in parts]), np.concatenate([c for _, _, c in parts])
    del parts, texts
    return fit(features, size, count, label)


def scores(texts: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    """Probability of each text to be good."""
    out = np.zeros(len(texts))
    for a, b in chunks(texts):
        if b == a + 1 and texts[a].count(b"\n") >= WALK_LINES:
            share = np.array([long_share(texts[a], model["weights"], model["moves"])])
        else:
            features, size, count = line_features(texts[a:b])
            share = good_share(_with_one(features), size, count, model["weights"], model["moves"])
        out[a:b] = 1 / (1 + np.exp(-np.clip(model["curve"][0] * _logit(share) + model["curve"][1], -30, 30)))
    return out


def with_score(docs: DataFrame, model: dict[str, np.ndarray], name: str = "score") -> DataFrame:
    """``docs`` with the score of ``text`` as a last column ``name``, row by row, nothing shuffled.

    Null texts count as empty; an empty text is one empty line and is scored
    like any other; repeated rows are scored alike; an empty table gives no
    rows.  Texts of any number of lines are scored whole, in pieces; a single
    line is held in memory at some 60 times its bytes.  A column already
    called ``name`` is replaced.  Only ``text`` is an input of a score.
    """
    docs = docs.drop(name)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = pa.array(scores(_bytes(batch.column(at)), sent.value), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    kind = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, kind)
