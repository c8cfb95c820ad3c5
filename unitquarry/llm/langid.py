"""Language identification by Bayesian fusion of evidence.

The posterior of a language is the product of the likelihood of the text
(byte trigrams), of the language that the markup declares, of the suffix of
the address, and of a prior of the host.  Priors are smoothed along a
hierarchy: a host leans on its domain, the domain on its suffix, the suffix on
all rows.  Likelihoods of declarations and suffixes and all priors are counted
by grouped aggregation over all rows, each row weighted by what its text says,
and a row's own share is taken out of what it is judged by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from unitquarry.llm.common import attach, lower_ascii, slices, written

CELLS = 1 << 14
# Trigrams overlap: a text's log-likelihood counts with this share.
TEMPER = 0.3
STRENGTH = 20.0
SURE = 0.5
CHUNK_BYTES = 1 << 20
HELD_CELLS = 1 << 19
# A language with this many distinct cells has a full table, any other a list of the cells it has.
DENSE_CELLS = CELLS // 4
# Numbers that a task holds at a time in one matrix or one flush of sums.
HELD_NUMBERS = 1 << 21


def _folded() -> np.ndarray:
    """Bytes folded: A-Z to a-z, digits to one, everything in ASCII that is no letter to a blank."""
    table = np.full(256, 32, dtype=np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 48 if c.isdigit() else 32
    table[0x80:] = np.arange(0x80, 0x100)
    return table


def cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of every trigram of the texts (each between two blanks), number of trigrams and of letters per text."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    folded = _folded()[data]
    cell = ((folded[:-2] << 10) ^ (folded[1:-1] << 5) ^ folded[2:]) & (CELLS - 1)
    # Trigrams that reach into the next text are left out.
    starts = np.cumsum(size + 2) - (size + 2)
    use = np.ones(len(data), dtype=bool)
    use[starts + size], use[starts + size + 1] = False, False
    # Runs of blanks say nothing.
    use[:-2] &= ~((folded[:-2] == 32) & (folded[1:-1] == 32))
    use = use[:-2]
    letters = np.add.reduceat(((folded >= 97) & (folded <= 122) | (folded >= 0xC0)).astype(np.int64), starts) if len(texts) else size
    of = np.repeat(np.arange(len(texts)), size + 2)[:-2]
    return cell[use], np.bincount(of[use], minlength=len(texts)), letters


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHUNK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(text) + 64
    if begin < len(texts):
        yield begin, len(texts)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


@dataclass
class TextModel:
    """Log-probability of every cell in every language; its size grows with the cells that were seen, not with languages by cells.

    ``dense`` numbers the languages with a full table ``table`` (cells by
    languages).  The others, numbered by ``sparse``, have a probability for
    cells never seen, ``base``, and ``gain`` over it for the cells they have:
    those of a cell stand from ``begin[cell]`` on, of the language ``of``.
    """

    languages: list[str]
    dense: np.ndarray
    table: np.ndarray
    sparse: np.ndarray
    base: np.ndarray
    begin: np.ndarray
    of: np.ndarray
    gain: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        """The whole matrix, languages by cells."""
        out = np.empty((len(self.languages), CELLS))
        out[self.dense] = self.table.T
        rest = np.repeat(self.base[:, None], CELLS, axis=1)
        rest[self.of, np.repeat(np.arange(CELLS), np.diff(self.begin))] += self.gain
        out[self.sparse] = rest
        return out


def _model(languages: list[str], lang: np.ndarray, cell: np.ndarray, n: np.ndarray) -> TextModel:
    """From one entry per language and cell that were seen together."""
    languages = languages or ["und"]
    total = np.bincount(lang, weights=n, minlength=len(languages)) + 0.5 * CELLS
    full = np.bincount(lang, minlength=len(languages)) >= DENSE_CELLS
    dense, sparse = np.flatnonzero(full), np.flatnonzero(~full)
    at = np.where(full, np.cumsum(full), np.cumsum(~full)) - 1
    table = np.full((CELLS, len(dense)), 0.5)
    use = full[lang]
    table[cell[use], at[lang[use]]] += n[use]
    rest = np.flatnonzero(~use)
    rest = rest[np.argsort(cell[rest], kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(cell[rest], minlength=CELLS))])
    return TextModel(
        languages, dense, np.log(table / total[dense]), sparse, np.log(0.5 / total[sparse]), begin, at[lang[rest]].astype(np.int32), np.log1p(2 * n[rest]))


def train(examples: DataFrame) -> TextModel:
    """Trigram model of every language that a row of (text, lang) names, the most frequent first, counted over all these rows."""
    named = examples.filter(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    languages = [r["lang"] for r in named.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        keys, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            unique, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            names = pa.array(list(number), pa.string()).take(pa.array(unique // CELLS))
            return pa.RecordBatch.from_arrays([names, pa.array((unique % CELLS).astype(np.int32)), pa.array(n)], ["lang", "cell", "n"])

        for batch in slices(batches):
            of = np.array([number.setdefault(x, len(number)) for x in batch.column(1).to_pylist()], dtype=np.int64)
            texts = _bytes(batch.column(0))
            for a, b in chunks(texts):
                cell, size, _ = cells(texts[a:b])
                used, at = np.unique(of[a:b], return_inverse=True)
                n = np.bincount(np.repeat(at, size) * CELLS + cell, minlength=1)
                there = np.flatnonzero(n)
                keys.append(used[there // CELLS] * CELLS + there % CELLS)
                counts.append(n[there])
                held += len(there)
                if held > HELD_CELLS:
                    yield flush()
                    keys, counts, held = [], [], 0
        if held:
            yield flush()

    found = named.mapInArrow(run, "lang string, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    number = {x: i for i, x in enumerate(languages)}
    names = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    lang = np.array([number[x] for x in names.dictionary.to_pylist()], dtype=np.int64)[names.indices.to_numpy()]
    return _model(languages, lang, found.column("cell").to_numpy(), found.column("n").to_numpy())


def _rows_held(languages: int) -> int:
    """Rows whose evidence a task holds at a time."""
    return max(16, min(1024, HELD_NUMBERS // languages))


def _dense_evidence(log: np.ndarray, cell: np.ndarray, of: np.ndarray, model: TextModel) -> None:
    """Adds what the full tables say of the cells of text ``of`` (ascending) to ``log``."""
    step = max(1024, HELD_NUMBERS // len(model.dense))
    for at in range(0, len(cell), step):
        text = of[at : at + step]
        starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        log[np.ix_(text[starts], model.dense)] += np.add.reduceat(model.table[cell[at : at + step]], starts, axis=0)


def _sparse_evidence(log: np.ndarray, cell: np.ndarray, of: np.ndarray, model: TextModel) -> None:
    """The same of the languages with lists: each distinct cell of a text meets the languages that have it."""
    pair, count = np.unique(of * CELLS + cell, return_counts=True)
    text, cell = pair // CELLS, pair % CELLS
    found = model.begin[cell + 1] - model.begin[cell]
    size = np.bincount(text, weights=count, minlength=len(log))
    log[:, model.sparse] += size[:, None] * model.base
    ends = np.cumsum(found)
    at = 0
    while at < len(pair):
        # At least one cell at a time, which every language may have.
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD_NUMBERS, "right")))
        some = found[at:stop]
        first = np.cumsum(some) - some
        entry = np.repeat(model.begin[cell[at:stop]] - first, some) + np.arange(some.sum())
        low, high = text[at], text[stop - 1] + 1
        place = np.repeat(text[at:stop] - low, some) * len(model.sparse) + model.of[entry]
        gain = np.bincount(place, weights=model.gain[entry] * np.repeat(count[at:stop], some), minlength=(high - low) * len(model.sparse))
        log[low:high, model.sparse] += gain.reshape(high - low, len(model.sparse))
        at = stop


def text_evidence(texts: list[bytes], model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihood of each text in each language, and its letters."""
    log, letters = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), dtype=np.int64)
    for a, b in chunks(texts):
        cell, size, letters[a:b] = cells(texts[a:b])
        of = np.repeat(np.arange(b - a), size)
        if len(cell) and len(model.dense):
            _dense_evidence(log[a:b], cell, of, model)
        if len(cell) and len(model.sparse):
            _sparse_evidence(log[a:b], cell, of, model)
    return log * TEMPER, letters


def with_text_evidence(rows: DataFrame, model: TextModel) -> DataFrame:
    """``rows`` without ``text``, with _lid_text (log-likelihood per language) and _lid_letters; nothing is shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    at, count = rows.columns.index("text"), len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _rows_held(count)):
            log, letters = text_evidence(_bytes(batch.column(at)), sent.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, log.size + 1, count, dtype=np.int32)), pa.array(log.ravel()))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in rest], flat, pa.array(letters)],
                [*[batch.schema.names[i] for i in rest], "_lid_text", "_lid_letters"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    kind = T.StructType([*fields, T.StructField("_lid_text", T.ArrayType(T.DoubleType())), T.StructField("_lid_letters", T.LongType())])
    return rows.mapInArrow(run, kind)


def _share(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


@dataclass
class Statistics:
    """Weighted counts by language of declarations, address suffixes and hosts with the levels above them.

    Counts are arrays of (lang, mass): only languages that have any.
    """

    declared: DataFrame
    address: DataFrame
    hosts: DataFrame
    total: list[float]
    declarations: int
    addresses: int


KEYS = ("declared", "address", "host")
COUNTED = "kind int, key string, lang int, mass double"


def masses(rows: DataFrame, count: int) -> DataFrame:
    """kind (number in KEYS, or their number for all rows), key, lang, mass: what the texts of the rows of a key say, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        # One line of sums per key, as many as fit the bound.
        lines = max(2 * len(KEYS) + 2, HELD_NUMBERS // count)
        sums = np.zeros((lines, count))

        def flush() -> pa.RecordBatch:
            line, lang = np.nonzero(sums[: len(number)])
            kinds = np.fromiter((k for k, _ in number), dtype=np.int32, count=len(number))
            keys = pa.array([key for _, key in number], pa.string())
            out = pa.RecordBatch.from_arrays(
                [pa.array(kinds[line]), keys.take(pa.array(line)), pa.array(lang.astype(np.int32)), pa.array(sums[line, lang])], ["kind", "key", "lang", "mass"])
            number.clear()
            sums[:] = 0
            return out

        for batch in slices(batches, _rows_held(count)):
            own = _share(_matrix(batch.column(0), count)[0])
            for kind in range(len(KEYS) + 1):
                values = batch.column(1 + kind).to_pylist() if kind < len(KEYS) else [""] * len(own)
                known = [i for i, v in enumerate(values) if v is not None]
                # Rows go in parts that find room for all their keys.
                for a in range(0, len(known), lines):
                    part = known[a : a + lines]
                    if len(number) + len({values[i] for i in part}) > lines:
                        yield flush()
                    at = np.array([number.setdefault((kind, values[i]), len(number)) for i in part], dtype=np.int64)
                    np.add.at(sums, at, own[part])
        if number:
            yield flush()

    # Python sums rows of one task, Spark those of all.
    parts = rows.select("_lid_text", *[F.col(k).cast("string") for k in KEYS]).mapInArrow(run, COUNTED)
    return parts.groupBy("kind", "key", "lang").agg(F.sum("mass").alias("mass"))


def statistics(rows: DataFrame, count: int) -> Statistics:
    """From rows with _lid_text, declared, address, host."""
    every = written(masses(rows, count))
    listed = F.array_sort(F.collect_list(F.struct("lang", "mass")))

    def of(kind: int) -> DataFrame:
        return every.filter(F.col("kind") == kind)

    def by(kind: int, name: str) -> DataFrame:
        return written(of(kind).groupBy(F.col("key").alias(KEYS[kind])).agg(listed.alias(name)))

    def level(key: str, name: str) -> DataFrame:
        return lines.groupBy(key, "lang").agg(F.sum("mass").alias("mass")).groupBy(key).agg(listed.alias(name))

    lines = of(2).select(F.col("key").alias("host"), _domain(F.col("key")).alias("_domain"), _suffix(F.col("key")).alias("_suffix"), "lang", "mass")
    hosts = lines.groupBy("host", "_domain", "_suffix").agg(listed.alias("_lid_host"))
    full = hosts.join(level("_domain", "_lid_domain"), "_domain").join(level("_suffix", "_lid_suffix"), "_suffix")
    total = np.zeros(count)
    for r in of(len(KEYS)).collect():
        total[r["lang"]] = r["mass"]
    declared, address = by(0, "_lid_declared"), by(1, "_lid_address")
    return Statistics(
        declared, address, written(full.select("host", "_lid_host", "_lid_domain", "_lid_suffix")), total.tolist(),
        declared.count(), address.count())


COUNTS = ("_lid_declared", "_lid_address", "_lid_host", "_lid_domain", "_lid_suffix")


def with_counts(rows: DataFrame, stats: Statistics) -> DataFrame:
    """``rows`` (declared, address, host) with the counts of their evidence; null where there is none."""
    # An entry of a list takes 16 bytes, so a list counts twice in the size that is measured.
    joined = attach(rows, stats.declared, ["declared"], "left", "declared", *["_lid_declared"] * 2)
    joined = attach(joined, stats.address, ["address"], "left", "address", *["_lid_address"] * 2)
    return attach(joined, stats.hosts, ["host"], "left", "host", *["_lid_host", "_lid_domain", "_lid_suffix"] * 2)


def _matrix(column: pa.Array, count: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of lists (of numbers, or of lang and mass) as a matrix, with zeros where it is null, and where it is not."""
    has = ~column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), count))
    flat = column.drop_null().flatten()
    if pa.types.is_struct(flat.type):
        size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        out[np.repeat(np.arange(len(column)), size), flat.field("lang").to_numpy()] = flat.field("mass").to_numpy()
    else:
        out[has] = flat.to_numpy().reshape(-1, count)
    return out, has


def posteriors(log: np.ndarray, counts: dict[str, pa.Array], total: np.ndarray, kinds: dict[str, int]) -> np.ndarray:
    """Posterior of each row and language from the text's log-likelihoods and the counts of the other evidence."""
    n, languages = log.shape

    own = _share(log)
    found = {name: _matrix(column, languages) for name, column in counts.items()}
    # Each row's own share is taken out of what it is judged by.
    rest = np.maximum(total - own, 0)
    prior = (rest + 1) / (max(total.sum() - 1, 0) + languages)
    has = found["_lid_host"][1]
    for level in ("_lid_suffix", "_lid_domain", "_lid_host"):
        mass = np.maximum(found[level][0].sum(axis=1, keepdims=True) - 1, 0)
        leaned = (np.maximum(found[level][0] - own, 0) + STRENGTH * prior) / (mass + STRENGTH)
        prior = np.where(has[:, None], leaned, prior)
    log = log + np.log(prior)
    for name, several in kinds.items():
        count, has = found[name]
        log = log + np.where(has[:, None], np.log((np.maximum(count - own, 0) + 1) / (rest + several + 1)), 0.0)
    return _share(log)


def fuse(rows: DataFrame, stats: Statistics, model: TextModel) -> DataFrame:
    """``rows`` with _lid_language, _lid_posterior and _lid_letters added, and the columns of counts and text evidence dropped.

    ``rows`` come from ``with_counts`` and hold either _lid_text and
    _lid_letters or ``_lid_source``, the text itself.
    """
    languages = model.languages
    names = pa.array(languages)
    read = "_lid_source" in rows.columns
    sent = rows.sparkSession.sparkContext.broadcast(model if read else None)
    total, kinds = np.array(stats.total), {"_lid_declared": stats.declarations, "_lid_address": stats.addresses}
    kept = [f for f in rows.schema.fields if not f.name.startswith("_lid_") or f.name == "_lid_row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, _rows_held(len(languages))):
            of = {name: i for i, name in enumerate(batch.schema.names)}
            if read:
                log, letters = text_evidence(_bytes(batch.column(of["_lid_source"])), sent.value)
                letters = pa.array(letters)
            else:
                log, letters = _matrix(batch.column(of["_lid_text"]), len(languages))[0], batch.column(of["_lid_letters"])
            p = posteriors(log, {c: batch.column(of[c]) for c in COUNTS}, total, kinds)
            best = p.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(of[f.name]) for f in kept], names.take(pa.array(best)), pa.array(p[np.arange(len(p)), best]), letters],
                [*[f.name for f in kept], "_lid_language", "_lid_posterior", "_lid_letters"])

    added = [T.StructField("_lid_language", T.StringType()), T.StructField("_lid_posterior", T.DoubleType()), T.StructField("_lid_letters", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*kept, *added]))


def accepted(posterior: Column, letters: Column, sure: float = SURE) -> Column:
    """Whether a row's language is known: it has letters, and one language holds at least ``sure`` of the posterior."""
    return (letters > 0) & (posterior >= sure)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Language of every row of ``rows`` (text, declared, address, host and any ids).

    Returns the other columns with declared, address, host, language,
    posterior and kept.  Null or empty texts leave the decision to the other
    evidence and are not kept, as they have no letters; null declarations,
    addresses and hosts say nothing; repeated rows are judged alike; an empty
    table gives no rows.  Very long texts are read whole, as one text at a
    time.  Work grows with rows by languages that a trigram has been seen in,
    a row's evidence is one number per language.  Ids must not be called declared, address, host,
    language, posterior, kept or begin with _lid_.
    """
    seen = written(with_text_evidence(rows, model))
    stats = statistics(seen, len(model.languages))
    found = fuse(with_counts(seen, stats), stats, model)
    ids = [c for c in rows.columns if c != "text"]
    return found.select(
        *ids, F.col("_lid_language").alias("language"), F.col("_lid_posterior").alias("posterior"),
        accepted(F.col("_lid_posterior"), F.col("_lid_letters")).alias("kept"))


def keep_identified(docs: DataFrame, declared: str = "lang", host: str = "source") -> DataFrame:
    """Rows of ``docs`` (text, and the columns named) whose language is known; columns are those of ``docs``.

    The text model is trained on the declared languages.  For nulls, empty
    texts and repeated rows see ``identify``.
    """
    model = train(docs.select("text", F.col(declared).alias("lang")))
    evidence = [F.col(declared).cast("string").alias("declared"), F.lit(None).cast("string").alias("address"), F.col(host).cast("string").alias("host")]
    small = written(with_text_evidence(docs.select("text", *evidence), model))
    stats = statistics(small, len(model.languages))
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("_lid_row")
    rows = docs.select(whole, F.col("text").alias("_lid_source"), *evidence)
    judged = fuse(with_counts(rows, stats), stats, model)
    return judged.filter(accepted(F.col("_lid_posterior"), F.col("_lid_letters"))).select("_lid_row.*")


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, page_id, text and the evidence of documents: their declared language, and their source as host."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"),
        F.lit(None).cast("string").alias("address"), F.col("source").alias("host"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """The same of pages: the markup's lang attribute, the host, its suffix with a two-letter first part of the path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    first = lower_ascii(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    declared = lower_ascii(F.regexp_extract(F.coalesce("html", F.lit("")), r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    blank = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    text = F.regexp_replace(blank, r"&[A-Za-z0-9#]{1,10};", " ")
    known = host != ""
    return pages.select(
        F.lit(None).cast("bigint").alias("doc_id"), F.col("page_id").cast("bigint").alias("page_id"), text.alias("text"),
        F.nullif(declared, F.lit("")).alias("declared"), F.when(known, F.concat_ws("/", _suffix(host), first)).alias("address"), F.when(known, host).alias("host"))
