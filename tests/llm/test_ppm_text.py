import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from unitquarry.llm import ppm, ppm_text


class PlainTrie:
    """PPM over whole texts with update exclusion, escape method D and symbol exclusion, byte by byte."""

    def __init__(self, texts):
        level = Counter(g for t in texts for g in grams(t))
        self.follow = defaultdict(Counter)
        for size in range(ppm.ORDER, -1, -1):
            for (context, byte), n in level.items():
                self.follow[context][byte] += n
            level = Counter((context[1:], byte) for context, byte in level) if size else level

    def log10(self, text):
        total = 0.0
        for context, byte in grams(text):
            out = set()
            while True:
                left = {b: n for b, n in self.follow.get(context, {}).items() if b not in out}
                room = sum(left.values())
                if byte in left:
                    total += math.log10((left[byte] - 0.5) / room)
                    break
                if left:
                    total += math.log10(len(left) / 2 / room)
                out |= set(left)
                if not context:
                    total -= math.log10(256 - len(out))
                    break
                context = context[1:]
        return total


def grams(text):
    coded = b"\xfe" * ppm.ORDER + (text or "").encode() + b"\xff"
    return [(coded[i - ppm.ORDER : i], coded[i]) for i in range(ppm.ORDER, len(coded))]


TEXTS = [
    (i, " ".join(f"{'the of and sur les auf'.split()[(i * j) % 6]} {'ba be bo ti'.split()[j % 4]}{'na no'.split()[i % 2]}{j % 5}" for j in range(1 + i % 17)),
     ("en", "fr", None)[i % 3]) for i in range(90)]
TEXTS += [(200, None, "en"), (201, "", "fr"), (202, " \t\x0b", None), (None, "THE End of\x0bit", "en"), (203, "same row", "fr"), (203, "same row", "fr"),
          (204, "é" * 3000 + " x" * 500 + " y", "xx"), (205, "quite\x00new wörds \U0001f600\n", "en"), (6, "Ünder THE", "de")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string, lang string").withColumns(
        {"word": F.lit(1), "n": F.lit("x"), "held": F.lit(0), "row": F.lit(0), "s0": F.lit(0), "by": F.lit(1), "gram": F.lit(1)})


@pytest.mark.parametrize("hot", [1 << 20, 3])
def test_scores_against_a_plain_coder(spark, docs, hot, monkeypatch):
    for name, value in (("HOT_WORDS", hot), ("HOT_GRAMS", hot), ("PIECE", 1000 if hot == 3 else 1 << 20), ("HELD_GRAMS", 40), ("BLOCK_GRAMS", 10)):
        monkeypatch.setattr(ppm_text, name, value)
    got = sorted(ppm_text.score(docs, ppm.bucket_of(F.col("doc_id"), 7) == 2).collect(), key=lambda r: (str(r.doc_id), r.score))
    langs = list(dict.fromkeys(lang for i, _, lang in TEXTS if not held(i)))
    learned = {lang: [t for i, t, x in TEXTS if x == lang and not held(i)] for lang in langs}
    whole = Counter(w for texts in learned.values() for t in texts for w in ppm.tokens(t))
    n, v, all_texts = sum(whole.values()), len(whole), sum(map(len, learned.values()))
    tries = {lang: PlainTrie(texts) for lang, texts in learned.items()}
    want = []
    for i, text, _ in TEXTS:
        words = ppm.tokens(text)
        parts = [math.log10(len(learned[lang]) / all_texts) + tries[lang].log10(text) for lang in langs]
        mixed = max(parts) + math.log10(sum(10 ** (p - max(parts)) for p in parts))
        want.append((i, held(i), len(words), sum(w in whole for w in words), n, sum(math.log10((whole[w] + 1) / (n + v + 1)) for w in words), mixed))
    want.sort(key=lambda r: (str(r[0]), r[6]))
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want])
    assert [r.score for r in got] == pytest.approx([w[6] for w in want])


def test_contexts_cross_spaces(spark, tmp_path):
    from unitquarry.llm.queries import QUERIES

    # Document 6 is held out, and so is 11; they have the same words in another order.
    rows = [(i, "in the old town by the sea", "en") for i in range(100, 140)] + [(6, "by the sea in the old town", "en"), (11, "town the by sea old in the", "en")]
    assert held(6) and held(11)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op2_ppm_score"](spark, str(tmp_path)).collect()}
    assert got[6].base_score == pytest.approx(got[11].base_score)
    assert got[6].score > got[11].score + 3


def test_empty_table_and_nothing_to_learn_from(spark, docs):
    assert ppm_text.score(docs.limit(0), F.lit(False)).count() == 0
    r = ppm_text.score(docs.filter("doc_id = 203"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
    assert r.score == pytest.approx(-math.log10(256) * 9)


def test_trie_as_a_table_leaves_nothing_out(spark, docs, monkeypatch):
    monkeypatch.setattr(ppm_text, "BLOCK_GRAMS", 10)
    counted = ppm_text.gram_counts(docs.select("text", F.lit(0).cast("int").alias("cls")), 1)
    whole = PlainTrie([t for _, t, _ in TEXTS])
    costs = {r.gram: r.s0 for r in ppm_text.prices(counted, 1).collect()}
    assert len(costs) == len({g for _, t, _ in TEXTS for g in grams(t)}) > 60
    for _, text, _ in TEXTS[:20] + TEXTS[-9:]:
        got = sum(costs[int.from_bytes(context + bytes((byte,)), "big")] for context, byte in grams(text))
        assert got == pytest.approx(whole.log10(text))
