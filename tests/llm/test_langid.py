import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import langid

WORDS = {"en": "the boat and with this that from shall would".split(), "de": "der und nicht über schön für das auch".split(), "fr": "le être avec où très des une façon".split()}


def sentence(lang, i):
    return " ".join(WORDS[lang][(i * 5 + j * j) % len(WORDS[lang])] for j in range(4 + i % 9))


@pytest.fixture
def docs(spark):
    rows = [(i, sentence(("en", "de", "fr")[i % 3], i), ("en", "de", "fr")[i % 3], f"s{i % 3}" if i % 2 else "hot") for i in range(300)]
    rows += [(900, sentence("de", 4), None, None), (901, None, "en", "s0"), (902, "", "en", "hot"), (903, "12 34 !!", None, None), (None, sentence("fr", 2), "fr", "s2"),
             (904, "the boat", "en", "s0"), (904, "the boat", "en", "s0"), (905, sentence("en", 3) * 5000, "en", "s1")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumns(
        {"language": F.lit(1), "host": F.lit(0), "declared": F.lit("x"), "_0": F.lit(0)})


def plain_identify(rows, model):
    """Posterior of every (text, declared, address, host) with all counts by loops."""
    n = len(model.languages)

    def soft(x):
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    logs = []
    for text, *_ in rows:
        data = b" " + (text or "").encode() + b" "
        f = langid._folded()[np.frombuffer(data, dtype=np.uint8)]
        log = [0.0] * n
        for a, b, c in zip(f, f[1:], f[2:]):
            if not (a == 32 and b == 32):
                for m in range(n):
                    log[m] += langid.TEMPER * model.weights[m, ((a << 10) ^ (b << 5) ^ c) & (langid.CELLS - 1)]
        logs.append(log)
    own = [soft(x) for x in logs]
    suffix, domain = (lambda h: h.split(".")[-1]), (lambda h: ".".join(h.split(".")[-2:]))
    out = []
    for i, (_, declared, address, host) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]

        def count(m, fits):
            return sum(own[j][m] for j in others if fits(rows[j]))

        full = []
        for m in range(n):
            rest = count(m, lambda r: True)
            prior = (rest + 1) / (len(others) + n)
            if host is not None:
                for fits in (lambda r: r[3] is not None and suffix(r[3]) == suffix(host), lambda r: r[3] is not None and domain(r[3]) == domain(host), lambda r: r[3] == host):
                    prior = (count(m, fits) + langid.STRENGTH * prior) / (sum(fits(rows[j]) for j in others) + langid.STRENGTH)
            log = logs[i][m] + math.log(prior)
            for at, value in ((1, declared), (2, address)):
                if value is not None:
                    kinds = len({r[at] for r in rows if r[at] is not None})
                    log += math.log((count(m, lambda r: r[at] == value) + 1) / (rest + kinds + 1))
            full.append(log)
        p = soft(full)
        out.append((model.languages[p.index(max(p))], max(p)))
    return out


def test_fusion_against_brute_force(spark, docs):
    model = langid.train(docs.select("text", "lang"))
    rows = [(sentence(l, i)[: 3 + i], d, a, h) for i, (l, d, a, h) in enumerate(
        [("en", "en", "com/en", "www.a.com"), ("en", "en", "com/en", "m.a.com"), ("de", "de", "com/de", "b.com"), ("de", None, "de", "x.b.de"), ("fr", "en", None, "www.a.com"),
         ("fr", "fr", "fr", "c.fr"), ("en", None, None, None), ("fr", "fr", "fr", "c.fr"), ("de", "de", "de", "hot"), ("de", "de", None, "hot")])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, text string, declared string, address string, host string")
    got = {r.i: (r.language, r.posterior) for r in langid.identify(df, model).collect()}
    for i, (lang, p) in enumerate(plain_identify(rows, model)):
        assert got[i] == (lang, pytest.approx(p))


def test_documents_keep_their_language(spark, docs):
    plain = docs.drop("language", "host", "declared")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    lost = set(r.doc_id for r in docs.collect()) - set(r.doc_id for r in kept.collect())
    assert lost == {901, 902, 903}
    assert kept.filter("doc_id = 904").count() == 2
    model = langid.train(plain.select("text", "lang"))
    found = {r.doc_id: r.language for r in langid.identify(langid.document_evidence(plain), model).collect()}
    assert all(found[i] == ("en", "de", "fr")[i % 3] for i in range(300))
    assert found[900] == "de" and found[905] == "en"


def test_page_evidence(spark):
    rows = [(1, "https://M.Example.COM/FR/x", "<html class=a lang='fr-CA'><style>x</style><p>le&amp;la"), (2, "nowhere", None), (None, None, "<HTML LANG=de>"), (3, "http://a.org/french/", "<p lang=es>")]
    got = langid.page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert [(r.declared, r.address, r.host) for r in got] == [("fr", "com/fr", "m.example.com"), (None, None, None), ("de", None, None), (None, "org/", "a.org")]
    assert got[0].text.split() == ["le", "la"]


def test_empty_tables(spark, docs):
    assert langid.keep_identified(docs.limit(0)).count() == 0
    nothing = langid.train(docs.select("text", F.lit(None).cast("string").alias("lang")))
    assert nothing.languages == ["und"]
    assert langid.keep_identified(docs.withColumn("lang", F.lit(None).cast("string"))).count() == docs.count() - 3


def test_every_declared_language_has_a_model(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    rows = [(100 * m + i, " ".join(f"{letters[m]}{'aeiou'[(i + j) % 5]}{letters[m]}{'eo'[j % 2]}" for j in range(12)), f"l{m:02}", None) for m in range(20) for i in range(25 - m)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = langid.train(docs.select("text", "lang"))
    assert model.languages == [f"l{m:02}" for m in range(20)]
    found = langid.identify(langid.document_evidence(docs), model).collect()
    assert all(r.language == f"l{r.doc_id // 100:02}" and r.kept for r in found)
    assert langid.keep_identified(docs).count() == len(rows)


def test_model_in_lists_and_tables(spark, docs, monkeypatch):
    """Whatever has a full table, the model is the plain one."""
    rows = [(r.text or "", r.lang) for r in docs.select("text", "lang").collect() if r.lang is not None]
    plain = {}
    for text, lang in rows:
        f = langid._folded()[np.frombuffer(b" " + text.encode() + b" ", dtype=np.uint8)]
        counts = plain.setdefault(lang, np.full(langid.CELLS, 0.5))
        for a, b, c in zip(f, f[1:], f[2:]):
            if not (a == 32 and b == 32):
                counts[((a << 10) ^ (b << 5) ^ c) & (langid.CELLS - 1)] += 1
    texts = [r[0].encode() for r in rows[::7]] + [b"", "schön über".encode() * 300]
    found = []
    for dense in (1, 60, langid.CELLS):
        monkeypatch.setattr(langid, "DENSE_CELLS", dense)
        model = langid.train(docs.select("text", "lang"))
        for m, lang in enumerate(model.languages):
            assert np.allclose(model.weights[m], np.log(plain[lang] / plain[lang].sum()))
        for held in (1 << 21, 50):
            monkeypatch.setattr(langid, "HELD_NUMBERS", held)
            found.append(langid.text_evidence(texts, model)[0])
    assert all(np.allclose(found[0], x) for x in found[1:])


def test_sums_that_do_not_fit_a_task_at_once(spark, docs, monkeypatch):
    model = langid.train(docs.select("text", "lang"))
    once = {r.doc_id: r.posterior for r in langid.identify(langid.document_evidence(docs), model).collect()}
    monkeypatch.setattr(langid, "HELD_NUMBERS", 8)
    parts = {r.doc_id: r.posterior for r in langid.identify(langid.document_evidence(docs), model).collect()}
    assert parts == pytest.approx(once)


def test_two_thousand_declared_values(spark):
    """Every value has its model; cost and memory stay bounded."""
    rows = [(i, " ".join(f"w{(i % 2000) * 7 + j}x{chr(97 + i % 26)}" for j in range(6)), f"v{i % 2000}", f"h{i % 9}.example.org") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(8)
    model = langid.train(docs.select("text", "lang"))
    assert len(model.languages) == 2000
    assert model.table.size == 0 and len(model.gain) < 200 * 2000
    assert langid.keep_identified(docs).columns == docs.columns
    found = langid.identify(langid.document_evidence(docs), model)
    assert found.count() == 6000
