import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from unitquarry.llm import urlfilter
from unitquarry.llm.queries import URL_RULES


def plain_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [(h + p, act) for act, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


class PlainModel:
    """Interpolated Witten-Bell over symbols, as a recursion."""

    def __init__(self, shapes):
        self.grams, self.total, self.kinds = Counter(), Counter(), Counter()
        for shape, n in shapes:
            for at in range(1, len(shape)):
                for size in range(1, urlfilter.ORDER + 2):
                    if at + 1 >= size:
                        self.grams[shape[at + 1 - size : at + 1]] += n
        for gram, n in self.grams.items():
            if n:
                self.total[gram[:-1]] += n
                self.kinds[gram[:-1]] += 1

    def p(self, context, symbol):
        lower = self.p(context[1:], symbol) if context else 1 / urlfilter.SYMBOLS
        n, d = self.total[context], self.kinds[context]
        return (self.grams[context + symbol] + d * lower) / (n + d) if n else lower


URLS = [f"https://www.site{i % 9}.example.org/fr/{i}" for i in range(60)] + [
    f"http://casino-win{i}.example.com/x/{i}?q=1" for i in range(20)] + [f"http://blog.ab{'cdefg'[i % 5]}.example.com/en/{i}#top" for i in range(40)] + [
    None, "", "no scheme at all", "http://", "HTTP://ExAmple.NET", "http://a.net/x://y", "ftp://Example.Net/en/Page?x", "http://example.com/de/1",
    "http://notnet/", "http://net/x", "x://h\nost.net/\npath?", "http://ÄÖ.org/fr/ü", "http://free-bets.example.org/fr/2", "http://" + "a" * 5000 + ".com/" + "b/" * 3000]


@pytest.fixture
def pages(spark):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (1, URLS[1])]
    return spark.createDataFrame(rows, "page_id bigint, url string").withColumns(
        {"host": F.lit("clash"), "rule": F.lit(1), "shape": F.lit(1), "score": F.lit("x"), "gram": F.lit(0)})


def test_parts_rules_and_verdicts(spark, pages):
    got = urlfilter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        host, path = plain_parse(URLS[0] if r.page_id is None else URLS[r.page_id])
        rule, act = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == act if act else r.verdict in ("allow", "block")
        if not act and "casino" in host:
            assert r.verdict == "block"
        if not act and host.startswith("blog"):
            assert r.verdict == "allow"


def test_short_words_count_as_whole_parts_only(spark):
    good = [f"https://{h}.example.com/en/{i}" for i in range(40) for h in ("uploads", "roads", "alphabets")]
    bad = [f"https://www.{h}.example.org/en/{i}" for i in range(40) for h in ("spam-farm", "cheap-pills", "x.ads")]
    pages = spark.createDataFrame(list(enumerate(good + bad)), "page_id bigint, url string")
    got = {r.page_id: r.verdict for r in urlfilter.judge_urls(pages, URL_RULES).collect()}
    assert [got[i] for i in range(len(good + bad))] == ["allow"] * len(good) + ["block"] * len(bad)


def test_scores_against_a_plain_model(spark):
    good = [("^blog.abc/en/0$", 5), ("^www.site0.org/fr/0$", 7), ("^a-b.com/$", 1)]
    bad = [("^casino-win0.com/x/0$", 4), ("^free-bets.org/$", 2)]
    rows = [(s, n, 0) for s, n in good] + [(s, 0, n) for s, n in bad]
    model = urlfilter.train(spark.createDataFrame(rows, "shape string, accepted bigint, rejected bigint"))
    shapes = [s for s, *_ in rows] + ["^casino-blog.com/fr/0$", "^*$", "^$", "^zzz_q$"]
    got = dict(urlfilter.ratio(spark.createDataFrame([(s,) for s in shapes], "shape string"), model).collect())
    a, r = PlainModel(good), PlainModel(bad)
    for s in shapes:
        marks = [math.log(r.p(s[max(0, i - 3) : i], s[i]) / a.p(s[max(0, i - 3) : i], s[i])) for i in range(1, len(s))]
        assert got[s] == pytest.approx(sum(marks) / len(marks)), s


def test_empty_table_and_plan(spark, pages):
    assert urlfilter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    plan = urlfilter.judge_urls(pages, URL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
