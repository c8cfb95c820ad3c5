import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from unitquarry.llm import html

BODY = ["The harbour of the town is one of the oldest on this coast, and for most of its life it was used by fishing boats that came in with the tide.",
        "In the winter of that year the wall gave way & the boats had to be moved to the river, where they were kept for as long as the work on it lasted.",
        "It is said that the builders found a chest of coins under the stones, but no record of it has been kept by the council or by the church."]
FRAME = {
    "article": "<nav><a href=/>Home</a> <a href=/a>About the of and</a></nav><article><header><h1>The old harbour</h1></header>{body}</article><footer>All rights of the town</footer>",
    "main": "<header>Town news of the day and more of the same as ever</header><main><h1>The old harbour</h1>{body}</main><aside>Read this too, it is about the sea and the land</aside>",
    "plain": "<div id=header>Town news</div><div class='menu'><ul><li><a href=/>Home</a><li><a href=/b>Boats</a></ul></div><div id=content><h1>The old harbour</h1>{body}</div><div class=footer>All rights of the town</div>",
    "comments": "<article><h1>The old harbour</h1>{body}</article><section id='comments'><article class='comment'><p>I was there and it is not true that the wall gave way in the winter.</p></article></section>",
    "notice": "<div class='cookie-notice'><p>This site uses cookies, and by the use of it you agree to that in all of its forms and for all of the time.</p></div><article><h1>The old harbour</h1>{body}<div class='ad'>Buy the boats of the year</div><form><label>Name</label><input></form><p class='share-links'>Share this</p></article>",
    "hidden": "<article><h1>The old harbour</h1>{body}<p hidden>the secret of it</p><p style='display: none'>not to be seen</p><noscript>no script</noscript></article>",
    "unclosed": "<article><h1>The old harbour</h1><b>{body}<script>var a = '<p>not text</p>';</script><style>p{{}}</style><!-- <p>comment</p> --></article><footer>end",
    "links": "<p><a href=1>One link</a> <a href=2>Another link of the site</a></p><h1>The old harbour</h1>{body}<ul><li><a href=3>More of it</a></li><li><a href=4>And more</a></li></ul>",
}


@pytest.mark.parametrize("frame", FRAME)
def test_article_without_its_surroundings(frame):
    body = "".join(f"<p>{t.replace('&', '&amp;')}</p>\n" for t in BODY)
    page = f"<!DOCTYPE html><html><head><title>Title</title></head><body class='has-sidebar'>{FRAME[frame].format(body=body)}</body></html>"
    assert html.main_text(page) == "\n\n".join(["The old harbour", *BODY])


def test_short_and_odd_blocks_of_an_article_stay():
    page = "<article><h2>x</h2><p>a | b | c</p><p>###&nbsp;%%%&#33;</p><ul><li>one<li>two</ul><table><tr><td>1<td>2</table><p>a<br>b  \n c</p>1 < 2 <3</article>"
    assert html.main_text(page) == "x\n\na | b | c\n\n### %%%!\n\none\n\ntwo\n\n1 2\n\na b c\n\n1 < 2 <3"


def test_short_blocks_between_good_ones_inherit():
    page = f"<div><p>{BODY[0]}</p><p>Yes.</p><p>{BODY[1]}</p></div><div class=footer><p>No.</p></div><p>Maybe.</p>"
    assert html.main_text(page) == "\n\n".join([BODY[0], "Yes.", BODY[1]])
    assert html._settle([1, 0, 0, -1], [False] * 4) == [1, 1, -1, -1]
    assert html._settle([-1, 0, 1], [False, True, False]) == [-1, 1, 1]
    assert html._settle([0, 0], [False] * 2) == [1, 1]


@pytest.mark.parametrize("page", ["", None, "<", "<a", "<!--", "<!-- x", "<script>", "<p", "</p></p>", "<p class='x", "&", "&#xD800;&#0;", "<" * 3000, "<p>" * 3000,
                                  "<div>" * 2000 + "x", "<!--" * 5000, "<a href='" * 3000, "<script>" * 3000, "\x00<p>\x00", "<b class=ad>x</p></b>", "İ<script>İ</script>"])
def test_any_markup_is_read(page):
    assert isinstance(html.main_text(page), str)


def test_table(spark):
    long = "<article>" + "".join(f"<p>{BODY[i % 3]}</p>" for i in range(5000)) + "</article>"
    rows = [(1, "u", f"<p>{BODY[0]}</p>"), (1, "u", f"<p>{BODY[0]}</p>"), (None, None, None), (2, "v", ""), (3, "w", long)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = html.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", len(BODY[0]))] * 2 + [("2", 0), ("3", sum(len(BODY[i % 3]) + 2 for i in range(5000)) - 2), ("None", 0)]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("card", ["<article class=card><h3>Boats</h3><p>Short teaser.</p></article>", "<main class=card><p>Short teaser.</p></main>"])
def test_a_card_article_does_not_drop_the_body(card):
    body = f"<div id=content><h1>The old harbour</h1><p>{BODY[0]}</p><p>Yes.</p><p>{BODY[1].replace('&', '&amp;')}</p><p>{BODY[2]}</p></div>"
    for page in (f"<nav><a href=/>Home</a></nav>{body}{card}", f"{card}{body}<footer>All rights</footer>"):
        got = html.main_text(page).split("\n\n")
        assert [t for t in got if t not in ("Boats", "Short teaser.")] == ["The old harbour", BODY[0], "Yes.", BODY[1], BODY[2]]


def test_short_blocks_around_an_article_stay_outside():
    page = f"<div>Town news</div><article><p>{BODY[0]}</p></article><div>Printed in the town</div>"
    assert html.main_text(page) == BODY[0]


def plain_first(length, links, stops, inside, heading):
    if links > 0.5:
        return 0 if inside and heading else -1
    if length < 70 or heading:
        return -1 if links > 0.2 and not inside else 0
    enough = stops >= (0.1 if inside else 0.3)
    return 1 if enough and (length >= 200 or links <= 0.2) else 0


def plain_second(labels, headings):
    """Every ambiguous block looks at all others."""
    out = []
    for i, x in enumerate(labels):
        if x:
            out.append(x)
            continue
        if 1 not in labels:
            out.append(1)
            continue
        up = [(i - j, labels[j]) for j in range(i) if labels[j]]
        down = [(j - i, labels[j]) for j in range(i + 1, len(labels)) if labels[j]]
        a, b = min(up, default=(10**9, 0)), min(down, default=(10**9, 0))
        if not up or not down:
            out.append(a[1] or b[1])
        elif headings[i]:
            out.append(b[1] if b[0] <= a[0] else a[1])
        else:
            out.append(a[1] if a[0] < b[0] else b[1] if b[0] < a[0] else max(a[1], b[1]))
    return out


def plain_decide(blocks):
    """``blocks``: length, links, stops, inside, heading, aside."""
    first = [-1 if b[5] else plain_first(*b[:5]) for b in blocks]
    pick = lambda ids: plain_second([first[i] for i in ids], [blocks[i][4] for i in ids])
    out = pick(range(len(blocks)))
    inside = [i for i, b in enumerate(blocks) if b[3] and not b[5]]
    if inside:
        for i, x in zip(inside, pick(inside)):
            out[i] = x
        outside = [i for i, b in enumerate(blocks) if not b[3]]
        apart = pick(outside) if 1 in [first[i] for i in outside] else [-1] * len(outside)
        for i, x in zip(outside, apart):
            if not blocks[i][4]:
                out[i] = x
    return out


def test_both_passes_equal_a_plain_version(monkeypatch):
    rnd = random.Random(9)
    for _ in range(3000):
        made = [(rnd.choice([5, 69, 70, 150, 200, 900]), rnd.choice([0, 0.2, 0.21, 0.5, 0.51, 1]), rnd.choice([0, 0.1, 0.29, 0.3]),
                 rnd.random() < 0.5, rnd.random() < 0.2, rnd.random() < 0.15) for _ in range(rnd.randint(0, 9))]
        blocks, texts = [], []
        for i, (length, links, stops, inside, heading, aside) in enumerate(made):
            block = html.Block(aside, inside, heading)
            block.linked = links * length
            blocks.append(block)
            texts.append(str(i) + "x" * (length - 1))
        monkeypatch.setattr(html, "stop_share", lambda t, made=made: made[int(t[0])][2])
        assert html._decide(blocks, texts) == plain_decide(made)


def test_link_lists_of_an_article_are_left_out():
    page = f"<article><h1><a href=#t>Title</a></h1><p>{BODY[0]}</p><ul><li><a href=/1>More on the boats of the town</a><li><a href=/2>The sea</a></ul><p>{BODY[2]}</p></article>"
    assert html.main_text(page) == "\n\n".join(["Title", BODY[0], BODY[2]])


@pytest.mark.parametrize("name", ["werbung", "kommentare", "publicite", "commentaires", "publicidad", "comentarios"])
def test_names_of_other_languages(name):
    assert html.main_text(f"<article><p>{BODY[0]}</p><div class='{name}'><p>{BODY[1]}</p></div></article>") == BODY[0]


def test_stop_words_length_and_links_decide_blocks_of_the_tables(monkeypatch):
    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet", columns=["html"]).column(0).to_pylist()

    def decided():
        labels = []
        for page in pages:
            blocks = [(b, " ".join("".join(b.parts).split())) for b in html.blocks_of(page or "") if not b.bad]
            labels += [html._label(b, t) for b, t in blocks]
        return labels.count(html.GOOD), labels.count(html.OPEN)

    good, open_ = decided()
    assert good > 0 and open_ > 0
    monkeypatch.setattr(html, "STOP_WORDS", frozenset())
    assert decided() == (0, good + open_)


@pytest.mark.parametrize("piece", ["<a href='", "<a ", "<script>", "<div></p>", "<script x>", "<!--", "<b class=ad>", "<a '>", '<a ">"'])
def test_time_grows_with_the_page(piece):
    def took(n):
        start = time.perf_counter()
        html.main_text(piece * n)
        return time.perf_counter() - start

    took(1000)
    assert took(80_000) < 8 * took(20_000) + 0.5
