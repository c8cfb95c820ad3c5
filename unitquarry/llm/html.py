"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags; what the markup itself names as
menu, form, notice, advert or comment is set aside.  The first pass looks at
each other block alone: its link density, its length and its share of stop
words make it good, bad or ambiguous, inside the article element as outside it
(inside, fewer stop words do).  The second pass settles ambiguous blocks by
their nearest decided neighbours.  Pages are independent, so the work is one
pass over the table; a page takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Fixed word lists: the most frequent function words of four languages.
STOP_WORDS = frozenset(
    """the of and to in is that it for was on are as with be by at this from or an have not which were but had has their been its they you
    der die das und ist von den mit im für auf ein eine nicht sich des dem zu als auch es an werden aus er hat dass sie nach bei wird sind
    le la les de des du et un une que qui dans pour sur par est au aux avec ce pas il ne se plus son en sont ou
    el los las del y en una por con para como su al lo se es no más pero sus le ha este""".split())
# Fixed names of tags.
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4
    h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul
    caption""".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template svg math iframe object textarea select title canvas audio video map datalist".split())
OUTSIDE = frozenset("nav aside footer form menu dialog head search button fieldset".split())
OWN_END = frozenset(["p", "li", "dt", "dd", "tr", "option", "head"])
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
MARKS = frozenset(
    """ad ads advert advertisement advertising banner promo promotion sponsor sponsored sidebar rail menu nav navbar navigation breadcrumb breadcrumbs
    footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup
    login share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies discussion widget
    pagination pager toolbar searchbox copyright legal disclaimer skip hidden teaser outbrain taboola
    werbung anzeige anzeigen kommentar kommentare leserkommentare seitenleiste kopfzeile fusszeile hinweis teilen verwandte
    publicite annonce annonces commentaire commentaires partager avis pied menus
    publicidad anuncio anuncios comentario comentarios compartir aviso cabecera pie""".split())
TALK = frozenset(
    """comment comments commentlist disqus respond reply replies discussion kommentar kommentare leserkommentare commentaire commentaires
    comentario comentarios""".split())
ABOUT_PAGE = frozenset("content main page wrap wrapper container layout body post article entry has with".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)

SHORT, LONG = 70, 200
STOPS, STOPS_INSIDE, LINKS, FEW_LINKS = 0.3, 0.1, 0.5, 0.2
GOOD, BAD, OPEN = 1, -1, 0

# After so many tags with open quotes a page's quotes are not followed any more: each had to be read to the page's end.
BROKEN = 64


class Block:
    __slots__ = ("parts", "linked", "bad", "main", "heading")

    def __init__(self, bad: bool, main: bool, heading: bool) -> None:
        self.parts: list[str] = []
        self.linked = 0
        self.bad, self.main, self.heading = bad, main, heading


def _surroundings(tag: str, attributes: str, bad: int, main: bool) -> tuple[int, bool]:
    """Of an element inside another: 2 for outside the article by its tag, 1 by a name or role, 0 otherwise; and whether in the main part."""
    names: set[str] = set()
    hidden = False
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                names.update(_NAME.findall(value))
            elif key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                hidden = True
            elif key == "style" and _HIDDEN.search(value):
                hidden = True
    if tag in ("html", "body"):
        return bad, main
    marked = names & MARKS
    if main and not marked & TALK:
        # The article's own header is a part of it.
        marked = marked - {"header", "banner", "masthead"}
    if marked and names & ABOUT_PAGE and not marked & TALK:
        marked = marked - {"sidebar", "rail", "header", "footer", "nav", "menu", "banner", "navbar", "widget", "legal", "notice", "related"}
    if hidden or tag in OUTSIDE or tag == "header" and not main:
        return 2, main
    if tag in ("main", "article") and not names & TALK:
        return (bad if bad == 2 or tag == "article" else 0), True
    return max(bad, 1 if marked else 0), main


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, with the text as written, those without text left out."""
    found: list[Block] = []
    # Open elements as (tag, bad, main).
    stack: list[tuple[str, int, bool]] = []
    bad, main, link, block = 0, False, -1, None
    at, size = 0, len(page)
    # Behind the last ">" no tag ends, and an end tag that is not there is looked for once.
    last = page.rfind(">")
    lower, missing, open_tags, broken = "", set(), Counter(), 0

    def leave(tag: str) -> None:
        nonlocal bad, main
        while stack:
            name, bad, main = stack.pop()
            open_tags[name] -= 1
            if name == tag:
                break

    def text(piece: str) -> None:
        nonlocal block
        if not piece:
            return
        if block is None:
            if piece.isspace():
                return
            block = Block(bad > 0, main, any(t in HEADINGS for t, _, _ in stack[-3:]))
            found.append(block)
        block.parts.append(piece)
        if link >= 0:
            block.linked += len(piece.strip())

    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            text(page[at:])
            break
        if mark > at:
            text(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), mark):
            end = page.find(">", mark)
            at = size if end < 0 else end + 1
            continue
        m = _TAG.match(page, mark) if mark < last and broken < BROKEN else None
        if not m and mark < last:
            m = _LOOSE_TAG.match(page, mark)
            broken += m is not None
        if not m:
            text("<")
            at = mark + 1
            continue
        at = m.end()
        closes, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in UNSEEN:
            if not closes and not attributes.endswith("/") and tag not in missing:
                lower = lower or page.lower()
                end = lower.find(f"</{tag}", at) if len(lower) == size else -1
                if end < 0:
                    again = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, at)
                    end = again.start() if again else -1
                close = page.find(">", end) if end >= 0 else -1
                if close >= 0:
                    at = close + 1
                else:
                    missing.add(tag)
            continue
        if tag == "a":
            link = -1 if closes else len(stack)
            continue
        if tag in ("br", "td", "th", "img"):
            text(" ")
            continue
        if tag not in BLOCK and tag not in OUTSIDE:
            if not closes and attributes and tag not in VOID:
                inner, inner_main = _surroundings(tag, attributes, bad, main)
                if inner > bad:
                    # A hidden or marked inline element stands apart like a block.
                    stack.append((tag, bad, main))
                    open_tags[tag] += 1
                    bad, main, block = inner, inner_main, None
            elif closes and open_tags[tag]:
                leave(tag)
                block = None
            continue
        block = None
        if closes:
            if open_tags[tag]:
                leave(tag)
                if link > len(stack):
                    link = -1
            continue
        # A new block ends an open paragraph; items end items of their kind.
        while stack and (stack[-1][0] in ("p", "head") and tag != "html" or stack[-1][0] == tag and tag in OWN_END):
            leave(stack[-1][0])
        if link > len(stack):
            link = -1
        if tag in VOID:
            continue
        stack.append((tag, bad, main))
        open_tags[tag] += 1
        bad, main = _surroundings(tag, attributes, bad, main)
    return found


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / max(1, len(words))


def label(length: int, links: float, stops: float, inside: bool, heading: bool) -> int:
    """First pass: one block alone, by its length, its share of linked text and its share of stop words.

    Mostly linked text is bad, but for headings inside, which often link to
    themselves.  Short blocks and headings are ambiguous, and bad with some
    links outside.  Other blocks are good with stop words enough and few
    links, or much text.
    """
    if links > LINKS:
        return OPEN if inside and heading else BAD
    if heading or length < SHORT:
        return BAD if links > FEW_LINKS and not inside else OPEN
    if stops >= (STOPS_INSIDE if inside else STOPS):
        return GOOD if length >= LONG or links <= FEW_LINKS else OPEN
    return OPEN


def _label(block: Block, text: str) -> int:
    return BAD if block.bad else label(len(text), min(1.0, block.linked / max(1, len(text))), stop_share(text), block.main, block.heading)


def _settle(labels: list[int], headings: list[bool]) -> list[int]:
    """Second pass: an ambiguous block takes the label of the nearest decided block.

    At equal distance a heading follows the block below it, any other block is
    good if one of the two is.  Without any good block all ambiguous ones are.
    """
    if GOOD not in labels:
        return [GOOD if x == OPEN else x for x in labels]
    n, none = len(labels), len(labels) + 1
    above, below = [(none, OPEN)] * n, [(none, OPEN)] * n
    far = (none, OPEN)
    for i in range(n):
        far = (0, labels[i]) if labels[i] else (far[0] + 1, far[1])
        above[i] = far
    far = (none, OPEN)
    for i in range(n - 1, -1, -1):
        far = (0, labels[i]) if labels[i] else (far[0] + 1, far[1])
        below[i] = far
    out = []
    for i, x in enumerate(labels):
        (up, a), (down, b) = above[i], below[i]
        if x or up == down == 0:
            out.append(x)
        elif a == OPEN or b == OPEN:
            out.append(a or b)
        elif headings[i]:
            out.append(b if down <= up else a)
        else:
            out.append(a if up < down else b if down < up else max(a, b))
    return out


def _decide(blocks: list[Block], texts: list[str]) -> list[int]:
    """Both passes over the blocks of a page.

    On a page with an article or main element ambiguous blocks inside take
    their neighbours from inside, where blocks set aside by the markup are
    gone, and ambiguous ones outside, other than headings, from outside, so
    that neither draws in the other.
    """
    first = [_label(b, t) for b, t in zip(blocks, texts, strict=True)]
    headings = [b.heading for b in blocks]
    inside = [i for i, b in enumerate(blocks) if b.main and not b.bad]
    labels = _settle(first, headings)
    if inside:
        for i, x in zip(inside, _settle([first[i] for i in inside], [headings[i] for i in inside]), strict=True):
            labels[i] = x
        outside = [i for i, b in enumerate(blocks) if not b.main]
        apart = [first[i] for i in outside]
        apart = _settle(apart, [headings[i] for i in outside]) if GOOD in apart else [BAD] * len(apart)
        for i, x in zip(outside, apart, strict=True):
            if not headings[i]:
                labels[i] = x
    return labels


def main_text(page: str | None) -> str:
    """Main text of a page: its good blocks in order, joined by an empty line."""
    blocks, texts = [], []
    for block in blocks_of(page or ""):
        text = " ".join(unescape("".join(block.parts)).split())
        if text:
            blocks.append(block)
            texts.append(text)
    return "\n\n".join(t for t, x in zip(texts, _decide(blocks, texts), strict=True) if x == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    A null or empty page, and one without main text, gives the empty text and
    0; long pages are read whole, in time that grows with their length; ids and URLs may be null or repeat; malformed markup is read as far as
    it goes; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
