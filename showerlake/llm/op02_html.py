"""Main text of web pages: flat text blocks, judged by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those of its
neighbours, and what encloses it; a tree grown from the labelled pages below says whether it is article.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .trees import Node, grow

#: Elements whose content is never shown as text, that end a block, and that enclose other than the article.
SILENT = "script style noscript template svg math iframe object embed canvas audio video head title select option button textarea input datalist".split()
BREAKING = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
APART = "nav footer aside form menu dialog search".split()
#: Words of class, id and role names that mark other than the article.
APART_NAMES = set(
    "ad ads adv advert adverts advertisement adsbygoogle advertising banner sponsor sponsored promo promotion nav navbar navigation menu topnav sidenav breadcrumb breadcrumbs header masthead topbar footer foot "
    "copyright sidebar aside rail widget widgets related recommended popular trending notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login search share sharing social "
    "comment comments reply replies respond disqus discussion pagination pager skip toolbar legal disclaimer complementary contentinfo form".split()
)
#: Parts of names that say where an element stands, not what it holds.
PLACE_NAMES = set("left right top bottom main inner outer primary secondary sub box block blocks wrap wrapper container list item items area section group row col column bar links link widget content body text title small large mobile desktop site page global the of and my".split())
#: First words of names that tell of a page's make-up, not of what the element holds.
LAYOUT_NAMES = set("has with no without is js page layout wp single".split())
MAIN_NAMES = set("article content main post story entry body text articlebody maincontent".split())
#: What a head may hold; anything else ends one that was left open.
HEAD = frozenset("title meta link script style base noscript template".split())

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
_NAME_PART = re.compile(r"[a-z]+")
_RAW_END = {n: re.compile(rf"</{n}\s*[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "textarea", "title", "iframe", "noscript")}
_SILENT, _BREAKING, _VOID, _APART = map(frozenset, (SILENT, BREAKING, VOID, APART))

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "element", "named", "half_named", "main", "page_has_main", "heading"]


class Block:
    __slots__ = ("text", "words", "linked", "element", "named", "half_named", "main", "heading", "form")

    def __init__(self, text: str, linked: int, state: tuple, heading: bool):
        self.text, self.words, self.linked, self.heading = text, len(text.split()), linked, heading
        _, _, self.element, self.named, self.half_named, self.main, _, self.form = state


def _marks(name: str, rest: str, in_main: bool) -> tuple[bool, bool, bool, bool, bool]:
    """(hidden, element, named, half_named, main) of an element: what its name and its attributes say of its content.

    named: a class, id or role wholly of words for what is not the article; half_named: one that has such a word beside others.
    """
    hidden, element, named, half, main = False, (name in _APART and name != "form") or (name == "header" and not in_main), False, False, name in ("article", "main")
    if rest and not rest.isspace():
        for key, value in _ATTRIBUTE.findall(rest):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role"):
                for token in value.split():
                    words = _NAME_PART.findall(token)
                    if not words or words[0] in LAYOUT_NAMES:
                        continue
                    if name not in ("html", "body", "article", "main") and not APART_NAMES.isdisjoint(words):
                        if all(w in APART_NAMES or w in PLACE_NAMES for w in words):
                            named = True
                        else:
                            half = True
                    elif token.replace("-", "").replace("_", "") in MAIN_NAMES:
                        main = True
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    return hidden, element, named, half, main


#: What holds for a block outside all elements: name, hidden, element, named, half_named, main, link, form.
_OUTSIDE = ("", False, False, False, False, False, False, 0)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is read as far as it goes; nothing is dropped but silent elements."""
    found: list[Block] = []
    stack: list[tuple] = []
    parts: list[str] = []
    linked: list[str] = []
    state, heading, forms = _OUTSIDE, False, 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append(Block(text, len(html.unescape("".join(linked)).split()), state, heading))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        nonlocal state
        if stack and stack[-1][0] == "head" and text and not text.isspace():
            stack.pop()
            state = stack[-1] if stack else _OUTSIDE
        if not state[1] and text:
            parts.append(text)
            if state[6]:
                linked.append(text)

    at, size = 0, len(page)
    while at < size:
        m = _PIECE.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            say(m["cdata"].replace("&", "&amp;"))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name == "br":
            say(" ")
            continue
        if name in _BREAKING:
            flush()
        if m["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            else:
                continue
        else:
            if stack and stack[-1][0] == "head" and name not in HEAD:
                stack.pop()
            if name in _RAW_END:
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else size
                continue
            if name in _VOID or m["rest"].endswith("/"):
                continue
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()
            last = stack[-1] if stack else _OUTSIDE
            hid, element, named, half, main = _marks(name, m["rest"], last[5])
            forms += name == "form"
            stack.append((name, last[1] or hid or name in _SILENT, last[2] or element, last[3] or named, last[4] or half, last[5] or main, last[6] or name == "a", last[7] or (forms if name == "form" else 0)))
        state = stack[-1] if stack else _OUTSIDE
        heading = any(s[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for s in stack[-3:])
    flush()
    _settle_forms(found)
    return found


def _settle_forms(found: list[Block]) -> None:
    """A form counts as an element apart, unless it holds the page's main part or most of its words: then it is the page's frame."""
    if not any(b.form for b in found):
        return
    total, inside, frame = sum(b.words for b in found), Counter(), set()
    for b in found:
        inside[b.form] += b.words
        if b.form and b.main and not b.named and not b.element:
            frame.add(b.form)
    for b in found:
        if b.form and b.form not in frame and 2 * inside[b.form] <= total:
            b.element = True


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES per block."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    links = np.array([0, *(b.linked / max(b.words, 1) for b in found), 0], float)
    has_main = any(b.main and not (b.element or b.named) for b in found)
    flags = np.array([(b.element, b.named, b.half_named, b.main, has_main, b.heading) for b in found], float).reshape(n, 6)
    return np.c_[words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], flags]


#: Labelled pages: a small table of blocks. `+n` stands for n words of article, `-n` for n words of something else, `=n`
#: for n more words of the block before. Written and labelled by hand for this module.
LABELLED = """
<nav><ul><li><a>-2</a><li><a>-1</a><li><a>-3</a></ul></nav><div class=ad>-9</div><article><h1>+12</h1><p>+60<p>+8<p>+95 <a>=3</a><p>+1<p>+30</article><aside><h3>-2</h3><a>-5</a></aside><footer>-8</footer>
<header><h1>-3</h1><p>-7</header><nav><a>-1</a></nav><main><h1>+7</h1><p>+40<p>+55<h2>+3</h2><ul><li>+5<li>+9<li><a>+4</a></ul><p>+20<div class=share>-3 <a>=2</a></div></main><section class=comments><h3>-2</h3><p>-40<p>-75<p>-6</section><footer><p>-30</footer>
<div id=menu><a>-2</a> <a>=2</a></div><div class=post><h2>+6</h2><p>+90<p>+45<blockquote>+25</blockquote><p>+5</div><div class="sidebar"><p>-35<p>-12<ul><li><a>-4</a><li><a>-3</a></ul></div><div class=footer>-15</div>
<h1>+5</h1><p>+70<p>+50<p>+33<p>+4<p>+80<hr><p>-4 <a>=6</a>
<div><a>-1</a> <a>=1</a> <a>=2</a> <a>=1</a></div><div><h1>+9</h1><div>+64</div><div>+3</div><div>+48 <a>=2</a></div><div>+22</div></div><div><a>-5</a></div><div><a>-7</a></div><div>-3 <a>=4</a></div>
<table><tr><td><a>-2</a><br><a>=1</a><td><p>+85<p>+40<p>+12<td>-1 <a>=3</a></table><p><a>-3</a> <a>=2</a> <a>=2</a>
<div class=social-history><h1>+4</h1><p>+75<p>+35<p>+18<p>+60</div><div class=social-links><a>-2</a> <a>=1</a></div>
<section class=ad-free><article><h1>+8</h1><p>+50<p>+66<p>+2</article></section><div class=ad-slot>-11</div><div class=promo-offer-now>-6 <a>=3</a></div><div class=newsletter-teaser-xl><p>-9<p><a>-3</a></div>
<div class=search-theory><p>+45<p>+70<p>+6<p>+38</div><div class=search-box>-2</div><div class=related-stories-feed><h3>-2</h3><a>-6</a><p><a>-8</a><p><a>-5</a></div>
<article><h1>+6</h1><p>+30<div class="pull-quote-share">-4 <a>=1</a></div><p>+40<div class=advert-inline-x>-7</div><p>+55<figure><figcaption>+10</figcaption></figure><p>+25<footer>-5</footer></article><div class="comment-list"><div class=comment-body><p>-65<p>-20</div></div>
<article><p>+2<p>+4<p>+3</article><footer>-20</footer><div class=cookie-notice>-25 <a>=2</a></div><div class=copyright>-6</div>
<article><header><h1>+10</h1><p>+6</header><p>+70<p>+1<p>+33<ul><li><a>+3</a><li>+7</ul><p><a>+5</a><p>+44</article>
<article><p>+90 <a>=30</a><p><a>+12</a><p>+8 <a>=8</a><p>+65</article><nav>-3</nav><aside>-60</aside><aside><p>-85<p>-40</aside><form>-12</form><form><p>-3<p>-5</form>
<article><h1>+5</h1><p>+40<aside>-2 <a>=1</a></aside><p>+3<nav><a>-2</a> <a>=1</a></nav><p>+50<aside><p>-30 <a>=2</a><a>=6</a></aside><p>+20 <a>=4</a><footer>-3 <a>=2</a></footer></article>
<main><h1>+3</h1><p>+25 <a>=5</a><aside><h4>-2</h4><ul><li><a>-4</a><li><a>-3</a></ul></aside><p>+44<div class=related><a>-5</a><p>-20</div><p>+6</main>
<main><p>+100<p>+80<p>+3<p>+2<p>+120</main><p>-3<p>-12<p>-30 <a>=2</a><p>-45<ul><li><a>-3</a></ul>
<article><h1>+3</h1><p>+15</article><p>-20<p>-8<div>-55</div><div>-4</div>
<p>-4 <a>=4</a><p>-2<h1>+11</h1><p>+3<p>+77<p>+90<p>+6<p>+41<p>-2 <a>=2</a><p>-5 <a>=5</a>
<p>+14<p>+20<p>+9
<p>+30
<h1>+4</h1><p>+5
<p>+3
<ul><li><a>-4</a><li><a>-2</a><li><a>-6</a><li><a>-3</a></ul>
<p><a>-3</a><p>-1 <a>=9</a><p><a>-2</a><p>-2 <a>=3</a>
<h1>+2</h1><p>+60<h2>+1</h2><p>+45<p>+2<p>+38<h2>+2</h2><p>+52<p><a>+4</a><p>+61
<div>-2</div><ul><li><a>-2</a><li><a>-3</a></ul><div>-1</div><ul><li><a>-4</a></ul><p>+66<p>+2<p>+47<div>-2</div><ul><li><a>-3</a></ul>
<div>-5</div><div><a>-4</a></div><div>-3</div><div><a>-6</a></div><h1>+5</h1><p>+58<p>+3<p>+71<div>-4</div><div><a>-2</a></div><div>-6</div><div><a>-3</a></div>
<div class=social-history><h1>+2</h1><p>+80<h2>+2</h2><p>+41</div><div class=share-this-now>-2 <a>=2</a></div>
<div class=archive-search-results><h2>-2</h2><p><a>-5</a><p>-6<p><a>-4</a><p>-3</div><p>+40<p>+30
<div class=form-and-function><h2>+1</h2><p>+35<p>+4<p>+50<p>+2<p>+66</div><div class=signup-cta>-4 <a>=1</a></div>
<div class=notice><p>-28</div><p>+50<p>+24<p>+17<div class=disclaimer><p>-70</div><div class=related><h4>-2</h4><p>-15<p>-22</div>
<div class=content><p>+60<p>+33<div class=newsletter><h3>-4</h3><p>-14</div><p>+48</div><div class=replies><p>-5<p>-80<p>-33</div>
"""


#: Copies of each labelled page whose block lengths are varied (seeded), so that cuts lie between kinds and not between examples.
COPIES, LEAST, TREE_DEPTH = 24, 6, 8


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED."""
    rng = random.Random(2)

    def words(m: re.Match) -> str:
        n = int(m[2]) if copy == 0 else max(1, round(int(m[2]) * rng.lognormvariate(0, 0.6)))
        return " ".join([{"+": "yes", "-": "no", "=": "so"}[m[1]], *["so"] * (n - 1)])

    rows, labels = [], []
    for line in LABELLED.strip().splitlines():
        for copy in range(COPIES):
            found = blocks(re.sub(r"([+=-])(\d+)", words, line))
            rows.append(features(found))
            labels += [b.text.startswith("yes") for b in found]
    return np.concatenate(rows), np.array(labels, float)


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled_blocks(), depth=TREE_DEPTH, least=LEAST)


def main_text(page: str | None) -> str:
    """Article blocks joined by newlines; null or a page without article text gives the empty string."""
    found = blocks(page or "")
    if not found:
        return ""
    kept = []
    for block, row in zip(found, features(found).tolist(), strict=True):
        node = tree()
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        if node.value > 0.5:
            kept.append(block.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html in one narrow pass.

    Null html counts as empty; repeated rows and ties give equal results; an empty table gives an empty
    one; very long pages are read whole; other columns are not read, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    cast = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cast.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
