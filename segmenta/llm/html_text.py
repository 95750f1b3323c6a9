"""Main text of pages: flat text blocks, classified by a decision tree.

A page is read as a row of blocks, the text between the borders of block elements.
Each block has its number of words and its link density (the share of its words in
links), those of the block before and after it, and marks: whether it stands in an
article or main element, in an element or role that is no text (menu, header, footer,
sidebar, form), in a part that is named as none (class or id), whether the page has an
article or main element at all, whether it stands in an element of prose (2), of a list
(1) or another one (0), and whether that other one is a part with a class or id of its
own. A decision tree over these features is grown, when a query starts, from the blocks
of a small set of labelled pages (LABELLED).

Scripts, styles, titles, templates and comments are no blocks. Character references are
decoded, white space in a block becomes one space, blocks are joined in page order by
one space. Broken markup is read as far as it goes, in time linear in the page: elements
may stay open (a link ends with the element it stands in), stray "<" are text, an
unclosed script or comment takes the rest, an unclosed tag is text.

Defined results: null and empty pages, and pages without text blocks, give an empty
text; pages of any length are read whole; repeated rows give equal texts; further columns
are ignored.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .store import ready, tidied

# Elements by their role.
BLOCK_TAGS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe noframes svg math canvas object audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT_TAGS = frozenset("nav header footer aside form button select menu dialog label fieldset".split())
MAIN_TAGS = frozenset("article main".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
#: words in a class or id that mark a part as no text
NO_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer "
    "sidebar aside widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments comentarios kommentare "
    "commentaires disqus respond reply replies share sharing social related recommended recommendations teaser teasers form search pagination pager toolbar".split()
)
MAIN_WORDS = frozenset("article content main post entry story articlebody".split())

PROSE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dd dt td th caption summary".split())
LIST_TAGS = frozenset(("li",))

# The labelled pages. +n stands for about n words of main text, -n for about n other words, and
# +w and -w for any number of words from 1 to 150: there only the place says what the block is.
LABELLED = [
    "<nav><ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul></nav><div class=ad>-w</div><article><h1>+w</h1><p>+w</p><p>+w</p><p>+w</p></article><footer>-w</footer>",
    "<nav><ul><li><a>-1</a></li></ul></nav><div class=ad>-w</div><article><h1>+w</h1><p>+w<br><p>+w</p><p>+w<br><p>+w</p></article><footer>-w <a>-2</a></footer>",
    "<header>-w <a>-2</a></header><main><h1>+1</h1><p>+w</p><p>+w<br>+w<p>+w</p><ul><li>+w</li><li>+9 <a>+2</a></li></ul><p>+w</p></main><aside><h3>-2</h3><p>-w</p></aside><footer>-w</footer>",
    "<div class=menu><a>-1</a> <a>-1</a></div><article><p>+w</p><div class=advert>-w</div><p>+w</p><blockquote>+w</blockquote><section id=comments><p>-w</p><p>-w</p></section></article>",
    "<article><h2>+w</h2><p>+40 <a>+2</a></p><div class=x1>-5</div><p>+w</p><div class=x2>-7</div><p>+w</p></article><div>-w</div>",
    "<main><p>+w</p><div class=x3>-4 <a>-2</a></div><p>+w</p><div class=x4><a>-3</a></div><div class=x5>+45</div><div id=x6>+28</div></main><div class=x7>-w</div>",
    "<article><div>+w</div><div>+w</div><div>+8</div><div class=body>+70</div><div class=x8>-6</div></article><p>-w</p><div>-w</div>",
    "<main><h1>+w</h1><p>+w</p><h3>-2</h3><ul><li><a>-4</a></li><li><a>-6</a></li><li><a>-5</a></li></ul></main><div class=related><a>-8</a></div>",
    "<article><p>+w</p><ul><li><a>+3</a></li></ul><p>+w</p><p><a>+2</a></p><p>+w</p><p>+2 <a>+9</a></p><p>+w</p></article><div>-w</div><div>-w</div>",
    "<article><table><tr><th>+w</th><td>+w</td></tr><tr><td>+1</td><td>+w</td></tr></table><p>+w</p><pre>+w</pre><form>-w</form><p>+w</p></article><p class=notice>-w</p>",
    "<div class=top><a>-1</a> <a>-1</a> <a>-2</a></div><h1>+w</h1><p>+w</p><p>+w</p><p>+30 <a>+1</a></p><p>+w</p><div class=x9>-4</div><div class=foot>-6 <a>-2</a></div>",
    "<div><a>-1</a></div><div><a>-2</a></div><div>+60</div><div>+4</div><div>+35</div><div class=ad>-w</div><div>-3 <a>-3</a></div>",
    "<h2>+w</h2><p>+w</p><p>+w</p>",
    "<p>+w</p><p>+w</p><div class=y1>-5</div><p>+w</p>",
    "<ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul><p>+w</p><ul><li>+5</li><li>+12</li><li>+6 <a>+1</a></li></ul><p>+w</p><h4>-2</h4><ul><li><a>-5</a></li><li><a>-4</a></li></ul>",
    "<div class=y2>-2</div><div class=y3><a>-4</a></div><div class=y4>+90</div><div class=y5>+24</div><div class=y6>-3</div>",
    "<header><h1>-w</h1></header><div id=y7><h2>+w</h2><p>+w</p><p>+w</p></div><div class=sidebar><h3>-2</h3><p>-w</p><p>-w</p></div><footer><p>-w</p></footer>",
    "<div class=cookie><p>-w</p></div><p>+w</p><p>+w</p><p><a>-3</a></p><p><a>-2</a></p><p><a>-6</a></p>",
    "<table><tr><td>+w</td></tr><tr><td>+w</td></tr></table><div>-2 <a>-4</a></div><div class=y8>-8</div>",
    "<section><h2>+w</h2>+25</section><section>+30</section><div class=share><a>-1</a></div><div><a>-2</a> <a>-2</a> -1</div>",
    "<main><div class=y9>+24</div><div class=z1>-8</div><section>+w</section><section>+w</section><div class=z2>-9</div><p>+w</p></main>",
    "<main><p>+w</p></main><div class=z8>-w</div><section>-w</section>",
    "<article><h1>+w</h1></article><div class=z3>-w</div><p>-w</p><ul><li>-w</li></ul>",
    "<div><a>-2</a></div><p>+10 <a>+4</a></p><p><a>-3</a> <a>-2</a></p><div>-4 <a>-5</a></div><div>-20 <a>-25</a></div>",
    "<article><p>+w</p><div class=z4>-1</div><div class=z5><p>+w</p></div><div class=z6><a>-7</a></div><p>+w</p></article><div class=z7>-w</div>",
    "+w",
    "+w<br>+w<br>+w",
    "<a>-1</a> <a>-2</a> <a>-1</a><br>+40<br>+w<br>+25",
    "<article>+w<br>+w<br>+w</article>",
    "<main><div>+w</div><div>+w</div></main>",
    "<article><ul><li>+w</li><li>+w</li><li>+w</li></ul><div>+w</div></article>",
    "<main><div class=k1><div>+w</div><div>+w</div></div><div class=k2>-6</div></main><div class=k3>-w</div>",
    "<div class=k4>-3</div><div class=k5><div>+60</div><div>+w</div><div>+45</div></div><div class=k6>-5</div>",
]
#: how often each labelled page is written out, each time with other numbers of words
VARIANTS = 24
MIN_LEAF = 4

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 1) -> tuple | float:
    """A tree of (feature, threshold, at most, above) with shares of label 1 at its leaves, by Gini gain."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (1e-9, None, None)
    gini = lambda y: y.mean() * (1 - y.mean()) * len(y)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= t
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = gini(labels) - gini(labels[left]) - gini(labels[~left])
            if gain > best[0] + 1e-12:
                best = (gain, f, float(t))
    if best[1] is None:
        return share
    left = rows[:, best[1]] <= best[2]
    return best[1], best[2], grow(rows[left], labels[left], depth - 1, least), grow(rows[~left], labels[~left], depth - 1, least)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: main text) of the blocks of the labelled pages."""
    rows, labels = [], []
    draw = random.Random(7)

    def some(m: re.Match) -> str:
        n = 150 ** draw.random() if m[2] == "w" else int(m[2]) * draw.uniform(0.75, 1.3)
        return " ".join(m[1] * max(1, round(n)))

    for page in LABELLED * VARIANTS:
        found = blocks(re.sub(r"([+-])(\d+|w)", some, page))
        rows += features(found)
        labels += [b.text[0] == "+" for b in found]
    return np.array(rows, np.float64), np.array(labels, np.float64)


@functools.cache
def tree() -> tuple | float:
    """The tree grown from the labelled pages."""
    return grow(*labelled(), depth=12, least=MIN_LEAF)


def is_text(node: tuple | float, row: tuple) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node >= 0.5


def _marks(tag: str, attrs: str) -> tuple[bool, bool, bool, bool]:
    """(main, no text, named as no text, has a class or id) of an element by its name, role, class and id."""
    main, out, named, own = tag in MAIN_TAGS, tag in NO_TEXT_TAGS, False, False
    if attrs and not out:
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                out = True
            elif name == "role":
                main, out = main or value.lower() == "main", out or value.lower() in NO_TEXT_ROLES
            elif name in ("class", "id") and value and tag not in ("body", "html"):
                own = True
                names = {w.lower() for w in _CAMEL.findall(value)}
                named = named or (not main and bool(names & NO_TEXT_WORDS))
                main = main or (not named and (value.lower() in MAIN_WORDS or "articlebody" in value.lower()))
    return main, out, named, own


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; comments and declarations have no name.

    Every search that fails is not made again further on, so a page is passed over a
    constant number of times.
    """
    at, last_end = 0, page.rfind(">")
    last_quote = {q: page.rfind(q) for q in "\"'"}
    while 0 <= (start := page.find("<", at)) < last_end or (start >= 0 and page.startswith("<!--", start)):
        at = start + 1
        if page.startswith("<!--", start):
            short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, start)), None)
            end = _COMMENT_END.search(page, start + 4) if not short else None
            at = start + len(short) if short else end.end() if end else len(page)
            yield start, at, "", False, ""
        elif page.startswith(("<!", "<?"), start):
            at = page.find(">", start) + 1
            yield start, at, "", False, ""
        elif m := _NAME.match(page, start + 1):
            a = end = m.end()
            # the first > outside of quotes; quotes that never close are plain characters
            while True:
                stop = page.find(">", end)
                quote = min((i for i in (page.find(q, end, stop) for q in "\"'") if i >= 0), default=-1) if stop >= 0 else -1
                if quote < 0 or last_quote[page[quote]] <= quote:
                    break
                close = page.find(page[quote], quote + 1)
                if close > last_end:
                    break
                end = close + 1
            at = (stop if stop >= 0 else page.find(">", a)) + 1
            name = m[0].lower()
            yield start, at, name.lstrip("/"), name[0] == "/", page[a : at - 1]


class Block(NamedTuple):
    """A block's text, words, words in links, and where it stands."""

    text: str
    words: int
    linked: int
    main: bool
    out: bool
    named: bool
    prose: int
    own: bool


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    found: list[Block] = []
    # (tag, in main, in no text, in a part named as none, prose, has a class or id of its own)
    outside = ("", False, False, False, 0, False)
    stack = [outside]
    open_tags: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    link_depth = 0
    here = outside
    at = 0

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, main, out, named, prose, own = here
                n = text.count(" ") + 1
                found.append(Block(text, n, min(n, len(html.unescape(" ".join(linked)).split())), main, out, named, prose, own and not prose))
            parts.clear()
            linked.clear()

    def pop() -> None:
        nonlocal link_depth
        open_tags[stack.pop()[0]] -= 1
        if link_depth > len(stack):
            link_depth = 0

    for start, end, tag, closing, attrs in tags(page):
        if start < at:
            continue
        if start > at:
            parts.append(page[at:start])
            if link_depth:
                linked.append(page[at:start])
        at = end
        if not tag:
            continue
        if tag in RAW_TAGS and not closing:
            if not attrs.endswith("/"):
                past = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = past.end() if past else len(page)
            continue
        if tag in BLOCK_TAGS:
            close()
        if tag == "a":
            link_depth = 0 if closing else len(stack)
        if tag in VOID_TAGS:
            continue
        if closing:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
                # an element inside a line ends no block, unless the place changes with it
                if stack[-1][1:] != here[1:]:
                    close()
        elif tag in BLOCK_TAGS or attrs:
            if tag in BLOCK_TAGS and stack[-1][0] == "p":
                pop()
            if tag == "li" and stack[-1][0] == "li":
                pop()
            main, out, named, own = _marks(tag, attrs)
            _, in_main, in_out, in_named, prose, in_own = stack[-1]
            if (out and not in_out) or (named and not in_named):
                close()
            if tag in BLOCK_TAGS:
                prose, in_own = 2 if tag in PROSE_TAGS else 1 if tag in LIST_TAGS else 0, own
            stack.append((tag, in_main or main, in_out or out, in_named or named, prose, in_own))
            open_tags[tag] += 1
        else:
            continue
        here = stack[-1]
    parts.append(page[at:])
    close()
    return found


def features(found: list[Block]) -> list[tuple]:
    """The tree's features of each block of a page."""
    has_main = any(b.main and not b.out and not b.named for b in found)
    rate = [(0, 0.0), *((b.words, b.linked / b.words) for b in found), (0, 0.0)]
    return [(*rate[i + 1], *rate[i], *rate[i + 2], b.main, b.out, b.named, has_main, b.prose, b.own) for i, b in enumerate(found)]


def main_text(page: str | None, grown: tuple | float) -> str:
    """The blocks that the tree takes for text, joined."""
    found = blocks(page) if page else []
    return " ".join(b.text for b, row in zip(found, features(found), strict=True) if is_text(grown, row))


@tidied
def _extractor(grown: tuple | float) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, grown) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ready(pages.sparkSession)
    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return d.mapInArrow(_extractor(tree()), "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
