"""Main text of web pages: flat text blocks, their words and link density and their neighbours', and a small decision tree.

A page is cut into blocks at block-level tags; a block has text, words, words inside links, and what encloses it. A CART tree, trained
here on the small labelled pages ``PAGES`` below, decides for each block from its own and its neighbours' numbers, two on each side, whether it is main
text. Scripts, styles, comments, heads and form controls never become blocks. Names of classes are one number among the others: how likely a logistic
regression on the grams of labelled names takes one for what isn't main text, at any part and in any spelling (``advert__inner``, ``AdBox``; ``no-sidebar``
isn't a sidebar). An element that holds an article, a main element, a first heading or nine tenths of the page's words isn't marked by its name.

Defined results: null html is an empty page; a page without blocks gives empty text; broken or unclosed markup is read to its end, and a
quote that is never closed is an ordinary character; very long pages are read whole, in time linear in their length; ties and repeated rows: a
row's result depends on its html alone, so equal rows give equal rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by role.
SKIPPED = frozenset("script style noscript template title iframe object svg math canvas select textarea button option".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PROSE = frozenset("p li dd dt blockquote pre figcaption".split())
# The labelled names of classes, ids and roles, of what isn't main text and of what may be.
BESIDE_NAMES = "ad ads ad-slot ad-container adbox ad-banner ad-1 ad-300x250 advert advertisement advert-wrapper advertising adsbygoogle dfp-ad google-ad sponsor sponsored sponsored-content sponsored-post promo promo-box promo-unit promoted promotion banner top-banner nav navbar main-nav navigation site-navigation menu menu-item dropdown-menu breadcrumb breadcrumbs sidebar right-sidebar footer site-footer page-footer header site-header page-header masthead topbar toolbar cookie cookies cookie-banner cookie-consent cookie-notice consent gdpr gdpr-notice privacy-notice notice site-notice newsletter newsletter-signup signup sign-up-form subscribe subscription-box paywall popup modal overlay share share-buttons sharing social social-links social-media follow-us related related-posts related-stories related-articles recommended recommendations more-stories read-next you-may-like outbrain taboola comment comments comment-list comment-section comments-area user-comments reader-comments discussion disqus replies reply respond author-bio author-box about-author login login-form search search-form search-box copyright legal disclaimer terms widget widgets widget-area pagination pager tags tag-cloud skip-link trending popular-posts poll".split()
TEXT_NAMES = "content main-content article article-body article-content post post-body post-content entry entry-content entry-body story story-body story-text text body-text rich-text prose paragraph lead lede intro summary headline title subtitle heading chapter section section-body page page-body container content-wrapper wrapper inner outer row column col grid layout main primary block box group item list card panel left right top bottom center wide full clearfix theme-light figure caption image photo quote blockquote pullquote poem verse recipe steps ingredients definition glossary table note notes footnote footnotes reference question answer faq no-sidebar has-sidebar without-sidebar no-ads without-ads no-comments without-comments no-header footer-widgets-3 footer-widgets-4 adapted address advice additional added adventure shadow loading reading leading gradient thread download commentary navy socialism menuet legend mode modern popular position area form form-text media user reader site about author more link links unit slot buttons message".split()
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NAMED = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HEAD = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)?+(?:\s*+(=)\s*+)?+")
UNQUOTED = re.compile(r"[^\s>]*+")
SPACE = re.compile(r"\s+")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title")}

MAIN_ROLE, TAG_ROLE, LINK_ROLE, HEADING_ROLE, SKIP_ROLE, PROSE_ROLE = 1, 2, 4, 8, 16, 32


def _said(n: int) -> str:
    return " ".join(["word"] * n)


def _p(*words: int) -> str:
    return "".join(f"<p>{_said(n)}</p>" for n in words)


def _links(*words: int) -> str:
    return "<ul>" + "".join(f"<li><a href=x>{_said(n)}</a></li>" for n in words) + "</ul>"


#: The labelled pages: fragments in order, each main text (1) or not (0).
PAGES: list[list[tuple[int, str]]] = [
    # an article among structural elements
    [(0, f"<nav>{_links(1, 1, 1, 1)}</nav>"), (0, f"<div class=ad>{_said(5)}</div>"), (1, f"<article><h1>{_said(9)}</h1>{_p(70, 12, 2, 90)}</article>"), (0, f"<footer>{_said(12)}</footer>")],
    [
        (0, f"<header><h2>{_said(2)}</h2></header><nav>{_links(1, 1)}</nav><div class=cookie-notice>{_said(12)}</div>"),
        (1, f"<article><h1>{_said(3)}</h1>{_p(14, 1)}"),
        (0, f"<aside>{_said(9)}</aside><form><label>{_said(2)}</label></form>"),
        (1, f"{_p(2)}</article>"),
        (0, f"<div id=comments>{_p(30, 11)}</div><footer>{_said(3)}</footer>"),
    ],
    # short paragraphs, lists and links belong to an article
    [(0, f"<nav>{_links(1, 2, 1)}</nav>"), (1, f"<article><h1>{_said(1)}</h1>{_p(1, 3, 1, 5)}{_links(2, 3, 1)}<p><a href=x>{_said(20)}</a></p>{_p(4)}</article>"), (0, f"<footer>{_links(2, 1)}</footer>")],
    [(1, f"<article><h1>{_said(6)}</h1>{_p(40)}"), (0, f"<div class=share>{_links(1, 1)}</div><div class=newsletter>{_p(20)}</div>"), (1, f"{_p(30, 200)}</article>"), (0, f"<footer>{_p(60)}</footer>")],
    # notices, adverts and remarks outside of the article, with and without names
    [(0, f"<div>{_p(40)}</div>"), (1, f"<article><h1>{_said(7)}</h1>{_p(60, 80, 30)}</article>"), (0, f"<div>{_p(25, 6)}</div><div class=comments>{_p(50, 45)}</div>")],
    [(0, f"<div>{_said(2)}</div>"), (1, f"<main><h1>{_said(7)}</h1>{_p(45, 110)}</main>"), (0, f"<aside>{_p(40)}</aside><section>{_p(8, 30)}</section>")],
    # pages without structural elements
    [(0, f"<div>{_links(1, 2, 2)}</div>"), (1, f"<h1>{_said(7)}</h1>{_p(60, 45, 3, 55)}"), (0, f"<div>{_links(3, 2, 3)}</div><div>{_said(6)}</div>")],
    [(0, f"<table><tr><td><a href=x>{_said(2)}</a><td><a href=x>{_said(3)}</a></table>"), (1, f"<div>{_p(110)}</div>"), (0, f"<div><a href=x>{_said(9)}</a> {_said(2)}</div><div>{_links(1)}</div>")],
    [(0, f"<div>{_links(2, 1)}</div>"), (1, f"{_p(25, 45, 20, 50, 8, 70)}"), (0, f"<div>{_links(4, 3)}</div><div>{_said(5)}</div>")],
    [(1, f"{_said(50)}<br>{_said(30)}<br>{_said(12)}<br>{_said(40)}")],
    [(1, _p(150))],
    [(1, f"<div class='site footer'>{_p(110)}</div>")],
    # ... but with names
    [
        (0, f"<div class=header>{_said(4)}</div><div class=menu>{_links(1, 1, 1)}</div>"),
        (1, f"<div class=content><h1>{_said(5)}</h1>{_p(45, 25)}<h2>{_said(4)}</h2>{_p(50, 90)}</div>"),
        (0, f"<div class=sidebar>{_p(20)}{_links(4, 5)}</div><div class=comments><h3>{_said(2)}</h3>{_p(40, 12, 60)}</div><div class=footer>{_p(10)}</div>"),
    ],
    [(0, f"<div class=cookie-consent>{_p(30)}</div>"), (1, f"<div>{_p(60, 8, 90)}</div>"), (0, f"<div class=related>{_p(18, 22)}</div><div class=legal>{_p(35)}</div>")],
    # short texts without structural elements: the only paragraph, a poem, lists, a last short line
    [(0, f"<div>{_said(1)}</div>"), (1, f"<div><h1>{_said(1)}</h1>{_p(11)}</div>")],
    [(1, f"<h1>{_said(1)}</h1>{_p(8)}")],
    [(1, _p(6))],
    [(1, _p(15, 3))],
    [(1, f"<h1>{_said(2)}</h1>" + _p(*[4, 6, 5, 7] * 5))],
    [(0, f"<div>{_links(1, 2, 1)}</div>"), (1, f"<h2>{_said(2)}</h2><dl>" + f"<dt>{_said(1)}</dt><dd>{_said(5)}</dd>" * 10 + "</dl>")],
    [(1, f"<h1>{_said(4)}</h1>{_p(12)}<ul>" + "".join(f"<li>{_said(n)}</li>" for n in (3, 2, 6, 1, 4)) + "</ul>"), (0, f"<div>{_said(4)}</div>")],
    [(0, f"<div>{_said(2)}</div><div>{_links(1, 1, 2)}</div>"), (1, f"<h1>{_said(5)}</h1>{_p(18, 35, 2)}"), (0, f"<div>{_links(2, 1)}</div><div>{_said(7)}</div>")],
    # links inside running text, and headings of lists of links
    [(1, f"<h1>{_said(3)}</h1><p>{_said(18)} <a href=x>{_said(4)}</a></p><p>{_said(9)} <a href=x>{_said(5)}</a> {_said(3)}</p>"), (0, f"<h3>{_said(2)}</h3>{_links(4, 6, 5)}")],
    [(1, f"<h2>{_said(4)}</h2>{_p(28, 14)}"), (0, f"<h3>{_said(1)}</h3>{_links(6, 7, 4)}<div>{_said(3)}</div>")],
    # lines of text in plain elements
    [(0, f"<div><a href=x>{_said(1)}</a> <a href=x>{_said(1)}</a></div>"), (1, f"<div>{_said(24)}</div><div>{_said(9)}</div><div>{_said(41)}</div>"), (0, f"<div>{_said(4)}</div>")],
    # named elements inside of an article
    [(1, f"<article><h1>{_said(4)}</h1>{_p(30)}"), (0, f"<div class=ad-slot>{_said(13)}</div>"), (1, _p(22, 5)), (0, f"<div class=related-stories>{_p(7, 9)}</div><p class=promo>{_said(16)}</p>"), (1, f"{_p(11)}</article>")],
    [(1, f"<h1>{_said(4)}</h1>{_p(30, 3)}"), (0, f"<p class=advert>{_said(9)}</p><div class=share-buttons>{_said(3)}</div>"), (1, _p(16)), (0, f"<div class=author-bio>{_p(24)}</div><div class=discussion><h3>{_said(1)}</h3>{_p(19, 33)}</div>")],
    # structural elements with running text, around an article that is shorter than they are, or around none
    [(1, f"<article><h1>{_said(3)}</h1>{_p(3)}</article>"), (0, f"<footer>{_said(16)}</footer>")],
    [(0, f"<header>{_p(14)}</header>"), (1, f"<h1>{_said(3)}</h1>{_p(20, 9)}"), (0, f"<aside>{_p(25, 4)}</aside><footer>{_p(16)}{_said(30)}</footer>")],
    [(0, f"<nav>{_said(12)}</nav>"), (1, f"<div>{_said(30)}</div><div>{_said(12)}</div>"), (0, f"<form>{_said(12)}{_p(10)}</form><aside>{_said(18)}</aside><footer>{_said(40)}</footer>")],
    # teasers in articles, the text elsewhere
    [(0, f"<article><a href=x>{_said(6)}</a></article><article><a href=x>{_said(8)}</a></article><div>{_links(3)}</div>"), (1, f"<div><h1>{_said(8)}</h1>{_p(70, 80, 60)}</div>"), (0, f"<div>{_links(3, 4)}</div>")],
]


def grow(rows: list[tuple], depth: int = 8):
    """A CART tree by Gini impurity: nested (feature, threshold, low, high), leaves 0 or 1."""
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(rows[0]) - 1):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:]):
            cut = (a + b) / 2
            low, high = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            gini = sum(len(part) * (p := sum(r[-1] for r in part) / len(part)) * (1 - p) for part in (low, high))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, cut, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, low, high = best
    return (f, cut, grow(low, depth - 1), grow(high, depth - 1))


def labelled() -> list[tuple]:
    """The training table: each block of the labelled pages with its features and its label."""
    rows = []
    for page in PAGES:
        done, labels = 0, []
        for k, (label, _) in enumerate(page):
            n = len(blocks_of("".join(x for _, x in page[: k + 1])))
            labels += [label] * (n - done)
            done = n
        rows += [(*x, label) for x, label in zip(features(blocks_of("".join(x for _, x in page))), labels, strict=True)]
    return rows


@lru_cache(maxsize=1)
def tree():
    return grow(labelled())


def decide(node, numbers: tuple) -> int:
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if numbers[f] <= cut else high
    return node


def name_grams(name: str) -> set[str]:
    """What a name shows: its parts (at dashes, underscores and changes of case), their beginnings and pieces of three to five letters, and which part follows which."""
    parts = [f"^{x.lower()}$" for x in PART.findall(name)]
    return {p[i : i + n] for p in parts for n in (3, 4, 5) for i in range(len(p) - n + 1)} | set(parts) | {a + b for a, b in zip(parts, parts[1:])}


@lru_cache(maxsize=1)
def name_weights() -> dict[str, float]:
    """Weights of a logistic regression on the labelled names, by gradient descent; the bias is under the empty gram."""
    rows = [(name_grams(x) | {""}, y) for y, names in ((1.0, BESIDE_NAMES), (0.0, TEXT_NAMES)) for x in names]
    place = {g: i for i, g in enumerate(sorted(set().union(*(g for g, _ in rows))))}
    x = np.zeros((len(rows), len(place)))
    for i, (grams, _) in enumerate(rows):
        x[i, [place[g] for g in grams]] = 1
    y, w = np.array([label for _, label in rows]), np.zeros(len(place))
    for _ in range(400):
        w -= 0.8 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(rows) + 0.0005 * w)
    return {g: float(w[i]) for g, i in place.items()}


@lru_cache(maxsize=4096)
def beside(name: str) -> float:
    """How likely a class, id or role names what isn't main text, 0 to 1."""
    weights = name_weights()
    return 1 / (1 + math.exp(-sum(weights.get(g, 0.0) for g in name_grams(name)) - weights[""]))


class _Tags:
    """Reads tags one after the other; each character is looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none: set[str] = set()  # quotes that don't occur any more

    def end(self, at: int) -> int:
        """Where the tag that has its attributes at ``at`` ends, behind its bracket."""
        page, n = self.page, len(self.page)
        while at < n:
            if page[at] == ">":
                return at + 1
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if not m[2]:
                at += m.end() == m.start()  # a stray character
                continue
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote not in self.none:
                close = page.find(quote, at + 1)
                if close >= 0:
                    at = close + 1
                    continue
                self.none.add(quote)
            at = UNQUOTED.match(page, at).end()
        return n


def blocks_of(page: str) -> list[tuple]:
    """(text, words, link words, in main, in boilerplate, name, kind) of each flat text block, in page order; kind is 2 in headings, 1 in paragraphs and entries of lists, else 0.

    ``in main`` is -1 outside of the main elements of a page that has some with at least a quarter of its words.
    """
    out: list[tuple] = []
    parts: list[str] = []
    linked = 0
    open_tags: list[tuple[str, int, int]] = []  # name, role, and which named element it is or -1
    counts = dict.fromkeys((MAIN_ROLE, TAG_ROLE, LINK_ROLE, HEADING_ROLE, SKIP_ROLE, PROSE_ROLE), 0)
    depth: dict[str, int] = {}
    named = [-1]  # open elements with a name, the innermost last
    outer: list[int] = []  # the named element around each named element, or -1
    scores: list[float] = []  # how likely its name says that it isn't main text
    main_within: list[bool] = []  # whether it holds an article, a main element or a first heading

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                words = text.count(" ") + 1
                out.append((text, words, min(linked, words), counts[MAIN_ROLE] > 0, counts[TAG_ROLE] > 0, named[-1], 2 if counts[HEADING_ROLE] else int(counts[PROSE_ROLE] > 0)))
            parts.clear()
        linked = 0

    def said(raw: str) -> None:
        nonlocal linked
        if raw and not counts[SKIP_ROLE]:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if counts[LINK_ROLE]:
                linked += len(text.split())

    tags, at, begin, n = _Tags(page), 0, 0, len(page)
    while True:
        at = page.find("<", at)
        if at < 0:
            said(page[begin:])
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?"):
            said(page[begin:at])
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                begin = at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", at)
                begin = at = end + 1 if end >= 0 else n
            continue
        head = HEAD.match(page, at + 1)
        if head is None:
            at += 1
            continue
        said(page[begin:at])
        name, rest = head[1].lower(), head.end()
        begin = at = tags.end(rest)
        if name not in INLINE:
            flush()
        if follows == "/":
            if depth.get(name):
                while open_tags:
                    top, role, mark = open_tags.pop()
                    depth[top] -= 1
                    if role:
                        counts[role] -= 1
                    if mark >= 0:
                        named.pop()
                    if top == name:
                        break
            continue
        if name in VOID or page.endswith("/>", rest, at):
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            begin = at = end.end() if end else n
            continue
        role = 0
        if name in SKIPPED:
            role = SKIP_ROLE
        elif name in MAIN:
            role = MAIN_ROLE
        elif name in BOILERPLATE:
            role = 0 if name == "header" and counts[MAIN_ROLE] else TAG_ROLE
        elif name == "a":
            role = LINK_ROLE
        elif len(name) == 2 and name[0] == "h" and name[1].isdigit():
            role = HEADING_ROLE
        elif name in PROSE:
            role = PROSE_ROLE
        if role == MAIN_ROLE or name == "h1":
            if named[-1] >= 0:
                main_within[named[-1]] = True
        mark = -1
        if at - rest > 4 and role in (0, HEADING_ROLE, PROSE_ROLE) and name not in ("html", "body"):
            score = max((beside(x) for _, *values in NAMED.findall(page, rest, at) for value in values for x in value.split()), default=0.0)
            if score > 0.5:
                mark = len(outer)
                scores.append(score)
                outer.append(named[-1])
                main_within.append(False)
                named.append(mark)
        open_tags.append((name, role, mark))
        depth[name] = depth.get(name, 0) + 1
        if role:
            counts[role] += 1
    flush()
    total = sum(b[1] for b in out)
    held = [0] * len(outer)  # words of each named element
    for b in out:
        if b[5] >= 0:
            held[b[5]] += b[1]
    for k in range(len(outer) - 1, -1, -1):  # an element comes after the one around it
        if outer[k] >= 0:
            held[outer[k]] += held[k]
            main_within[outer[k]] |= main_within[k]
    marked: list[float] = []
    for k, around in enumerate(outer):
        own = scores[k] if not main_within[k] and 10 * held[k] < 9 * total else 0.0
        marked.append(max(own, marked[around] if around >= 0 else 0.0))
    in_main = sum(b[1] for b in out if b[3])
    within = in_main > 0 and 4 * in_main >= total
    return [(text, words, links, 1 if inside else -int(within), int(tag), marked[k] if k >= 0 else 0.0, kind) for text, words, links, inside, tag, k, kind in out]


def features(found: list[tuple]) -> list[tuple]:
    """Each block's numbers: words, link density, in main, in boilerplate, name, kind; words and link density of the two blocks before it and the two after it."""
    none = (-1, 0.0)
    near = [none, none, *((b[1], b[2] / b[1]) for b in found), none, none]
    return [(*near[i + 2], *b[3:], *near[i + 1], *near[i + 3], *near[i], *near[i + 4]) for i, b in enumerate(found)]


def main_text(page: str) -> str:
    """The blocks that the tree takes for main text, joined by one space."""
    found, node = blocks_of(page), tree()
    return " ".join(b[0] for b, x in zip(found, features(found)) if decide(node, x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
