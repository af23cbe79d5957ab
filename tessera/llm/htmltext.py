"""HTML main text (5): a linear-chain conditional random field over DOM leaf blocks.

A page is read once by a tolerant tag scanner: comments, scripts, styles and
other unseen elements go, inline elements do not end a block, every other tag
does.  A block carries the tags and class/id words of its open elements.
Features are its tags, its ancestors' tags and class words, and coarse text
shape (length, links, punctuation, place in the page).  Labels are ``main``
and ``other``.  The field is trained on labelled pages: ``labelled_pages``
makes a fixed number of them from templates of common page layouts, whose every
block is labelled, with made-up words so that no language is learned.  Viterbi
decoding picks the blocks of the article.

Character references are decoded, white space in a block becomes one blank,
blocks are trimmed and joined by one blank in page order.

What a page shows counts: text of formulas and drawings and text that is only
hidden from screen readers is read; elements with the attribute ``hidden`` or
the style ``display: none``, the parts of forms and what stands in for scripts
and objects are not.

Defined cases: null or empty html gives empty text; texts, pages and nesting of
any size are read whole; unclosed elements and pages
that break off are read as far as they go; a page without any article block
gives empty text; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
from functools import lru_cache
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.crf import ChainCRF

DIM, N_TRAINING_PAGES = 1 << 13, 300
OTHER, MAIN = 0, 1
INLINE = frozenset("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup mstyle semantics tspan a abbr acronym b bdi bdo big cite code data dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
UNSEEN = frozenset("script style noscript template iframe object canvas head title textarea select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)", re.I)
_UNSHOWN = re.compile(r"(?:^|\s)style\s*=\s*(?:\"[^\"]*?|'[^']*?)display\s*:\s*none", re.I)


class Block:
    __slots__ = ("text", "tag", "path", "marks", "n_link")

    def __init__(self, text: str, tag: str, path: tuple[str, ...], marks: tuple[str, ...], n_link: int):
        self.text, self.tag, self.path, self.marks, self.n_link = text, tag, path, marks, n_link


@lru_cache(maxsize=4096)
def _marks(attrs: str) -> tuple[str, ...]:
    found = []
    for m in _ATTR.finditer(attrs):
        found += _WORDS.findall((m[1] or m[2] or m[3] or "").lower())
    return tuple(dict.fromkeys(found))


@lru_cache(maxsize=4096)
def _dark(attrs: str) -> bool:
    """Whether the attribute ``hidden`` or the style says that nothing is shown; a class of that name says nothing."""
    return bool(_HIDDEN.search(_QUOTED.sub("''", attrs)) or _UNSHOWN.search(attrs))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page with text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, class/id words, unseen
    places: dict[str, list[int]] = {}  # of each tag's open elements in the stack
    outer: list[int] = []  # places of the open elements that are not inline
    parts: list[str] = []
    linked = 0
    unseen = 0

    def close(place: int) -> None:
        nonlocal unseen
        while len(stack) > place:
            t, _, dark = stack.pop()
            places[t].pop()
            unseen -= dark
            if t not in INLINE:
                outer.pop()

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                path = tuple(t for t, _, _ in stack)
                tag = next((t for t in reversed(path) if t not in INLINE), "")
                out.append(Block(text, tag, path, tuple(x for _, m, _ in stack for x in m), min(linked, len(text))))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not unseen:
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name not in INLINE:
                end()
            mine = places.get(name)
            if mine and (name not in INLINE or not outer or mine[-1] > outer[-1]):
                close(mine[-1])
            continue
        if name not in INLINE:
            end()
        if name in VOID:
            continue
        if name in CLOSES_P and outer and stack[outer[-1]][0] == "p":  # an open paragraph ends, with the inline elements in it
            close(outer[-1])
        attrs = m[3] or ""
        if attrs.endswith("/"):
            continue
        if name in RAW:  # their content has no tags
            stop = re.compile(f"</{name}\\s*>", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        if name in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        dark = name in UNSEEN or bool(attrs) and _dark(attrs)
        unseen += dark
        places.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            outer.append(len(stack))
        stack.append((name, _marks(attrs) if attrs else (), dark))
    end()
    return out


@lru_cache(maxsize=1 << 16)
def _number(name: str) -> int:
    return crc32(name.encode()) % DIM


@lru_cache(maxsize=1 << 14)
def _tree_features(tag: str, path: tuple[str, ...], marks: tuple[str, ...]) -> tuple[int, ...]:
    names = ["bias", f"tag={tag}"]
    names += {f"in={t}" for t in path if t not in ("html", "body", tag) and t not in INLINE}
    names += {f"mark={x}" for x in marks}
    names += {f"mark2={x[:6]}" for x in marks if len(x) > 6}
    last = [t for t in path if t not in INLINE][-3:]
    names.append("path=" + "/".join(last))
    return tuple(sorted({_number(x) for x in names}))


def features_of(blocks: list[Block]) -> list[list[int]]:
    out = []
    n = len(blocks)
    for i, b in enumerate(blocks):
        k = len(b.text)
        words = b.text.count(" ") + 1
        share = b.n_link / k
        names = [f"len={min(8, k.bit_length())}", f"words={min(7, words.bit_length())}", f"link={int(share * 4)}", f"stop={b.text[-1] in '.!?…:;'}",
                 f"copy={'©' in b.text or '(c)' in b.text.lower()}", f"edge={'first' if i < 2 else 'last' if i >= n - 2 else 'mid'}",
                 f"tag={b.tag}&len={min(8, k.bit_length())}", f"bar={b.text.count('|') > 1}"]
        out.append([*_tree_features(b.tag, b.path, b.marks), *map(_number, names)])
    return out


def labelled_pages(n: int = N_TRAINING_PAGES, seed: int = 11) -> list[str]:
    """Pages of common layouts; text of the article starts its words with ``q``, all other text with ``z``."""
    r = random.Random(seed)

    def words(k: int, first: str, stop: str = ".") -> str:
        w = [first + "".join(r.choice("aeioulmnrst") for _ in range(r.randint(1, 8))) for _ in range(max(1, k))]
        return " ".join(w).capitalize() + stop

    def z(lo: int, hi: int, stop: str = "") -> str:
        return words(r.randint(lo, hi), "z", stop)

    def pick(*x: str) -> str:
        return r.choice(x)

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{z(1, 3)}</a></{tag}>' for i in range(k))

    def para() -> str:
        t = words(int(r.paretovariate(0.9) * 4) % 200 + 1, "q", pick(".", ".", ".", "", "!"))
        if r.random() < 0.25:
            a = t.split(" ")
            i = r.randrange(len(a))
            a[i] = f"<{(x := pick('b', 'i', 'em', 'strong', 'a', 'span'))}>{a[i]}</{x}>"
            t = " ".join(a)
        return t

    def body_part() -> str:
        kind = r.random()
        if kind < 0.7:
            return f"<p>{para()}" + pick("</p>", "</p>", "")
        if kind < 0.78:
            return f"<h{(h := r.randint(2, 4))}>{words(r.randint(1, 8), 'q', '')}</h{h}>"
        if kind < 0.84:
            return "<ul>" + "".join(f"<li>{para()}</li>" for _ in range(r.randint(1, 4))) + "</ul>"
        if kind < 0.88:
            return f"<blockquote>{pick('<p>', '')}{para()}</blockquote>"
        if kind < 0.91:
            return f"<pre>{para()}</pre>"
        if kind < 0.94:
            return "<table><tr>" + "".join(f"<td>{words(2, 'q', '')}</td>" for _ in range(3)) + "</tr></table>"
        if kind < 0.97:
            return f"<figure><img src=x><figcaption>{words(r.randint(2, 12), 'q')}</figcaption></figure>"
        return f"{para()}<br>"

    def junk_inside() -> str:
        return pick(
            f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner")}">{z(2, 20, ".")}</div>',
            f'<div class="{pick("share", "social", "share-buttons", "related", "related-posts", "newsletter", "subscribe")}">{links(r.randint(1, 4), "span")}</div>',
            f'<aside>{z(2, 25, ".")}</aside>', f'<form><label>{z(1, 3)}</label><input><button>{z(1, 2)}</button></form>', "")

    def top() -> str:
        out = []
        if r.random() < 0.5:
            out.append(f'<div class="{pick("cookie", "cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "popup", "modal")}"><p>{z(3, 25, ".")}</p><button>{z(1, 2)}</button></div>')
        if r.random() < 0.6:
            out.append(f'<{(t := pick("header", "div"))} {pick("id", "class")}="{pick("header", "masthead", "site-header", "top", "topbar", "branding")}"><{(h := pick("h1", "p", "div", "span", "a"))}>{z(1, 5)}</{h}>{pick("", f"<p>{z(2, 9)}</p>")}</{t}>')
        if r.random() < 0.85:
            out.append(pick(f"<nav><ul>{links(r.randint(2, 8))}</ul></nav>", f'<div {pick("id", "class")}="{pick("nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs")}"><ul>{links(r.randint(2, 8))}</ul></div>',
                            f"<nav>{links(r.randint(1, 6), 'span')}</nav>", f"<nav>{z(1, 12)}</nav>"))
        if r.random() < 0.5:
            out.append(f'<div {pick("id", "class")}="{pick("ad", "ads", "ad-top", "advert", "banner", "sponsor", "promo")}">{pick("", "<p>")}{z(1, 40, pick(".", ""))}</div>')
        if r.random() < 0.15:
            out.append(f'<form {pick("", "class=search id=search")}><label>{z(1, 4)}</label><input name=q><button>{z(1, 2)}</button></form>')
        return "".join(r.sample(out, len(out))) if r.random() < 0.3 else "".join(out)

    def side() -> str:
        return f'<{(t := pick("aside", "div", "section"))} {pick("id", "class")}="{pick("sidebar", "side", "widget", "widgets", "rail", "related", "recent", "tags")}">{pick(f"<h3>{z(1, 4)}</h3>", "")}{pick(f"<ul>{links(r.randint(1, 6))}</ul>", f"<p>{z(3, 40, chr(46))}</p>")}</{t}>'

    def comments() -> str:
        one = lambda: f'<{(t := pick("div", "li", "article"))} class="{pick("comment", "comment-body", "reply", "response")}"><{(s := pick("span", "b", "p", "h4"))} class=author>{z(1, 3)}</{s}><p>{z(2, 60, ".")}</p></{t}>'
        return f'<{(t := pick("section", "div", "ul"))} {pick("id", "class")}="{pick("comments", "comment-list", "discussion", "responses", "replies", "disqus")}">{pick(f"<h3>{z(1, 4)}</h3>", "")}{"".join(one() for _ in range(r.randint(1, 6)))}</{t}>'

    def foot() -> str:
        return pick(f"<footer>{pick('&copy; ', '')}{z(2, 20, pick('.', ''))}</footer>", f"<footer><p>&copy; {z(2, 12)}</p><ul>{links(3)}</ul></footer>",
                    f'<div {pick("id", "class")}="{pick("footer", "foot", "site-footer", "copyright", "legal", "disclaimer")}"><p>{z(2, 25, ".")}</p>{pick("", f"<ul>{links(3)}</ul>")}</div>')

    pages = []
    for i in range(n):
        # some pages have one short paragraph only
        k = pick("1", "1", "2", "5", "9", "14")
        inner = pick(f"<h1>{words(r.randint(1, 12), 'q', pick('', '.'))}</h1>", f"<header><h1>{words(r.randint(1, 12), 'q', '')}</h1></header>" if i % 9 == 0 else "", f"<h1>{words(r.randint(1, 14), 'q', '')}</h1>")
        inner += f'<div class="{pick("byline", "meta", "date")}">{z(1, 5)}</div>' if r.random() < 0.1 else ""
        inner += "".join(body_part() + (junk_inside() if r.random() < 0.15 else "") for _ in range(int(k)))
        # an article's opening paragraph may never be closed
        inner = inner.replace("<p>", "<p><b>", 1) if r.random() < 0.2 else inner
        o, c = r.choice([("<article>", "</article>")] * 5 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="main">', "</div>"), ('<div class="post">', "</div>"),
                         ('<div class="article-body">', "</div>"), ('<section class="entry-content">', "</section>"), ('<div itemprop="articleBody">', "</div>"), ('<div id="story">', "</div>"), ("<div>", "</div>"), ("", ""), ("", ""), ("<center><font>", "</font></center>"), ("<table><tr><td>", "</td></tr></table>"), ('<div id="page"><div class="text">', "</div></div>")])
        inner += comments() if r.random() < 0.08 else ""
        mid = o + inner + c
        mid = side() + mid if r.random() < 0.2 else mid
        mid += side() if r.random() < 0.3 else ""
        mid += comments() if r.random() < 0.35 else ""
        body = top() + mid + (foot() if r.random() < 0.9 else "")
        pages.append(f"<!DOCTYPE html><html><head><title>{z(2, 8)}</title><script>var a='</p>';</script></head><body>{body}</body></html>")
    return pages


@lru_cache(maxsize=1)
def field() -> ChainCRF:
    """The field trained on the labelled pages."""
    data = []
    for page in labelled_pages():
        blocks = blocks_of(page)
        if blocks:
            y = [MAIN if sum(w[:1] in "qQ" for w in b.text.split()) * 2 > len(b.text.split()) else OTHER for b in blocks]
            data.append((features_of(blocks), y))
    return ChainCRF(2, DIM).fit(data, epochs=6)


def main_text(page: str | None, crf: ChainCRF | None = None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    y = (crf or field()).decode(features_of(blocks))
    return " ".join(b.text for b, label in zip(blocks, y) if label == MAIN)


_FIELD: list[ChainCRF] = []


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    kind = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    w = field()
    used = {i: w.w[i].tolist() for i in range(DIM) if w.w[i].any()}
    state = (used, w.t.tolist(), w.s.tolist())

    def run(batches):
        import numpy as np

        if not _FIELD:
            crf = ChainCRF(2, DIM)
            for i, x in state[0].items():
                crf.w[i] = x
            crf.t, crf.s = np.asarray(state[1]), np.asarray(state[2])
            _FIELD.append(crf)
        for b in batches:
            text = [main_text(x, _FIELD[0]) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(html_col).alias("h")).mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
