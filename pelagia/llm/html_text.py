"""Operator 3, main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks (text between edges of block elements). Each block has features of
its ancestors' tags, classes and roles, of the nearest ancestor that says what it is for, and of its text; an element that
holds half of the page's text or more counts as another kind than a small one of the same name, as a ``sidebar`` around
everything is none. A two-state chain (article or not), trained on labelled pages and decoded by Viterbi, picks the blocks of the article.
The labelled pages come from ``labelled_pages``: seeded layouts (menus, adverts, notices,
sidebars, forms, comments, footers around, inside and beside an article, under wrappers whose names mislead) whose blocks are labelled as they are made.

Pages are read as browsers read them: scripts, styles, titles, comments and what stands in for media that can't be shown
(inside canvas, video, object, ...) are no text and no edges of blocks; a head ends at the first thing that can't be
in one, and skipped markup without an end tag at the next block or the enclosing block's end; a page that ends inside
a tag, a comment or a script ends before it; formulas are text; character references are
decoded; white space in a block becomes one space. Reading takes time in proportion to the page. Null and empty html, and
pages without an article, give the empty text; unclosed and stray tags are borne; repeated rows are read each;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .textkit import read_table, slices

# Element names of HTML.
SKIPPED = frozenset("script style noscript template iframe svg object canvas audio video select textarea title".split())
#: Those of SKIPPED whose content is no markup: without an end tag they hold the rest of the page, as in browsers.
RAW = frozenset("script style iframe textarea title".split())
#: Elements that can't be inside an unclosed one of SKIPPED.
BREAKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img br input ruby rt rp "
                   "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts semantics".split())
CLOSED_BY_BLOCK = frozenset(["p"])
CLOSED_BY_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: A whole tag with plain attributes; all others are read attribute by attribute.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[a-zA-Z][\w:.-]*+(?:=(?:\"[^\"<>]*+\"|'[^'<>]*+'))?+)*+)([\s/]*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_GAP = re.compile(r"[\s/]*+")
_KEY = re.compile(r"([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([a-zA-Z][\w:.-]*+)=(?:\"([^\"]*+)\"|'([^']*+)')")
_WORD = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Attributes that say what an element is for.
_TELLING = frozenset(["class", "id", "role", "itemprop"])

Block = tuple[str, tuple[str, ...], int]  # text, features of the ancestors, characters inside links
Tag = tuple[int, int, bool, str, str, bool]  # start, end, closing, name, what telling attributes say, closed at once


def _tag_by_attribute(page: str, at: int) -> Tag | None:
    """The tag at ``at`` by the rules of HTML: unquoted values end at a blank or ``>``. None if the page ends first."""
    m = _NAME.match(page, at)
    pos, told = m.end(), []
    while True:
        pos = _GAP.match(page, pos).end()
        if pos >= len(page):
            return None
        if page[pos] == ">":
            return at, pos + 1, bool(m[1]), m[2].lower(), " ".join(told), page[pos - 1] == "/"
        k = _KEY.match(page, pos)
        pos, value = k.end(), ""
        if k[2]:
            quote = page[pos : pos + 1]
            if quote in ('"', "'"):
                end = page.find(quote, pos + 1)
                if end < 0:
                    return None
                value, pos = page[pos + 1 : end], end + 1
            else:
                v = _BARE.match(page, pos)
                value, pos = v[0], v.end()
        if k[1].lower() in _TELLING:
            told.append(value)


def tags(page: str) -> list[Tag]:
    """Tags, comments (no name) and raw elements (one tag each, closed at once) in page order; the rest is text."""
    out: list[Tag] = []
    at, svg, endless = page.find("<"), 0, set()
    n = len(page)
    while 0 <= at < n:
        m = _TAG.match(page, at)
        if m:
            told = " ".join(v for key, *values in _ATTR.findall(m[3]) if key.lower() in _TELLING for v in values if v) if m[3] else ""
            tag: Tag | None = (at, m.end(), bool(m[1]), m[2].lower(), told, "/" in m[4])
        elif _NAME.match(page, at):
            tag = _tag_by_attribute(page, at)
        elif page.startswith("<!--", at):
            end = at + 5 if page.startswith(">", at + 4) else at + 6 if page.startswith("->", at + 4) else (c.end() if (c := _COMMENT_END.search(page, at + 4)) else n)
            tag = (at, end, False, "", "", True)
        elif page[at + 1 : at + 2] in ("!", "?", "/") and at + 2 < n:
            end = page.find(">", at + 2) + 1
            tag = (at, end or n, False, "", "", True)
        else:
            at = page.find("<", at + 1)
            continue
        if tag is None:
            out.append((at, n, False, "", "", True))
            break
        _, end, closing, name, _, empty = tag
        if name == "svg" and not empty:
            svg = max(0, svg - 1) if closing else svg + 1
        if name in RAW and not closing:
            close = None if name in endless or empty and svg else _END[name].search(page, end)
            if close:
                tag = (at, page.find(">", close.end()) + 1 or n, False, name, "", True)
            elif svg:
                endless |= set() if empty else {name}
                tag = (at, end, False, "", "", True)
            else:
                tag = (at, n, False, name, "", True)
        out.append(tag)
        at = page.find("<", tag[1])
    return out


def skipped_ends(found: list[Tag], n: int) -> dict[int, int]:
    """Where each skipped element of markup ends, by its start: after its end tag or, if the enclosing block ends first, at the first block inside it or else there."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    whole: list[int] = []  # open skipped elements with no block inside so far
    for start, end, closing, name, _, empty in found:
        if not name or name in INLINE or name in VOID and name not in BREAKS or name == "head" or name in RAW:
            continue
        if closing:
            while opened[name]:
                own, at = stack.pop()
                opened[own] -= 1
                if own in SKIPPED:
                    ends[at] = end if own == name else ends.get(at, start)
                if own == name:
                    break
            continue
        if name in BREAKS:
            for at in whole:
                ends.setdefault(at, start)
            whole.clear()
        if name not in VOID and not empty:
            stack.append((name, start))
            opened[name] += 1
            if name in SKIPPED:
                whole.append(start)
    return {at: n for own, at in stack if own in SKIPPED} | ends


#: Share of the page's text from which on an element is wide.
WIDE = 0.5
#: Elements that say what they are for by their name.
SECTIONS = frozenset("article aside footer form header main nav section".split())


def base_of(feature: str) -> str:
    """What an element's own feature is called before its size and place are told."""
    return feature.removeprefix("by=").removeprefix("wide:")


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order, with those features of their ancestors whose base is ``known`` (all by default)."""
    stack: list[tuple[str, int, int]] = []  # name, number of the element, nearest element at or above that is not inline
    opened: Counter = Counter()
    parts: list[str] = []
    linked = 0
    found = tags(page)
    ends = skipped_ends(found, len(page)) if any(t[3] in SKIPPED and t[3] not in RAW for t in found) else {}
    steps: list[tuple | int | None] = []  # a block, an element that opens, or the last one open that ends
    own: list[list[str]] = []  # features of each element
    share: list[float] = []  # characters before it, then those inside it
    total = 0

    def flush() -> None:
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = stack[-1][2] if stack else -1
                steps.append((text, stack[at][0] if at >= 0 else "", linked))
                total += len(text)
            parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if opened["a"]:
                linked += len(text.strip())

    def pop() -> str:
        name, number, _ = stack.pop()
        opened[name] -= 1
        share[number] = total - share[number]
        steps.append(None)
        return name

    pos = 0
    for start, end, closing, name, told, empty in found:
        if start < pos:  # inside something skipped
            continue
        add(page[pos:start])
        pos = end
        if not name:
            continue
        if closing:
            if name not in INLINE:
                flush()
            while opened[name] and pop() != name:
                pass
            continue
        if name in SKIPPED:
            pos = end if empty else max(end, ends.get(start, end))
            continue
        if name == "head":  # what can be in a head is skipped anyway; anything else ends it
            flush()
            continue
        if name == "br":
            parts.append(" ")
        if name not in INLINE:
            flush()
            closes = CLOSED_BY_SELF.get(name, frozenset()) | CLOSED_BY_BLOCK
            at, cut = stack[-1][2] if stack else -1, None
            while at >= 0 and stack[at][0] in closes:
                cut = at
                at = stack[at - 1][2] if at else -1
            while cut is not None and len(stack) > cut:
                pop()
        if name not in VOID and not empty:
            own.append([f for f in (f"in={name}", *(f"is={w}" for w in dict.fromkeys(_WORD.findall(told.lower())))) if known is None or f in known])
            stack.append((name, len(own) - 1, len(stack) if name not in INLINE else stack[-1][2] if stack else -1))
            opened[name] += 1
            share.append(total)
            steps.append(len(own) - 1)
    add(page[pos:])
    flush()
    while stack:
        pop()
    return _told(steps, own, share, total)


def _told(steps: list, own: list[list[str]], share: list[float], total: int) -> list[Block]:
    """Blocks with the features of what was open around them."""
    out: list[Block] = []
    active: Counter = Counter()  # features of all open elements
    stack: list[list[str]] = []
    marks: list[tuple[int, list[str]]] = []  # open elements that say what they are for: depth, features
    for step in steps:
        if step is None:
            for f in stack.pop():
                active[f] -= 1
                if not active[f]:
                    del active[f]
            if marks and marks[-1][0] > len(stack):
                marks.pop()
        elif isinstance(step, int):
            wide = share[step] >= WIDE * total
            named = [f"wide:{f}" for f in own[step]] if wide else own[step]
            stack.append(named)
            active.update(named)
            if telling := [f"by={f}" for f in named if "is=" in f or f.rsplit("=", 1)[1] in SECTIONS]:
                marks.append((len(stack), telling))
        else:
            text, leaf, linked = step
            out.append((text, (*active, *(marks[-1][1] if marks else ("by=",)), f"leaf={leaf}"), linked))
    return out


# Words of short labels around articles.
_SAYS = frozenset("about advertisement comment comments contact cookie cookies copyright email home login menu more newsletter password popular privacy related replies reply search share sponsored subscribe tags terms trending".split())


def features(found: list[Block]) -> list[list[str]]:
    """Of each block: its ancestors, what its text looks like, and its place."""
    out = []
    for k, (text, path, linked) in enumerate(found):
        n = len(text)
        short = n < 40 and not _SAYS.isdisjoint(_WORD.findall(text.lower())[:4])
        out.append([*path, "bias", f"length={min(7, n.bit_length() - 2)}", f"linked={round(4 * min(1, linked / n))}", f"end={text[-1] if text[-1] in '.!?:»”' else 'w'}",
                    f"stops={min(3, text.count('. ') + text.count(', '))}", f"signs={any(c in text for c in '©®|»›')}", f"first={k == 0}", f"last={k == len(found) - 1}", f"says={short}"])
    return out


# ---- labelled pages

# How layouts mark what is not the article, and what such parts say.
_ROLES = {
    "menu": ("nav", "menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "navigation", "toc", "topbar"),
    "header": ("header", "header", "masthead", "banner", "top", "logo"),
    "footer": ("footer", "footer", "copyright", "bottom", "colophon", "legal"),
    "side": ("aside", "sidebar", "related posts", "related", "widget", "share social", "recommended", "popular", "trending", "tags", "more stories", "rail"),
    "notice": ("div", "cookie notice", "consent banner", "popup modal", "newsletter", "notice", "alert", "gdpr", "paywall"),
    "advert": ("div", "ad", "ads", "advert", "sponsored promo", "advertisement", "adsbygoogle", "sponsor"),
    "form": ("form", "search", "subscribe", "login", "signup", "contact form", "poll"),
    "comments": ("div", "comments", "commentlist", "comment reply", "responses", "disqus thread", "user reviews", "discussion", "respond", "replies"),
}
_MAIN = (("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "post body"), ("div", "article text"), ("div", "entry"), ("section", "story"), ("div", "main"), ("div", ""))
_PHRASES = {
    "menu": ("Home", "News", "About us", "Contact", "Menu"), "header": ("Search", "Login", "Home"), "footer": ("Privacy", "Terms", "Copyright"), "side": ("Related", "Most popular", "Share this", "Tags", "More stories", "Trending"),
    "notice": ("We use cookies", "Subscribe to our newsletter"), "advert": ("Advertisement", "Sponsored"), "form": ("Search", "Your email", "Password", "Subscribe", "Login"), "comments": ("Comments", "3 comments", "Leave a reply", "Replies"),
}
#: What names of wrappers and of parts are joined with.
_JOINED = ("{}-open", "{}-fixed", "has-{}", "{}-free", "with-{}", "{}-enabled", "no-{}", "right-{}", "{}", "{}_on")


def labelled_pages(n: int, seed: int = 17) -> Iterator[tuple[str, list[int]]]:
    """Pages and, for each leaf block in page order, 1 if it is of the article."""
    rng = random.Random(seed)
    letters = "aeiounrstlmdch"
    every = [w for names in _ROLES.values() for x in names[1:] for w in x.split()]

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence() -> str:
        return words(4, 14).capitalize() + rng.choice([".", ".", ".", "!", "?", ", " + words(2, 6) + "."])

    def prose(a: int, b: int) -> str:
        return " ".join(sentence() for _ in range(rng.randint(a, b)))

    def misleading() -> str:
        """Attributes of a wrapper: names of parts, which say nothing here."""
        held = [rng.choice(_JOINED).format(rng.choice(every)) for _ in range(rng.randint(1, 4))] + rng.sample(["page", "home", "wrapper", "container", "layout", "single"], rng.randint(0, 2))
        rng.shuffle(held)
        return f' {rng.choice(["class", "class", "id"])}="{" ".join(held)}"' if rng.random() < 0.7 else rng.choice(["", ' id="main"', ' id="wrapper"', ' class="container"'])

    for _ in range(n):
        out: list[str] = []
        labels: list[int] = []

        def put(text: str, label: int) -> None:
            out.append(text)  # noqa: B023
            labels.append(label)  # noqa: B023

        def block(tag: str, text: str, label: int) -> None:
            closing = "" if tag in ("p", "li") and rng.random() < 0.15 else f"</{tag}>"
            put(f"<{tag}>{text}{closing}", label)

        def heading(role: str) -> str:
            return rng.choice(_PHRASES[role]) if rng.random() < 0.5 else words(1, 4).capitalize()

        def extra(role: str) -> None:
            plain, *names = _ROLES[role]
            tag, marked = plain, ""
            if plain == "div" or rng.random() < 0.6:
                name = rng.choice(names)
                tag = rng.choice((plain, "div", "div", "section", "aside", "ul" if role in ("menu", "side") else "div"))
                joined = rng.choice(["{}", "{}", "site {}", "page {}", "{}-wrapper", "block-{}", "{}-inner", "main {}"]).format(rng.choice(["-", "_", " "]).join(name.split()))
                marked = f' {rng.choice(["class", "class", "id"])}="{joined}"'
            if role in ("comments", "side") and rng.random() < 0.2:  # its heading stands before it
                block(rng.choice(["h2", "h3"]), rng.choice(_PHRASES[role]), 0)
            out.append(f"<{tag}{marked}>")  # noqa: B023
            if role in ("menu", "side", "header") and rng.random() < 0.75:
                if role == "side" and rng.random() < 0.6:
                    block(rng.choice(["h2", "h3", "h4", "div"]), heading(role), 0)
                links = [f'<a href="/">{heading(role)}</a>' for _ in range(rng.choice([1, 2, 2, 3, 5, 8]))]
                if tag != "ul" and rng.random() < 0.4:
                    put(rng.choice([" ", " | ", "\n", " &raquo; "]).join(links), 0)
                else:
                    out.append("" if tag == "ul" else "<ul>")  # noqa: B023
                    for x in links:
                        block("li", x, 0)
                    out.append("" if tag == "ul" else "</ul>")  # noqa: B023
            elif role == "form":
                if rng.random() < 0.5:
                    block(rng.choice(["h3", "legend", "div"]), heading(role), 0)
                if rng.random() < 0.7:
                    put(f"<label>{heading(role)}</label> <input type=text>", 0)
                block("button", heading(role), 0)
            elif role == "comments":
                if rng.random() < 0.6:
                    block(rng.choice(["h2", "h3", "h4", "p"]), heading(role), 0)
                for _ in range(rng.randint(1, 5)):
                    block(rng.choice(["p", "li", "div"]), prose(1, 4), 0)
            elif role == "notice" and rng.random() < 0.4:
                put(heading(role), 0)
                block("button", rng.choice(["OK", "Accept", words(1, 2)]), 0)
            elif rng.random() < 0.6:
                put(("&copy; " if role == "footer" and rng.random() < 0.6 else "") + (heading(role) if rng.random() < 0.4 else prose(1, 3)), 0)
            else:
                for _ in range(rng.randint(1, 3)):
                    block(rng.choice(["p", "div", "h3"]), heading(role) if rng.random() < 0.3 else prose(1, 3), 0)
            out.append(f"</{tag}>")  # noqa: B023

        def some(roles: tuple[str, ...], often: dict[str, float]) -> None:
            for role in roles:
                if rng.random() < often.get(role, 0.35):
                    extra(role)

        def article() -> None:
            tag, name = rng.choice(_MAIN)
            noise = " " + rng.choice(_JOINED).format(rng.choice(every)) if rng.random() < 0.1 else ""
            out.append(f'<{tag} {rng.choice(["class", "class", "id"])}="{name}{noise}">' if name or noise else f"<{tag}>")  # noqa: B023
            if rng.random() < 0.85:
                top = rng.random() < 0.15
                out.append("<header>" if top else "")  # noqa: B023
                block(rng.choice(["h1", "h1", "h2"]), words(2, 10).capitalize(), 1)
                out.append("</header>" if top else "")  # noqa: B023
            inner = rng.random() < 0.3
            out.append(rng.choice(['<div class="entry-content">', '<div class="body">', "<div>", '<section class="text">']) if inner else "")  # noqa: B023
            opened = out[-1]  # noqa: B023
            for _ in range(rng.randint(1, 9)):
                kind = rng.random()
                if kind < 0.08:
                    block(rng.choice(["h2", "h3"]), words(1, 5).capitalize(), 1)
                elif kind < 0.16:
                    out.append("<ul>")  # noqa: B023
                    for _ in range(rng.randint(1, 4)):
                        block("li", words(2, 12), 1)
                    out.append("</ul>")  # noqa: B023
                elif kind < 0.25:
                    extra(rng.choice(["advert", "side", "form", "form", "notice"]))
                elif kind < 0.33:
                    block("blockquote", prose(1, 2), 1)
                elif kind < 0.36:
                    block("figcaption", sentence(), 1)
                elif kind < 0.46:
                    block("p", f'{sentence()} <a href="/">{words(1, 4)}</a> {prose(0, 3)}', 1)
                else:
                    block("p", rng.choice(["", "<b>", "<em>"]) + rng.choice([words(1, 3) + ".", prose(1, 8), prose(2, 10)]) + rng.choice(["", "<br>"]), 1)
            out.append("</section>" if opened.startswith("<section") else "</div>" if inner else "")  # noqa: B023
            if rng.random() < 0.15:
                extra(rng.choice(["comments", "side", "form"]))
            out.append(f"</{tag}>")  # noqa: B023

        out += ["<!DOCTYPE html><html><head><title>", words(2, 6), "</title><style>p{}</style></head>", f"<body{misleading()}>"]
        wrappers = [(rng.choice(["div", "div", "div", "form", "main", "section", "center"]), misleading()) for _ in range(rng.choice([0, 0, 1, 2]))]
        out += [f"<{tag}{marks}>" for tag, marks in wrappers]
        some(("header", "menu", "notice", "advert", "side"), {"menu": 0.75})
        around = (rng.choice(["div", "div", "main"]), misleading()) if rng.random() < 0.4 else None
        out.append(f"<{around[0]}{around[1]}>" if around else "")
        if around:
            some(("menu", "side"), {"menu": 0.15, "side": 0.25})
        if rng.random() < 0.97:
            article()
        if around:
            some(("comments", "side", "form"), {"comments": 0.25, "side": 0.3, "form": 0.15})
            out.append(f"</{around[0]}>")
        some(("comments", "side", "advert", "form", "menu", "footer"), {"footer": 0.6, "menu": 0.2})
        out += [f"</{tag}>" for tag, _ in wrappers[::-1]]
        out.append(rng.choice(["</body></html>", ""]))
        if labels:
            yield "".join(out), labels


# ---- the chain


class Chain:
    """Two-state linear-chain CRF: a weight for each feature and state, and for each pair of neighbour states."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves
        self.bases = frozenset(map(base_of, names))

    def rows(self, feats: list[list[str]]) -> list[np.ndarray]:
        return [np.fromiter((k for f in own if (k := self.names.get(f)) is not None), np.int64) for own in feats]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum(0) for r in rows])

    def gradient(self, rows: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood: by the scores of each block, and by the moves. Forwards and backwards with sums scaled to one."""
        s, n = self.scores(rows), len(rows)
        weight = np.exp(s - s.max(1, keepdims=True)).tolist()
        (aa, ab), (ba, bb) = np.exp(self.moves - self.moves.max()).tolist()
        ahead, x, y = [], 1.0, 1.0
        for k, (p, q) in enumerate(weight):
            x, y = (p, q) if k == 0 else ((x * aa + y * ba) * p, (x * ab + y * bb) * q)
            x, y = x / (x + y), y / (x + y)
            ahead.append((x, y))
        unary, pair, x, y = np.empty((n, 2)), np.zeros((2, 2)), 1.0, 1.0
        for k in range(n - 1, -1, -1):
            p, q = ahead[k][0] * x, ahead[k][1] * y
            unary[k] = -p / (p + q), -q / (p + q)
            if k:
                x, y = x * weight[k][0], y * weight[k][1]
                f, g = ahead[k - 1]
                both = (f * aa * x, f * ab * y, g * ba * x, g * bb * y)
                whole = sum(both)
                pair -= np.array(both).reshape(2, 2) / whole
                pair[labels[k - 1], labels[k]] += 1
                x, y = aa * x + ab * y, ba * x + bb * y
                x, y = x / (x + y), y / (x + y)
        unary[np.arange(n), labels] += 1
        return unary, pair

    def decode(self, feats: list[list[str]]) -> list[int]:
        """Viterbi."""
        if not feats:
            return []
        s = self.scores(self.rows(feats)).tolist()
        (aa, ab), (ba, bb) = self.moves.tolist()
        a, b = s[0]
        came = []
        for x, y in s[1:]:
            came.append((a + aa < b + ba, a + ab < b + bb))
            a, b = max(a + aa, b + ba) + x, max(a + ab, b + bb) + y
        state = int(b > a)
        out = [state]
        for step in reversed(came):
            state = int(step[state])
            out.append(state)
        return out[::-1]


def train(pages: Iterator[tuple[str, list[int]]], epochs: int = 8, rate: float = 0.3, decay: float = 1e-4) -> Chain:
    """AdaGrad on the log-likelihood, a page at a time."""
    data = []
    for page, labels in pages:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError("labels and blocks differ")
        data.append((features(found), labels))
    names = {f: k for k, f in enumerate(sorted({f for feats, _ in data for own in feats for f in own}))}
    chain = Chain(names, np.zeros((len(names), 2)), np.zeros((2, 2)))
    rows = [(chain.rows(feats), labels) for feats, labels in data if labels]
    seen, seen_moves = np.full((len(names), 2), 1e-2), np.full((2, 2), 1e-2)
    for _ in range(epochs):
        for own, labels in rows:
            unary, pair = chain.gradient(own, labels)
            at, g = np.concatenate(own), np.repeat(unary, [len(r) for r in own], 0)
            step = np.zeros_like(chain.weights)
            np.add.at(step, at, g)
            step -= decay * chain.weights
            seen += step**2
            seen_moves += pair**2
            chain.weights += rate * step / np.sqrt(seen)
            chain.moves += rate * pair / np.sqrt(seen_moves)
    return chain


@cache
def trained(pages: int = 600, seed: int = 17) -> Chain:
    """The chain that ``extract`` uses: trained once a session, on that many labelled pages."""
    return train(labelled_pages(pages, seed))


def main_text(page: str | None, chain: Chain) -> str:
    found = blocks(page or "", chain.bases)
    return "\n".join(b[0] for b, keep in zip(found, chain.decode(features(found)), strict=True) if keep)


def extract(spark: SparkSession, pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), chain: Chain | None = None) -> DataFrame:
    """The ``keep`` columns, text and n_chars of each page."""
    chain = chain or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__html"):
            texts = [main_text(x, chain) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, "text", "n_chars"])

    schema = StructType([*(pages.schema[c] for c in keep), StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select(*keep, pages[column].alias("__html")).mapInArrow(run, schema)


def op3_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, read_table(spark, sf_dir, "pages"))


QUERIES = {"op3_html_crf": op3_html_crf}
ORACLES: dict[str, str] = {}
