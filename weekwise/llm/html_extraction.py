"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags.
Each block has features of its ancestors (tag names and the words of their
class, id and role) and of its text (length, share of linked text, closing
punctuation, place). A two-label chain (main text or not) scores whole label
sequences, so a block also counts by its neighbours. The weights are trained
in numpy on labelled pages (`labelled_pages` builds them from many layouts
with neutral syllable text); pages are decoded by Viterbi.

Text rules: character references are decoded; white space inside a block
becomes one space; blocks are joined in page order by one line feed.
Scripts, styles, templates, comments and the page head never make a block.

Defined results
- null and empty html, or a page without main text: the empty text, 0 code points.
- broken markup: unclosed elements end with what encloses them, stray end
  tags are ignored, an unfinished tag or comment at the end is dropped.
- repeated rows are extracted alike; extra columns pass through unless a
  result has the same name; empty table: no rows.
- buttons, selections and text fields lie in the text around them, their own
  text is dropped; `<svg/>` and `<math/>` may close themselves.
- a very long page is one task's work: parsing and decoding grow with its size,
  and with the depth of elements that differ in their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# A quoted value is read whole up to 8192 characters, and a tag up to 400 quotes; beyond that it ends at the next >.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]{0,8192}"|'[^']{0,8192}'){0,400}+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>|<[!?/a-zA-Z][^>]*+\Z""",
    re.S,
)
UNFINISHED = re.compile(r"<!--.*|<[!?/a-zA-Z].*", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript title svg math iframe object head".split())
CONTROLS = frozenset("button select textarea".split())  # inside the text around them, without their own
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span "
    "strike strong sub sup time tt u var img br wbr".split()
)
# Opening one of these ends an open element of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    context: tuple[str, ...]  # features of the ancestors
    tag: str


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    # Open elements: tag, features up to and including it, inside a link.
    stack: list[tuple[str, tuple[str, ...], bool]] = [("", (), False)]
    parts: list[str] = []
    linked, base = 0, 0
    at, n = 0, len(page)
    open_: Counter[str] = Counter()  # of the stack, so that no end tag searches it in vain
    last = page.rfind(">")
    ends_of: dict[str, list[int]] = {}

    def close(i: int) -> None:
        open_.subtract(s[0] for s in stack[i:])
        del stack[i:]

    def end_of(tag: str) -> int | None:
        """Where the next end tag of this name ends."""
        if tag not in ends_of:
            ends_of[tag] = [m.end() for m in re.compile(rf"</{tag}\b[^>]*+>", re.I).finditer(page, at)][::-1]
        left = ends_of[tag]
        while left and left[-1] <= at:
            left.pop()
        return left[-1] if left else None

    def flush() -> None:
        nonlocal linked, base
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                tag = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append(Block(text, linked, stack[base][1] if base < len(stack) else stack[-1][1], tag))
            parts.clear()
        linked, base = 0, len(stack) - 1

    while at < n:
        # Beyond the last > nothing is a tag: what is unfinished there is dropped.
        m = TOKEN.search(page, at) if at <= last else UNFINISHED.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if not parts:
                base = len(stack) - 1
            parts.append(text)
            if stack[-1][2]:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is TOKEN else ""
        if not tag:
            continue
        if m[1] or m[4]:
            if not open_[tag]:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE:
                        flush()
                    close(i)
                    base = min(base, len(stack) - 1)
                    break
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW or tag in CONTROLS:
            if tag in ("svg", "math") and attributes.rstrip().endswith("/"):
                continue
            end = end_of(tag)
            if tag == "head" and end is None:  # an unclosed head ends where the body begins
                body = re.compile(r"(?=<body\b)", re.I).search(page, at)
                end = body.end() if body else None
            if end is not None:
                at = end
            elif tag in RAW and tag not in ("head", "svg", "math", "object"):
                at = n
            if tag in CONTROLS and parts:
                parts.append(" ")
            continue
        if tag in ("br", "hr", "wbr"):
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        if tag not in INLINE:
            flush()
            ends, holds = CLOSES.get(tag, set()), HOLDS.get(tag, set())
            for i in range(len(stack) - 1, 0, -1):
                if not open_["p"] and not any(open_[x] for x in ends):
                    break
                if stack[i][0] in ends:
                    close(i)
                    break
                if stack[i][0] == "p":
                    close(i)
                elif stack[i][0] in holds or stack[i][0] not in INLINE and not ends:
                    break
        features = stack[-1][1]
        own = () if tag in INLINE and tag not in ("a", "label") else ("in:" + tag,)
        if attributes:
            names = (v for a in ATTRIBUTE.finditer(attributes) for v in a.groups()[1:] if v)
            own += tuple("name:" + w.lower() for v in names for w in NAME_PART.findall(v))
        features += tuple(x for x in dict.fromkeys(own) if x not in features)
        if attributes.rstrip().endswith("/") and tag in ("a", "span"):
            continue
        stack.append((tag, features, stack[-1][2] or tag == "a"))
        open_[tag] += 1
        if tag not in INLINE:
            base = len(stack) - 1
    flush()
    return out


_PAGE = ("in:html", "in:body")


def features(found: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        link = b.linked / max(1, len(b.text))
        out.append(
            [
                "bias",
                f"tag:{b.tag}",
                f"words:{min(words, 127).bit_length()}",
                f"link:{0 if b.linked == 0 else 1 if link < 0.3 else 2 if link < 0.8 else 3}",
                f"stop:{b.text[-1] in '.!?…:;'}",
                f"sign:{b.text[0] in '©®™•|»'}",
                f"top:{next((c for c in b.context if c not in _PAGE), '')}",
                f"place:{0 if i == 0 else 2 if i == n - 1 else 1}",
                *b.context,
            ]
        )
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)  # for the label main; the other label scores 0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from label, to label

    def decode(self, rows: list[list[str]]) -> list[bool]:
        """Viterbi: the best label sequence."""
        if not rows:
            return []
        (s00, s01), (s10, s11) = self.step.tolist()
        get = self.weights.get
        back: list[tuple[int, int]] = []
        a, b = 0.0, 0.0
        for i, names in enumerate(rows):
            u = sum([get(x, 0.0) for x in names])
            if i == 0:
                a, b = 0.0, u
                continue
            from_a, from_b = int(b + s10 > a + s00), int(b + s11 > a + s01)
            back.append((from_a, from_b))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11) + u
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return [x == 1 for x in reversed(labels)]


def fit(pages: list[tuple[list[list[str]], list[bool]]], steps: int = 150, rate: float = 0.1, l2: float = 1e-3) -> Model:
    """Conditional maximum likelihood by forward-backward over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({x for rows, _ in pages for r in rows for x in r})
    at = {x: i for i, x in enumerate(names)}
    n, longest = len(pages), max(len(rows) for rows, _ in pages)
    page_of, step_of, column_of = [], [], []
    truth, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (rows, labels) in enumerate(pages):
        real[i, : len(rows)], truth[i, : len(rows)] = True, labels
        for t, r in enumerate(rows):
            page_of += [i] * len(r)
            step_of += [t] * len(r)
            column_of += [at[x] for x in r]
    cell, column_of = np.array(page_of) * longest + np.array(step_of), np.array(column_of)
    w, step = np.zeros(len(names)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(step), np.zeros_like(step)]
    pair = real[:, 1:]
    seen_step = np.zeros((2, 2))
    np.add.at(seen_step, (truth[:, :-1][pair], truth[:, 1:][pair]), 1)
    for k in range(1, steps + 1):
        u = np.zeros((n, longest, 2))
        u[:, :, 1] = np.bincount(cell, w[column_of], minlength=n * longest).reshape(n, longest)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = u[:, 0]
        for t in range(1, longest):
            new = np.logaddexp.reduce(forward[:, t - 1, :, None] + step, axis=1) + u[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(step + (u[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * real
        both = forward[:, :-1, :, None] + step + (u[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        expected = (np.exp(np.minimum(both, 0)) * pair[:, :, None, None]).sum(axis=(0, 1))
        slope = ((chance - truth * real).ravel())[cell]
        g_w = np.bincount(column_of, slope, minlength=len(names)) / n + l2 * w
        g_s = (expected - seen_step) / n + l2 * step
        for x, g, m, v in ((w, g_w, *moments[:2]), (step, g_s, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model({x: float(w[i]) for x, i in at.items()}, step)


# Names that authors give to parts of a page.
NAMES = {
    "menu": ("menu", "nav", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "main-menu", "toc", "pagination", "pager", "tabs"),
    "header": ("header", "masthead", "top-bar", "site-header", "page-header", "branding", "logo", "topbar", "tagline"),
    "footer": ("footer", "site-footer", "page-footer", "bottom", "copyright", "colophon", "legal", "credits", "imprint"),
    "sidebar": ("sidebar", "side", "aside", "secondary", "widget", "related", "recommended", "more-stories", "right-column", "rail", "teaser", "trending", "popular", "tags", "share", "social", "author-box", "bio"),
    "notice": ("notice", "cookie", "cookies", "cookie-banner", "consent", "gdpr", "alert", "banner", "message", "popup", "modal", "overlay", "toast", "warning", "disclaimer", "privacy", "paywall", "announcement"),
    "advert": ("ad", "ads", "advert", "adverts", "advertisement", "adsbygoogle", "ad-slot", "ad-container", "sponsor", "sponsored", "promo", "promotion", "promoted", "commercial", "outbrain", "taboola", "dfp"),
    "form": ("search", "search-form", "newsletter", "subscribe", "signup", "login", "contact-form", "subscription", "register", "feedback", "poll"),
    "comments": ("comments", "comment", "comment-list", "reader-comments", "discussion", "disqus", "responses", "replies", "respond", "user-comments", "comment-body", "thread", "reviews"),
    "content": ("content", "post", "entry", "article", "article-body", "entry-content", "post-content", "main", "main-content", "story", "story-body", "body", "text", "page-content", "blog-post", "primary"),
}
PART_TAGS = {
    "menu": ("nav", "div", "ul", "menu"),
    "header": ("header", "div"),
    "footer": ("footer", "div", "section"),
    "sidebar": ("aside", "div", "section"),
    "notice": ("div", "section", "p", "aside", "dialog"),
    "advert": ("div", "aside", "section", "ins", "p"),
    "form": ("form", "div"),
    "comments": ("div", "section", "ol", "ul"),
}


class _Writer:
    """Writes one labelled page."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.rng, self.main = rng, set()

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        return " ".join("".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4)))) for _ in range(n))

    def sentence(self, lo: int = 3, hi: int = 16) -> str:
        return self.words(lo, hi).capitalize() + self.pick((".", ".", ".", "!", "?"))

    def prose(self, main: bool, most: int = 5) -> str:
        text = " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most + 1))))
        if main:
            self.main.add(text)
        return text

    def inline(self, text: str) -> str:
        """The text with some inline markup."""
        words = text.split(" ")
        for _ in range(int(self.rng.integers(0, 3))):
            i = int(self.rng.integers(len(words)))
            tag = self.pick(("b", "i", "em", "strong", "a", "span"))
            words[i] = f'<a href="/{i}">{words[i]}</a>' if tag == "a" else f"<{tag}>{words[i]}</{tag}>"
        return " ".join(words)

    def part(self, kind: str, inner: str) -> str:
        tag, named = self.pick(PART_TAGS[kind]), self.rng.random() < 0.75
        if tag in ("div", "section", "p", "ul", "ol", "ins") or named:
            key = self.pick(("class", "class", "id"))
            name = self.pick(NAMES[kind])
            if self.rng.random() < 0.3:
                name += " " + self.pick(("clearfix", "row", "col-md-4", "box", "hidden", "wrapper", "block"))
            return f'<{tag} {key}="{name}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def links(self, lo: int = 2, hi: int = 8) -> str:
        items = [f'<a href="#">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(lo, hi + 1)))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return " ".join(items) if self.rng.random() < 0.5 else "".join(f"<div>{x}</div>" for x in items)

    def boilerplate(self, kind: str) -> str:
        prose = [self.prose(False, 3) for _ in range(int(self.rng.integers(1, 3)))]
        paragraphs = "".join(f"<p>{x}</p>" for x in prose)
        if kind == "menu":
            inner = self.links()
        elif kind == "header":
            inner = self.pick((self.words(1, 4), f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.sentence()}</p>", f"<div>{self.words(1, 3)}</div>{self.links()}"))
        elif kind == "footer":
            inner = self.pick((f"&copy; {self.words(1, 3)} &middot; {prose[0]}", paragraphs, f"<p>&copy; 2020 {self.words(1, 4)}</p>{self.links()}", prose[0]))
        elif kind == "sidebar":
            inner = f"<h3>{self.words(1, 3)}</h3>" * int(self.rng.integers(0, 2)) + self.pick((self.links(), paragraphs, prose[0]))
        elif kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input type='text'><button>{self.words(1, 2)}</button>" + f"<p>{prose[0]}</p>" * int(self.rng.integers(0, 2))
            inner = inner if self.rng.random() < 0.6 else f"<form action='/s'>{inner}</form>"
        elif kind == "comments":
            one = [f"<b>{self.words(1, 2)}</b><p>{self.prose(False)}</p>" for _ in range(int(self.rng.integers(1, 5)))]
            wrap = self.pick(('<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "<div>{}</div>"))
            inner = f"<h2>{self.words(1, 3)}</h2>" * int(self.rng.integers(0, 2)) + "".join(wrap.format(x) for x in one)
        else:
            inner = self.pick((prose[0], paragraphs, f"{prose[0]} <a href='#'>{self.words(1, 3)}</a>", f"<div>{prose[0]}</div>"))
        return self.part(kind, inner)

    def article(self) -> str:
        out = []
        if self.rng.random() < 0.85:
            title = self.words(2, 10) + self.pick(("", "", "."))
            self.main.add(title)
            out.append(f"<h1>{title}</h1>" if self.rng.random() < 0.8 else f"<header><h1>{title}</h1></header>")
        broken = self.rng.random() < 0.3
        for _ in range(int(self.rng.integers(1, 12))):
            roll = self.rng.random()
            if roll < 0.66:
                text = self.inline(self.prose(True, 7)) if self.rng.random() < 0.8 else self.short()
                out.append(f"<p><b>{text}<br>" if broken and self.rng.random() < 0.3 else f"<p>{text}</p>")
            elif roll < 0.74:
                title = self.words(1, 7)
                self.main.add(title)
                out.append(f"<h2>{title}</h2>" if self.rng.random() < 0.7 else f"<h3>{title}</h3>")
            elif roll < 0.82:
                tag = self.pick(("ul", "ol"))
                out.append(f"<{tag}>" + "".join(f"<li>{self.short()}</li>" for _ in range(int(self.rng.integers(2, 6)))) + f"</{tag}>")
            elif roll < 0.87:
                out.append(f"<blockquote>{self.prose(True)}</blockquote>")
            elif roll < 0.90:
                rows = ("<tr>" + "".join(f"<td>{self.short()}</td>" for _ in range(3)) + "</tr>" for _ in range(2))
                out.append("<table>" + "".join(rows) + "</table>")
            elif roll < 0.93:
                out.append(f"<pre>{self.short()}</pre>")
            else:
                out.append(self.boilerplate(self.pick(("advert", "sidebar", "notice", "form"))))
        return "".join(out)

    def short(self) -> str:
        text = self.words(1, 9) + self.pick(("", ".", ","))
        self.main.add(text)
        return text

    def page(self) -> str:
        body = self.article()
        roll = self.rng.random()
        if roll < 0.35:
            body = f"<article>{body}</article>"
        elif roll < 0.5:
            body = f"<main>{body}</main>"
        elif roll < 0.9:
            tag = self.pick(("div", "div", "section", "article", "td"))
            body = f'<{tag} {self.pick(("class", "id"))}="{self.pick(NAMES["content"])}">{body}</{tag}>'
            body = f"<table><tr>{body}</tr></table>" if tag == "td" else body
        if self.rng.random() < 0.25:
            body = f'<div class="{self.pick(("container", "wrapper", "page", "layout", "site"))}">{body}</div>'
        before = [k for k in ("header", "menu", "notice", "advert", "form") if self.rng.random() < 0.55]
        after = [k for k in ("advert", "sidebar", "comments", "form", "footer", "notice") if self.rng.random() < 0.5]
        if self.rng.random() < 0.2:
            before.append("sidebar")
        self.rng.shuffle(before)
        head = f"<head><title>{self.words(1, 6)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
        inner = "".join(self.boilerplate(k) for k in before) + body + "".join(self.boilerplate(k) for k in after)
        return f"<!DOCTYPE html><html>{head}<body>{inner}</body></html>"


    def plain_article(self) -> str:
        """A few blocks, often without a title, in elements without names."""
        roll, out = self.rng.random(), []
        if self.rng.random() < 0.25:
            title = self.words(1, 8)
            self.main.add(title)
            out.append(f"<h1>{title}</h1>")
        for _ in range(int(self.rng.integers(1, 5))):
            kind = self.rng.random()
            if kind < 0.12:
                out.append("<dl>" + "".join(f"<dt>{self.short()}</dt><dd>{self.short()}</dd>" for _ in range(int(self.rng.integers(1, 4)))) + "</dl>")
            elif kind < 0.2:
                out.append(f"<figure><img src='x'><figcaption>{self.short()}</figcaption></figure>")
            elif kind < 0.26:
                out.append("<ul>" + "".join(f"<li>{self.short()}</li>" for _ in range(int(self.rng.integers(1, 5)))) + "</ul>")
            else:
                tag = "p" if roll < 0.65 else "div"
                out.append(f"<{tag}>{self.inline(self.prose(True, 4)) if self.rng.random() < 0.8 else self.short()}</{tag}>")
        return "".join(out)

    def plain_page(self) -> str:
        body, roll = self.plain_article(), self.rng.random()
        if roll < 0.7:
            body = "<{0}>{1}</{0}>".format(self.pick(("article", "main", "div", "section", "article", "div")), body)
        before = [k for k in ("header", "menu") if self.rng.random() < 0.35]
        after = [k for k in ("sidebar", "footer") if self.rng.random() < 0.35]
        head = f"<head><title>{self.words(1, 6)}</title></head>" if self.rng.random() < 0.5 else ""
        inner = "".join(map(self.boilerplate, before)) + body + "".join(map(self.boilerplate, after))
        return f"<html>{head}<body>{inner}</body></html>" if self.rng.random() < 0.6 else head + inner


_SYLLABLES = tuple(a + b for a in ("b", "d", "g", "k", "l", "m", "n", "r", "s", "t", "v", "") for b in ("a", "e", "i", "o", "u"))[:-1]


def labelled_pages(n: int = 500, seed: int = 3, plain: int | None = None) -> list[tuple[str, list[bool]]]:
    """Pages with, per leaf block, whether it is main text; the same ones for the same arguments.

    Beside `n` pages with many parts come `plain` small ones, a fifth more than those if not given.
    """
    rng, out = np.random.default_rng(seed), []
    for i in range(n + (6 * n // 5 if plain is None else plain)):
        w = _Writer(rng)
        page = w.page() if i < n else w.plain_page()
        out.append((page, [b.text in w.main for b in blocks(page)]))
    return out


def train(pages: list[tuple[str, list[bool]]] | None = None) -> Model:
    """Fit on labelled pages; without any, on `labelled_pages()`."""
    pages = labelled_pages() if pages is None else pages
    return fit([(features(blocks(page)), labels) for page, labels in pages])


def main_text(page: str | None, model: Model) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, keep in zip(found, model.decode(features(found))) if keep)


def extract(pages: DataFrame, model: Model | None = None, source: str = "html") -> DataFrame:
    """`pages` without its html column, with `text` and `n_chars`."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    names = [c for c in pages.columns if c.lower() not in (source.lower(), "text", "n_chars")]
    rows = pages.select(*names, source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [main_text(x, shared.value) for x in part.column(part.num_columns - 1).to_pylist()]
                columns = [*part.columns[:-1], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [*names, "text", "n_chars"])

    own = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return rows.mapInArrow(run, T.StructType([*rows.select(*names).schema.fields, *own]))
