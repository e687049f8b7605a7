"""Main text of web pages: boosted trees over DOM nodes and a decoding from the root down.

Pages are parsed into a tree of elements (inline ones without a name of their own are
part of the text around them).  Gradient-boosted trees give every element two chances,
that of being the article where what is above it isn't, and that of being left out where
what is above it is article, from its tag, the words of its class, id and role, its depth
and place among its siblings, and what its subtree is made of.  Decoding then takes the
likeliest labelling in which every path from the root is outside, then article, then left
out: nothing that an article leaves out is article again.

No labelled pages exist, so the trees are fitted to page layouts made by a seeded
generator (:func:`layouts`): wording plays no part in the features, only lengths do.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_checked, releasing

# Kinds of elements by what they mean in a page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never page text: code, controls, embedded things.
HIDDEN = frozenset("script style noscript template svg iframe object canvas audio video select textarea button head title".split())
#: Elements that hold raw text up to their end tag.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Start tags that end an open element of a kind.
ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What such an element can't close beyond.
HOLDERS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
GROUPS = {
    name: i
    for i, names in enumerate(
        (
            "html body", "div", "section", "article", "main", "nav menu", "header", "footer", "aside", "form fieldset", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd",
            "table tbody thead tr td th", "blockquote pre figure figcaption", "a span b i em strong label time small font",
        )
    )
    for name in names.split()
}
OTHER = len(set(GROUPS.values()))
SPACES = re.compile(r"\s+")

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAMED = re.compile(r"(?i)\b(?:class|id|role|data-y)\s*=")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_LETTERS = re.compile(r"[a-z]+")


class Page:
    """Elements of a page, parents first, and its text in order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.names, self.mark, self.depth = [-1], ["html"], [()], [None], [0]
        # (block, element, text, in a link); a block ends where a block element begins or ends.
        self.texts: list[tuple[int, int, str, bool]] = []

    def add(self, parent: int, tag: str, attributes: dict) -> int:
        told = " ".join(attributes.get(k) or "" for k in ("class", "id", "role"))
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(tuple(_LETTERS.findall(_CAMEL.sub(r"\1 \2", told).lower())) if told.strip() else ())
        self.mark.append(attributes.get("data-y"))
        self.depth.append(self.depth[parent] + 1)
        return len(self.parent) - 1


def _attributes(told: str) -> dict:
    found = {}
    for name, *values in _ATTRIBUTE.findall(told):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def parse(source: str) -> Page:
    """The page of any text, in time linear in its length; what isn't well formed is read as browsers do, roughly."""
    page, at, block, link, end = Page(), 0, 0, 0, len(source)
    stack: list[tuple[str, int]] = [("html", 0)]
    opened: Counter = Counter()
    hidden, tags = 0, _TAG

    def close(upto: int) -> None:
        nonlocal hidden
        while len(stack) > upto:
            tag, _ = stack.pop()
            opened[tag] -= 1
            hidden -= tag in HIDDEN

    def say(text: str) -> None:
        if not hidden and text:
            page.texts.append((block, stack[-1][1], html.unescape(text), link > 0))

    while at < end:
        begin = source.find("<", at)
        if begin < 0:
            say(source[at:])
            break
        say(source[at:begin])
        following = source[begin + 1 : begin + 2]
        if following == "!" or following == "?":
            comment = source.startswith("<!--", begin)
            stop = source.find("-->" if comment else ">", begin + (4 if comment else 1))
            at = end if stop < 0 else stop + (3 if comment else 1)
            continue
        m = tags.match(source, begin) if following == "/" or following.isalpha() else None
        if m is None and following and tags is _TAG and (following == "/" or following.isalpha()):
            # A quote is never closed: from here on tags end at the first ">".
            tags = _PLAIN_TAG
            m = tags.match(source, begin)
        if m is None:
            # A lone "<"; without any ">" left, the rest is text.
            say("<")
            at = begin + 1
            if tags is _PLAIN_TAG and source.find(">", at) < 0:
                say(source[at:])
                break
            continue
        at = m.end()
        ending, tag, told = m[1], m[2].lower(), m[3]
        if ending:
            if tag == "a":
                link = 0
            if opened[tag] > 0:
                upto = len(stack) - 1
                while stack[upto][0] != tag:
                    upto -= 1
                close(upto)
            if tag not in INLINE:
                block += 1
                link = 0
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            block += 1
            link = 0
        elif tag == "a":
            link = 1
        if tag in VOID:
            continue
        if tag in ENDS_P and opened["p"] > 0:
            upto = len(stack) - 1
            while stack[upto][0] != "p":
                upto -= 1
            close(upto)
        if tag in SAME_LEVEL:
            for upto in range(len(stack) - 1, 0, -1):
                if stack[upto][0] in SAME_LEVEL[tag]:
                    close(upto)
                    break
                if stack[upto][0] in HOLDERS[tag] or len(stack) - upto > 64:
                    break
        if tag in RAW and not told.rstrip().endswith("/"):
            stop = re.compile(f"(?i)</{tag}[^>]*>").search(source, at)
            at = stop.end() if stop else end
            continue
        if tag in ("html", "body"):
            continue  # there is one of each, whatever is written
        attributes = _attributes(told) if told and _NAMED.search(told) else {}
        if told.rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in INLINE and not attributes:
            continue
        stack.append((tag, page.add(stack[-1][1], tag, attributes)))
        opened[tag] += 1
        hidden += tag in HIDDEN
    return page


MEASURES = (
    "depth", "place", "from_end", "siblings", "alike", "chars", "words", "links", "elements", "density", "stops", "paragraphs", "share", "begins", "per_block", "parent", "over_nav", "over_article", "named"
)


def measures(page: Page) -> list[list[float]]:
    """The numbers of every element, as :data:`MEASURES` names them."""
    n = len(page.parent)
    chars, words, linked, stops, blocks, first = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n
    said, last = 0, None
    for block, at, text, link in page.texts:
        k = len(text.split())
        if not k:
            continue
        if first[at] < 0:
            first[at] = said
        size = len(text)
        said += size
        chars[at] += size
        words[at] += k
        linked[at] += size * link
        stops[at] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
        blocks[at] += block != last
        last = block
    elements, paragraphs, children, tags_of = [1] * n, [0] * n, [0] * n, {}
    place = [0] * n
    for at in range(1, n):
        up = page.parent[at]
        place[at] = children[up]
        children[up] += 1
        tags_of[up, page.tag[at]] = tags_of.get((up, page.tag[at]), 0) + 1
    for at in range(n - 1, 0, -1):
        up = page.parent[at]
        paragraphs[at] += page.tag[at] == "p"
        for counts in (chars, words, linked, stops, blocks, elements, paragraphs):
            counts[up] += counts[at]
        if first[at] >= 0 and (first[up] < 0 or first[at] < first[up]):
            first[up] = first[at]
    rows, over_nav, over_article = [], [0] * n, [0] * n
    for at in range(n):
        up = page.parent[at]
        if at:
            over_nav[at] = over_nav[up] or page.tag[up] in ("nav", "footer", "aside", "form", "menu")
            over_article[at] = over_article[up] or page.tag[up] in ("article", "main")
        size, beside = chars[at], children[up] if at else 1
        rows.append([
            page.depth[at], place[at], beside - 1 - place[at], beside, tags_of.get((up, page.tag[at]), 1) / beside, math.log1p(size), math.log1p(words[at]),
            linked[at] / size if size else 0.0, math.log1p(elements[at]), math.log1p(size / elements[at]), 100 * stops[at] / size if size else 0.0, math.log1p(paragraphs[at]),
            size / said if said else 0.0, first[at] / said if said and first[at] >= 0 else 1.0, math.log1p(size / max(1, blocks[at])),
            GROUPS.get(page.tag[up], OTHER) if at else -1, over_nav[at], over_article[at], len(page.names[at]) > 0,
        ])
    return rows


def features(pages: list[Page], words: dict[str, int]) -> np.ndarray:
    """A row per element of all pages: its measures, its kind of tag, and the words of its names."""
    numbers = np.array([r for p in pages for r in measures(p)], np.float32).reshape(-1, len(MEASURES))
    marks = np.zeros((len(numbers), OTHER + 1 + len(words)), np.float32)
    at = 0
    for p in pages:
        for tag, names in zip(p.tag, p.names):
            marks[at, GROUPS.get(tag, OTHER)] = 1
            for name in names:
                if name in words:
                    marks[at, OTHER + 1 + words[name]] = 1
            at += 1
    return np.concatenate([numbers, marks], axis=1)


class Trees:
    """Gradient-boosted trees for a yes-or-no label: logistic loss, splits at quantiles.

    Of the columns the first ``n_numbers`` are numbers, the others are 0 or 1.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, n_numbers: int, rounds: int = 50, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 4.0):
        self.depth, self.rate = depth, rate
        self.base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(n_numbers)]
        binned = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(n_numbers)], axis=1)
        marks = x[:, n_numbers:]
        score, rows = np.full(len(y), self.base), np.arange(len(y))
        self.feature, self.cut, self.value = [], [], []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
            for level in range(depth):
                first, width = 2**level - 1, 2**level
                place = node - first
                total_g, total_h = np.bincount(place, gradient, width), np.bincount(place, weight, width)
                best, choice, border = np.full(width, 1e-3), np.full(width, -1), np.full(width, 0.5)

                def consider(f: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray) -> None:
                    """Splits whose lower side sums to g and h: a row a node, a column a split of feature f at ``at``."""
                    rest_g, rest_h = total_g[:, None] - g, total_h[:, None] - h
                    gain = g * g / (h + 1) + rest_g * rest_g / (rest_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                    gain[(h < least) | (rest_h < least)] = 0.0
                    k = gain.argmax(axis=1)
                    found = gain[np.arange(width), k]
                    better = found > best
                    best[better], choice[better], border[better] = found[better], f[k[better]], at[k[better]]

                for f in range(n_numbers):
                    if len(cuts[f]):
                        key, n_bins = place * (len(cuts[f]) + 1) + binned[:, f], len(cuts[f]) + 1
                        g, h = (np.bincount(key, v, width * n_bins).reshape(width, n_bins).cumsum(axis=1)[:, :-1] for v in (gradient, weight))
                        consider(np.full(n_bins - 1, f), g, h, cuts[f])
                sides = np.zeros((2 * width, len(y)), np.float32)
                sides[place, rows], sides[width + place, rows] = gradient, weight
                with_mark = (sides @ marks).astype(float)
                n_marks = marks.shape[1]
                consider(n_numbers + np.arange(n_marks), total_g[:, None] - with_mark[:width], total_h[:, None] - with_mark[width:], np.full(n_marks, 0.5))
                split = choice >= 0
                feature[first : first + width][split], cut[first : first + width][split] = choice[split], border[split]
                goes = split[place] & (x[rows, np.maximum(choice[place], 0)] > border[place])
                node = 2 * node + 1 + goes
            leaf = node - (2**depth - 1)
            value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + 1)
            score += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return score


def decode(page: Page, enters: list[float], leaves: list[float]) -> list[bool]:
    """Which elements are article: the likeliest labels that go outside, article, left out on every path down.

    ``enters`` and ``leaves`` are log odds, of turning to article below what is outside and
    of being left out below what is article.
    """
    n = len(page.parent)
    no = lambda odds: -math.log1p(math.exp(min(odds, 30.0))) if odds < 30 else -odds  # noqa: E731 (log chance against)
    outside, article = [0.0] * n, [0.0] * n
    # Log chances of the likeliest labels of what is below an outside and below an article element.
    for at in range(n - 1, 0, -1):
        up = page.parent[at]
        outside[up] += max(no(enters[at]) + outside[at], no(-enters[at]) + article[at])
        article[up] += max(no(leaves[at]) + article[at], no(-leaves[at]))
    state = [0] * n
    for at in range(1, n):
        above = state[page.parent[at]]
        if above == 0:
            state[at] = int(no(-enters[at]) + article[at] > no(enters[at]) + outside[at])
        elif above == 1:
            state[at] = 1 if no(leaves[at]) + article[at] >= no(-leaves[at]) else 2
        else:
            state[at] = 2
    return [s == 1 for s in state]


def text_of(page: Page, article: list[bool]) -> str:
    """The article's blocks in page order, one a line, their white space single."""
    out, parts, last = [], [], None
    for block, at, text, _ in page.texts:
        if article[at]:
            if block != last and parts:
                out.append("".join(parts))
                parts = []
            last = block
            parts.append(text)
    out.append("".join(parts))
    return "\n".join(b for b in (SPACES.sub(" ", x).strip() for x in out) if b)


# Names that sites give to the parts of their pages, by what the parts are.
NAMES = {
    "article": "article post entry content story main body text blog news single detail".split(),
    "wrap": "wrapper container page site layout row col outer inner grid wrap columns".split(),
    "inside": "content body text section inner lead intro summary caption wrapper paragraph".split(),
    "nav": "nav menu navbar navigation topnav links breadcrumb breadcrumbs pagination pager toc tabs".split(),
    "header": "header masthead top site brand logo branding topbar".split(),
    "footer": "footer bottom copyright legal colophon foot".split(),
    "sidebar": "sidebar aside side rail widget secondary widgets".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo banner dfp adsbygoogle promotion".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay cookies message".split(),
    "comments": "comments comment disqus replies reply discussion respond commentlist".split(),
    "more": "share social sharing related recommended more tags meta author byline".split(),
    "form": "form search login signup subscribe newsletter contact".split(),
}
TAGS = {
    "nav": "nav nav nav ul div", "header": "header header header div", "footer": "footer footer footer div", "sidebar": "aside aside div section", "ad": "div div aside section ins",
    "notice": "div div section aside", "comments": "section div div ol", "more": "div div ul section aside", "form": "form form div",
}


class _Layout:
    """One made-up page; ``data-y`` tells what an element is (1 article, 0 not), for what is below as well."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        self.bare = rng.random() < 0.1  # a page whose elements have no names and few meanings

    def words(self, least: int, most: int) -> str:
        rng = self.rng
        out = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(least, most))]
        return " ".join(w + rng.choice([",", ".", ".", "!"]) if rng.random() < 0.1 else w for w in out).capitalize()

    def sentence(self, least: int, most: int) -> str:
        return self.words(least, most) + "."

    def open(self, kind: str, tag: str, y: int | None) -> str:
        rng, told = self.rng, ""
        if not self.bare and kind in NAMES and rng.random() < (0.85 if tag in ("div", "section", "ul", "ol", "ins") else 0.35):
            names = rng.sample(NAMES[kind], rng.choice([1, 1, 2]))
            other = [rng.choice(["x", "js", "clearfix", "css", "block", "m", "module", "box"])] if rng.random() < 0.3 else []
            names = rng.choice([["-".join(names + other)], names + other, ["_".join(names)]])
            told = f' {rng.choice(["class", "class", "id"])}="{" ".join(names)}"'
        return f"<{tag}{told}" + (f' data-y="{y}"' if y is not None else "") + ">"

    def element(self, kind: str, tag: str, inner: str, y: int | None = None) -> str:
        return self.open(kind, tag, y) + inner + f"</{tag}>"

    def links(self, n: int) -> str:
        one = lambda: f'<a href="/{self.rng.randint(0, 99)}">{self.words(1, 3)}</a>'
        return "".join(f"<li>{one()}</li>" for _ in range(n)) if self.rng.random() < 0.7 else " | ".join(one() for _ in range(n))

    def paragraph(self) -> str:
        rng = self.rng
        inner = self.sentence(*rng.choice([(1, 4), (4, 20), (20, 80), (60, 150)]))
        if rng.random() < 0.15:
            inner += f' <a href="/x">{self.words(1, 4)}</a> {self.sentence(2, 9)}'
        if rng.random() < 0.1:
            inner = f'<span class="{rng.choice(["dropcap", "highlight", "x", "lead"])}">{self.words(1, 2)}</span> ' + inner
        if rng.random() < 0.1:
            inner = "<b>" + inner + "<br>"
            return "<p>" + inner
        return f"<p>{inner}</p>"

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        tag = rng.choice(TAGS[kind].split())
        if self.bare and tag not in ("nav", "ul", "form"):
            tag = rng.choice(["div", "td", "section"])
        if kind in ("nav", "more"):
            inner = self.links(rng.randint(2, 12))
            if tag == "nav" and rng.random() < 0.7:
                inner = f"<ul>{inner}</ul>"
        elif kind == "header":
            inner = (f"<h1>{self.words(1, 3)}</h1>" if rng.random() < 0.4 else f'<a href="/">{self.words(1, 3)}</a>') + (self.boilerplate("nav") if rng.random() < 0.5 else "")
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "", "<p>"]) + self.sentence(2, 30) + (self.links(4) if rng.random() < 0.5 else "")
        elif kind == "sidebar":
            inner = "".join(rng.choice([f"<h3>{self.words(1, 4)}</h3>", f"<ul>{self.links(5)}</ul>", self.boilerplate("ad"), f"<p>{self.sentence(5, 30)}</p>"]) for _ in range(rng.randint(1, 5)))
        elif kind == "comments":
            inner = f"<h3>{self.words(1, 3)}</h3>" if rng.random() < 0.6 else ""
            one = "li" if tag == "ol" else "div"
            for _ in range(rng.randint(1, 8)):
                inner += self.element("comments", one, (f"<b>{self.words(1, 2)}</b>" if rng.random() < 0.5 else "") + "".join(f"<p>{self.sentence(3, 60)}</p>" for _ in range(rng.choice([1, 1, 2]))))
        elif kind == "form":
            inner = f"<label>{self.words(1, 5)}</label><input name=q>" + (f"<p>{self.sentence(4, 20)}</p>" if rng.random() < 0.4 else "") + "<button>Go</button>"
        else:
            inner = rng.choice(["", "<p>"]) + self.sentence(3, 40) + (f'<a href="/y">{self.words(1, 3)}</a>' if rng.random() < 0.4 else "")
        return self.element(kind, tag, inner, 0)

    def article(self) -> str:
        rng, parts = self.rng, []
        title = f"<h1>{self.words(2, 12)}</h1>"
        if rng.random() < 0.15:
            title = f"<header>{title}</header>"
        for _ in range(rng.choice([1, 1, 2, 2, 4, 8, 16])):
            parts.append(self.paragraph())
            extra = rng.random()
            if extra < 0.10:
                parts.append(f"<h2>{self.words(1, 7)}</h2>")
            elif extra < 0.16:
                parts.append("<ul>" + "".join(f"<li>{self.words(2, 15)}</li>" for _ in range(rng.randint(2, 7))) + "</ul>")
            elif extra < 0.20:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif extra < 0.23:
                parts.append(f"<pre>{self.words(5, 40)}</pre>")
            elif extra < 0.26:
                parts.append(f"<figure><img src=x><figcaption>{self.words(3, 15)}</figcaption></figure>")
            elif extra < 0.29:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(rng.randint(2, 6))) + "</table>")
            elif extra < 0.33:
                parts.append(self.element("inside", rng.choice(["div", "section"]), "".join(self.paragraph() for _ in range(rng.randint(1, 3)))))
            elif extra < 0.40:
                parts.append(self.boilerplate(rng.choice(["ad", "more", "form", "notice", "sidebar"])))
        if rng.random() < 0.85:
            parts.insert(0, title)
        if rng.random() < 0.5:
            parts.append(self.boilerplate(rng.choice(["more", "comments", "comments", "comments", "nav", "footer", "form"])))
        if rng.random() < 0.12:  # the article has no element of its own
            return "".join(p if " data-y=" in p.split(">")[0] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', p) for p in parts)
        return self.element("article", "div" if self.bare else rng.choice(["article", "article", "article", "div", "div", "main", "section"]), "".join(parts), 1)

    def page(self) -> str:
        rng = self.rng
        share = rng.choice([0.0, 0.2, 0.5, 0.5, 0.8])
        few = lambda *kinds: [self.boilerplate(k) for k in kinds if rng.random() < share]
        middle = few("nav", "ad", "notice")
        rng.shuffle(middle)
        middle += [self.article()] if rng.random() < 0.94 else [f"<ul>{self.links(9)}</ul>", f"<h2>{self.words(2, 5)}</h2>", f"<ul>{self.links(9)}</ul>"]
        middle += few("more", "comments", "sidebar", "form")
        if rng.random() < 0.6:
            middle = [self.element("wrap", rng.choice(["div", "div", "main", "section", "form"] if rng.random() < 0.1 else ["div", "div", "main"]), "".join(middle))]
        body = few("notice", "header", "nav", "ad") + middle + few("sidebar", "footer", "footer")
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><script>x</script></head><body>{''.join(body)}</body></html>"


def layouts(n: int, seed: int) -> list[str]:
    return [_Layout(random.Random(f"{seed}-{i}")).page() for i in range(n)]


def marked(page: Page) -> list[bool]:
    """What :class:`_Layout` says of each element."""
    found = [False]
    for at in range(1, len(page.parent)):
        found.append(page.mark[at] == "1" if page.mark[at] is not None else found[page.parent[at]])
    return found


def below_left_out(page: Page) -> list[bool]:
    """Elements below what an article leaves out, by :func:`marked`."""
    article, below = marked(page), [False] * len(page.parent)
    for at in range(1, len(below)):
        up = page.parent[at]
        below[at] = below[up] or (up > 0 and not article[up] and article[page.parent[up]])
    return below


#: Made-up pages that the trees are fitted to, and the most words of names that they know.
LAYOUTS, NAME_WORDS = 1_200, 120


class Model:
    """The trees and the words that they know."""

    def __init__(self, seed: int = 1, n: int = LAYOUTS):
        pages = [parse(s) for s in layouts(n, seed)]
        seen = Counter(w for p in pages for names in p.names for w in set(names))
        self.words = {w: i for i, (w, k) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:NAME_WORDS]) if k >= 5}
        x = features(pages, self.words)
        article = np.array([y for p in pages for y in marked(p)])
        above = np.array([p.parent[at] >= 0 and y[p.parent[at]] for p in pages for y in [marked(p)] for at in range(len(y))])
        left = np.array([b for p in pages for b in below_left_out(p)])
        outside = ~above & ~left
        self.enters = Trees(x[outside], article[outside].astype(float), len(MEASURES))
        self.leaves = Trees(x[above], (~article[above]).astype(float), len(MEASURES))

    def texts(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        if not pages:
            return []
        x = features(pages, self.words)
        enters, leaves = self.enters.log_odds(x).tolist(), self.leaves.log_odds(x).tolist()
        out, at = [], 0
        for p in pages:
            end = at + len(p.parent)
            out.append(text_of(p, decode(p, enters[at:end], leaves[at:end])))
            at = end
        return out


@functools.lru_cache(maxsize=1)
def fitted() -> Model:
    return Model()


#: Pages go through the trees together until they have so many characters.
CHUNK_CHARS = 400_000


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    Null or empty html, and pages without an article, give an empty text.  Repeated rows
    give the same, null ids and addresses stay null, pages of any length are read whole,
    other columns aren't read, and an empty table gives no rows.  ``<br>`` is white space.
    """
    model = fitted()
    size = sum(a.nbytes for t in (model.enters, model.leaves) for a in [*t.feature, *t.cut, *t.value]) + 100 * len(model.words)
    shared = broadcast_checked(pages.sparkSession, model, size, "the trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            ends = np.flatnonzero(np.diff(sizes // CHUNK_CHARS, append=sizes[-1:] // CHUNK_CHARS + 1)) + 1
            for begin, end in zip([0, *ends], ends):
                part = b.slice(begin, end - begin)
                texts = shared.value.texts([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = rows.mapInArrow(releasing(run), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
