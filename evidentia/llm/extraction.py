"""Main text of web pages: boosted trees over the nodes of the page's tree, decoded from the root down."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by how they shape text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style title textarea template svg math select button iframe noscript object canvas audio video datalist".split())
LIST_ITEMS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
TAG_GROUPS = ("html body", "article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tfoot tr td th", "blockquote pre", "figure figcaption")
#: Words of class, id, role and itemprop, and elements, that name what a part of a page is for.
FAMILIES = (
    ("content", "article articlebody post entry story content main maincontent text prose", ""),
    ("menu", "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc skip", "nav menu"),
    ("header", "header masthead topbar logo brand hero", "header"),
    ("footer", "footer colophon copyright legal bottom contentinfo", "footer"),
    ("side", "sidebar side aside related recommended recommendations widget popular trending more complementary", "aside"),
    ("advert", "ad ads adv advert advertisement adsense adslot dfp sponsor sponsored promo promotion banner", ""),
    ("notice", "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription alert paywall signup disclaimer", "dialog"),
    ("comments", "comment comments commentlist disqus reply replies respond discussion thread", ""),
    ("share", "share sharing social follow tags meta byline author", ""),
    ("form", "form search login contact", "form fieldset"),
    ("hidden", "hidden", ""),
    ("landmark", "", "article main"),
)
BIT = {name: 1 << i for i, (name, *_) in enumerate(FAMILIES)}
BY_WORD = {w: BIT[name] for name, words, _ in FAMILIES for w in words.split()}
BY_TAG: dict[str, int] = {t: BIT[name] for name, _, tags in FAMILIES for t in tags.split()}
GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
OTHER_GROUP = len(TAG_GROUPS)
#: What is no part of an article, wherever it stands.
FOREIGN = sum(BIT[b] for b in ("menu", "footer", "side", "advert", "notice", "comments", "form", "hidden"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")
CUT_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
PUNCTUATION = re.compile(r"[.,;:!?]")
#: Marks article text of pages made for training; it is taken off when they are read.
MARK = "\ue000"


def families(attributes: str) -> int:
    out = 0
    for name, value in NAMED.findall(attributes):
        name = name.lower()
        if name in ("hidden", "style", "aria-hidden"):
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I) or "true" in value.lower():
                out |= BIT["hidden"]
            continue
        for w in NAME_WORDS.findall(value):
            out |= BY_WORD.get(w.lower(), 0)
        if name == "role" and value.strip("\"'").lower() in ("main", "article"):
            out |= BIT["landmark"]
    return out


@dataclass
class Page:
    """Block elements in page order (parents first), and the text that stands directly in them, run by run."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    own: list[int] = field(default_factory=lambda: [0])
    runs: list[tuple[int, str, int]] = field(default_factory=list)


def read(html: str, seen: dict[str, int]) -> Page:
    """The tree of a page, however broken its markup; ``seen`` remembers what attributes name.

    Inline elements are part of the block that they stand in. Character references are decoded, white space is one
    space, empty runs are left out; scripts, styles, controls and the title are not read.
    """
    page, stack, open_, links = Page(), [0], {"html": 1}, [False]
    pieces: list[str] = []
    linked, in_link, pos, end = 0, False, 0, len(html)
    unended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.runs.append((stack[-1], text, linked))
            pieces.clear()
        linked = 0

    def close() -> None:
        nonlocal in_link
        flush()
        open_[page.tag[stack.pop()]] -= 1
        in_link = links.pop()

    while pos < end:
        m = TOKEN.search(html, pos)
        text = html[pos : m.start()] if m else html[pos:]
        if not m and (cut := CUT_OFF.search(text)):
            text = text[: cut.start()]
        if text:
            pieces.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and len(stack) > 1 and open_.get(tag) and tag not in ("html", "body"):
                while page.tag[stack[-1]] != tag:
                    close()
                close()
            continue
        if tag in UNREAD:
            if tag not in unended:
                after = re.compile(f"</{tag}\\b[^>]*>", re.I).search(html, pos)
                if after:
                    pos = after.end()
                else:
                    unended.add(tag)
                    if tag in ("script", "style", "title", "textarea"):
                        pos = end
            pieces.append(" ")
        elif tag == "a":
            in_link = True
        elif tag == "br":
            pieces.append(" ")
        elif tag == "hr":
            if page.tag[stack[-1]] == "p":
                close()
            flush()
        elif tag not in INLINE and tag not in VOID and tag not in ("html", "body", "head"):
            if page.tag[stack[-1]] == "p":
                close()
            elif tag in CLOSED_BY:
                depth = len(stack) - 1
                while depth > 0 and page.tag[stack[depth]] not in LIST_ITEMS[tag] and page.tag[stack[depth]] not in CLOSED_BY[tag]:
                    depth -= 1
                if depth > 0 and page.tag[stack[depth]] in CLOSED_BY[tag]:
                    while len(stack) > depth:
                        close()
            flush()
            given = m[3] or m[6] or ""
            names = 0
            if given.strip(" /"):
                if (names := seen.get(given, -1)) < 0:
                    if len(seen) > 50_000:
                        seen.clear()
                    names = seen[given] = families(given)
            page.parent.append(stack[-1])
            page.tag.append(tag)
            page.own.append(names | BY_TAG.get(tag, 0))
            stack.append(len(page.tag) - 1)
            open_[tag] = open_.get(tag, 0) + 1
            links.append(in_link)
    flush()
    return page


NUMBERS = 17


def described(page: Page) -> tuple[np.ndarray, list[int]]:
    """Counts of each node that has text in its subtree, a row each, and which nodes these are."""
    n = len(page.tag)
    chars, own_chars, linked, words, points, runs, nodes = ([0] * n for _ in range(7))
    before, at = [0] * n, 0
    first_seen = [False] * n
    for node, text, link in page.runs:
        k = node
        while k >= 0 and not first_seen[k]:
            first_seen[k], before[k] = True, at
            k = page.parent[k]
        size = len(text)
        chars[node] += size
        own_chars[node] += size
        linked[node] += min(link, size)
        words[node] += text.count(" ") + 1
        points[node] += len(PUNCTUATION.findall(text))
        runs[node] += 1
        at += size
    inside = page.own[:]
    depth = [0] * n
    for i in range(1, n):
        p = page.parent[i]
        inside[i] |= inside[p]
        depth[i] = depth[p] + 1
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        words[p] += words[i]
        points[p] += points[i]
        runs[p] += runs[i]
        nodes[p] += nodes[i] + 1
    live = [i for i in range(n) if chars[i]]
    count, last, same, place = [0] * n, [0] * n, {}, [0] * n
    previous, following = [0] * n, [0] * n
    for i in live[1:]:
        p = page.parent[i]
        place[i] = count[p]
        count[p] += 1
        if last[p]:
            previous[i], following[last[p]] = chars[last[p]], chars[i]
        last[p] = i
        key = (p, page.tag[i])
        same[key] = same.get(key, 0) + 1
    rows = [
        (GROUP.get(page.tag[i], OTHER_GROUP), page.own[i], inside[(p := max(0, page.parent[i]))], depth[i], chars[i], own_chars[i], linked[i], words[i], points[i], runs[i], nodes[i], place[i], count[p], previous[i], following[i], before[i], same.get((p, page.tag[i]), 1), chars[p], linked[p], words[p], runs[p], at)
        for i in live
    ]
    return np.array(rows, dtype=np.float64).reshape(-1, 22), live


def features(counts: np.ndarray) -> np.ndarray:
    """Densities, attribute words, depth and sibling statistics of nodes."""
    group, own, above = (counts[:, i].astype(np.int64) for i in range(3))
    depth, chars, own_chars, linked, words, points, runs, nodes, place, siblings, previous, following, before, same, p_chars, p_linked, p_words, p_runs, total = counts[:, 3:].T
    at_least = lambda x: np.maximum(x, 1)
    numbers = [
        np.minimum(depth, 30), np.log1p(chars), np.log1p(own_chars), linked / at_least(chars), points / at_least(words), np.log1p(chars / (nodes + 1)), words / at_least(runs),
        chars / at_least(total), chars / at_least(p_chars), (place + 1) / at_least(siblings), np.minimum(siblings, 50), np.log1p(previous), np.log1p(following), before / at_least(total), np.minimum(same, 50),
        p_linked / at_least(p_chars), p_words / at_least(p_runs),
    ]
    bits = 1 << np.arange(len(FAMILIES))
    return np.concatenate([np.stack(numbers, axis=1), group[:, None] == np.arange(OTHER_GROUP + 1), (own[:, None] & bits) > 0, (above[:, None] & bits) > 0], axis=1).astype(np.float32)


@dataclass
class Boosted:
    """Gradient-boosted trees of one depth for a yes-or-no question, fitted on binned features by the logistic loss."""

    depth: int = 4
    trees: int = 40
    rate: float = 0.3
    ridge: float = 1.0
    bins: int = 32

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(f)]
        edges = [np.unique(np.append(e, x[:, j].min())) for j, e in enumerate(edges)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        width, inner = self.bins + 1, 2**self.depth - 1
        base = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(base / (1 - base)))
        self.feature, self.cut = np.zeros((self.trees, inner), np.int64), np.full((self.trees, inner), np.inf, np.float32)
        self.leaf = np.zeros((self.trees, inner + 1))
        score = np.full(n, self.base)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h, at = p - y, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
            for level in range(self.depth):
                size, first = 2**level, 2**level - 1
                place = at - first
                sums = np.stack([[np.bincount(place * width + codes[j], w, size * width).reshape(size, width) for w in (g, h)] for j in range(f)])
                left = sums.cumsum(axis=3)
                total = left[:, :, :, -1:]
                right = total - left
                value = lambda s: s[:, 0] ** 2 / (s[:, 1] + self.ridge)
                gain = value(left) + value(right) - value(total)
                gain[(left[:, 1] < 1e-3) | (right[:, 1] < 1e-3)] = 0
                best = gain.transpose(1, 0, 2).reshape(size, -1)
                pick = best.argmax(axis=1)
                for k in range(size):
                    j, b = divmod(int(pick[k]), width)
                    if best[k, pick[k]] > 1e-6 and b < len(edges[j]):
                        self.feature[t, first + k], self.cut[t, first + k] = j, edges[j][b]
                at = self._down(x, t, at)
            place = at - inner
            self.leaf[t] = -self.rate * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + self.ridge)
            score += self.leaf[t][place]
        return self

    def _down(self, x: np.ndarray, t: int, at: np.ndarray) -> np.ndarray:
        return 2 * at + 1 + (x[np.arange(len(x)), self.feature[t][at]] > self.cut[t][at])

    def chances(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for t in range(self.trees):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = self._down(x, t, at)
            score += self.leaf[t][at - (2**self.depth - 1)]
        return np.clip(1 / (1 + np.exp(-score)), 1e-6, 1 - 1e-6)


@dataclass
class Model:
    """``holds``: a node's subtree has article text; ``within``: most of its text is; ``leave``: log odds against a part that is no article inside one."""

    holds: Boosted
    within: Boosted
    leave: float = 2.0

    def kept(self, pages: list[Page]) -> list[set[int]]:
        """Nodes of each page whose own text is article text.

        Every node is above the article, in it or apart from it. All below a node that is apart is apart, and nothing
        below a node in the article is above it; of the labellings that obey this the likeliest is taken.
        """
        described_ = [described(p) for p in pages]
        if not any(len(c) for c, _ in described_):
            return [set() for _ in pages]
        x = features(np.concatenate([c for c, _ in described_]))
        holds, within = self.holds.chances(x), self.within.chances(x)
        leaf = np.concatenate([c[:, 10] == 0 for c, _ in described_ if len(c)])
        holds, within = np.where(leaf, (holds + within) / 2, np.maximum(holds, within)), np.where(leaf, (holds + within) / 2, within)
        apart, above, inside = (np.log(np.maximum(x, 1e-6)).tolist() for x in (1 - holds, np.where(leaf, 0, holds - within), within))
        out, start = [], 0
        for page, (_, live) in zip(pages, described_, strict=True):
            k, at = len(live), {node: i for i, node in enumerate(live)}
            up = [at.get(page.parent[node], -1) for node in live]
            a, o, n = apart[start : start + k], above[start : start + k], inside[start : start + k]
            start += k
            for i in range(k - 1, 0, -1):
                p = up[i]
                a[p] += a[i]
                n[p] += max(n[i], a[i] - self.leave)
                o[p] += max(o[i], n[i], a[i])
            state, keep = [0] * k, set()
            for i in range(k):
                may = 2 if i == 0 else state[up[i]]
                best = max((a[i] - self.leave * (i > 0 and may == 1), 0), (n[i], 1) if may else (-np.inf, 0), (o[i], 2) if may == 2 else (-np.inf, 0))
                state[i] = best[1]
                if best[1] == 1:
                    keep.add(live[i])
            out.append(keep)
        return out


def labelled(page: Page) -> list[bool] | None:
    """Of a page with an article or main element: which runs are article text. None if it has none, or nothing in it."""
    state = [0] * len(page.tag)
    for i in range(1, len(page.tag)):
        s = state[page.parent[i]] or int(bool(page.own[i] & BIT["landmark"]))
        state[i] = 2 if s == 2 or s == 1 and page.own[i] & FOREIGN and not page.own[i] & BIT["landmark"] else s
    out = [state[node] == 1 for node, *_ in page.runs]
    return out if any(out) else None


class Made:
    """Pages made for training: articles among the parts that pages have around them, in many forms, from the words of given pages."""

    def __init__(self, words: list[str], seed: int) -> None:
        self.r, self.words = random.Random(seed), words

    def say(self, low: int, high: int) -> str:
        k = self.r.randint(low, high)
        s = self.r.choices(self.words, k=k)
        for i in range(self.r.randint(6, 14), k, self.r.randint(6, 14)):
            s[i - 1] += self.r.choice(".,.;")
        return " ".join(s).capitalize() + self.r.choice([".", ".", ".", "", "!"])

    def links(self, n: int) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.say(1, 4)}</a>' for i in range(n)]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items)])

    def part(self, tags: str, names: str, body: str) -> str:
        """A named part; now and then its name says nothing, so that what it holds has to tell."""
        r = self.r
        tag, name = r.choice(tags.split()), r.choice(names.split())
        if tag not in ("div", "section", "ins"):
            name = r.choice([name, ""])
        elif r.random() < 0.12:
            name = r.choice(["", "box", "c" + str(r.randint(1, 99))])
        how = r.choice(["class", "class", "id"])
        given = f' {how}="{r.choice(["", "site-", "page_", "x-"])}{name}{r.choice(["", "", " clearfix", "-1"])}"' if name else ""
        return f"<{tag}{given}>{body}</{tag}>"

    def around(self) -> tuple[list[str], list[str]]:
        r = self.r
        some = lambda *made: [m() for m in made if r.random() < 0.5]
        top = some(
            lambda: self.part("header div header", "header masthead topbar", r.choice(["", f"<h1>{self.say(1, 3)}</h1>"]) + f"<p>{self.say(2, 9)}</p>"),
            lambda: self.part("nav div ul", "nav menu navbar breadcrumbs", self.links(r.randint(2, 12))),
            lambda: self.part("div section dialog", "cookie-notice consent alert notice", f"<p>{self.say(6, 40)}</p>" + r.choice(["", f"<a href=#>{self.say(1, 2)}</a>"])),
            lambda: self.part("div aside ins", "ad advert banner promo sponsored", r.choice([self.say(3, 30), f"<p>{self.say(3, 40)}</p>"])),
        )
        bottom = some(
            lambda: self.part("aside div section", "sidebar related widget recommended", f"<h3>{self.say(1, 4)}</h3>" + r.choice([self.links(r.randint(2, 8)), f"<p>{self.say(8, 60)}</p>", f"<p>{self.say(8, 50)}</p><p>{self.say(8, 50)}</p>"])),
            lambda: self.part("div section", "comments comment-list disqus discussion", f"<h3>{self.say(1, 3)}</h3>" + "".join(f'<{t} class="{r.choice(["comment", "reply", "comment-body"])}"><p>{self.say(3, 60)}</p></{t}>' for t in r.choices(["div", "li", "article"], k=r.randint(1, 6)))),
            lambda: self.part("form form div", "newsletter subscribe search signup", f"<label>{self.say(1, 6)}</label><input name=q><p>{self.say(3, 20)}</p>"),
            lambda: self.part("div ul", "share social tags", self.links(r.randint(2, 5))),
            lambda: self.part("div aside ins", "ad advert banner promo", r.choice([self.say(3, 30), f"<p>{self.say(3, 40)}</p>"])),
            lambda: self.part("footer div footer", "footer site-footer copyright", r.choice([f"&copy; {self.say(2, 25)}", f"<p>{self.say(3, 40)}</p>" + self.links(r.randint(1, 6))])),
        )
        return top, bottom

    def blocks(self) -> list[str]:
        """Article text, each block with its mark."""
        r = self.r

        def block() -> str:
            t, u = MARK + self.say(1, r.choice([4, 4, 20, 60, 150])), MARK + self.say(1, 20)
            kind = r.random()
            if kind < 0.72:
                return f"<p>{t}" + r.choice(["</p>", "</p>", "</p>", "", "<br>", f' <a href="/x">{self.say(1, 3)}</a></p>'])
            if kind < 0.80:
                return f"<h2>{u}</h2>"
            if kind < 0.86:
                return f"<ul><li>{u}</li><li>{MARK}{self.say(1, 25)}</li></ul>"
            if kind < 0.90:
                return f"<blockquote>{r.choice([t, f'<p>{t}</p>'])}</blockquote>"
            if kind < 0.93:
                return f"<pre>{t}</pre>"
            if kind < 0.95:
                return f"<table><tr><td>{u}</td><td>{MARK}{self.say(1, 5)}</td></tr></table>"
            return f"<div>{t}</div>"

        out = [block() for _ in range(r.choice([1, 1, 2, 4, 8, 16, 30]))]
        title = f"<h1>{MARK}{self.say(2, 12)}</h1>"
        return ([r.choice([title, f"<header>{title}</header>"])] if r.random() < 0.8 else []) + out

    def page(self) -> str:
        r = self.r
        top, bottom = self.around()
        body = self.blocks()
        for extra in self.around()[r.randint(0, 1)][: r.choice([0, 0, 0, 1])]:
            body.insert(r.randint(0, len(body)), extra)
        inner = "".join(body)
        name = r.choice(["article", "post-content", "entry", "story-body", "main-content", "content", "text", "c7", ""])
        tag = r.choice(["article", "article", "main", "section", "div", "div"])
        core = f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name and (tag in ('div', 'section') or r.random() < 0.5) else ''}>{inner}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            core = f'<{r.choice(["div", "main", "section"])} class="{r.choice(["wrap", "container", "page", "row", "layout", "site"])}">{core}' + (bottom.pop(0) if bottom and r.random() < 0.4 else "") + "</div>"
        return "<!DOCTYPE html><html><head><title>t</title></head><body>" + "".join(top) + core + "".join(bottom) + r.choice(["</body></html>", ""])


def marked_runs(page: Page) -> list[bool]:
    out = [MARK in text for _, text, _ in page.runs]
    page.runs = [(node, " ".join(text.replace(MARK, "").split()) or ".", link) for node, text, link in page.runs]
    return out


def fit(pages: list[str], made: int = 700, most_nodes: int = 40_000, seed: int = 11) -> Model:
    """The model, from pages whose markup names their article and from ``made`` pages with the words of these."""
    seen: dict[str, int] = {}
    given = [read(h, seen) for h in pages]
    words = sorted({w for p in given for _, t, _ in p.runs for w in t.split()[:400]})[:200_000]
    maker = Made(words if len(words) >= 50 else [f"{a}{b}" for a in "ba de ki lo mu na pe ri so tu".split() for b in "lan mer nos tik vel".split()], seed)
    told = [(p, y) for p in given if (y := labelled(p))]
    for _ in range(made):
        p = read(maker.page(), seen)
        told.append((p, marked_runs(p)))
    counts, holds, within = [], [], []
    for page, y in told:
        c, live = described(page)
        kept, every = [0] * len(page.tag), [0] * len(page.tag)
        for (node, text, _), is_kept in zip(page.runs, y, strict=True):
            every[node] += len(text)
            kept[node] += len(text) * is_kept
        for i in range(len(page.tag) - 1, 0, -1):
            kept[page.parent[i]] += kept[i]
            every[page.parent[i]] += every[i]
        counts.append(c)
        holds += [kept[i] > 0 for i in live]
        within += [2 * kept[i] >= every[i] for i in live]
    x, h, w = features(np.concatenate(counts)), np.array(holds, float), np.array(within, float)
    if len(x) > most_nodes:
        pick = np.random.default_rng(seed).choice(len(x), most_nodes, replace=False)
        x, h, w = x[pick], h[pick], w[pick]
    return Model(Boosted().fit(x, h), Boosted().fit(x, w))


def sample(pages: DataFrame, html_col: str, size: int, longest: int) -> list[str]:
    """At most ``size`` different pages of up to ``longest`` characters, picked by hash: rates follow the table's size, so that only about twice as many reach the driver's side."""
    d = pages.select(F.col(html_col).alias("html")).filter((F.length("html") > 0) & (F.length("html") <= longest))
    every = max(1, d.count() // (2 * size))
    d = d.withColumn("h", F.xxhash64("html")).filter(F.pmod("h", F.lit(every)) == 0)
    return [r.html for r in d.groupBy("h").agg(F.min("html").alias("html")).orderBy("h").limit(size).collect()]


def texts(htmls: list[str | None], model: Model, seen: dict[str, int]) -> list[str]:
    pages = [read(h or "", seen) for h in htmls]
    return ["\n\n".join(text for node, text, _ in p.runs if node in keep) for p, keep in zip(pages, model.kept(pages), strict=True)]


#: Characters of pages that are looked at together.
TOGETHER = 4_000_000


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", train_pages: int = 500, train_chars: int = 50_000, model: Model | None = None) -> DataFrame:
    """``keep`` columns of every page with ``text``, its article's blocks joined by empty lines, and ``n_chars``.

    Nodes of a page's tree are judged by boosted trees over density, attribute words, depth and siblings, and
    the likeliest labelling is taken in which nothing under a rejected node is kept. The trees are fitted on at most
    ``train_pages`` pages of up to ``train_chars`` characters whose markup names an article, and on pages made
    of their words in many forms; every page is then read whole, in one pass without a shuffle.

    Null and empty pages, and those without article text, have the empty text; pages may be of any length and
    broken anywhere; equal pages have equal texts and rows repeated whole stay; an empty table gives an
    empty one; columns not in ``keep`` are left out, and so are names that clash with the added ones.
    """
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))
    model = model or fit(sample(pages, html_col, train_pages, train_chars))
    chosen = pages.select(*keep, F.col(html_col).alias("html_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            htmls, out, part, size = b.column("html_").to_pylist(), [], [], 0
            for h in htmls:
                part.append(h)
                size += len(h or "")
                if size > TOGETHER:
                    out += texts(part, model, seen)
                    part, size = [], 0
            out += texts(part, model, seen)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = chosen.drop("html_").schema.add("text", "string", False).add("n_chars", "long", False)
    return chosen.mapInArrow(run, schema)
