"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags, each with
the tags and class / id words of its ancestors.  Two labels (text, boilerplate)
are scored by weights on ancestor, text and position features plus transition
weights; the weights maximise the likelihood of labelled pages (forward-backward,
Adam), and a page is decoded by Viterbi.

The labelled pages are written by :func:`labelled_pages`: seeded layouts with
articles in article / main / section / div / td elements or bare, among menus,
headers, sidebars, notices, adverts, forms and reader comments, some of them
inside the article, whose labels are known by construction.  Callers may train
on pages of their own instead.

Cutting takes time in proportion to the page: nothing is searched again that was
not found once, and open elements are found by name, not by a walk up the stack.

Edge cases: null and empty html give the empty text; text outside any element is
a block; unclosed p, li, td, th, tr, dt, dd, option are closed as HTML5 implies;
``br`` is white space within its block; character references are decoded; white
space (Unicode) inside a block becomes one space.  Contents of script, style,
title, template, noscript, iframe, svg, textarea, select and button are never
text (those that may hold markup are ignored if they are not closed).  A quote
that is not closed ends nothing: from there on a tag ends at the next ``>``.
Repeated pages are each extracted.  Only the named input columns are read.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Contents that are no markup, and elements of markup that are never text.
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("template noscript svg select button".split())
#: Start tags that end an open element of these names (up to a border).
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BORDER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: What an end tag does not reach out of.
SCOPE = ("html", "table", "td", "th", "caption")
IN_TABLE = frozenset("tr td th tbody thead tfoot caption".split())
#: Elements whose start ends an open p.
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "caption"}
#: Elements that hold blocks of their own rather than a run of text.
CONTAINERS = frozenset("article aside body center details dialog div fieldset footer form header html main menu nav ol section table td ul".split())

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:_-]*)|/)")
_MARK = re.compile(r">|=\s*[\"']")
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PARTS = re.compile(r"[a-z]{2,}")
_STOPS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW | HIDDEN}


@dataclass(slots=True)
class Block:
    text: str
    tag: str
    ancestors: frozenset
    names: frozenset
    #: The names of its own element alone.
    own: frozenset
    linked: int
    #: Number of the innermost container, and of the page's containers those that they stand in.
    group: int
    parents: list[int]


class _Stack:
    """Open block elements, found by name; inline elements are not kept."""

    def __init__(self, known: frozenset | None) -> None:
        self.known = known
        self.open: list[tuple[str, frozenset, int]] = []
        self.at: dict[str, list[int]] = {name: [] for name in BLOCK}
        self.headings: list[int] = []
        self.counts: dict[str, int] = {}
        self.parents = [0]
        self.seen: tuple[frozenset, frozenset] | None = None

    def push(self, name: str, attributes: str) -> None:
        found: frozenset = frozenset()
        if attributes and name not in ("html", "body"):
            found = frozenset(_PARTS.findall(" ".join("".join(x) for x in _NAMES.findall(attributes)).lower()))
            if self.known is not None:
                found &= self.known
        if not self.at[name]:
            self.seen = None
        self.at[name].append(len(self.open))
        if name in HEADINGS:
            self.headings.append(len(self.open))
        group = self.open[-1][2] if self.open else 0
        if name in CONTAINERS:
            self.parents.append(group)
            group = len(self.parents) - 1
        self.open.append((name, found, group))
        for c in found:
            if c not in self.counts:
                self.seen = None
            self.counts[c] = self.counts.get(c, 0) + 1

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            name, found, _ = self.open.pop()
            self.at[name].pop()
            if not self.at[name]:
                self.seen = None
            if name in HEADINGS:
                self.headings.pop()
            for c in found:
                self.counts[c] -= 1
                if not self.counts[c]:
                    del self.counts[c]
                    self.seen = None

    def border(self, names: tuple) -> int:
        return max((self.at[n][-1] for n in names if n in self.at and self.at[n]), default=-1)

    def close(self, name: str, border: int) -> None:
        """Ends the innermost open ``name`` above ``border`` with all inside it."""
        places = self.headings if name in HEADINGS else self.at[name]
        if places and places[-1] > border:
            self.cut(places[-1])

    def context(self) -> tuple[frozenset, frozenset]:
        if self.seen is None:
            self.seen = frozenset(n for n, places in self.at.items() if places), frozenset(self.counts)
        return self.seen


def leaf_blocks(html: str, known: frozenset | None = None) -> list[Block]:
    """The blocks of a page in order; ``known``: the class and id words that matter (None: all)."""
    out: list[Block] = []
    stack, buffer = _Stack(known), []
    link, linked, at, size = False, 0, 0, len(html)
    plain, missing = False, set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if "&" in text:
                text = html_lib.unescape(text)
            text = " ".join(text.split())
            if text:
                own, found, group = stack.open[-1] if stack.open else ("", frozenset(), 0)
                out.append(Block(text, own, *stack.context(), found, linked, group, stack.parents))
        linked = 0

    def tag_end(start: int) -> int:
        """Where the tag's ``>`` stands, quoted values passed over; -1: nowhere."""
        nonlocal plain
        here = start
        while not plain:
            m = _MARK.search(html, here)
            if m and m[0] == ">":
                return m.start()
            close = html.find(m[0][-1], m.end()) if m else -1
            plain = close < 0
            here = close + 1
        return html.find(">", start)

    def held(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if link:
            linked += len(text)

    while at < size:
        m = _OPEN.search(html, at)
        if not m:
            held(html[at:])
            break
        if m.start() > at:
            held(html[at : m.start()])
        at = m.end()
        if m[1]:
            stop = html.find("-->", m.start() + 2)
            at = stop + 3 if stop >= 0 else size
            continue
        name = (m[4] or "").lower()
        if not name:  # <!doctype>, <?xml>, </ and no name
            stop = html.find(">", at)
            at = stop + 1 if stop >= 0 else size
            continue
        stop = tag_end(at)
        if stop < 0:
            break
        attributes, at, end = html[at:stop], stop + 1, m[3]
        if name in _STOPS:
            if end or (name == "svg" and attributes.endswith("/")):
                continue
            found = None if name in missing else _STOPS[name].search(html, at)
            if found:
                stop = tag_end(found.end())
                at = stop + 1 if stop >= 0 else size
            elif name in RAW:
                break
            else:
                missing.add(name)
            continue
        if name == "a":
            link = not end
        elif name == "br":
            buffer.append(" ")
        if name not in BLOCK:
            continue
        flush()
        if end:
            if name in IN_TABLE:
                stack.close(name, stack.border(("html", "table")))
            else:
                stack.close(name, stack.border(("html",) if name == "table" else SCOPE))
        elif name != "hr":
            if name in CLOSES_P:
                stack.close("p", stack.border(SCOPE))
            for other in IMPLIED.get(name, ()):
                stack.close(other, stack.border(BORDER[name]))
            stack.push(name, attributes)
    flush()
    return out


def context_features(tag: str, ancestors: frozenset, names: frozenset, found: frozenset) -> list[str]:
    """Of a block's place in the tree."""
    own = ["bias", f"tag={tag}", *(f"in={n}" for n in ancestors), *(f"name={n}" for n in names), *(f"own={n}" for n in found)]
    inside = next((n for n in ("article", "main") if n in ancestors), None)
    return own + [f"{n}<{inside}" for n in ("header", "footer", "section", "div", "aside") if inside and n in ancestors]


def text_keys(blocks: list[Block]) -> list[tuple]:
    """Of each block's text and of its place in the page: what its features hang on."""
    mass: dict[int, int] = {}
    counts = [b.text.count(" ") + 1 for b in blocks]
    for b, words in zip(blocks, counts, strict=True):
        if b.linked * 2 < len(b.text):
            mass[b.group] = mass.get(b.group, 0) + words
    # Words in a container and all that it holds, and then their share of the page's; an inner container has the higher number.
    parents = blocks[0].parents if blocks else [0]
    held = [mass.get(g, 0) for g in range(len(parents))]
    for g in range(len(parents) - 1, 0, -1):
        held[parents[g]] += held[g]
    whole = max(1, held[0])
    out, titled = [], False
    for b, words in zip(blocks, counts, strict=True):
        text, size = b.text, len(b.text)
        stop, sign = text[-1] in ".!?。！？…\"", text[0] == "©" or text[:9].lower() == "copyright"
        inside = "article" if "article" in b.ancestors else "main" if "main" in b.ancestors else ""
        links = round(4 * min(1.0, b.linked / size)) if b.linked else 0
        own = mass.get(b.group, 0).bit_length()
        out.append((min(size.bit_length(), 11), min(words.bit_length(), 8), links, min(own, 9), 8 * held[b.group] // whole, 8 * held[parents[b.group]] // whole, stop, sign, titled and b.tag != "h1", inside))
        titled = titled or b.tag == "h1"
    return out


def text_features(key: tuple) -> list[str]:
    """The names of the features of a key."""
    size, words, links, mass, held, around, stop, sign, titled, inside = key
    own = [f"size={size}", f"words={words}", f"links={links}", f"mass={mass}", f"held={held}", f"around={around}"]
    own += ["stop"] * stop + ["sign"] * sign + ["titled"] * titled
    return own + [f"links={links}<{inside}"] * bool(inside)


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of each block's binary features."""
    return [context_features(b.tag, b.ancestors, b.names, b.own) + text_features(key) for b, key in zip(blocks, text_keys(blocks), strict=True)]


@dataclass
class Crf:
    weights: dict[str, float]
    #: Of (boilerplate, text) followed by (boilerplate, text).
    transitions: np.ndarray

    def words(self) -> frozenset:
        """The class and id words that have a weight."""
        return frozenset(f[5:] for f in self.weights if f.startswith("name="))

    def scores(self, blocks: list[Block]) -> list[float]:
        get, places, texts = self.weights.get, {}, {}
        out = []
        for b, own in zip(blocks, text_keys(blocks), strict=True):
            key = b.tag, b.ancestors, b.names, b.own
            if key not in places:
                places[key] = sum(get(f, 0.0) for f in context_features(*key))
            if own not in texts:
                texts[own] = sum(get(f, 0.0) for f in text_features(own))
            out.append(places[key] + texts[own])
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The labels (True: text) of the likeliest path, by Viterbi."""
        if not blocks:
            return []
        scores = self.scores(blocks)
        (t00, t01), (t10, t11) = self.transitions.tolist()
        a, b, back = 0.0, scores[0], []
        for s in scores[1:]:
            from0, from1 = a + t00 < b + t10, a + t01 < b + t11
            back.append((from0, from1))
            a, b = (b + t10 if from0 else a + t00), (b + t11 if from1 else a + t01) + s
        state = b > a
        labels = [state]
        for from0, from1 in reversed(back):
            state = from1 if state else from0
            labels.append(state)
        return labels[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], *, rounds: int = 250, l2: float = 1e-4, rate: float = 0.15) -> Crf:
    """Maximum likelihood with an L2 prior, on all labelled pages at once."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in fs] for fs in features(blocks)] for blocks, _ in pages]
    p, t = len(pages), max(len(r) for r in rows)
    y, mask = np.zeros((p, t)), np.zeros((p, t), bool)
    cell, feature = [], []
    for i, (own, (_, labels)) in enumerate(zip(rows, pages, strict=True)):
        mask[i, : len(own)] = True
        y[i, : len(own)] = labels
        for k, fs in enumerate(own):
            cell += [i * t + k] * len(fs)
            feature += fs
    cell, feature = np.array(cell), np.array(feature)
    pairs = mask[:, 1:]
    seen = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum()
    w = np.zeros(len(names) + 4)
    m1, m2 = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        tr = w[-4:].reshape(2, 2)
        emit = np.zeros((p, t, 2))
        emit[:, :, 1] = np.bincount(cell, w[feature], p * t).reshape(p, t)
        fwd, bwd = np.zeros((p, t, 2)), np.zeros((p, t, 2))
        fwd[:, 0] = emit[:, 0]
        for k in range(1, t):
            last = fwd[:, k - 1]
            new = emit[:, k] + np.logaddexp(last[:, :1] + tr[0], last[:, 1:] + tr[1])
            fwd[:, k] = np.where(mask[:, k, None], new, last)
        for k in range(t - 2, -1, -1):
            ahead = emit[:, k + 1] + bwd[:, k + 1]
            new = np.logaddexp(ahead[:, :1] + tr[:, 0], ahead[:, 1:] + tr[:, 1])
            bwd[:, k] = np.where(mask[:, k + 1, None], new, 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        p1 = np.where(mask, np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z[:, None]), 0)
        joint = np.exp(fwd[:, :-1, :, None] + tr + (emit + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pairs[:, :, None, None]
        wrong = ((y - p1) * mask).reshape(-1)
        grad = np.concatenate((np.bincount(feature, wrong[cell], len(names)), (seen - joint.sum(axis=(0, 1))).reshape(-1))) / p - l2 * w
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        w = w + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf({n: float(w[i]) for n, i in names.items()}, w[-4:].reshape(2, 2))


#: Words by which pages name their parts.
PARTS = {
    "menu": "menu nav navbar navigation breadcrumb breadcrumbs crumbs tabs toolbar pagination pager links topbar skip",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion promoted banner billboard",
    "side": "sidebar side rail widget related recommended recommendations trending popular more teaser teasers",
    "share": "share sharing social follow tags buttons tools actions",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup paywall",
    "comments": "comments comment commentlist replies reply respond discussion disqus responses thread reader",
    "footer": "footer foot bottom copyright colophon legal imprint",
    "header": "header masthead branding logo top site",
    "form": "form login search contact signin register poll",
    "article": "content article post entry story main text body hentry news blog prose",
}
PARTS = {k: v.split() for k, v in PARTS.items()}


def labelled_pages(n: int = 1300, seed: int = 7) -> list[tuple[list[Block], list[bool]]]:
    """Seeded pages of many layouts; a block is text where it holds the mark that only articles are given."""
    rng = random.Random(seed)
    mark = ""

    def words(k: int, stop: bool = True) -> str:
        text = " ".join("".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(1, 9))) for _ in range(k))
        style = rng.random()
        if style < 0.06:
            return text.replace(" ", rng.choice((" | ", "### ", "!! ", " - ")))
        if style < 0.1:
            text = text.replace(" ", rng.choice((" &copy; ", " &middot; ", " &amp; ")), 1)
        text = text.upper() if style > 0.97 else text.capitalize()
        return text + ("." if stop else "")

    def chance(p: float) -> bool:
        return rng.random() < p

    def noise() -> str:
        """A name that tells nothing."""
        return "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randint(1, 3))) + str(rng.randrange(99))

    def named(tag: str, part: str, inner: str) -> str:
        name = rng.choice(PARTS[part])
        if chance(0.4):
            name = rng.choice((f"{name}-{rng.choice(('box', 'wrap', 'list', 'area', 'inner', 'block'))}", f"{noise()} {name}", f"{rng.choice(('site', 'page', 'top'))}-{name}"))
        return f'<{tag} {rng.choice(("class", "id", "class"))}="{name}">{inner}</{tag}>'

    def menu() -> str:
        items = [f'<a href="/{i}">{words(rng.randint(1, 4), chance(0.3))}</a>' for i in range(rng.randint(2, 9))]
        kind = rng.random()
        if kind < 0.7:
            return "<ul>" + "".join(f"<li>{x}{'</li>' if chance(0.8) else ''}" for x in items) + "</ul>"
        return "<div>" + rng.choice((" | ", " ", " &middot; ")).join(items) + "</div>"

    def some(tags: tuple = ("div", "div", "section")) -> str:
        return rng.choice(tags)

    def prose(k: int) -> str:
        """Text of a notice, advert or comment."""
        return "".join(f"<p>{words(rng.randint(3, 40))}</p>" if chance(0.6) else f"<div>{words(rng.randint(3, 40))}</div>" if chance(0.3) else words(rng.randint(3, 30)) for _ in range(k))

    def comments() -> str:
        head = f"<h{rng.choice('234')}>{words(2, False)}</h2>" if chance(0.6) else ""
        many = rng.randint(1, 4)
        kind = rng.random()
        if kind < 0.4:
            return named(some(), "comments", head + "".join(f'<div class="{rng.choice(("comment", "reply", "item"))}">{prose(1)}</div>' for _ in range(many)))
        if kind < 0.7:
            return named(rng.choice(("ol", "ul")), "comments", "".join(f"<li>{'<b>' + words(1, False) + '</b> ' if chance(0.5) else ''}{prose(1)}</li>" for _ in range(many)))
        return named(some(), "comments", head + prose(many))

    def boiler(inside: bool = False) -> str:
        kinds = [
            lambda: f"<nav>{menu()}</nav>",
            lambda: named("div", "menu", menu()),
            lambda: named(some(("div", "div", "aside", "p", "section")), "advert", words(rng.randint(1, 40))),
            lambda: named(some(), "advert", prose(rng.randint(1, 2))),
            lambda: f"<aside>{prose(rng.randint(1, 2))}{menu() if chance(0.5) else ''}</aside>",
            lambda: named(some(("div", "section", "aside")), "side", (f"<h3>{words(2, False)}</h3>" if chance(0.5) else "") + prose(rng.randint(0, 2)) + menu()),
            lambda: named(some(("div", "ul", "p")), "share", rng.choice((words(rng.randint(1, 4), False), menu(), f"<a href='#'>{words(1, False)}</a> <a href='#'>{words(1, False)}</a>"))),
            lambda: named(some(("div", "div", "section", "dialog")), "notice", prose(rng.randint(1, 2))),
            lambda: f"<form>{prose(1)}<label>{words(2, False)}</label><input><button>{words(1, False)}</button></form>",
            lambda: named("div", "form", f"<form><p>{words(rng.randint(1, 12))}</p><input></form>"),
            comments,
        ]
        return rng.choice([*kinds[2:], *[kinds[6]] * 3] if inside else kinds)()

    def m(k: int, stop: bool = True) -> str:
        return mark + words(k, stop)

    def paragraph(loose: bool) -> str:
        text = m(rng.choice((1, 2, 5, 12, 30, 60, 120)), chance(0.9))
        kind = rng.random()
        if loose:
            return rng.choice((f"<div>{text}</div>", f"{text}<br><br>{words(20)}", f"<div class='{noise()}'>{text}</div>", f"<p>{text}</p>"))
        if kind < 0.55:
            return f"<p>{text}</p>"
        if kind < 0.62:
            return f"<p><b>{text}<br><p>{m(20)}</p>"
        if kind < 0.7:
            level = rng.randint(2, 4)
            return f"<h{level}>{m(rng.randint(1, 6), False)}</h{level}><p>{text}</p>"
        if kind < 0.76:
            return f"<{(tag := rng.choice(('ul', 'ol')))}>" + "".join(f"<li>{m(rng.randint(1, 15))}" for _ in range(3)) + f"</{tag}>"
        if kind < 0.81:
            return f'<blockquote>{text}</blockquote><p>{m(9)} <a href="#">{words(2, False)}</a> {words(8)}</p>'
        if kind < 0.85:
            return "<table>" + "".join(f"<tr><td>{m(2, False)}</td><td>{m(2, False)}</td></tr>" for _ in range(3)) + "</table>"
        if kind < 0.89:
            return f"<figure><img src='x'><figcaption>{m(rng.randint(2, 14), chance(0.5))}</figcaption></figure><p>{text}</p>"
        if kind < 0.92:
            return f"<pre><code>{m(rng.randint(3, 30), False)}</code></pre><p>{text}</p>"
        if kind < 0.95:
            return f"<p><a href='#'>{m(rng.randint(1, 8), chance(0.5))}</a></p><p>{text}</p>"
        if kind < 0.97:
            return f"<dl><dt>{m(2, False)}<dd>{m(8)}</dl>"
        return f"<div class='{noise()}'>{text}</div><section><h2>{m(3, False)}</h2><p>{m(30)}</p></section>"

    def link_list() -> str:
        """A list of links that is what the article tells."""
        items = [f"<a href='/{i}'>{m(rng.randint(1, 9), chance(0.2))}</a>" for i in range(rng.randint(2, 12))]
        about = f"{rng.choice((', ', ' - ', ' '))}{words(rng.randint(2, 12))}" if chance(0.3) else ""
        tag = rng.choice(("ul", "ul", "ol"))
        return f"<{tag}>" + "".join(f"<li>{x}{about}{'</li>' if chance(0.7) else ''}" for x in items) + f"</{tag}>"

    def column() -> str:
        """A name that tells of the place in the layout alone."""
        return rng.choice(("wrap", "wrapper", "col", "col1", "col2", "col3", "column", "left", "right", "center", "inner", "outer", "box", "row", "cell", "grid", "layout", "container", "block", "a", "b", noise()))

    def columns(content: str) -> str:
        """The article in one column, and boilerplate in others, none of them named for what it holds."""
        kind, head = rng.choice(("id", "class")), rng.choice(("h2", "h3", "h4", "p", "div"))
        side = "".join(f"<{head}>{words(rng.randint(1, 3), False)}</{head}>{menu()}" if chance(0.7) else menu() for _ in range(rng.randint(1, 3)))
        cells = [f"<div {kind}='{column()}'>{content}</div>", f"<div {kind}='{column()}'>{side}</div>"]
        if chance(0.35):
            cells.reverse()
        if chance(0.2):
            cells.insert(rng.randrange(3), f"<div {kind}='{column()}'>{menu()}</div>")
        inner = "".join(cells)
        return f"<div {kind}='{column()}'>{inner}</div>" if chance(0.7) else inner

    def article() -> str:
        loose, kind = chance(0.2), rng.random()
        parts = [paragraph(loose) for _ in range(rng.choice((1, 1, 2, 3, 5, 9, 14)))]
        if 0.7 <= kind < 0.82:  # beside other columns: an article of some length
            parts += [paragraph(loose) for _ in range(3)]
        if kind < 0.54 and chance(0.18):
            for _ in range(rng.randint(1, 2)):
                parts.insert(rng.randint(0, len(parts)), link_list())
            if chance(0.25):
                parts = [link_list()]
        level = 1 if chance(0.8) else 2
        head = f"<h{level}>{m(rng.randint(1, 12), chance(0.4))}</h{level}>" if chance(0.88) else ""
        line = f"<{(tag := rng.choice(('p', 'div', 'address')))} class='{rng.choice(('byline', 'author', 'date', 'meta', noise()))}'>{m(rng.randint(2, 6), False)}</{tag}>" if chance(0.25) else ""
        if head and chance(0.2):
            head, line = f"<header>{head}{line}</header>", ""
        for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
            parts.insert(rng.randint(1, len(parts)), boiler(True))
        foot = f"<footer>{rng.choice((menu(), words(rng.randint(2, 9))))}</footer>" if chance(0.08) else ""
        content = head + line + "".join(parts) + foot
        if kind < 0.35:
            return f"<article>{content}</article>"
        if kind < 0.45:
            return f"<main><article class='{noise()}'>{content}</article>{boiler() if chance(0.3) else ''}</main>"
        if kind < 0.54:
            return f"<main>{content}</main>"
        if kind < 0.7:
            return named(some(), "article", content)
        if kind < 0.82:
            return columns(content)
        if kind < 0.86:
            return f'<div id="page"><section class="post">{content}</section></div>'
        if kind < 0.92:
            return f"<div id='{noise()}'>{content}</div>"
        if kind < 0.96:
            return f"<table><tr><td class='{noise()}'>{named('div', 'menu', menu())}</td><td>{content}</td></tr></table>"
        return content

    out = []
    for _ in range(n):
        page = article()
        before = "".join(boiler() for _ in range(rng.choice((0, 0, 1, 1, 2, 3))))
        after = "".join(boiler() for _ in range(rng.choice((0, 0, 1, 1, 2, 3))))
        top = f"<header>{words(rng.randint(1, 5), False)}{menu() if chance(0.4) else ''}</header>" if chance(0.35) else named("div", "header", words(rng.randint(1, 5), False) + (menu() if chance(0.5) else "")) if chance(0.3) else ""
        line = rng.choice(("&copy; ", "&copy; 2020 ", "Copyright ", "")) + words(rng.randint(2, 12))
        foot = rng.choice((f"<footer>{line}</footer>", f"<footer><p>{line}</p>{menu()}</footer>", named("div", "footer", f"<p>{line}</p>"), f"<p>&copy; {line}</p>", ""))
        body = f"{top}{before}{page}{after}{foot}"
        if chance(0.3):
            body = f"<div class='{rng.choice(('has-sidebar', 'wrapper', 'container', 'page with-ads', 'layout comments-open', 'no-header', noise()))}'>{body}</div>"
        blocks = leaf_blocks(f"<html><head><title>{words(4)}</title></head><body>{body}</body></html>")
        labels = [mark in b.text for b in blocks]
        for b in blocks:
            b.text = b.text.replace(mark, "").strip() or "."
        if blocks:
            out.append((blocks, labels))
    return out


@functools.lru_cache(maxsize=2)
def default_model(n: int = 1300, seed: int = 7) -> Crf:
    return train(labelled_pages(n, seed))


def main_text(model: Crf, html: str | None, known: frozenset | None = None) -> str:
    blocks = leaf_blocks(html, model.words() if known is None else known) if html else []
    return "\n".join(b.text for b, keep in zip(blocks, model.decode(blocks), strict=True) if keep)


def extract(df: DataFrame, model: Crf | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row.  No shuffle; memory is one Arrow batch and one page."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.words()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [main_text(shared.value, x.as_py(), known) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
