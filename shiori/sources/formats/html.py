"""HTML sections: text under its last heading, with newlines at block edges."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from shiori.functions.text import normalize_html

#: Element names.
SKIPPED = frozenset("script style noscript iframe svg head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset("p div li td th dt dd blockquote pre section article main nav footer header aside".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that imply the end of an open p, as HTML5 has it.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: Start tag: the open elements whose end it implies, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("html table td th caption button object template".split())


class _Sections(HTMLParser):
    """Keeps the stack of open elements, so that implied ends are seen as ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: Counter[str] = Counter()
        self.out: list[tuple[str, str]] = []
        self.heading, self.body, self.title = "", [], None
        self.skipping = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in VOID:
            return
        self.stack.append(tag)
        self.open[tag] += 1
        self._opened(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "svg" or (self.skipping and tag not in VOID):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self._opened("p")
            self._closed("p")
        elif tag in HEADINGS:
            self._close(set(HEADINGS), SCOPE)
        else:
            self._close({tag}, {"td", "th"} if tag not in ("tr", "table", "tbody", "html", "body", "td", "th") else set())

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            (self.body if self.title is None else self.title).append(data)

    def _close(self, names: set, border: set | frozenset) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in names:
                while len(self.stack) > k:
                    self._pop()
                return
            if self.stack[k] in border:
                return

    def _pop(self) -> None:
        tag = self.stack.pop()
        self.open[tag] -= 1
        self._closed(tag)

    def _opened(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag in HEADINGS:
            self._flush()
            self.heading, self.title = "", []
        elif tag in BLOCKS:
            self.body.append("\n")

    def _closed(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping -= 1
        elif self.skipping:
            return
        elif tag in HEADINGS and self.title is not None:
            self.heading, self.title = normalize_html("".join(self.title)), None
        elif tag in BLOCKS:
            self.body.append("\n")

    def _flush(self) -> None:
        text = normalize_html("".join(self.body))
        if text:
            self.out.append((self.heading, text))
        self.body = []

    def finish(self) -> list[tuple[str, str]]:
        self.close()
        while self.stack:
            self._pop()
        self._flush()
        return self.out


#: An ampersand that begins no character reference with a semicolon.
_BARE = re.compile(r"&(?!#?[0-9A-Za-z]+;)")


def sections(text: str, bare: bool = True) -> list[tuple[str, str]]:
    """``bare``: character references without a semicolon (an error that HTML5 recovers from) are decoded too, else they stay as written."""
    if not text.strip():
        return []
    parser = _Sections()
    parser.feed(text if bare else _BARE.sub("&amp;", text))
    return parser.finish()
