"""AsciiDoc and Markdown sections: (heading with its marks, body).

The Markdown reader is a block parser (headings, paragraphs, quotes, lists,
fences, indented code, tables, HTML blocks, front matter) that yields the text a
CommonMark reader would show: emphasis and links lose their marks, images keep
their alt text, raw HTML is dropped.  Cells of a table stand without a separator,
and code runs into the text that follows, as no paragraph ends there.
"""

from __future__ import annotations

import html
import re

from shiori.functions.text import trim

_ADOC = re.compile(r"^(={1,6})\s+([^\n]+)$", re.M)


def asciidoc_sections(text: str) -> list[tuple[str, str]]:
    """``\\s+`` may cross a newline, so a block delimiter of equal signs leads a heading too."""
    text = trim(text)
    if not text:
        return []
    found = list(_ADOC.finditer(text))
    if not found:
        return [("", text)]
    lead = trim(text[: found[0].start()])
    ends = [m.start() for m in found[1:]] + [len(text)]
    return [("", lead)] * bool(lead) + [(f"{m[1]} {trim(m[2])}", trim(text[m.end() : end])) for m, end in zip(found, ends, strict=True)]


_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
_TASK = re.compile(r"\[[ xX]\][ \t]+")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:!--|[!?]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_INLINE_TAG = re.compile(r"</?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--.*?-->", re.S)


_MARKS = [(re.compile(rf"{m}(?=\S)"), re.compile(rf"(?<=\S){m}")) for m in (r"\*\*\*", r"\*\*", r"\*", "~~", "~", r"\|\|", r"\^")]
_MARKS += [(re.compile(rf"(?<!\w){m}(?=\S)"), re.compile(rf"(?<=\S){m}(?!\w)")) for m in ("___", "__", "_")]
#: Quotes and lists in each other are followed so deep; what lies deeper is text.
DEEPEST = 100


def unmarked(text: str, opener: re.Pattern, closer: re.Pattern) -> str:
    """``text`` without pairs of marks; what one mark finds no partner for, no later one does."""
    out, at = [], 0
    while (a := opener.search(text, at)) and (b := closer.search(text, a.end() + 1)):
        out += text[at : a.start()], text[a.end() : b.start()]
        at = b.end()
    return "".join([*out, text[at:]])


def inline(text: str) -> str:
    """The text that inline Markdown shows."""
    kept: list[str] = []

    def keep(shown: str) -> str:
        kept.append(shown)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match) -> str:
        body = m[2].replace("\n", " ")
        return keep(body[1:-1] if len(body) > 2 and body[0] == body[-1] == " " and body.strip() else body)

    text = text.replace("\x00", "\ufffd")
    text = re.sub(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", code, text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(m[1]), text)
    text = re.sub(r"(?<!\$)\$\$?(?=\S)[^$]+?(?<=\S)\$\$?(?!\d)", "", text) if "$" in text and re.search(r"\$\S[^$]*\S?\$", text) else text
    text = re.sub(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[^\s<>@]+@[^\s<>@]+)>", lambda m: keep(m[1]), text)
    text = _INLINE_TAG.sub("", text)
    text = re.sub(r"\[\^[^\]\s]+\]", "", text)
    link = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\](?:\((?:<[^>]*>|[^()\s]*(?:\([^()]*\)[^()\s]*)*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)|\[[^\]]*\])")
    while True:
        text, n = link.subn(lambda m: m[1], text)
        if not n:
            break
    for opener, closer in _MARKS:
        text = unmarked(text, opener, closer)
    text = html.unescape(text)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], text)


class _Markdown:
    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.heading, self.parts, self.text = "", [], ""

    def flush(self) -> None:
        shown = trim(self.text)
        if shown:
            self.parts.append(shown)
        self.text = ""

    def section(self) -> None:
        self.flush()
        if self.parts:
            self.out.append((self.heading, "\n\n".join(self.parts)))
        self.parts = []

    def head(self, level: int, title: str) -> None:
        self.section()
        self.heading = f"{'#' * level} {trim(inline(title))}"

    def paragraph(self, lines: list[str], tight: bool) -> None:
        if lines:
            body = "\n".join(re.sub(r"(?: {2,}|\\)$", "", x.strip(" \t")) if i + 1 < len(lines) else x.strip(" \t") for i, x in enumerate(lines))
            self.text += inline(body)
            if not tight:
                self.flush()

    def blocks(self, lines: list[str], tight: bool = False, depth: int = 0) -> None:
        held: list[str] = []
        nested = depth < DEEPEST
        i = 0
        while i < len(lines):
            line = lines[i].expandtabs(4) if "\t" in lines[i][:8] else lines[i]
            atx, fence, item = _ATX.match(line), _FENCE.match(line), _ITEM.match(line)
            if not line.strip():
                self.paragraph(held, tight)
                held = []
                i += 1
            elif held and _SETEXT.match(line) and not (tight and line.lstrip().startswith("-") and _ITEM.match(line) and line.strip() == "-"):
                title, held = "\n".join(held), []
                self.head(1 if "=" in line else 2, title.replace("\n", ""))
                i += 1
            elif not held and line.startswith("    "):
                while i < len(lines) and (lines[i].startswith("    ") or not lines[i].strip()):
                    self.text += lines[i][4:] + "\n"
                    i += 1
            elif atx:
                self.paragraph(held, tight)
                held = []
                self.head(len(atx[1]), atx[2] or "")
                i += 1
            elif fence and not (fence[1][0] == "`" and "`" in fence[2]):
                self.paragraph(held, tight)
                held = []
                i += 1
                close = re.compile(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$")
                while i < len(lines) and not close.match(lines[i]):
                    self.text += lines[i] + "\n"
                    i += 1
                i += 1
            elif _RULE.match(line):
                self.paragraph(held, tight)
                held = []
                i += 1
            elif nested and _QUOTE.match(line):
                self.paragraph(held, tight)
                held, inner = [], []
                while i < len(lines) and lines[i].strip() and (_QUOTE.match(lines[i]) or not self._starts_block(lines[i])):
                    inner.append(_QUOTE.sub("", lines[i], count=1))
                    i += 1
                # Marks that all lines share are one quote for what is shown.
                while all(map(_QUOTE.match, inner)):
                    inner = [_QUOTE.sub("", x, count=1) for x in inner]
                self.blocks(inner, depth=depth + 1)
                self.flush()
            elif nested and item and not (held and (not line[item.end() :].strip() or (item[2][0].isdigit() and item[2][:-1] != "1"))):
                self.paragraph(held, tight)
                held = []
                i = self._list(lines, i, depth)
            elif not held and _HTML.match(line):
                while i < len(lines) and lines[i].strip():
                    i += 1
            elif not held and i + 1 < len(lines) and "|" in line and _TABLE.match(lines[i + 1]) and "-" in lines[i + 1]:
                rows = [line]
                i += 2
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    rows.append(lines[i])
                    i += 1
                for row in rows:
                    cells = re.split(r"(?<!\\)\|", row.strip().strip("|"))
                    self.text += "".join(inline(c.strip()) for c in cells)
            else:
                held.append(line)
                i += 1
        self.paragraph(held, tight)

    def _starts_block(self, line: str) -> bool:
        return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _ITEM.match(line))

    def _list(self, lines: list[str], i: int, depth: int) -> int:
        """Items of one list; it is loose if a blank line parts its blocks."""
        items: list[list[str]] = []
        kind = None
        loose, blank = False, False
        while i < len(lines):
            m = _ITEM.match(lines[i])
            if not m or _RULE.match(lines[i]) or (kind is not None and m[2][-1] != kind):
                break
            kind = m[2][-1]
            loose |= blank
            space = m[3] or " "
            width = len(m[1]) + len(m[2]) + (len(space) if len(space) <= 4 and lines[i][m.end() :].strip() else 1)
            own = [lines[i][width:]]
            i += 1
            blank = False
            while i < len(lines):
                if not lines[i].strip():
                    own.append("")
                    blank = True
                elif len(lines[i]) - len(lines[i].lstrip(" ")) >= width:
                    loose |= blank
                    own.append(lines[i][width:])
                    blank = False
                elif not blank and not self._starts_block(lines[i]) and not _QUOTE.match(lines[i]):
                    own.append(lines[i].lstrip())
                else:
                    break
                i += 1
            while own and not own[-1].strip():
                own.pop()
            items.append(own)
        for own in items:
            if own:
                own[0] = _TASK.sub("", own[0], count=1)
            self.blocks(own, tight=not loose, depth=depth + 1)
            self.flush()
        return i


def markdown_sections(text: str) -> list[tuple[str, str]]:
    if not trim(text):
        return []
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    reader = _Markdown()
    # Front matter is shown as the text of its block.
    if lines[0].rstrip() in ("---", "+++") and (end := next((k for k, x in enumerate(lines[1:], 1) if x.rstrip() in (lines[0].rstrip(), "...")), 0)):
        reader.text += "\n".join(lines[1:end]) + "\n"
        lines = lines[end + 1 :]
    definition = re.compile(r" {0,3}\[[^\]]+\]:\s*\S+.*$")
    reader.blocks([x for x in lines if not definition.match(x)])
    reader.section()
    return reader.out
