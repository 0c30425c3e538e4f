"""DOCX paragraphs as pseudo-Markdown: styled headings become ``#`` lines."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from shiori.functions.text import trim

_HEADING = re.compile(r"(?:heading|見出し)\s*\+?0*([1-6])\s*", re.I)


def heading_level(style: str | None) -> int | None:
    found = _HEADING.fullmatch(style) if style else None
    return int(found[1]) if found else None


def local(name: str) -> str:
    """A name without its namespace, which does not matter here."""
    return name.rpartition("}")[2]


def inside(paragraph: ElementTree.Element) -> Iterator[ElementTree.Element]:
    """A paragraph's descendants, in order, but for those of paragraphs in it (text boxes)."""
    left = list(reversed(paragraph))
    while left:
        element = left.pop()
        if local(element.tag) != "p":
            yield element
            left += reversed(element)


def line_of(paragraph: ElementTree.Element) -> str:
    """A paragraph's text, led by the marks of its style; empty without text."""
    parts = list(inside(paragraph))
    text = trim("".join(e.text or "" for e in parts if local(e.tag) == "t"))
    styles = [v for e in parts if local(e.tag) == "pStyle" for k, v in e.attrib.items() if local(k) == "val"]
    level = heading_level(styles[-1]) if styles else None
    return f"{'#' * level} {text}" if level and text else text


def markdown_of_xml(xml: str | bytes) -> str:
    lines = (line_of(e) for e in ElementTree.fromstring(xml).iter() if local(e.tag) == "p")
    return "".join(f"{line}\n\n" for line in lines if line)


def pseudo_markdown(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return markdown_of_xml(z.read("word/document.xml"))
