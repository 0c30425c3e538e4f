"""PDF text: a pluggable extractor, with a small one for Flate or plain content streams.

The built-in extractor reads the strings that text operators show, in stream
order; fonts with their own encodings are out of its reach.  Set :data:`extract`
to a function from bytes to text to use a full PDF library.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from shiori.functions.text import normalize_pdf

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|T\*|Td|TD|ET|'|\"", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _decoded(token: bytes) -> str:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw.startswith(b"\xfe\xff") else raw.decode("latin-1")


def simple_extract(content: bytes) -> str:
    if not content.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    out = []
    for head, body in _STREAM.findall(content):
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" in body:
            for block in re.findall(rb"\bBT\b(.*?)\bET\b", body, re.S):
                out += [_decoded(t) if t[:1] in b"(<" else "\n" for t in _SHOWN.findall(block)]
                out.append("\n")
    return re.sub(r"\n{2,}", "\n", "".join(out))


extract: Callable[[bytes], str] = simple_extract


def text_of(content: bytes) -> str:
    return normalize_pdf(extract(content))
