"""CSV and TSV rows as ``header: value`` lines, packed into chunks."""

from __future__ import annotations

import csv
import io

from shiori.functions.text import trim
from shiori.operators.chunking import pack_lines
from shiori.schema import CHUNK_SIZE


def row_text(headers: list[str], cells: list[str]) -> str:
    return ", ".join(f"{h}: {v}" for h, v in zip(headers, cells, strict=False) if trim(h) and trim(v))


def chunks(text: str, delimiter: str, size: int = CHUNK_SIZE) -> list[str]:
    """The whole content is trimmed first, and a byte order mark goes; a record of another length than the header fails the file; cells have any length."""
    body = trim(text.removeprefix("\ufeff"))
    csv.field_size_limit(max(csv.field_size_limit(), len(body) + 1))
    rows = [r for r in csv.reader(io.StringIO(body, newline=""), delimiter=delimiter) if r]
    if not rows:
        return []
    headers, records = rows[0], rows[1:]
    for number, record in enumerate(records, 2):
        if len(record) != len(headers):
            raise ValueError(f"record {number} has {len(record)} fields, the header {len(headers)}")
    return pack_lines(filter(None, (row_text(headers, r) for r in records)), size)
