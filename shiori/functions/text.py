"""Scalar text functions: Column expressions, and their Python twins for the format readers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE_CLASS = r"[\t-\r\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_RUN = re.compile(f"[{WHITE_SPACE.replace(chr(10), '')}]+")


def trim(text: str) -> str:
    return text.strip(WHITE_SPACE)


def utrim(c: Column) -> Column:
    """Trims Unicode white space (Spark's ``trim`` knows the space alone)."""
    return F.regexp_replace(c, f"^{WHITE_CLASS}+|{WHITE_CLASS}+$", "")


def is_blank(c: Column) -> Column:
    return F.length(utrim(c)) == 0


def normalize_html(text: str) -> str:
    """Runs of white space other than newlines become a space, three or more newlines two."""
    return trim(re.sub(r"\n{3,}", "\n\n", _RUN.sub(" ", text)))


def normalize_html_column(c: Column) -> Column:
    spaces = F.regexp_replace(c, r"(?U)[^\S\n]+", " ")
    return utrim(F.regexp_replace(spaces, r"\n{3,}", "\n\n"))


def normalize_pdf(text: str) -> str:
    return trim(re.sub(r"[ \t]+", " ", text))


def normalize_pdf_column(c: Column) -> Column:
    return utrim(F.regexp_replace(c, r"[ \t]+", " "))


def extension(path: Column) -> Column:
    """Lower-case extension of a path's last part; empty where it has none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def row_to_text(headers: list[str], cells: list[Column]) -> Column:
    """``h: v`` of each pair whose header and value are not blank, comma-joined."""
    pairs = [F.when(is_blank(v) | v.isNull() | F.lit(not trim(h)), F.lit(None)).otherwise(F.concat(F.lit(f"{h}: "), v)) for h, v in zip(headers, cells, strict=False)]
    return F.concat_ws(", ", *pairs)


def sha256_hex(content: Column) -> Column:
    return F.sha2(content, 256)


def flatten(c: Column, width: int) -> Column:
    """One line of at most ``width`` characters, with dots where it was cut."""
    line = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width), F.lit("..."))).otherwise(line)
