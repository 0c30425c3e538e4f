"""Format readers: bytes of a file to its chunks."""

from __future__ import annotations

from shiori.operators.chunking import chunk_sections, chunk_text
from shiori.schema import EXTENSIONS
from shiori.sources.formats import delimited, docx, html, markup, pdf


def chunks_of_file(content: bytes, ext: str) -> list[str]:
    """Dispatch on the lower-case extension; raises where the file can't be read as what it claims to be."""
    if ext not in EXTENSIONS:
        raise ValueError(f"unsupported extension: {ext}")
    if ext == "docx":
        return chunk_sections(markup.markdown_sections(docx.pseudo_markdown(content)))
    if ext == "pdf":
        return chunk_text(pdf.text_of(content))
    text = content.decode("utf-8")
    if ext in ("csv", "tsv"):
        return delimited.chunks(text, "," if ext == "csv" else "\t")
    if ext == "txt":
        return chunk_text(text)
    sections = {"md": markup.markdown_sections, "adoc": markup.asciidoc_sections, "html": html.sections, "htm": html.sections}[ext]
    return chunk_sections(sections(text))
