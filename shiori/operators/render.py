"""Results as lines or JSON, as columns and as driver-side text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shiori.functions.text import flatten

HEADER = f"{'Score':<8} | {'Method':<10} | {'Source':<15} | Text"
RULE = "-" * 80


def short_source(source: Column) -> Column:
    return F.when(F.length(source) > 15, F.concat(F.substring(source, 1, 13), F.lit(".."))).otherwise(source)


def line() -> Column:
    """One line of a hit (score, method, source, text)."""
    return F.format_string("%-8s | %-10s | %-15s | %s", F.format_string("%.4f", "score"), F.col("method"), short_source(F.col("source")), flatten(F.col("text"), 50))


def json_row() -> Column:
    return F.to_json(F.struct("score", "method", "source", "chunk_id", "text"))


def as_text(hits: DataFrame) -> str:
    return "\n".join([HEADER, RULE, *(r[0] for r in hits.orderBy("rank").select(line()).collect())])


def as_json(hits: DataFrame) -> str:
    rows = [json.loads(r[0]) for r in hits.orderBy("rank").select(json_row()).collect()]
    return json.dumps(rows, ensure_ascii=False, indent=2)


def status_text(path: str, tables: list[dict]) -> str:
    out = ["", "--- Database Status ---", f"Path:  {path}", f"Total: {len(tables)} table(s)", RULE, f"{'Table Name':<20} | {'Rows':>8} | {'Version':>7} | Fields", RULE]
    for t in tables:
        fields = ", ".join(t["fields"])
        out.append(f"{t['name']:<20} | {t['row_count']:>8} | {t['version']:>7} | {fields[:40] + '...' if len(fields) > 40 else fields}")
    return "\n".join([*out, RULE])


def list_text(rows: list) -> str:
    if not rows:
        return "No documents registered."
    return "\n".join([f"{'Source':<60} | Name", RULE, *(f"{r.source:<60} | {r.doc_name}" for r in rows)])
