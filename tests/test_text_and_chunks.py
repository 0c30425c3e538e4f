"""Chunking, text functions and format readers, on the fixtures of FIXTURES.md."""

import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shiori.functions import text as tx
from shiori.operators import chunking, embedding, packing
from shiori.sources import formats
from shiori.sources.formats import delimited, docx, html, markup, pdf


def test_chunk_fixtures():
    # Small inputs and their results, which any engine of this kind must give.
    assert chunking.chunk_text("") == chunking.chunk_text("   ") == []
    assert chunking.chunk_text("短いテキスト") == ["短いテキスト"]
    parts = chunking.chunk_text("あ" * 900 + "。" + "い" * 900, 1000, 0, 0)
    assert [len(p) for p in parts] == [901, 900] and parts[0].endswith("。")
    assert chunking.merge_short(["長いチャンク" * 50, "短"], 200) == ["長いチャンク" * 50 + "\n\n短"]
    assert chunking.chunk_sections([("## 見出し", "本文テキスト")])[0].startswith("## 見出し\n")
    assert chunking.chunk_sections([("## empty", "  ")]) == []


def test_overlap_echo_and_short_first():
    assert [len(p) for p in chunking.chunk_text("あ" * 900 + "。" + "い" * 1900)] == [1053, 1000, 1000, 200]
    assert [len(p) for p in chunking.chunk_text("短い。" + "い" * 2000)] == [3, 1000, 1000, 300]


def naive_cut(window):
    """The rule in words, by walking backwards."""
    for i in range(len(window), 0, -1):
        if window[i - 1] in "。！？":
            return i
    for i in range(len(window), 1, -1):
        if window[i - 2 : i] == "\n\n":
            return i
    for i in range(len(window), 0, -1):
        if window[i - 1] == "\n":
            return i
    return len(window)


@given(st.text(alphabet="a。！\n 𝄞", min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_cut_matches_the_rule(window):
    assert chunking.cut_length(window) == naive_cut(window)


def test_no_text_is_lost_without_overlap():
    rng = random.Random(1)
    text = "".join(rng.choice("ab。\n") for _ in range(5000))
    squeezed = "".join(text.split())
    assert "".join("".join(chunking.chunk_text(text, 100, 0, 0)).split()) == squeezed


def test_asciidoc():
    assert len(markup.asciidoc_sections("== はじめに\n\n本文1\n\n=== 節\n\n本文2")) == 2
    assert markup.asciidoc_sections("前置き\n\n== 見出し\n\n本文") == [("", "前置き"), ("== 見出し", "本文")]
    assert markup.asciidoc_sections("no heading") == [("", "no heading")]
    assert markup.asciidoc_sections("====\nfoo\nbar")[0][0] == "==== foo"


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("前置き\n\n## セクション\n\n本文", [("", "前置き"), ("## セクション", "本文")]),
        ("# a\n\n## b\n\nx", [("## b", "x")]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", [("", "ab12")]),
        ("- one\n- two *em*\n\n> q", [("", "one\n\ntwo em\n\nq")]),
        ("```\ncode\n```\nnext", [("", "code\nnext")]),
        ("a [link](http://x) ![alt](i.png) `c*d*` <b>x</b>", [("", "a link alt c*d* x")]),
        ("Title\n===\nbody  \nmore", [("# Title", "body\nmore")]),
        ("a &amp; b \\*c\\*", [("", "a & b *c*")]),
        ("", []),
    ],
)
def test_markdown(source, expected):
    assert markup.markdown_sections(source) == expected


def test_html():
    assert html.sections("<html><body><h1>タイトル</h1><p>本文</p></body></html>") == [("タイトル", "本文")]
    assert html.sections("<script>alert(1)</script><p>テキスト</p>") == [("", "テキスト")]
    assert tx.normalize_html("a  b\n\n\nc") == "a b\n\nc"
    assert html.sections("<p>a<p>b<ul><li>x<li>y</ul>") == [("", "a\n\nb\n\nx\n\ny")]
    assert html.sections("<h1>only</h1>") == []
    assert html.sections("<p>a<br>b&nbsp;c</p>") == [("", "ab c")]
    assert html.sections("<svg><svg>x</svg>y</svg>z") == [("", "z")]


def test_delimited():
    assert delimited.chunks("名前,年齢\n田中,30", ",") == ["名前: 田中, 年齢: 30"]
    assert delimited.chunks("名前,年齢\n田中,", ",") == ["名前: 田中"]
    assert delimited.chunks('a,b\n"x\ny",2', ",") == ["a: x\ny, b: 2"]
    assert delimited.chunks("", ",") == delimited.chunks("a,b", ",") == []
    with pytest.raises(ValueError):
        delimited.chunks("a\tb\n1\t\n", "\t")  # the trim eats the last, empty cell
    assert chunking.pack_lines(["a" * 30, "b" * 30, "c" * 80, "d"], 61) == ["a" * 30 + "\n" + "b" * 30, "c" * 80, "d"]


def test_docx_text_boxes_and_deep_runs():
    """A paragraph inside another stands for itself; text lies at any depth; an empty heading is none."""
    xml = '<d xmlns="x"><p><pPr><pStyle val="Heading2"/></pPr><r><ins><t>He</t></ins></r><box><p><r><t>in a box</t></r></p></box><r><t>ad</t></r></p><p><pPr><pStyle val="Heading1"/></pPr></p><p><r><t> </t><del>gone</del></r></p></d>'
    assert docx.markdown_of_xml(xml) == "## Head\n\nin a box\n\n"


def test_docx():
    assert [docx.heading_level(s) for s in ("Heading1", "heading 2", "見出し 1", "Normal", None, "Heading7")] == [1, 2, 1, None, None, None]
    xml = '<w:d xmlns:w="u"><w:p><w:pPr><w:pStyle w:val="見出し 1"/></w:pPr><w:r><w:t>はじめに</w:t></w:r></w:p><w:p><w:r><w:t>a &lt; b</w:t></w:r></w:p></w:d>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    assert docx.pseudo_markdown(out.getvalue()) == "# はじめに\n\na < b\n\n"
    assert formats.chunks_of_file(out.getvalue(), "docx") == ["# はじめに\na < b"]


def test_pdf():
    assert tx.normalize_pdf("こんにちは   世界\n次の行") == "こんにちは 世界\n次の行"
    body = b"BT (Hello \\(PDF\\)) Tj T* (world) Tj ET"
    assert pdf.text_of(b"%PDF-1.4\n1 0 obj\n<</Length 9>>\nstream\n" + body + b"\nendstream") == "Hello (PDF)\nworld"


def test_dispatch_errors():
    with pytest.raises(ValueError):
        formats.chunks_of_file(b"x", "exe")
    with pytest.raises(UnicodeDecodeError):
        formats.chunks_of_file(b"\xff\xfe", "txt")
    assert formats.chunks_of_file(b"", "txt") == []


def test_columns_agree_with_python(spark):
    texts = ["　 a  b\t\tc\n\n\n\nd \n", "", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.utrim(F.col("t")).alias("a"), tx.normalize_html_column(F.col("t")).alias("b"), tx.normalize_pdf_column(F.col("t")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(tx.trim(t), tx.normalize_html(t), tx.normalize_pdf(t)) for t in texts]


def test_merge_and_pack_rows(spark):
    rng = random.Random(3)
    rows = [(g, i, "x" * rng.choice((1, 50, 199, 200, 500))) for g in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "g int, i int, t string")
    merged = {(r.g, r.chunk_id): r.chunk_text for r in chunking.merge_short_rows(df, ["g"], "i", "t").collect()}
    packed = {(r.g, r.chunk_id): r.chunk_text for r in packing.pack_rows(df, ["g"], "i", "t", 600).collect()}
    for g in range(4):
        own = [t for a, _, t in rows if a == g]
        assert [merged[g, k] for k in range(len([1 for a, _ in merged if a == g]))] == chunking.merge_short(own, 200)
        assert [packed[g, k] for k in range(len([1 for a, _ in packed if a == g]))] == chunking.pack_lines(own, 600)


def test_chunks_column(spark):
    df = spark.createDataFrame([(1, "あ" * 900 + "。" + "い" * 1900), (2, None), (3, " ")], "k int, t string")
    got = chunking.explode_chunks(df, chunking.chunks_of(F.col("t")), ["k"]).orderBy("k", "chunk_id").collect()
    assert [(r.k, r.chunk_id, len(r.chunk_text)) for r in got] == [(1, 0, 1053), (1, 1, 1000), (1, 2, 1000), (1, 3, 200)]


def test_a_batch_is_cut_and_embedded_in_parts(spark):
    most = chunking.PART

    def few(texts):
        if len(texts) > most:
            raise MemoryError(len(texts))
        return np.ones((len(texts), 2))

    n = 2 * most + 7
    df = spark.range(n, numPartitions=1).select("id", F.concat(F.lit("text "), "id").alias("t"))
    got = df.select("id", embedding.embed(F.col("t"), few).alias("v"), chunking.chunks_of(F.col("t")).alias("c")).collect()
    assert len(got) == n and all(r.v == [1.0, 1.0] and r.c == [f"text {r.id}"] for r in got)
