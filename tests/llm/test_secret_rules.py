"""Trigram queries of arbitrary rules lose no match; many hits in one text stay cheap."""

import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shiori.llm import secrets


def wrap(inner):
    group = inner.map(lambda x: f"(?:{x})")
    return st.one_of(
        st.tuples(inner, inner).map("".join),
        st.tuples(inner, inner).map(lambda x: f"(?:{x[0]}|{x[1]})"),
        st.tuples(inner, inner, inner).map(lambda x: f"({'|'.join(x)})"),
        st.tuples(group, st.sampled_from(["?", "+", "*", "{2}", "{1,3}", "{0,2}", "{3,}", "+?", "{1}"])).map("".join),
    )


ATOMS = st.sampled_from(["a", "bc", "def", "[ab]", "[xyz]", "[a-f]", "[^q]", r"\d", "K", "-", "é", "[éa]", r"\.", "key", "="])
PATTERNS = st.tuples(st.sampled_from(["", "(?i)"]), st.recursive(ATOMS, wrap, max_leaves=8)).map("".join)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_every_match_is_a_candidate(data):
    pattern = data.draw(PATTERNS)
    try:
        query = secrets.trigram_query(pattern)
    except ValueError:
        assert re.fullmatch(pattern, "")
        return
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=True))
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert query is None or any(all(g in folded for g in c) for c in query), (pattern, text, query)


@pytest.mark.parametrize("pattern,text", [("xy[ab]{2}zw", "xyabzw"), ("xy[ab]{2}zw", "xyaazw"), ("q(?:abc|def)+z", "qabcdefz"), ("k(?:ab|c)+end", "kcabcend"), ("(?i)TOK[EN]{3}ID", "xtokENeid"), ("ΑΣΣ[0-9]{4}", "ΑΣΣ1234")])
def test_repeats_are_found(spark, pattern, text):
    df = spark.createDataFrame([(1, text), (2, "nothing"), (3, None)], "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.scan(df, (secrets.Rule("own", pattern),)).collect()}
    assert found == {1: [(m.start(), 0, m.end()) for m in re.finditer(pattern, text)], 2: [], 3: []}


def test_many_hits_in_one_text(spark):
    n = 60_000
    one = "token=abcdef12 "
    df = spark.createDataFrame([(1, one * n), (2, one * 63), (3, one * 64), (4, one * 65), (5, one * 129)], "doc_id long, text string")
    rules = secrets.BASE[:1]
    secrets.scan(df.filter("doc_id > 1"), rules).collect()
    began = time.time()
    got = {r.doc_id: [tuple(x) for x in r.found] for r in secrets.scan(df, rules).collect()}
    assert time.time() - began < 20
    for i, k in ((1, n), (2, 63), (3, 64), (4, 65), (5, 129)):
        assert got[i] == [(len(one) * j, 0, len(one) * j + 14) for j in range(k)]


def test_a_rule_for_the_empty_string_is_an_error():
    with pytest.raises(ValueError):
        secrets.trigram_query("a*")
