"""Secret scans through a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean trigram query is derived: an OR of
conjunctions of trigrams that any match must hold.  Postings (trigram, document)
are built over the folded texts for the trigrams of the rules asked for: an index
serves one rule set and those whose trigrams it holds, not any other.  A
conjunction's postings are intersected by one aggregation; the candidates are
joined back and verified by the rule itself.  Rules without mandatory trigrams
scan every text.  Trigrams are of ASCII characters alone, which fold one by one;
any other character ends a literal.

Spans are found without a UDF: splitting a text by a rule's matches gives the
gaps, extracting gives the matches, and their running lengths give the offsets
(code points, end exclusive).  The lengths are summed in blocks of BLOCK matches, so
that no step copies more than a block and the list of blocks.

Base kinds: assign, access, hex; further kinds follow them and only add spans.

Edge cases: null and empty texts have no spans; matches that fail a length rule
are dropped (the text they covered is not searched again); repeated rows are each
reported; an empty table gives no rows; only the named input columns are read;
a rule that matches the empty string is an error.
A document is named in the index by a 64-bit hash of id and text; a collision
makes a candidate more, never a span.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiori.llm.common import scratch, written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Group and least length that a match must have.
    group: int = 0
    least: int = 1


#: The patterns of secrets, base kinds first.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("git_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
)
RULES = BASE + MORE

#: A class of more characters, or a product of more alternatives, ends a literal.
CLASS_SIZE, ALTERNATIVES = 5, 64
#: Matches that are summed before their block is appended to the others.
BLOCK = 64
#: Ends a literal segment.
BREAK = "\0"


def _folded(point: int) -> str:
    """A literal character as it stands in the folded text."""
    return chr(point).lower() if 0 < point < 128 else BREAK


def _literals(tokens) -> list[str] | None:
    """Strings of literal segments (parted by BREAK), one of which every match contains in order; None: too many."""
    out = [""]
    for op, arg in tokens:
        if op is rc.LITERAL:
            part = [_folded(arg)]
        elif op is rc.IN and all(o is rc.LITERAL for o, _ in arg) and len(arg) <= CLASS_SIZE:
            part = [_folded(a) for _, a in arg]
        elif op is rc.SUBPATTERN:
            part = _literals(arg[-1]) or [BREAK]
        elif op is rc.BRANCH:
            part = [x for branch in arg[1] for x in (_literals(branch) or [BREAK])]
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
            low, high, inner = arg
            inner = _literals(inner) or [BREAK]
            if (low, high) == (0, 1) and len(inner) == 1:
                part = ["", *inner]
            elif low == high == 1:
                part = inner
            elif low and len(inner) ** 2 <= ALTERNATIVES:
                # First and last repetition, each any alternative; of a single one the first is the last.
                part = [f"{x}{BREAK}{y}" for x in inner for y in inner]
            else:
                part = [BREAK]
        else:
            part = [BREAK]
        out = list(dict.fromkeys(a + b for a in out for b in part))
        if len(out) > ALTERNATIVES:
            return None
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of folded trigrams that every match holds; None if some match may hold none."""
    parsed = _parser.parse(pattern)
    if parsed.getwidth()[0] == 0:
        raise ValueError(f"rule matches the empty string: {pattern}")
    found = _literals(parsed)
    if found is None:
        return None
    out = {frozenset(s[i : i + 3] for s in x.split(BREAK) for i in range(len(s) - 2)) for x in found}
    if frozenset() in out:
        return None
    return sorted((x for x in out if not any(y < x for y in out)), key=sorted)


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def build_index(df: DataFrame, trigrams: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (gram, key) of the given trigrams over folded texts, written to the shared folder."""
    folded = df.select(_key(id_col, text_col).alias("key"), F.lower(F.col(text_col)).alias("_low"))
    here = F.array_compact(F.array(*(F.when(F.contains("_low", F.lit(g)), F.lit(i)) for i, g in enumerate(trigrams))))
    return written(folded.select(F.explode(here).alias("gram"), "key"), "secret-postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...], trigrams: list[str]) -> DataFrame:
    """(key, rules): documents in which some conjunction of a rule's query is complete."""
    spark: SparkSession = index.sparkSession
    rows, full, number = [], [], 0
    for r, rule in enumerate(rules):
        for grams in trigram_query(rule.pattern) or ():
            for bit, g in enumerate(sorted(grams)):
                rows.append((number, r, trigrams.index(g), 1 << bit))
            full.append((1 << len(grams)) - 1)
            number += 1
    # As many rows as the rules have trigrams: the bound of the broadcast.
    values = ", ".join(f"({c}, {r}, {g}, {b}L)" for c, r, g, b in rows)
    asked = spark.sql(f"SELECT * FROM VALUES {values} AS asked(conjunction, rule, gram, bit)")
    whole = F.element_at(F.array(*(F.lit(x) for x in full)), F.col("conjunction") + 1)
    met = index.join(F.broadcast(asked), "gram").groupBy("conjunction", "rule", "key").agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == whole)
    return written(met.groupBy("key").agg(F.collect_set("rule").alias("rules")), "secret-candidates")


EMPTY = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of a rule's matches in order, those that fail its length dropped."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    sized = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.length(g).alias("gap"), F.length(h).alias("size"), (F.length(F.regexp_extract(h, rule.pattern, rule.group)) >= rule.least).alias("ok")))
    blocks = _let(sized, lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / BLOCK).cast("int")), lambda k: F.slice(s, k * BLOCK + 1, F.lit(BLOCK))))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + x["size"]
        one = F.struct(a.alias("start"), F.lit(number).alias("kind"), b.alias("end"))
        return F.struct(b.alias("at"), F.when(x["ok"], F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, xs: Column) -> Column:
        own = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(EMPTY).alias("out")), step)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.array_append(acc["out"], o["out"]).alias("out")))

    none = F.array().cast(EMPTY)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{EMPTY}>").alias("out"))
    return F.when(text.rlike(rule.pattern), F.flatten(F.aggregate(blocks, start, block)["out"])).otherwise(none)


def full_scan(text: Column, rule: Rule, number: int) -> Column:
    """As :func:`spans`, for a rule that is one class repeated: only runs of the least length are looked at."""
    own = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    if not own or rule.group:
        return spans(text, rule, number)
    # A maximal run of the class is one match either way, so the length may as well stand in the pattern.
    return spans(text, Rule(rule.kind, f"{own[1]}{{{rule.least},}}"), number)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``found``: every span of every rule, by start, then kind in the rules' order."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({g for q in queries if q for c in q for g in c})
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = []
    if trigrams:
        with scratch() as keep:
            told = keep(candidates(build_index(docs, trigrams), rules, trigrams))
        docs = docs.withColumn("key", _key("doc_id", "text")).join(told, "key", "left")
    for i, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        if query is None:
            probe = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
            maybe = F.col("text").rlike(f"{probe[1]}{{{rule.least}}}" if probe and not rule.group else rule.pattern)
            parts.append(F.when(maybe, full_scan(F.col("text"), rule, i)).otherwise(F.array().cast(EMPTY)))
        else:
            parts.append(F.when(F.array_contains("rules", i), spans(F.col("text"), rule, i)).otherwise(F.array().cast(EMPTY)))
    return docs.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))


def told(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the checksum of their spans, and all spans."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(i: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == i)).cast("long")

    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("found")).alias("spans")
    )
