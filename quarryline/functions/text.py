"""Scalar text and scoring functions as column expressions, and their driver-side twins for query strings."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_WIDTH = 256
#: Words of a query that count.
QUERY_WORDS = 10
#: Words that are operators in a full-text query.
OPERATORS = frozenset({"AND", "OR", "NOT", "NEAR"})
#: Scripts written without spaces, as code point ranges.
CJK_RANGES = ((0x3040, 0x309F), (0x30A0, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF), (0xAC00, 0xD7AF))
#: Fixed value: a traditional answer is taken to cost so many times a pointer answer.
TRADITIONAL_FACTOR = 15

_CJK_ANY = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"
_CJK = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES)
_TOKEN = rf"[{_CJK}]|[\p{{L}}\p{{N}}&&[^{_CJK}]]+"
_QUERY_TOKEN = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES) + r"]|\w")


def is_cjk(ch: str) -> bool:
    return any(a <= ord(ch) <= b for a, b in CJK_RANGES)


def query_words(query: str) -> list[str]:
    """Words of a query: letters, digits and underscores; each CJK character alone; without operators; the first ten."""
    words, run = [], ""
    for ch in query + " ":
        alone = is_cjk(ch)
        if not alone and (ch.isalnum() or ch == "_"):
            run += ch
            continue
        if run and run.upper() not in OPERATORS:
            words.append(run)
        run = ""
        if alone:
            words.append(ch)
    return words[:QUERY_WORDS]


def query_words_of(column: Column) -> Column:
    """The column form of query_words."""
    words = F.regexp_extract_all(column, F.lit(rf"[{_CJK}]|[\p{{L}}\p{{N}}_&&[^{_CJK}]]+"), F.lit(0))
    return F.slice(F.filter(words, lambda w: ~F.upper(w).isin(*sorted(OPERATORS))), 1, QUERY_WORDS)


@cache
def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and their base letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code).lower()
        base = unicodedata.normalize("NFD", ch)[0]
        if len(ch) == 1 and base != ch:
            pairs[ch] = base
    return "".join(pairs), "".join(pairs.values())


def fold(text: str) -> str:
    return text.lower().translate(str.maketrans(*_accents()))


def folded(column: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(column), *_accents())


def fts_tokens(column: Column) -> Column:
    """Tokens of the full-text index: folded runs of letters and digits, each CJK character alone.

    Plain ASCII text and text without CJK characters are parted by simpler patterns with the same result, and only tokens
    that need it are folded: a letter with a mark and its base are both letters, so folding parts nothing.
    """
    low = F.lower(F.coalesce(column, F.lit("")))
    plain = F.split(low, "[^a-z0-9]+")
    simple, full = F.split(low, r"[^\p{L}\p{N}]+"), F.regexp_extract_all(low, F.lit(_TOKEN), F.lit(0))
    marked = F.transform(F.when(low.rlike(_CJK_ANY), full).otherwise(simple), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, *_accents())))
    return F.array_remove(F.when(F.octet_length(low) == F.length(low), plain).otherwise(marked), "")


def fts_phrase(word: str) -> list[str]:
    """A query word as the index sees it: one or more tokens (an underscore parts them)."""
    out, run = [], ""
    for ch in fold(word) + " ":
        alone = is_cjk(ch)
        if not alone and ch.isalnum():
            run += ch
            continue
        if run:
            out.append(run)
        run = ""
        if alone:
            out.append(ch)
    return out


def literal_score(query: Column, name: Column) -> Column:
    """1 if equal, 0.9 at either end, else 0.5 and a share of 0.4 by length in bytes."""
    return (
        F.when(name == query, 1.0)
        .when(name.startswith(query) | name.endswith(query), 0.9)
        .otherwise(0.5 + 0.4 * F.octet_length(query) / F.greatest(F.octet_length(name), F.lit(1)))
    )


def bm25_normal(score: Column) -> Column:
    """Raw BM25 to a score below one; values near zero give one half."""
    size = F.abs(score)
    return F.when(size < 0.001, 0.5).otherwise(F.least(1 - 1 / (1 + size), F.lit(1.0)))


def vector_tokens(column: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores of two bytes or more."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"[^\p{L}\p{N}_]+"), F.lower), lambda t: F.octet_length(t) > 1)


def buckets(tokens: Column) -> Column:
    """0 to 255 for each token: the first byte of its md5.  Places of two hex digits are far cheaper than conv."""
    digit = lambda h, i: F.instr(F.lit("0123456789abcdef"), F.substring(h, i, 1)) - 1
    return F.transform(F.transform(tokens, F.md5), lambda h: (16 * digit(h, 1) + digit(h, 2)).cast("int"))


def query_vector(query: str) -> list[float] | None:
    """The query's unit vector; None without tokens."""
    tokens = [t.lower() for t in re.split(r"[^\w]+", query) if len(t.lower().encode()) > 1]
    if not tokens:
        return None
    counts = np.zeros(VECTOR_WIDTH)
    for t in tokens:
        counts[hashlib.md5(t.encode()).digest()[0]] += 1
    return [float(v) for v in (counts / np.sqrt(counts @ counts)).astype(np.float32)]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hash_vector(tokens: Column) -> Column:
    """Sparse unit vector of a token array: (b, v) for each bucket it has.

    Buckets are sorted, and a run of equal ones is as long as it is to the start of the next.
    """

    def scaled(counted: Column) -> Column:
        norm = F.sqrt(F.aggregate(counted, F.lit(0.0), lambda acc, c: acc + c["n"] * c["n"]))
        return _let(norm, lambda z: F.transform(counted, lambda c: F.struct(c["b"].alias("b"), (c["n"] / z).cast("float").alias("v"))))

    def counted(ordered: Column, starts: Column) -> Column:
        return F.transform(starts, lambda p, k: F.struct(F.get(ordered, p).alias("b"), (F.coalesce(F.get(starts, k + 1), F.size(ordered)) - p).cast("double").alias("n")))

    def starts_of(ordered: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))

    def vector(ordered: Column) -> Column:
        return _let(starts_of(ordered), lambda starts: _let(counted(ordered, starts), scaled))

    # Null without tokens: an empty array would make a sequence that runs backwards.
    return _let(F.sort_array(buckets(tokens)), lambda ordered: F.when(F.size(ordered) > 0, vector(ordered)))


def cosine_with(vector: Column, query: list[float]) -> Column:
    """Dot product of a sparse unit vector with the query's, in double precision."""
    dense = F.array(*(F.lit(v) for v in query))
    return F.aggregate(vector, F.lit(0.0), lambda acc, c: acc + c["v"].cast("double") * F.element_at(dense, c["b"] + 1))


def count_words(column: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(column, F.lit("")), r"\p{IsWhite_Space}+"), lambda w: w != ""))


def token_estimate(column: Column) -> Column:
    """Four tokens for three words, rounded up."""
    return F.floor((4 * count_words(column) + 2) / 3).cast("long")


def line_array(column: Column) -> Column:
    r"""Lines without their ends (\n or \r\n); a final line end makes no further line."""
    lines = F.split(column, "\r?\n")
    return F.when(column == "", F.array().cast("array<string>")).when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def count_lines(column: Column) -> Column:
    return F.size(line_array(column)).cast("long")


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end, counted from one and clamped to what is there; end null or 0: to the last."""
    lines = line_array(content)
    n = F.size(lines)
    low = F.least(F.greatest(F.coalesce(start, F.lit(1)), F.lit(1)), n + 1).cast("int")
    high = F.when(F.coalesce(end, F.lit(0)) <= 0, n).otherwise(F.least(end, n)).cast("int")
    return F.array_join(F.slice(lines, low, F.greatest(high - low + 1, F.lit(0))), "\n")


def percent(column: Column) -> Column:
    return F.format_string("%.1f%%", column)


def parse_since(text: str) -> int | None:
    """Seconds of Nh or Nd; None for `all` and for anything else, which means all time."""
    m = re.fullmatch(r"(\d+)([hd])", text)
    return int(m[1]) * (3600 if m[2] == "h" else 86400) if m else None
