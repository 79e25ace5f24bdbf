"""Quality rules kept in a bitmask ledger, built from DataFrame functions only.

`ledger` evaluates every rule once, and `stored_ledger` writes the outcome: a row
holds the measurements and `failed`, a long whose bit i says that rule i failed.  A policy is a version, a mask of the
rules it enforces and how many of them may fail; `apply_policy` needs only the
stored bits, and `ablation` says, for every rule of a policy, how many more
documents would be kept without it, from counts of the distinct bit patterns.

Everything about a document is computed inside its own row, so no text is
shuffled and a group of any size does no harm.

Defined results: a null text has no words and no lines; texts of any length are read
whole.  A measurement that equals its limit passes.  A text without words
has zero in every measurement and fails ``few_words``.  Repeated rows are judged
alike, each on its own.  An empty table gives an empty ledger.  Columns other
than the id and the text are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, id_and_text, stash

#: Words in a window of the repetition rule.
WINDOW = 8

#: The rules in the order of their bits.  Each is true where it fails.  Never reorder: stored ledgers depend on it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "many_exclamations": "2 * n_exclamations > n_words",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
}


@dataclass(frozen=True)
class Policy:
    """Keeps a document if at most `allowed` of the rules fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


#: The rules every version enforces, and the versions so far.
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "many_symbols", "duplicate_lines", "many_exclamations")), Policy("v2", tuple(RULES)))}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by windows whose hash occurs twice or more.  hashes: of the windows, by first word."""

    def count(at: Column) -> Column:
        return F.coalesce(
            F.aggregate(
                at,
                F.struct(F.lit(-width).alias("last"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(width))).alias("n")),
                lambda acc: acc["n"],
            ),
            F.lit(0).cast("long"),
        )

    def repeated(ordered: Column) -> Column:
        held = F.filter(
            ordered,
            lambda v, i: (i > 0) & (F.get(ordered, i - 1)["h"] == v["h"]) | F.coalesce(F.get(ordered, i + 1)["h"] == v["h"], F.lit(False)),
        )
        return count(F.sort_array(F.transform(held, lambda v: v["p"])))

    def look(h: Column) -> Column:
        pairs = F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("p")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), repeated))

    return _let(hashes, look)


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a long for every measurement the rules use.

    Windows are told apart by a 64-bit hash of their words, within one document only.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, f"[{BLANK_CLASS}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda v: v.rlike(f"[^{BLANK_CLASS}]"))

    def of_words(w: Column) -> Column:
        n = F.size(w)
        windows = F.when(
            n >= WINDOW,
            _let(F.transform(w, lambda v: F.xxhash64(v)), lambda h: F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))),
        )
        return F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n > WINDOW, _covered(windows, WINDOW)).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        )

    def of_lines(v: Column) -> Column:
        return F.struct(F.size(v).cast("long").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"))

    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.inline(F.array(_let(words, of_words))).alias("n_words", "word_chars", "n_repeat_words"),
        F.octet_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.octet_length(F.regexp_replace(text, r"[^!]+", "")).cast("long").alias("n_exclamations"),
        _let(lines, of_lines).alias("of_lines"),
    ).select("doc_id", "n_words", "word_chars", "n_symbols", "of_lines.n_dup_lines", "n_repeat_words", "of_lines.n_lines", "n_exclamations")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and `failed`, a bit for each of RULES."""
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measurements(docs, id_col, text_col).withColumn("failed", failed)


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger written as a table, so that every policy and ablation after it reads bits and no text."""
    return stash(ledger(docs, id_col, text_col), "ledger")


def fails(policy: Policy) -> Column:
    """Whether a ledger row fails the policy, from its bits alone."""
    return F.bit_count(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))) > policy.allowed


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """Adds `kept` and the policy's version to ledger rows."""
    return rows.withColumn("kept", ~fails(policy)).withColumn("policy", F.lit(policy.version))


def ablation(rows: DataFrame, policy: Policy) -> DataFrame:
    """For every rule of the policy: documents it fails, and documents kept only if it is dropped.

    Counts distinct bit patterns first (at most two to the number of rules), so little is shuffled.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(Policy("", (r,)).mask).cast("long").alias("bit")) for r in policy.rules))
    has, left = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.bit_count(F.col("bits").bitwiseXOR(F.col("bit")))
    return (
        patterns.select("bits", "n", F.inline(rules))
        .groupBy("rule")
        .agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(has & (F.bit_count("bits") > policy.allowed) & (left <= policy.allowed), F.col("n")).otherwise(0)).alias("n_only_this"))
    )


def op5(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, the four base measurements, base_failed, kept and the ledger's bits for every document."""
    rows = apply_policy(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v1"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), "kept", "failed")


def op5_ablation(spark, sf_dir: str) -> DataFrame:
    """Rule, n_failed and n_only_this of policy v1 over every document."""
    return ablation(stored_ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), POLICIES["v1"])


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rk, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda v: regexp_matches(v, '[^\x20\x09-\x0D]')) AS v FROM documents
), win AS (
  SELECT rk, i, w[i : i + 7] AS x FROM (SELECT rk, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)
), cover AS (
  SELECT rk, count(DISTINCT k) AS n FROM (SELECT rk, unnest(range(i, i + 8)) AS k FROM (SELECT rk, i, count(*) OVER (PARTITION BY rk, x) AS c FROM win) WHERE c > 1) GROUP BY rk
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(v) - len(list_distinct(v)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(v) AS n_lines, length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations
  FROM doc LEFT JOIN cover USING (rk)
), f AS (
  SELECT *, CAST((CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END) + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END) + (CASE WHEN 2 * n_exclamations > n_words THEN 16 ELSE 0 END) + (CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 64 ELSE 0 END) AS BIGINT) AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed & 31 = 0 AS kept, failed FROM f
"""

SQL_ABLATION = f"""
WITH l AS ({SQL}), r AS (SELECT unnest(['few_words', 'repeated_words', 'many_symbols', 'duplicate_lines', 'many_exclamations']) AS rule, unnest([1, 2, 4, 8, 16]) AS bit)
SELECT rule, CAST(count(*) FILTER (failed & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (failed & 31 = bit) AS BIGINT) AS n_only_this FROM l, r GROUP BY rule
"""
