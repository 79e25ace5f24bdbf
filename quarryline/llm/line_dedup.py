"""Near-duplicate lines removed by an exact set-similarity join, built from DataFrame functions only.

A line is the set of its blank-parted words.  It is removed if an earlier line of
the input, by (id, text hash, line number), has a Jaccard similarity of 0.8 or
more with it.  Lines without a word stay.

Lines of equal sets are grouped first, by two 64-bit hashes of the set; only the
earliest of each set goes on, as any earlier similar line of that set implies
that one.  Copies, however many, thus collapse in the map side of one
aggregation, and no later step sees them.

The join orders a line's words from rare to common and needs one shared word
among the first n - ceil(0.8 n) + 1 (prefix filter), lengths within 0.8 of each
other, enough words left behind the shared one (positional filter) and few enough
words that only one of them has: a 64-bit parity sketch of a set's words, or one of
128 bits for long lines, differs in at most that many bits from another's (bitmap filter).  All are necessary
conditions, so nothing is lost; what passes is verified on the words themselves.
Lines of fewer than four words match only equal sets (three of four is 0.75), so
they have no prefix; one of four words also matches five that hold them.

Any total order of words is exact; rarity only makes it fast.  Counts over all
lines are kept in 2^19 hash buckets, a size that does not depend on the data;
the array of their levels is a one-row table that plans read as a scalar subquery.

Texts are parted once, into a table of each line's word hashes, from which words are
counted and prefixes made; only lines that have a candidate are read as text again.

The join is a semi-join first: it finds the lines that have any partner, whatever their
number, and both its sides are one shuffle, whose large partitions Spark splits.  Only
these lines go on.  Groups of near copies are then settled in linear work: a line is
compared with the earliest line of each word of its prefix, and what that leaves once
more with the earliest of those left.  What is left then is compared with all partners.

Defined results: a null text has no lines and stays null; an empty one has one
line without words.  A line of any length is one set.  Rows that repeat an id and
text are at the same place and do not remove each other's lines.  A null id is
earlier than any other.  Ties do not occur: places are ordered completely.  An
empty table gives an empty result.  Other columns are carried along; one that has
the name of a column added here gives way to it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, id_and_text, quoted, stash, unstash

#: Buckets of the word counts.
BUCKETS = 1 << 19
#: Words beyond which a line has a second sketch, of the words that one bit of the hash chooses; the first without it is that of the others.
LONG = 96
#: What two lines must meet; a similarity of 0.8 means |common| >= 4/9 of the summed sizes, and |only in one| <= 1/9 of them.
_NEAR = (
    "5 * {a}n >= 4 * {b}n AND 5 * {b}n >= 4 * {a}n AND 9 * bit_count({a}sig ^ {b}sig) <= {a}n + {b}n"
    f" AND (least({{a}}n, {{b}}n) <= {LONG} OR 9 * (bit_count({{a}}sig2 ^ {{b}}sig2) + bit_count({{a}}sig ^ {{b}}sig ^ {{a}}sig2 ^ {{b}}sig2)) <= {{a}}n + {{b}}n)"
)
_POSITIONAL = "9 * least({a}n - {a}pos, {b}n - {b}pos) >= 4 * ({a}n + {b}n)"
_PLACE = ("d", "h", "l")
#: Pairs of places, of some 50 bytes each, up to which their places are broadcast.
SENT = 400_000
#: Level from which a word is common (of some 255 lines), and how many of them in a prefix are looked up in pairs; any numbers give the same result.
COMMON, MOST = 24, 8
#: Setting of the bytes up to which Spark takes a shuffled partition for small.
_HASHED = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"


def _bound(value: Column, name: str) -> Column:
    """value as a generated column, so that it is computed once however often it is used."""
    return F.explode(F.array(value)).alias(name)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a lambda variable is bound to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    """The words of a text, with empty ones where blanks meet."""
    for blank in "\t\n\x0b\x0c\r":  # far cheaper than translate, which looks up every character
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, " ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")


def _bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _hashed(keyed: DataFrame) -> DataFrame:
    """d, h, l (line number) and k (hashes of its words, sorted) of every line: the one pass that parts all texts."""
    lines = keyed.select("d", "h", F.posexplode(F.split("text", "\n")).alias("l", "line"))
    hashes = F.array_remove(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return lines.select(*_PLACE, F.sort_array(hashes).alias("k"))


def _levels(hashed: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS levels: how many lines have words of each bucket, on a log scale, in a long's first byte."""
    counts = hashed.select(F.explode("k").alias("v")).groupBy(_bucket(F.col("v")).alias("b")).agg(F.count("*").alias("c"))
    every = hashed.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("c"))
    level = F.shiftleft(F.least(F.lit(126), (3 * F.log2(F.sum("c") + 1)).cast("int")).cast("long"), 56).alias("v")
    each = counts.unionByName(every).groupBy("b").agg(level)
    return each.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda e: e["v"]).alias("levels"))


def _sets(hashed: DataFrame, levels: DataFrame) -> DataFrame:
    """d, h, l (line number), s (hash of the set), n (words), sig and sig2 (parity sketches) and pre (prefix, rare words first, and one word more) of the earliest line of each word set."""
    # Named first, as a lambda may not hold a subquery; it is used once, so the optimizer puts it back in its place.
    named = hashed.withColumn("levels", levels.scalar())
    # Bound to a variable, as a subquery is slow where a lambda evaluates it for each word.  Never null, and typed so: Spark then sorts plain longs.
    rank = lambda levels: lambda v: F.coalesce(F.get(levels, _bucket(v)).bitwiseOR(F.shiftrightunsigned(v, 8)), F.lit(0).cast("long"))
    order = _let(F.col("levels"), lambda levels: F.transform("k", rank(levels)))
    prefix = F.when(F.size("k") >= 4, F.slice(F.sort_array(order), F.lit(1), F.expr("size(k) - (4 * size(k) + 4) DIV 5 + 2"))).otherwise(F.array().cast("array<bigint>")).alias("pre")
    sig = F.expr("aggregate(k, 0L, (acc, v) -> acc ^ shiftleft(1L, cast(v & 63 AS int)))").alias("sig")
    sig2 = F.expr(f"CASE WHEN size(k) > {LONG} THEN aggregate(k, 0L, (acc, v) -> acc ^ shiftleft(shiftright(v, 6) & 1L, cast(v & 63 AS int))) ELSE 0L END").alias("sig2")
    keyed_sets = named.select(F.xxhash64("k").alias("s"), F.xxhash64(F.lit(1), "k").alias("s2"), F.struct(*_PLACE, F.size("k").alias("n"), sig, sig2, prefix).alias("p"))
    return keyed_sets.groupBy("s", "s2").agg(F.min("p").alias("p")).select("s", "p.*")


def _on(a: str, b: str) -> Column:
    """Whether two places, of columns that start with a and with b, are the same."""
    return F.expr(f"{a}d <=> {b}d AND {a}h = {b}h AND {a}l = {b}l")


def _places(df: DataFrame, start: str = "", to: str = "") -> DataFrame:
    return df.select(*(F.col(f"{start}{c}").alias(f"{to}{c}") for c in _PLACE))


def _prefixes(sets: DataFrame, *names: str) -> DataFrame:
    """A row for each word of a set's prefix: tok and its place in the prefix, pos."""
    return sets.where(F.size("pre") > 0).select(*names, "n", "sig", "sig2", F.posexplode(F.expr("slice(pre, 1, size(pre) - 1)")).alias("pos", "tok"))


def _with_partner(sets: DataFrame) -> DataFrame:
    """The sets of lines that share a word of both prefixes with another line and pass every filter with it.

    Where the first word that two lines share is a common one, they share a second one, as far as one word behind their prefixes.  Common words are thus
    looked up with each that follows; but by themselves where one of the lines has too many of them.
    """
    cut = F.lit(COMMON << 56)
    many = F.coalesce(F.expr(f"get(pre, size(pre) - {MOST + 2})") >= cut, F.lit(False)).alias("many")
    words = sets.where(F.size("pre") > 0).select("s", "n", "sig", "sig2", "pre", many, F.posexplode("pre").alias("pos", "tok")).where("pos < size(pre) - 1")
    common = F.col("tok") >= cut
    second = F.explode(F.when(common, F.expr("slice(pre, pos + 2, size(pre))")).otherwise(F.array(F.lit(None).cast("long")))).alias("second")
    rows = words.where(~common | ~F.col("many")).select("s", "n", "sig", "sig2", "pos", "tok", second)
    keys = rows.withColumn("tok", F.when(F.col("second").isNull(), F.col("tok")).otherwise(F.xxhash64("tok", "second"))).drop("second")
    alone = words.where(common).drop("pre")

    def partnered(one: DataFrame, other: DataFrame) -> DataFrame:
        near = f"a.tok = b.tok AND a.s <> b.s AND {_NEAR.format(a='a.', b='b.')} AND {_POSITIONAL.format(a='a.', b='b.')}"
        return one.alias("a").join(other.alias("b"), F.expr(near), "left_semi").select("s")

    every = partnered(keys, keys).unionByName(partnered(alone, alone.where("many"))).unionByName(partnered(alone.where("many"), alone))
    found = stash(every.distinct(), "lines-with-partner")
    return sets.join(found, "s", "left_semi")


def _pairs_with_first(sets: DataFrame) -> DataFrame:
    """Candidate pairs (ad, ah, al), (d, h, l) of lines with the earliest line of a word of their prefix; one for each line."""
    rows = _prefixes(sets, *_PLACE)
    firsts = rows.groupBy("tok").agg(F.min(F.struct(*_PLACE, "n", "sig", "sig2", "pos")).alias("f"))
    near = f"struct(f.d, f.h, f.l) < struct(d, h, l) AND {_NEAR.format(a='f.', b='')} AND {_POSITIONAL.format(a='f.', b='')}"
    return rows.join(firsts, "tok").where(near).select(*(F.col(f"f.{c}").alias(f"a{c}") for c in _PLACE), *_PLACE).dropDuplicates(list(_PLACE))


def _pairs(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """Candidate pairs of the lines that are not settled with all earlier lines."""
    a = _prefixes(sets, *_PLACE).alias("a")
    b = _prefixes(sets.join(_places(settled, to="g"), _on("", "g"), "left_anti"), *_PLACE).alias("b")
    near = f"a.tok = b.tok AND struct(a.d, a.h, a.l) < struct(b.d, b.h, b.l) AND {_NEAR.format(a='a.', b='b.')} AND {_POSITIONAL.format(a='a.', b='b.')}"
    return a.join(b, F.expr(near)).select(*(F.col(f"a.{c}").alias(f"a{c}") for c in _PLACE), *(F.col(f"b.{c}").alias(c) for c in _PLACE)).distinct()


def _verified(keyed: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of a table of pairs of places (ad, ah, al) and (d, h, l) the places (d, h, l) whose line truly is that similar to the other."""
    places = _places(pairs).unionByName(_places(pairs, "a")).distinct()
    wanted = places.groupBy(F.col("d").alias("wd"), F.col("h").alias("wh")).agg(F.collect_list("l").alias("ls"))
    if pairs.count() <= SENT:  # so few are sent to the texts, instead of shuffling these
        wanted = F.broadcast(wanted)
    # A text's lines are parted once, and each wanted one goes on alone.
    line_of = lambda lines: F.transform("ls", lambda l: F.struct(l.alias("l"), F.get(lines, l).alias("line")))
    held = keyed.join(wanted, F.expr("d <=> wd AND h = wh")).select("d", "h", F.inline(_let(F.split("text", "\n"), line_of)))
    texts = stash(held.select(*_PLACE, F.array_remove(F.array_distinct(_words(F.col("line"))), "").alias("w")).dropDuplicates(list(_PLACE)), "line-words")
    one, other = (texts.select(*(F.col(c).alias(f"{to}{c}") for c in _PLACE), F.col("w").alias(f"{to}w")) for to in "xy")
    both = pairs.join(one, _on("a", "x")).join(other, _on("", "y"))
    out = stash(_places(both.where(9 * F.size(F.array_intersect("xw", "yw")) >= 4 * (F.size("xw") + F.size("yw")))).distinct(), "similar-lines")
    unstash(texts)
    return out


def _removed(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """The places, earliest of their sets, whose line has an earlier similar one."""

    def verified(pairs: DataFrame) -> DataFrame:
        held = stash(pairs, "line-pairs")
        out = _verified(keyed, held)
        unstash(held)
        return out

    some = stash(_with_partner(sets), "partnered-sets")
    first = verified(_pairs_with_first(some))
    second = verified(_pairs_with_first(some.join(_places(first, to="g"), _on("", "g"), "left_anti")))
    settled = stash(first.unionByName(second), "settled-lines")
    later = verified(_pairs(some, settled))
    out = stash(settled.unionByName(later), "removed-lines")
    unstash(some, first, second, settled, later)
    return out


@contextlib.contextmanager
def _hash_joins(spark) -> Iterator[None]:
    """Meanwhile a join whose shuffled partitions all turn out to be small hashes them instead of sorting both sides; any other one sorts, and may spill."""
    before = spark.conf.get(_HASHED, None)
    spark.conf.set(_HASHED, "64m")
    try:
        yield
    finally:
        spark.conf.set(_HASHED, before) if before is not None else spark.conf.unset(_HASHED)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, h and the numbers of the lines with a word that stay, for every place (id, text hash) with any."""
    keyed = _keyed(id_and_text(docs, id_col, text_col))
    with _hash_joins(docs.sparkSession):
        hashed = stash(_hashed(keyed), "line-hashes")
        levels = stash(_levels(hashed), "line-levels")
        sets = stash(_sets(hashed.where(F.size("k") > 0), levels), "line-sets")
        unstash(hashed, levels)
        gone = _removed(keyed, sets)
        stay = _places(sets).join(_places(gone, to="g"), _on("", "g"), "left_anti")
        out = stash(stay.groupBy("d", "h").agg(F.collect_list("l").alias("stay")), "lines-kept")
    unstash(sets, gone)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the text's removed lines gone, and the number of its lines and of removed ones under the names of `out`; other columns stay as they are."""
    stay = kept_lines(docs, id_col, text_col).withColumnsRenamed({"d": "sd", "h": "sh"})
    # The input's other columns travel in one, so that their names meet no other.
    rows = docs.select(F.struct(*(quoted(c) for c in docs.columns if c != text_col)).alias("row"), quoted(id_col).cast("long").alias("d"), quoted(text_col).cast("string").alias("text"))
    joined = rows.withColumn("h", F.xxhash64("text")).join(stay, F.expr("d <=> sd AND h = sh"), "left")
    text = F.col("text")

    def cut(lines: Column) -> Column:
        with_words = F.array_compact(F.transform(lines, lambda v, i: F.when(v.rlike(f"[^{BLANK_CLASS}]"), i)))
        return F.struct(lines.alias("lines"), F.array_except(with_words, F.coalesce("stay", F.array().cast("array<int>"))).alias("gone"))

    def rest(c: Column) -> Column:
        numbers = F.array_except(F.sequence(F.lit(0), F.size(c["lines"]) - 1), c["gone"])
        kept = F.when(F.size(c["gone"]) == 0, text).otherwise(F.array_join(F.transform(numbers, lambda i: F.get(c["lines"], i)), "\n"))
        return F.struct(kept.alias("text"), F.size(c["lines"]).cast("long").alias("n"), F.size(c["gone"]).cast("long").alias("r"))

    done = joined.select("row", F.when(text.isNotNull(), _let(_let(F.split(text, "\n"), cut), rest)).alias("c"))
    added = {name.lower() for name in out}
    carried = [F.col("c.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in added]
    zero = F.lit(0).cast("long")
    return done.select(*carried, F.coalesce("c.n", zero).alias(out[0]), F.coalesce("c.r", zero).alias(out[1]))


def op10(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH line AS (
  SELECT doc_id, l, list_distinct(regexp_extract_all(v, '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents)
), full_line AS (
  SELECT row_number() OVER (ORDER BY doc_id, l) AS k, doc_id, l, w, len(w) AS n FROM line WHERE len(w) > 0
), df AS (
  SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM full_line) GROUP BY t
), ranked AS (
  SELECT k, n, x.t, row_number() OVER (PARTITION BY k ORDER BY c, x.t) AS pos FROM (SELECT k, n, unnest(w) AS t FROM full_line) x JOIN df ON x.t = df.t
), prefix AS (
  SELECT k, n, t, pos FROM ranked WHERE pos <= n - (4 * n + 4) // 5 + 1
), pair AS (
  SELECT DISTINCT a.k AS ka, b.k AS kb FROM prefix a JOIN prefix b ON a.t = b.t AND a.k < b.k AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
), gone AS (
  SELECT DISTINCT kb FROM pair JOIN full_line a ON a.k = ka JOIN full_line b ON b.k = kb WHERE 9 * len(list_intersect(a.w, b.w)) >= 4 * (a.n + b.n)
), kept AS (
  SELECT doc_id, string_agg(v, chr(10) ORDER BY l) AS t
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS v, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM documents) s
  WHERE NOT EXISTS (SELECT 1 FROM gone JOIN full_line f ON f.k = gone.kb WHERE f.doc_id = s.doc_id AND f.l = s.l) GROUP BY doc_id
), lost AS (
  SELECT doc_id, count(*) AS c FROM gone JOIN full_line f ON f.k = gone.kb GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN lost ON lost.doc_id = d.doc_id
"""
