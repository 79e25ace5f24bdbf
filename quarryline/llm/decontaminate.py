"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is K consecutive words of an item; a shorter item with any word is one
window.  A document holds a window only if it holds all its words, so of the words
ordered by rarity over all documents a prefix of one, the rarest, must be shared:
the prefix of a containment of 1 is no longer.  Documents are joined to windows on
that word alone.  The word's place in the window fixes where the window would start
(positional bound) and its length must fit into what the document has (length
bound); then the words are compared exactly.

Documents are read twice, whatever the benchmark's size: once to count words, once to
find hits.  Windows of at most BLOCK_WORDS words, counted before they are gathered,
travel to the executors as one index, and need no shuffle.  More are joined: a bitmap
of fixed size says which words may be the rarest of a window, and only the places of
these, each with the K - 1 words on both sides, are shuffled by word.  A word of very
many places is split by Spark.

Words: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.
Defined results: null and empty texts have no words and hit nothing; texts of any
length are read whole; an item without words, or with a null id, never occurs.  Equal
windows of several items count for each of them; of a window's words that are equally
rare the least in byte order is taken.  Repeated documents are judged each; an empty
table of documents gives an empty result, an empty benchmark hits nothing.  Columns
other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 10
#: Words of items whose index, of some 500 bytes a word, is sent to every executor at most.
BLOCK_WORDS = 200_000
#: Bits of the bitmap of windows' rarest words, as Spark's bitmap functions lay it out.
BITS, BITS_EACH = 1 << 25, 1 << 15

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TABLE).split() if text else []


def windows_of(words: list[bytes], k: int = K) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


def _rarity(docs: DataFrame, vocabulary: frozenset[bytes]) -> Counter:
    """How often each word of the vocabulary occurs in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text in common.binary(batch.column(0)):
                n.update(filter(vocabulary.__contains__, words_of(text)))
        yield pa.record_batch([pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])

    got = common.map_arrow(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return Counter({bytes(r["word"]): r["n"] for r in got.toLocalIterator()})  # at most the block's words


def _index(items: list[tuple[str, bytes]], seen: Counter, k: int) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
    """Rarest word of each window -> its place in the window, the window's words, the items that have it."""
    owners: dict[tuple[bytes, ...], dict[str, None]] = {}
    for item, text in items:
        for window in windows_of(words_of(text), k):
            owners.setdefault(window, {})[item] = None
    index: dict[bytes, list] = {}
    for window, have in owners.items():
        rarest = min(window, key=lambda w: (seen[w], w))
        index.setdefault(rarest, []).append((window.index(rarest), list(window), list(have)))
    return index


def _hits(words: list[bytes], index: dict) -> tuple[list[tuple[int, int]], set[str]]:
    spans, items = [], set()
    n = len(words)
    for at in [i for i, w in enumerate(words) if w in index]:
        for offset, window, have in index[words[at]]:
            start, end = at - offset, at - offset + len(window)
            if start >= 0 and end <= n and words[start:end] == window:
                spans.append((start, end))
                items.update(have)
    return spans, items


def _digest(spans: list[tuple[int, int]], items: set[str]) -> tuple[int, int, str]:
    n, last = 0, 0
    for start, end in sorted(spans):
        n += max(0, end - max(start, last))
        last = max(last, end)
    return n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def decontaminate(docs: DataFrame, items: DataFrame, k: int = K, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and copy (a hash of the text) for every document."""
    texts = common.id_and_text(docs, id_col, text_col).withColumn("copy", F.xxhash64("text"))
    asked = items.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("item_text"))

    def finished(keys: pa.Array, copies: pa.Array, rows: list[tuple[int, list, set]]) -> pa.RecordBatch:
        made = [(n, *_digest(spans, found)) for n, spans, found in rows]
        n, hit, many, digest = zip(*made, strict=True) if made else ((), (), (), ())
        return pa.record_batch([keys, copies, pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(many, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], ["doc_id", "copy", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    schema = "doc_id long, copy long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    # A word takes two bytes at least, with what parts it from the next.
    if (asked.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) <= 2 * block_words:
        rows = [(r["item"], r["item_text"].encode()) for r in asked.collect()]
        vocabulary = frozenset(w for _, text in rows for w in words_of(text))
        shared = texts.sparkSession.sparkContext.broadcast(_index(rows, _rarity(texts, vocabulary) if vocabulary else Counter(), k))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common.no_worker_state()
            index = shared.value
            for batch in batches:
                rows = []
                for text in common.binary(batch.column(1)):
                    words = words_of(text)
                    rows.append((len(words), *_hits(words, index)))
                yield finished(batch.column(0), batch.column(2), rows)

        return common.map_arrow(texts, whole, schema)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, [(s["start"], s["end"]) for s in spans or []], set(found or [])) for n, spans, found in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield finished(batch.column(0), batch.column(1), rows)

    return common.map_arrow(_joined_hits(texts, asked, k), last, schema)


def _windows(asked: DataFrame, k: int) -> DataFrame:
    """item, win (a window's words, parted by blanks) for every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, win = [], []
            for own, text in zip(batch.column(0).to_pylist(), common.binary(batch.column(1)), strict=True):
                found = [b" ".join(w) for w in windows_of(words_of(text), k)]
                item += [own] * len(found)
                win += found
            yield pa.record_batch([pa.array(item, pa.string()), pa.array(win, pa.binary())], ["item", "win"])

    return common.map_arrow(asked, run, "item string, win binary").distinct()


class _Anchors(dict):
    """Whether a word may be the rarest of a window, remembered for some words."""

    def __init__(self, bits: bytes):
        super().__init__()
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 500_000:
            self.clear()
        b = zlib.crc32(word) % BITS
        self[word] = found = bool(self.bits[b >> 3] >> (b & 7) & 1)
        return found


def _word_counts(texts: DataFrame) -> DataFrame:
    """word, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(n), pa.binary()), pa.array(n.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in common.binary(batch.column(0)):
                n.update(words_of(text))
                if len(n) > 200_000:  # bounds the worker's memory; Spark sums on
                    yield out()
                    n.clear()
        yield out()

    return common.map_arrow(texts.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _joined_hits(texts: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """doc_id, copy, n, spans and items of every document, from joins whose sides may have any size."""
    owners = common.stash(_windows(asked, k), "window-owners")
    wins = owners.select("win").distinct().select("win", F.split(F.col("win").cast("string"), " ").alias("ws"))
    each = wins.select("win", F.size("ws").alias("size"), F.posexplode("ws").alias("place", "w")).select("win", "size", "place", F.col("w").cast("binary").alias("word"))
    counted = each.join(_word_counts(texts), "word", "left")
    # A window with a word that no document has occurs nowhere.
    rarest = counted.groupBy("win").agg(F.count("n").alias("known"), F.first("size").alias("size"), F.min(F.struct("n", "word", "place")).alias("r")).where("known = size")
    anchors = common.stash(rarest.select("win", "size", F.col("r.word").alias("word"), F.col("r.place").alias("place")), "window-anchors")
    bit = F.pmod(F.crc32("word"), F.lit(BITS)).cast("long") + 1  # Spark's bitmaps count from one
    parts = anchors.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    bits = bytearray(BITS // 8)
    for r in parts.collect():  # BITS / BITS_EACH rows at most, of 4 KB
        at = (r["bucket"] - 1) * (BITS_EACH // 8)
        bits[at : at + BITS_EACH // 8] = r["bits"]
    shared = texts.sparkSession.sparkContext.broadcast(bytes(bits))
    place = pa.struct([("word", pa.binary()), ("at", pa.int64()), ("low", pa.int64()), ("around", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor = _Anchors(shared.value)
        for batch in batches:
            n, places = [], []
            for text in common.binary(batch.column(1)):
                words = words_of(text)
                n.append(len(words))
                places.append([{"word": w, "at": i, "low": max(0, i - k + 1), "around": b" ".join(words[max(0, i - k + 1) : i + k])} for i, w in enumerate(words) if anchor[w]])
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(places, pa.list_(place))], ["doc_id", "copy", "n", "places"])

    found = common.stash(common.map_arrow(texts, run, "doc_id long, copy long, n long, places array<struct<word: binary, at: long, low: long, around: binary>>"), "anchor-places")
    there = found.select("doc_id", "copy", F.inline("places")).join(anchors, "word").withColumn("start", F.col("at") - F.col("place"))
    same = F.array_join(F.slice(F.split(F.col("around").cast("string"), " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("size")), " ").cast("binary") == F.col("win")
    hits = common.stash(there.where(F.when(F.col("start") >= F.col("low"), same).otherwise(False)).select("doc_id", "copy", "start", (F.col("start") + F.col("size")).alias("end"), "win").distinct(), "window-hits")
    spans = hits.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    items = hits.select("doc_id", "copy", "win").distinct().join(owners, "win").groupBy("doc_id", "copy").agg(F.collect_set("item").alias("items"))
    out = found.select("doc_id", "copy", "n")
    for more, name in ((spans, "spans"), (items, "items")):
        more = more.select(F.col("doc_id").alias("hit_id"), F.col("copy").alias("hit_copy"), name)
        out = out.join(more, F.expr("doc_id <=> hit_id AND copy <=> hit_copy"), "left").drop("hit_id", "hit_copy")
    return out.select("doc_id", "copy", "n", "spans", "items")


def op9(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("copy")


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, w[i : i + least(10, len(w)) - 1] AS v FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)
), place AS (
  SELECT rk, w, n, unnest(range(1, len(w) - n + 2)) AS i, n FROM doc, (SELECT DISTINCT len(v) AS n FROM win) WHERE len(w) >= n
), hit AS (
  SELECT p.rk, p.i, p.n, x.item_id FROM (SELECT rk, i, n, w[i : i + n - 1] AS v FROM place) p JOIN win x ON p.v = x.v
), cover AS (
  SELECT rk, count(DISTINCT k) AS n_hit FROM (SELECT rk, unnest(range(i, i + n)) AS k FROM hit) GROUP BY rk
), found AS (
  SELECT rk, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rk, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rk
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (rk) LEFT JOIN found USING (rk)
"""
