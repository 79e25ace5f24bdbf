"""Passages that recur across documents, found by automata of repeated phrases.

A window is WINDOW consecutive words.  Every word of a document that is covered
by a window which also starts in a document with a smaller id is removed;
windows are judged on the input, not on what is left.

1. Every window holds eight runs of GRAM words; the one with the least hash is
   its sample.  Equal windows have equal samples, so a window can recur only if
   its sample recurs.  About two runs in nine are samples of some window; these
   are counted with map-side sums, and those of a single document are dropped.
2. The stretches of text around recurring samples, as long as the windows that
   have the sample, are cut out and dealt by sample.  A sample with more than HOT
   stretches is cut into single windows, each dealt by its own words; equal ones
   of these are merged, on the map side first, before they are dealt, so that no
   sample or passage brings more than HOT rows to a shard.
3. Shards of whole samples, SHARD stretches or a little more each, confirm which
   windows recur, compile them into an Aho-Corasick automaton over word numbers,
   and stream the shard's stretches through it, which gives every occurrence and
   the first document that has it.
4. Occurrences with a smaller first document go back to their documents by join,
   whose large partitions Spark splits.

Words are parted by blanks and compared unchanged.  Defined results: null and
empty texts have no words.  Documents with the same id do not remove each
other's words.  A document with a null id neither loses words nor removes any.
Documents shorter than a window lose nothing; very long ones are read whole.  Of
equal ids none is smaller, so ties remove nothing.  An empty table gives an empty
result.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import collections
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import WordHashes, mix, runs

WINDOW, GRAM = 13, 6
#: Stretches in a shard, and stretches of one sample beyond which it is cut into windows.
SHARD, HOT = 8_000, 1_000


def sampled(words: list[bytes], hashes: WordHashes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sample, first window and number of windows for each stretch of windows with the same sample."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, np.uint64),) * 3
    least, width = runs(hashes.of(words), gram), 1
    while width < window - gram + 1:  # sliding minimum by doubling
        step = min(width, window - gram + 1 - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    return least[starts], starts, np.diff(np.append(starts, n))


def _samples(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """sample, d, h, at, n for every document long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.worker_state("word-hashes", WordHashes)
        for batch in batches:
            parts, owners = [], []
            for i, text in enumerate(common.binary(batch.column(2))):
                found = sampled(text.split(), hashes, window, gram)
                if len(found[0]):
                    parts.append(found)
                    owners.append(np.full(len(found[0]), i))
            if parts:
                sample, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                rows = pa.array(np.concatenate(owners))
                yield pa.record_batch([pa.array(sample.view(np.int64)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["sample", "d", "h", "at", "n"])

    return common.map_arrow(keyed, run, "sample long, d long, h long, at int, n int")


def _stretches(cuts: DataFrame, window: int) -> DataFrame:
    """key, d, h, at, stretch, hot from rows (d, h, text, cuts: array of sample, at, n, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, d, h, at, stretch, hot = [], [], [], [], [], []
            for own, copy, text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.binary(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                for c in found:
                    first, n = c["at"], c["n"]
                    if c["hot"]:
                        for i in range(first, first + n):
                            part = b" ".join(words[i : i + window])
                            key.append(xxhash.xxh64_intdigest(part) - (1 << 63))
                            at.append(i)
                            stretch.append(part)
                            hot.append(True)
                    else:
                        key.append(c["sample"])
                        at.append(first)
                        stretch.append(b" ".join(words[first : first + n + window - 1]))
                        hot.append(False)
                d += [own] * (len(key) - len(d))
                h += [copy] * (len(key) - len(h))
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(d, pa.int64()), pa.array(h, pa.int64()), pa.array(at, pa.int32()), pa.array(stretch, pa.binary()), pa.array(hot, pa.bool_())], ["key", "d", "h", "at", "stretch", "hot"])

    return common.map_arrow(cuts, run, "key long, d long, h long, at int, stretch binary, hot boolean")


def locate(stretches: list[bytes], low: np.ndarray, high: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard's stretches, with the smallest and largest id that has each: (stretch, place, first id) of every recurring window.

    Windows whose first document is no smaller than the stretch's largest are left out: they remove nothing.  Each word is
    numbered and written as one character, and the whole shard is one string in which a character of its own parts stretches.
    """
    import ahocorasick

    none = (np.empty(0, np.int64),) * 3
    flat = (b" \n ".join(stretches) + b" \n").split(b" ")  # a newline is no word and ends a stretch
    numbers: dict[bytes, int] = collections.defaultdict(itertools.count().__next__)
    codes = np.fromiter(map(numbers.__getitem__, flat), np.uint32, len(flat))
    size = np.diff(np.flatnonzero(codes == numbers[b"\n"]), prepend=-1)
    owner = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    place = np.arange(len(codes)) - begin[owner]
    whole = np.flatnonzero(place <= size[owner] - 1 - window)
    if not len(whole):
        return none
    hashes = runs(mix(codes.astype(np.uint64)), window)[whole]
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    least, most = np.minimum.reduceat(low[owner[whole[order]]], first), np.maximum.reduceat(high[owner[whole[order]]], first)
    confirmed = np.flatnonzero(least < most)
    if not len(confirmed):
        return none
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    text = (codes + np.uint32(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
    for i, at in zip(confirmed.tolist(), whole[order[first[confirmed]]].tolist(), strict=True):
        automaton.add_word(text[at : at + window], i)
    automaton.make_automaton()
    # Stretches without a confirmed window, which hold no occurrence, are not streamed.
    recurs = np.zeros(len(size), bool)
    recurs[owner[whole[order[np.repeat(least < most, np.diff(np.append(first, len(order))))]]]] = True
    streamed = np.flatnonzero(recurs[owner])
    text = (codes[streamed] + np.uint32(0x10000)).astype("<u4").tobytes().decode("utf-32-le")
    found = np.fromiter(itertools.chain.from_iterable(automaton.iter(text)), np.int64).reshape(-1, 2)
    start = streamed[found[:, 0] - window + 1]
    kept = least[found[:, 1]] < high[owner[start]]
    start, ids = start[kept], least[found[kept, 1]]
    return owner[start], place[start], ids


def _located(dealt: DataFrame, window: int) -> DataFrame:
    """key, s (hash of the stretch), hits from rows (key, s, stretch, low, high) sorted by key."""
    kind = pa.struct([("i", pa.int32()), ("first", pa.int64())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            if count >= SHARD:
                whole = pa.Table.from_batches(held).combine_chunks()
                key = whole.column(0).to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last key may go on
                if last:
                    yield whole.slice(0, last)
                held, count = whole.slice(last).to_batches(), whole.num_rows - last
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches):
            key, s, low, high = (shard.column(c).to_numpy() for c in ("key", "s", "low", "high"))
            order = np.lexsort((s, key))  # equal stretches of a key are one
            first = np.flatnonzero(np.concatenate(([True], (np.diff(key[order]) != 0) | (np.diff(s[order]) != 0))))
            rows = order[first]
            text = shard.column("stretch").take(pa.array(rows)).to_pylist()
            which, place, ids = locate(text, np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first), window)
            if len(which):
                starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
                hits = pa.ListArray.from_arrays(pa.array(np.append(starts, len(which)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(place.astype(np.int32)), pa.array(ids)], fields=list(kind)))
                yield pa.record_batch([pa.array(key[rows][which[starts]]), pa.array(s[rows][which[starts]]), hits], ["key", "s", "hits"])

    return common.map_arrow(dealt.select("key", "s", "stretch", "low", "high"), run, "key long, s long, hits array<struct<i: int, first: long>>")


def removed_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """d, h (hash of the text) and starts, the first words of the windows to remove, for documents that have any."""
    keyed = common.id_and_text(docs, id_col, text_col).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    samples = common.stash(_samples(keyed, window, gram), "samples", "none")
    # Counted with map-side sums, so that a sample of a third of all documents is one row a task; the join back is split by Spark where it is uneven.
    often = samples.groupBy("sample").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("many")).where("low < high").select("sample", "many")
    # Each sample is once in the hashed side, so that no task's table depends on how often a sample recurs.
    recurring = samples.join(common.stash(often, "recurring").hint("shuffle_hash"), "sample")
    cuts = recurring.groupBy("d", "h").agg(F.collect_set(F.struct("sample", "at", "n", (F.col("many") > HOT).alias("hot"))).alias("cuts")).withColumnsRenamed({"d": "cd", "h": "ch"})
    cuts = common.stash(cuts, "recurring-samples")
    common.unstash(samples)
    held = keyed.join(cuts, (F.col("d") == F.col("cd")) & (F.col("h") == F.col("ch")))
    places = common.stash(_stretches(held.select("d", "h", "text", "cuts"), window), "stretches")
    few = places.where("NOT hot").select("key", "stretch", F.col("d").alias("low"), F.col("d").alias("high"))
    many = places.where("hot").groupBy("key", "stretch").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    dealt = few.unionByName(many).select("key", F.xxhash64("stretch").alias("s"), "stretch", "low", "high").repartition(F.col("key")).sortWithinPartitions("key")
    hits = common.stash(_located(dealt, window), "window-hits")
    theirs = places.select("key", F.xxhash64("stretch").alias("s"), "d", "h", "at").join(hits, ["key", "s"])
    smaller = F.transform(F.filter("hits", lambda x: x["first"] < F.col("d")), lambda x: x["i"] + F.col("at"))
    return theirs.select("d", "h", smaller.alias("starts")).where(F.size("starts") > 0).groupBy("d", "h").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) for every document."""
    gone = common.stash(removed_windows(docs, id_col, text_col, window, gram), "removed-windows").withColumnsRenamed({"d": "gd", "h": "gh"})
    texts = common.id_and_text(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    joined = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("gd")) & (F.col("h") == F.col("gh")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_, removed, kept = [], [], []
            for text, starts in zip(common.binary(batch.column(1)), batch.column(2), strict=True):
                words = text.split() if text else []
                n = len(words)
                if starts.is_valid and len(starts):
                    first = np.asarray(starts.values)
                    edge = np.bincount(first, minlength=n + 1) - np.bincount(first + window, minlength=n + 1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0)]
                words_.append(n)
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([batch.column(0), pa.array(words_, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return common.map_arrow(joined.select("doc_id", "text", "starts"), run, "doc_id long, n_words long, n_removed long, kept string")


def op6(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rk, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT rk, doc_id, i, w[i : i + 12] AS v FROM (SELECT rk, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)
), gone AS (
  SELECT DISTINCT rk, unnest(range(i, i + 13)) AS k FROM (SELECT rk, doc_id, i, min(doc_id) OVER (PARTITION BY v) AS f FROM win) WHERE f < doc_id
), word AS (
  SELECT rk, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM doc WHERE len(w) > 0
), kept AS (
  SELECT rk, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS t FROM word ANTI JOIN gone USING (rk, k) GROUP BY rk
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rk)
"""
