"""Near-duplicate documents by a chosen-path similarity join.

A document is the set of its SHINGLE-word shingles.  Documents with equal sets
form a class; classes are linked if the Jaccard similarity of their sets is 0.8
or more.  Linked classes are grouped into connected components.

Chosen paths: from the root, a set of n shingles picks each of its shingles with
probability SPREAD / n, by a hash of the path so far and the shingle, and each
pick leads to a child bucket.  Two similar sets share most shingles and so, with
known probability, a pick.  All sets take one step, in so many runs that the
expected recall of a pair at the threshold reaches RECALL.  Buckets of at most SMALL
sets are compared by brute force.  So are larger ones of which most are like one
member by sketch: groups of near copies, which no step would part.  The members of
other large buckets share a passage, but are not similar; they start anew together,
with up to DEPTH steps and the more runs that this needs for the same recall, and take
each further step only in buckets that are still large.  The steps thus follow the
buckets met and not the size of the table, and what DEPTH steps leave is compared in
blocks, so nothing is capped.

A bucket's members are compared by sketches first: 64 bits or more, about one for
each shingle, that hold the parities of the shingles' hashes.  Sets that are similar
differ in (a + b) / 9 shingles at most, and sketches in no more bits than that, so
this loses nothing.  Only members with such a partner go on, each to be compared
exactly, on the 64-bit hashes of its text's shingles.  Texts travel to the cells of
those buckets alone; a cell is bounded by sets and by shingles.

Buckets with the same members are compared once, before sketches and before texts.
A pair that meets in several buckets counts in the least of them, so links are
counted without listing pairs: a bucket yields at most one edge and one count a
member.  A group of m near copies with different texts has m squared links to count,
which are counted in matrices of cells spread over tasks; equal sets are one class from the start.

Words are parted by blanks and compared unchanged.  A text with one to four words
has one shingle, all its words; a text of any length is one set.  Defined results: a
null, empty or wordless text, and a document with a null id, is linked with nothing
and is its own group.  Repeated rows are equal sets.  Of documents with equal sets
the one with the least (id, text hash) stands for them; ties beyond that are the same
row.  An empty table gives an empty result.  Columns other than the id and the text
are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import WordHashes, mix, runs

SHINGLE = 5
SPREAD, RECALL, DEPTH = 1.25, 0.9998, 6
#: Sets of a bucket that is not split further, as comparing their sketches takes a second or so; sets and shingles of a block of a larger one.
SMALL, BLOCK, BLOCK_SHINGLES = 16_384, 4096, 2_000_000
#: Sets, of some 50 bytes each, up to which their places are broadcast to the texts.
SENT = 400_000


def runs_for(depth: int, recall: float = RECALL) -> int:
    """Repetitions until a pair at the threshold, which shares SPREAD * 0.8 picks a step, meets at the last step with that recall."""
    meets = 1.0
    for _ in range(depth):
        meets = 1 - math.exp(-SPREAD * 0.8 * meets)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(runs(hashes.of(words), min(k, len(words))))


def roots(first: int, n: int) -> np.ndarray:
    """Where runs first, first + 1, ... start."""
    return mix(np.arange(first, first + n, dtype=np.uint64))


def children(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The buckets that a set enters from those at `at`."""
    limit = np.uint64(min(2**64 - 1, int(SPREAD / len(tokens) * 2**64)))
    made, step = [at[:0]], max(1, 4_000_000 // len(tokens))
    for low in range(0, len(at), step):
        drawn = mix(at[low : low + step, None] ^ tokens[None, :])
        node, token = np.nonzero(drawn < limit)
        made.append(mix(drawn[node, token] + np.uint64(1)) ^ at[low + node])
    return np.concatenate(made)


def parities(tokens: np.ndarray) -> np.ndarray:
    """A sketch: a bit for each hash bucket, set if an odd number of shingles falls there; 64 bits, or the power of two that reaches their number."""
    bits = 1 << max(6, (len(tokens) - 1).bit_length())
    return np.packbits(np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1, bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch that the same set has in fewer bytes."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def _sketches(keyed: DataFrame, n_runs: int) -> DataFrame:
    """d, h, set (a digest of the shingles, null without any), n, bits (sketch) and paths, the buckets of the first step."""
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, start = common.worker_state("word-hashes", WordHashes), roots(1, n_runs)
        for batch in batches:
            digest, size, bits, paths = [], [], [], []
            for text in common.binary(batch.column(2)):
                tokens = shingle_set(text.split() if text else [], hashes)
                digest.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                size.append(len(tokens))
                bits.append(parities(tokens).tobytes() if len(tokens) else None)
                paths.append(children(tokens, start).view(np.int64) if len(tokens) else [])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(paths, longs)], ["d", "h", "set", "n", "bits", "paths"])

    return common.map_arrow(keyed, run, "d long, h long, set binary, n int, bits binary, paths array<long>")


def _sizes(members: DataFrame) -> DataFrame:
    """Of buckets (path, set, n) with two members or more: many, weight (shingles) and a signature of who they are."""
    return members.groupBy("path").agg(F.count("*").alias("many"), F.sum("n").alias("weight"), F.bit_xor(F.xxhash64("set")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set")).alias("y")).where("many > 1")


def _once(members: DataFrame) -> DataFrame:
    """Of a table (path, set, n) the buckets with two members or more, equal ones once, with many and weight."""
    sizes = _sizes(members)
    # Buckets with one signature are many if they are those of a group of copies, so the least of them is found on the map side first.
    chosen = sizes.groupBy("many", "x", "y").agg(F.min("path").alias("path"), F.first("weight").alias("weight")).select("path", "many", "weight")
    return members.join(chosen, "path").select("path", "set", "n", "many", "weight")


def _next_step(members: DataFrame, with_text: Callable) -> DataFrame:
    """path, set, n: what members (path, set) of buckets enter by another step."""
    paths = members.groupBy("set").agg(F.collect_list("path").alias("paths"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.worker_state("word-hashes", WordHashes)
        for batch in batches:
            path, which, size = [np.empty(0, np.uint64)], [], []
            for i, (at, text) in enumerate(zip(batch.column(1).to_pylist(), common.binary(batch.column(2)), strict=True)):
                tokens = shingle_set(text.split(), hashes)
                made = children(tokens, np.array(at, np.int64).view(np.uint64))
                path.append(made)
                which += [i] * len(made)
                size += [len(tokens)] * len(made)
            yield pa.record_batch([pa.array(np.concatenate(path).view(np.int64)), batch.column(0).take(pa.array(which, pa.int32())), pa.array(size, pa.int32())], ["path", "set", "n"])

    return common.map_arrow(with_text(paths).select("set", "paths", "text"), run, "path long, set binary, n int")


def _of_copies(big: DataFrame, classes: DataFrame) -> DataFrame:
    """The paths of buckets (path, set, n) most of whose members are like one of three of them by sketch."""
    chosen = big.groupBy("path").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.min(F.struct(F.xxhash64("set"), "set"))["set"].alias("c"))
    bits = classes.select("set", "bits")
    pivots = chosen.select("path", F.explode(F.array_distinct(F.array("a", "b", "c"))).alias("set")).join(classes.select("set", "bits", "n"), "set").select("path", F.col("set").alias("pivot"), F.col("bits").alias("pivot_bits"), F.col("n").alias("pivot_n"))
    rows = big.select("path", "set", "n").join(pivots, "path").join(bits, "set").select("path", "pivot", "n", "bits", "pivot_n", "pivot_bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, list[int]] = {}
            for path, pivot, m, x, k, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count = seen.setdefault((path, pivot), [0, 0])
                count[0] += len(alike([x, y], np.array([m, k], np.int64), np.array([0]), np.array([1]))) > 0
                count[1] += 1
            path, pivot = zip(*seen, strict=True) if seen else ((), ())
            near, many = zip(*seen.values(), strict=True) if seen else ((), ())
            yield pa.record_batch([pa.array(path, pa.int64()), pa.array(pivot, pa.binary()), pa.array(near, pa.int64()), pa.array(many, pa.int64())], ["path", "pivot", "near", "many"])

    judged = common.map_arrow(rows, run, "path long, pivot binary, near long, many long")
    return judged.groupBy("path", "pivot").agg((2 * F.sum("near") > F.sum("many")).alias("copies")).where("copies").select("path").distinct()


def _buckets(classes: DataFrame, with_text: Callable, small: int, recall: float) -> DataFrame:
    """path, set, n, many, weight: the buckets to compare, equal ones once."""
    tables, done = [], []

    def held(df: DataFrame, name: str) -> DataFrame:
        tables.append(common.stash(df, name))
        return tables[-1]

    def part(members: DataFrame, last: bool = False) -> DataFrame | None:
        """Put aside the buckets to compare, and return the members of the others, if there are any."""
        sizes = held(_sizes(members), "bucket-sizes")
        own = held(members.join(sizes.select("path", "many"), "path").select("path", "set", "n", "many"), "buckets")
        if last or own.where(F.col("many") > small).isEmpty():
            done.append(own)
            return None
        copies = held(_of_copies(own.where(F.col("many") > small), classes), "buckets-of-copies")
        done.extend([own.where(F.col("many") <= small), own.where(F.col("many") > small).join(copies, "path", "left_semi")])
        large = own.where(F.col("many") > small).join(copies, "path", "left_anti")
        return None if large.isEmpty() else large

    n_runs = runs_for(1, recall)
    large = part(classes.select("set", "n", F.explode("paths").alias("path")))
    if large is not None:
        start = roots(n_runs + 1, runs_for(DEPTH, recall)).view(np.int64).tolist()
        large = large.select("set").distinct().select("set", F.explode(F.array(*map(F.lit, start))).alias("path"))
        for step in range(DEPTH):
            large = part(held(_next_step(large, with_text), "step"), step == DEPTH - 1)
            if large is None:
                break
    out = common.stash(_once(functools.reduce(DataFrame.unionByName, [d.select("path", "set", "n") for d in done])), "members")
    common.unstash(*tables)
    return out


def _in_cells(members: DataFrame, block: int, carried: list[str]) -> DataFrame:
    """A row for each cell of a bucket that a member is in: path, low, high, block and what is carried, sorted by cell.

    A bucket is dealt into blocks by the members' hashes, and every two blocks are a cell; a bucket of one block is one cell.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("many") / F.lit(block)), F.ceil(F.col("weight") / F.lit(BLOCK_SHINGLES))).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("low"), F.greatest(F.col("block"), o).alias("high")))
    dealt = members.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("path", "set"), F.col("parts")).cast("int")).select("path", F.inline(cells), "block", *carried)
    return dealt.repartition(F.col("path"), F.col("low"), F.col("high")).sortWithinPartitions("path", "low", "high")


def _rows_of_cells(batches: Iterator[pa.RecordBatch], lists: Callable[[pa.RecordBatch], list[list]]) -> Iterator[tuple[tuple, list]]:
    """(path, low, high) and the cell's rows (block, ...)."""
    now, rows = None, []
    for batch in batches:
        for path, low, high, *row in zip(*lists(batch), strict=True):
            if (path, low, high) != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = (path, low, high), []
            rows.append(row)
    if len(rows) > 1:
        yield now, rows


def alike(sketches: list[bytes], size: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Places of the sets of `one` and `other` whose sketches and sizes allow that some set of the other side, not itself, is similar."""
    held = [np.frombuffer(s, np.uint8) for s in sketches]
    found = np.zeros(len(sketches), bool)
    wide_one, wide_other = (np.array([len(held[i]) for i in rows]) for rows in (one, other))
    for w in np.unique(wide_one):
        for v in np.unique(wide_other):
            if max(w, v) > 2 * min(w, v):  # sizes are too far apart
                continue
            a, b = one[wide_one == w], other[wide_other == v]
            x, y = (np.stack([folded(held[i], min(w, v)) for i in rows]).view(np.uint64) for rows in (a, b))
            step = max(1, 4_000_000 // y.size)
            for at in range(0, len(a), step):
                rows = a[at : at + step]
                apart = np.bitwise_count(x[at : at + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                total = size[rows][:, None] + size[b][None, :]
                near = (9 * apart <= total) & (9 * np.minimum(size[rows][:, None], size[b][None, :]) >= 4 * total) & (rows[:, None] != b[None, :])
                found[rows] |= near.any(1)
                found[b] |= near.any(0)
    return np.flatnonzero(found)


def _alike(members: DataFrame) -> DataFrame:
    """path, set, n of the members that have a partner by sketch, from rows (cell; block, set, n, bits) sorted by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (path, low, high), rows in _rows_of_cells(batches, lambda b: [b.column(i).to_pylist() for i in range(7)]):
            block, size = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], np.int64)
            one, other = (np.flatnonzero(block == x) for x in (low, high))
            if not len(one) or not len(other):
                continue
            kept = alike([r[3] for r in rows], size, one, other)
            if len(kept):
                yield pa.record_batch([pa.array([path] * len(kept), pa.int64()), pa.array([rows[i][1] for i in kept], pa.binary()), pa.array(size[kept].astype(np.int32))], ["path", "set", "n"])

    return common.map_arrow(members, run, "path long, set binary, n int")


def similar(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each set of `one` and of `other`, not itself, whether their similarity is 0.8 or more, from the counts of shared shingles."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    shared = np.zeros((len(one), len(other)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    top, wide = int(column[-1]) + 1 if len(column) else 0, max(64, 4_000_000 // len(sets))
    for low in range(0, top, wide):
        a, b = np.searchsorted(column, (low, low + wide))
        dense = np.zeros((len(sets), min(wide, top - low)), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        shared += dense[one] @ dense[other].T
    return (9 * shared >= 4 * (size[one][:, None] + size[other][None, :])) & (one[:, None] != other[None, :])


def groups(near: np.ndarray, one: np.ndarray, other: np.ndarray) -> Iterator[np.ndarray]:
    """The connected sets, two or more together, of a matrix of `one` by `other`."""
    left = near.any(1)
    while left.any():
        rows = np.zeros(len(one), bool)
        rows[left.argmax()] = True
        while True:
            columns = near[rows].any(0) | np.isin(other, one[rows])
            more = near[:, columns].any(1) | np.isin(one, other[columns]) | rows
            if (more == rows).all():
                break
            rows = more
        left &= ~rows
        yield np.union1d(one[rows], other[columns])


def owned(paths: list[frozenset[int]], path: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Of each set of `one` and of `other`, whether they share no lesser path, so that this bucket has to compare them."""
    times = Counter(p for held in paths for p in held if p < path)
    column = {p: k for k, p in enumerate(p for p, n in times.items() if n > 1)}
    has = np.zeros((len(paths), len(column)), np.float32)
    for i, held in enumerate(paths):
        for p in held:
            if p in column:
                has[i, column[p]] = 1
    return ((has[one] @ has[other].T) == 0) & (one[:, None] != other[None, :])


def _compared(members: DataFrame) -> DataFrame:
    """set, links, other from rows (cell: path and two blocks; block, set, copies, paths, text) sorted by cell.

    `links` is how many documents a class is linked with by pairs counted here; `other` is the class of its group, in this cell, with the least digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.worker_state("word-hashes", WordHashes)
        for (path, low, high), rows in _rows_of_cells(batches, lambda b: [*(b.column(i).to_pylist() for i in range(7)), common.binary(b.column(7))]):
            block = np.array([r[0] for r in rows])
            one, other = (np.flatnonzero(block == x) for x in (low, high))
            paths = [frozenset(r[3]) for r in rows]
            ours = owned(paths, path, one, other)
            one, other, ours = one[ours.any(1)], other[ours.any(0)], ours[ours.any(1)][:, ours.any(0)]
            if not ours.size:
                continue
            if low == high:
                rest = 2 * ours.sum(1) < len(other)  # if only a few sets have partners here, these are compared with all
                if rest.any() and not ours[rest][:, rest].any():
                    one = one[~rest]
            ours = owned(paths, path, one, other)
            asked = np.union1d(one, other)
            near = similar([shingle_set(rows[i][4].split(), hashes) for i in asked], np.searchsorted(asked, one), np.searchsorted(asked, other))
            if not near.any():
                continue
            copies, links = np.array([r[2] for r in rows], np.int64), np.zeros(len(rows), np.int64)
            ours &= near
            links[one] += ours @ copies[other]
            apart = ~np.isin(other, one)  # a pair of two sets of `one` is there twice
            links[other[apart]] += ours[:, apart].T @ copies[one]
            key, found, least = [r[1] for r in rows], [], []
            for together in groups(near, one, other):
                found += together.tolist()
                least += [min(key[i] for i in together)] * len(together)
            yield pa.record_batch([pa.array([key[i] for i in found], pa.binary()), pa.array(links[found]), pa.array(least, pa.binary())], ["set", "links", "other"])

    return common.map_arrow(members, run, "set binary, links long, other binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component, for the nodes of edges (a, b).

    Every round a node takes the least label of its neighbours and then that label's own label, so the rounds grow with the
    logarithm of a component's width.  Labels are written out each round; the driver sees only how many changed.
    """
    once = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = common.stash(once.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near"))))), "component-edges")
    labels = common.stash(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("beyond"))
        new = common.stash(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("beyond", "root")).alias("root")), "labels")
        if new.where("was <> root").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, h, group for every document.

    class_id is the least id of the group, n_links how many other documents have a similarity of 0.8 or more, h a hash of
    the text, group the group's own key (null for documents that can have no links).
    """
    keyed = common.id_and_text(docs, id_col, text_col).select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), "text")
    sketches = common.stash(_sketches(keyed, runs_for(1, recall)), "sketches")
    rows = common.stash(sketches.select(F.col("d").alias("doc_id"), "h", F.when(F.col("d").isNotNull(), F.col("set")).alias("set")), "document-sets")
    usable = sketches.where(F.col("d").isNotNull() & F.col("set").isNotNull())
    classes = usable.groupBy("set").agg(F.min(F.struct("d", "h")).alias("own"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "bits", "paths")))
    classes = common.stash(classes.select("set", F.col("own.d").alias("d"), F.col("own.h").alias("h"), "copies", "n", "bits", "paths"), "classes")
    common.unstash(sketches)
    places = classes.select("set", "copies", F.col("d").alias("cd"), F.col("h").alias("ch"))

    def with_text(sets: DataFrame) -> DataFrame:
        """sets, each once, with the number of copies and the text."""
        wanted = common.stash(places.join(sets.select("set"), "set", "left_semi"), "wanted-sets")
        if wanted.count() <= SENT:  # so few are sent to the texts, instead of shuffling these
            wanted = F.broadcast(wanted)
        texts = keyed.where(F.col("d").isNotNull()).join(wanted, F.expr("d = cd AND h = ch")).select("set", "copies", "text").dropDuplicates(["set"])
        return sets.join(texts, "set")

    buckets = _buckets(classes, with_text, small, recall)
    # Members with a partner by sketch, then each of them with its buckets, and its text once.
    cells = _in_cells(buckets.join(classes.select("set", "bits"), "set"), block, ["set", "n", "bits"])
    likely = common.stash(_alike(cells), "likely-members")
    common.unstash(buckets)
    left = common.stash(_once(likely.distinct()), "members")
    held = common.stash(left.groupBy("set").agg(F.collect_set("path").alias("paths"), F.collect_list(F.struct("path", "many", "weight")).alias("at")), "sets-to-compare")
    dealt = _in_cells(with_text(held).select("set", "copies", "paths", "text", F.inline("at")), block, ["set", "copies", "paths", "text"])
    found = common.stash(_compared(dealt), "links")
    counted = found.groupBy("set").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("set").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "set"})
    linked = classes.select("set", "d", "copies").join(counted, "set", "left").join(labels, "set", "left").select("set", "d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "set").alias("root"))
    linked = common.stash(linked, "linked")
    common.unstash(classes, likely, left, held, found)
    least = linked.groupBy("root").agg(F.min("d").alias("class_id"))
    named = linked.join(least, "root").select("set", "class_id", "n_links", F.col("root").alias("group"))
    return rows.join(named, "set", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "h", "group")


def op8(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links for every document."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rk, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT rk, w[i : i + least(5, len(w)) - 1] AS s FROM (SELECT rk, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM doc WHERE len(w) > 0)
), size AS (
  SELECT rk, count(*) AS n FROM shingle GROUP BY rk
), link AS (
  SELECT a, b FROM (SELECT x.rk AS a, y.rk AS b, count(*) AS c FROM shingle x JOIN shingle y ON x.s = y.s AND x.rk <> y.rk GROUP BY 1, 2)
  JOIN size p ON p.rk = a JOIN size q ON q.rk = b WHERE 9 * c >= 4 * (p.n + q.n)
), reach(a, b) AS (
  SELECT rk, rk FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), least_of AS (
  SELECT a AS rk, min(b) AS m FROM reach GROUP BY a
), degree AS (
  SELECT a AS rk, count(*) AS n FROM link GROUP BY a
)
SELECT d.doc_id, r.doc_id AS class_id, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links
FROM doc d JOIN least_of l ON l.rk = d.rk JOIN doc r ON r.rk = l.m LEFT JOIN degree g ON g.rk = d.rk
"""
