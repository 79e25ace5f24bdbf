"""Mixing sources to target weights by balanced sampling with the cube method.

A document is taken a whole number of times: its source's target divided by its source's size, rounded down or up.  The fraction
is an inclusion probability, and the cube method decides it.  Of three undecided documents of a source at a time, the
probabilities move along the null space of two constraints, words and documents, until one of them is 0 or 1; the
direction is drawn so that every probability keeps its mean.  Both totals therefore stay what they were.  What is left in
the end, LANDING documents of a source at most, is a small problem whose outcomes are all tried: the one nearest in
words, then in documents, is taken.

It is done in levels.  A source's documents are dealt over buckets of about BUCKET by a hash of the id, as many as its rows ask for,
so a hot source is many buckets.  A bucket is streamed through and leaves its LANDING largest undecided documents at most; those of FAN
buckets are one bucket of the next level, until a source has one.  Buckets, order and draws depend on the rows only, so a rerun
gives the same result on any cluster.

Targets: sources in the order of code points, null last, weigh WEIGHTS again and again and share SHARE times all words.  A target stops
at MOST times its source's size, and the excess is shared by weight among the others until none is above.

Defined results: a null text has no words.  A document without words takes part in nothing and takes 0.  A source without words has the target
0.  A null source is a source.  Rows that repeat an id are documents of their own; null ids too.  Texts of any length are read whole.  An
empty table gives no rows.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, map_arrow, quoted, stash

#: Weights by the place of a source; the words to take in all, and from a source at most, as multiples of its words.
WEIGHTS, SHARE, MOST = (3, 1, 2), Fraction(3, 2), 2
#: Documents of a bucket, buckets that meet in one at the next level, and undecided documents that are settled by trying all outcomes.
BUCKET, FAN, LANDING = 1000, 100, 14

_SIZES = "doc_id long, source string, size long"
#: Words and documents are two constraints, so three documents have a direction to move in.
_FREE = 3


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source and size, the words of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([len(t.split()) if t else 0 for t in binary(b.column("text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), n], ["doc_id", "source", "size"])

    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"), quoted(text_col).cast("string").alias("text"))
    return map_arrow(rows, count, _SIZES)


def targets(rows: DataFrame) -> DataFrame:
    """source, n (documents), source_size and target of every source.  The driver sees sums over all sources only."""
    totals = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    in_order = F.asc_nulls_last("source")
    placed = stash(totals.repartitionByRange(in_order).sortWithinPartitions(in_order).withColumn("pid", F.spark_partition_id()), "mix-sources")
    before, starts = 0, []
    for r in placed.groupBy("pid").count().orderBy("pid").collect():  # a row for each partition
        starts.append((r["pid"], before))
        before += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "pid int, first long")
    place = F.col("first") + F.row_number().over(Window.partitionBy("pid").orderBy(in_order)) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    table = stash(placed.join(F.broadcast(first), "pid").select("source", "n", "source_size", weight.cast("long").alias("weight")), "mix-weights")

    cap, level = MOST * F.col("source_size"), 0.0
    stopped, known = F.lit(False), -1
    while True:  # the level rises, so sources only ever join those that have stopped
        full = F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0))
        r = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), full.alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("weight"), F.count_if(stopped).alias("k")).first()
        if not r["weight"] or r["k"] == known:
            break
        known, level = r["k"], float((SHARE * r["total"] - r["full"]) / r["weight"])
        stopped = F.col("weight") * level > cap
    return table.select("source", "n", "source_size", F.when(stopped, cap.cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _draw(draws: tuple[int, ...]) -> float:
    """A number from 0 to below 1 by the documents that move."""
    x = 0
    for d in draws:
        x = ((x ^ d & 0xFFFFFFFFFFFFFFFF) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF  # odd numbers of a mixing hash
        x ^= x >> 29
    return (x >> 11) / (1 << 53)


def step(units: list[list]) -> None:
    """Move the probabilities of three units (probability, size, draw, ...) along the null space until one of them is decided."""
    (a, b, c) = (u[1] for u in units)
    way = (b - c, c - a, a - b)
    if not any(way):
        way = (1, -1, 0)
    far = []  # how far each direction can go
    for sign in (1, -1):
        far.append(min(((1.0 - u[0]) if sign * w > 0 else u[0]) / abs(w) for u, w in zip(units, way, strict=True) if w))
    ahead = _draw(tuple(u[2] for u in units)) * (far[0] + far[1]) < far[1]
    move = far[0] if ahead else -far[1]
    rest = [(1.0 - u[0] if move * w > 0 else u[0]) / abs(w) if w else np.inf for u, w in zip(units, way, strict=True)]
    first = int(np.argmin(rest))
    for k, (u, w) in enumerate(zip(units, way, strict=True)):
        p = u[0] + move * w
        u[0] = float(move * w > 0) if k == first else 0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p


def smallest(pool: list[list]) -> list[list]:
    """The three smallest units: the large ones, which no step can weigh out, remain for landing."""
    return sorted(pool, key=lambda u: u[1])[:_FREE]


def land(units: list[list]) -> None:
    """Decide the last units together: of all outcomes the nearest in words, then in documents."""
    if not units:
        return
    p, size = (np.array([u[k] for u in units], float) for k in (0, 1))
    taken = (np.arange(1 << len(units))[:, None] >> np.arange(len(units)) & 1) - p
    words, documents = (np.round(np.abs(taken @ w), 6) for w in (size, np.ones(len(units))))
    best = int(np.lexsort((documents, words))[0])
    for k, u in enumerate(units):
        u[0] = float(best >> k & 1)


_FIELDS = ("doc_id", "source", "size", "base", "source_size", "target", "buckets", "bucket", "draw", "pi")
_UNIT = "doc_id long, source string, size long, base long, source_size long, target double, buckets long, bucket long, draw long, pi double"


def _flight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _UNIT sorted by source and bucket: the same rows, decided but for LANDING a bucket where the source has several."""
    key, pool, last = None, [], False

    def finish() -> list[list]:
        if last:
            land(pool)
        return pool

    for batch in batches:
        done: list[list] = []
        for row in zip(*(batch.column(f).to_pylist() for f in _FIELDS), strict=True):
            if (row[1], row[7]) != key:
                done += finish()
                key, pool, last = (row[1], row[7]), [], row[6] == 1
            pool.append([row[9], row[2], row[8], row])  # probability, size, draw
            while len(pool) > LANDING:
                step(smallest(pool))
                done += [u for u in pool if u[0] in (0.0, 1.0)]
                pool = [u for u in pool if u[0] not in (0.0, 1.0)]
        yield _rows(done, batch.schema)
    if key is not None:
        yield _rows(finish(), batch.schema)


def _rows(units: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*((*u[3][:-1], u[0]) for u in units), strict=True)) or [()] * len(_FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(f).type) for c, f in zip(columns, _FIELDS, strict=True)], list(_FIELDS))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document."""
    counted = stash(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    shares = targets(counted)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    held = counted.join(shares.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("base", F.floor(rate))
    held = held.withColumn("pi", F.when(F.col("size") > 0, rate - F.col("base")).otherwise(0.0))
    buckets = F.ceil(F.col("n") / BUCKET)
    todo = held.where("pi > 0").withColumns({"buckets": buckets, "bucket": F.pmod(F.xxhash64(F.lit(22), "doc_id"), buckets), "draw": F.xxhash64(F.lit(21), "doc_id")}).select(*_FIELDS)
    columns = ("doc_id", "source", "size", "base", "source_size", "target", "pi")
    out, left = held.where("pi = 0").select(*columns), shares.agg(F.ceil(F.max("n") / BUCKET)).first()[0] or 0
    while True:
        ordered = todo.repartition("source", "bucket").sortWithinPartitions("source", "bucket", "draw", "doc_id", "size")
        flown = stash(map_arrow(ordered, _flight, _UNIT), "mix-flight")
        out = out.unionByName(flown.where("pi = 0 OR pi = 1").select(*columns))
        if left <= 1:
            break
        todo = flown.where("pi > 0 AND pi < 1").withColumns({"bucket": F.floor(F.col("bucket") / FAN), "buckets": F.ceil(F.col("buckets") / FAN)}).select(*_FIELDS)
        left = -(-left // FAN)
    copies = F.col("base") + F.col("pi").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op12(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
