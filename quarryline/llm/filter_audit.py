"""Filter interaction audit: what each filter removes in every order of the filters.

Five conditions fail a document (FILTERS); E, identity with a smaller id's text, is found by sorting.  Documents are
range-sorted by a 64-bit fingerprint, the full text and the id, so equal texts stand next to each other and a group of
copies of any size is dealt over many tasks by its ids.  One pass compares each document with the one before it and
judges each text once, since copies fail the other conditions alike.  Range bounds are fingerprints and ids, never texts.

A fingerprint can run over the bounds of partitions.  Each partition therefore writes down the texts under its first and
its last fingerprint with their least ids, a row or two; of equal ones the least id over all partitions settles the
documents that had no predecessor where they stood.  Texts are compared in full, so equal fingerprints of different
texts do no harm.

What follows is additive: a count for each part and failure mask (at most 32 a part), beside counts of labelled
documents.  `interactions` multiplies a part's counts with fixed matrices of the 120 orders and their steps.

Defined results: a null text is empty.  A null lang belongs to the part with the empty name, as an empty lang does.  A
document with a null id fails E neither itself nor for others, and has no label.  Rows that repeat an id are judged each
on its own: of equal id and text neither fails E for the other's sake.  A document counts as good or toxic if any label row of
its id says so.  Texts of any length are read whole.  An empty table has no parts and gives no rows.  Columns other
than the named ones are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, map_arrow, quoted, stash

#: The filters in the order of their bits.
FILTERS = "ABCDE"
#: Words a text needs; percent of its words that must be distinct; percent of its characters that may be capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITALS, _SYMBOLS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_COPY = 1 << FILTERS.index("E")

_PASS = "pid int, run int, fp long, text binary, doc_id long, part string, mask int"
_COUNTERS = ("n", "good", "toxic")
_STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: bytes, points: int) -> int:
    """The bits of A to D for a text of so many code points."""
    words = text.split()
    n = len(words)
    mask = 1 if n < LEAST_WORDS else 0
    if 100 * len(set(words)) < LEAST_DISTINCT * n:
        mask |= 2
    if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > MOST_CAPITALS * points:
        mask |= 4
    if len(text.translate(None, _SYMBOLS)) < len(text):
        mask |= 8
    return mask


def fingerprint(text: Column) -> Column:
    return F.xxhash64(text)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by fp, text and doc_id: each document's mask, and the texts under the first and the last fp.

    A document under the first fp that has no smaller id before it here gets `run`, the number of its text; a text's row has that, the
    text and the least id.
    """
    pid, number, run = TaskContext.get().partitionId(), 0, None
    head = fp = text = None
    here: list[list] = []  # under this fp: number, text, least id
    for batch in batches:
        fps, ids, parts = (batch.column(k).to_pylist() for k in ("fp", "doc_id", "part"))
        texts, points = binary(batch.column("text")), pc.utf8_length(batch.column("text")).to_pylist()
        rows: list[tuple] = []
        for f, t, size, i, part in zip(fps, texts, points, ids, parts, strict=True):
            if f != fp or t != text:
                if f != fp:
                    if fp is None:
                        head = f
                    elif fp == head:
                        rows += [(pid, k, fp, x, least, None, None) for k, x, least in here]
                    here = []
                fp, text, mask = f, t, failures(t, size)
                run = [number, t, None]
                number += 1
                here.append(run)
            late = False
            if i is not None:
                if run[2] is None:
                    run[2] = i
                late = i > run[2]
            rows.append((pid, run[0] if fp == head and i is not None and not late else None, None, None, i, part, mask | _COPY if late else mask))
        yield _batch(rows)
    if here:
        yield _batch([(pid, k, fp, x, least, None, None) for k, x, least in here])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int32())
    names = [f.split()[0] for f in _PASS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part and mask, the failed filters' bits, for every document."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(part_col).cast("string"), F.lit("")).alias("part"), fingerprint(text).alias("fp"), text.alias("text"))
    ordered = rows.repartitionByRange("fp", "doc_id").sortWithinPartitions("fp", "text", "doc_id")
    seen = stash(map_arrow(ordered, _compare, _PASS), "audit-masks")
    documents = seen.where("mask IS NOT NULL").select("pid", "run", "doc_id", "part", "mask")
    # Few rows: one for each text under the first or last fingerprint of a partition.
    edges = seen.where("mask IS NULL").withColumn("least", F.min("doc_id").over(Window.partitionBy("fp", "text")))
    late = edges.where("least < doc_id").select("pid", "run")
    settled = documents.where("run IS NULL").drop("pid", "run")
    open_ones = documents.where("run IS NOT NULL").join(late.withColumn("late", F.lit(_COPY)), ["pid", "run"], "left")
    return settled.unionByName(open_ones.select("doc_id", "part", (F.col("mask") + F.coalesce("late", F.lit(0))).alias("mask")))


def counters(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask and the documents, the good ones and the toxic ones with them; sums of any pieces of the corpus add up."""
    flagged = labels.groupBy("doc_id").agg(*(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0).cast("long")).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    known = judged.join(flagged.where("good + toxic > 0"), "doc_id").groupBy("part", "mask").agg(F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    zero = F.lit(0).cast("long")
    every = judged.groupBy("part", "mask").agg(F.count("*").alias("n")).withColumns({"good": zero, "toxic": zero})
    return every.unionByName(known.withColumn("n", zero)).groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in _COUNTERS))


def matrices() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every (order, step), and for each measure which of the 32 masks count there."""
    steps, at = [], []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append(("".join(FILTERS[g] for g in order), k + 1))
            at.append((before, 1 << f))
            before |= 1 << f
    before, own = (np.array(c)[:, None] for c in zip(*at, strict=True))
    m = np.arange(1 << len(FILTERS))[None, :]
    fails, gone = (m & own) != 0, (m & before) != 0
    return steps, {"kept": (m & (before | own)) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": np.broadcast_to(m == own, fails.shape)}


def interactions(counted: DataFrame) -> DataFrame:
    """The audit of every part from its counters."""
    steps, chosen = matrices()
    chosen = {k: v.astype(np.int64) for k, v in chosen.items()}
    orders, places = [o for o, _ in steps], [s for _, s in steps]
    filters = np.array([FILTERS.index(o[s - 1]) for o, s in steps])
    names = [f.split()[0] for f in _STEP.split(", ")]

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("held").to_pylist(), strict=True):
                n, good, toxic = (np.zeros(1 << len(FILTERS), np.int64) for _ in _COUNTERS)
                for h in held:
                    n[h["mask"]], good[h["mask"]], toxic[h["mask"]] = h["n"], h["good"], h["toxic"]
                out = {k: v @ n for k, v in chosen.items()} | {"good_lost": chosen["removed"] @ good, "toxic_lost": chosen["removed"] @ toxic}
                total = np.zeros(len(FILTERS), np.int64)
                np.add.at(total, filters, out["removed"])
                out |= {"shapley": total[filters], "part": [part] * len(steps), "filter_order": orders, "step": pa.array(places, pa.int32())}
                yield pa.RecordBatch.from_arrays([pa.array(out[k]) for k in names], names)

    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTERS)).alias("held"))  # at most 32 a part
    return held.mapInArrow(expand, _STEP)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step."""
    return interactions(counters(masks(docs), labels))


def op11(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = r"""
WITH doc AS (
  SELECT coalesce(lang, '') AS part, doc_id, t, length(t) AS points, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS least
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)
), m AS (
  SELECT part, doc_id, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * points THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN least < doc_id THEN 16 ELSE 0 END) AS mask FROM doc
), flag AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN flag USING (doc_id) GROUP BY ALL
), f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit
), o AS (
  SELECT concat(a.f, b.f, c.f, d.f, e.f) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS own, CAST(coalesce(list_sum(bits[1 : step - 1]), 0) AS BIGINT) AS before FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)
), r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | before) = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant,
    sum(n) FILTER (mask = own) AS unique_fails, sum(good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r
"""
