"""Vector code compression: product codes learnt in integers, so that a result never depends on rounding or order.

Components become floor(SCALE * x).  Vectors are cut into PARTS equal parts, and each part position has a codebook of ENTRIES, which starts
as that part of the least ids' vectors.  A round assigns every part to its nearest entry and replaces entries by the floored means
of their parts; after ROUNDS rounds all are assigned once more.

The nearest entry is found by screening.  A float32 matrix product gives |c|^2 - 2 x.c for every entry.  An interval
around it holds the true value: a product sum of w terms in any order, of inputs rounded to float32, errs by at most
g(w + 2) |x| |c| with g(n) = n u / (1 - n u) and u = 2^-24, and by nothing where every partial sum is an integer below 2^24.
Entries whose interval meets that of the best are evaluated again in int64, and equal distances go to the lower index.

Vectors are only ever read, never shuffled: a round sends each task the codebooks (ENTRIES x the vector's length) and gets back sums and counts
of entries, which are bounded by the same.  The driver holds no more than that and the first ENTRIES vectors.

Defined results: a row whose vector is null, empty, of a length that PARTS does not divide, or holds a null or non-finite component is dropped, as is
one whose length is not that of the least id's vector.  A null id is coded, but starts no entry.  Rows that repeat an id each count, the
smaller integers first.  Fewer rows than ENTRIES make fewer entries; none make an empty result.  Components from
2^20 on in size are an error, since their errors would not fit in a long.  Columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, quoted, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers from here on are an error; vectors that are screened at once; the unit roundoff of float32.
LARGEST, BLOCK, _U = 1 << 28, 4096, 2.0**-24


def lengths_of(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def integers(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the usable vectors of this length, and a row of integers for each."""
    lengths = lengths_of(column)
    at = np.flatnonzero(lengths == length)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    x = flat[(np.cumsum(lengths) - lengths)[at][:, None] + np.arange(length)] * SCALE
    fine = np.isfinite(x).all(axis=1)
    x = np.floor(x[fine])
    if x.size and np.abs(x).max() >= LARGEST:
        raise ValueError(f"a component times {SCALE} is not below {LARGEST}")
    return at[fine], x.astype(np.int64)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The index of the nearest row of c for every row of x, both int64; ties go to the lower index."""
    w = x.shape[1]
    p = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    norm = (c * c).sum(axis=1).astype(np.float64)
    score = norm - 2.0 * p
    g = (w + 2) * _U / (1 - (w + 2) * _U)
    size = np.sqrt((x * x).sum(axis=1).astype(np.float64))
    err = 2 * g * size * np.sqrt(norm.max()) * (1 + 1e-6) + 2.0**-50 * (norm.max() + 2 * np.abs(p).max(axis=1))
    err[w * np.abs(x).max(axis=1) * np.abs(c).max() < 1 << 24] = 0.0  # exact
    near = score <= (score.min(axis=1) + 2 * err)[:, None]
    out = score.argmin(axis=1)
    open_rows = np.flatnonzero(near.sum(axis=1) > 1)
    if open_rows.size:
        r, e = np.nonzero(near[open_rows])
        d = x[open_rows[r]] - c[e]
        order = np.lexsort((e, (d * d).sum(axis=1), r))
        first = np.concatenate([[True], r[order][1:] != r[order][:-1]])
        out[open_rows] = e[order][first]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in larger blocks: the table, the places of those that have the codebooks' length, and their vectors."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        at, x = integers(table.column("v").combine_chunks(), books.shape[0] * books.shape[2])
        return table, at, x.reshape(len(at), books.shape[0], books.shape[2])

    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= BLOCK:
            yield block()
            held = []
    if held:
        yield block()


def first_vectors(rows: DataFrame) -> np.ndarray:
    """The codebooks at the start, by part, entry and position; each task offers its ENTRIES least ids."""

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}  # by length
        for b in batches:
            ids = b.column("vec_id").to_pylist()
            for length in np.unique(lengths_of(b.column("v"))).tolist():
                if not length or length % PARTS:
                    continue
                top = best.setdefault(length, [])
                for k, v in zip(*integers(b.column("v"), length), strict=True):
                    if ids[k] is not None and (len(top) < ENTRIES or ids[k] <= top[-1][0]):
                        top.append((ids[k], v.tolist()))
                        top.sort()
                        del top[ENTRIES:]
        found = [t for top in best.values() for t in top]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([v for _, v in found], pa.list_(pa.int64()))], ["vec_id", "v"])

    offered = stash(map_arrow(rows, offer, "vec_id long, v array<long>"), "code-seeds").orderBy("vec_id", "v")
    least = offered.first()
    if least is None:
        return np.zeros((PARTS, 0, 0), np.int64)
    length = len(least["v"])
    seeds = [r["v"] for r in offered.where(F.size("v") == length).limit(ENTRIES).collect()]
    return np.array(seeds, np.int64).reshape(len(seeds), PARTS, length // PARTS).transpose(1, 0, 2)


def improve(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round; an entry that nothing is assigned to stays."""
    parts, entries, w = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for _, _, x in _blocks(batches, books):
            for p in range(parts if len(x) else 0):
                at = nearest(x[:, p], books[p])
                n[p] += np.bincount(at, minlength=entries)
                for j in range(w):  # a block's sums are below 2^53, so the weights lose nothing
                    sums[p, :, j] += np.bincount(at, x[:, p, j], entries).astype(np.int64)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    added = map_arrow(rows, add, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[j]) for j in range(w))).alias("s"))
    out = books.copy()
    for r in added.collect():  # a row for each entry
        out[r["part"], r["entry"]] = [v // r["n"] for v in r["s"]]
    return out


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every vector."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at, x in _blocks(batches, books):
            codes, error = np.zeros((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64)
            for p in range(len(books) if len(x) else 0):
                codes[:, p] = nearest(x[:, p], books[p])
                d = x[:, p] - books[p][codes[:, p]]
                error += (d * d).sum(axis=1)
            taken = table.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([taken.column(c).combine_chunks() for c in ("vec_id", "label")] + [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return map_arrow(rows, code, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and label_error of every vector, and the codebooks."""
    rows = vectors.select(quoted(id_col).cast("long").alias("vec_id"), quoted(vector_col).alias("v"), quoted(label_col).alias("label"))
    books = first_vectors(rows.select("vec_id", "v"))
    if not books.size:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).limit(0), books
    for _ in range(ROUNDS):
        books = improve(rows.select("v"), books)
    coded = stash(assign(rows, books), "codes")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(of_label, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op13(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds one after another; parts of four components, as the tables have."""
    xs, floors = [f"x{j}" for j in range(4)], lambda v: f"((sum({v}) - ((sum({v}) % count(*)) + count(*)) % count(*)) // count(*))"
    distance = " + ".join(f"(x.{v} - c.{v}) * (x.{v} - c.{v})" for v in xs)
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT rk, p, min(d * {ENTRIES} + e) AS best FROM (SELECT rk, p, e, {distance} AS d FROM x JOIN c{k} c USING (p)) GROUP BY rk, p)")
        if k < ROUNDS:
            means = ", ".join(f"CAST({floors(v)} AS BIGINT) AS {v}" for v in xs)
            steps.append(f"m{k} AS (SELECT p, best % {ENTRIES} AS e, {means} FROM a{k} JOIN x USING (rk, p) GROUP BY 1, 2)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, {', '.join(f'coalesce(m.{v}, c.{v}) AS {v}' for v in xs)} FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)")
    last = f"c{ROUNDS}"
    return f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS rk, vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: coalesce(isfinite(v), false))) = len(embedding)),
    x AS MATERIALIZED (SELECT rk, p, {', '.join(f'v[4 * p + {j + 1}] AS {v}' for j, v in enumerate(xs))} FROM (SELECT rk, v, unnest(range({PARTS})) AS p FROM k)),
    c0 AS MATERIALIZED (SELECT p, rk - 1 AS e, {', '.join(xs)} FROM x WHERE rk <= {ENTRIES}), {', '.join(steps)},
    b AS (SELECT sha256(string_agg(concat_ws(',', {', '.join(xs)}), ',' ORDER BY p, e)) AS codebooks_sha256 FROM {last}),
    r AS (SELECT rk, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rk)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN k USING (rk), b"""


SQL = _sql()
