"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources import scratch
from quarryline.sources.scratch import collecting, shared_dir, stash, unstash  # noqa: F401

# Functions of this package, and of the one module it uses, travel to the executors by value, so that they need no installed copy there.
cloudpickle.register_pickle_by_value(sys.modules[__package__])
cloudpickle.register_pickle_by_value(scratch)

#: Bytes that part words: space, tab, newline, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class body.
BLANK_CLASS = r"\x20\x09-\x0D"
#: Rows of text in one Arrow batch at most: bounds a Python worker's memory when texts are long.
ROWS_PER_BATCH = 500


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, since one text may be very long."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"  # read when a plan is run, so it has to stay
    if int(conf.get(name)) not in range(1, ROWS_PER_BATCH + 1):
        conf.set(name, str(ROWS_PER_BATCH))
    return df.mapInArrow(fn, schema)


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> tuple[str, ...]:
    """Names like these that no column of df has."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return tuple(out)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the two columns an operator reads, under fixed names; other columns of any name do no harm."""
    return df.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).cast("string").alias("text"))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of an id's decimal text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """About `rows` rows of df, never more than 1.2 times that, chosen by a hash of the key.  Only for fitting models."""
    total = df.count()
    if total <= rows:
        return df
    return df.where(_draw(seed, key) < int(rows / total * (1 << 30))).orderBy(_draw(seed, key), key).limit(int(rows * 1.2))


def _draw(seed: int, *keys: str) -> Column:
    """A number below 2^30 by a hash of the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *map(F.col, keys)), F.lit(1 << 30))


def sample_of_each(df: DataFrame, key: str, value: str, text: str, rows: int, least: int) -> DataFrame:
    """bounded_sample of df, but with about `least` rows, and at least one, of each value that has fewer there.

    These are chosen by a hash of key and text, without repeated rows.  The size is bounded by `rows` and the number of values.
    """
    counts = {r[0]: r[1] for r in df.groupBy(value).count().collect()}
    total = sum(counts.values())
    if total <= rows:
        return df
    common_draw, own_draw = _draw(11, key) < int(rows / total * (1 << 30)), _draw(12, key, text)
    first = lambda part: part.orderBy(_draw(11, key), key, F.xxhash64(text)).limit(int(rows * 1.2))  # noqa: E731  the bound holds even if keys repeat
    found = df.groupBy(value).agg(F.count_if(common_draw), F.min(own_draw)).collect()
    rare = [(v, max(least_draw, least * (1 << 30) // counts[v])) for v, n, least_draw in found if n < least]
    if not rare:
        return first(df.where(common_draw))
    cuts = F.broadcast(df.sparkSession.createDataFrame(rare, f"`{value}` {df.schema[value].dataType.simpleString()}, __cut long"))
    often = first(df.join(cuts, value, "left_anti").where(common_draw))
    return often.unionByName(df.join(cuts, value).where(own_draw <= F.col("__cut")).select(*df.columns).dropDuplicates([key, text, value]).select(*often.columns))


def worker_state(key: Any, make: Callable[[], Any]) -> Any:
    """make() once for tasks of one kind in a Python worker process, which outlives tasks; for caches that change no result.

    Only the last kind's state is held, so that a worker that turns to other work, or to none, does not keep the caches of all.
    """
    held = sys.modules.setdefault("_quarryline_worker_state", types.ModuleType("_quarryline_worker_state")).__dict__
    if held.get("key") != key:
        held["key"], held["state"] = key, None
        held["state"] = make()
    return held["state"]


def no_worker_state() -> None:
    """Let go of what worker_state holds."""
    worker_state("nothing", dict)
