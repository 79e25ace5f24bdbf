"""Steps written as tables in a folder that all executors share: cuts lineage and survives lost executors."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Setting under which Spark removes a query's shuffle files at the query's end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where that is unset and the executors are this process's own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="quarryline-")
    return own


def _collections(spark: SparkSession) -> list[list[Callable[[], None]]]:
    """Of each open `collecting` the removals so far; kept with the session, as functions of this module travel to executors."""
    return spark.__dict__.setdefault("_quarryline_collections", [])


@contextlib.contextmanager
def collecting(spark: SparkSession) -> Iterator[list[Callable[[], None]]]:
    """Gather what removes the tables that `stash` writes meanwhile."""
    made: list[Callable[[], None]] = []
    _collections(spark).append(made)
    try:
        yield made
    finally:
        _collections(spark).pop()


def stash(df: DataFrame, name: str = "step", compression: str = "zstd") -> DataFrame:
    """Write df as a table in the shared folder and read it back.  Columns of hashes gain nothing from compression.

    The write's own shuffle files are removed once it is done.  The table is deleted by `unstash`, or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def remove() -> None:
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the JVM may be gone at exit
            pass

    atexit.register(remove)
    for made in _collections(spark)[-1:]:
        made.append(remove)
    table = spark.read.schema(df.schema).parquet(path)
    table.remove_stash = remove
    return table


def unstash(*tables: DataFrame) -> None:
    """Delete tables that nothing will read any more."""
    for t in tables:
        t.remove_stash()
        atexit.unregister(t.remove_stash)
