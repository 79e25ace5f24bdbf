"""A workspace of text files as a table.

Spark's own file sources leave out names that start with a dot or an underscore, so the tree is walked here: by the executors, each
task from some folders down until it has listed BUDGET entries.  Folders it has not entered by then are dealt out again, so a large
folder never holds up one task and the driver holds no paths.  The folder must be one that the executors share.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.scratch import stash

#: Extensions that are read and folders that are not entered.
EXTENSIONS = frozenset("rs tsx ts jsx js md toml json css py yml yaml sh ps1 tf".split())
PRUNED = frozenset("target node_modules .git .venv .mypy_cache .pytest_cache .ruff_cache dist .next .vite".split())
#: Entries that a task lists; rows and bytes of a batch.
BUDGET, ROWS, BATCH_BYTES = 50_000, 1000, 8 << 20

_ENTRY = "kind string, path string, real string"
_FILE = "path string, ext string, content string, error string"


def wanted(name: str, env_files: bool = False) -> bool:
    stem, dot, ext = name.rpartition(".")
    return bool(dot and stem and ext in EXTENSIONS) or (env_files and name.startswith(".env"))


def _entries(tops: Iterator[str], env_files: bool, budget: int) -> Iterator[tuple[str, str, str]]:
    """Files below the folders, links to folders, and folders that the budget did not reach: (kind, path, real path)."""
    for top in tops:
        stack = [top]
        while stack:
            folder = stack.pop()
            if budget <= 0:
                yield "folder", folder, folder
                continue
            try:
                found, real = sorted(os.scandir(folder), key=lambda e: e.name), os.path.realpath(folder)
            except OSError:
                continue
            budget -= len(found)
            for e in found:
                if not e.is_dir():
                    if wanted(e.name, env_files):
                        yield "file", e.path, f"{real}/{e.name}"
                elif e.name not in PRUNED:
                    if e.is_symlink():
                        yield "link", e.path, os.path.realpath(e.path)
                    else:
                        stack.append(e.path)


def _batches(rows: Iterator[tuple], names: list[str], size=lambda row: BATCH_BYTES // ROWS) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip(names, zip(*held), strict=True)})
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.string()) for n, c in zip(names, zip(*held), strict=True)})


def list_files(spark: SparkSession, root: str, env_files: bool = False) -> DataFrame:
    """path of every file to read.

    A link to a folder is followed, unless that lies in the tree and is walked there; a folder that several links lead to is entered once.
    """
    if not os.path.isdir(root) or os.path.basename(os.path.normpath(root)) in PRUNED:
        return spark.createDataFrame([], "path string")

    budget = BUDGET

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = (p for b in batches for p in b.column(0).to_pylist())
        return _batches(_entries(tops, env_files, budget), ["kind", "path", "real"])

    own = os.path.realpath(root).rstrip("/")
    inside = (F.col("real") == own) | F.col("real").startswith(own + "/") & ~F.arrays_overlap(F.split(F.substring("real", len(own) + 2, 1 << 30), "/"), F.array(*map(F.lit, sorted(PRUNED))))
    todo, rounds = spark.createDataFrame([(root,)], "path string"), []
    while True:
        rounds.append(stash(todo.mapInArrow(walk, _ENTRY), "listed"))
        every = functools.reduce(DataFrame.unionByName, rounds)
        links = rounds[-1].where((F.col("kind") == "link") & ~inside)
        if len(rounds) > 1:
            links = links.join(functools.reduce(DataFrame.unionByName, rounds[:-1]).where("kind = 'link'").select("real"), "real", "left_anti")
        todo = rounds[-1].where("kind = 'folder'").select("path").unionByName(links.groupBy("real").agg(F.min("path").alias("path")).select("path")).repartition("path")
        if todo.isEmpty():
            return every.where("kind = 'file'").groupBy("real").agg(F.min("path").alias("path")).select("path")


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def files() -> Iterator[tuple]:
        for b in batches:
            for p in b.column(0).to_pylist():
                try:
                    raw = Path(p).read_bytes()
                except OSError as e:
                    yield p, Path(p).suffix[1:], None, str(e)
                else:
                    yield p, Path(p).suffix[1:], raw.decode("utf-8", "replace"), None

    return _batches(files(), ["path", "ext", "content", "error"], lambda row: 100 + len(row[2] or ""))


def read_workspace(spark: SparkSession, root: str, env_files: bool = False) -> DataFrame:
    """path, ext, content and error of every file; bytes that are no UTF-8 are replaced."""
    return read_files(list_files(spark, root, env_files))


def read_files(paths: DataFrame) -> DataFrame:
    """The same of some paths (column path)."""
    return paths.select("path").mapInArrow(_contents, _FILE)
