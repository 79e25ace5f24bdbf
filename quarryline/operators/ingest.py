"""Incremental ingestion: what changed, what vanished, and the change that follows.

A changed file's nodes, edges and hashes are all replaced, but of its chunks only
those whose content changed are indexed again: ids depend on what a chunk is, so the
index rows of the others still fit.  What is written follows what changed.  A vanished file's rows go, its hashes included, so
that it is indexed again if it comes back.  Hashes are taken of the text as it was
decoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import chunking, envscan, graph, search
from quarryline.plans import schema as S
from quarryline.sources.scratch import collecting, stash
from quarryline.sources.store import Change, Snapshot, Store
from quarryline.sources.workspace import EXTENSIONS, read_workspace

@dataclass(frozen=True)
class Report:
    total_files: int
    indexed: int
    skipped: int
    errors: int
    nodes_created: int


def content_hash(column) -> F.Column:
    return F.sha2(F.coalesce(column, F.lit("")), 256)


def classify_files(files: DataFrame, hashes: DataFrame, project: str) -> DataFrame:
    """files with hash and `changed`: whether nothing, or another hash, is stored for the path."""
    stored = hashes.where(F.col("project_id") == project).select(F.col("file_path").alias("path"), F.col("content_hash").alias("stored"))
    out = files.withColumn("hash", content_hash(F.col("content"))).join(stored, "path", "left")
    return out.withColumn("changed", F.col("stored").isNull() | (F.col("stored") != F.col("hash"))).drop("stored")


def stale_paths(stored: DataFrame, present: DataFrame) -> DataFrame:
    """file_path of what is stored but no longer present."""
    return stored.select("file_path").distinct().join(present.select(F.col("path").alias("file_path")), "file_path", "left_anti")


def changed_chunks(chunks: DataFrame, hashes: DataFrame, project: str) -> DataFrame:
    """Chunks whose content differs from what is stored under path, name and ordinal."""
    keyed = chunks.withColumn("key", chunk_key()).withColumn("hash", content_hash(F.col("content")))
    stored = hashes.where(F.col("project_id") == project).select(F.col("file_path").alias("key"), F.col("content_hash").alias("stored"))
    return keyed.join(stored, "key", "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("hash"))).drop("stored")


def chunk_key() -> F.Column:
    return F.concat_ws("::", F.col("path"), F.col("name"), F.col("ordinal").cast("string"))


def file_nodes(files: DataFrame, project: str) -> DataFrame:
    rows = files.select(F.col("path").alias("name"), F.lit("file").alias("node_type"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"), X.count_lines(F.col("content")).alias("end_line"), F.lit(None).cast("string").alias("summary"), F.col("hash").alias("content_hash"), F.lit(-1).alias("ordinal"))
    return graph.node_rows(rows, project)


def chunk_nodes(chunks: DataFrame, project: str) -> DataFrame:
    rows = chunks.select("name", "node_type", F.col("path").alias("file_path"), "start_line", "end_line", "summary", F.lit(None).cast("string").alias("content_hash"), "ordinal")
    return graph.node_rows(rows, project)


def text_changes(now: Snapshot, project: str, texts: DataFrame, stale: DataFrame) -> list[Change]:
    """What adding full-text rows, and taking away those of stale nodes (column id), changes in the text index.

    Both are read and written in proportion to themselves: old rows stay where they are, hidden by tombstones, and the statistics get
    counts of what comes and, negative, of what goes.  The index of what comes is made first, as its blocks give the counts.
    """
    texts = stash(texts, "texts")
    index = search.text_index(texts)
    gone = graph.rows_of(now.read("fts", project), "node_id", stale)
    counts = search.index_counts(index["fts_docs"], index["fts_postings"], gone).where("df <> 0 OR total <> 0")
    return [
        Change("fts", project, add=texts, remove=stale.select(F.col("id").alias("key")), derived=index),
        Change("fts_terms", project, add=counts),
    ]


def ingest(store: Store, root: str, project: str) -> Report:
    """Bring the store up to what the folder holds now, in one change."""
    found: list[Report] = []
    with collecting(store.spark) as steps:
        everything = read_workspace(store.spark, root, env_files=True).persist()
        try:
            store.update(lambda now: _changes(now, everything, project, found))
        finally:
            everything.unpersist()
            for remove in steps:
                remove()
    return found[-1]


def _changes(now: Snapshot, everything: DataFrame, project: str, found: list[Report]) -> list[Change]:
    """What makes a state of the store agree with the files; its report is added to `found`."""
    base = F.substring_index("path", "/", -1)
    indexable = F.regexp_extract(base, r"^.+\.([^.]+)$", 1).isin(*sorted(EXTENSIONS))
    readable = everything.where(F.col("content").isNotNull())
    out = []
    registry, known = stash(envscan.registry(envscan.scan(readable), project), "registry"), now.read("config_registry", project)
    a, b = (df.select("project_id", "key", "is_defined", "is_used") for df in (registry, known))
    if a.exceptAll(b).unionByName(b.exceptAll(a)).head() is not None:
        out.append(Change("config_registry", project, add=registry, replace=True))

    files = everything.where(indexable)
    hashes, nodes = now.read("file_hashes", project), now.read("nodes", project)
    judged = classify_files(files.where(F.col("content").isNotNull()), hashes, project)
    judged = stash(judged.select("path", "hash", "changed", F.when(F.col("changed"), F.col("content")).alias("content")), "judged")
    changed = judged.where("changed").select("path", "content", "hash")
    paths = changed.select(F.col("path").alias("file_path"))
    gone = stale_paths(graph.file_paths(nodes, project), files)
    touched = paths.unionByName(gone)
    counts, total = judged.agg(F.count("*").alias("n"), F.count_if("changed").alias("c")).first(), files.count()
    if counts["c"] or not gone.isEmpty():
        doomed = stash(graph.nodes_of_files(nodes, touched, project), "doomed")
        chunks = stash(chunking.chunk_files(changed), "chunks")
        fresh = stash(changed_chunks(chunks, hashes, project), "fresh")
        made = file_nodes(changed, project).unionByName(chunk_nodes(chunks, project))
        key = lambda kind, name, ordinal: S.stable_id(F.lit(project), F.col("path"), kind, name, ordinal)
        file_id, part_id = key(F.lit("file"), F.col("path"), F.lit(-1)), key(F.col("node_type"), F.col("name"), F.col("ordinal"))
        # What is doomed and not among the unchanged chunks goes from the text index.
        same = chunks.select(part_id.alias("id")).join(fresh.select(part_id.alias("id")), "id", "left_anti")
        links = graph.edge_rows(chunks.select(file_id.alias("source_id"), part_id.alias("target_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight")), project)
        texts = changed.select(file_id.alias("node_id"), F.lit(project).alias("project_id"), F.col("path").alias("name"), "content", F.col("path").alias("file_path")).unionByName(
            fresh.select(part_id.alias("node_id"), F.lit(project).alias("project_id"), "name", "content", F.col("path").alias("file_path"))
        )
        time = F.current_timestamp()
        new_hashes = changed.select(F.lit(project).alias("project_id"), F.col("path").alias("file_path"), F.col("hash").alias("content_hash"), time.alias("indexed_at")).unionByName(
            chunks.select(F.lit(project).alias("project_id"), chunk_key().alias("file_path"), content_hash(F.col("content")).alias("content_hash"), time.alias("indexed_at"))
        )
        ids, made = doomed.select(F.col("id").alias("key")), stash(made, "made")
        out += [
            Change("nodes", project, add=made, remove=ids),
            Change("edges", project, add=graph.first_edges(links), remove=ids),
            Change("vectors", project, add=search.vector_index(made), remove=ids),
            Change("file_hashes", project, add=new_hashes, remove=touched.select(F.col("file_path").alias("key"))),
            *text_changes(now, project, texts, doomed.join(same, "id", "left_anti")),
        ]
        created = counts["c"] + fresh.count()
    else:
        created = 0
    found.append(Report(total, counts["c"], counts["n"] - counts["c"], total - counts["n"], created))
    return out
