"""Property graph: writes as snapshots, and one-hop traversal as joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.plans import schema as S
from quarryline.sources.store import DERIVED, Derived


@dataclass(frozen=True)
class NodeSpec:
    """A node to be; its id follows from what it is."""

    name: str
    node_type: str = S.NODE_DEFAULT
    file_path: str | None = None
    start_line: int | None = None
    end_line: int | None = None
    summary: str | None = None
    content_hash: str | None = None
    ordinal: int = 0


@dataclass(frozen=True)
class EdgeSpec:
    source_id: str
    target_id: str
    edge_type: str = S.EDGE_DEFAULT
    weight: float = 1.0


def build_nodes(spark: SparkSession, project: str, specs: list[NodeSpec]) -> DataFrame:
    rows = [(s.name, s.node_type, s.file_path, s.start_line, s.end_line, s.summary, s.content_hash, s.ordinal) for s in specs]
    df = spark.createDataFrame(rows, "name string, node_type string, file_path string, start_line long, end_line long, summary string, content_hash string, ordinal long")
    return node_rows(df, project)


def node_rows(df: DataFrame, project: str) -> DataFrame:
    """Rows of the nodes table from name, node_type, file_path, start_line, end_line, summary, content_hash, ordinal."""
    kind = S.typed(F.col("node_type"), S.NODE_TYPES, S.NODE_DEFAULT)
    key = S.stable_id(F.lit(project), F.col("file_path"), kind, F.col("name"), F.col("ordinal"))
    now = F.current_timestamp()
    return df.select(key.alias("id"), F.lit(project).alias("project_id"), "name", kind.alias("node_type"), "file_path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), "summary", "content_hash", now.alias("created_at"), now.alias("updated_at"))


def build_edges(spark: SparkSession, project: str, specs: list[EdgeSpec]) -> DataFrame:
    return edge_rows(spark.createDataFrame([(s.source_id, s.target_id, s.edge_type, s.weight) for s in specs], "source_id string, target_id string, edge_type string, weight double"), project)


def edge_rows(df: DataFrame, project: str) -> DataFrame:
    kind = S.typed(F.col("edge_type"), S.EDGE_TYPES, S.EDGE_DEFAULT)
    return df.select(S.stable_id(F.lit(project), F.col("source_id"), F.col("target_id"), kind).alias("id"), F.lit(project).alias("project_id"), "source_id", "target_id", kind.alias("edge_type"), F.coalesce("weight", F.lit(1.0)).alias("weight"), F.current_timestamp().alias("created_at"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The next snapshot: new rows replace old ones with the same keys.  Among new rows of a key any one counts."""
    fresh = new.dropDuplicates(keys)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


EDGE_KEY = ["source_id", "target_id", "edge_type"]


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next snapshot: of edges between the same nodes with the same type the first stays (old ones, then by time and id)."""
    return old.unionByName(first_edges(new).join(old.select(*EDGE_KEY), EDGE_KEY, "left_anti"))


def first_edges(new: DataFrame) -> DataFrame:
    first = Window.partitionBy(*EDGE_KEY).orderBy("created_at", "id")
    return new.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def nodes_of_files(nodes: DataFrame, files: DataFrame, project: str) -> DataFrame:
    """Ids of the nodes of the given file paths."""
    return nodes.where(F.col("project_id") == project).join(files.select("file_path").distinct(), "file_path", "left_semi").select("id")


def cascade_delete(nodes: DataFrame, edges: DataFrame, fts: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Snapshots without the doomed nodes (column id), the edges that touch them, and their full-text rows.  Facts stay."""
    gone = doomed.select(F.col("id").alias("gone")).distinct()
    left_edges = edges.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("target_id") == F.col("gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), left_edges, fts.join(gone, F.col("node_id") == F.col("gone"), "left_anti")


def all_nodes(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.where(F.col("project_id") == project)


def get_node(nodes: DataFrame, node_id: str, project: str) -> DataFrame:
    return nodes.where((F.col("id") == node_id) & (F.col("project_id") == project)).limit(1)


def file_paths(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.where((F.col("project_id") == project) & (F.col("node_type") == "file") & F.col("file_path").isNotNull()).select("file_path").distinct()


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, project: str | None = None) -> DataFrame:
    """edge_id, edge_type, weight and the node at the other end, for each edge at a node.  Only edges are held to the project."""
    touching = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id))
    if project is not None:
        touching = touching.where(F.col("project_id") == project)
    other = F.when(F.col("source_id") == node_id, F.col("target_id")).otherwise(F.col("source_id"))
    ends = touching.select(F.col("id").alias("edge_id"), "edge_type", "weight", other.alias("other_id"))
    return ends.join(nodes, F.col("other_id") == F.col("id")).drop("other_id")


def incoming(edges: DataFrame) -> dict[str, DataFrame]:
    """The same edges as the table edges_in, which is laid out by target."""
    return {"edges_in": edges}


DERIVED["edges"] = Derived(("edges_in",), incoming)


def neighbors_stored(edges: DataFrame, edges_in: DataFrame, nodes: DataFrame, node_id: str, project: str | None = None) -> DataFrame:
    """neighbors from a store: its edges by source and by target, each scanned for one value, then the nodes at the other ends."""
    ends = ("id", "edge_type", "weight")
    if project is not None:
        edges, edges_in = (df.where(F.col("project_id") == project) for df in (edges, edges_in))
    out = edges.where(F.col("source_id") == node_id).select(*ends, F.col("target_id").alias("other_id"))
    back = edges_in.where((F.col("target_id") == node_id) & (F.col("source_id") != node_id)).select(*ends, F.col("source_id").alias("other_id"))
    touching = out.unionByName(back).withColumnRenamed("id", "edge_id")
    return touching.join(rows_of(nodes, "id", touching.select(F.col("other_id").alias("id"))), F.col("other_id") == F.col("id")).drop("other_id")


#: Ids up to which they are named in a filter.
FEW = 1000


def rows_of(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows with these ids (column id): of a few by a filter, by which a scan of sorted segments skips what cannot hold them."""
    few = [r["id"] for r in ids.select("id").distinct().limit(FEW + 1).collect()]
    if len(few) <= FEW:
        return df.where(F.col(column).isin(*few)) if few else df.limit(0)
    return df.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def neighbor_pairs(edges: DataFrame) -> DataFrame:
    """node_id, other_id of every edge seen from both ends; a loop is seen once."""
    ends = F.array(F.struct(F.col("source_id").alias("node_id"), F.col("target_id").alias("other_id")), F.struct(F.col("target_id").alias("node_id"), F.col("source_id").alias("other_id")))
    return edges.select(F.col("id").alias("edge_id"), "edge_type", F.inline(F.when(F.col("source_id") == F.col("target_id"), F.slice(ends, 1, 1)).otherwise(ends)))
