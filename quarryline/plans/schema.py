"""Tables of the store, closed sets of types, and stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], len(f) < 3) for f in fields])


NODES = _table(("id", _S, 0), ("project_id", _S, 0), ("name", _S, 0), ("node_type", _S, 0), ("file_path", _S), ("start_line", _L), ("end_line", _L), ("summary", _S), ("content_hash", _S), ("created_at", _TS, 0), ("updated_at", _TS, 0))
EDGES = _table(("id", _S, 0), ("project_id", _S, 0), ("source_id", _S, 0), ("target_id", _S, 0), ("edge_type", _S, 0), ("weight", _D), ("created_at", _TS, 0))
FACTS = _table(("id", _S, 0), ("project_id", _S, 0), ("node_id", _S), ("fact_type", _S, 0), ("content", _S, 0), ("valid_from", _TS, 0), ("valid_to", _TS), ("superseded_by", _S), ("source_reference", _S), ("created_at", _TS, 0))
FILE_HASHES = _table(("project_id", _S, 0), ("file_path", _S, 0), ("content_hash", _S, 0), ("indexed_at", _TS, 0))
ACCOUNTING = _table(("id", _S, 0), ("project_id", _S, 0), ("session_id", _S, 0), ("query_text", _S, 0), ("pointer_tokens", _L, 0), ("fetched_tokens", _L, 0), ("traditional_est", _L, 0), ("created_at", _TS, 0))
ACCOUNTING_SUMS = _table(("project_id", _S, 0), ("session_id", _S, 0), ("slot", _L, 0), ("n", _L, 0), ("pointer_tokens", _L, 0), ("fetched_tokens", _L, 0), ("traditional_est", _L, 0))
REGISTRY = _table(("project_id", _S, 0), ("key", _S, 0), ("is_defined", _B, 0), ("is_used", _B, 0), ("created_at", _TS, 0))
FTS = _table(("node_id", _S, 0), ("project_id", _S, 0), ("name", _S), ("content", _S), ("file_path", _S))
_INTS = T.ArrayType(T.IntegerType())
POSTINGS = _table(("term", _S, 0), ("seg", _S, 0), ("span", _L, 0), ("avg", _D, 0), ("top", _D, 0), ("at", _INTS, 0), ("tf", _INTS, 0), ("positions", _INTS, 0))
DOCS = _table(("seg", _S, 0), ("span", _L, 0), ("at", T.IntegerType(), 0), ("node_id", _S, 0), ("project_id", _S, 0), ("size", T.IntegerType(), 0))
TERMS = _table(("term", _S, 0), ("df", _L, 0), ("total", _L, 0))
VECTORS = _table(("id", _S, 0), ("project_id", _S, 0), ("vector", T.ArrayType(_table(("b", T.IntegerType()), ("v", T.FloatType())))))
VECTOR_DOCS = _table(("seg", _S, 0), ("span", _L, 0), ("at", T.IntegerType(), 0), ("id", _S, 0), ("project_id", _S, 0))
VECTOR_LISTS = _table(("term", _S, 0), ("seg", _S, 0), ("span", _L, 0), ("top", T.FloatType(), 0), ("at", _INTS, 0), ("v", T.ArrayType(T.FloatType()), 0))
NAMES = _table(("seg", _S, 0), ("span", _L, 0), ("at", T.IntegerType(), 0), ("low", _S, 0), ("id", _S, 0), ("project_id", _S, 0))
NAME_GRAMS = _table(("term", _S, 0), ("seg", _S, 0), ("span", _L, 0), ("at", _INTS, 0))
FILES = _table(("path", _S, 0), ("ext", _S), ("content", _S, 0))

TABLES: dict[str, T.StructType] = {
    "nodes": NODES, "names": NAMES, "name_grams": NAME_GRAMS, "edges": EDGES, "edges_in": EDGES, "temporal_facts": FACTS, "file_hashes": FILE_HASHES,
    "accounting": ACCOUNTING, "accounting_sums": ACCOUNTING_SUMS, "config_registry": REGISTRY, "fts": FTS, "fts_postings": POSTINGS, "fts_docs": DOCS, "fts_terms": TERMS, "vectors": VECTORS,
    "vector_docs": VECTOR_DOCS, "vector_lists": VECTOR_LISTS,
}

#: What tombstones name rows by; an edge goes with either end, and a hash with the file it is of.
KEYS: dict[str, tuple[str, ...]] = {
    "nodes": ("id",), "names": ("id",), "edges": ("source_id", "target_id"), "edges_in": ("source_id", "target_id"), "temporal_facts": ("id",), "file_hashes": ("substring_index(file_path, '::', 1)",),
    "fts": ("node_id",), "fts_docs": ("node_id",), "vectors": ("id",), "vector_docs": ("id",),
}

#: What the rows of a segment are sorted by, so that a scan for a few values skips row groups and pages.
LAYOUT: dict[str, tuple[str, ...]] = {
    "nodes": ("id",), "names": ("low", "id"), "name_grams": ("term", "span"), "edges": ("source_id", "id"), "edges_in": ("target_id", "id"), "temporal_facts": ("id",),
    "file_hashes": ("file_path",), "fts": ("node_id",), "fts_docs": ("span", "at"), "fts_postings": ("term", "span"), "fts_terms": ("term",),
    "vector_docs": ("span", "at"), "vector_lists": ("term", "span"), "accounting": ("created_at", "id"),
}

#: Tables that are not dealt anew by range, as a scan for a term reads a few pages of each file: counts come dealt by term, and are sorted in each
#: partition; blocks, many times the rows they stand for, come sorted in each.
SORTED_IN_PLACE, MADE_IN_ORDER = {"fts_terms"}, {"fts_postings"}

#: The closed sets and what an unknown value becomes.
NODE_TYPES, NODE_DEFAULT = ("file", "module", "function", "struct", "impl", "trait", "enum", "concept", "document"), "concept"
EDGE_TYPES, EDGE_DEFAULT = ("calls", "imports", "implements", "depends_on", "contains", "documents"), "depends_on"
FACT_TYPES, FACT_DEFAULT = ("architecture", "api_contract", "decision", "error_pattern", "constraint", "learning"), "decision"


def laid_out(table: str, df: DataFrame, files: int | None = None) -> DataFrame:
    """Rows in their table's layout, in so many partitions if that is said."""
    keys = LAYOUT.get(table, ())
    if keys and table not in SORTED_IN_PLACE | MADE_IN_ORDER:
        df = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    elif files:
        df = df.coalesce(files)
    return df.sortWithinPartitions(*keys) if keys and table not in MADE_IN_ORDER else df


def parse_type(value: str, known: tuple[str, ...], default: str) -> str:
    return value if value in known else default


def typed(column: Column, known: tuple[str, ...], default: str) -> Column:
    """The column form of parse_type; null becomes the default."""
    return F.when(column.isin(*known), column).otherwise(F.lit(default))


def stable_id(*parts: Column) -> Column:
    """An id that depends on its parts only, so that a second run gives the same one."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
