"""The engine's operators bound to the driver's tables, each with its SQL twin where there is one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.plans import schema as S
from quarryline.operators import accounting, chunking, envscan, graph, ingest, search, temporal
from quarryline.sources.scratch import shared_dir, stash
from quarryline.sources.store import Snapshot, Store

P = "p"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (tables, spark) under a name."""

    def put(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir), spark)
        if sql:
            SQL[name] = sql
        return fn

    return put


class Tables:
    """The tables of a folder: called with a name, and with columns if not all are wanted."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at

    def __call__(self, name: str, *columns: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.at}/{name}.parquet")
        return df.select(*columns) if columns else df

    def kept(self, name: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """Tables made from these once a session and written, as a store keeps its indexes, so that a query only asks."""
        held = self.spark.__dict__.setdefault("_quarryline_kept", {})
        if (self.at, name) not in held:
            held[self.at, name] = {t: stash(S.laid_out(t, df), t) for t, df in make().items()}
        return held[self.at, name]


def _r(column, alias: str):
    return F.round(column, 6).alias(alias)


# Nodes from parts: name, with the brand as path and the type as summary.


def part_nodes(t) -> DataFrame:
    p = t("part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    size = F.col("p_size").cast("long")
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.lit(P).alias("project_id"), F.col("p_name").alias("name"), F.lit("concept").alias("node_type"), F.col("p_brand").alias("file_path"), F.lit(1).cast("long").alias("start_line"), size.alias("end_line"), F.col("p_type").alias("summary"))


_PART = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS file_path, p_size AS end_line, p_type AS summary FROM part"


def literal_sql(q: str, limit: int = search.TIER_LIMIT) -> str:
    return f"""SELECT id, score FROM (SELECT *, max(p) OVER () AS any_p FROM (
      SELECT id, name, starts_with(lower(name), '{q}') AS p, CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN starts_with(lower(name), '{q}') OR ends_with(lower(name), '{q}') THEN 0.9
        ELSE 0.5 + 0.4 * strlen('{q}') / greatest(strlen(name), 1) END AS score FROM ({_PART}) WHERE contains(lower(name), '{q}'))) WHERE p = any_p ORDER BY score DESC, id LIMIT {limit}"""


for _name, _q in {"literal_prefix": "old", "literal_suffix": "widget", "literal_contains": "ot plat", "literal_exact": "blue ring", "literal_none": "zzz"}.items():
    query(_name, f"SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM ({literal_sql(_q)})")(lambda t, s, q=_q: search.literal_search(part_nodes(t), q, P).select("id", _r("score", "score")))



def _literal_stored(t, q: str) -> DataFrame:
    """The name index is built by the first of these queries, and asked by all."""
    kept = t.kept("names", lambda: search.name_index(part_nodes(t)))
    return search.literal_search_stored(kept["names"], kept["name_grams"], q, P).select("id", _r("score", "score"))


for _name, _q in {"literal_stored_prefix": "old", "literal_stored_contains": "ot plat", "literal_stored_short": "ol", "literal_stored_none": "zzz"}.items():
    query(_name, f"SELECT id, round(CAST(score AS DOUBLE), 6) AS score FROM ({literal_sql(_q)})")(lambda t, s, q=_q: _literal_stored(t, q))


_POINTERS = f"""SELECT n.id, coalesce(file_path, '') AS source, name AS chunk, '1-' || end_line AS lines, round(CAST(score AS DOUBLE), 6) AS relevance, coalesce(summary, '') AS summary, 'concept' AS node_type,
  CAST(NULL AS VARCHAR) AS last_modified,
  CAST((4 * len(list_filter(regexp_split_to_array(file_path || ' ' || name || ' 1-' || end_line || ' ' || summary, '\\s+'), lambda w: w <> '')) + 2) // 3 + 2 AS BIGINT) AS tokens
  FROM ({literal_sql('old')}) h JOIN ({_PART}) n ON n.id = h.id"""


@query("pointers", _POINTERS)
def _(t, s):
    nodes = part_nodes(t)
    return search.pointers(search.literal_search(nodes, "old", P), nodes).withColumn("relevance", F.round("relevance", 6))


@query("response_report", f"""SELECT p AS pointer_tokens, CAST(100 AS BIGINT) AS fetched_tokens, p + 100 AS total_tokens, 15 * p AS traditional_rag_estimate,
  round(greatest(0, (1 - (p + 100) / (15.0 * p)) * 100), 6) AS savings_pct FROM (SELECT CAST(sum(tokens) AS BIGINT) AS p FROM ({_POINTERS}))""")
def _(t, s):
    nodes = part_nodes(t)
    return search.response_report(search.pointers(search.literal_search(nodes, "old", P), nodes), 100).withColumn("savings_pct", F.round("savings_pct", 6))


# Full text over documents.


def doc_nodes(t) -> DataFrame:
    d = t("documents", "doc_id", "lang", "source")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.lit(P).alias("project_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.lit("document").alias("node_type"), F.concat_ws("/", "source", F.col("lang")).alias("file_path"), F.lit(None).cast("long").alias("start_line"), F.lit(None).cast("long").alias("end_line"), F.col("lang").alias("summary"))


def doc_fts(t) -> DataFrame:
    d = t("documents", "doc_id", "text", "lang", "source")
    return d.select(F.col("doc_id").cast("string").alias("node_id"), F.lit(P).alias("project_id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("text").alias("content"), F.concat_ws("/", "source", "lang").alias("file_path"))


def _toks(column: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\\p{{L}}\\p{{N}}]+')"


_DOC_FTS = f"""SELECT CAST(doc_id AS VARCHAR) AS id, list_concat(list_concat(list_concat({_toks("'doc ' || doc_id")}, [chr(1)]), list_concat({_toks('text')}, [chr(1)])), {_toks("concat_ws('/', source, lang)")}) AS toks FROM documents"""
_PART_FTS = f"""SELECT CAST(p_partkey AS VARCHAR) AS id, list_concat(list_concat(list_concat({_toks('p_name')}, [chr(1)]), list_concat({_toks('p_type')}, [chr(1)])), {_toks('p_brand')}) AS toks FROM part"""


def fts_sql(source: str, q: str, limit: int = search.TIER_LIMIT) -> str:
    """The strategy cascade as SQL: counts of every phrase, then hits by strategy, then the scores of the one chosen."""
    plans = search.strategies(q)
    names, cols, hits = [], [], []

    def count(phrase: list[str], prefix: bool) -> str:
        k = len(phrase)
        test = lambda i, w, last: (f"starts_with(toks[i + {i}], '{w}')" if prefix and last else f"toks[i + {i}] = '{w}'")
        cond = " AND ".join(test(i, w, i == k - 1) for i, w in enumerate(phrase))
        return f"len(list_filter(range(1, greatest(len(toks) - {k} + 2, 1)), lambda i: {cond}))"

    for s, (_, phrases, every) in enumerate(plans):
        for i, (p, prefix) in enumerate(phrases):
            names.append(f"f{s}_{i}")
            cols.append(f"{count(p, prefix)} AS f{s}_{i}")
        hits.append("(" + (" AND " if every else " OR ").join(f"f{s}_{i} > 0" for i in range(len(phrases))) + ")")
    chosen = "CASE " + " ".join(f"WHEN h{s} >= {search.STRATEGY_MIN} THEN {s}" for s in range(len(plans) - 1)) + f" ELSE {len(plans) - 1} END" if len(plans) > 1 else "0"

    def raw(s: int) -> str:
        return " + ".join(
            f"(CASE WHEN ln((n - d{s}_{i} + 0.5) / (d{s}_{i} + 0.5)) > 0 THEN ln((n - d{s}_{i} + 0.5) / (d{s}_{i} + 0.5)) ELSE 1e-6 END) * f{s}_{i} * 2.2 / (f{s}_{i} + 1.2 * (0.25 + 0.75 * size / avg_size))"
            for i in range(len(plans[s][1]))
        )

    return f"""WITH f AS (SELECT id, len(toks) - 2 AS size, {', '.join(cols)} FROM ({source})),
      st AS (SELECT count(*) AS n, avg(size) AS avg_size, {', '.join(f'count(*) FILTER ({c} > 0) AS d{c[1:]}' for c in names)}, {', '.join(f'count(*) FILTER {h} AS h{s}' for s, h in enumerate(hits))} FROM f),
      ch AS (SELECT *, {chosen} AS c FROM st),
      sc AS (SELECT id, c, CASE {' '.join(f'WHEN c = {s} THEN {raw(s)}' for s in range(len(plans)))} END AS raw FROM f, ch WHERE {' OR '.join(f'(c = {s} AND {h})' for s, h in enumerate(hits))})
      SELECT id, CASE {' '.join(f"WHEN c = {s} THEN '{plans[s][0]}'" for s in range(len(plans)))} END AS strategy, CAST(raw AS DOUBLE) AS raw,
        CAST(CASE WHEN abs(raw) < 0.001 THEN 0.5 ELSE least(1 - 1 / (1 + abs(raw)), 1) END AS DOUBLE) AS score FROM sc ORDER BY round(raw, 9) DESC, id LIMIT {limit}"""


def _fts(index: DataFrame, nodes: DataFrame, q: str) -> DataFrame:
    strategy, hits = search.fts_search(search.fts_index(index), nodes, q, P)
    return hits.select("id", F.lit(strategy).alias("strategy"), _r("raw", "raw"), _r("score", "score"))


for _name, _q in {"fts_single": "thnd", "fts_phrase": "of the", "fts_prefix_and": "thand onesen", "fts_or": "erblest eranenes whou", "fts_common": "the", "fts_path": "src3/en"}.items():
    query(_name, f"SELECT id, strategy, round(raw, 6) AS raw, round(score, 6) AS score FROM ({fts_sql(_DOC_FTS, _q)})")(lambda t, s, q=_q: _fts(doc_fts(t), doc_nodes(t), q))



def _text_tables(rows: DataFrame) -> dict[str, DataFrame]:
    made = search.text_index(rows)
    return made | {"fts_terms": search.index_counts(made["fts_docs"], made["fts_postings"])}


def _stored_hits(read: Callable[[str], DataFrame], q: str) -> DataFrame:
    strategy, hits = search.fts_search_stored(read("fts_postings"), read("fts_docs"), read("fts_terms"), q, P)
    return hits.select("id", F.lit(strategy).alias("strategy"), _r("raw", "raw"), _r("score", "score"))


def _fts_stored(t, q: str) -> DataFrame:
    """The index of all documents is built by the first of these queries, and asked by all."""
    return _stored_hits(t.kept("text", lambda: _text_tables(doc_fts(t))).__getitem__, q)


for _name, _q in {"fts_stored_single": "thnd", "fts_stored_phrase": "of the", "fts_stored_prefix_and": "thand onesen", "fts_stored_or": "erblest eranenes whou", "fts_stored_common": "the", "fts_stored_path": "src3/en"}.items():
    query(_name, f"SELECT id, strategy, round(raw, 6) AS raw, round(score, 6) AS score FROM ({fts_sql(_DOC_FTS, _q)})")(lambda t, s, q=_q: _fts_stored(t, q))

query("fts_term_counts", f"""WITH f AS (SELECT list_filter(toks, lambda v: v <> chr(1)) AS ws FROM ({_DOC_FTS}))
  SELECT w AS term, count(*) AS df, CAST(0 AS BIGINT) AS total FROM (SELECT unnest(list_distinct(ws)) AS w FROM f) GROUP BY w UNION ALL SELECT '', count(*), CAST(sum(len(ws)) AS BIGINT) FROM f""")(lambda t, s: search.term_counts(doc_fts(t)))


@query("fts_build", f"""SELECT w AS term, count(DISTINCT id) AS rows, count(*) AS places FROM (SELECT id, unnest(list_filter(toks, lambda v: v <> chr(1))) AS w FROM ({_DOC_FTS})) GROUP BY w""")
def _(t, s):
    """The inverted index built anew, and summed up by term."""
    blocks = search.text_index(doc_fts(t))["fts_postings"]
    return blocks.groupBy("term").agg(F.sum(F.size("at")).alias("rows"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, b: a + b)).alias("places"))


_EDITED = f"""SELECT id, toks FROM ({_DOC_FTS.replace('text', "text || CASE WHEN doc_id % 3 = 0 THEN ' later thnd' ELSE '' END")}) WHERE CAST(id AS BIGINT) % 5 <> 0"""


@query("fts_after_edits", f"SELECT id, strategy, round(raw, 6) AS raw, round(score, 6) AS score FROM ({fts_sql(_EDITED, 'erblest thnd whou')})")
def _(t, s):
    """A store after three rounds of edits: rows come, others change, and some go; it answers as an index of what is left."""
    store, fts, at = _new_store(s), doc_fts(t), F.col("node_id").cast("long")
    none = fts.limit(0).select(F.col("node_id").alias("id"))
    longer = fts.withColumn("content", F.concat("content", F.lit(" later thnd")))
    ids = lambda df: df.select(F.col("node_id").alias("id"))
    for texts, gone in (
        (fts.where(at % 4 != 0), none),
        (longer.where(at % 3 == 0).unionByName(fts.where((at % 4 == 0) & (at % 3 != 0))), ids(fts.where((at % 3 == 0) & (at % 4 != 0)))),
        (fts.limit(0), ids(fts.where(at % 5 == 0))),
    ):
        store.update(lambda now, texts=texts, gone=gone: ingest.text_changes(now, P, texts, gone))
    return _stored_hits(store.snapshot().read, "erblest thnd whou")


query("bm25_normalise", "SELECT event_id, CAST(round(CASE WHEN abs(value - 6.55) < 0.001 THEN 0.5 ELSE least(1 - 1 / (1 + abs(value - 6.55)), 1) END, 6) AS DOUBLE) AS score FROM events")(
    lambda t, s: t("events", "event_id", "value").select("event_id", _r(X.bm25_normal(F.col("value") - 6.55), "score"))
)

# Vectors.


def _hashvec_sql(source: str, text: str, q: str, limit: int = search.TIER_LIMIT) -> str:
    dense = X.query_vector(q)
    return f"""WITH tok AS (SELECT id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)), lambda x: strlen(x) > 1)) AS w FROM ({source})),
      cnt AS (SELECT id, CAST('0x' || substr(md5(w), 1, 2) AS INTEGER) AS b, count(*) AS n FROM tok GROUP BY 1, 2),
      vec AS (SELECT id, b, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS v FROM cnt),
      q AS (SELECT unnest(range(0, 256)) AS b, unnest([{', '.join(repr(v) for v in dense)}]) AS v)
      SELECT id, sum(vec.v * q.v) AS score FROM vec JOIN q USING (b) GROUP BY id HAVING sum(vec.v * q.v) >= 0.2 ORDER BY round(sum(vec.v * q.v), 9) DESC, id LIMIT {limit}"""


def _text_vectors(t) -> DataFrame:
    rows = t("documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), F.lit(P).alias("project_id"), F.lit("").alias("name"), F.col("text").alias("summary"), F.lit(None).cast("string").alias("file_path"))
    return search.vector_index(rows)


def _name_vectors(t) -> DataFrame:
    return search.vector_index(part_nodes(t))


query("hashvec_topk", f"SELECT id, round(score, 6) AS score FROM ({_hashvec_sql('SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents', 'text', 'thnd whou erblest of the')})")(
    lambda t, s: search.vector_search(_text_vectors(t), "thnd whou erblest of the", P).select("id", _r("score", "score"))
)


def _stored_nearest(t, kind: str, rows: Callable, q: str) -> DataFrame:
    """The inverted lists are built by the first of these queries, and asked by all."""
    kept = t.kept(kind, lambda: search.vector_lists(rows(t)))
    return search.vector_search_stored(kept["vector_lists"], kept["vector_docs"], q, P).select("id", _r("score", "score"))


query("hashvec_stored_topk", SQL["hashvec_topk"])(lambda t, s: _stored_nearest(t, "text-vectors", _text_vectors, "thnd whou erblest of the"))
for _name, _q in {"hashvec_stored_names": "promo widget", "hashvec_stored_rare": "zinc economy brass"}.items():
    query(_name, f"""SELECT id, round(score, 6) AS score FROM ({_hashvec_sql(_PART, "concat_ws(' ', name, summary, file_path)", _q)})""")(lambda t, s, q=_q: _stored_nearest(t, "name-vectors", _name_vectors, q))


@query("vector_topk", """WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 6) AS score
  FROM embeddings, q WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) >= 0.2 ORDER BY round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 9) DESC, vec_id LIMIT 20""")
def _(t, s):
    rows = t("embeddings", "vec_id", "embedding")
    q = [float(v) for v in (rows.where("vec_id = 0").first() or [0, []])["embedding"]]
    dot = F.aggregate(F.zip_with("embedding", F.array(*map(F.lit, q)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    score = dot / (norm * sum(v * v for v in q) ** 0.5)
    return rows.select("vec_id", score.alias("score")).where("score >= 0.2").orderBy(F.desc(F.round("score", 9)), "vec_id").limit(20).select("vec_id", _r("score", "score"))


# The cascade.


def _part_fts(t) -> DataFrame:
    return t("part", "p_partkey", "p_name", "p_brand", "p_type").select(F.col("p_partkey").cast("string").alias("node_id"), F.lit(P).alias("project_id"), F.col("p_name").alias("name"), F.col("p_type").alias("content"), F.col("p_brand").alias("file_path"))


def _cascade(t, q: str) -> DataFrame:
    nodes = part_nodes(t)
    return search.cascade(search.literal_search(nodes, q, P), lambda: search.fts_search(search.fts_index(_part_fts(t)), nodes, q, P)[1], lambda: search.vector_search(search.vector_index(nodes), q, P)).select("id", _r("score", "score"), "tier")


def cascade_sql(q: str) -> str:
    return f"""WITH l0 AS ({literal_sql(q)}), g AS (SELECT CASE WHEN count(*) >= 10 THEN min(score) ELSE 0 END AS m FROM (SELECT score FROM l0 ORDER BY score DESC LIMIT 10)),
      every AS (SELECT id, CAST(score AS DOUBLE) AS score, '{search.LITERAL}' AS tier, 0.3 AS bonus FROM l0
        UNION ALL SELECT id, score, '{search.FULL_TEXT}', 0.1 FROM ({fts_sql(_PART_FTS, q)}), g WHERE m < 0.9
        UNION ALL SELECT id, score, '{search.VECTOR}', 0.0 FROM ({_hashvec_sql(_PART, "concat_ws(' ', name, summary, file_path)", q)}), g WHERE m < 0.8),
      best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score + bonus, 9) DESC, tier) AS r FROM every)
      SELECT id, round(score, 6) AS score, tier FROM best WHERE r = 1 ORDER BY round(score, 9) DESC, tier, id LIMIT 10"""


for _name, _q in {"hybrid_search": "promo blue widget", "hybrid_literal_only": "red", "hybrid_skip_vector": "ot plat", "hybrid_single": "economy"}.items():
    query(_name, cascade_sql(_q))(lambda t, s, q=_q: _cascade(t, q))


@query("dedup_rank", """WITH x AS (SELECT CAST(p_partkey % 100 AS VARCHAR) AS id, p_size / 50.0 AS score, CASE p_partkey % 3 WHEN 0 THEN 'L0Literal' WHEN 1 THEN 'L1Fts' ELSE 'L2Vector' END AS tier,
    CASE p_partkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.1 ELSE 0.0 END AS b FROM part),
  y AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score + b, 9) DESC, tier) AS r FROM x)
  SELECT id, round(CAST(score AS DOUBLE), 6) AS score, tier FROM y WHERE r = 1 ORDER BY round(score, 9) DESC, tier, id LIMIT 10""")
def _(t, s):
    tier = F.element_at(F.array(F.lit(search.LITERAL), F.lit(search.FULL_TEXT), F.lit(search.VECTOR)), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = t("part", "p_partkey", "p_size").select((F.col("p_partkey") % 100).cast("string").alias("id"), (F.col("p_size") / 50.0).alias("score"), tier.alias("tier"))
    return search.dedup_rank(rows, 10).select("id", _r("score", "score"), "tier")




@query("query_words", r"""SELECT id, u.w AS word, CAST(u.i AS INTEGER) AS place FROM (SELECT id, unnest(list_zip(ws[1:10], range(len(ws[1:10])))) AS z FROM (
    SELECT CAST(c_custkey AS VARCHAR) AS id, list_filter(regexp_extract_all('GET /' || c_name || '/or_ders AND ' || c_mktsegment || ' not ' || repeat(c_name || ' ', 9), '\w+'), lambda w: upper(w) NOT IN ('AND', 'OR', 'NOT', 'NEAR')) AS ws
    FROM customer)), LATERAL (SELECT z[1] AS w, z[2] AS i) u""")
def _(t, s):
    asked = F.concat(F.lit("GET /"), "c_name", F.lit("/or_ders AND "), "c_mktsegment", F.lit(" not "), F.repeat(F.concat("c_name", F.lit(" ")), 9))
    return t("customer", "c_custkey", "c_name", "c_mktsegment").select(F.col("c_custkey").cast("string").alias("id"), F.posexplode(X.query_words_of(asked)).alias("place", "word"))


# Graph and store.


def graph_nodes(t) -> DataFrame:
    c = t("customer", "c_custkey", "c_name").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"))
    o = t("orders", "o_orderkey", "o_orderpriority").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("name"))
    return c.unionByName(o).withColumn("project_id", F.lit(P))


def graph_edges(t) -> DataFrame:
    o = t("orders", "o_orderkey", "o_custkey")
    return o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit(P).alias("project_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target_id"), F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))


_GN = "SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders"
query("neighbors", f"""SELECT CAST(o_orderkey AS VARCHAR) AS edge_id, n.id, n.name FROM orders JOIN ({_GN}) n ON n.id = 'o' || o_orderkey WHERE o_custkey = 7""")(
    lambda t, s: graph.neighbors(graph_nodes(t).drop("project_id"), graph_edges(t), "c7", P).select("edge_id", "id", "name")
)


def _kept_graph(t) -> dict[str, DataFrame]:
    return {"edges": graph_edges(t)} | graph.incoming(graph_edges(t)) | {"nodes": graph_nodes(t).drop("project_id")}


@query("neighbors_stored", f"""SELECT CAST(o_orderkey AS VARCHAR) AS edge_id, n.id, n.name FROM orders JOIN ({_GN}) n ON n.id = 'c' || o_custkey WHERE o_orderkey = 7
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), n.id, n.name FROM orders JOIN ({_GN}) n ON n.id = 'o' || o_orderkey WHERE o_custkey = 7""")
def _(t, s):
    """From the kept layouts: an order's edge comes in, a customer's go out."""
    kept = t.kept("graph", lambda: _kept_graph(t))
    found = [graph.neighbors_stored(kept["edges"], kept["edges_in"], kept["nodes"], i).select("edge_id", "id", "name") for i in ("o7", "c7")]
    return found[0].unionByName(found[1])


query("neighbor_counts", "SELECT node_id, count(*) AS n FROM (SELECT 'c' || o_custkey AS node_id FROM orders UNION ALL SELECT 'o' || o_orderkey FROM orders) GROUP BY 1")(
    lambda t, s: graph.neighbor_pairs(graph_edges(t)).groupBy("node_id").agg(F.count("*").alias("n"))
)
query("node_scan", _GN)(lambda t, s: graph.all_nodes(graph_nodes(t), P).select("id", "name"))
query("point_lookup", f"SELECT id, name FROM ({_GN}) WHERE id = 'c42'")(lambda t, s: graph.get_node(graph_nodes(t), "c42", P).select("id", "name"))
query("distinct_paths", "SELECT DISTINCT source AS file_path FROM documents WHERE source IS NOT NULL")(
    lambda t, s: graph.file_paths(t("documents", "source").select(F.lit(P).alias("project_id"), F.lit("file").alias("node_type"), F.col("source").alias("file_path")), P)
)


@query("upsert_nodes", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'renamed ' || c_name ELSE c_name END AS c_name FROM customer")
def _(t, s):
    c = t("customer", "c_custkey", "c_name")
    return graph.upsert(c.where("c_custkey % 3 <> 2 OR c_custkey % 2 = 1"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat(F.lit("renamed "), "c_name")), ["c_custkey"])


@query("edge_dedup", "SELECT o_custkey AS source_id, o_orderpriority AS target_id, o_orderstatus AS edge_type, min(o_orderkey) AS id FROM orders GROUP BY 1, 2, 3")
def _(t, s):
    e = t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("target_id"), F.col("o_orderstatus").alias("edge_type"), F.col("o_orderkey").alias("id"), F.lit(0).alias("created_at"))
    return graph.insert_edges(s.createDataFrame([], e.schema), e).drop("created_at")


@query("edge_insert_ignore", """SELECT o_custkey AS source_id, o_orderpriority AS target_id, o_orderstatus AS edge_type, coalesce(min(o_orderkey) FILTER (o_orderkey % 5 = 0), min(o_orderkey)) AS id FROM orders GROUP BY 1, 2, 3""")
def _(t, s):
    e = t("orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("target_id"), F.col("o_orderstatus").alias("edge_type"), F.col("o_orderkey").alias("id"), F.lit(0).alias("created_at"))
    old = graph.insert_edges(s.createDataFrame([], e.schema), e.where("id % 5 = 0"))
    return graph.insert_edges(old, e.where("id % 5 <> 0")).drop("created_at")


_ID = "sha256(concat_ws(chr(31), 'p', {path}, '{kind}', {name}, '{ordinal}'))"
_FILE_ID, _PART_ID = _ID.format(path="p_brand", kind="file", name="p_name", ordinal=0), _ID.format(path="p_brand", kind="concept", name="p_name", ordinal=1)


@query("graph_builders", f"""SELECT {_ID.format(path="p_brand", kind="module", name="p_name", ordinal="' || p_size || '")} AS id, p_name AS name, 'module' AS node_type, CAST(p_partkey AS BIGINT) AS start_line FROM part""")
def _(t, s):
    p = t("part", "p_partkey", "p_name", "p_brand", "p_size")
    none = F.lit(None).cast("string")
    rows = p.select(F.col("p_name").alias("name"), F.lit("module").alias("node_type"), F.col("p_brand").alias("file_path"), F.col("p_partkey").alias("start_line"), F.lit(None).cast("long").alias("end_line"), none.alias("summary"), none.alias("content_hash"), F.col("p_size").alias("ordinal"))
    return graph.node_rows(rows, P).select("id", "name", "node_type", "start_line")


@query("contains_edges", f"""SELECT sha256(concat_ws(chr(31), 'p', a, b, 'contains')) AS id, a AS source_id, b AS target_id, 'contains' AS edge_type, CAST(1.0 AS DOUBLE) AS weight FROM (SELECT {_FILE_ID} AS a, {_PART_ID} AS b FROM part GROUP BY p_brand, p_name)""")
def _(t, s):
    one = t("part", "p_brand", "p_name").distinct().select(F.col("p_name").alias("name"), F.col("p_brand").alias("file_path"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit(None).cast("string").alias("summary"), F.lit(None).cast("string").alias("content_hash"))
    files = graph.node_rows(one.withColumns({"node_type": F.lit("file"), "ordinal": F.lit(0)}), P).select(F.col("id").alias("source_id"), "name", "file_path")
    parts = graph.node_rows(one.withColumns({"node_type": F.lit("concept"), "ordinal": F.lit(1)}), P).select(F.col("id").alias("target_id"), "name", "file_path")
    pairs = files.join(parts, ["name", "file_path"]).select("source_id", "target_id", F.lit("contains").alias("edge_type"), F.lit(1.0).alias("weight"))
    return graph.edge_rows(pairs, P).select("id", "source_id", "target_id", "edge_type", "weight")


@query("cascade_delete", """SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) + (SELECT count(*) FROM orders) AS n_nodes,
  (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3) AS n_edges, (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS n_fts""")
def _(t, s):
    doomed = t("customer", "c_custkey", "c_nationkey").where("c_nationkey = 3").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    fts = t("customer", "c_custkey").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node_id"))
    counts = [df.agg(F.count("*").alias(n)) for df, n in zip(graph.cascade_delete(graph_nodes(t), graph_edges(t), fts, doomed), ("n_nodes", "n_edges", "n_fts"), strict=True)]
    one = counts[0].withColumn("k", F.lit(1))
    for c in counts[1:]:
        one = one.join(c.withColumn("k", F.lit(1)), "k")
    return one.drop("k")


# Hashes and ingestion.


def _doc_files(t) -> DataFrame:
    return t("documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def _stored(t) -> DataFrame:
    key = F.col("doc_id")
    return t("documents", "doc_id", "text").where(key % 3 != 0).select(F.lit(P).alias("project_id"), key.cast("string").alias("file_path"), F.when(key % 7 == 0, "other").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("content_hash"))


query("file_hash", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(coalesce(text, '')) AS hash FROM documents")(lambda t, s: _doc_files(t).select("path", ingest.content_hash(F.col("content")).alias("hash")))
query("changed_files", "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")(lambda t, s: ingest.classify_files(_doc_files(t), _stored(t), P).where("changed").select("path"))
query("unchanged_files", "SELECT CAST(doc_id AS VARCHAR) AS path FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0")(lambda t, s: ingest.classify_files(_doc_files(t), _stored(t), P).where("NOT changed").select("path"))
query("stale_paths", "SELECT CAST(doc_id AS VARCHAR) AS file_path FROM documents WHERE doc_id % 3 <> 0 EXCEPT SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 <> 0")(
    lambda t, s: ingest.stale_paths(_stored(t), _doc_files(t).where("CAST(path AS BIGINT) % 5 <> 0"))
)
query("ingest_report", "SELECT count(*) AS total_files, count(*) FILTER (doc_id % 3 = 0 OR doc_id % 7 = 0) AS indexed, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0) AS skipped FROM documents")(
    lambda t, s: ingest.classify_files(_doc_files(t), _stored(t), P).agg(F.count("*").alias("total_files"), F.count_if("changed").alias("indexed"), F.count_if(~F.col("changed")).alias("skipped"))
)
query("changed_chunks", "SELECT CAST(doc_id AS VARCHAR) || '::' || coalesce(lang, '') || '::' || doc_id % 4 AS key FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 0")(
    lambda t, s: ingest.changed_chunks(_doc_chunks(t), _doc_chunks(t).where("CAST(path AS BIGINT) % 3 <> 0").select(F.lit(P).alias("project_id"), ingest.chunk_key().alias("file_path"), F.when(F.col("path").cast("long") % 7 == 0, "other").otherwise(ingest.content_hash(F.col("content"))).alias("content_hash")), P).select("key")
)


def _doc_chunks(t) -> DataFrame:
    return t("documents", "doc_id", "text", "lang").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("lang", F.lit("")).alias("name"), (F.col("doc_id") % 4).alias("ordinal"), F.coalesce("text", F.lit("")).alias("content"))


@query("hash_upsert", "SELECT CAST(doc_id AS VARCHAR) AS file_path, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 <> 0 THEN sha256(coalesce(text, '')) ELSE 'other' END AS content_hash FROM documents")
def _(t, s):
    new = _doc_files(t).where("CAST(path AS BIGINT) % 3 = 0").select(F.lit(P).alias("project_id"), F.col("path").alias("file_path"), ingest.content_hash(F.col("content")).alias("content_hash"))
    return graph.upsert(_stored(t), new, ["project_id", "file_path"]).select("file_path", "content_hash")


@query("chunk_hash_upsert", """SELECT CAST(doc_id AS VARCHAR) || '::' || coalesce(lang, '') || '::' || doc_id % 4 AS file_path, CASE WHEN doc_id % 2 = 0 THEN sha256(coalesce(text, '')) ELSE sha256('old ' || doc_id) END AS content_hash FROM documents""")
def _(t, s):
    """Hashes of chunks, kept under path, name and ordinal: those of changed chunks replace the old ones."""
    chunks = _doc_chunks(t)
    row = lambda h: (F.lit(P).alias("project_id"), ingest.chunk_key().alias("file_path"), h.alias("content_hash"))
    old = chunks.select(*row(ingest.content_hash(F.concat(F.lit("old "), "path"))))
    new = chunks.where("CAST(path AS BIGINT) % 2 = 0").select(*row(ingest.content_hash(F.col("content"))))
    return graph.upsert(old, new, ["project_id", "file_path"]).select("file_path", "content_hash")


@query("fts_replace", "SELECT CAST(doc_id AS VARCHAR) AS node_id, CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE md5(coalesce(text, '')) END AS content FROM documents WHERE doc_id % 4 <> 1")
def _(t, s):
    """Full-text rows of changed documents are replaced, those of vanished ones go."""
    fts = doc_fts(t).withColumn("content", F.md5(F.coalesce("content", F.lit(""))))
    doomed = fts.where("CAST(node_id AS BIGINT) % 4 < 2").select(F.col("node_id").alias("id"))
    no_edges = s.createDataFrame([], "source_id string, target_id string")
    kept = graph.cascade_delete(doc_nodes(t), no_edges, fts, doomed)[2]
    new = fts.where("CAST(node_id AS BIGINT) % 4 = 0").withColumn("content", F.concat(F.lit("new "), "node_id"))
    return kept.unionByName(new).select("node_id", "content")


query("content_tokens", r"SELECT doc_id, CAST((4 * len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> '')) + 2) // 3 AS BIGINT) AS tokens FROM documents")(
    lambda t, s: t("documents", "doc_id", "text").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))
)
_LINES = "CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
query("line_count", f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n FROM documents")(lambda t, s: t("documents", "doc_id", "text").select("doc_id", X.count_lines(F.col("text")).alias("n")))
query("line_slice", f"SELECT doc_id, coalesce(array_to_string(({_LINES})[2:4], chr(10)), '') AS part FROM documents")(lambda t, s: t("documents", "doc_id", "text").select("doc_id", X.line_slice(F.col("text"), F.lit(2), F.lit(4)).alias("part")))

@query("fetch_content", f"""SELECT id, content, CAST((4 * len(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')) + 2) // 3 AS BIGINT) AS token_count FROM (
    SELECT CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 7 WHEN 0 THEN '' WHEN 1 THEN '[File not found: /gone/' || doc_id || ']' ELSE coalesce(array_to_string(({_LINES})[CASE WHEN doc_id % 3 = 0 THEN 1 ELSE doc_id % 3 END:CASE WHEN doc_id % 4 = 0 THEN len({_LINES}) ELSE doc_id % 4 + 1 END], chr(10)), '') END AS content FROM documents)""")
def _(t, s):
    """What fetching a node gives, for nodes of every kind: of some lines, to the end, without a file, and of a file that is gone."""
    d, key = t("documents", "doc_id", "text"), F.col("doc_id")
    path = F.when(key % 7 == 1, F.concat(F.lit("/gone/"), key.cast("string"))).when(key % 7 != 0, F.concat(F.lit("/w/"), key.cast("string")))
    nodes = d.select(key.cast("string").alias("id"), path.alias("file_path"), (key % 3).alias("start_line"), F.when(key % 4 != 0, key % 4 + 1).alias("end_line"))
    return search.fetched(nodes, d.select(F.concat(F.lit("/w/"), key.cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content")))


# Facts: a conversation is a node, a turn a moment; the next turn of the same role supersedes.


def fact_table(t) -> DataFrame:
    c = t("conversations", "conv_id", "turn", "role", "text")
    kind = F.when(F.col("role") == "system", "constraint").when(F.col("role") == "user", "decision").otherwise("learning")
    key = F.format_string("%d-%d", "conv_id", "turn")
    later = Window.partitionBy("conv_id", "role").orderBy("turn")
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + n)
    nxt = F.lead("turn").over(later)
    return c.select(key.alias("id"), F.lit(P).alias("project_id"), F.col("conv_id").cast("string").alias("node_id"), kind.alias("fact_type"), F.col("text").alias("content"), at(F.col("turn")).alias("valid_from"), F.when(nxt.isNotNull(), at(nxt)).alias("valid_to"), F.when(nxt.isNotNull(), F.format_string("%d-%d", F.col("conv_id"), nxt)).alias("superseded_by"), F.lit(None).cast("string").alias("source_reference"), at(F.col("turn")).alias("created_at"))


_FACT = """SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS node_id, CASE role WHEN 'system' THEN 'constraint' WHEN 'user' THEN 'decision' ELSE 'learning' END AS fact_type, text AS content,
  1700000000 + conv_id * 1000 + turn AS valid_from, lead(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS nxt FROM conversations"""


def _seconds():
    return F.unix_seconds("valid_from").alias("valid_from")


query("active_facts", f"SELECT id, fact_type, content, CAST(valid_from AS BIGINT) AS valid_from FROM ({_FACT}) WHERE nxt IS NULL")(lambda t, s: temporal.active_facts(fact_table(t), P).select("id", "fact_type", "content", _seconds()))
query("facts_by_type", f"SELECT id, CAST(valid_from AS BIGINT) AS valid_from FROM ({_FACT}) WHERE nxt IS NULL AND fact_type = 'decision'")(lambda t, s: temporal.active_facts(fact_table(t), P, "no such type").select("id", _seconds()))
query("fact_history", f"SELECT id, CAST(valid_from AS BIGINT) AS valid_from, node_id || '-' || nxt AS superseded_by FROM ({_FACT}) WHERE node_id = '3'")(lambda t, s: temporal.fact_history(fact_table(t), "3", P).select("id", _seconds(), "superseded_by"))
query("supersession_chain", f"SELECT CAST(row_number() OVER (ORDER BY valid_from) - 1 AS INTEGER) AS step, id FROM ({_FACT}) f WHERE node_id = '3' AND fact_type = (SELECT fact_type FROM ({_FACT}) WHERE id = '3-0')")(
    lambda t, s: temporal.supersession_chain(fact_table(t), "3-0")
)


@query("supersede", f"SELECT id, fact_type, CASE WHEN nxt IS NULL AND fact_type = 'learning' THEN 'new' ELSE node_id || '-' || nxt END AS superseded_by, CAST(CASE WHEN nxt IS NULL AND fact_type = 'learning' THEN 1 WHEN nxt IS NULL THEN 0 ELSE valid_from - 1700000000 END > 0 AS BOOLEAN) AS closed_or_late FROM ({_FACT})")
def _(t, s):
    facts = fact_table(t)
    ended = temporal.active_facts(facts, P, "learning").select("id", "project_id", F.lit("new").alias("superseded_by"))
    out = temporal.invalidate(facts, ended, F.timestamp_seconds(F.lit(1_900_000_000)))
    late = F.when(F.col("superseded_by") == "new", 1).when(F.col("valid_to").isNull(), 0).otherwise(F.unix_seconds("valid_from") - 1_700_000_000)
    return out.select("id", "fact_type", "superseded_by", (late > 0).alias("closed_or_late"))


# Accounting: an event's day is its session, its value the pointer tokens, a purchase's value is fetched as well.


def log_table(t) -> DataFrame:
    e = t("events", "event_id", "ts", "event_type", "value")
    v = F.floor("value").cast("long")
    return e.select(F.col("event_id").alias("id"), F.lit(P).alias("project_id"), F.to_date("ts").cast("string").alias("session_id"), F.col("event_type").alias("query_text"), v.alias("pointer_tokens"), F.when(F.col("event_type") == "purchase", v).otherwise(0).alias("fetched_tokens"), (v * X.TRADITIONAL_FACTOR).alias("traditional_est"), F.col("ts").cast("timestamp").alias("created_at"))


_LOG = "SELECT ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, CAST(floor(value) AS BIGINT) AS p, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS f, 15 * CAST(floor(value) AS BIGINT) AS e FROM events"


def _stats_sql(where: str = "", key: str = "") -> str:
    return f"""SELECT *, CASE WHEN total_traditional_estimate > 0 THEN round(cumulative_savings_tokens / total_traditional_estimate * 100, 6) ELSE 0.0 END AS cumulative_savings_pct FROM (
      SELECT *, greatest(total_traditional_estimate - total_pointer_tokens - total_fetched_tokens, 0) AS cumulative_savings_tokens FROM (SELECT {key + ',' if key else ''} count(*) AS total_queries,
        CAST(coalesce(sum(p), 0) AS BIGINT) AS total_pointer_tokens, CAST(coalesce(sum(f), 0) AS BIGINT) AS total_fetched_tokens, CAST(coalesce(sum(e), 0) AS BIGINT) AS total_traditional_estimate
        FROM ({_LOG}) {where} {'GROUP BY ' + key if key else ''}))"""


def _pct(df: DataFrame) -> DataFrame:
    return df.withColumn("cumulative_savings_pct", F.round("cumulative_savings_pct", 6))




def _now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


query("stats_cumulative", _stats_sql())(lambda t, s: _pct(accounting.stats(log_table(t), P)))
query("stats_since", _stats_sql("WHERE ts >= TIMESTAMP '2024-01-19 12:00:00'"))(lambda t, s: _pct(accounting.stats(log_table(t), P, since=accounting.seconds_ago(_now(), X.parse_since("24h")))))
query("stats_session", _stats_sql("WHERE session_id = '2024-01-15'"))(lambda t, s: _pct(accounting.stats(log_table(t), P, session="2024-01-15")))
query("stats_today", _stats_sql("WHERE CAST(ts + INTERVAL 2 HOUR AS DATE) = DATE '2024-01-20'"))(lambda t, s: _pct(accounting.stats(log_table(t), P, day=F.to_date(F.lit("2024-01-20")), zone="+02:00")))


def _kept_log(t, s) -> Snapshot:
    """The log appended to a store in ten parts, of which it merges eight and makes rollups."""
    store, log = _new_store(s), log_table(t)
    for k in range(10):
        store.append("accounting", log.where(F.col("id") % 10 == k), P)
    return store.snapshot()


query("stats_stored_since", _stats_sql("WHERE ts >= TIMESTAMP '2024-01-19 12:07:30'"))(lambda t, s: _pct(accounting.stored_stats(_kept_log(t, s), P, since=F.lit("2024-01-19 12:07:30").cast("timestamp"))))
query("stats_stored_today", _stats_sql("WHERE CAST(ts + INTERVAL 345 MINUTE AS DATE) = DATE '2024-01-20'"))(lambda t, s: _pct(accounting.stored_stats(_kept_log(t, s), P, day=F.to_date(F.lit("2024-01-20")), zone="+05:45")))
query("stats_empty", _stats_sql("WHERE session_id = 'none'"))(lambda t, s: _pct(accounting.stats(log_table(t), P, session="none")))
query("stats_by_session", _stats_sql(key="session_id"))(lambda t, s: _pct(accounting.stats_by(log_table(t), "session_id")))
query("percent_format", f"SELECT session_id, printf('%.1f%%', cumulative_savings_pct) AS pct FROM ({_stats_sql(key='session_id')})")(lambda t, s: accounting.stats_by(log_table(t), "session_id").select("session_id", X.percent(F.col("cumulative_savings_pct")).alias("pct")))

# Environment variables.


def reg_table(t) -> DataFrame:
    """Brand and type of a part as key; a part with a quality label defines it, one with a toxic label uses it."""
    parts, labels = t("part", "p_partkey", "p_brand", "p_type"), t("labels", "doc_id", "quality", "toxic")
    keyed = parts.join(labels, F.col("p_partkey") == F.col("doc_id")).select(F.upper(F.concat_ws("_", F.regexp_replace("p_brand", "#", ""), "p_type")).alias("name"), "quality", "toxic")
    hits = keyed.select("name", F.inline(F.array(F.struct(F.lit(True).alias("is_definition"), (F.col("quality") == 1).alias("on")), F.struct(F.lit(False).alias("is_definition"), (F.col("toxic") == 1).alias("on"))))).where("on")
    return envscan.registry(hits, P).drop("created_at")


_REG = """SELECT key, bool_or(quality = 1) AS is_defined, bool_or(toxic = 1) AS is_used FROM (SELECT upper(replace(p_brand, '#', '') || '_' || p_type) AS key, quality, toxic FROM part JOIN labels ON p_partkey = doc_id)
  WHERE quality = 1 OR toxic = 1 GROUP BY key"""
_KIND = "CASE WHEN NOT is_defined AND is_used THEN 'unknown' WHEN is_defined AND NOT is_used THEN 'unused' ELSE 'consistent' END"
query("registry_merge", f"SELECT key, is_defined, is_used FROM ({_REG})")(lambda t, s: reg_table(t).select("key", "is_defined", "is_used"))
query("env_classify", f"SELECT key, is_defined, {_KIND} AS class FROM ({_REG})")(lambda t, s: envscan.classify(reg_table(t)))
query("env_consistency", f"""SELECT *, CASE WHEN unknown = 0 AND unused = 0 THEN 'clear' ELSE 'issues_found' END AS status FROM (
  SELECT count(*) FILTER (c = 'unknown') AS unknown, count(*) FILTER (c = 'unused') AS unused, count(*) FILTER (c = 'consistent') AS consistent FROM (SELECT {_KIND} AS c FROM ({_REG})))""")(lambda t, s: envscan.consistency(reg_table(t)))
query("env_nearest_defined", f"""WITH k AS ({_REG}), p AS (SELECT u.key AS variable, d.key AS suggestion, row_number() OVER (PARTITION BY u.key ORDER BY levenshtein(u.key, d.key), d.key) AS r
  FROM k u JOIN k d ON d.is_defined AND levenshtein(u.key, d.key) <= 3 WHERE NOT u.is_defined AND u.is_used)
  SELECT k.key AS variable, suggestion FROM k LEFT JOIN (SELECT * FROM p WHERE r = 1) q ON q.variable = k.key WHERE NOT is_defined AND is_used""")(lambda t, s: envscan.nearest_defined(reg_table(t)))
query("env_suggestions", f"SELECT key, CAST(levenshtein('BRAND1_ECONOMIC', key) AS INTEGER) AS dist FROM ({_REG}) ORDER BY dist, key LIMIT 5")(lambda t, s: envscan.suggestions(reg_table(t), "BRAND1_ECONOMIC"))
query("registry_by_key", f"SELECT key, row_number() OVER (ORDER BY key) AS place FROM ({_REG}) WHERE {_KIND} = 'unused'")(
    lambda t, s: envscan.keys_of(reg_table(t), "unused").withColumn("place", F.row_number().over(Window.orderBy("key")).cast("long"))
)
query("env_validate", f"""SELECT name, name IN (SELECT key FROM ({_REG})) AS valid, CASE WHEN name IN (SELECT key FROM ({_REG})) THEN NULL ELSE (SELECT string_agg(key, ',' ORDER BY d, key) FROM (SELECT key, levenshtein(v.name, key) AS d FROM ({_REG}) ORDER BY d, key LIMIT 5)) END AS near
  FROM (VALUES ('BRAND_1'), ('BRAND11_ECONOMIC'), ('BRAND11_ECONOMY')) AS v(name)""")(
    lambda t, s: envscan.validations(reg_table(t), ["BRAND_1", "BRAND11_ECONOMIC", "BRAND11_ECONOMY"]).select("name", "valid", F.when(F.size("near") > 0, F.concat_ws(",", "near")).alias("near"))
)


@query("env_scan", """WITH n AS (SELECT n_nationkey AS k, replace(upper(n_name), ' ', '_') AS v, replace(upper(r_name), ' ', '_') AS r FROM nation JOIN region ON r_regionkey = n_regionkey)
  SELECT 'DEF_' || v AS name, '/w/' || k || '/.env' AS file_path, true AS is_definition FROM n UNION ALL SELECT 'LIST_' || v, '/w/' || k || '/l.yml', true FROM n UNION ALL SELECT 'ROW_' || v, '/w/' || k || '/r.md', true FROM n
  UNION ALL SELECT 'PY_' || v, '/w/' || k || '/p.py', false FROM n UNION ALL SELECT 'PY_' || r, '/w/' || k || '/p.py', false FROM n UNION ALL SELECT 'JS_' || v, '/w/' || k || '/j.ts', false FROM n UNION ALL SELECT 'TAKEN_' || r, '/w/' || k || '/j.ts', false FROM n
  UNION ALL SELECT 'RS_' || v, '/w/' || k || '/s.rs', false FROM n UNION ALL SELECT 'SH_' || v, '/w/' || k || '/h.sh', false FROM n UNION ALL SELECT 'SH_' || r, '/w/' || k || '/h.sh', false FROM n""")
def _(t, s):
    joined = t("nation", "n_nationkey", "n_name", "n_regionkey").join(t("region", "r_regionkey", "r_name"), F.expr("r_regionkey = n_regionkey"))
    v, r = (F.translate(F.upper(c), " ", "_") for c in ("n_name", "r_name"))
    texts = {
        ".env": ("DEF_{v} = 1\nlower=2\nPORT=3\n", v), "l.yml": ("env:\n  - LIST_{v}: x\n  plain: y\n", v), "r.md": ("| `ROW_{v}` | about |\n", v),
        "p.py": ("os.getenv('PY_{v}')\nos.environ[\"PY_{r}\"]\n", v, r), "j.ts": ("process.env.JS_{v};\nconst { TAKEN_{r}: other, lower } = process.env;\n", v, r),
        "s.rs": ("let a = std::env::var(\"RS_{v}\");\n", v), "h.sh": ("echo $SH_{v} ${{SH_{r}}} $lower\n", v, r),
    }

    def filled(text: str) -> Column:
        parts = re.split(r"(\{v\}|\{r\})", text)
        return F.concat(*({"{v}": v, "{r}": r}.get(x, F.lit(x.replace("{{", "{").replace("}}", "}"))) for x in parts))

    files = F.array(*(F.struct(F.concat(F.lit("/w/"), F.col("n_nationkey").cast("string"), F.lit(f"/{name}")).alias("path"), filled(text).alias("content")) for name, (text, *_) in texts.items()))
    return envscan.scan(joined.select(F.inline(files)))


# Chunks.

_DOC_MD = "'# Doc ' || doc_id || chr(10) || coalesce(text, '') || chr(10) || '## Tail' || chr(10) || '### no section' || chr(10) || coalesce(lang, '')"
query("chunk_markdown", f"""WITH l AS (SELECT doc_id, unnest(ls) AS v, unnest(range(1, len(ls) + 1)) AS i, len(ls) AS n FROM (SELECT doc_id, CASE WHEN x LIKE '%' || chr(10) THEN string_split(x, chr(10))[:-2] ELSE string_split(x, chr(10)) END AS ls FROM (SELECT doc_id, {_DOC_MD} AS x FROM documents))),
  h AS (SELECT doc_id, i, n, trim(ltrim(v, '#')) AS name FROM l WHERE v LIKE '# %' OR v LIKE '## %')
  SELECT '/w/' || doc_id || '.md' AS path, name, CAST(i AS BIGINT) AS start_line, CAST(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - 1, n) AS BIGINT) AS end_line FROM h""")(
    lambda t, s: chunking.markdown_sections(t("documents", "doc_id", "text", "lang").select(F.format_string("/w/%d.md", "doc_id").alias("path"), F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n## Tail\n### no section\n"), F.coalesce("lang", F.lit(""))).alias("content"))).select("path", "name", "start_line", "end_line")
)
query("chunk_documents", f"SELECT CAST(doc_id AS VARCHAR) || '.toml' AS name, 'file' AS node_type, CAST(1 AS BIGINT) AS start_line, CAST(len({_LINES}) AS BIGINT) AS end_line, 'File: ' || doc_id || '.toml' AS summary FROM documents")(
    lambda t, s: chunking.chunk_files(t("documents", "doc_id", "text").select(F.concat(F.lit("/w/"), F.col("doc_id").cast("string"), F.lit(".toml")).alias("path"), F.col("text").alias("content"))).select("name", "node_type", "start_line", "end_line", "summary")
)

#: A source file for every part: items, nested ones, ones without a block, and lines that only look like items.
_RS = ["pub fn price_@(n: u32) -> u32 {", "    if n > @ { 1 } else { 2 }", "}", "struct Part@ {", "    size: u32,", "}", "impl fmt::Debug for Part@ {", "    fn show_@(&self) {", "    }", "}", "enum Kind@ { A, B }", "pub trait Priced@", "    : Send {", "}", "let fn_@ = 1;", "async fn late_@();", "// end", "fn " + "x" * 90 + "_@() {", "}"]
_TS = ["export function total@(a) {", "  return { a };", "}", "const pick@ = async (u) => {", "  go();", "}", "const limit@ = 3;", "export default class Shop@ extends Base {", "}"]


def _code_oracle() -> str:
    out = []
    for lines, ext, kind, name, summary in (
        (_RS, "rs", "CASE regexp_extract(b, '^(?:pub )?(?:async )?(fn|struct|enum|trait|impl) ', 1) WHEN 'fn' THEN 'function' ELSE regexp_extract(b, '^(?:pub )?(?:async )?(fn|struct|enum|trait|impl) ', 1) END",
         "regexp_extract(b, '^(?:pub )?(?:async )?(?:fn|struct|enum|trait|impl)(?: .* for)? (\\w+)', 1)", "kind || ': ' || CASE WHEN strlen(b) <= 80 THEN b ELSE name END"),
        (_TS, "ts", "CASE WHEN regexp_matches(b, '^((export )?(function|const) |export default (function|class) )') AND (b LIKE 'export default %' OR contains(b, '=>') OR contains(b, '(')) THEN 'function' ELSE '' END",
         "regexp_extract(b, '(?:function|const|class) (\\w+)', 1)", "'TypeScript function: ' || name"),
    ):
        listed = "[" + ", ".join(f"'{v}'" for v in lines) + "]"
        out.append(f"""(WITH l AS (SELECT p_partkey AS k, unnest({listed}) AS t, unnest(range({len(lines)})) AS i FROM part), c AS (SELECT k, i, replace(t, '@', CAST(k AS VARCHAR)) AS v, len(replace(t, '}}', '')) - len(replace(t, '{{', '')) AS delta FROM l),
          d AS (SELECT *, trim(v) AS b, sum(delta) OVER (PARTITION BY k ORDER BY i) AS d FROM c), o AS (SELECT *, min(CASE WHEN contains(v, '{{') THEN i END) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opened FROM d),
          s AS (SELECT k, i, b, d - delta AS base, opened, {kind} AS kind FROM o), m AS (SELECT *, {name} AS name FROM s WHERE kind <> ''), e AS (SELECT m.k, m.i, min(d.i) AS stop FROM m JOIN d ON d.k = m.k AND d.i >= m.opened AND d.d <= m.base GROUP BY 1, 2)
          SELECT '/w/' || m.k || '.{ext}' AS path, name, kind AS node_type, CAST(m.i + 1 AS BIGINT) AS start_line, CAST(coalesce(stop, least(m.i + 1, {len(lines) - 1})) + 1 AS BIGINT) AS end_line, {summary} AS summary FROM m LEFT JOIN e ON e.k = m.k AND e.i = m.i)""")
    return " UNION ALL ".join(out)


@query("chunk_code", _code_oracle())
def _(t, s):
    key = F.col("p_partkey").cast("string")
    files = F.array(*(F.struct(F.concat(F.lit("/w/"), key, F.lit(f".{ext}")).alias("path"), F.replace(F.lit("\n".join(lines)), F.lit("@"), key).alias("content")) for ext, lines in (("rs", _RS), ("ts", _TS))))
    return chunking.chunk_files(t("part", "p_partkey").select(F.inline(files))).select("path", "name", "node_type", "start_line", "end_line", "summary")


# Appending to a store.


def _new_store(s) -> Store:
    return Store(s, f"{shared_dir(s)}/store-{uuid.uuid4().hex}")


@query("accounting_append", f"""SELECT session_id, count(*) AS n, CAST(sum(p) AS BIGINT) AS pointer_tokens FROM ({_LOG}) GROUP BY 1""")
def _(t, s):
    """The log appended in two parts to a store, and read back."""
    store, log = _new_store(s), log_table(t)
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        store.append("accounting", log.where(part))
    return store.read("accounting").groupBy("session_id").agg(F.count("*").alias("n"), F.sum("pointer_tokens").alias("pointer_tokens"))


@query("fact_append", """SELECT sha256(concat_ws(chr(31), 'p', conv_id, CASE role WHEN 'system' THEN 'constraint' ELSE 'decision' END, text, '2024-01-01 00:00:00')) AS id, CAST(conv_id AS VARCHAR) AS node_id,
    CASE role WHEN 'system' THEN 'constraint' ELSE 'decision' END AS fact_type, text AS content, valid_to IS NULL AS active FROM (SELECT *, CAST(NULL AS TIMESTAMP) AS valid_to FROM conversations)""")
def _(t, s):
    """Facts of a known type, and of an unknown one, which become decisions, appended to a store."""
    c = t("conversations", "conv_id", "role", "text").select(F.when(F.col("role") == "system", "constraint").otherwise("a guess").alias("fact_type"), F.col("text").alias("content"), F.col("conv_id").cast("string").alias("node_id"))
    store = _new_store(s)
    store.append("temporal_facts", temporal.fact_rows(c, P, F.lit("2024-01-01").cast("timestamp")))
    return store.read("temporal_facts").select("id", "node_id", "fact_type", "content", F.col("valid_to").isNull().alias("active"))


@query("facts_interleaved", f"""SELECT id, CASE role WHEN 'user' THEN 'by one' WHEN 'assistant' THEN 'by two' END AS superseded_by, role NOT IN ('user', 'assistant') AS active
  FROM (SELECT conv_id || '-' || turn AS id, role FROM conversations)""")
def _(t, s):
    """Two writers close different facts of a project, and the second commits between the first one's read and its commit: both hold."""
    one = _new_store(s)
    two = Store(s, one.root)
    facts = fact_table(t).withColumns({"valid_to": F.lit(None).cast("timestamp"), "superseded_by": F.lit(None).cast("string")})
    one.append("temporal_facts", facts, P)
    ended = lambda now, kind, by: now.read("temporal_facts", P).where(F.col("fact_type") == kind).select("id", "project_id", F.lit(by).alias("superseded_by"))
    late = []

    def first(now):
        changes = temporal.invalidation(now, P, ended(now, "decision", "by one"))
        if not late:
            late.append(two.update(lambda then: temporal.invalidation(then, P, ended(then, "learning", "by two"))))
        return changes

    one.update(first)
    return one.read("temporal_facts").select("id", "superseded_by", F.col("valid_to").isNull().alias("active"))
