"""The three search tiers, their cascade, and what a search returns."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions import inversion
from quarryline.functions import text as X
from quarryline.functions.inversion import EDGE
from quarryline.sources.scratch import stash
from quarryline.sources.store import COMBINED, DERIVED, Derived

#: Candidates of each tier, results of a front end, and the least cosine.
TIER_LIMIT, TOP_K, MIN_COSINE = 20, 10, 0.20
#: Scores of the k-th literal hit from which the other tiers, or the last, are skipped.
SKIP_ALL, SKIP_VECTOR = 0.9, 0.8
#: A full-text strategy counts as successful from so many hits.
STRATEGY_MIN = 3
LITERAL, FULL_TEXT, VECTOR = "L0Literal", "L1Fts", "L2Vector"
#: What a tier adds to a score when a node was found by several.
BONUS = {LITERAL: 0.3, FULL_TEXT: 0.1, VECTOR: 0.0}
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Rows of a span of an index; spans a top-k search begins with, and spans up to which it names those it goes on with.
SPAN, FIRST_SPANS, MOST_SPANS = 128, 8, 500


def _of(df: DataFrame, project: str | None) -> DataFrame:
    return df if project is None else df.where(F.col("project_id") == project)


def literal_search(nodes: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT) -> DataFrame:
    """id, score of nodes whose name starts with the query; only if none does, of those that contain it.

    The best `limit` are taken with prefix hits first, which fits into one pass; the gate then looks at these few rows only.
    """
    q, name = F.lit(query.lower()), F.lower("name")
    hits = _of(nodes, project).where(F.contains(name, q)).select("id", name.startswith(q).alias("p"), X.literal_score(q, name).alias("score"))
    best = hits.orderBy(F.desc("p"), F.desc("score"), "id").limit(limit)
    return best.withColumn("any", F.max("p").over(Window.partitionBy(F.lit(1)))).where("p = any").select("id", "score")


#: Characters of a gram of the name index.
GRAM = 3


def name_index(nodes: DataFrame) -> dict[str, DataFrame]:
    """The index of names, as the tables names, lower-cased and sorted, and name_grams: who has which three characters, by spans of names."""
    seg = uuid.uuid4().hex
    ordered = nodes.select("id", "project_id", F.lower("name").alias("low")).repartitionByRange("low", "id").sortWithinPartitions("low", "id").withColumn("no", F.monotonically_increasing_id())
    held = stash(ordered.select(F.lit(seg).alias("seg"), F.floor(F.col("no") / SPAN).alias("span"), (F.col("no") % SPAN).cast("int").alias("at"), "low", "id", "project_id"), "name-index")
    grams = F.when(F.length("low") >= GRAM, F.transform(F.sequence(F.lit(1), F.length("low") - (GRAM - 1)), lambda i: F.substring("low", i, GRAM)))
    each = held.select("seg", "span", "at", F.explode(F.array_distinct(grams)).alias("term"))
    return {"names": held, "name_grams": each.groupBy("term", "seg", "span").agg(F.sort_array(F.collect_list("at")).alias("at"))}


DERIVED["nodes"] = Derived(("names", "name_grams"), name_index)


def literal_search_stored(names: DataFrame, grams: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT) -> DataFrame:
    """literal_search from the name index: names that start so are a range of the sorted ones; those that contain it have all its grams."""
    q, low = F.lit(query.lower()), F.col("low")
    scored = lambda df: _first(df.select("id", X.literal_score(q, low).alias("raw")), limit)
    mine = _of(names, project)
    hits = scored(mine.where(low.startswith(query.lower())))
    if not hits:
        hits = scored(_with_grams(mine, grams, query.lower()).where(F.contains(low, q)))
    return names.sparkSession.createDataFrame(hits, "id string, score double")


def _with_grams(names: DataFrame, grams: DataFrame, low: str) -> DataFrame:
    """The names that have every gram of the text; all, if it is too short to have one."""
    wanted = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return names
    spans = grams.where(F.col("term").isin(*wanted)).groupBy("seg", "span").agg(F.collect_list("at").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0)), F.array_intersect)
    return names.join(spans.select("seg", "span", F.explode(both).alias("at")), ["seg", "span", "at"], "left_semi")


def fts_index(rows: DataFrame) -> DataFrame:
    """node_id, project_id, toks, size from rows of the full-text table.  The tokens are a generated column, made once however often they are used."""
    return rows.select("node_id", "project_id", F.explode(F.array(_toks())).alias("toks")).withColumn("size", F.size("toks") - 2)


def _toks() -> Column:
    parts = [X.fts_tokens(F.col(c)) for c in ("name", "content", "file_path")]
    return F.concat(parts[0], F.array(F.lit(EDGE)), parts[1], F.array(F.lit(EDGE)), parts[2])


def text_index(rows: DataFrame) -> dict[str, DataFrame]:
    """The inverted index of full-text rows, as the tables fts_docs and fts_postings.

    Each partition numbers its rows by length and parts them into spans of SPAN, so that a hot term is as many rows as it has spans.  A row of
    fts_postings is a term's block in a span: the rows that hold it by their places there, how often, and at which positions, those of one row after
    those of another.  `top` bounds what the term gives any of them: the BM25 share of its most occurrences in the shortest of them, with the average
    size `avg` that the index was built with.

    A span lies within a partition, so only the texts are shuffled, and then the blocks; never single tokens.
    """
    seg = uuid.uuid4().hex
    length = functools.reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)) for c in ("name", "content", "file_path")))
    ordered = rows.withColumn("length", length).repartition("node_id").sortWithinPartitions("length", "node_id").withColumn("no", F.monotonically_increasing_id())
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("name", "content", "file_path")]
    text = F.concat_ws(" ", *parts)
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit(EDGE))
    texts = F.when(plain, F.concat_ws(f" {EDGE} ", *parts)), F.when(~plain, _toks())
    spans = ordered.select(F.floor(F.col("no") / SPAN).alias("span"), (F.col("no") % SPAN).cast("int").alias("at"), "node_id", "project_id", texts[0].alias("plain"), texts[1].alias("toks"))
    made = stash(spans.mapInArrow(inversion.inverted, inversion.SCHEMA).sortWithinPartitions("term", "span"), "text-index")
    docs = made.where(F.col("term").isNull()).select(F.lit(seg).alias("seg"), "span", F.inline("docs"))
    avg = F.lit(max(docs.agg(F.avg("size")).first()[0] or 0.0, 1e-9))
    blocks = made.where(F.col("term").isNotNull())
    return {"fts_docs": docs, "fts_postings": blocks.select("term", F.lit(seg).alias("seg"), "span", avg.alias("avg"), bm25_share(F.col("most"), F.col("shortest"), avg).alias("top"), "at", "tf", "positions")}


def term_counts(rows: DataFrame, sign: int = 1) -> DataFrame:
    """term, df (rows that hold it) and total; the empty term counts the rows and their sizes.  With sign -1, what goes with the rows.

    Counts of any pieces add up, so a change keeps the statistics with a few rows of its own.
    """
    return added_counts(_counted(rows, sign))


def _counted(rows: DataFrame, sign: int) -> DataFrame:
    one, zero = F.lit(sign).cast("long"), F.lit(0).cast("long")
    held = F.transform(F.array_remove(F.array_distinct("toks"), EDGE), lambda t: F.struct(t.alias("term"), zero.alias("size")))
    every = F.concat(F.array(F.struct(F.lit("").alias("term"), F.col("size").cast("long").alias("size"))), held)
    return fts_index(rows).select(F.inline(every)).select("term", one.alias("df"), (one * F.col("size")).alias("total"))


def index_counts(docs: DataFrame, postings: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """term_counts of the rows of an index, from its blocks, less those of full-text rows that go."""
    zero = F.lit(0).cast("long")
    every = docs.agg(F.lit("").alias("term"), F.count("*").alias("df"), F.sum("size").alias("total"))
    counts = postings.select("term", F.size("at").cast("long").alias("df"), zero.alias("total")).unionByName(every.where("df > 0"))
    return added_counts(counts if gone is None else counts.unionByName(_counted(gone, -1)))


def added_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


DERIVED["fts"] = Derived(("fts_docs", "fts_postings"), text_index)
COMBINED["fts_terms"] = added_counts


def bm25_share(tf: Column, size: Column, average: Column) -> Column:
    """What a term with inverse document frequency 1 gives a row."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / average))


def phrase_count(toks: Column, phrase: list[str], prefix: bool = False) -> Column:
    """Occurrences of consecutive tokens; with `prefix` the last need only start so."""
    same = lambda t, i: t.startswith(phrase[i]) if prefix and i == len(phrase) - 1 else t == phrase[i]
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(toks, lambda t: same(t, 0)))

    def at(t: Column, i: Column) -> Column:
        hit = same(t, 0)
        for k in range(1, len(phrase)):
            hit = hit & F.coalesce(same(F.get(toks, i + k), k), F.lit(False))
        return hit

    # A row that lacks a token is settled without looking at places.
    has = F.array_contains(toks, phrase[0])
    return F.when(has, F.size(F.filter(toks, at))).otherwise(0)


def strategies(query: str) -> list[tuple[str, list[tuple[list[str], bool]], bool]]:
    """(name, phrases, all must match), in the order they are tried."""
    words = X.query_words(query)
    if not words:
        return []
    one = [X.fts_phrase(w) for w in words]
    if len(words) == 1:
        return [("single", [(one[0], False)], True)]
    return [("phrase", [([t for w in one for t in w], False)], True), ("prefix", [(w, True) for w in one], True), ("any", [(w, False) for w in one], False)]


def fts_search(index: DataFrame, nodes: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT) -> tuple[str | None, DataFrame]:
    """The strategy used, and id, raw, score of its hits by BM25, from token arrays.

    One pass over the tokens counts the phrases of every strategy; what follows reads these few numbers a row.
    """
    plans = strategies(query)
    if not plans:
        return None, _nothing(index)
    counts = [phrase_count(F.col("toks"), p, prefix).alias(n) for n, p, prefix in _phrases(plans)]
    rows = stash(index.select("node_id", "project_id", "size", *counts), "phrase-counts")
    total = rows.agg(F.count("*").alias("n"), F.sum("size").alias("total")).first()
    return _ranked(rows, total, plans, nodes, project, limit)


def fts_search_stored(postings: DataFrame, docs: DataFrame, terms: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT) -> tuple[str | None, DataFrame]:
    """fts_search from the stored index, where every row has a node.

    Sizes and document frequencies come from the kept counts.  A strategy whose phrases are single words reads the blocks that can hold one of the
    best rows only (`_best_rows`); other phrases and prefixes are counted in all spans that can hold them.  The driver holds hits of a search, at most
    `limit`, and counts of the query's words.
    """
    plans, none = strategies(query), _nothing(postings)
    tokens = sorted({t for _, p, _ in _phrases(plans) for t in p})
    if not tokens:
        return None, none
    known = {r["term"]: r for r in added_counts(terms.where(F.col("term").isin("", *tokens))).collect()}
    n, size = (known[""]["df"], known[""]["total"]) if "" in known else (0, 0)
    if n <= 0:
        return None, none
    average = max(size / n, 1e-9)
    for s, (name, phrases, every) in enumerate(plans):
        if all(len(p) == 1 and not prefix for p, prefix in phrases):
            weights: dict[str, float] = {}
            for (t,), _ in phrases:
                df = known[t]["df"] if t in known else 0
                weights[t] = weights.get(t, 0.0) + _idf(n, df)
            hits = _best_rows(postings, docs, weights, average, project, limit)[0]
        else:
            hits = _best_phrases(postings, docs, plans[s], n, average, project, limit)
        if len(hits) >= STRATEGY_MIN or s == len(plans) - 1:
            break
    found = postings.sparkSession.createDataFrame(hits, "id string, raw double")
    return name, found.select("id", "raw", X.bm25_normal(F.col("raw")).alias("score"))


def _first(rows: DataFrame, limit: int) -> list[tuple[str, float]]:
    """The best of (id, raw)."""
    return [(r["id"], r["raw"]) for r in rows.orderBy(F.desc(F.round("raw", 9)), "id").limit(limit).select("id", "raw").collect()]


def _best_rows(postings: DataFrame, docs: DataFrame, weights: dict[str, float], average: float, project: str | None, limit: int) -> tuple[list[tuple[str, float]], int]:
    """The best rows by the weighted BM25 shares of words, and from how many blocks.

    A block's bound holds for another average size than it was built with, too, if it is raised by the ratio of the averages.
    """
    held = postings.where(F.col("term").isin(*weights))
    weight = F.element_at(F.create_map(*(F.lit(v) for pair in weights.items() for v in pair)), F.col("term"))
    bound = weight * F.col("top") * F.greatest(F.lit(1.0), F.lit(average) / F.col("avg"))
    share = weight * bm25_share(F.col("tf"), F.col("size"), F.lit(average))
    return _best_of_spans(held, _of(docs, project).withColumnRenamed("node_id", "id"), bound, "tf", share, limit)


def _best_of_spans(blocks: DataFrame, docs: DataFrame, bound: Column, value: str, share: Column, limit: int, least: float = 0.0) -> tuple[list[tuple[str, float]], int]:
    """The `limit` best rows, of at least `least`, by the sum of their shares over blocks, and the number of blocks read.

    The blocks' bounds, without their rows, bound every span.  The spans with the highest bounds are read first; their k-th best row is a
    threshold, and of the others only spans whose bound reaches it are read.  The driver sees the MOST_SPANS spans with the highest bounds; if
    even more reach the threshold, these are joined where they are.
    """
    spans = blocks.select("seg", "span", bound.alias("bound")).groupBy("seg", "span").agg(F.sum("bound").alias("bound"), F.count("*").alias("blocks"))
    reaches = lambda least: F.col("bound") * (1 + 1e-9) >= least
    top = spans.where(reaches(least)).orderBy(F.desc("bound"), "seg", "span").limit(MOST_SPANS + 1).collect()

    def score(chosen: Callable[[DataFrame], DataFrame]) -> list[tuple[str, float]]:
        rows = chosen(blocks).select("seg", "span", "term", F.inline(F.arrays_zip("at", value)))
        return _first(rows.join(chosen(docs), ["seg", "span", "at"]).groupBy("id").agg(F.sum(share).alias("raw")), limit)

    def among(some: list) -> Callable[[DataFrame], DataFrame]:
        """As a filter, by which the scans skip row groups."""
        names: dict[str, list[int]] = {}
        for r in some:
            names.setdefault(r["seg"], []).append(r["span"])
        is_one = F.lit(False)
        for seg, numbers in names.items():
            is_one = is_one | (F.col("seg") == seg) & F.col("span").isin(*numbers)
        return lambda df: df.where(is_one)

    first = top[:FIRST_SPANS]
    best, read = score(among(first)) if first else [], sum(r["blocks"] for r in first)
    reached = max(least, best[-1][1] - 2e-9 if len(best) == limit else 0.0)
    rest = [r for r in top[FIRST_SPANS:] if r["bound"] * (1 + 1e-9) >= reached]
    if len(first) + len(rest) > MOST_SPANS:
        wide = stash(spans.where(reaches(reached)), "spans")
        best, read = score(lambda df: df.join(wide.select("seg", "span"), ["seg", "span"], "left_semi")), wide.agg(F.sum("blocks")).first()[0]
    elif rest:
        best, read = sorted(best + score(among(rest)), key=lambda h: (-round(h[1], 9), h[0]))[:limit], read + sum(r["blocks"] for r in rest)
    return [h for h in best if h[1] >= least], read


def _best_phrases(postings: DataFrame, docs: DataFrame, plan: tuple, n: int, average: float, project: str | None, limit: int) -> list[tuple[str, float]]:
    """The best rows of a strategy of phrases or prefixes; their frequencies are counted over all projects."""
    _, phrases, every = plan
    wanted = sorted({(t, prefix and i == len(p) - 1) for p, prefix in phrases for i, t in enumerate(p)})
    place = {w: f"s{k}" for k, w in enumerate(wanted)}
    is_slot = {w: F.col("term").startswith(w[0]) if w[1] else F.col("term") == w[0] for w in wanted}
    hit = functools.reduce(lambda a, b: a | b, is_slot.values())
    blocks = postings.where(hit)
    if len(phrases) == 1:  # it is only where all its words are
        both = blocks.groupBy("seg", "span").agg(*(F.max(c).alias(place[w]) for w, c in is_slot.items())).where(" AND ".join(place.values()))
        blocks = blocks.join(both.select("seg", "span"), ["seg", "span"], "left_semi")
    before = lambda i: F.aggregate(F.slice("tf", 1, i), F.lit(0), lambda a, b: a + b)
    own = F.transform("at", lambda at, i: F.struct(at.alias("at"), F.slice("positions", before(i) + 1, F.get("tf", i)).alias("positions")))
    each = blocks.select("term", "seg", "span", F.inline(own))
    held = each.groupBy("seg", "span", "at").agg(*(F.flatten(F.collect_list(F.when(c, F.col("positions")))).alias(place[w]) for w, c in is_slot.items()))

    def moved(slot: str, by: int) -> Column:
        return F.transform(slot, lambda p: p - by)

    def count(phrase: list[str], prefix: bool) -> Column:
        if not phrase:
            return F.lit(0)
        at = F.col(place[phrase[0], prefix and len(phrase) == 1])
        for k in range(1, len(phrase)):
            at = F.array_intersect(at, moved(place[phrase[k], prefix and k == len(phrase) - 1], k))
        return F.size(at)

    names = [f"f{i}" for i in range(len(phrases))]
    counts = held.select("seg", "span", "at", *(count(p, prefix).alias(c) for c, (p, prefix) in zip(names, phrases, strict=True))).where(" OR ".join(f"{c} > 0" for c in names))
    rows = stash(counts.join(docs, ["seg", "span", "at"]), "phrase-counts")
    df = rows.agg(*(F.count_if(F.col(c) > 0).alias(c) for c in names)).first()
    raw = functools.reduce(lambda a, b: a + b, (F.lit(_idf(n, df[c])) * bm25_share(F.col(c), F.col("size"), F.lit(average)) for c in names))
    mine = _of(rows, project).where((" AND " if every else " OR ").join(f"{c} > 0" for c in names))
    return _first(mine.select(F.col("node_id").alias("id"), raw.alias("raw")), limit)


def _nothing(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "id string, raw double, score double")


def _phrases(plans: list[tuple]) -> list[tuple[str, list[str], bool]]:
    """(column, phrase, prefix) of every strategy's phrases."""
    return [(f"f{s}_{i}", p, prefix) for s, (_, phrases, _) in enumerate(plans) for i, (p, prefix) in enumerate(phrases)]


def _ranked(rows: DataFrame, total, plans: list[tuple], nodes: DataFrame, project: str | None, limit: int) -> tuple[str | None, DataFrame]:
    """The first strategy with enough hits, and its best by BM25; statistics are over all projects, hits in the project and among the nodes."""
    if not total["n"]:
        return None, _nothing(rows)
    counts = [n for n, _, _ in _phrases(plans)]
    there = nodes.select(F.col("id").alias("node_id")).distinct()
    some = rows.where(" OR ".join(f"{c} > 0" for c in counts))
    mine = (some if project is None else some.where(F.col("project_id") == project)).join(there, "node_id", "left_semi")

    def matches(s: int) -> Column:
        _, phrases, every = plans[s]
        hit = [F.col(f"f{s}_{i}") > 0 for i in range(len(phrases))]
        out = hit[0]
        for h in hit[1:]:
            out = (out & h) if every else (out | h)
        return out

    df = some.agg(*(F.count_if(F.col(c) > 0).alias(c) for c in counts)).first()
    hits = mine.agg(*(F.count_if(matches(s)).alias(f"hits{s}") for s in range(len(plans)))).first()
    chosen = next((s for s in range(len(plans)) if min(hits[f"hits{s}"], limit) >= STRATEGY_MIN), len(plans) - 1)
    average = max(total["total"] / total["n"], 1e-9)
    raw = F.lit(0.0)
    for i in range(len(plans[chosen][1])):
        f = F.col(f"f{chosen}_{i}")
        raw = raw + F.lit(_idf(total["n"], df[f"f{chosen}_{i}"])) * bm25_share(f, F.col("size"), F.lit(average))
    scored = mine.where(matches(chosen)).select(F.col("node_id").alias("id"), raw.alias("raw"))
    return plans[chosen][0], scored.orderBy(F.desc(F.round("raw", 9)), "id").limit(limit).select("id", "raw", X.bm25_normal(F.col("raw")).alias("score"))


def _idf(n: int, df: int) -> float:
    import math

    value = math.log((n - df + 0.5) / (df + 0.5))
    return value if value > 0 else IDF_FLOOR


def vector_index(nodes: DataFrame) -> DataFrame:
    """id, project_id, vector of every node's name, summary and path; null without tokens.  Built once, read by every query."""
    text = F.concat_ws(" ", "name", "summary", "file_path")
    return nodes.select("id", "project_id", X.hash_vector(X.vector_tokens(text)).alias("vector"))


def vector_search(index: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT, least: float = MIN_COSINE) -> DataFrame:
    """id, score of the nodes nearest to the query's hashed words."""
    q = X.query_vector(query)
    if q is None:
        return index.sparkSession.createDataFrame([], "id string, score double")
    # The threshold comes after the limit, where it means the same: before it, the optimizer would compute every score twice.
    return _of(index, project).select("id", X.cosine_with(F.col("vector"), q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit).where(F.col("score") >= least)


def vector_lists(index: DataFrame) -> dict[str, DataFrame]:
    """Inverted lists of vectors, as the tables vector_docs and vector_lists.

    Vectors are numbered so that those with the same largest bucket stand together, and parted into spans as the text index is.  A row of
    vector_lists is a bucket's block in a span: who has it, how much, and the most that any has.
    """
    seg = uuid.uuid4().hex
    largest = F.array_max(F.transform("vector", lambda c: F.struct(c["v"].alias("v"), c["b"].alias("b"))))
    ordered = index.where(F.col("vector").isNotNull()).withColumn("main", largest["b"]).repartitionByRange("main", "id").sortWithinPartitions("main", "id").withColumn("no", F.monotonically_increasing_id())
    held = stash(ordered.select(F.lit(seg).alias("seg"), F.floor(F.col("no") / SPAN).alias("span"), (F.col("no") % SPAN).cast("int").alias("at"), "id", "project_id", "vector"), "vector-index")
    each = held.select("seg", "span", "at", F.inline("vector").alias("b", "v"))
    blocks = each.groupBy(F.col("b").cast("string").alias("term"), "seg", "span").agg(F.max("v").alias("top"), F.sort_array(F.collect_list(F.struct("at", "v"))).alias("r"))
    lists = blocks.select("term", "seg", "span", "top", F.col("r.at").alias("at"), F.col("r.v").alias("v"))
    return {"vector_docs": held.drop("vector"), "vector_lists": lists}


DERIVED["vectors"] = Derived(("vector_docs", "vector_lists"), vector_lists)


def vector_search_stored(lists: DataFrame, docs: DataFrame, query: str, project: str | None = None, limit: int = TIER_LIMIT, least: float = MIN_COSINE) -> DataFrame:
    """vector_search from the inverted lists: reads the query's buckets only, and of these the blocks that can hold one of the nearest."""
    return lists.sparkSession.createDataFrame(_nearest(lists, docs, query, project, limit, least)[0], "id string, score double")


def _nearest(lists: DataFrame, docs: DataFrame, query: str, project: str | None, limit: int, least: float) -> tuple[list[tuple[str, float]], int]:
    weights = {str(b): v for b, v in enumerate(X.query_vector(query) or []) if v}
    if not weights:
        return [], 0
    weight = F.element_at(F.create_map(*(F.lit(v) for pair in weights.items() for v in pair)), F.col("term"))
    blocks = lists.where(F.col("term").isin(*weights))
    return _best_of_spans(blocks, _of(docs, project), weight * F.col("top").cast("double"), "v", weight * F.col("v").cast("double"), limit, least)


def dedup_rank(results: DataFrame, k: int) -> DataFrame:
    """Of rows (id, score, tier) each id's best by score and tier bonus; then the k best by score alone."""
    bonus = F.element_at(F.create_map(*(F.lit(v) for pair in BONUS.items() for v in pair)), F.col("tier"))
    best = Window.partitionBy("id").orderBy(F.desc(F.round(F.col("score") + bonus, 9)), "tier")
    return results.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").orderBy(F.desc(F.round("score", 9)), "tier", "id").limit(k)


def cascade(literal: DataFrame, full_text: Callable[[], DataFrame], nearest: Callable[[], DataFrame], k: int = TOP_K) -> DataFrame:
    """id, score, tier of the hybrid search from the literal tier's hits.  full_text and nearest make the other tiers' hits, if they are needed.

    The driver looks at the literal tier's at most 20 scores and adds the other tiers only if these do not suffice.
    """
    found = literal.withColumn("tier", F.lit(LITERAL))
    top = sorted((r["score"] for r in literal.collect()), reverse=True)
    least = min(top[:k]) if len(top) >= k else 0.0
    if least < SKIP_ALL:
        found = found.unionByName(full_text().select("id", "score", F.lit(FULL_TEXT).alias("tier")))
        if least < SKIP_VECTOR:
            found = found.unionByName(nearest().withColumn("tier", F.lit(VECTOR)))
    return dedup_rank(found, k)


def pointers(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a search returns for each (id, score): where to look, and the tokens that saying so costs."""
    lines = F.format_string("%d-%d", F.coalesce("start_line", F.lit(0).cast("long")), F.coalesce("end_line", F.lit(0).cast("long")))
    out = results.join(nodes, "id").select("id", F.coalesce("file_path", F.lit("")).alias("source"), F.col("name").alias("chunk"), lines.alias("lines"), F.col("score").alias("relevance"), F.coalesce("summary", F.lit("")).alias("summary"), "node_type", F.lit(None).cast("string").alias("last_modified"))
    return out.withColumn("tokens", pointer_tokens())


def pointer_tokens() -> Column:
    return X.token_estimate(F.concat_ws(" ", "source", "chunk", "lines", "summary")) + 2


def response_report(found: DataFrame, fetched: int = 0) -> DataFrame:
    """One row: pointer_tokens, fetched_tokens, total_tokens, traditional_rag_estimate, savings_pct."""
    ptr = F.coalesce(F.sum("tokens"), F.lit(0))
    one = found.agg(ptr.alias("pointer_tokens")).withColumn("fetched_tokens", F.lit(fetched).cast("long"))
    one = one.withColumns({"total_tokens": F.col("pointer_tokens") + F.col("fetched_tokens"), "traditional_rag_estimate": F.col("pointer_tokens") * X.TRADITIONAL_FACTOR})
    share = (1 - F.col("total_tokens") / F.col("traditional_rag_estimate")) * 100
    return one.withColumn("savings_pct", F.when(F.col("traditional_rag_estimate") > 0, F.greatest(share, F.lit(0.0))).otherwise(0.0))


def fetched(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, content and token_count of nodes (id, file_path, start_line, end_line): their lines of the files (path, content) they are in.

    A node without a file has no content, and of a file that is not there it is said so.
    """
    held = nodes.select("id", "file_path", "start_line", "end_line").join(files.select(F.col("path").alias("file_path"), "content"), "file_path", "left")
    lost = F.concat(F.lit("[File not found: "), "file_path", F.lit("]"))
    lines = X.line_slice(F.col("content"), F.col("start_line"), F.col("end_line"))
    out = held.withColumn("content", F.when(F.coalesce("file_path", F.lit("")) == "", "").when(F.col("content").isNull(), lost).otherwise(lines))
    return out.select("id", "content", X.token_estimate(F.col("content")).alias("token_count"))
