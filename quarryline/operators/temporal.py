"""Facts with validity intervals and supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.plans import schema as S
from quarryline.sources.scratch import stash
from quarryline.sources.store import Change, Snapshot


def fact_rows(df: DataFrame, project: str, now: Column | None = None) -> DataFrame:
    """Open-ended rows of the facts table from fact_type, content and, if there, node_id and source_reference."""
    at = F.current_timestamp() if now is None else now
    opt = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    kind = S.typed(F.col("fact_type"), S.FACT_TYPES, S.FACT_DEFAULT)
    key = S.stable_id(F.lit(project), opt("node_id"), kind, F.col("content"), at)
    return df.select(key.alias("id"), F.lit(project).alias("project_id"), opt("node_id").alias("node_id"), kind.alias("fact_type"), "content", at.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), F.lit(None).cast("string").alias("superseded_by"), opt("source_reference").alias("source_reference"), at.alias("created_at"))


def invalidate(facts: DataFrame, ended: DataFrame, now: Column | None = None) -> DataFrame:
    """The next snapshot: facts of (id, project_id) in `ended` are closed now, whether or not they were closed before."""
    at = F.current_timestamp() if now is None else now
    marks = ended.select(F.col("id").alias("__i"), F.col("project_id").alias("__p"), F.col("superseded_by").alias("__s")).dropDuplicates(["__i", "__p"])
    hit = F.col("__i").isNotNull()
    joined = facts.join(marks, (F.col("id") == F.col("__i")) & (F.col("project_id") == F.col("__p")), "left")
    return joined.withColumns({"valid_to": F.when(hit, at).otherwise(F.col("valid_to")), "superseded_by": F.when(hit, F.col("__s")).otherwise(F.col("superseded_by"))}).select(*facts.columns)


def invalidation(now: Snapshot, project: str, ended: DataFrame, at: Column | None = None) -> list[Change]:
    """The change that closes the project's facts in `ended`: only these are written anew."""
    facts = now.read("temporal_facts", project).where(F.col("project_id") == project)
    closed = invalidate(facts.join(ended.select("id").distinct(), "id", "left_semi"), ended, at)
    return [Change("temporal_facts", project, add=closed, remove=ended.select(F.col("id").alias("key")))]


def active_facts(facts: DataFrame, project: str | None = None, fact_type: str | None = None) -> DataFrame:
    """Facts without an end, newest first; an unknown type asks for decisions."""
    out = facts.where(F.col("valid_to").isNull())
    if project is not None:
        out = out.where(F.col("project_id") == project)
    if fact_type is not None:
        out = out.where(F.col("fact_type") == S.parse_type(fact_type, S.FACT_TYPES, S.FACT_DEFAULT))
    return out.orderBy(F.desc("valid_from"), "id")


def fact_history(facts: DataFrame, node_id: str, project: str | None = None) -> DataFrame:
    out = facts.where(F.col("node_id") == node_id)
    return (out if project is None else out.where(F.col("project_id") == project)).orderBy(F.desc("valid_from"), "id")


def supersession_chain(facts: DataFrame, fact_id: str, most: int | None = None) -> DataFrame:
    """step, id: a fact, what superseded it, what superseded that, ... up to the last, or `most` steps if given (an extension).

    Each round doubles the steps that are followed, so a chain of n facts takes about log2(n) rounds of joins.  A fact comes once, at its first
    step, so a cycle ends where it closes; a successor that is no fact ends the chain.
    """
    ids = facts.select("id").distinct()
    jump = facts.select("id", F.col("superseded_by").alias("next")).join(ids.select(F.col("id").alias("next")), "next", "left_semi").select("id", "next").distinct()
    chain = ids.where(F.col("id") == fact_id).select(F.lit(0).alias("step"), "id")
    span, known = 1, 1
    while most is None or span <= most:
        later = chain.join(jump, "id").select((F.col("step") + span).alias("step"), F.col("next").alias("id"))
        chain = stash(chain.unionByName(later).groupBy("id").agg(F.min("step").alias("step")))
        before, known = known, chain.count()
        if known in (before, 0):
            break
        jump = stash(jump.join(jump.select(F.col("id").alias("next"), F.col("next").alias("further")), "next").select("id", F.col("further").alias("next")).distinct())
        span *= 2
    if most is not None:
        chain = chain.where(F.col("step") <= most)
    return chain.select("step", "id").orderBy("step", "id")
