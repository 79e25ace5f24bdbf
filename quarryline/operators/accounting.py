"""Token accounting: an append-only log and its reports."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.sources.store import DERIVED, Derived, Snapshot

#: Seconds of a rollup's slot.  The offsets of time zones are whole slots, so a slot lies within one day anywhere.
SLOT = 900
SUMS = {"total_pointer_tokens": "pointer_tokens", "total_fetched_tokens": "fetched_tokens", "total_traditional_estimate": "traditional_est"}


def _totals() -> list[Column]:
    return [F.count("*").alias("total_queries"), *(F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(n) for n, c in SUMS.items())]


def with_savings(totals: DataFrame) -> DataFrame:
    """Adds the tokens saved, never below zero, and their share of the traditional estimate in percent."""
    saved = F.greatest(F.col("total_traditional_estimate") - F.col("total_pointer_tokens") - F.col("total_fetched_tokens"), F.lit(0).cast("long"))
    out = totals.withColumn("cumulative_savings_tokens", saved)
    return out.withColumn("cumulative_savings_pct", F.when(F.col("total_traditional_estimate") > 0, F.col("cumulative_savings_tokens") / F.col("total_traditional_estimate") * 100).otherwise(0.0))


def stats(log: DataFrame, project: str | None = None, session: str | None = None, since: Column | None = None, day: Column | None = None, zone: str = "UTC") -> DataFrame:
    """One row over the log, narrowed by project, session, a first moment, or a calendar day in a time zone."""
    if project is not None:
        log = log.where(F.col("project_id") == project)
    if session is not None:
        log = log.where(F.col("session_id") == session)
    if since is not None:
        log = log.where(F.col("created_at") >= since)
    if day is not None:
        log = log.where(F.to_date(F.from_utc_timestamp("created_at", zone)) == day)
    return with_savings(log.agg(*_totals()))


def stats_by(log: DataFrame, *keys: str) -> DataFrame:
    """The same for each value of the keys."""
    return with_savings(log.groupBy(*keys).agg(*_totals()))


def _slot(at: Column) -> Column:
    return F.floor(F.unix_micros(at) / (SLOT * 1_000_000))


def rollup(log: DataFrame) -> dict[str, DataFrame]:
    """Counts and sums of each project, session and slot, as the table accounting_sums.  The store makes it of segments as it merges them."""
    keys = ["project_id", "session_id", _slot(F.col("created_at")).alias("slot")]
    return {"accounting_sums": log.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in SUMS.values()))}


DERIVED["accounting"] = Derived(("accounting_sums",), rollup, at_once=False)


def stored_stats(now: Snapshot, project: str, session: str | None = None, since: Column | None = None, day: Column | None = None, zone: str = "UTC") -> DataFrame:
    """`stats` of a store's log: rollups of the merged segments, rows of those that are not merged yet, and rows of the slot in which `since` falls."""
    merged = {e["unit"] for e in now.entries("accounting_sums", project)}
    parts: dict[bool, list[dict]] = {True: [], False: []}
    for e in now.entries("accounting", project):
        parts[e["unit"] in merged].append(e)
    moment = F.col("created_at")
    pieces = [(now.rows("accounting", parts[False]), moment), (now.rows("accounting_sums", now.entries("accounting_sums", project)), F.timestamp_seconds(F.col("slot") * SLOT))]
    if since is not None and parts[True]:
        pieces.append((now.rows("accounting", parts[True]).where((moment >= since) & (moment < F.timestamp_seconds((_slot(since) + 1) * SLOT)) & (_slot(since) * SLOT * 1_000_000 < F.unix_micros(since))), moment))
    out = []
    for df, at in pieces:
        df = df.where(F.col("project_id") == project)
        if session is not None:
            df = df.where(F.col("session_id") == session)
        if since is not None:
            df = df.where(at >= since)
        if day is not None:
            df = df.where(F.to_date(F.from_utc_timestamp(at, zone)) == day)
        n = F.col("n") if "n" in df.columns else F.lit(1).cast("long")
        out.append(df.select(n.alias("n"), *SUMS.values()))
    rows = functools.reduce(DataFrame.unionByName, out)
    zero = F.lit(0).cast("long")
    return with_savings(rows.agg(F.coalesce(F.sum("n"), zero).alias("total_queries"), *(F.coalesce(F.sum(c), zero).alias(name) for name, c in SUMS.items())))


def seconds_ago(now: Column, seconds: int) -> Column:
    return now - F.make_dt_interval(secs=F.lit(seconds))
