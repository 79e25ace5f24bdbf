"""URL verdicts from rules, and from trust and distrust that spread over the link graph of hosts.

A rule names a host and a path prefix; it fits the host and its subdomains.  The
longest fitting rule decides.  Where none fits, the page's host does: hosts of
allowed pages are seeds of trust, hosts of blocked pages seeds of distrust.
Trust is personalised PageRank along links; distrust is personalised PageRank
against them, so that who links to blocked hosts is distrusted.  A host whose
share of distrust in the two exceeds THRESHOLD is blocked, any other is allowed.

Links are the targets of a page's href attributes that name a host, with http: or
https: or without a scheme, summed by pair of hosts before anything is joined, so a
page or host with any number of links gives one edge a pair; links within a host say
nothing about others and are left out.

Ranks are settled when a step reaches no further host and changes less than TOLERANCE
of the mass, so every host that a seed reaches gets its share, however far it is.
Each step is one join and one sum; a hub's edges are split by Spark, and sums are
taken on the map side first.  A step's ranks are written out, which cuts the lineage.

Defined results: a null url, or one without ://, has empty host and path, fits
no rule and is allowed.  A null html has no links; a html of any length is searched
whole.  Of rules of one length that both fit the first counts.  A host that no seed
reaches, or whose share is the threshold itself, is allowed.  Repeated pages count
each.  An empty table gives an empty result.  Columns other than the named ones are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, unstash

DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """text: host and path prefix, like ``net/de/``."""

    verdict: str
    text: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, or null.  Of equally long ones the first counts."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        hit = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(r.fits(host, path), hit) if out is None else out.when(r.fits(host, path), hit)
    return out if out is not None else F.lit(None).cast("struct<rule: string, verdict: string>")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, n: links from one host to another."""
    target = F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)(?<![\w-])href\s*=\s*["']?(?:https?:)?//([^"'\s>/?#]+)"""), F.lit(1)))
    links = pages.select(host_of(F.col(url_col)).alias("src"), target.alias("to")).select("src", F.translate("to", _UPPER, _LOWER).alias("dst"))
    return links.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """host, trust, distrust from edges (src, dst, n) and seeds (host, good, bad: summed page counts).

    Mass that reaches a host without links to pass it on returns to the seeds, which only scales all ranks alike.  So ranks are
    summed without it, as the series of what the seeds pass on, and scaled to one at the end.
    """
    out_sum, in_sum = edges.groupBy(F.col("src").alias("host")).agg(F.sum("n").alias("o")), edges.groupBy(F.col("dst").alias("host")).agg(F.sum("n").alias("i"))
    hosts = edges.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    own = [F.coalesce(c, F.lit(0)).cast("double").alias(to) for c, to in (("good", "t"), ("bad", "d"))]
    nodes = seeds.join(hosts, "host", "full_outer").join(out_sum, "host", "left").join(in_sum, "host", "left")
    nodes = stash(nodes.select("host", *own, F.coalesce("o", F.lit(0)).alias("o"), F.coalesce("i", F.lit(0)).alias("i")), "hosts")
    # Each edge passes trust from src to dst and distrust from dst to src.
    flow = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b"), "n", F.lit(True).alias("fwd")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"), "n", F.lit(False).alias("fwd")))))
    base, ranks, last = nodes.select("host", F.col("t").alias("t0"), F.col("d").alias("d0")), nodes, None
    settled = edges.isEmpty()  # nothing spreads then: what the seeds have stays with them
    while not settled:
        passed = ranks.where("t > 0 OR d > 0").join(flow, ranks["host"] == flow["a"]).select(
            F.col("b").alias("to"), F.when(F.col("fwd"), F.col("t") * F.col("n") / F.col("o")).otherwise(0.0).alias("pt"), F.when(~F.col("fwd"), F.col("d") * F.col("n") / F.col("i")).otherwise(0.0).alias("pd")
        )
        summed = passed.groupBy("to").agg(F.sum("pt").alias("pt"), F.sum("pd").alias("pd"))
        got = lambda own, more: F.col(own) + F.lit(damping) * F.coalesce(F.col(more), F.lit(0.0))
        step = ranks.join(base, "host").join(summed, F.col("host") == F.col("to"), "left")
        new = stash(step.select("host", F.col("t").alias("was_t"), F.col("d").alias("was_d"), got("t0", "pt").alias("t"), got("d0", "pd").alias("d"), "o", "i"), "ranks")
        change = [F.sum(F.abs(F.col(c) - F.col(f"was_{c}"))) <= tolerance * F.sum(c) for c in ("t", "d")]
        reached = F.count_if(F.expr("(t > 0 AND was_t = 0) OR (d > 0 AND was_d = 0)")) == 0
        settled = new.agg((change[0] & change[1] & reached).alias("done")).first()["done"]
        if last is not None:
            unstash(last)
        ranks, last = new.select("host", "t", "d", "o", "i"), new
    total = ranks.agg(F.sum("t").alias("t"), F.sum("d").alias("d")).first()
    return ranks.select("host", (F.col("t") / F.lit(total["t"] or 1.0)).alias("trust"), (F.col("d") / F.lit(total["d"] or 1.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("hit", hit)
    seeds = seen.where(F.col("host") != "").groupBy("host").agg(F.count_if(F.col("hit.verdict") == "allow").alias("good"), F.count_if(F.col("hit.verdict") == "block").alias("bad"))
    edges = stash(host_edges(pages, url_col, html_col), "host-edges")
    hosts = propagate(edges, seeds)
    share = F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust"))
    own = F.when(share > threshold, "block").otherwise("allow")
    return seen.join(hosts, "host", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce(F.col("hit.verdict"), own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op7(spark, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
