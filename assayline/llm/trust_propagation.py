"""URL filter: rules first, then trust and distrust carried along links between hosts.

The project keeps no crawled pages, so this operator is general: any table of (page_id, url, html).
Trust spreads from hosts with allowed pages to the hosts they link to (personalised PageRank);
distrust spreads from hosts with blocked pages to the hosts that link to them. All steps are
DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import quoted
from assayline.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class UrlRule:
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the filter.
RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The longest rule that fits, as struct(text, verdict); null if none. Ties go to the first listed."""
    found = F.lit(None).cast("struct<text:string, verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, links): absolute links between different hosts, counted; null html has none."""
    links = pages.select(host_of(quoted(url)).alias("src"), F.explode(F.regexp_extract_all(quoted(html), F.lit(HREF), 1)).alias("link"))
    # A link without a scheme starts with // and takes the page's.
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link"))
    ends = links.select("src", host_of(absolute).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return ends.groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-9, passes: int = 10_000) -> DataFrame:
    """(host, trust, distrust) from ``edges`` (src, dst, links) and ``seeds`` (host, trusted, blocked weights).

    Both kinds run in the same passes. Each kind's seed weights sum to 1; a host without outgoing
    links keeps nothing to pass on. Hosts that no seed reaches do not appear. A pass moves on only what
    the one before brought, and passes end once they reach no new host and bring less than ``tolerance``
    in sum; if that is not so after ``passes`` of them, the call fails. Every pass is written,
    so a lost executor repeats one pass at most.
    """
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links")
    backward = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    both = materialise(forward.unionAll(backward))
    # Written, so that both sides of the joins are plain tables, whose large partitions Spark can split.
    out = materialise(both.groupBy("kind", "src").agg(F.sum("links").alias("total")))
    steps = materialise(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("total")).alias("w")))
    start = seeds.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trusted", "blocked"))).alias("kind", "weight")).filter("weight > 0")
    totals = start.groupBy("kind").agg(F.sum("weight").alias("total"))  # two rows
    base = materialise(start.join(F.broadcast(totals), "kind").select("kind", "host", ((1 - damping) * F.col("weight") / F.col("total")).alias("rank")))
    rank = moved = base
    for _ in range(passes):
        onward = moved.withColumnRenamed("host", "src").join(steps, ["kind", "src"])
        onward = onward.select("kind", F.col("dst").alias("host"), (damping * F.col("rank") * F.col("w")).alias("rank"))
        moved = materialise(onward.groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        known = rank.select("kind", "host", F.lit(True).alias("known"))
        brought = moved.join(known, ["kind", "host"], "left").agg(F.coalesce(F.sum("rank"), F.lit(0.0)), F.count_if(F.col("known").isNull())).first()
        if not any(brought):
            break
        rank = materialise(rank.unionAll(moved).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        if brought[0] < tolerance and not brought[1]:
            break
    else:
        raise RuntimeError(f"ranks have not settled after {passes} passes")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules: tuple[UrlRule, ...] = RULES,
    damping: float = 0.85,
    tolerance: float = 1e-9,
    passes: int = 10_000,
    block_ratio: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust): one row per row of ``pages``.

    The longest fitting rule decides. Without one the page is blocked if its host's distrust is above
    ``block_ratio`` times its trust, and allowed otherwise (so also where no seed reaches it). Seeds
    are the hosts of pages decided by a rule, weighted by their number of pages. A null url, or one
    without ``://``, has empty host and path; empty hosts take no part in the links. Repeated rows
    give repeated rows; links on repeated pages count again.
    """
    rows = pages.select(
        quoted(page_id).alias("page_id"), host_of(quoted(url)).alias("host"), path_of(quoted(url)).alias("path")
    ).withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    count_of = lambda verdict: F.count_if(F.col("found.verdict") == verdict).cast("double")
    seeds = rows.filter("found IS NOT NULL AND host <> ''").groupBy("host").agg(count_of("allow").alias("trusted"), count_of("block").alias("blocked"))
    ranks = materialise(propagate(host_edges(pages, url=url, html=html), seeds, damping=damping, tolerance=tolerance, passes=passes))
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when(distrust > block_ratio * trust, F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(ranks, "host", "left").select(
        "page_id", "host", "path", F.col("found.text").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust")
    )
