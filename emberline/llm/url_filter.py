"""URL filter: rules first, then trust and distrust spread over the host graph.

Hosts are joined by the absolute links of their pages.  Trust is a personalised
PageRank that starts at hosts with allowed pages; distrust runs against the
links from hosts with blocked pages, as a host that links to blocked ones is
suspect.  A host whose distrust passes a threshold and its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.sources.staging import stage

#: Verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
ROUNDS = 10
DAMPING = 0.85
THRESHOLD = 0.5  # of distrust, in units of what a host with blocked pages only has of itself
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first `://`, A-Z lower-cased, and the path up to `?`, `#` or the end; '' if there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p).otherwise(rule)
        verdict = F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, of pages with columns host and html."""
    link = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"
    found = pages.filter((F.col("host") != "") & F.col("html").isNotNull() & F.col("html").contains("//")).select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(link), F.lit(1))).alias("to")
    )
    dst, _ = host_and_path(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to")))
    return found.withColumn("dst", dst).filter("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, mass) of a personalised PageRank from ``seeds`` (host, seed) along ``edges`` (src, dst, share)."""
    start = seeds.select("host", ((1 - damping) * F.col("seed")).alias("mass"))
    mass = start
    for _ in range(rounds):
        # one row per edge; the partial sums are taken before the exchange
        moved = edges.join(mass, F.col("src") == F.col("host")).groupBy("dst").agg(
            F.sum(damping * F.col("share") * F.col("mass")).alias("mass")
        )
        both = start.unionByName(moved.withColumnRenamed("dst", "host"))
        mass = stage(both.groupBy("host").agg(F.sum("mass").alias("mass")), "mass")
    return mass


def _shares(edges: DataFrame, source: str, target: str) -> DataFrame:
    out = edges.groupBy(source).agg(F.sum("n").alias("total"))
    return stage(
        edges.join(out, source).select(
            F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("n") / F.col("total")).alias("share")
        ),
        "shares",
    )


def judge(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    rounds: int = ROUNDS,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Verdict on every row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A fitting rule decides; otherwise the host is blocked if its distrust is
    above ``threshold`` and above its trust, and allowed if not, so also where
    nothing is known of it.  A null url or one without `://` has empty host and
    path and is allowed.  Null html has no links; repeated rows are judged
    alike, and each of their links counts.  An empty table gives no rows; other
    columns are ignored.
    """
    url = F.col(f"`{url_col}`").cast("string")
    host, path = host_and_path(url)
    base = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"),
        F.col(f"`{html_col}`").cast("string").alias("html"),
    )
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"rule": rule, "by_rule": verdict})
    edges = stage(host_edges(base), "host-edges")
    hosts = ruled.filter("host <> ''").groupBy("host").agg(
        F.avg(F.coalesce(F.col("by_rule") == "allow", F.lit(False)).cast("double")).alias("good"),
        F.avg(F.coalesce(F.col("by_rule") == "block", F.lit(False)).cast("double")).alias("bad"),
    )
    hosts = stage(hosts, "hosts")
    trust = spread(_shares(edges, "src", "dst"), hosts.filter("good > 0").select("host", F.col("good").alias("seed")), rounds)
    distrust = spread(_shares(edges, "dst", "src"), hosts.filter("bad > 0").select("host", F.col("bad").alias("seed")), rounds)
    known = hosts.join(trust.withColumnRenamed("mass", "trust"), "host", "left").join(
        distrust.withColumnRenamed("mass", "distrust"), "host", "left"
    ).select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    known = stage(known, "host-verdicts")
    out = ruled.drop("html").join(known, "host", "left")
    limit = threshold * (1 - DAMPING)
    suspect = (F.col("distrust") > limit) & (F.col("distrust") > F.col("trust"))
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("by_rule", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
