"""URL filter: rules, and link-graph propagation for what no rule judges.

Hosts are nodes; an edge is a host linking to another, weighed by the number of
pages that do.  Hosts with pages that a rule allows are trusted seeds, hosts with
blocked pages are distrusted ones, each weighed by these pages.  Trust walks along
the links and distrust against them, as personalised PageRank: in each round a
share ``DAMPING`` of what arrived at a host goes on, split by edge weight, and
all that ever arrived makes its score.  A host is blocked if distrust makes at
least ``BLOCK_SHARE`` of its two scores; a host that nothing reaches is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stages import drop, stage

DAMPING, TOLERANCE, BLOCK_SHARE = 0.85, 0.01, 0.5
# After so many rounds less than TOLERANCE of the seeds' weight is still walking.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
# (verdict, host, path prefix): for the host and its subdomains.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
_LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s<>]+)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, pages): hosts that link to other hosts, by the absolute links of their pages."""
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)),
                                         lambda x: F.translate(x, _UPPER, _LOWER)))
    rows = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("dst"))
    return rows.where((F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("pages"))


def propagate(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) for the hosts reached from ``seeds`` (kind, host, mass) over ``edges``."""
    def steps(kind: str, start: str, to: str) -> DataFrame:
        total = edges.groupBy(F.col(start).alias("from")).agg(F.sum("pages").alias("all"))
        return edges.select(F.col(start).alias("from"), F.col(to).alias("to"), "pages").join(total, "from").select(
            F.lit(kind).alias("kind"), "from", "to", (DAMPING * F.col("pages") / F.col("all")).alias("share"))

    walk = stage(steps("trust", "src", "dst").union(steps("distrust", "dst", "src")), "walk")
    arrived = [stage(seeds, "arrived")]
    if not walk.isEmpty():
        for _ in range(ROUNDS):
            last = arrived[-1]
            onward = walk.join(last.withColumnRenamed("host", "from"), ["kind", "from"]).groupBy(
                "kind", F.col("to").alias("host")).agg(F.sum(F.col("share") * F.col("mass")).alias("mass"))
            arrived.append(stage(onward, "arrived"))
            if arrived[-1].isEmpty():
                break
    every = arrived[0]
    for more in arrived[1:]:
        every = every.unionByName(more)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0.0))
    out = stage(every.groupBy("host").agg(part("trust").alias("trust"), part("distrust").alias("distrust")), "scores")
    drop(walk, *arrived)
    return out


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but the HTML, with host, path, rule, verdict, trust and distrust.

    Null or odd urls have an empty host and path, no rule and no score; pages without
    HTML have no links; rows that repeat are judged alike and count as pages of
    their own.  An empty table gives an empty result.  Columns of the input with the
    names of the new ones are replaced.
    """
    new = ("host", "path", "rule", "verdict", "trust", "distrust")
    url, kept = F.col(f"`{url_col}`"), [F.col(f"`{c}`") for c in pages.columns if c not in (html_col, *new)]
    ruled = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = ruled.withColumn("_rule", _rule(F.col("host"), F.col("path"), rules))
    by_host = ruled.where(F.col("_rule").isNotNull() & (F.col("host") != "")).groupBy(
        F.when(F.col("_rule.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count("*").alias("n"))
    by_host = stage(by_host, "seeds")
    total = by_host.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = by_host.join(F.broadcast(total), "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("mass"))  # two rows
    edges = stage(host_edges(pages, f"`{url_col}`", f"`{html_col}`"), "edges")
    scores = propagate(seeds, edges)
    drop(by_host, edges)
    both = F.col("trust") + F.col("distrust")
    by_method = F.when((both > 0) & (F.col("distrust") >= BLOCK_SHARE * both), "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        *kept, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "host", "path", "rule", "verdict")


ORACLE = rf"""
WITH RECURSIVE p AS (SELECT page_id, html,
  translate(coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
u(verdict, h, prefix) AS (VALUES {", ".join(str(r) for r in RULES)}),
r AS (SELECT page_id, host, arg_max(h || prefix, len(h || prefix)) AS rule, arg_max(verdict, len(h || prefix)) AS verdict
  FROM p JOIN u ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, prefix) GROUP BY ALL),
n AS (SELECT if(verdict = 'allow', 'trust', 'distrust') AS kind, host, count(*) AS n FROM r WHERE host <> '' GROUP BY ALL),
link AS (SELECT DISTINCT page_id, host AS src,
  translate(unnest(regexp_extract_all(html, '{_LINK.replace("'", "''")}', 1)), '{_UPPER}', '{_LOWER}') AS dst FROM p WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS pages FROM link WHERE src <> dst GROUP BY ALL),
walk AS (SELECT 'trust' AS kind, src AS a, dst AS b, {DAMPING} * pages / sum(pages) OVER (PARTITION BY src) AS share FROM e
  UNION ALL SELECT 'distrust', dst, src, {DAMPING} * pages / sum(pages) OVER (PARTITION BY dst) FROM e),
f AS (SELECT 0 AS round, kind, host, n / sum(n) OVER (PARTITION BY kind) AS mass FROM n
  UNION ALL SELECT round + 1, walk.kind, b, sum(share * mass) FROM f JOIN walk ON walk.kind = f.kind AND a = f.host
  WHERE round < {ROUNDS} GROUP BY round, walk.kind, b),
s AS (SELECT host, coalesce(sum(mass) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (kind = 'distrust'), 0) AS distrust
  FROM f GROUP BY host)
SELECT p.page_id, p.host, path, rule, coalesce(verdict,
  CASE WHEN trust + distrust > 0 AND distrust >= {BLOCK_SHARE} * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN r ON r.page_id = p.page_id LEFT JOIN s ON s.host = p.host
"""
