"""URL filter: host and path rules, and where none fits, trust that runs along links between hosts.

Trust is a personalised PageRank from the hosts with allowed pages along their links; distrust is
one from the hosts with blocked pages against the direction of the links (who links to a blocked
host is suspect).  Both are shares of one, so a host is blocked if it holds more distrust than trust.

Everything is DataFrame functions.  Links are counted per pair of hosts before anything is shuffled
by host, so a host that holds a third of all pages is one row per task and target.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from journeyloom.llm.common import table
from journeyloom.sources.workspace import settle


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)
DAMPING, ROUNDS = 0.7, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A link target with its own host, and a host name in running text.
LINK = "(?:href|src)[ \\t\\n]*=[ \\t\\n]*[\"']?(?:https?:)?//([^/\"'?# \\t\\n>]+)"
MENTION = "[a-z0-9-]+(?:[.][a-z0-9-]+)+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a URL; both empty for null or without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, else null; rules are a list of bounded size."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(
        *[F.when(fits(r), F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ranked]
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, links): pages of host src that link to, or name, another host of the crawl.

    ``pages`` has host and html.  A page counts once per target; links inside a host do not count.
    """
    html = F.translate(F.coalesce("html", F.lit("")), _UPPER, _LOWER)
    targets = F.array_distinct(F.concat(F.regexp_extract_all(html, F.lit(LINK), 1), F.regexp_extract_all(html, F.lit(MENTION), 0)))
    counted = (
        pages.where("host <> ''")
        .select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )
    known = pages.where("host <> ''").select(F.col("host").alias("dst")).distinct()
    return counted.join(known, "dst", "left_semi").select("src", "dst", "links")


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) after some rounds; ``seeds`` is (host, allowed, blocked) page counts.

    Both graphs walk together as kinds of one table.  Where a host has no links in a graph, its rank
    ends there.  Hosts that no rank reaches have no row.
    """
    kinds = [("trust", "src", "dst", "allowed"), ("distrust", "dst", "src", "blocked")]
    edges = start = None
    for kind, a, b, weight in kinds:
        out = links.groupBy(F.col(a).alias("node")).agg(F.sum("links").alias("_all"))
        one = links.select(F.col(a).alias("node"), F.col(b).alias("to"), "links").join(out, "node").select(
            F.lit(kind).alias("kind"), "node", "to", (F.col("links") / F.col("_all")).alias("part")
        )
        total = seeds.agg(F.sum(weight).alias("_total"))  # one row
        seed = seeds.where(F.col(weight) > 0).crossJoin(F.broadcast(total)).select(
            F.lit(kind).alias("kind"), F.col("host").alias("node"), (F.col(weight) / F.col("_total")).alias("rank")
        )
        edges = one if edges is None else edges.unionByName(one)
        start = seed if start is None else start.unionByName(seed)
    edges, start = settle(edges, "host_edges"), settle(start, "host_seeds")
    back = start.select("kind", "node", (F.col("rank") * (1 - damping)).alias("rank"))
    ranks = start
    for done in range(1, rounds + 1):
        moved = ranks.join(edges, ["kind", "node"]).select("kind", F.col("to").alias("node"), (F.col("rank") * F.col("part") * damping).alias("rank"))
        ranks = moved.unionByName(back).groupBy("kind", "node").agg(F.sum("rank").alias("rank"))
        if done % 5 == 0:
            ranks = settle(ranks, "host_ranks")
    held = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy(F.col("node").alias("host")).agg(held("trust"), held("distrust"))


def judge_pages(pages: DataFrame, rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust per page (starts jobs).

    Urls that are null or have no ``://`` have empty host and path; no rule and no link is theirs, and
    like hosts that no rank reaches they are allowed.  Null html has no links.  Repeated rows are
    judged alike; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    ruled = split.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    count = lambda verdict: F.count(F.when(F.col("_fit.verdict") == verdict, 1))
    seeds = ruled.where("_fit is not null").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    ranks = propagate(settle(host_links(split), "host_links"), seeds, damping, rounds)
    doubt = F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0)) * (1 + 1e-9)
    return ruled.drop("html").join(ranks, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce("_fit.verdict", F.when(doubt, "block").otherwise("allow")).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages"))


def oracle_sql(rules: Sequence[Rule] = RULES, damping: float = DAMPING, rounds: int = ROUNDS) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    fold = f"'{_UPPER}', '{_LOWER}'"
    whens = " ".join(
        f"WHEN (host = {quoted(r.host)} OR ends_with(host, {quoted('.' + r.host)})) AND starts_with(path, {quoted(r.path)}) THEN %s"
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    )
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    steps, last = [], "seeded"
    for k in range(rounds):
        steps.append(
            f"r{k} AS MATERIALIZED (SELECT kind, node, sum(rank) AS rank FROM (SELECT e.kind, e.dest AS node, {last}.rank * e.part * {damping} AS rank "
            f"FROM {last} JOIN edges e ON e.kind = {last}.kind AND e.node = {last}.node "
            f"UNION ALL SELECT kind, node, rank * (1 - {damping}) FROM seeded) GROUP BY kind, node)"
        )
        last = f"r{k}"
    return f"""
WITH rest AS (
  SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(html, {fold}), '') AS html, translate(regexp_extract(rest, '^([^/?#]*)', 1), {fold}) AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE {whens % tuple(quoted(r.text) for r in ranked)} END AS rule,
         CASE {whens % tuple(quoted(r.verdict) for r in ranked)} END AS fit FROM split),
named AS (
  SELECT DISTINCT row, host AS src, unnest(regexp_extract_all(html, {quoted(LINK)}, 1) || regexp_extract_all(html, {quoted(MENTION)})) AS dst
  FROM (SELECT row_number() OVER () AS row, host, html FROM split WHERE host <> '')),
links AS (
  SELECT src, dst, count(*) AS links FROM named WHERE src <> dst AND dst IN (SELECT host FROM split) GROUP BY src, dst),
edges AS (
  SELECT 'trust' AS kind, src AS node, dst AS dest, links / sum(links) OVER (PARTITION BY src) AS part FROM links
  UNION ALL SELECT 'distrust', dst, src, links / sum(links) OVER (PARTITION BY dst) FROM links),
counted AS (
  SELECT CASE fit WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host AS node, count(*) AS n FROM ruled WHERE fit IS NOT NULL GROUP BY ALL),
seeded AS (SELECT kind, node, n / sum(n) OVER (PARTITION BY kind) AS rank FROM counted),
{", ".join(steps)},
ranks AS (
  SELECT node, sum(CASE kind WHEN 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) AS distrust FROM {last} GROUP BY node)
SELECT page_id, host, path, rule,
       coalesce(fit, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict,
       round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust
FROM ruled LEFT JOIN ranks ON node = host"""
