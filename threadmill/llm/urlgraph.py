"""URL verdicts from rules and from trust that spreads over the link graph of hosts.

Personalised PageRank runs from trusted hosts along links, and from blocked
hosts against them: whoever links to a blocked host is distrusted. Rules decide
first, the longest that fits; other pages go by their host's two scores.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Pages of a host that has more than one in so many are dealt to so many tasks.
SPREAD = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str


@dataclass
class Settings:
    damping: float = 0.85
    #: Rounds end when all ranks of a kind together change by less, or at the most rounds.
    tolerance: float = 1e-6
    rounds: int = 100
    #: A host is blocked from this share of distrust in both scores on.
    threshold: float = 0.5
    #: A host is a blocked seed if rules block this share of its pages.
    blocked_share: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(_part(url, r"^([^/?#]*)"), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, r"^[^/?#]*([^?#]*)")


def _part(url: Column, pattern: str) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), pattern, 1)), F.lit(""))


def with_rule(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``pages`` (host, path) with rule and action of the longest rule that fits; of equal ones a block goes first."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the list is short, so it becomes one expression; what is applied last wins
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.action == "block", r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit(f".{r.host}"))) & F.startswith("path", F.lit(r.path))
        rule, action = F.when(fits, r.host + r.path).otherwise(rule), F.when(fits, r.action).otherwise(action)
    return pages.withColumns({"rule": rule, "action": action})


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts; relative links stay on theirs."""
    links = F.regexp_extract_all("html", F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    absolute = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return found.select("src", host_of(absolute).alias("dst")).where("src <> dst AND src <> '' AND dst <> ''").distinct()


def scores(seeds: DataFrame, edges: DataFrame, s: Settings) -> DataFrame:
    """trust and distrust of each host that either reaches; ``seeds`` has kind (trust or distrust) and host.

    A seed's share is one over the number of its kind. What a host without
    links would pass on is lost, as in a walk that ends there. After the last
    round no kind's ranks are off by more than tolerance * damping / (1 - damping)
    in all, unless ``rounds`` ended them.
    """
    total = seeds.groupBy("kind").count()
    start = cut(seeds.join(F.broadcast(total), "kind").select("kind", "host", (1 / F.col("count")).alias("seed")))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst").union(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    degree = both.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    steps = cut(both.join(degree, ["kind", "src"]).withColumnRenamed("kind", "of"))
    back = start.select("kind", "host", ((1 - s.damping) * F.col("seed")).alias("rank"))
    ranks = back
    if not steps.isEmpty():
        for k in range(1, s.rounds + 1):
            moved = ranks.join(steps, (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src"))).select(
                "kind", F.col("dst").alias("host"), (s.damping * F.col("rank") / F.col("degree")).alias("rank")
            )
            new = moved.union(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
            if k % 3:
                ranks = new
                continue
            new = cut(new)
            # the change of the last round alone: ranks only grow, towards the limit
            total = lambda r, name: r.groupBy("kind").agg(F.sum("rank").alias(name))
            grown = total(new, "now").join(total(ranks, "before"), "kind").agg(F.max(F.col("now") - F.col("before"))).first()[0]
            ranks = new
            if grown is not None and grown < s.tolerance:
                break
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: list[Rule], settings: Settings | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust: one row for each row of ``pages``.

    A url that is null or has no ``://`` has an empty host and path, fits no
    rule and is allowed; so is a host that neither score reaches. Hosts whose
    pages rules block by ``blocked_share`` or more are blocked seeds; others
    with a page that a rule allows are trusted ones. Null html has no links,
    repeated page ids stay repeated, and further columns are left out.
    """
    s = settings or Settings()
    url = F.col("url").cast("string")
    named = with_rule(pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    of = lambda action: F.count_if(F.col("action") == action)
    hosts = cut(named.groupBy("host").agg(F.count("*").alias("n"), of("block").alias("bad"), of("allow").alias("good")))
    kind = F.when((F.col("bad") > 0) & (F.col("bad") >= s.blocked_share * F.col("n")), "distrust").when(F.col("good") > 0, "trust")
    seeds = hosts.select(kind.alias("kind"), "host").where("host <> '' AND kind IS NOT NULL")
    found = scores(seeds, host_edges(pages.select(url.alias("url"), "html")), s)
    # hosts with more than one in SPREAD pages are fewer than SPREAD; their pages go to as many tasks
    pages_all = hosts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(hosts.where(F.col("n") * SPREAD > pages_all).select("host", F.lit(True).alias("hot")))
    zero = F.lit(0).cast("long")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("page_id", "path"), F.lit(SPREAD))).otherwise(zero)
    salts = F.when(F.col("hot"), F.sequence(zero, zero + (SPREAD - 1))).otherwise(F.array(zero))
    known = found.join(hot, "host", "left").select("host", "trust", "distrust", F.explode(salts).alias("salt"))
    blocked = F.coalesce(F.col("distrust") >= s.threshold * (F.col("trust") + F.col("distrust")), F.lit(False)) & (F.col("distrust") > 0)
    method = F.when(blocked, "block").otherwise("allow")
    return named.join(hot, "host", "left").withColumn("salt", salt).join(known, ["host", "salt"], "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def oracle(rules: list[Rule], s: Settings) -> str:
    """DuckDB SQL with the same rows; all ``rounds`` are walked, without a look at the change."""
    lower = f"translate(%s, '{UPPER}', '{LOWER}')"
    tail = "CASE WHEN contains({0}, '://') THEN substr({0}, instr({0}, '://') + 3) ELSE '' END"
    host = lambda x: lower % f"regexp_extract({tail.format(x)}, '^([^/?#]*)', 1)"
    path = f"regexp_extract({tail.format('url')}, '^[^/?#]*([^?#]*)', 1)"
    order = sorted(rules, key=lambda r: (len(r.host + r.path), r.action == "block", r.host + r.path), reverse=True)
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in order) + " END"
    link = r"""(?i)\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)"""
    parts = [
        f"u AS (SELECT page_id, coalesce(url, '') AS url, html FROM pages), h AS (SELECT page_id, {host('url')} AS host, {path} AS path FROM u)",
        f"n AS (SELECT *, {case(lambda r: r.host + r.path)} AS rule, {case(lambda r: r.action)} AS action FROM h)",
        "m AS (SELECT host, count(*) AS n, count(*) FILTER (action = 'block') AS bad, count(*) FILTER (action = 'allow') AS good FROM n WHERE host <> '' GROUP BY host)",
        f"k AS (SELECT host, CASE WHEN bad > 0 AND bad >= {s.blocked_share} * n THEN 'distrust' WHEN good > 0 THEN 'trust' END AS kind FROM m)",
        "seed AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM k WHERE kind IS NOT NULL)",
        f"l AS (SELECT {host('url')} AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM u)",
        f"e AS (SELECT DISTINCT src, {host('full_link')} AS dst FROM (SELECT src, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS full_link FROM l))",
        "g AS (SELECT * FROM e WHERE src <> dst AND src <> '' AND dst <> '')",
        "b AS (SELECT 'trust' AS kind, src, dst FROM g UNION ALL SELECT 'distrust', dst, src FROM g)",
        "w AS (SELECT *, count(*) OVER (PARTITION BY kind, src) AS degree FROM b)",
        f"r0 AS (SELECT kind, host, {1 - s.damping} * seed AS rank FROM seed)",
        # ranks are sums over walks: each round's mass moves on from the round before
        f"x AS (SELECT 0 AS round, kind, host, rank FROM r0 UNION ALL SELECT x.round + 1, w.kind, w.dst, sum({s.damping} * x.rank / w.degree) FROM x JOIN w ON x.kind = w.kind AND x.host = w.src WHERE x.round < {s.rounds} GROUP BY ALL)",
    ]
    parts.append("t AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM x GROUP BY host)")
    return (
        "WITH RECURSIVE " + ",\n".join(parts) + "\nSELECT n.page_id, n.host, n.path, n.rule, coalesce(n.action, CASE WHEN t.distrust > 0 AND "
        f"t.distrust >= {s.threshold} * (t.trust + t.distrust) THEN 'block' ELSE 'allow' END) AS verdict FROM n LEFT JOIN t ON n.host = t.host"
    )
