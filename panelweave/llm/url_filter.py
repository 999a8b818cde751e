"""URL verdicts from rules and from the company a host keeps, with built-in expressions only.

Rules decide first. A host without a rule for its page is judged by two personalised PageRanks over host edges: trust flows along
links from hosts with allowed pages, distrust flows against them from hosts with blocked pages. Host edges are the links
of the pages to other hosts, and the tie between a host and the nearest domain above it that is a host itself, in both
directions. A public suffix such as co.uk is no host, so it ties nobody; addresses (1.2.3.4) have no domain above them. User
info and port are no part of a host's name in the graph."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import stage
from .text import columns

log = logging.getLogger(__name__)

# fixed: (verdict, rule); a rule is a host and the start of a path
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"://([^/?#]*)([^?#]*)"
NUMBERS = r"^[0-9.]+$"
LINK = r"""(?i)(?:href|src|action)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
CHANGE = 1e-4  # share of a host's score below which what still arrives is not passed on
MARGIN = 2.0  # a host is blocked when its distrust is more than so many times its trust


def located(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, ADDRESS, 1), UPPER, LOWER), F.regexp_extract(u, ADDRESS, 2)


def node(host: Column) -> Column:
    """A host's name in the graph: without user info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, nulls if none does; equal lengths: the first listed."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): number of links between different hosts, and 1 for each tie to a parent host, either way."""
    host, _ = located(F.col("url"))
    at = pages.select(node(host).alias("src"), "html").filter("src <> ''")
    links = (
        at.filter(F.col("html").isNotNull())
        .select("src", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("to"))
        .select("src", node(F.translate("to", UPPER, LOWER)).alias("dst"))
        .filter("src <> dst AND dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    hosts = stage(at.select("src").unionAll(links.select("dst")).distinct().withColumnRenamed("src", "host"), "hosts")
    parts = F.split("host", r"\.")
    n = F.size(parts)
    # every domain above a host down to two labels; the longest that is a host is its parent
    above = (
        hosts.filter((n > 2) & ~F.col("host").rlike(NUMBERS))
        .select("host", F.explode(F.sequence(F.lit(2), n - 1)).alias("labels"), parts.alias("parts"))
        .select(F.col("host").alias("a"), "labels", F.array_join(F.slice("parts", -F.col("labels"), F.col("labels")), ".").alias("host"))
    )
    ties = above.join(hosts, "host").groupBy("a").agg(F.max_by("host", "labels").alias("b"))
    both = ties.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionAll(
        ties.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    return links.unionAll(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def host_scores(edges: DataFrame, seeds: DataFrame, change: float = CHANGE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) of every host that is reached from ``seeds`` (host, allowed, blocked: numbers of pages).

    Teleports are in proportion to those numbers. A round passes on what has just arrived at a host, and adds it to the
    host's score; what arrives is passed on as long as it is more than ``change`` of that score, so a host that is reached
    for the first time always passes it on, however far it lies from the seeds and however little it is. The rounds end when
    nothing is left to pass on: what is neglected is less than change / (1 - damping) of a score. What reaches a host
    without an edge is not dealt out again. Every fourth round is written, so that a lost executor costs no long
    recomputation."""
    steps = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").unionAll(
        edges.select(F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "weight")
    )
    out = steps.groupBy("kind", "host").agg(F.sum("weight").alias("all"))
    steps = stage(
        steps.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("all")).alias("share")), "steps"
    )
    counted = seeds.select(F.lit(0).alias("kind"), "host", F.col("allowed").cast("double").alias("n")).unionAll(
        seeds.select(F.lit(1).alias("kind"), "host", F.col("blocked").cast("double").alias("n"))
    )
    total = {r.kind: r.n for r in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # two rows
    part = F.when(F.col("kind") == 0, F.lit(total.get(0) or 1.0)).otherwise(F.lit(total.get(1) or 1.0))
    first = counted.filter("n > 0").groupBy("kind", "host").agg(F.sum(F.col("n") / part).alias("new"))
    state = stage(first.select("kind", "host", "new", F.col("new").alias("score")), "scores")
    rounds = 0
    while not state.filter("new > 0").isEmpty():
        for _ in range(4):
            moved = state.filter("new > 0").join(steps, ["kind", "host"]).select(
                "kind", F.col("to").alias("host"), (F.col("new") * F.col("share") * damping).alias("new"), F.lit(0.0).alias("score")
            )
            state = (
                moved.unionAll(state.select("kind", "host", F.lit(0.0).alias("new"), "score"))
                .groupBy("kind", "host")
                .agg(F.sum("new").alias("new"), F.sum("score").alias("score"))
                .withColumn("score", F.col("score") + F.col("new"))
                .withColumn("new", F.when(F.col("new") > change * F.col("score"), F.col("new")).otherwise(0.0))
            )
        state = stage(state, "scores")
        rounds += 4
    log.info("host scores after %d rounds", rounds)
    state = state.withColumn("score", F.col("score") * (1 - damping))
    return state.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"),
    )


def judged_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule (null without one) and verdict (allow or block) of every row of ``pages`` (page_id, url, html).

    A null url or one without :// has an empty host and path, no rule and no score, and is allowed, as is every host that
    neither trust nor distrust reaches. Urls and texts of any length are read whole. Null html has no links; null ids are kept. Repeated rows are judged alike, and
    their links count again. Other columns are ignored; an empty table gives an empty table."""
    clean = columns(pages, page_id="bigint", url="string", html="string")
    host, path = located(F.col("url"))
    judged = clean.select("page_id", host.alias("host"), path.alias("path")).withColumn(
        "r", ruled(F.col("host"), F.col("path"), rules)
    )
    is_a = lambda v: F.count(F.when(F.col("r.verdict") == v, 1))
    seeds = stage(
        judged.withColumn("host", node(F.col("host")))
        .filter("host <> ''")
        .groupBy("host")
        .agg(is_a("allow").alias("allowed"), is_a("block").alias("blocked")),
        "seeds",
    )
    scores = host_scores(stage(host_edges(clean), "edges"), seeds)
    bad = scores.filter(F.col("distrust") > MARGIN * F.col("trust")).select(F.col("host").alias("node"), F.lit("block").alias("by_host"))
    return judged.withColumn("node", node(F.col("host"))).join(bad, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", "by_host", F.lit("allow")).alias("verdict"),
    )


def _verdicts_sql() -> str:
    """The same for DuckDB, by the series of what arrives round after round, until nothing above 1e-15 is left."""
    fits = "\n".join(
        f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{v} {h}/{p}'"
        for v, (h, _, p) in sorted(((v, r.partition('/')) for v, r in RULES), key=lambda x: -len("".join(x[1])))
    )
    link = LINK.replace("'", "''")
    name = lambda host: f"regexp_replace(regexp_replace({host}, '^.*@', ''), ':[0-9]*$', '')"
    return rf"""
WITH RECURSIVE u AS (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '{ADDRESS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{ADDRESS}', 2) AS path FROM pages),
j AS MATERIALIZED (SELECT *, {name('host')} AS node, CASE
{fits} END AS hit FROM u),
l AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS w FROM (SELECT src, {name('dst')} AS dst FROM (SELECT node AS src,
    translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM j WHERE node <> ''))
    WHERE src <> dst AND dst <> '' GROUP BY src, dst),
h AS (SELECT node AS host FROM j WHERE node <> '' UNION SELECT dst FROM l),
up AS (SELECT host AS a, i, array_to_string(p[-i:], '.') AS b FROM (SELECT host, string_split(host, '.') AS p FROM h
    WHERE NOT regexp_matches(host, '{NUMBERS}')) x, unnest(range(2, len(p))) AS y(i)),
tie AS (SELECT a, arg_max(b, i) AS b FROM up WHERE b IN (SELECT host FROM h) GROUP BY a),
e AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM l UNION ALL SELECT a, b, 1 FROM tie UNION ALL SELECT b, a, 1 FROM tie)
    GROUP BY src, dst),
k AS (SELECT 0 AS kind, src, dst, w FROM e UNION ALL SELECT 1, dst, src, w FROM e),
steps AS MATERIALIZED (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM k),
n AS (SELECT CASE WHEN hit LIKE 'allow%' THEN 0 ELSE 1 END AS kind, node AS host, count(*) AS n FROM j
    WHERE hit IS NOT NULL AND node <> '' GROUP BY 1, 2),
s AS (SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS score FROM n
  UNION ALL SELECT t.kind, t.dst, sum(s.score * t.share * {DAMPING}) FROM s JOIN steps t ON s.kind = t.kind AND s.host = t.src
  GROUP BY t.kind, t.dst HAVING sum(s.score * t.share * {DAMPING}) > 1e-15),
bad AS (SELECT host FROM s GROUP BY host
    HAVING sum(CASE WHEN kind = 1 THEN score ELSE 0 END) > {MARGIN} * sum(CASE WHEN kind = 0 THEN score ELSE 0 END))
SELECT page_id, host, path, nullif(substr(coalesce(hit, ''), 7), '') AS rule,
    CASE WHEN hit IS NOT NULL THEN substr(hit, 1, 5) WHEN node IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


VERDICTS_SQL = _verdicts_sql()
