"""Url rules, and trust and distrust spread over the link graph between hosts.

The longest rule that fits a url decides.  For urls without a rule their host does: hosts are seeds of trust by
the share of their pages that rules allow, and of distrust by the share that rules block.  Personalised PageRank
spreads trust along links and distrust against them (who links to blocked hosts is suspect), and a host whose
distrust exceeds its trust by ``border`` or more is blocked.  All of it is DataFrame work: links are counted by
pair of hosts first, so the graph has a row for each pair, and both scores move in one join and one sum a round.

Defined results: null urls and those without `://` have empty host and path, no rule and the verdict allow; null
html has no links; links within a host count for nothing; repeated rows give repeated rows; extra columns
aren't returned; an empty table gives no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many rules are compiled into one expression; more are joined as a table, with the same result.
MOST_RULES = 200


class Rule(NamedTuple):
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules in force.
RULES = (Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True), Rule("net", "/es/", False), Rule("net", "/fr/", False))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(rule: Rule) -> Column:
    return ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)


def longest_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, rule_allows: of distinct urls (host, path), the longest of the rules (rule_host, rule_path,
    allow) that fits, if any does; the first by name among equals. A url meets the rules of its host and of the
    domains above, by equal host."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = urls.withColumn("rule_host", F.explode(F.array_distinct(above))).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    best = F.min_by(F.struct(name.alias("rule"), F.col("allow").alias("rule_allows")), F.struct(-F.length(name), name))
    return met.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.*")


def with_rule(pages: DataFrame, rules: tuple[Rule, ...] = RULES, most: int = MOST_RULES) -> DataFrame:
    """page_id, host, path, html, rule (the longest that fits, else null), rule_allows."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    if len(rules) > most:
        known = pages.sparkSession.createDataFrame([(r.host, r.path, r.allow) for r in rules], "rule_host string, rule_path string, allow boolean")
        found = saved(longest_rules(rows.select("host", "path").distinct(), known), "url-rules")
        return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "html", "rule", "rule_allows")
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    rule = F.coalesce(F.lit(None).cast("string"), *[F.when(_fits(r), F.lit(r.name)) for r in longest])
    allows = F.coalesce(F.lit(None).cast("boolean"), *[F.when(F.col("rule") == r.name, F.lit(r.allow)) for r in longest])
    return rows.withColumn("rule", rule).withColumn("rule_allows", allows)


def host_links(rows: DataFrame) -> DataFrame:
    """from_host, to_host, n: links between different hosts in the anchors of pages."""
    found = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)<a\s(?:[^>]*\s)?href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1))
    to = host_of(F.concat(F.lit("://"), F.regexp_replace(F.col("link"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//", "")))
    links = rows.where((F.col("host") != "") & F.col("html").contains("//")).select(F.col("host").alias("from_host"), found.alias("link")).select("from_host", to.alias("to_host"))
    return links.where("to_host <> '' AND to_host <> from_host").groupBy("from_host", "to_host").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, follow: float = 0.85, still: float = 1e-6) -> DataFrame:
    """host, trust, distrust. ``seeds``: host, trust, distrust, the shares that rules allow and block.

    Trust divides over the links of a host, distrust over the links to it. Rounds end when what later rounds could
    still add, to all hosts together, is under ``still``; so no host's score is off by more. What a round adds is at
    most ``follow`` times what the one before added, which bounds the rounds by the logarithm of the sum of seeds.
    """
    columns = ["host", "trust", "distrust"]
    base = saved(seeds.select("host", ((1 - follow) * F.col("trust")).alias("trust"), ((1 - follow) * F.col("distrust")).alias("distrust")), "host-seeds")
    out = links.groupBy("from_host").agg(F.sum("n").alias("out_n"))
    into = links.groupBy("to_host").agg(F.sum("n").alias("in_n"))
    forward = links.join(out, "from_host").select(F.col("from_host").alias("source"), F.col("to_host").alias("target"), (F.col("n") / F.col("out_n")).alias("for_trust"), F.lit(0.0).alias("for_distrust"))
    backward = links.join(into, "to_host").select(F.col("to_host").alias("source"), F.col("from_host").alias("target"), F.lit(0.0).alias("for_trust"), (F.col("n") / F.col("in_n")).alias("for_distrust"))
    edges = saved(forward.unionByName(backward).groupBy("source", "target").agg(F.sum("for_trust").alias("for_trust"), F.sum("for_distrust").alias("for_distrust")), "host-edges")
    scores = base
    if edges.isEmpty():
        return scores
    mass = lambda df: df.agg(F.sum(F.col("trust") + F.col("distrust")).alias("x")).first().x or 0.0
    total = mass(base)
    rest = total * follow / (1 - follow)
    for _ in range(most_rounds(total, follow, still)):
        if rest <= still:
            return scores
        moved = edges.join(scores.withColumnRenamed("host", "source"), "source").select(F.col("target").alias("host"), (follow * F.col("trust") * F.col("for_trust")).alias("trust"), (follow * F.col("distrust") * F.col("for_distrust")).alias("distrust"))
        scores = saved(base.select(*columns).unionByName(moved).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "host-scores")
        # scores only grow, so their sums tell what was added
        before, total = total, mass(scores)
        rest = (total - before) * follow / (1 - follow)
    if rest > still:
        raise RuntimeError(f"scores of hosts don't rest: {rest} of {total} may be missing")
    return scores


def most_rounds(total: float, follow: float, still: float) -> int:
    """Rounds after which less than ``still`` of a sum of seeds is left to spread, and two for rounding."""
    left = total * follow / (1 - follow)
    return 2 + max(0, math.ceil(math.log(still / left) / math.log(follow))) if left > 0 else 1


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, follow: float = 0.85, border: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust.

    ``border``: how far distrust must exceed trust; by default half of what a host gets from seeds alone if all
    its pages are blocked, so that a host without links is blocked where rules block over half its pages.
    """
    border = (1 - follow) / 2 if border is None else border
    rows = with_rule(pages, rules)
    share = lambda allow: F.avg(F.when(F.col("rule_allows") == allow, 1.0).otherwise(0.0))
    seeds = rows.where("host <> ''").groupBy("host").agg(share(True).alias("trust"), share(False).alias("distrust"))
    # sources are pages and every end of a link; hosts seen only as targets have no seed
    scores = propagate(seeds, saved(host_links(rows), "host-links"), follow)
    blocked = saved(scores.select("host", "trust", "distrust", (F.col("distrust") - F.col("trust") > border).alias("blocked")), "host-verdicts")
    judged = rows.drop("html").join(blocked, "host", "left")
    verdict = F.when(F.coalesce(F.col("rule_allows"), ~F.coalesce(F.col("blocked"), F.lit(False))), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
