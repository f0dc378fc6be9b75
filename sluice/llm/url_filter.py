"""Operator 4: URL rules, and host verdicts by trust and distrust that spread over links; DataFrame functions alone."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The host of each link of a page that names one: href, then // and what may stand before it.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Spread:
    """``damping`` of the propagation, which goes on until at most a share of ``tolerance`` of the mass can still move.  A host is blocked if its distrust is
    over ``factor`` times its trust.  ``unrolled``: rounds in one job."""

    damping: float = 0.85
    tolerance: float = 0.01
    factor: float = 1.0
    unrolled: int = 5

    @property
    def rounds(self) -> int:
        """After so many rounds ``damping ** rounds``, the mass that has not come to rest, is at most ``tolerance``."""
        return math.ceil(math.log(self.tolerance) / math.log(self.damping))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def ruling(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits (ties: the first in alphabetical order, blocks before allows), else null.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name], r.verdict != "block")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def propagate(links: DataFrame, seeds: DataFrame, spread: Spread, written: Written) -> DataFrame:
    """(host, trust, distrust): personalised PageRank from seeds (columns host, trust, distrust: weights), along ``links`` (source, target, n) for
    trust and against them for distrust.

    Each kind of weight is scaled to a sum of 1; a score is (1 - damping) of the seed's share plus damping times what comes in, by links' share of
    ``n``; what a host without links holds is not passed on.  Both kinds spread in one job a round, over the same written edges.
    """
    sums = seeds.agg(F.sum("trust"), F.sum("distrust")).first()
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), (F.col("trust") / (sums[0] or 1.0)).alias("share")), F.struct(F.lit(1).alias("kind"), (F.col("distrust") / (sums[1] or 1.0)).alias("share"))))
    start = written(seeds.select("host", kinds.alias("k")).select("host", "k.kind", "k.share").where("share > 0"))
    both = links.select("source", "target", "n").select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "n"), F.struct(F.lit(1).alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "n"))).alias("e")).select("e.*")
    both = written(both)
    out_sums = written(both.groupBy("kind", "from").agg(F.sum("n").alias("all")))
    edges = written(both.join(out_sums, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("w")))
    base = start.select("kind", "host", (F.col("share") * (1 - spread.damping)).alias("score"))
    scores = base
    if not edges.isEmpty():
        for i in range(1, spread.rounds + 1):
            came = edges.join(scores.withColumnRenamed("host", "from"), ["kind", "from"]).select("kind", F.col("to").alias("host"), (F.col("w") * F.col("score") * spread.damping).alias("score"))
            scores = came.union(base).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if i % spread.unrolled == 0 or i == spread.rounds:
                scores = written(scores)
    return scores.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"))


def domain_links(hosts: DataFrame) -> DataFrame:
    """(source, target, n) between each host (columns host, n: its pages) and its parent domain, and so on up to the one of two labels; both ways."""
    labels = F.split("host", r"\.")
    name = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    steps = F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(name(i).alias("low"), name(i + 1).alias("high")))
    up = hosts.where(F.size(labels) > 2).select(F.explode(steps).alias("s"), "n").groupBy("s").agg(F.sum("n").cast("double").alias("n"))
    ways = F.array(F.struct(F.col("s.low").alias("source"), F.col("s.high").alias("target")), F.struct(F.col("s.high").alias("source"), F.col("s.low").alias("target")))
    return up.select(F.explode(ways).alias("e"), "n").select("e.source", "e.target", "n")


def judge_urls(pages: DataFrame, rules: list[Rule], spread: Spread = Spread(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, host, path, rule, verdict, by): one row per page; ``by``: rule or links.

    Pages that no rule fits get their host's verdict: block if the distrust that reached it is over ``spread.factor`` times its trust, else allow.  Seeds are
    hosts with pages that rules decide, with the numbers of those allowed and blocked; edges are the links of pages to other hosts, counted per pair of hosts before
    anything is joined, and each host's with its parent domain (:func:`domain_links`), which counts as linked both ways, for pages link within their
    host mostly.

    Null urls and urls without ``://`` have empty hosts, which take no part in the spread and are allowed; null html has no links.  Repeated rows
    count again as pages and stay, with equal results.  Other columns, whatever their names, are not looked at; an empty table gives no rows.
    """
    written = Written(pages.sparkSession, "urls")
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    seen = seen.withColumn("ruled", ruling(F.col("host"), F.col("path"), rules))
    hosts = seen.where("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled.verdict") == "allow").alias("allowed"), F.count_if(F.col("ruled.verdict") == "block").alias("blocked"))
    hosts = written(hosts)
    seeds = hosts.select("host", F.col("allowed").cast("double").alias("trust"), F.col("blocked").cast("double").alias("distrust")).where("trust > 0 or distrust > 0")
    linked = F.transform(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER))
    links = pages.select(host_of(url).alias("source"), F.explode(linked).alias("target")).where("source != '' and source != target")
    links = links.groupBy("source", "target").agg(F.count(F.lit(1)).cast("double").alias("n"))
    links = written(links.union(domain_links(hosts)).groupBy("source", "target").agg(F.sum("n").alias("n")))
    scores = propagate(links, seeds, spread, written)
    bad = written(scores.where(F.col("distrust") > spread.factor * F.col("trust")).select("host", F.lit("block").alias("linked")))
    out = seen.join(bad, "host", "left")
    by = F.when(F.col("ruled").isNotNull(), "rule").otherwise("links")
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce("ruled.verdict", "linked", F.lit("allow")).alias("verdict"), by.alias("by"))
