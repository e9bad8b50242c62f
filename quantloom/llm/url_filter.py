"""URL filter: explicit rules first, then trust and distrust spread over the link graph of hosts.

The longest rule that fits a URL decides it.  For the other URLs the host decides, by personalised
PageRank: hosts are seeds of trust by the share of their pages that a rule allows and seeds of distrust
by the share that a rule blocks.  Trust flows along the links between hosts, distrust against them, to those who
link to bad hosts; a host passes ``damping`` of its score on, in equal parts to its neighbours.

PageRank grows with the number of neighbours, so no raw score is held against a threshold.  Each is
divided by the PageRank that the host has in the same direction with every host as a seed of weight one.  The
quotient is the part of the host's own rank that stems from trusted (or blocked) seeds: a number from 0 to 1 that
follows neither pages nor neighbours.  A host is blocked when distrust / (distrust + trust + prior) reaches the
threshold; ``prior`` stands for what is not known about a host, so that one link in many does not block it.

Edges are distinct pairs of hosts.  Each round is one join and one aggregation over them, both directions and both
ranks at once, with sums combined map-side; rounds go on until no rank has moved by more than ``tolerance`` of the
host's rank in ``every`` rounds.  Ranks only grow and what is on its way shrinks by ``damping`` a round, so this ends;
a reliable checkpoint cuts the lineage every ``every`` rounds.  Nothing per host meets on the driver.  The pages of
hosts that hold over a thousandth of all pages get their score by broadcast (fewer than a thousand such hosts exist).

Mass at hosts without links in a direction ends there; sending it back to the seeds would only scale all ranks of a kind alike.

Defined cases: null URLs and those without "://" have empty host and path, fit no rule and are
allowed; a URL without path fits no rule with one; null bodies have no links; hosts without pages pass
scores on; repeated rows count as pages of their own; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def match(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and action of the longest rule that fits; null without one."""
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # later, longer rules win
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): pairs of different hosts with a link from one to the other, from absolute and protocol-relative link targets."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:https?:)?//[^\s"'<>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(targets).alias("target"))
    links = links.select("src", split_url(F.regexp_replace("target", "^//", "http://"))[0].alias("dst"))
    return links.where((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst"))).distinct()


def ranks(links: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """(kind, host, rank, base): personalised PageRank from the seeds of each kind, and PageRank from all hosts alike.

    ``links`` has (src, dst), ``seeds`` (host, trust, distrust) for every host with pages; trust flows from src to dst, distrust back.
    """
    steps = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to")).unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to")))
    degree = steps.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    step = checkpoint(steps.join(degree, ["kind", "host"]).select("kind", "host", "to", (damping / F.col("degree")).alias("share")))
    nodes = seeds.unionByName(links.select(F.explode(F.array("src", "dst")).alias("host")).distinct(), allowMissingColumns=True)
    seed = nodes.groupBy("host").agg(F.coalesce(F.max("trust"), F.lit(0.0)).alias("trust"), F.coalesce(F.max("distrust"), F.lit(0.0)).alias("distrust"))
    start = checkpoint(seed.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "rank"), F.lit(1.0).alias("base")))
    now = before = start.select("kind", "host", "rank", "base")
    change, i = (0.0 if step.isEmpty() else 1.0), 0
    while change > tolerance:
        flow = now.join(step, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("share")).alias("rank"), (F.col("base") * F.col("share")).alias("base"))
        now, i = start.unionByName(flow).groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("base").alias("base")), i + 1
        if i % every == 0:
            now = checkpoint(now)
            was = before.select("kind", "host", F.col("base").alias("_was"))
            change = now.join(was, ["kind", "host"]).agg(F.max((F.col("base") - F.col("_was")) / F.col("base"))).first()[0] or 0.0
            before = now
    return now


def verdicts(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5, prior: float = 0.2, damping: float = 0.85, tolerance: float = 1e-3) -> DataFrame:
    """page_id, host, path, rule, verdict and the badness of the host per row."""
    host, path = split_url(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, action = match(F.col("host"), F.col("path"), rules)
    judged = split.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    hosts = checkpoint(judged.where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.avg(F.col("action").eqNullSafe("allow").cast("double")).alias("trust"),
        F.avg(F.col("action").eqNullSafe("block").cast("double")).alias("distrust")))
    links = checkpoint(host_edges(split.select("host", "html")))
    part = ranks(links, hosts.select("host", "trust", "distrust"), damping, tolerance).withColumn("part", F.col("rank") / F.col("base"))
    both = part.groupBy("host").agg(F.max(F.when(F.col("kind") == "trust", F.col("part"))).alias("t"), F.max(F.when(F.col("kind") == "distrust", F.col("part"))).alias("d"))
    scored = checkpoint(hosts.select("host", "pages").join(both.select("host", (F.col("d") / (F.col("d") + F.col("t") + prior)).alias("badness")), "host"))
    total = scored.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    is_hot = F.col("pages") * 1000 > total
    hot = F.broadcast(scored.where(is_hot).select("host", F.col("badness").alias("_hot")))
    cold = scored.where(~is_hot).select(F.col("host").alias("_key"), "badness")
    # rows that need no look-up get keys of their own ("#" is in no host), so that they do not meet in one task
    alone = F.col("_hot").isNotNull() | (F.col("host") == "")
    keyed = judged.join(hot, "host", "left").withColumn("_n", F.monotonically_increasing_id()).withColumn(
        "_key", F.when(alone, F.concat(F.lit("#"), "_n")).otherwise(F.col("host")))
    out = keyed.join(cold, "_key", "left").withColumn("badness", F.coalesce("_hot", "badness", F.lit(0.0)))
    default = F.when(F.col("badness") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", default).alias("verdict"), "badness")
