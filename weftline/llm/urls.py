"""URL filters: rules first, then trust and distrust that spread over the graph of links between hosts.

Rules name a host and a path; the longest that fits decides.  Rules are a table: each distinct host is joined, by each
of its parent domains, with the rules of that domain, and a page then takes the first of its host's rules that fits its
path.  Their number is not bounded by the plan.

For all other urls the host decides: a personalised PageRank starts from trusted hosts and follows links, distrust
starts from blocked hosts and follows them backwards (who links to a blocked host shares its distrust).  A host's seeds
are the shares of its pages that rules allow or block.  Both solve ``mass = seed + damping * inflow``.  This is, up to
one factor for all hosts, the PageRank whose random jumps and dangling hosts return to the seeds; without that factor a
host's score is its own seed and what links bring it on top, so links elsewhere change no score and one threshold fits
all tables, with links or without; a score exceeds 1 where many links bring more.  Scores are whole nano-units; sums do
not depend on the order of rows.  A host is blocked if its distrust reaches ``threshold`` and exceeds its trust.

Links come from the pages' ``href`` attributes and are counted per pair of hosts before any shuffle of single links.
Joins by host are salted: a host may hold a third of all pages or links.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and is judged as the host
``''``; pages without links and hosts without pages have no out-links; repeated pages count again; of rules that are
equally long the first in order of text decides; without rules nothing is a seed and all is allowed; other columns than
the id, url and html are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialised, salted_join

NANO = 1_000_000_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    target: str  # host, then path from its first slash on


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_by_host(hosts: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``host, rules``: of each host that rules name, itself or by a parent domain, these rules, the longest first.

    ``rules`` as a DataFrame has the columns ``verdict, target``.
    """
    spark = hosts.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame([(r.verdict, r.target) for r in rules], "verdict string, target string")
    at = F.instr("target", "/")
    table = table.select(F.expr("substring(target, 1, instr(target, '/') - 1)").alias("domain"), F.expr("substring(target, instr(target, '/'))").alias("start"), "target", "verdict").where(at > 0)
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    named = hosts.select("host").where("host != ''").distinct().select("host", F.explode(domains).alias("domain"))
    found = salted_join(named, table.groupBy("domain").agg(F.collect_set(F.struct((-F.char_length("target")).alias("order"), "target", "start", "verdict")).alias("r")), "domain")
    return found.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("rules"))


def ruled(pages: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``pages`` (with ``host, path``) and ``rule, ruled``: the longest rule that fits and its verdict, or nulls."""
    with_rules = salted_join(pages, rules_by_host(pages, rules), "host", "left")
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["start"])), 0)
    return with_rules.select(*pages.columns, first["target"].alias("rule"), first["verdict"].alias("ruled"))


def host_links(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, n``: links between different hosts."""
    links = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]*://[^"'\s>]+)"""), F.lit(1))
    pairs = pages.select(host_of(F.col(url)).alias("src"), F.explode(links).alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    return pairs.where("src != dst and dst != ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(seeds: DataFrame, links: DataFrame, *, damping: float = 0.85, rounds: int = 400, cut_every: int = 4, settled: int = NANO // 1_000_000) -> DataFrame:
    """``side, host, mass`` over ``side, src, dst, n``; ``seeds``: side, host, seed (nano-units).  Sides do not mix.

    Each step a host has its seed and the damped mass of those that link to it.  The steps end once no mass moves by more
    than ``settled`` in a step (looked at every ``cut_every`` steps).  What moves shrinks by ``damping`` a step, from all
    seeds together at most; more than ``rounds`` steps are an error.
    """
    out = links.groupBy("side", "src").agg(F.sum("n").alias("all"))
    shares = materialised(salted_join(links, out, ["side", "src"]).select("side", "src", "dst", (F.col("n") / F.col("all")).alias("share")))
    now = seeds.select("side", "host", F.col("seed").alias("mass"), F.col("seed").alias("before"))
    if shares.isEmpty():
        return now.drop("before")  # what the rounds would give
    none = F.lit(0).cast("long")
    for k in range(rounds):
        sent = now.select("side", F.col("host").alias("src"), "mass")
        moved = salted_join(shares, sent, ["side", "src"]).groupBy("side", F.col("dst").alias("host")).agg(F.sum(F.floor(F.col("mass") * F.col("share") * damping)).alias("inflow"))
        parts = [seeds.select("side", "host", F.col("seed").alias("mass"), none.alias("before")), moved.select("side", "host", "inflow", none), now.select("side", "host", none, "mass")]
        now = parts[0].union(parts[1]).union(parts[2]).groupBy("side", "host").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before"))
        if (k + 1) % cut_every == 0:
            now = materialised(now)
            if now.where(F.abs(F.col("mass") - F.col("before")) > settled).isEmpty():
                return now.drop("before")
    raise RuntimeError(f"masses still move after {rounds} rounds")


def judged(pages: DataFrame, rules: list[Rule] | DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, damping: float = 0.85, rounds: int = 400) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of each page."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    cut = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    cut = materialised(ruled(cut, rules))
    share = lambda what: F.floor(F.count_if(F.col("ruled") == what) * NANO / F.count(F.lit(1)))
    hosts = materialised(cut.groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked")))
    links = materialised(host_links(pages, url=url, html=html))
    back = links.select(F.lit("distrust").alias("side"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = links.select(F.lit("trust").alias("side"), "src", "dst", "n").unionByName(back)
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trusted", F.lit("distrust"), "blocked")).alias("side", "seed"))
    mass = spread(seeds, both, damping=damping, rounds=rounds)
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("mass"))), F.lit(0)).alias(side)
    scored = mass.groupBy("host").agg(of("trust"), of("distrust"))
    bad = (F.col("distrust") >= int(threshold * NANO)) & (F.col("distrust") > F.col("trust"))
    method = F.when(bad, "block").otherwise("allow")
    return salted_join(cut, scored, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), (F.col("trust") / NANO).alias("trust"), (F.col("distrust") / NANO).alias("distrust"))
