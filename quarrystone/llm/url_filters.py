"""URL filters: rules first, then trust and distrust over the host graph.

Links between hosts come from the pages' ``href`` attributes, those without a scheme
(``//host/...``) among them; links within a site stay in its host.  Trust flows
from hosts with allowed pages along the links, distrust from hosts with blocked
pages against them (personalised PageRank with teleport to the seeds, which what hosts without links hold
returns to).  Seeds of both kinds share one mass by their pages, so a few blocked pages
don't outweigh many trusted ones.  A page
that no rule fits is blocked if its host's distrust is at least ``threshold`` of
trust plus distrust, else allowed.

Defined results: a url that is null or lacks ``://`` has an empty host and path
and is allowed if no rule fits; a null page text has no links; repeated rows are
judged each for itself; a page of no rule whose host's distrust is just the threshold is
blocked; urls and texts of any length are read whole; an empty table gives no rows; only
the named columns of the input are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.common import ascii_lower, dropped, stored

#: (host, path, verdict)
Rules = list[tuple[str, str, str]]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(after)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def longest_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        on = fits(host, path, h, p)
        text, verdict = F.when(on, F.lit(h + p)).otherwise(text), F.when(on, F.lit(v)).otherwise(verdict)
    return text, verdict


def host_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(src, dst, n): how many links lead from one host to another."""
    urls = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(urls).alias("to")).select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), F.col("to"))).otherwise(F.col("to"))).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, *, damping: float = 0.85, tolerance: float = 1e-6, most_rounds: int = 1000, rounds_per_table: int = 4) -> DataFrame:
    """Personalised PageRank of both kinds at once: (host, kind, score).

    ``seeds``: (host, kind, mass).  Kind ``trust`` follows a link, kind ``distrust`` goes
    back along it.  Rounds go on until scores move by ``tolerance`` at most and no host is
    reached for the first time.  They lose what hosts without links hold; giving it back to
    the seeds in each round multiplies all scores of a kind by one number, so it is done
    once, at the end: a kind's scores sum to its seeds' masses."""
    one = links.select(F.lit("trust").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n")
    both = one.unionByName(back)
    out = both.groupBy("kind", "from").agg(F.sum("n").alias("all"))
    edges = stored(both.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("all")).alias("share")), "links")
    seeds = stored(seeds, "seeds")
    ranks = seeds.select("host", "kind", F.col("mass").alias("score"))
    if not edges.take(1):
        return ranks
    held = None
    for k in range(1, most_rounds + 1):
        was = ranks
        flow = ranks.withColumnRenamed("host", "from").join(edges, ["kind", "from"]).select(F.col("to").alias("host"), "kind", (damping * F.col("score") * F.col("share")).alias("score"))
        home = seeds.select("host", "kind", ((1 - damping) * F.col("mass")).alias("score"))
        ranks = flow.unionByName(home).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if k % rounds_per_table == 0 or k == most_rounds:
            ranks = stored(ranks, "ranks")
            both = ranks.withColumnRenamed("score", "now").join(was, ["host", "kind"], "full")
            change = F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("score", F.lit(0.0))))
            moved, new = both.select(change, F.count_if(F.col("score").isNull())).first()
            if held is not None:
                dropped(held)
            held = ranks
            if (moved or 0.0) <= tolerance and not new:
                return _whole(ranks, seeds)
    raise RuntimeError(f"scores of hosts don't settle in {most_rounds} rounds")


def _whole(ranks: DataFrame, seeds: DataFrame) -> DataFrame:
    sums = ranks.groupBy("kind").agg(F.sum("score").alias("got")).join(seeds.groupBy("kind").agg(F.sum("mass").alias("due")), "kind")
    return ranks.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("score") * F.col("due") / F.col("got")).alias("score"))


def judge_urls(pages: DataFrame, rules: Rules, *, page_id: str = "page_id", url: str = "url", html: str = "html", threshold: float = 0.5, floor: float = 0.5, **options) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page.

    A host without a rule is blocked where its distrust is at least ``threshold`` of its trust and
    distrust, and at least ``floor`` times what a host would hold if all distrust were spread
    evenly over the hosts with any: a faint trace from far along the links blocks nobody."""
    p = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "by_rule": verdict})
    judged = p.where(F.col("by_rule").isNotNull() & (F.col("host") != ""))
    kind = F.when(F.col("by_rule") == "block", "distrust").otherwise("trust")
    seeds = judged.groupBy("host", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    seeds = seeds.join(F.broadcast(seeds.agg(F.sum("n").alias("all")))).select("host", "kind", (F.col("n") / F.col("all")).alias("mass"))
    ranks = propagate(host_links(p), seeds, **options)
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    hosts = ranks.groupBy(F.col("host").alias("at")).agg(of("trust"), of("distrust"))
    slim = p.drop("html")
    ruled = slim.where(F.col("by_rule").isNotNull()).select("page_id", "host", "path", "rule", F.col("by_rule").alias("verdict"), F.lit(None).cast("double").alias("trust"), F.lit(None).cast("double").alias("distrust"))
    other = slim.where(F.col("by_rule").isNull()).join(hosts, F.col("host") == F.col("at"), "left")
    even = hosts.agg(F.try_divide(F.sum("distrust"), F.count_if(F.col("distrust") > 0)).alias("even"))
    other = other.join(F.broadcast(even), F.lit(True), "left")
    bad = (F.col("distrust") > 0) & (F.col("distrust") >= floor * F.col("even")) & (F.col("distrust") >= threshold * (F.col("trust") + F.col("distrust")))
    other = other.select("page_id", "host", "path", "rule", F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow").alias("verdict"), "trust", "distrust")
    return ruled.unionByName(other)
